"""Progress in order, whatever the order in which pages finish."""

import json
import os
import random
import zipfile

import numpy as np
import pytest

from folioloom import __main__ as cli
from folioloom.sinks import images
from folioloom.streaming import progress


def _pages(chapters, failed=()):
    rows = [(c, i) for c, n in enumerate(chapters) for i in range(n)]
    return [(place, len(rows), f"c{c}", 1, "page_processing_failed: x" if place in failed else None) for place, (c, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(6))
def test_any_order_gives_the_same_events(seed):
    """In micro-batches of any size, with repetitions, events are those of pages that finish in order."""
    pages = _pages((3, 1, 4), failed=(5, 6) if seed % 2 else ())
    straight = [e[1:] for e in progress.advance("b", None, pages)[1]]
    rng = random.Random(seed)
    mixed = [*pages, *rng.sample(pages, 3)]
    rng.shuffle(mixed)
    state, told = None, []
    while mixed:
        n = rng.randint(1, 4)
        before = len(told)
        state, events = progress.advance("b", state, mixed[:n])
        told += events
        mixed = mixed[n:]
        contiguous = [e[6] for e in told[before:]]
        assert contiguous == sorted(contiguous)
    assert [e[1:] for e in told] == straight and [e[1] for e in told] == list(range(1, len(told) + 1))
    kinds = [e[2] for e in told]
    assert kinds.count("chapter_started") == kinds.count("chapter_finished") == 3 and kinds[-1] == ("failed" if seed % 2 else "finished") and kinds.count("error") == seed % 2


def test_stream_of_marks(spark, tmp_path):
    rng = random.Random(3)
    rows = [(book, *p) for book in ("a", "b") for p in _pages((2, 3))]
    rng.shuffle(rows)
    (tmp_path / "marks").mkdir()
    told = []
    query = progress.follow(spark, str(tmp_path / "marks"), lambda e: told.append(tuple(e)), str(tmp_path / "checkpoint"))
    try:
        for part in (rows[:3], rows[3:7], rows[7:]):
            marks = progress.Marks(str(tmp_path / "marks"))
            for r in part:
                marks.add(*r)
            marks.flush()
            query.processAllAvailable()
    finally:
        query.stop()
    for book in ("a", "b"):
        own = [e for e in told if e[0] == book]
        assert [e[1] for e in own] == list(range(1, 11)) and [e[4] for e in own if e[2] == "page"] == [1, 2, 3, 4, 5] and own[-1][2] == "finished"
    assert not [n for n in os.listdir(tmp_path / "marks") if not n.endswith((".json", ".crc"))]


def test_conversion_tells_of_chapters_and_pages(spark, tmp_path, capsys):
    with zipfile.ZipFile(tmp_path / "tale.cbz", "w") as z:
        for c in (1, 2):
            for i in range(3):
                z.writestr(f"c{c}/p{i}.png", images.png(np.full((90, 60), 20 * i, np.uint8)) if (c, i) != (2, 1) else b"\x89PNG\r\n\x1a\n?")
        z.writestr("ComicInfo.xml", "<ComicInfo/>")
    assert cli.main([str(tmp_path / "tale.cbz"), "-p", "KoC", "-f", "epub", "-o", str(tmp_path / "out"), "--json-events"], spark) == 0
    events = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [e["sequence"] for e in events] == list(range(len(events)))
    assert [(e["chapter"], e["state"]) for e in events if e["type"] == "chapter"] == [("c1", "started"), ("c1", "finished"), ("c2", "started"), ("c2", "finished")]
    assert [(e["page"], e["completed"], e["total"]) for e in events if e["type"] == "page"] == [(i, i, 6) for i in (1, 2, 3, 4, 6)]
    assert [(e["code"], e["page"]) for e in events if e["type"] == "error"] == [("page_processing_failed", 5)]
    assert os.listdir(tmp_path / "out") == ["tale.kepub.epub"]
