"""The command line: options, events, exit codes."""

import json
import os
import zipfile
from dataclasses import fields

import numpy as np
import pytest

from folioloom import __main__ as cli
from folioloom import api
from folioloom.operators.pages import PageOptions
from folioloom.sinks import images


@pytest.fixture(scope="module")
def volume(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    with zipfile.ZipFile(root / "tale.cbz", "w") as z:
        for i in range(3):
            z.writestr(f"p{i}.png", images.png(np.full((90, 60), 20 * i, np.uint8)))
        z.writestr("notes.txt", "x")
    return str(root / "tale.cbz")


def test_every_field_has_its_option():
    named = {*cli.SWITCHES.values(), *(f for f, _, _ in cli.VALUES.values())}
    assert {f.name for f in fields(PageOptions)} | {f.name for f in fields(api.Request)} == named | {"options", "labels", "kepub"}
    args = cli.parser().parse_args(["x", "-m", "-p", "KoC", "--metadatatitle", "title-only", "--jpeg-quality", "70", "--nokepub", "--invertdirection", "--ipc", "both"])
    request = cli.request_of(args)
    assert request.options == PageOptions(profile="KoC", right_to_left=True, jpeg_quality=70, inter_panel="both") and request.title_mode == "title_only" and request.invert_direction and not request.kepub


def test_conversion_and_plan(spark, volume, tmp_path, capsys):
    assert cli.main([volume, "-p", "KoC", "-f", "epub", "--dry-run"], spark) == 0
    assert "tale.kepub.epub: 3 pages in 1 chapters" in capsys.readouterr().out
    assert cli.main([volume, "-p", "KoC", "-f", "epub", "-o", str(tmp_path), "--json-events"], spark) == 0
    events = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [e["sequence"] for e in events] == list(range(len(events))) and {e["protocol"] for e in events} == {1}
    done = [e for e in events if e["type"] == "result"]
    assert [os.path.basename(e["output_path"]) for e in done] == ["tale.kepub.epub"] and done[0]["written"] and os.path.exists(done[0]["output_path"])
    assert {e["code"] for e in events if e["type"] == "warning"} == {"skipped_non_images", "images_smaller_than_device"}


def test_failures_and_lists(spark, volume, tmp_path, capsys):
    assert cli.main([str(tmp_path / "none.cbz")], spark) == 1 and "there is no" in capsys.readouterr().err
    assert cli.main([volume, "-p", "KoX"], spark) == 1 and "did you mean" in capsys.readouterr().err
    (tmp_path / "bad.json").write_text('{"spreads": ["1"]}')
    assert cli.main([volume, "--spreads", str(tmp_path / "bad.json"), "--json-events"], spark) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["code"] == "spread_labels_read_failed"
    assert cli.main(["--protocol-version"]) == 0 and capsys.readouterr().out.strip() == "1"
    assert cli.main(["--list-profiles"], spark) == 0 and "KoC" in capsys.readouterr().out
    for wrong in ([], ["x", "-f", "txt"], ["x", "--jpeg-quality", "0"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == 2
