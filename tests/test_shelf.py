"""Publication: plans, stages, names that are taken, jobs that fail."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom import __main__ as cli
from folioloom import api
from folioloom.sinks import images, shelf

SCHEMA = "book_id string, name string, turn int, bytes long, pages int, content binary, error string"


def _books(spark, rows):
    return spark.createDataFrame([(b, n, t, len(c or b""), 1, c, e) for b, n, t, c, e in rows], SCHEMA)


def test_nothing_is_overwritten_and_nothing_stays(spark, tmp_path):
    (tmp_path / "a.cbz").write_bytes(b"previous")
    rows = [("1", "a.cbz", 0, b"one", None), ("2", "a.cbz", 1, b"two", None), ("3", "b.kepub.epub", 0, b"three", None), ("4", "c.cbz", 0, None, "book_build_failed: no page")]
    told = {r.book_id: r for r in shelf.write(_books(spark, rows).repartition(3), str(tmp_path)).collect()}
    assert {b: r.path and os.path.basename(r.path) for b, r in told.items()} == {"1": "a (folioloom).cbz", "2": "a (folioloom 2).cbz", "3": "b.kepub.epub", "4": None}
    assert told["4"].error == "book_build_failed: no page" and (tmp_path / "a.cbz").read_bytes() == b"previous" and (tmp_path / "a (folioloom 2).cbz").read_bytes() == b"two"
    again = {r.book_id: r.path for r in shelf.write(_books(spark, rows[2:3]), str(tmp_path)).collect()}
    assert again == {"3": told["3"].path} and sorted(os.listdir(tmp_path)) == ["a (folioloom 2).cbz", "a (folioloom).cbz", "a.cbz", "b.kepub.epub"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = _books(spark, [(str(i), f"{i}.cbz", 0, b"x", None) for i in range(8)]).repartition(4)
    broken = rows.withColumn("content", F.when(F.col("book_id") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        shelf.write(broken, str(tmp_path / "new")).collect()
    assert os.listdir(tmp_path / "new") == []


def test_impossible_destinations_fail_before_any_work(spark, tmp_path):
    (tmp_path / "blocked").write_bytes(b"a file")
    for output in ("blocked/book.epub", "blocked/sub/book.epub", f"{'x' * 300}.epub", "CON.epub", "missing?/book.epub", "trailing./x.cbz", "a:b"):
        with pytest.raises(api.ConversionError) as e:
            api.destination(str(tmp_path), str(tmp_path / output))
        assert (e.value.code, e.value.stage) == ("output_plan_failed", "plan")
    with pytest.raises(api.ConversionError):
        api.destination(str(tmp_path), "nosuchscheme://x/y")
    assert sorted(os.listdir(tmp_path)) == ["blocked"]
    assert api.destination(str(tmp_path), str(tmp_path / "missing/nested/book.cbz")) == (str(tmp_path / "missing/nested"), "book.cbz")
    assert api.destination(str(tmp_path), str(tmp_path / "missing/nested")) == (str(tmp_path / "missing/nested"), None)
    (tmp_path / "folder.cbz").mkdir()
    assert api.destination(str(tmp_path), str(tmp_path / "folder.cbz")) == (str(tmp_path / "folder.cbz"), None)
    with pytest.raises(shelf.PlanError) as e:
        shelf.open_stage(str(tmp_path / "blocked" / "x"))
    assert e.value.code == "output_directory_create_failed"


def test_names_planned_are_those_that_are_free(spark):
    names = spark.createDataFrame([("1", "a.cbz"), ("2", "A.cbz"), ("3", "b.kepub.epub"), ("4", "c.pdf"), ("5", "c.pdf")], "book_id string, name string")
    there = spark.createDataFrame([("a.cbz",), ("a (folioloom 2).cbz",), ("b.kepub.epub",), ("b (folioloom).kepub.epub",), ("c (folioloom).pdf",), ("other",)], "name string")
    found = {r.book_id: (r.turn, r.output, r.occupied) for r in shelf.planned(names, there).collect()}
    assert found == {"1": (0, "a (folioloom).cbz", True), "2": (1, "A (folioloom 3).cbz", True), "3": (0, "b (folioloom 2).kepub.epub", True), "4": (0, "c.pdf", False), "5": (1, "c (folioloom 2).pdf", False)}


def _archive(path):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for i in range(2):
            z.writestr(f"p{i}.png", images.png(np.full((90, 60), 30 * i, np.uint8)))


def test_the_plan_is_what_a_run_writes(spark, tmp_path, capsys):
    import json

    _archive(tmp_path / "tale.cbz")
    before = (tmp_path / "tale.cbz").read_bytes()
    events = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    for output in (None, str(tmp_path / "missing/nested"), str(tmp_path / "deep/er/book.cbz")):
        args = [str(tmp_path / "tale.cbz"), "-p", "KV", "-f", "cbz", "--json-events", *(["-o", output] if output else [])]
        listed = sorted(os.listdir(tmp_path))
        assert cli.main([*args, "--dry-run"], spark) == 0
        plan = events()
        assert sorted(os.listdir(tmp_path)) == listed and not any(e.get("stage") == "process" for e in plan)
        assert cli.main(args, spark) == 0
        done = events()
        assert plan[-1]["output_path"] == next(e for e in done if e["type"] == "result")["output_path"]
        assert os.listdir(os.path.dirname(plan[-1]["output_path"])).count(os.path.basename(plan[-1]["output_path"])) == 1
        codes = [e["code"] for e in done if e["type"] == "warning"]
        assert ("output_collision" in codes) == (output is None)
    assert (tmp_path / "tale.cbz").read_bytes() == before and (tmp_path / "tale (folioloom).cbz").exists() and not [n for n in os.listdir(tmp_path) if n.startswith(".")]
    assert cli.main([*args, "-o", str(tmp_path / "CON.cbz")], spark) == 1 and events()[-1]["code"] == "output_plan_failed"


def test_publication_in_a_folder_of_any_file_system(spark, tmp_path):
    """Without hard links a name is taken by a check and a move."""
    from pyarrow import fs

    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    for name, data in (("s1", b"one"), ("s2", b"two"), ("s3", b"one"), ("a.cbz", b"old")):
        with system.open_output_stream(name) as f:
            f.write(data)
    assert shelf.publish(system, "", "s1", "a.cbz", 0) == "a (folioloom).cbz"
    assert shelf.publish(system, "", "s2", "a.cbz", 0) == "a (folioloom 2).cbz"
    assert shelf.publish(system, "", "s3", "a.cbz", 1) == "a (folioloom).cbz"
    assert sorted(os.listdir(tmp_path)) == ["a (folioloom 2).cbz", "a (folioloom).cbz", "a.cbz"]


