"""Conversion from the command line: `python -m folioloom INPUT -p KoC -o OUT`, or by spark-submit.

Every option is a field of PageOptions or Request. Exit codes: 0 success, 1 a failure, 2 wrong arguments. Warnings and
errors go to stderr, lists and plans to stdout; with --json-events stdout has JSON lines only, numbered without a gap.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from folioloom import api
from folioloom.operators.pages import PageOptions
from folioloom.sinks import shelf
from folioloom.streaming import progress

PROTOCOL = 1
# Options by their names, and the fields that they set.
SWITCHES = {
    "m manga-style": "right_to_left", "u upscale": "upscale", "s stretch": "stretch", "wallpaper": "wallpaper", "blackborders": "black_borders", "whiteborders": "white_borders",
    "forcepng": "force_png", "norotate": "no_rotate", "rotatefirst": "rotate_first", "maximizestrips": "maximize_strips", "rotateright": "rotate_right", "w webtoon": "webtoon",
    "forcecolor": "force_color", "force-png-rgb": "force_png_rgb", "colorautocontrast": "color_autocontrast", "pnglegacy": "png_legacy", "noquantize": "no_quantize", "noprocessing": "no_processing",
    "autolevel": "autolevel", "noautocontrast": "no_autocontrast", "eraserainbow": "erase_rainbow", "invertdirection": "invert_direction", "spreadshift": "spread_shift", "onepagelandscape": "one_page",
    "smartcovercrop": "smart_cover_crop", "coverfill": "cover_fill", "keepcomicinfo": "keep_comic_info", "nested-toc": "nested_toc",
}
VALUES = {
    "p profile": ("profile", str, None), "c cropping": ("cropping", str, ("disabled", "margins", "margins-and-page-numbers")), "croppingpower": ("cropping_power", float, None), "croppingminimum": ("cropping_minimum", float, None),
    "preservemargin": ("preserve_margin", float, None), "r splitter": ("splitter", str, ("split", "rotate", "both")), "jpeg-quality": ("jpeg_quality", int, range(1, 101)), "g gamma": ("gamma", str, None),
    "ipc": ("inter_panel", str, ("disabled", "horizontal", "both")), "f format": ("format", str, ("auto", "epub", "cbz", "pdf")), "t title": ("title", str, None), "a author": ("author", str, None),
    "metadatatitle": ("title_mode", str, ("series-only", "combine", "title-only")), "language": ("language", str, None), "customwidth": ("custom_width", int, None), "customheight": ("custom_height", int, None), "cover": ("cover", str, None),
}


def _names(option: str) -> list[str]:
    return [f"-{x}" if len(x) == 1 else f"--{x}" for x in option.split()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioloom", description=__doc__.split("\n", 1)[0])
    p.add_argument("input", nargs="?")
    p.add_argument("-o", "--output", help="folder for the books, or a file for the only one; by default the folder of the input")
    p.add_argument("--spreads", help='a file of labelled pages: {"spreads": [12, 40]}')
    for name in ("--list-profiles", "--json-events", "--protocol-version", "--nokepub"):
        p.add_argument(name, action="store_true")
    p.add_argument("-n", "--dry-run", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    for option, field in SWITCHES.items():
        p.add_argument(*_names(option), dest=field, action="store_true")
    for option, (field, kind, choices) in VALUES.items():
        p.add_argument(*_names(option), dest=field, type=kind, choices=choices, metavar=None if choices and not isinstance(choices, range) else field.upper())
    return p


def request_of(args: argparse.Namespace) -> api.Request:
    told = {k: v for k, v in vars(args).items() if v is not None and v is not False}
    if "title_mode" in told:
        told["title_mode"] = told["title_mode"].replace("-", "_")
    page = {f.name for f in fields(PageOptions)}
    rest = {f.name for f in fields(api.Request)} - {"options", "labels", "kepub"}
    labels: tuple[int, ...] = ()
    if args.spreads:
        try:
            with open(args.spreads, encoding="utf-8") as f:
                labels = tuple(json.load(f)["spreads"])
            if any(type(p) is not int or p < 0 for p in labels):
                raise ValueError("a position is no whole number from 0 up")
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise api.ConversionError("spread_labels_read_failed", str(e)) from e
    options = PageOptions(**{k: v for k, v in told.items() if k in page})
    return api.Request(options=options, labels=labels, kepub=not args.nokepub, **{k: v for k, v in told.items() if k in rest})


class Output:
    """Events as JSON lines, or text for people."""

    def __init__(self, as_json: bool, quiet: bool):
        self.as_json, self.quiet, self.sequence = as_json, quiet, 0

    def event(self, kind: str, **told) -> None:
        if self.as_json:
            print(json.dumps({"protocol": PROTOCOL, "sequence": self.sequence, "type": kind, **{k: v for k, v in told.items() if v is not None}}, ensure_ascii=False), flush=True)
            self.sequence += 1

    def say(self, line: str) -> None:
        if not self.as_json and not self.quiet:
            print(line, file=sys.stderr)

    def warn(self, code: str, message: str | None, **where) -> None:
        self.event("warning", code=code, stage=stage_of(code), message=message, **where)
        if not self.as_json:
            print(f"{where.get('book') or ''}: {code}" + (f" ({message})" if message else ""), file=sys.stderr)

    def fail(self, code: str, message: str) -> int:
        self.event("error", code=code, stage=stage_of(code), message=message)
        print(f"error: {message}", file=sys.stderr)
        return 1


def stage_of(code: str) -> str:
    return next((s for s, codes in api.ISSUES.items() if code in codes), "process")


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a plan or a report, one for each book or issue."""
    return [r.asDict() for r in df.collect()]


def run(spark: SparkSession, args: argparse.Namespace, out: Output) -> int:
    try:
        if args.list_profiles:
            for row in _rows(api.list_profiles(spark)):
                out.event("profile", **row)
                if not out.as_json:
                    print("\t".join(str(row[c]) for c in ("code", *[c for c in row if c not in ("code", "decl_ord")])))
            return 0
        request = api.resolve(request_of(args))
        if not api.exists(spark, args.input):
            raise api.ConversionError("input_not_found", f"there is no {args.input}")
        folder, name = api.destination(args.input, args.output)
        out.event("stage", stage="inspect", state="started")
        plan = _rows(api.dry_run(spark, args.input, request, args.output or folder))
        if name is not None and len(plan) > 1:
            raise api.ConversionError("output_plan_failed", f"{len(plan)} books can't be one file {name}")
        for row in plan:
            if row["code"]:
                out.warn(row["code"], f"{row['output']} is written instead", book=row["book_id"])
        if args.dry_run:
            for row in plan:
                told = {k: v for k, v in row.items() if k not in ("code", "output")}
                out.event("result", dry_run=True, written=False, format=request.options.output, profile=request.options.profile, output_path=row["output"], **told)
                if not out.as_json:
                    print(f"{row['book_id']} -> {row['output']}: {row['pages']} pages in {row['chapters']} chapters")
            return 0
        try:
            stage = shelf.open_stage(folder)  # before page work
        except shelf.PlanError as e:
            raise api.ConversionError(e.code, str(e)) from e
        query = None
        try:
            out.event("stage", stage="process", state="started")
            marks = f"{stage}/marks" if out.as_json else None
            if marks:
                shelf.make_folder(marks)
                query = progress.follow(spark, marks, lambda e: out.event(e["type"].split("_")[0], book=e["book_id"], state=(e["type"].split("_") + [None])[1], chapter=e["chapter"], page=e["page"], code=e["code"], completed=e["done"], total=e["places"]), f"{stage}/followed")
            result = api.convert(spark, args.input, request, marks)
            failed = False
            done = _rows(api.written(result, folder, request, name, stage, keep=True))
            if query:
                query.processAllAvailable()
        finally:
            if query:
                query.stop()
            shelf.close_stage(stage)
        for row in done:
            if row["error"]:
                failed = bool(out.fail(row["error"].split(":")[0], f"{row['book_id']}: {row['error']}"))
            else:
                out.event("result", dry_run=False, written=True, format=request.options.output, profile=request.options.profile, book=row["book_id"], output_path=row["path"], bytes=row["bytes"], output_pages=row["pages"])
                out.say(f"{row['book_id']} -> {row['path']} ({row['pages']} pages)")
        for row in _rows(result.issues):
            out.warn(row["code"], row["diagnostic"], book=row["book_id"], page=row["path"])
        result.release()
        return int(failed)
    except api.ConversionError as e:
        return out.fail(e.code, str(e))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    out = Output(args.json_events, args.quiet)
    if args.protocol_version:
        out.event("protocol", version=PROTOCOL)
        if not args.json_events:
            print(PROTOCOL)
        return 0
    if not args.input and not args.list_profiles:
        p.error("an input is needed")
    try:
        return run(spark or SparkSession.builder.appName("folioloom").getOrCreate(), args, out)
    except BrokenPipeError:  # the reader of a list or a plan has gone
        sys.stdout = open(os.devnull, "w")
        return 1 if args.json_events else 0


if __name__ == "__main__":
    sys.exit(main())
