"""Progress in order: pages finish in any order on many tasks, and are told of in the order of their book.

A stream of finished pages is grouped by book. A book's state holds the place expected next and the pages that came early; a micro-batch
emits what has become contiguous: an event where a chapter begins, one for each page, one where a chapter ends, an error at the first page
that failed, and one when the book is done. Events of a book are numbered from 1 without a gap. A page that comes again (a task ran twice) is told of once.

The state of a book is as large as what is early: numbers and names, never contents. That of a finished book stays as one small row, so
that late repetitions are known; a folder of marks belongs to one conversion.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioloom.sources.archives import located

#: A finished page: its place from 0 among all places of its book, the number of places, and what went wrong (null: nothing).
FINISHED = "book_id string, place long, places long, chapter string, pages long, error string"
EVENTS = "book_id string, sequence long, type string, chapter string, page long, code string, done long, places long"
_STATE = "next long, sequence long, chapter string, failed boolean, early string"


class Marks:
    """What a task has finished, written to a folder as small files of JSON lines: at most one every few seconds."""

    def __init__(self, folder: str, every: float = 2.0):
        self.folder, self.every, self.rows, self.last = folder, every, [], time.monotonic()

    def add(self, book: str, place: int, places: int, chapter: str, pages: int, error: str | None) -> None:
        self.rows.append({"book_id": book, "place": place, "places": places, "chapter": chapter, "pages": pages, "error": error})
        if time.monotonic() - self.last > self.every:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            system, inner = located(self.folder)
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{inner}/.{name}") as f:
                f.write("\n".join(json.dumps(r) for r in self.rows).encode())
            system.move(f"{inner}/.{name}", f"{inner}/{name}.json")  # a stream sees whole files only
        self.rows, self.last = [], time.monotonic()


def advance(book: str, state: tuple | None, rows: Iterable[tuple[int, int, str, int, str | None]]) -> tuple[tuple, list[tuple]]:
    """The state after more finished pages (place, places, chapter, pages, error) and the events that follow."""
    at, sequence, chapter, failed, early = state or (0, 0, None, False, {})
    places = 0
    for place, places, *rest in rows:
        if place >= at:
            early.setdefault(place, rest)
    events: list[tuple] = []

    def tell(kind: str, page: int | None = None, code: str | None = None) -> None:
        nonlocal sequence
        sequence += 1
        events.append((book, sequence, kind, chapter, page, code, at, places))

    while at in early:
        name, _, error = early.pop(at)
        if name != chapter:
            if chapter is not None:
                tell("chapter_finished")
            chapter = name
            tell("chapter_started")
        at += 1
        if error is None:
            tell("page", at)
        elif not failed:  # the first in order; those behind it are in the issues
            failed = True
            tell("error", at, error.split(":")[0])
    if events and at >= places:
        tell("chapter_finished")
        tell("failed" if failed else "finished")
    return (at, sequence, chapter, failed, early), events


def in_order(stream: DataFrame) -> DataFrame:
    """EVENTS of a stream of FINISHED rows, by book."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = None
        if held.exists:
            at, sequence, chapter, failed, early = held.get
            state = (at, sequence, json.loads(chapter), failed, {int(k): v for k, v in json.loads(early).items()})
        rows = [r for b in batches for r in b[["place", "places", "chapter", "pages", "error"]].astype(object).where(b.notna(), None).itertuples(index=False, name=None)]
        state, events = advance(key[0], state, ((int(p), int(n), c, int(m or 0), e) for p, n, c, m, e in rows))
        held.update((*state[:2], json.dumps(state[2]), state[3], json.dumps(state[4])))
        if events:
            yield pd.DataFrame(events, columns=[f.split()[0] for f in EVENTS.split(", ")]).astype({"page": "Int64"})

    return stream.groupBy("book_id").applyInPandasWithState(run, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, folder: str, tell: Callable[[Row], None], checkpoint: str) -> StreamingQuery:
    """Runs a stream over the marks in a folder and tells of every event, in order within each book, until it is stopped."""

    def batch(events: DataFrame, _: int) -> None:
        for row in events.orderBy("book_id", "sequence").toLocalIterator():
            tell(row)

    stream = spark.readStream.schema(FINISHED).json(folder)
    return in_order(stream).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
