"""Language identification by language-bitmask n-gram filters.

Training counts character n-grams of labelled documents for each language: at most `per_language` documents of each,
those with the smallest hashes of their identifiers (a share of the hash range, so the bound holds in expectation), read whole. A language's set holds the n-grams whose share among
its own documents is at least `share` of the largest share that any language has. The sets go into one bit-sliced Bloom filter:
slot by slot, a mask with one bit for each language (a plane of masks for each 63 of them); the masks at an n-gram's
slots, ANDed, give all languages that hold it. A prediction looks up every n-gram of the whole text, counts the bits of each language, takes away the hits
expected from the filter's false positives, and chooses the language with the largest corrected share.

Null texts and texts without a letter are `und` with score 0; ties go to the language first in order. The score is
the chosen language's corrected share of the n-grams. Without training documents all texts are `und`. Identifiers,
sources and labels play no part in a prediction; repeated rows and other columns, whatever their names, don't matter.
Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N = 4
HASHES = 2
#: Languages of a mask.
PLANE = 63
#: Multipliers of the n-gram's hash, odd.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # planes of slots, a mask each
    wrong: np.ndarray  # false-positive rate of each language


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of the text's lower-cased letters; other characters become single spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _grams(points, _is_letter(points))


_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    flags = _LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        flags[i] = chr(points[i]).isalpha()
    return flags


def _grams(points: np.ndarray, letter: np.ndarray) -> np.ndarray:
    p = np.where(letter, points, 32).astype(np.uint64)
    p = np.concatenate(([np.uint64(32)], p, [np.uint64(32)]))
    p = p[np.concatenate(([True], (p[1:] != 32) | (p[:-1] != 32)))]
    if len(p) < N:
        return np.zeros(0, dtype=np.uint64)
    h = p[: len(p) - N + 1].copy()
    for i in range(1, N):
        h = h * np.uint64(0x100000001B3) + p[i : len(p) - N + 1 + i]
    return h


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = h ^ (h >> np.uint64(29))
    return [((x * m) >> np.uint64(64 - bits)).astype(np.int64) for m in MIX]


def build(counts: dict[str, Counter], totals: dict[str, int], share: float = 0.25) -> Filter:
    """counts: for each language, of each n-gram the number of its documents that hold it."""
    languages = sorted(counts)
    best: dict[int, float] = {}
    for lang in languages:
        for g, n in counts[lang].items():
            best[g] = max(best.get(g, 0.0), n / totals[lang])
    sets = [np.array([g for g, n in counts[lang].items() if n > 1 and n / totals[lang] >= share * best[g]], dtype=np.uint64) for lang in languages]
    bits = max(12, int(np.ceil(np.log2(16 * max(1, *(len(s) for s in sets), 1)))))
    slots = np.zeros((-(-len(languages) // PLANE) or 1, 1 << bits), dtype=np.uint64)
    for i, s in enumerate(sets):
        for at in _slots(s, bits):
            np.bitwise_or.at(slots[i // PLANE], at, np.uint64(1 << i % PLANE))
    wrong = np.array([np.mean((slots[i // PLANE] >> np.uint64(i % PLANE)) & np.uint64(1)) ** HASHES for i in range(len(languages))])
    return Filter(languages, slots, wrong)


def predict(model: Filter, text: str | None) -> tuple[str, float]:
    if not text or not model.languages:
        return "und", 0.0
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return "und", 0.0
    h = _grams(points, letter)
    if not len(h):
        return model.languages[0], 0.0
    first, second = _slots(h, model.slots.shape[1].bit_length() - 1)
    masks = [plane[first] & plane[second] for plane in model.slots]
    hits = np.array([np.count_nonzero(masks[i // PLANE] & np.uint64(1 << i % PLANE)) for i in range(len(model.languages))])
    corrected = np.clip((hits / len(h) - model.wrong) / (1 - model.wrong), 0, 1)
    i = int(np.argmax(corrected))
    return model.languages[i], float(corrected[i])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: for each language and n-gram, the documents that hold it; n-gram null: the documents."""
    seen: dict[str, Counter] = {}
    total: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[lang] += 1
            seen.setdefault(lang, Counter()).update(np.unique(grams(text)).tolist())
    for lang, n in total.items():
        g = np.fromiter(seen[lang].keys(), dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(g) + 1)), pa.array([None, *g.tolist()], pa.int64()), pa.array([n, *seen[lang].values()], pa.int64())], ["lang", "gram", "n"])


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from training; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(spark: SparkSession, docs: DataFrame, per_language: int = 1000, share: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Learns from documents that are not held out and have a label: of each language the `per_language` rows of the least hashes of identifier and text, at most. That bounds what the driver gathers.

    Equal rows have one hash and are interchangeable, so the sample doesn't depend on how rows are dealt.
    """
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts_of = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts_of:
        return Filter([], np.zeros((1, 1), np.uint64), np.zeros(0))
    # a share of twice the size first, so that few rows are ranked; of large groups of equal rows the ranks keep each task's first
    chosen = F.lit(False)
    for lang, n in counts_of.items():
        chosen = chosen | (F.col("lang") == lang) & (F.shiftrightunsigned("_hash", 1) <= int(min(1.0, 2 * per_language / n) * (2**63 - 1024)))
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("_hash")).where(chosen)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "text"))
    sample = rows.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts: dict[str, Counter] = {lang: Counter() for lang in counts_of}
    totals = dict.fromkeys(counts_of, 0)
    for r in sample.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1 OR gram IS NULL").toArrow().to_batches():
        for lang, g, n in zip(*(c.to_pylist() for c in r.columns), strict=True):
            if g is None:
                totals[lang] = n
            else:
                counts[lang][g & 2**64 - 1] = n
    return build(counts, totals, share)


def identify(docs: DataFrame, model: Filter, keep: list[str] | None = None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (none of them named as `out`), lang_pred and score of every row."""
    keep = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, *out])

    fields = docs.select(F.col(text_col).alias("_text"), *keep)
    schema = type(fields.schema)(fields.schema.fields[1:]).add(out[0], "string").add(out[1], "double")
    return fields.mapInArrow(run, schema)


def languages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(spark, docs, id_col=id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"])
