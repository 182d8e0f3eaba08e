"""Personal data: patterns, and a semi-Markov conditional random field for what patterns drop.

Patterns give the base spans; each is found by itself and stays. What lies beside them and still looks like personal data (rows of
digits that fail as a whole, addresses with written-out signs) becomes a region. A semi-Markov field segments a region: its
segments are single tokens outside or whole candidate spans of at most `LONGEST` tokens, and features see a span as a whole (Luhn's
sum, groups of digits, signs, what goes on beside it, a word before it). Dynamic programming picks boundaries and kinds together.

The field is trained here, by likelihood, on a bounded sample of windows about base spans (`sample` for each kind, those with the least
hashes) and on rewritings of them: two numbers in a row, other groupings and signs, and digits in rows that are no numbers. A corpus without base spans has
no model, and nothing is added.

Offsets are code points, ends are exclusive. Null text is empty. Spans of one start are in the order of KINDS; equal rows get equal
results; texts of any length are read whole. Empty tables give empty results, other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, release_memory

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a candidate, characters about a base span in a training window, characters that a region sees beside it.
LONGEST, AROUND, BESIDE = 40, 48, 32

Span = tuple[int, int, str]

# Starts within a run are ruled out, since the run's own start comes first: so each pattern reads a text in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done, "email"
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def base(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start and kind."""
    spans = list(_emails(text)) if "@" in text else []
    spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# What may be personal data beside the patterns.
_BETWEEN = " ().+/\\[\\] ‐-–-"
_NUMBERS = re.compile(f"[+(]{{0,2}}[0-9](?:[{_BETWEEN}]{{0,4}}[0-9])*+")
_AT = r"(?:\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\s?@\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s)"
_SIGN = re.compile(r"[(\[{<]\s?(?:at|@)\s?[)\]}>]|@|\sat\s(?=[^\n]{1,60}\sdot\s)", re.I)
_WRITTEN = re.compile(rf"(?P<local>[A-Za-z0-9._%+-]{{1,64}}){_AT}(?P<first>[A-Za-z0-9-]+)(?:{_DOT}[A-Za-z0-9-]+)*(?P<dot>{_DOT})(?P<top>[A-Za-z0-9-]+)", re.I)
_OCTETS = re.compile(r"([0-9]{1,3})(\s?[\[(]\.[\])]\s?|\s\.\s|\.)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})")
_DIALLED = re.compile(f"(?:\\+|00|\\()?[0-9][0-9{_BETWEEN}]*[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_GROUPS = re.compile("[0-9]+")
#: Words before numbers and addresses.
CUES = {
    "phone": frozenset("tel phone call fax mobile cell whatsapp telephone telefon telefono teléfono téléphone portable handy appel llame ruf".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte tarjeta kreditkarte pay".split()),
    "email": frozenset("mail email contact write courriel correo kontakt e".split()),
    "ip": frozenset("ip host server address addr adresse dirección serveur".split()),
}


def regions(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Places beside base spans that may hold personal data, in order, none overlapping another."""
    found: list[tuple[int, int]] = []
    for m in _NUMBERS.finditer(text):
        n = len(_NOT_DIGITS.sub("", m[0])) if m.end() - m.start() >= 9 else 0
        if n >= 9 or n >= 4 and "." in m[0]:
            found.append((m.start(), m.end()))
    if "@" in text or "at" in text or "AT" in text:
        own = sorted((a, b) for a, b, k in spans if k == "email")
        at = 0
        for m in _SIGN.finditer(text):
            while at < len(own) and own[at][1] <= m.start():
                at += 1
            if at < len(own) and own[at][0] <= m.start():
                continue  # the sign of an address that is found already
            found.append((max(text.rfind("\n", 0, m.start()) + 1, m.start() - 66), min(len(text) if (line := text.find("\n", m.end())) < 0 else line, m.end() + 80)))
    if not found:
        return []
    taken = sorted((a, b) for a, b, _ in spans)
    out: list[tuple[int, int]] = []
    at = 0
    for a, b in sorted(found):
        a = max(a, out[-1][1] if out else 0)
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        i = at
        while a < b:
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            stop = min(b, taken[i][0]) if i < len(taken) else b
            if stop > a:
                out.append((a, stop))
            a = max(stop, taken[i][1]) if i < len(taken) and taken[i][0] < b else b
    return out


def _shape(groups: list[str]) -> str:
    sizes = [len(g) for g in groups]
    return "single" if len(sizes) == 1 else "fours" if set(sizes) == {4} else "amex" if sizes == [4, 6, 5] else "others"


def _rest(digits: str) -> str:
    return "none" if not digits else "number" if 12 <= len(digits) <= 19 and luhn(digits) else "more"


def _cue(kind: str, before: str) -> str:
    words = _WORD.findall(before.lower())[-3:]
    return "cue" if any(w in CUES[kind] for w in words) else "plain"


_MORE_OCTETS, _LESS_OCTETS = re.compile(r"\s?[\[(]?[.][\])]?\s?[0-9]"), re.compile(r"[0-9]\s?[\[(]?[.][\])]?\s?\Z")
_CHAIN_BEFORE, _CHAIN_AFTER = re.compile(r"(?:[0-9][ -]?)+\Z"), re.compile(r"(?:[ -]?[0-9])+")


def features(kind: str, text: str, a: int, b: int) -> list[str] | None:
    """What speaks for or against text[a:b] as a span of a kind; None where it can't be one."""
    span = text[a:b]
    before, after = text[max(0, a - BESIDE) : a], text[b : b + BESIDE]
    if kind == "email":
        if not (m := _WRITTEN.fullmatch(span)):
            return None
        sign = span[m.end("local") : m.start("first")].strip().lower()
        dot = m["dot"].strip().lower()
        more = re.match(rf"{_DOT}?[A-Za-z0-9-]", after, re.I) is not None
        less = before[-1:] in _LOCAL and before != ""
        told = ["at:" + ("sign" if sign == "@" else "word" if sign == "at" else "bracket"), "dot:" + ("sign" if dot == "." else "word" if dot == "dot" else "bracket"), f"top:{m['top'].isalpha() and 2 <= len(m['top']) <= 6}", f"more:{more}", f"less:{less}", f"short:{len(m['local']) < 2}", f"spaces:{min(3, span.count(' '))}"]
    elif kind == "ip":
        if not (m := _OCTETS.fullmatch(span)) or any(int(m[i]) > 255 for i in (1, 3, 4, 5)):
            return None
        sign = m[2].strip()
        told = [f"sign:{'dot' if sign == '.' else 'bracket'}", f"spaced:{' ' in m[2]}", f"beside:{before[-1:].isalnum() or after[:1].isalnum()}", f"goes on:{_MORE_OCTETS.match(after) is not None or _LESS_OCTETS.search(before) is not None}"]
    elif kind == "card":
        groups = _GROUPS.findall(span)
        digits = "".join(groups)
        if not 12 <= len(digits) <= 19 or not luhn(digits) or not re.fullmatch(r"[0-9](?:[ . ‐-–-]?[0-9])+", span):
            return None
        left, right = _CHAIN_BEFORE.search(before), _CHAIN_AFTER.match(after)
        rests = [_rest(_NOT_DIGITS.sub("", m[0]) if m else "") for m in (left, right)]
        marks = set(_NOT_DIGITS.findall(span))
        told = [f"size:{len(digits)}", f"shape:{_shape(groups)}", f"first:{digits[0] in '3456'}", f"same:{len(set(digits)) < 4}", f"marks:{len(marks)}", *[f"rest:{r}" for r in rests], f"shape and rest:{_shape(groups)}:{'more' in rests}", f"inside:{before[-1:].isalnum() or after[:1].isalnum()}"]
    else:
        groups = _GROUPS.findall(span)
        n = sum(map(len, groups))
        if not 9 <= n <= 15 or not _DIALLED.fullmatch(span) or "+" in span[1:] or span.count("(") != span.count(")") or re.search(f"[{_BETWEEN}]{{4}}", span):
            return None
        start = "plus" if span[0] == "+" else "zeros" if span.startswith("00") else "bracket" if span[0] == "(" else "bare"
        cue = _cue(kind, before)
        if start == "bare" and cue == "plain":
            return None
        right = re.match(r"[ -]?([0-9]+)", after)
        told = [f"start:{start}", f"size:{n}", f"groups:{min(6, len(groups))}", f"bracket:{'(' in span}", f"last:{len(groups[-1])}", f"goes on:{len(right[1]) if right and len(right[1]) < 12 else 'no' if not right else 'long'}", f"inside:{before[-1:].isalnum() or after[:1].isalnum()}", f"from:{bool(re.search(r'[0-9+(] ?$', before))}"]
    return [f"{kind}:{t}" for t in (*told, _cue(kind, before), "any")]


def candidates(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """Tokens of a region and candidate spans as ranges of tokens, by their last token."""
    tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
    number = [text[s].isdigit() and text[s].isascii() for s, _ in tokens]
    found = []
    for i, (start, stop) in enumerate(tokens):
        first = text[start]
        digit = number[i] or first in "+(" and i + 1 < len(tokens)
        if not digit and not first.isalnum() and first not in _LOCAL:
            continue
        digits, signs = 0, 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            s, e = tokens[j]
            if text[s] == "\n":
                break
            digits += e - s if number[j] else 0
            signs |= text[s:e].lower() in ("@", "at")
            if not (number[j] or text[s].isalnum()):
                continue
            if digit and number[j] and 4 <= digits <= 19:
                for kind in ("ip", "card", "phone"):
                    if (told := features(kind, text, start, e)) is not None:
                        found.append((i, j + 1, kind, told))
            if signs and (told := features("email", text, start, e)) is not None:
                found.append((i, j + 1, "email", told))
            if digits > 19 and not signs and digit and number[i]:
                break
    return tokens, sorted(found, key=lambda c: (c[1], c[0], KINDS.index(c[2])))


def decode(text: str, a: int, b: int, weights: dict[str, float]) -> list[Span]:
    """The best segmentation of a region: its spans. Of equal ones, that with fewer and later spans."""
    tokens, found = candidates(text, a, b)
    if not found:
        return []
    best: list[tuple[float, float]] = [(0.0, -math.inf)]  # after a token outside, after a span
    back: list[tuple | None] = [None]
    at = 0
    for end in range(1, len(tokens) + 1):
        outside, inside, how = max(best[end - 1]), -math.inf, None
        while at < len(found) and found[at][1] == end:
            i, _, kind, told = found[at]
            at += 1
            own = sum(weights.get(t, 0.0) for t in told)
            for state in (0, 1):
                score = best[i][state] + own + weights.get(f"{kind}:after {state}", 0.0)
                if score > inside:
                    inside, how = score, (i, state, kind)
        best.append((outside, inside))
        back.append(how)
    spans, end = [], len(tokens)
    state = int(best[end][1] > best[end][0])
    while end:
        if state:
            start, state, kind = back[end]
            spans.append((tokens[start][0], tokens[end - 1][1], kind))
            end = start
        else:
            end -= 1
            state = int(best[end][1] > best[end][0])
    return spans[::-1]


def _variants(text: str, span: Span, other: dict[str, list[str]], rng: random.Random) -> Iterator[tuple[str, list[Span]]]:
    """A window with its base span, rewritten: texts and the spans in them."""
    a, b, kind = span
    left, found, right = text[:a], text[a:b], text[b:]

    def put(*parts: tuple[str, str | None]) -> tuple[str, list[Span]]:
        whole, spans = left, []
        for part, own in parts:
            if own:
                spans.append((len(whole), len(whole) + len(part), own))
            whole += part
        return whole + right, spans

    yield text, [span]
    if kind == "email":
        local, domain = found.split("@", 1)
        sign, dot = rng.choice([("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", ".")])
        yield put((local + sign + domain.replace(".", dot), kind))
        yield put((f"{local} @ {rng.randrange(1, 24)}.{rng.randrange(10, 60)}", None))
    elif kind == "ip":
        yield put((found.replace(".", rng.choice(["[.]", "(.)", " . "])), kind))
        yield put((found.replace(".", "[.]") + f"[.]{rng.randrange(99)}[.]{rng.randrange(99)}", None))
    elif kind == "card":
        digits = _NOT_DIGITS.sub("", found)
        fours = rng.choice(" -. ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
        again = _NOT_DIGITS.sub("", rng.choice(other["card"]))
        yield put((found, kind), (" ", None), (found, kind))
        yield put((digits, kind), (rng.choice(" -"), None), (again, kind))
        yield put((fours.replace(fours[4:5], " "), kind), (" ", None), (" ".join(again[i : i + 4] for i in range(0, len(again), 4)), kind))
        for sizes in ((1, 5), (2, 9), (4, 4), (3, 3)):  # rows of numbers that are no cards, though some part may pass the sum
            row = "".join(rng.choice("0123456789") for _ in range(60))
            groups, i = [], 0
            while i < len(row):
                groups.append(row[i : i + rng.randint(*sizes)])
                i += len(groups[-1])
            yield put((rng.choice(" -").join(groups), None))
    else:
        yield put(("00" + found[1:], kind))
        area = found[found.find("(") :] if "(" in found else None
        if area and len(_NOT_DIGITS.sub("", area)) >= 9:
            yield put((area, kind))
        bare = found.replace("(", "").replace(")", "")
        yield put(("00" + bare[1:], kind))
        if " " in bare and len(_NOT_DIGITS.sub("", bare[bare.find(" ") :])) >= 9:
            yield put((rng.choice(["tel ", "call ", "phone: "]), None), (bare[bare.find(" ") + 1 :], kind))
        if other["card"]:
            card = _NOT_DIGITS.sub("", rng.choice(other["card"]))
            yield put((found, kind), (" ", None), (card, "card"))
        yield put((f"({rng.randrange(100, 999)}) {rng.randrange(10**4, 10**5)} {rng.randrange(10**4, 10**5)} {rng.randrange(10**4, 10**5)} {rng.randrange(10**4, 10**5)}", None))


def fit(windows: list[tuple[str, int, int, str]], rounds: int = 60, penalty: float = 0.02) -> dict[str, float]:
    """Weights of the greatest penalised likelihood, from windows (text, start, end, kind), by gradient steps scaled by the slopes seen so far."""
    rng = random.Random(7)
    other = {k: [t[a:b] for t, a, b, kind in windows if kind == k] for k in KINDS}
    names: dict[str, int] = {f"{k}:after {s}": 2 * i + s for i, k in enumerate(KINDS) for s in (0, 1)}
    sequences = []
    for text, a, b, kind in windows:
        for told, spans in _variants(text, (a, b, kind), other, rng):
            tokens, found = candidates(told, 0, len(told))
            places = {(tokens[i][0], tokens[j - 1][1], k): n for n, (i, j, k, _) in enumerate(found)}
            if any(s not in places for s in spans):
                continue
            sequences.append((len(tokens), [(i, j, KINDS.index(k), [names.setdefault(t, len(names)) for t in f]) for i, j, k, f in found], {places[s] for s in spans}))
    flat = [c for _, found, _ in sequences for c in found]
    if not flat:
        return {}
    lists = np.concatenate([np.asarray(c[3], np.int64) for c in flat])
    owner = np.repeat(np.arange(len(flat)), [len(c[3]) for c in flat])
    weights, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    gold = np.zeros(len(names))
    at = 0
    for _, found, right in sequences:
        for n, (i, _, kind, told) in enumerate(found):
            if n in right:
                gold[told] += 1
                gold[2 * kind + int(any(found[m][1] == i for m in right))] += 1
        at += len(found)
    for _ in range(rounds):
        scores = np.bincount(owner, weights[lists], len(flat)).tolist()
        after = weights[: 2 * len(KINDS)].tolist()
        chance = np.zeros((len(flat), 2))
        at = 0
        for size, found, _ in sequences:
            _chances(size, found, scores[at : at + len(found)], after, chance[at : at + len(found)])
            at += len(found)
        expected = np.bincount(lists, chance.sum(axis=1)[owner], len(names))
        for kind in range(len(KINDS)):
            own = np.asarray([c[2] == kind for c in flat])
            expected[2 * kind : 2 * kind + 2] += chance[own].sum(axis=0)
        slope = (gold - expected) / len(sequences) - penalty * weights / 10
        seen += slope * slope
        weights += 0.5 * slope / np.sqrt(seen)
    return dict(zip(names, weights.tolist(), strict=True))


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _chances(size: int, found: list, scores: list[float], after: list[float], out: np.ndarray) -> None:
    """Posterior chances of each candidate after a token outside and after a span, by sums forwards and backwards."""
    forward = [[0.0, -math.inf]] + [[-math.inf, -math.inf] for _ in range(size)]
    at = 0
    for end in range(1, size + 1):
        forward[end][0] = _add(*forward[end - 1])
        while at < len(found) and found[at][1] == end:
            i, _, kind, _ = found[at]
            for state in (0, 1):
                forward[end][1] = _add(forward[end][1], forward[i][state] + scores[at] + after[2 * kind + state])
            at += 1
    backward = [[-math.inf, -math.inf] for _ in range(size)] + [[0.0, 0.0]]
    starts: dict[int, list[int]] = {}
    for n, c in enumerate(found):
        starts.setdefault(c[0], []).append(n)
    for start in range(size - 1, -1, -1):
        for state in (0, 1):
            total = backward[start + 1][0]
            for n in starts.get(start, ()):
                total = _add(total, scores[n] + after[2 * found[n][2] + state] + backward[found[n][1]][1])
            backward[start][state] = total
    whole = _add(*forward[size])
    for n, (i, j, kind, _) in enumerate(found):
        for state in (0, 1):
            told = forward[i][state] + scores[n] + after[2 * kind + state] + backward[j][1] - whole
            out[n, state] = math.exp(told) if told > -700 else 0.0


_SPANS = "array<struct<a: long, b: long, kind: string>>"
_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())]))
_REGION = pa.list_(pa.struct([("a", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("text", pa.string())]))
_WINDOW = pa.list_(pa.struct([("text", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())]))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text, the regions beside them and a window about each base span."""
    for batch in batches:
        spans, found, windows = [], [], []
        for text in batch["text"].to_pylist():
            text = text or ""
            own = base(text)
            spans.append([{"a": a, "b": b, "kind": k} for a, b, k in own])
            found.append([{"a": max(0, a - BESIDE), "from": min(a, BESIDE), "to": min(a, BESIDE) + b - a, "text": text[max(0, a - BESIDE) : b + BESIDE]} for a, b in regions(text, own)])
            near = []
            for a, b, k in own:
                left = max(0, a - AROUND)
                if b - a <= 4 * AROUND and all(y <= left or x >= b + AROUND or (x, y) == (a, b) for x, y, _ in own):  # alone in its window
                    near.append({"text": text[left : b + AROUND], "a": a - left, "b": b - left, "kind": k})
            windows.append(near)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, _SPAN), pa.array(found, _REGION), pa.array(windows, _WINDOW)], names=["doc_id", "base", "regions", "windows"])
        release_memory()


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base, regions and windows of every document, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, base {_SPANS}, regions array<struct<a: long, `from`: long, `to`: long, text: string>>, windows array<struct<text: string, a: long, b: long, kind: string>>"
    return Scratch(spark, "personal").store(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, schema), "scanned")


def train(scanned: DataFrame, sample: int = 60) -> dict[str, float]:
    """Weights from at most `sample` different windows of each kind, those of the least hashes."""
    told = scanned.select(F.explode("windows").alias("w")).select("w.*")
    told = told.groupBy("text", "a", "b", "kind").agg(F.lit(1)).withColumn("_at", F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("text", "a"), "text", "a")))
    return fit([(r["text"], r["a"], r["b"], r["kind"]) for r in told.where(F.col("_at") <= sample).orderBy("kind", "_at").collect()])


def spans(spark: SparkSession, docs: DataFrame, sample: int = 60) -> DataFrame:
    """doc_id, base (spans of the patterns) and added (spans of the field), each an array of a, b, kind in order."""
    scanned = scan(spark, docs)
    weights = spark.sparkContext.broadcast(train(scanned, sample))

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch["regions"].to_pylist():
                out.append([{"a": r["a"] + a, "b": r["a"] + b, "kind": k} for r in found for a, b, k in (decode(r["text"], r["from"], r["to"], weights.value) if weights.value else ())])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["base"], pa.array(out, _SPAN)], names=["doc_id", "base", "added"])

    return scanned.select("doc_id", "base", "regions").mapInArrow(added, f"doc_id {scanned.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, added {_SPANS}")


def redact(spark: SparkSession, docs: DataFrame, sample: int = 60) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; overlapping spans are one, named by the first. Rows of equal doc_id need equal texts."""
    found = spans(spark, docs, sample).select(F.col("doc_id").alias("_id"), F.concat("base", "added").alias("_spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch["text"].to_pylist(), batch["_spans"].to_pylist(), strict=True):
                pieces, at, text = [], 0, text or ""
                for s in sorted(own or [], key=lambda s: (s["a"], KINDS.index(s["kind"]))):
                    if s["a"] >= at:
                        pieces += [text[at : s["a"]], f"[{s['kind']}]"]
                    at = max(at, s["b"])
                texts.append("".join((*pieces, text[at:])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    once = found.dropDuplicates(["_id"])
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(once, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text", "_spans").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def report(spark: SparkSession, docs: DataFrame, sample: int = 60) -> DataFrame:
    """A row for each document: base spans of each kind, the digest of the base spans, and all spans as kind:start:end."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, more in zip(batch["base"].to_pylist(), batch["added"].to_pylist(), strict=True):
                lists = [",".join(f"{s['kind']}:{s['a']}:{s['b']}" for s in sorted(x, key=lambda s: (s["a"], KINDS.index(s["kind"])))) for x in (own, own + more)]
                rows.append((*[sum(s["kind"] == k for s in own) for k in KINDS], hashlib.sha256(lists[0].encode()).hexdigest(), lists[1]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
    counts = "".join(f", n_{k} long" for k in KINDS)
    return spans(spark, docs, sample).mapInArrow(told, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{counts}, base_sha256 string, spans string")
