"""Words of whole texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Lower-cases A-Z and turns ASCII punctuation and controls to spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(texts: pa.Array, table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (run of bytes other than \\x20, \\x09-\\x0d) after `table`, and each text's first place; null texts have no words."""
    texts = pc.cast(texts, pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = bytes(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].translate(table)
    nulls = np.asarray(texts.is_null())
    if nulls.any():  # what lies under a null is no text
        lengths = np.where(nulls, 0, np.diff(offsets))
        whole = b"".join(whole[a - offsets[0] : a - offsets[0] + n] for a, n in zip(offsets[:-1], lengths, strict=True))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(whole))
    split = pc.ascii_split_whitespace(plain)
    flat, parents = split.flatten(), np.asarray(pc.list_parent_indices(split))
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():
        flat, parents = flat.filter(full), parents[np.asarray(full)]
    code = flat.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, code.dictionary.to_pylist()), dtype=np.uint64, count=len(code.dictionary))
    return own[np.asarray(code.indices)] if len(own) else np.zeros(0, np.uint64), np.searchsorted(parents, np.arange(len(texts) + 1))


def slices(texts: pa.Array, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each, at least a row."""
    sizes = np.cumsum(np.nan_to_num(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    cuts = [0]
    while cuts[-1] < len(texts):
        done = sizes[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sizes, done + most, side="right"))))
    return [(a, min(b, len(texts))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different k-word shingles of each text as sorted 64-bit hashes, and each text's first place.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    words, at = hashes(texts, LOWER)
    n = np.diff(at)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(at[:-1], size)
    h = np.repeat(np.minimum(n, k), size).astype(np.uint64)
    for i in range(k):
        inside = i < np.repeat(n, size)
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[np.minimum(place + i, max(0, len(words) - 1))] if len(words) else 0, np.uint64(i)))
    for a, b in zip(first, first + size, strict=True):
        h[a:b].sort()
    owner = np.repeat(np.arange(len(n)), size)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(n)))))
