"""Token ids of whole texts by a tokenizer file, as little-endian 32-bit bytes."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

# The word pattern, and all that a tokenizer file must state for words to be encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Entries of a worker's word cache; it is emptied beyond that.
CACHE_WORDS = 400_000


def _plain() -> tuple[str, str, str]:
    """Letters, numbers and other characters for which lower() and the pattern need no Unicode tables of the library."""
    low = [chr(i) for i in range(0x250) if len(c := chr(i).lower()) == 1 and ord(c) < 0x250] + [chr(i) for i in (*range(0x2010, 0x2028), *range(0x2030, 0x205F))]
    kind = {c: unicodedata.category(c)[0] for c in low}
    space = set("\t\n\x0b\x0c\r \x85\xa0")
    pick = lambda f: "".join(re.escape(c) for c in low if f(c))
    return pick(lambda c: kind[c] == "L"), pick(lambda c: kind[c] == "N"), pick(lambda c: kind[c] not in "LN" and c not in space)


class _Words(dict):
    """Word to the bytes of its ids."""

    def __init__(self, model):
        self.model = model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = dict(zip(shown, map(chr, shown), strict=True))
        for b in range(256):
            self.alphabet.setdefault(b, chr(256 + len(self.alphabet) - len(shown)))

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, word.encode())))]
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """encode(text) gives the ids of the tokenizers library without special tokens.

    A tokenizer with just this NORMALIZER and these WORDS encodes each word on its own, so words are looked up in a
    cache; texts with other than plain characters, or that may hold a special token, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        self.fast = None
        model = told["model"]
        by_word = told.get("normalizer") == NORMALIZER and told.get("pre_tokenizer") == WORDS and model["type"] == "BPE" and not model["dropout"]
        if by_word and not any(told.get(k) for k in ("truncation", "padding")) and not any(t["normalized"] for t in told["added_tokens"]):
            letters, numbers, others = _plain()
            self.fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{others}]+").findall
            self.odd = re.compile(f"[^\t\n\x0b\x0c\r \x85\xa0{letters}{numbers}{others}]|" + "|".join(re.escape(t["content"]) for t in told["added_tokens"])).search
            self.words = _Words(self.whole.model)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or self.odd(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, self.fast(text.lower())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
