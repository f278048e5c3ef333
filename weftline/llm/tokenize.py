"""Exact, cached encoding of whole texts with a ``tokenizers`` file.

Both supported kinds of tokenizer split a text before they merge, and no piece
crosses the chunks taken here.  Encoding each distinct chunk once therefore
gives the ids of the whole text.  A text that holds an added token, or a
character on which the two definitions of white space differ, is encoded as a
whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ENCODE_ROWS = 512
ENCODE_BYTES = 4 << 20
CACHE_ENTRIES = 1_000_000
LONGEST_CACHED = 48
RUN = 256
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def encoding_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end row of the runs that are encoded together: bounded in rows and, but for a single text, in bytes."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        fits = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + ENCODE_BYTES, "right"))
        hi = min(lo + ENCODE_ROWS, max(lo + 1, fits))
        yield lo, hi
        lo = hi


class Encoder:
    """Token ids of texts as little-endian arrays of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        byte_level = any(p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space") for p in parts)
        drops_space = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "\\s" in str(p.get("pattern")) for p in parts)
        self.marks = ["\x1c", "\x1d", "\x1e", "\x1f", *(a["content"] for a in spec.get("added_tokens", []))]
        # a chunk ends at white space, or where a letter meets the punctuation that ends a word
        solid, letter, stop = f"[^{_SPACES}]", "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,;:!?]"
        word_end = f"(?={stop}*(?!{solid}))"
        normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lowers = any(n.get("type") == "Lowercase" for n in normalizers)
        if drops_space and self.lowers:
            self.split = re.compile(f"(?<!{solid}){letter}+{word_end}|(?<={letter}){stop}+(?!{solid})|{solid}+").findall
            self.ascii_split = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        elif byte_level and spec.get("normalizer") is None:
            spaces = f"[{_SPACES}]+(?!{solid})|[{_SPACES}]+"
            self.split = re.compile(f"(?: |(?<!{solid})){letter}+{word_end}|(?<={letter}){stop}+(?!{solid})| ?{solid}+|{spaces}").findall
            self.ascii_split = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall
        else:
            self.split = None
        top = max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec.get("added_tokens", []))])
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.dtype.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Add the ids of new chunks to the cache.

        Chunks of letters alone are single words to the tokenizer, so many are
        encoded as one text and told apart by their word numbers.
        """
        letters, rest = [], []
        for c in chunks:
            (letters if (c.isalpha() if self.lowers else c[:1] == " " and c[1:].isalpha()) else rest).append(c)
        runs = [letters[k : k + RUN] for k in range(0, len(letters), RUN)]
        glue, size = (" " if self.lowers else ""), self.dtype.itemsize
        for run, e in zip(runs, self.tokenizer.encode_batch([glue.join(r) for r in runs], add_special_tokens=False), strict=True):
            number = np.array(e.word_ids, np.int64)
            start = np.flatnonzero(np.diff(number, prepend=-1))
            if len(start) != len(run):
                rest += run
                continue
            raw, at = array(self.dtype.char, e.ids).tobytes(), (np.append(start, len(number)) * size).tolist()
            self.cache.update(zip(run, (raw[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))
        self.cache.update(zip(rest, self._encode(rest), strict=True))

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_split(text.lower() if self.lowers else text)
        return self.split(text)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, in order; null is empty."""
        out: list[np.ndarray | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, self.dtype)
            elif self.split is None or any(m in text for m in self.marks):
                whole.append(i)
            else:
                split.append((i, self._pieces(text)))
        known, long = self.cache, []
        if split:
            distinct = set().union(*(pieces for _, pieces in split))
            missing = list(distinct.difference(known))
            if len(known) + len(missing) > CACHE_ENTRIES:
                known.clear()
                missing = list(distinct)
            if missing:
                self._learn(missing)
                long = [c for c in missing if len(c) > LONGEST_CACHED]
        for i, pieces in split:
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, pieces)), self.dtype)
        for c in long:
            del known[c]
        if whole:
            for i, got in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
                out[i] = np.frombuffer(got, self.dtype)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
