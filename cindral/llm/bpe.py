"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Exact encoding by dynamic programming over prefixes instead of by merging: for every prefix of a pre-token the last token of its
encoding is unique. An automaton (Aho-Corasick over the vocabulary) gives all tokens that end at a position; the one that fits is the
one whose predecessor (the stored last token of the rest) and itself would not have been merged across their border, which a test of
the pair decides by undoing merges on both sides. Following the stored tokens back gives the identifiers. The time is linear in the
length, also for one pre-token of a million equal characters, and distinct pre-tokens are encoded once in each worker.

Nulls and odd input: a null or empty text gives an empty list; blank text is encoded as it is; text that looks like a special token is
ordinary text; lone surrogates (which Parquet cannot hold) are replaced; an empty table gives an empty result; rows without a key are left
out, rows repeated under one key count once; other columns are not touched. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.session import spread

#: Folder of the vocabularies, unless given.
TOKENIZERS = os.environ.get("CINDRAL_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, "PrefixEncoder"] = {}
_MOST_CACHED = 300_000
_LONG = 256


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte: printable bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder of one vocabulary file (the JSON form with vocab and merges)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = _byte_alphabet()
        self.ids = {bytes(back[c] for c in t): i for t, i in model["vocab"].items()}
        self.length = {i: len(t) for t, i in self.ids.items()}
        # In order of merging: pair -> merged token; rank of a token; the pair a token was last merged from.
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in self.ids.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = t
            if t not in self.halves:
                self.halves[t] = (a, b)
                self.rank[t] = rank
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay side by side when their joined bytes are encoded.

        Going back in time, whichever side was merged last is undone; if the tokens then at the border form a merge that comes before
        the time reached, it would have been done, and the two cannot stand together.
        """
        got = self.fits.get((left, right))
        if got is not None:
            return got
        key, rank, halves = (left, right), self.rank, self.halves
        now, ok = 1 << 60, True  # merges of a rank below `now` had precedence
        while True:
            m = self.merged.get((left, right))
            if m is not None and rank[m] < now:
                ok = False
                break
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                break
            # Of equal ranks the left one is merged first, so the right one is undone first.
            if a > b:
                now, left = a, halves[left][1]
            else:
                now, right = b + 1, halves[right][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def word(self, w: str) -> tuple[int, ...]:
        """Identifiers of one pre-token."""
        raw = w.encode("utf-8", "replace")
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        last: list[int] = [-1] * (len(raw) + 1)
        length, compatible, done = self.length, self.compatible, 0
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if done == end:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end], done = token, end
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for w in self.split(text):
            got = seen.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= _LONG:
                    if len(seen) >= _MOST_CACHED:
                        seen.clear()
                    seen[w] = got
            out += got
        return out


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> PrefixEncoder:
    path = os.path.join(folder or TOKENIZERS, f"{name}.json")
    if path not in _LOADED:
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) with counts_only, of every key."""
    kind = dict(docs.dtypes)[key]
    column = "n_tokens long" if counts_only else "ids array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        e = encoder(name, folder)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    value = pa.array(n, pa.int64())
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), value], names=[key, "n_tokens" if counts_only else "ids"])

    return spread(docs.where(F.col(key).isNotNull()).select(key, text), key).dropDuplicates([key]).mapInArrow(run, f"`{key}` {kind}, {column}")


def decoded(ids: list[int], name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The text of identifiers."""
    e = encoder(name, folder)
    by_id = getattr(e, "by_id", None) or {i: t for t, i in e.ids.items()}
    e.by_id = by_id
    return b"".join(by_id[i] for i in ids).decode("utf-8", "replace")


__all__ = ["PrefixEncoder", "decoded", "encoded", "encoder"]
