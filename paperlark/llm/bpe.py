"""Word-end byte-pair encoding and decoding with a vocabulary file of the tokenizers library.

A text is split at the file's special strings, put in NFC, lower-cased and cut at white space. Merges never cross white
space, so every chunk between two spaces is encoded for itself: a contraction, a run of letters, one digit or a run of
other signs at a time. A word is held as part boundaries beside a contiguous array of the ranks of adjacent parts: the
array is scanned for its minimum, that boundary is deleted and the two neighbouring ranks are looked up anew. Words of
over ``LONG`` signs, for which scans would grow with the square, take the same merges from a heap.

Workers keep the ids of chunks in a dictionary of bounded size. All rows are independent: there is no shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import fresh, whole

LONG = 64
CACHED = 400_000
#: Unicode's White_Space; the word pattern of the vocabulary file.
SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
END = "\ue000"


def byte_signs() -> list[str]:
    """The printable sign of each byte: itself where it is printable Latin-1, else the next sign from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        own = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s  # noqa: E731  the suffix as one sign
        self.ids = {own(s): i for s, i in model["vocab"].items()}
        self.rank = {(own(a), own(b)): r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words, self.spaces = regex.compile(WORDS), re.compile(f"[{SPACE}]+")
        self.signs = byte_signs()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, word: str) -> list[str]:
        """The parts of one word of byte signs that ends with END."""
        if len(word) > LONG:
            return self.merge_long(word)
        rank, never = self.rank, len(self.rank)
        at = [*range(len(word) - 1), len(word)]  # the last sign and END are one part
        ranks = [rank.get((word[a:b], word[b:c]), never) for a, b, c in zip(at, at[1:], at[2:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            del at[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((word[at[i] : at[i + 1]], word[at[i + 1] : at[i + 2]]), never)
            if i:
                ranks[i - 1] = rank.get((word[at[i - 1] : at[i]], word[at[i] : at[i + 1]]), never)
        return [word[a:b] for a, b in zip(at, at[1:])]

    def merge_long(self, word: str) -> list[str]:
        n = len(word) - 1
        parts: list[str | None] = [*word[: n - 1], word[n - 1 :]]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def chunk(self, chunk: str) -> bytes:
        """The ids of what stands between two white spaces, as little-endian unsigned 32-bit numbers."""
        out = []
        for word in self.words.findall(chunk):
            if (found := self.pieces.get(word)) is None:
                signs = word if word.isascii() and word.isprintable() else "".join(map(self.signs.__getitem__, word.encode()))
                found = np.array([self.ids[p] for p in self.merge(signs + END)], "<u4").tobytes()
                if len(word) <= LONG:
                    if len(self.pieces) >= CACHED:
                        self.pieces.clear()
                    self.pieces[word] = found
            out.append(found)
        return out[0] if len(out) == 1 else b"".join(out)

    def chunks_of(self, part: str) -> list[str]:
        """What stands between white spaces, in NFC and lower case."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each sign is lowered for itself
        part = part.lower()
        return self.spaces.split(part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; a special string in it has its own id."""
        if len(self.chunks) > CACHED:
            self.chunks.clear()
        return self.encode_known(text)

    def encode_known(self, text: str) -> np.ndarray:
        """The same; no chunk that is known is forgotten."""
        out = []
        for part in self.split.split(text) if "<" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            chunks = self.chunks_of(part)
            known = self.chunks
            for c in {*chunks}.difference(known) if len(chunks) > 32 else [c for c in chunks if c not in known]:
                known[c] = self.chunk(c)
            out += map(known.__getitem__, chunks)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The strings of the ids, joined by spaces: the file names no decoder. An id without a string gives none."""
        strings = self.strings
        try:
            return " ".join(map(strings.__getitem__, ids))
        except KeyError:
            return " ".join(strings[i] for i in ids if i in strings)


@lru_cache(2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode_udf(path: str):
    """Column of texts -> column of ids as little-endian unsigned 32-bit numbers (binary)."""

    @F.pandas_udf("binary")
    def encode(text: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.encode(t).tobytes() for t in text], dtype=object)

    return encode


def decode_udf(path: str):
    """Column of ids as encode_udf gives them -> column of decoded texts."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([None if x is None else bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], dtype=object)

    return decode


def bpe_encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with one more column, ids_col (renamed with underscores where docs has one): the ids of the whole text.

    Null and empty texts and those of white space alone have no ids (an empty binary). Repeated rows stay; an empty table
    stays empty.
    """
    return docs.withColumn(fresh(docs, ids_col), encode_udf(path)(whole(text_col)))


def bpe_decode(df: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with one more column, text_col: the text of the ids; null ids give null, no ids the empty text."""
    return df.withColumn(fresh(df, text_col), decode_udf(path)(F.col(ids_col)))


def bpe_round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the decoded text).

    Digests are taken where the ids are made, so that no text of ids crosses to the JVM. A null text counts as empty.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(text: pd.Series) -> pd.DataFrame:
        from hashlib import sha256

        bpe = load(path)
        decimal = {i: str(i) for i in bpe.strings}
        rows = []
        for t in text:
            ids = bpe.encode(t).tolist()
            rows.append((len(ids), sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), sha256(bpe.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(whole(text_col)).alias("_d")).select(id_col, "_d.*")
