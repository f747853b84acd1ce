"""Token counts of a sentencepiece BPE vocabulary without tokenizing most words.

Two facts are proved from the vocabulary before any text is read, and checked each time it is loaded:

* no piece has the space sign after another sign, so no merge crosses from a word into the spaces before the next one;
  a sign that is in no piece of two or more signs (a line break, say) is never merged at all;
* which pieces, as a whole pre-token, are merged to exactly one token. Those count one at sight.

Only what is left is merged, best score first and leftmost among equals, and a sign without a piece counts its UTF-8
bytes. Workers keep these counts in a dictionary of bounded size. All rows are independent: there is no shuffle.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import whole

BAR = "▁"
CACHED = 400_000
LONG = 64


class _Counts(dict):
    """Counts of pre-tokens; what is missing is merged once."""

    def __init__(self, pieces: PieceCounts, head: str):
        super().__init__({w[len(head) :]: 1 for w in pieces.alone if w.startswith(head)})
        self.pieces, self.head, self.sure = pieces, head, None
        self.sure = len(self)

    def __missing__(self, word: str) -> int:
        n = self.pieces.count(self.head + word)
        if len(word) <= LONG:
            if len(self) > self.sure + CACHED:
                super().clear()
                self.update({w[len(self.head) :]: 1 for w in self.pieces.alone if w.startswith(self.head)})
            self[word] = n
        return n


class PieceCounts:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in plain]
        scores = [model.get_score(i) for i in plain]
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        self.rank = {p: order[s] for p, s in zip(pieces, scores)}
        crossing = [p for p in pieces if re.search(f"[^{BAR}]{BAR}", p)]
        if crossing:
            raise ValueError(f"pieces that cross words: {crossing[:3]}")
        if model.encode("a b") != model.encode(f"a{BAR}b") or model.encode("a  b", out_type=str)[:1] != [f"{BAR}a"]:
            raise ValueError("the model changes texts before it splits them")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        if "\n" in joined:
            raise ValueError("the model merges line breaks")
        self.alone = {p for p in pieces if self.merged(p) == 1}
        self.first, self.later = _Counts(self, BAR), _Counts(self, "")
        self.breaks = 1 if "\n" in self.rank else len("\n".encode())
        self.words = re.compile(f"{BAR}*[^{BAR}]+|{BAR}+")

    def merged(self, word: str) -> int:
        """The number of tokens of one pre-token, by merging."""
        rank, never = self.rank, len(self.rank)
        if len(word) > LONG:
            return self.merged_long(word)
        at = [*range(len(word) + 1)]
        ranks = [rank.get(word[i : i + 2], never) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            del at[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(word[at[i] : at[i + 2]], never)
            if i:
                ranks[i - 1] = rank.get(word[at[i - 1] : at[i + 1]], never)
        return sum(1 if (part := word[a:b]) in rank else len(part.encode()) for a, b in zip(at, at[1:]))

    def merged_long(self, word: str) -> int:
        parts: list[str | None] = [*word]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := self.rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j], after[i] = pair, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x] + parts[y]))
        return sum(1 if p in self.rank else len(p.encode()) for p in parts if p is not None)

    def count(self, word: str) -> int:
        """A pre-token that may still hold line breaks: those stand alone."""
        if "\n" in word:
            head, *rest = word.split("\n")
            lead = (self.first[head[1:]] if head[0] == BAR and head[1:2] != BAR else self.merged(head)) if head else 0
            return lead + sum(self.breaks + (self.later[w] if w else 0) for w in rest)
        return 1 if word in self.alone else self.merged(word)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if BAR not in text and "" not in words:
            return sum(map(self.first.__getitem__, words))
        return sum(map(self.count, self.words.findall(BAR + text.replace(" ", BAR))))


@lru_cache(2)
def load(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text.

    Null and empty texts have no bytes and no tokens. Repeated rows stay; an empty table stays empty. Other columns of
    docs are ignored.
    """

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        counter = load(path)
        return pd.Series([counter(t) for t in text], dtype="int64")

    text = whole(text_col)
    return (
        docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
