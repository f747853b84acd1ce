"""Minimax contiguous sharding of atomic groups, with DataFrame operations only.

Rows with equal texts form a group that is never cut. A group larger than an even share of what is left gets a shard of
its own; these come first. The others stand in the order of their text's MD5, which mixes sources and languages. The
smallest shard capacity that needs no more than the remaining shards is found by binary search, each capacity checked by
the greedy walk, and the walk at that capacity gives the cuts.

The walk needs only positions where groups end. The driver never holds all of them: one job keeps, for each of ``blocks``
stretches of the corpus, its first and last group end. In a gap between two neighbouring known ends there may be hidden
ones; a walk that takes the gap's known end before its limit is pessimistic, one that takes the limit itself optimistic,
and both bracket the capacity. Only the gaps that these walks land in are divided again, by a job that sends at most
``2 * blocks`` numbers. Where the bracket is wider than one capacity, the optimistic walk at its lower end has landed in
such a gap (else both walks would agree there), so every job makes ends known and the search ends; a gap gets shorter by
the factor ``blocks`` / number of gaps each time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlark.llm.common import cut

Gap = tuple[int, int]
#: Divide each gap into so many blocks: first end, last end and number of ends of every block that has any.
Divide = Callable[[list[Gap], int], list[tuple[int, int, int]]]


class Ends:
    """Known ends of groups, and the gaps between neighbouring known ends in which more are hidden."""

    def __init__(self, total: int):
        self.total, self.known, self.hidden = total, [0, total], {0: total}

    def landing(self, limit: int) -> tuple[int, Gap | None]:
        """The last known end up to the limit, and the gap of the limit if ends are hidden in it."""
        at = self.known[bisect_right(self.known, limit) - 1]
        return at, (at, self.hidden[at]) if limit > at and at in self.hidden else None

    def walk(self, capacity: int, n: int, hopeful: bool) -> tuple[list[int] | None, list[Gap]]:
        """The ends of the shards that the greedy walk makes, None where n do not suffice, and the gaps it landed in."""
        at, cuts, gaps = 0, [], []
        for _ in range(n):
            limit = min(self.total, at + capacity)
            low, gap = self.landing(limit)
            if gap:
                gaps.append(gap)
            at, before = limit if hopeful and gap else low, at
            if at <= before:
                return None, gaps
            cuts.append(at)
            if at >= self.total:
                return cuts, gaps
        return None, gaps

    def smallest(self, n: int, hopeful: bool) -> int:
        low, high = -(-self.total // n), self.total
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, n, hopeful)[0] is None:
                low = middle + 1
            else:
                high = middle
        return low

    def doubts(self, n: int) -> list[Gap]:
        """The gaps that must be divided before the cuts are certain; none if they are."""
        low, high = self.smallest(n, True), self.smallest(n, False)
        found = {*self.walk(low, n, True)[1], *self.walk(high, n, False)[1]}
        if low < high:
            found |= {gap for hopeful in (True, False) for gap in self.walk((low + high) // 2, n, hopeful)[1]}
        return sorted(found)

    def add(self, gaps: list[Gap], blocks: list[tuple[int, int, int]]) -> None:
        """What dividing the gaps has found."""
        for a, _ in gaps:
            del self.hidden[a]
        self.hidden |= {a: b for a, b, n in blocks if n > 2}
        self.known = sorted({*self.known, *(a for a, _, _ in blocks), *(b for _, b, _ in blocks)})


def find_cuts(total: int, n_shards: int, blocks: int, divide: Divide) -> list[int]:
    """The ends of the shards of the smallest capacity, 0 < ends <= total."""
    ends = Ends(total)
    while gaps := ends.doubts(n_shards):
        known = len(ends.known), len(ends.hidden)
        ends.add(gaps, divide(gaps, max(2, blocks // len(gaps))))
        if known == (len(ends.known), len(ends.hidden)):
            raise RuntimeError("the search for the capacity makes no progress")
    return ends.walk(ends.smallest(n_shards, False), n_shards, False)[0]


def _divided(ends: DataFrame) -> Divide:
    """ends: one row for each group, with its end."""

    def divide(gaps: list[Gap], share: int) -> list[tuple[int, int, int]]:
        block: Column = F.lit(None)
        for k, (a, b) in enumerate(gaps):
            block = F.when((F.col("end") > a) & (F.col("end") < b), k * share + F.floor((F.col("end") - a) * share / (b - a))).otherwise(block)
        found = ends.select("end", block.alias("block")).where("block is not null").groupBy("block").agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n"))
        return [(r.a, r.b, r.n) for r in found.collect()]

    return divide


def giants(sizes: list[int], total: int, n_shards: int) -> int:
    """How many of the largest groups (sizes: the largest first) exceed an even share of what the larger ones leave."""
    found = 0
    while found < min(len(sizes), n_shards - 1) and sizes[found] * (n_shards - found) > total:
        total -= sizes[found]
        found += 1
    return found


def minimax_shards(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", blocks: int = 2048) -> DataFrame:
    """Shards 0 to n_shards - 1 of nearly equal bytes; rows with equal texts stay together.

    Returns id_col, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (the row's place in its shard) and
    capacity (the size of the largest shard). A null text has size 1 and is a group apart from the empty text. Repeated
    rows are kept, each with its own slot. An empty table gives no rows. Other columns of docs are ignored. A group
    larger than an even share is alone in its shard; with fewer groups than shards the last shards stay empty.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    slim = cut(
        docs.select(
            F.col(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"),
        ).toDF("id", "size", "text_crc32", "key")
    )
    largest = slim.groupBy("key").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "key").limit(n_shards).collect()
    total = slim.agg(F.sum("size")).first()[0] or 0
    alone = largest[: giants([r["size"] for r in largest], total, n_shards)]
    lead = F.lit(len(alone))
    for k, r in enumerate(alone):
        lead = F.when(F.col("key") == r["key"], k).otherwise(lead)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy("part").orderBy("lead", "key", "id")
    ranked = cut(
        slim.withColumn("lead", lead).repartitionByRange(parts, "lead", "key", "id").withColumn("part", F.spark_partition_id())
        .withColumns({"bytes": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(within)})
    )
    # one row for each partition: the first pass of the prefix sums
    bases, at_bytes, at_rows = [], 0, 0
    for r in ranked.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("part").collect():
        bases.append((r.part, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + r["size"], at_rows + r.n
    placed = ranked.join(spark.createDataFrame(bases, "part int, base_bytes long, base_rows long"), "part").select(
        "id", "size", "text_crc32", "key", "lead", (F.col("bytes") + F.col("base_bytes")).alias("end"), (F.col("nth") + F.col("base_rows")).alias("place")
    )
    cuts, rows_at, capacity = [], {}, 0
    if total:
        groups = cut(placed.groupBy("lead", "key").agg(F.max("end").alias("end"), F.max("place").alias("place")).select("end", "place"))
        for r in alone:
            cuts.append((cuts or [0])[-1] + r["size"])
        base = (cuts or [0])[-1]
        if base < total:
            cuts += [base + x for x in find_cuts(total - base, n_shards - len(cuts), blocks, _divided(groups.select((F.col("end") - base).alias("end"))))]
        rows_at = {r.end: r.place for r in groups.where(F.col("end").isin(cuts)).collect()}
        capacity = max(b - a for a, b in zip([0, *cuts], cuts))
    shard, before = F.lit(0), F.lit(0).cast("long")
    for k, end in enumerate(cuts[:-1], 1):
        shard = F.when(F.col("end") > end, F.lit(k)).otherwise(shard)
        before = F.when(F.col("end") > end, F.lit(rows_at[end]).cast("long")).otherwise(before)
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", shard.alias("shard"), (F.col("place") - 1 - before).alias("slot"), F.lit(capacity).cast("long").alias("capacity")
    )
