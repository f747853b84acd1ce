"""The search for the smallest capacity against a plain one, and shards where one group of equal texts dominates."""

import bisect
import itertools
import random

import pytest

from paperlark.llm.sharding import find_cuts, giants, minimax_shards


def plain(ends, n):
    def walk(capacity):
        at, cuts = 0, []
        for _ in range(n):
            i = bisect.bisect_right(ends, at + capacity) - 1
            if i < 0 or ends[i] <= at:
                return None
            at = ends[i]
            cuts.append(at)
            if at == ends[-1]:
                return cuts
        return None

    low, high = -(-ends[-1] // n), ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if walk(middle) else (middle + 1, high)
    return walk(low)


def searched(ends, n, blocks):
    rounds = 0

    def divide(gaps, share):
        nonlocal rounds
        rounds += 1
        out = []
        for a, b in gaps:
            inside = ends[bisect.bisect_right(ends, a) : bisect.bisect_left(ends, b)]
            for _, block in itertools.groupby(inside, lambda e: int((e - a) * share / (b - a))):
                block = list(block)
                out.append((block[0], block[-1], len(block)))
        return out

    return find_cuts(ends[-1], n, blocks, divide), rounds


@pytest.mark.parametrize("blocks,most", [(2, 14), (8, 10), (64, 6), (2048, 4)])
def test_search_of_small_cases(blocks, most):
    random.seed(blocks)
    for _ in range(200):
        sizes = [random.choice((1, 1, 5, random.randint(1, 50), random.randint(1, 3000))) for _ in range(random.choice((1, 2, 5, 30, 200, 600)))]
        ends, n = list(itertools.accumulate(sizes)), random.choice((1, 2, 3, 7, 16))
        cuts, rounds = searched(ends, n, blocks)
        assert cuts == plain(ends, n) and rounds <= most


@pytest.mark.parametrize("share", [0, 0.03, 0.06, 0.063, 0.08, 0.1, 0.2, 0.33, 0.9])
def test_search_with_a_dominating_group(share):
    random.seed(7)
    sizes = [random.randint(100, 6000) for _ in range(20_000)]
    sizes.insert(random.randrange(20_000), 1 + int(sum(sizes) * share / (1 - share)))
    ends = list(itertools.accumulate(sizes))
    cuts, rounds = searched(ends, 16, 2048)
    assert cuts == plain(ends, 16) and rounds <= 4


def test_search_of_equal_groups_and_of_one():
    assert searched(list(range(7, 7 * 1001, 7)), 16, 64)[0] == plain(list(range(7, 7 * 1001, 7)), 16)
    assert searched([5], 16, 64)[0] == [5]


def test_giants():
    assert giants([90, 2, 2, 2, 2, 2], 100, 4) == 1 and giants([25, 25, 25, 25], 100, 4) == 0 and giants([60, 30, 5, 5], 100, 3) == 2 and giants([5], 5, 1) == 0 and giants([], 0, 4) == 0


@pytest.mark.parametrize("copies", [200, 20_000])
def test_a_dominating_group_is_alone_and_the_rest_even(spark, copies):
    random.seed(1)
    rows = [(i, f"text {random.randrange(10**9)}") for i in range(1500)] + [(10_000 + i, "the same") for i in range(copies)]
    got = minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert sorted(got.doc_id) == sorted(i for i, _ in rows)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    same = got[got.doc_id >= 10_000]
    assert same.shard.nunique() == 1
    alone = copies == 20_000
    assert (set(got[got.shard == same.shard.iloc[0]].doc_id) == set(same.doc_id)) == alone
    rest = (got[got.shard != same.shard.iloc[0]] if alone else got).groupby("shard")["size"].sum()
    assert len(rest) == (7 if alone else 8) and rest.max() - rest.min() <= 200 + 9 * (0 if alone else copies) and got.capacity.nunique() == 1
