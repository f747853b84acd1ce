"""upper_median against plain Python, with one large group, ties, nulls and a group of nulls only."""

import random

from paperlark.operators import analytics as A


def test_upper_median_counts_instead_of_collecting(spark):
    random.seed(5)
    rows = [(0, random.randrange(50)) for _ in range(5000)] + [(g, random.choice((None, 1, 2, 3, 10**10))) for g in range(1, 40) for _ in range(g % 7 + 1)] + [(99, None)]
    found = A.upper_median(spark.createDataFrame(rows, "g int, price long"), ["g"], "price")
    expected = {}
    for g in {g for g, _ in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        expected[g] = values[len(values) // 2] if values else None
    assert {r.g: r.upper_median for r in found.collect()} == expected
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
