"""Lines as rows against the fold over arrays of the same lines."""

import random
import time

import pytest

from paperlark.operators import long_receipts as L
from paperlark.operators.receipts import parse_receipts

GOOD = [
    "Lidl s.r.o.", "Provozovna: Praha , Dlouhá 1", "provozovna", "Provozovna:", "Kč", "PT : 0,010", "Chléb 10,00 B", "1234 Rohlík 3,90 A", "Mléko", "19,90 A", "12,90", "2 ks x 9,95", "0,345 kg x 99,00", "Sleva -1,00", "Akce -0,50 B",
    "kupon 2,00", "Cena po slevě 5,00", "Cena po slevě 10,00", "Cena po slevě 99,00", "-------", "K PLATBĚ: 35,00", "CELKEM 36,00", "SUMA 34,00", "Celková sleva 1,50", "Karta", "Hotovost", "Visa", "DPH 21 %", "Účtenka č. 12345", "účtenka č", "777888",
    "1234 12345/12/12", "1234", "99999 / 123 / 45", "01.02.26 10:15", "01/02/26 9:05", "3. 4. 2026", "31.02.2026 10:00", "05.06.2026", "7:08", "", "  ", None, "abc", "x", "dm drogerie", "TESCO", "Jogurt 2 ks", "8,50 B", "-3,00",
]
FIELDS = ("store", "branch", "purchased_at", "total", "subtotal", "total_discount", "payment", "receipt_number", "unique_key", "warnings")
PARTS = ("rawName", "price", "quantity", "unit", "unitPrice", "discount", "discountLabel", "vat", "articleCode")


def held(spark, docs):
    rows = spark.createDataFrame([(d, list(lines)) for d, lines in docs.items()], "doc_id long, rows array<string>")
    want = {r.doc_id: r for r in parse_receipts(rows).collect() if any(x and x.strip() for x in docs[r.doc_id])}
    flat = [(d, k, x) for d, lines in docs.items() for k, x in enumerate(lines)]
    random.Random(1).shuffle(flat)
    receipts, items = L.parse_lines(spark.createDataFrame(flat, "doc_id long, line_no long, line string"))
    got, parts = {r.doc_id: r for r in receipts.collect()}, {}
    for r in items.orderBy("doc_id", "position").collect():
        parts.setdefault(r.doc_id, []).append(tuple(r[p] for p in PARTS))
    assert set(got) == set(want)
    for d, r in want.items():
        assert parts.get(d, []) == [tuple(i[p] for p in PARTS) for i in r["items"]], docs[d]
        assert [got[d][f] for f in FIELDS] == [r[f] for f in FIELDS], docs[d]
        assert got[d].n_items == len(r["items"])


@pytest.mark.parametrize("block, fan", [(512, 512), (6, 3)])
def test_random_lines(spark, monkeypatch, block, fan):
    monkeypatch.setattr(L, "BLOCK", block), monkeypatch.setattr(L, "FAN", fan)
    rng = random.Random(block)
    held(spark, {d: [rng.choice(GOOD) for _ in range(rng.randrange(0, 60))] for d in range(150)})


def test_many_lines_in_linear_time(spark):
    took = []
    for n in (20_000, 100_000):
        one = spark.range(n).selectExpr("7L as doc_id", "id as line_no", "case id % 3 when 0 then 'Chléb 10,00 B' when 1 then '2 ks x 5,00' else 'Sleva -1,00' end as line")
        began = time.time()
        receipts, items = L.parse_lines(one)
        row = receipts.first()
        took.append(time.time() - began)
        assert (row.n_items, row.total_discount) == (-(-n // 3), 100 * (n // 3)) and items.count() == row.n_items
    assert took[1] < 5 * took[0] + 5


def test_documents_of_one_block_need_no_states(spark, monkeypatch):
    def states(*_):
        raise AssertionError("a short document went over states and blocks")

    monkeypatch.setattr(L, "_entries", states)
    held(spark, {1: ["Lidl", "Chléb 10,00 B", "2 ks x 5,00", None, " | ", "K PLATBĚ: 10,00"], 2: [" ", None], 3: ["Mléko", "19,90 A"]})
