"""Reports whose registered query covers its whole table."""

from paperlark.operators import analytics as A
from paperlark.plans import catalogue
from paperlark.plans import standins as S

FOLDER = "/root/testdata/sf0.001"


def test_price_history_of_every_product(spark):
    got = catalogue.price_history(spark, FOLDER).toPandas()
    items, receipts = S.items(spark, FOLDER), S.receipts(spark, FOLDER)
    assert len(got) == items.join(receipts.select("id"), items["receipt_id"] == receipts["id"], "left_semi").count()
    assert got.raw_key.is_monotonic_increasing and got.groupby("raw_key").purchased_at.apply(lambda x: x.is_monotonic_decreasing).all()
    one = A.price_history(items, receipts, raw_key="7").select(*got.columns).toPandas()
    assert len(one) and got[got.raw_key == "7"].reset_index(drop=True).equals(one)
