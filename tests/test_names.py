"""Names, money and dates by example and against plain Python."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlark.functions import dates, money, names, text
from paperlark.operators import matching as M


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_money(spark):
    m = money
    got = one(spark, m.parse_money(F.lit("-1 234,50")), m.parse_money(F.lit("12,5")), m.format_money(F.lit(-123456789)), m.format_money(F.lit(5), False), m.parse_user_price(F.lit("89.9")), m.parse_user_price(F.lit("abc")), m.parse_user_price(F.lit(" ")))
    assert got == (-123450, None, "-1 234 567,89 Kč", "0,05", 8990, None, None)


def test_names(spark):
    got = one(spark, text.name_key(F.lit("Kukuř. kuře .prs.ř.")), names.expand(F.lit("Hrozny bílé 500gBS")), names.expand(F.lit("Kukuř.kuře.prs.ř.")), names.categorize(F.lit("Rohlík")), names.categorize(F.lit("xyz")), names.similarity(F.lit("abc abcde"), F.lit("abcde")), names.similarity(F.lit(""), F.lit("abc")))
    assert got == ("kukur.kure.prs.r", "Hrozny bílé 500 g bez semen", "Kukuřičné kuřecí prsní řízky", "PECIVO", "OSTATNI", 2.0, 0.0)
    assert one(spark, names.categorize_tags(F.array(F.lit("en:frozen-foods")), F.lit("x")), names.category_label(F.lit("?"))) == ("MRAZENE", "Ostatní")


def test_dates(spark):
    got = one(spark, dates.find_date(F.lit("01.01.26 10:00 a 07.10.26 18:39:41")).cast("string"), dates.find_date(F.lit("07/10/26 8:05")).cast("string"), dates.find_date(F.lit("1. 2. 2026 ahoj 3.4.2026")).cast("string"), dates.find_date(F.lit("x")), dates.month_title(F.lit(None).cast("date")))
    assert got == ("2026-10-07 18:39:41", "2026-10-07 08:05:00", "2026-02-01 00:00:00", None, "Bez data")


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aábčďéěíňóřšťúůýžÁŽ xyz.", max_size=12), min_size=1, max_size=8))
def test_strip_diacritics_is_nfd(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn")
    assert [r[0] for r in df.select(text.strip_diacritics(F.lower("w"))).collect()] == [plain(w) for w in words]


def test_matching_precedence(spark):
    entries = spark.createDataFrame([("lidl", "Chléb horský", "A", 0), ("albert", "Chleb horsky1", "B", 1), ("lidl", "Máslo", "C", 2), ("lidl", "Tvaroh tučný 500g", "D", 3)], "store string, alias string, product_id string, seq int")
    asked = spark.createDataFrame([(1, "Lidl", "Ch1eb horsky"), (2, "Lidl", "Chleb horsky1"), (3, "Lidl", "Masl0"), (4, "Billa", "chléb horský."), (5, "Lidl", "Masl"), (6, "Lidl", "Tvaroh tucny 5OOg"), (7, None, None), (8, "Lidl", "Zcela jiné")], "id int, store string, name string")
    got = {r.id: r.product_id for r in M.match_names(asked, entries).collect()}
    # a fuzzy hit in the own store goes before an exact one elsewhere; short names match exactly only
    assert got == {1: "A", 2: "A", 3: "C", 4: "A", 5: None, 6: "D", 7: None, 8: None}


def test_resolution(spark):
    items = spark.createDataFrame([(1, "lidl", "Rohlík"), (2, "lidl", "Máslo"), (3, "lidl", "Neznámá věc")], "id int, store string, raw_name string")
    mappings = spark.createDataFrame([("rohlik", "Můj rohlík", "PECIVO", None)], "raw_key string, name string, category string, image_url string")
    catalog = spark.createDataFrame([("p1", "Máslo 250 g", "MLECNE", "i", "B")], "product_id string, name string, category string, image_url string, brand string")
    aliases = spark.createDataFrame([("lidl", "Máslo", "p1", 0)], "store string, alias string, product_id string, seq int")
    got = {r.id: (r.name, r.category, r.image_url, r.catalog_id) for r in M.resolve_items(items, mappings, catalog, aliases).collect()}
    assert got == {1: ("Můj rohlík", "PECIVO", None, None), 2: ("Máslo 250 g", "MLECNE", "i", "p1"), 3: ("Neznámá věc", "OSTATNI", None, None)}
