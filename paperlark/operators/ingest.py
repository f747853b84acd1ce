"""Saving, replacing and correcting: each operation gives the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlark.functions.names import categorize_tags

#: Cents by which items may differ from the total when a stored receipt is checked again.
CHECK_TOLERANCE = 100


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order_col: str = "seq") -> DataFrame:
    """The last row of each key wins: new over stored, a later order_col over an earlier one. Rows are aggregated, so a key
    written many times is summed up before it is shuffled."""
    columns = [c for c in stored.columns if c != order_col]
    both = stored.select(*columns, F.lit(None).cast("long").alias("_seq"), F.lit(0).alias("_new")).unionByName(new.select(*columns, F.col(order_col).cast("long").alias("_seq"), F.lit(1).alias("_new")))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_new", "_seq")).alias("_row"))
    return last.select("_row.*")


def replace_children(items: DataFrame, new: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Items without those of the receipts that new has items for, and the new ones."""
    return items.join(new.select(key).distinct(), key, "left_anti").select(items.columns).unionByName(new)


def delete_cascade(receipts: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts and items without the receipts whose id is in gone."""
    return receipts.join(gone.select("id"), "id", "left_anti"), items.join(gone.select(F.col("id").alias("receipt_id")), "receipt_id", "left_anti").select(items.columns)


def update(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values that changes has for their key; a null change keeps what was there."""
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    return stored.join(renamed, keys, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])


def rename_all(items: DataFrame, renamed: DataFrame) -> DataFrame:
    """Name and category of every item whose raw_key is renamed (one row each: raw_key, name, category)."""
    return update(items, renamed.select("raw_key", "name", "category"), ["raw_key"])


def fill_images(items: DataFrame, images: DataFrame) -> DataFrame:
    """Images by raw_key for the items that have none."""
    told = images.select("raw_key", F.col("image_url").alias("_image"))
    return items.join(told, "raw_key", "left").select(*[F.coalesce("image_url", "_image").alias(c) if c == "image_url" else F.col(c) for c in items.columns])


def split_new(parsed: DataFrame, stored: DataFrame, order_col: str = "seq") -> DataFrame:
    """parsed (unique_key, total, items, order_col) with outcome: 'not_receipt', 'duplicate' or 'saved', and stored_id, the
    smallest id that stored has for the key (null without one, and where stored has no ids).

    A receipt has items or a total. Of equal keys the first is saved, unless the key is stored; null keys are never equal.
    """
    own_id = F.col("id").cast("long") if "id" in stored.columns else F.lit(None).cast("long")
    known = stored.where("unique_key is not null").groupBy("unique_key").agg(F.min(own_id).alias("stored_id")).withColumn("_stored", F.lit(True))
    readable = (F.size("items") > 0) | F.col("total").isNotNull()
    first = parsed.where(readable & F.col("unique_key").isNotNull()).groupBy("unique_key").agg(F.min(order_col).alias("_first"))
    outcome = F.when(~readable, "not_receipt").when(F.col("unique_key").isNull(), "saved").when(F.col("_stored") | (F.col("_first") < F.col(order_col)), "duplicate").otherwise("saved")
    return parsed.join(first, "unique_key", "left").join(known, "unique_key", "left").select(*parsed.columns, outcome.alias("outcome"), "stored_id")


def with_ids(saved: DataFrame, key: Column) -> DataFrame:
    """A stable id from a row's natural key, the same whenever the row is saved again."""
    return saved.withColumn("id", F.xxhash64(key))


def explode_items(parsed: DataFrame, id_col: str = "id") -> DataFrame:
    return parsed.select(F.col(id_col).alias("receipt_id"), F.posexplode("items").alias("position", "_item")).select("receipt_id", "position", "_item.*")


def reparse(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored receipts after their text was parsed again (id and the parser's columns): store, total, discount and warning are new;
    branch, date, payment and key new where there are any; the receipt number stays."""
    new = parsed.select("id", *[F.col(c).alias(f"_{c}") for c in ("store", "branch", "purchased_at", "total", "total_discount", "payment", "unique_key", "warning")])
    fresh, kept = {"store", "total", "total_discount", "warning"}, {"branch", "purchased_at", "payment", "unique_key"}
    hit = F.col("_store").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) if c in fresh else F.coalesce(F.col(f"_{c}"), F.col(c)) if c in kept else F.col(c)
    return stored.join(new, "id", "left").select(*[pick(c).alias(c) for c in stored.columns])


def check_totals(receipts: DataFrame, items: DataFrame, tolerance: int = CHECK_TOLERANCE) -> DataFrame:
    """id, items_sum and differs: whether the items' final prices are further than tolerance from the total."""
    sums = items.groupBy(F.col("receipt_id").alias("id")).agg(F.sum(F.col("price") - F.col("discount")).alias("s"))
    total = F.coalesce("s", F.lit(0))
    return receipts.join(sums, "id", "left").select("id", total.alias("items_sum"), (F.abs(total - F.col("total")) > tolerance).alias("differs"))


def next_position(items: DataFrame) -> DataFrame:
    """Of each receipt the place of an item added by hand."""
    return items.groupBy("receipt_id").agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("position"))


#: The hosts in the order in which they are asked, what a product from each is marked with, and the mark of the catalog's.
HOSTS = ("Open Food Facts", "Open Beauty Facts", "Open Products Facts")
CATALOG_MARK = "Katalog"
PRODUCT = ("name", "brand", "quantity", "category", "image_url", "nutriscore", "ingredients")
_ANSWER = (
    "status int, product struct<product_name_cs:string,product_name:string,generic_name_cs:string,generic_name:string,brands:string,quantity:string,categories_tags:array<string>,"
    "image_front_url:string,image_front_small_url:string,nutriscore_grade:string,ingredients_text_cs:string,ingredients_text:string>, _broken string"
)


def read_answers(answers: DataFrame) -> DataFrame:
    """Hosts' answers (code, host_rank, body) -> code, host_rank, status, the fields of a product, mark (where it is from) and broken.

    The name is the first of four fields that says something. A null body is a host that did not answer; broken: it is no JSON.
    """
    r = F.from_json("body", _ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # generated rows: the parsed answer and its name are not put in anew wherever a later step names them
    rows = answers.select("code", "host_rank", "body", F.inline(F.array(F.struct(r.alias("r")))))
    field = lambda c: F.nullif(F.trim(F.col(f"r.product.{c}")), F.lit(""))
    said = lambda *names: F.coalesce(*[F.when(F.trim(F.col(f"r.product.{c}")) != "", F.col(f"r.product.{c}")) for c in names])
    names = F.coalesce(*map(field, ("product_name_cs", "product_name", "generic_name_cs", "generic_name")))
    rows = rows.select("code", "host_rank", "body", "r", F.inline(F.array(F.struct(names.alias("name")))))
    name, grade = F.col("name"), F.col("r.product.nutriscore_grade")
    return rows.select(
        "code", "host_rank", F.col("r.status").alias("status"), "name", said("brands").alias("brand"), said("quantity").alias("quantity"),
        categorize_tags(F.coalesce("r.product.categories_tags", F.array().cast("array<string>")), F.coalesce(name, F.lit(""))).alias("category"), said("image_front_url", "image_front_small_url").alias("image_url"),
        F.when(F.length(grade) == 1, grade).alias("nutriscore"), said("ingredients_text_cs", "ingredients_text").alias("ingredients"), F.get(F.lit(list(HOSTS)), F.col("host_rank").cast("int")).alias("mark"),
        (F.col("body").isNotNull() & (F.col("r").isNull() | F.col("r._broken").isNotNull())).alias("broken"),
    )


def look_up(codes: DataFrame, products: DataFrame, catalog: DataFrame, eans: DataFrame, online: DataFrame) -> DataFrame:
    """codes(code) with the fields of a product, source, mark, linked_raw_key and offline: the saved product, else the catalog's, else
    what online hosts told (code, host_rank, status and more, as ``read_answers`` gives them; the first host with status 1 and a name).

    A code with force_online takes the online answer, if there is one, before all others, and keeps the saved link. Source is
    'unknown' where none knows it. offline: an online answer was needed and a host gave none that can be read before any other hit.
    """
    has = lambda df, c, kind="string": F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    fields = lambda df, mark: F.struct(*[has(df, c).alias(c) for c in PRODUCT], mark.alias("mark"), has(df, "linked_raw_key").alias("linked_raw_key"))
    broken = F.coalesce(has(online, "broken", "boolean"), F.lit(False))
    hit = (F.col("status") == 1) & (F.trim("name") != "")
    first = F.struct(broken.alias("broken"), fields(online, has(online, "mark")).alias("o"))
    told = online.where(hit | broken).groupBy("code").agg(F.min_by(first, "host_rank").alias("_f")).select("code", F.when(~F.col("_f.broken"), F.col("_f.o")).alias("o"), F.col("_f.broken").alias("_off"))
    local = products.select(F.col("barcode").alias("code"), fields(products, has(products, "source")).alias("p"))
    shop = has(catalog, "store")
    listed = eans.join(catalog, "product_id").select(F.col("ean").alias("code"), fields(catalog, F.concat(F.lit(CATALOG_MARK), F.coalesce(F.concat(F.lit(" ("), shop, F.lit(")")), F.lit("")))).alias("c"))
    found = codes.join(local, "code", "left").join(listed, "code", "left").join(told, "code", "left")
    forced = F.coalesce(has(codes, "force_online", "boolean"), F.lit(False))
    best = F.when(forced & F.col("o").isNotNull(), F.col("o")).otherwise(F.coalesce("p", "c", "o"))
    source = F.when(forced & F.col("o").isNotNull(), "online").when(F.col("p").isNotNull(), "local").when(F.col("c").isNotNull(), "catalog").when(F.col("o").isNotNull(), "online").otherwise("unknown")
    asked = forced | (F.col("p").isNull() & F.col("c").isNull())
    return found.select("code", *[best[c].alias(c) for c in PRODUCT], best["mark"].alias("mark"), F.col("p.linked_raw_key").alias("linked_raw_key"), source.alias("source"), (asked & F.coalesce("_off", F.lit(False))).alias("offline"))


def first_wins(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
