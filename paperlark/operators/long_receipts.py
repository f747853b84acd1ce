"""Receipts of any length: lines are rows, and a document is never an array.

What the fold of ``receipts`` remembers between lines that decides how a line counts is little: whether the branch is known, whether
there is an item, whether the items have ended, whether a name waits for its price. That makes 16 states, and a line is a map of
states to states, packed into one number. Maps compose associatively: blocks of lines are composed on their own, then blocks of blocks,
and from the start each block gets the state that it begins in (a segmented prefix scan). With its state known a line stands for
itself: items are numbered by running sums in blocks and over blocks, and what lines say of an item, of the totals and of the
text are aggregates. A document's lines are dealt to as many tasks as it has blocks; work grows with their number.

Matches of dates, keys and numbers may run over six lines. Null and blank lines count for nothing; a document without others has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlark.functions.dates import DAY_ONLY, DOTTED, SLASHED, find_date, minute_key
from paperlark.functions.money import format_money
from paperlark.functions.text import normalize_row
from paperlark.operators import receipts as R
from paperlark.sources.shared import kept

#: Lines of a block, blocks of a block of blocks, and the lines that a match may run over.
BLOCK, FAN, SPAN = 512, 512, 6
KINDS = ("other", "rule", "end", "skip", "after", "quantity", "weight")
_KNOWN, _SOME, _ENDED, _WAITS = 1, 2, 4, 8


def _rules(state: int, kind: str, names_branch: bool, branch: bool, off: bool, item: bool, price: bool, name: bool) -> dict:
    """How a line counts in a state, and the state after it: the step of the fold on what decides alone."""
    known, some, ended, waits = (bool(state & bit) for bit in (_KNOWN, _SOME, _ENDED, _WAITS))
    is_branch = names_branch and not known
    ends = not is_branch and not ended and some and kind in ("end", "rule")
    opened = not is_branch and not ended and not ends and kind != "end"
    free = opened and kind in ("other", "rule")
    measured = opened and kind in ("quantity", "weight")
    is_off = free and some and off
    new = free and not is_off and item
    priced = free and not is_off and not new and price and waits
    born = new or priced
    keeps = not opened or kind in ("skip", "after")
    after = waits if keeps else False if measured or is_off or born else name
    return {
        "branch": is_branch, "off": is_off, "new": new, "priced": priced, "measured": measured and some, "lower": opened and kind == "after" and some, "names": not keeps,
        "next": _KNOWN * (known or is_branch and branch) | _SOME * (some or born) | _ENDED * (ended or ends) | _WAITS * after,
    }


_COUNTS = ("branch", "off", "new", "priced", "measured", "lower", "names")


def _tables() -> tuple[list[int], dict[str, list[int]]]:
    """By a line's class: the next state of each state, four bits each, and for each way to count the states in which it does."""
    maps, counts = [], {c: [] for c in _COUNTS}
    for code in range(len(KINDS) << 6):
        flags = [bool(code >> bit & 1) for bit in range(6)]
        told = [_rules(q, KINDS[code >> 6], *flags) for q in range(16)]
        packed = sum(t["next"] << 4 * q for q, t in enumerate(told))
        maps.append(packed - (1 << 64) if packed >> 63 else packed)
        for c in _COUNTS:
            counts[c].append(sum(bool(t[c]) << q for q, t in enumerate(told)))
    return maps, counts


def _of(table: list[int], kind: str, code: Column) -> Column:
    return F.element_at(F.lit(table).cast(f"array<{kind}>"), code + 1)


def _class(x: Column) -> Column:
    kind = F.array_position(F.lit(list(KINDS)), x["kind"]).cast("int") - 1
    flags = (x["names_branch"], x["branch"].isNotNull(), x["off"].isNotNull(), x["item"].isNotNull(), x["price"].isNotNull(), x["name"].isNotNull())
    return kind * 64 + sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)), F.lit(0))


#: SQL of a map applied to a state, and of one map after another.
_NEXT = "cast(shiftright({m}, 4 * cast({q} as int)) & 15 as int)"
_AFTER = " | ".join(f"shiftleft(shiftright(m, 4 * cast(shiftright(a, {4 * q}) & 15 as int)) & 15, {4 * q})" for q in range(16))
_SAME = sum(q << 4 * q for q in range(16))
_SAME -= (1 << 64) if _SAME >> 63 else 0


def _composed(maps: str) -> str:
    return f"aggregate({maps}, cast({_SAME} as bigint), (a, m) -> {_AFTER})"


def _states(maps: str, start: str) -> str:
    """The state before each map of a bounded array, and the one after the last."""
    return f"aggregate({maps}, array({start}), (s, m) -> s || array({_NEXT.format(m='m', q='element_at(s, -1)')}))"


def _entries(maps: DataFrame, blocks: int) -> DataFrame:
    """maps(doc, block, map) -> (doc, block, q): the state in which each block begins; blocks is their largest number in a document."""
    if blocks <= FAN:
        ordered = maps.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("b"))
        told = ordered.withColumn("s", F.expr(_states("transform(b, x -> x.map)", "0")))
        return told.select("doc", F.explode(F.expr("transform(b, (x, i) -> struct(x.block as block, s[i] as q))")).alias("e")).select("doc", "e.*")
    own = maps.groupBy("doc", F.expr(f"block div {FAN}").alias("upper")).agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("b"))  # FAN of them at most
    above = _entries(own.select("doc", F.col("upper").alias("block"), F.expr(_composed("transform(b, x -> x.map)")).alias("map")), -(-blocks // FAN))
    told = own.join(above.select("doc", F.col("block").alias("upper"), "q"), ["doc", "upper"]).withColumn("s", F.expr(_states("transform(b, x -> x.map)", "q")))
    return told.select("doc", F.explode(F.expr("transform(b, (x, i) -> struct(x.block as block, s[i] as q))")).alias("e")).select("doc", "e.*")


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with something in them as (doc, n, line), n being gapless from 0."""
    full = lines.select("doc", "line_no", normalize_row(F.col("line")).alias("line")).where("line <> ''").withColumn("block", F.expr(f"line_no div {BLOCK}"))
    sizes = full.groupBy("doc", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    bases = sizes.select("doc", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("doc", "block").orderBy("line_no")) - 1
    return full.join(bases, ["doc", "block"]).select("doc", (F.col("base") + place).alias("n"), "line")


def _said_lines(lines: DataFrame) -> DataFrame:
    """(doc, block, n0, xs): blocks of lines with what each says by itself; near is the line with those that a match may run on to."""
    place = F.struct("n", "line")
    copied = lines.select("doc", "n", "line", F.explode(F.expr(f"case when n % {BLOCK} < {SPAN - 1} and n >= {BLOCK} then array(n div {BLOCK}, n div {BLOCK} - 1) else array(n div {BLOCK}) end")).alias("block"))
    blocks = copied.groupBy("doc", "block").agg(F.array_sort(F.collect_list(place)).alias("ls")).withColumn("size", F.expr(f"size(filter(ls, x -> x.n div {BLOCK} = block))"))
    text = F.transform("ls", lambda x: x["line"])
    own = F.slice(text, F.lit(1), F.col("size"))
    said = blocks.select("doc", "block", own.alias("own"), R.said_lines(own, text).alias("xs"), F.transform(own, lambda x, i: F.array_join(F.slice(text, i + 1, F.lit(SPAN)), "\n")).alias("near"))
    return said.withColumn("codes", F.transform("xs", _class))


def parse_lines(lines: DataFrame, *, doc_col: str = "doc_id", line_col: str = "line_no", text_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Rows of lines -> receipts (doc_col, store .. warnings, n_items, items_sum) and items (doc_col, position, and the fields of a parsed item).

    The results are those of ``receipts.parse_receipts`` on arrays of the same lines. A document whose lines are all of one block is
    such an array, and folded as one; only longer ones go over states and blocks.
    """
    rows = lines.select(F.col(doc_col).alias("doc"), F.col(line_col).cast("long").alias("line_no"), F.col(text_col).alias("line"))
    full = rows.where(F.col("line").rlike(r"[^\s|]"))  # what normalize_row leaves something of
    blocks = kept(full.groupBy("doc", F.expr(f"line_no div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls")))
    least, most = blocks.agg(F.min("block"), F.max("block")).first()
    if least == most:
        return _short(blocks, doc_col)
    long_ones = blocks.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    short, items = _short(blocks.join(long_ones, "doc", "left_anti"), doc_col)
    long_lines = blocks.join(long_ones, "doc", "left_semi").select("doc", F.explode("ls").alias("l")).select("doc", "l.*")
    more, more_items = _long(long_lines, doc_col)
    return short.unionByName(more), items.unionByName(more_items)


def _short(blocks: DataFrame, doc_col: str) -> tuple[DataFrame, DataFrame]:
    """What ``parse_lines`` gives of documents of one block each."""
    parsed = kept(R.parse_receipts(blocks.select(F.col("doc").alias(doc_col), F.transform("ls", lambda x: x["line"]).alias("rows"))).drop("rows"))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["price"] - i["discount"])
    receipts = parsed.select(
        doc_col, "store", "branch", "purchased_at", "total", "subtotal", "total_discount", "payment", "receipt_number", "unique_key", F.size("items").cast("long").alias("n_items"), total.alias("items_sum"), "warnings",
    )
    items = parsed.select(doc_col, F.posexplode("items").alias("position", "i")).select(doc_col, F.col("position").cast("long").alias("position"), "i.*")
    return receipts, items


def _long(rows: DataFrame, doc_col: str) -> tuple[DataFrame, DataFrame]:
    """What ``parse_lines`` gives of documents of any length: rows(doc, line_no, line)."""
    said = kept(_said_lines(_numbered(rows)))
    maps, counts = _tables()
    line_maps = F.transform("codes", lambda c: _of(maps, "bigint", c))
    composed = said.select("doc", "block", line_maps.alias("ms")).select("doc", "block", F.expr(_composed("ms")).alias("map"))
    most = (said.agg(F.max("block")).first()[0] or 0) + 1
    entered = said.withColumn("ms", line_maps).join(_entries(composed, most), ["doc", "block"]).withColumn("qs", F.expr(_states("ms", "q")))
    each = F.explode(F.expr(f"transform(xs, (x, i) -> struct(block * {BLOCK} + i as n, x, own[i] as line, near[i] as near, codes[i] as code, qs[i] as q))")).alias("l")
    flat = entered.select("doc", "block", each).select("doc", "block", "l.*")
    for c in _COUNTS:
        flat = flat.withColumn(f"_{c}", _of(counts[c], "int", F.col("code"))).withColumn(f"is_{c}", F.expr(f"shiftright(_{c}, q) & 1 = 1")).drop(f"_{c}")
    flat = flat.withColumn("born", (F.col("is_new") | F.col("is_priced")).cast("int"))

    # in blocks: the number of items so far and the name that waits; then over blocks, of which there is one row each
    upto = Window.partitionBy("doc", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("doc", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    setter = F.when(F.col("is_names"), F.struct(F.when(~F.col("is_measured") & ~F.col("is_off") & (F.col("born") == 0) & F.col("x.kind").isin("other", "rule"), F.col("x.name")).alias("name")))
    flat = kept(flat.withColumns({"own_items": F.sum("born").over(upto), "own_name": F.last(setter, ignorenulls=True).over(earlier), "sets": setter}))
    sums = flat.groupBy("doc", "block").agg(F.sum("born").alias("born"), F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("n"))).alias("sets"))
    before = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("doc", "block", F.coalesce(F.sum("born").over(before), F.lit(0)).alias("base"), F.last("sets", ignorenulls=True).over(before).alias("base_name"))
    placed = flat.join(bases, ["doc", "block"]).withColumn("item_no", F.col("base") + F.col("own_items") - 1)

    x, at = F.col("x"), F.col("n")
    waiting = F.coalesce("own_name", "base_name")["name"]
    item = F.when(F.col("is_new"), x["item"]).otherwise(R._item(waiting, x["price"], x["priceVat"]))
    born = placed.where("born = 1").select("doc", "item_no", item.alias("i")).select("doc", "item_no", "i.*")
    says = placed.where("is_measured or is_off or is_lower").select("doc", "item_no", "n", "x", "is_measured", "is_off", "is_lower").join(born.select("doc", "item_no", F.col("price").alias("full")), ["doc", "item_no"])
    valid = F.col("is_lower") & x["after"].between(0, F.col("full"))
    by = lambda value, cond: F.max_by(value, F.when(cond, at))
    told = says.groupBy("doc", "item_no").agg(
        by(F.struct(x["quantity"].alias("q"), F.when(x["kind"] == "weight", "kg").otherwise("ks").alias("u"), x["unitPrice"].alias("p")), F.col("is_measured")).alias("m"),
        F.max(F.when(valid, at)).alias("lower_at"), by(x["after"], valid).alias("after"), F.max(valid & (x["after"] != F.col("full"))).alias("lowered"), by(x["offLabel"], F.col("is_off")).alias("label"),
    )
    offs = says.where("is_off").select("doc", "item_no", "n", x["off"].alias("off")).join(told.select("doc", "item_no", "lower_at"), ["doc", "item_no"])
    offs = offs.where("lower_at is null or n > lower_at").groupBy("doc", "item_no").agg(F.sum("off").alias("off"))
    full = born.join(told, ["doc", "item_no"], "left").join(offs, ["doc", "item_no"], "left")
    discount = F.when(F.col("lower_at").isNotNull(), F.col("price") - F.col("after")).otherwise(F.lit(0)) + F.coalesce("off", F.lit(0))
    measured = F.col("m").isNotNull()
    items = full.select(
        F.col("doc").alias(doc_col), F.col("item_no").alias("position"), "rawName", "price", F.when(measured, F.col("m.q")).otherwise(F.col("quantity")).alias("quantity"), F.when(measured, F.col("m.u")).otherwise(F.col("unit")).alias("unit"),
        F.when(measured, F.col("m.p")).otherwise(F.col("unitPrice")).alias("unitPrice"), discount.alias("discount"), F.coalesce("label", F.when(F.col("lowered"), F.lit("Sleva"))).alias("discountLabel"), "vat", "articleCode",
    )
    items = kept(items)

    open_ = ~F.col("is_branch")
    first = lambda value, cond=True: F.min_by(value, F.when(value.isNotNull() & cond, at))
    last = lambda value, cond=True: F.max_by(value, F.when(value.isNotNull() & cond, at))
    near = F.col("near")
    hit = lambda p: F.when(near.rlike(p), F.try_element_at(F.regexp_extract_all(near, F.lit(p), F.lit(0)), F.lit(-1)))
    store = F.lit(None).cast("int")
    for k, (needle, _) in reversed([*enumerate(R.STORES)]):
        store = F.when(F.contains(F.lower("line"), F.lit(needle)), k).otherwise(store)
    heads = placed.groupBy("doc").agg(
        F.min(store).alias("store"), first(x["branch"], F.col("is_branch")).alias("branch"), first(F.coalesce(x["total"], x["generic"]), open_).alias("total"), last(x["subtotal"], open_).alias("subtotal"),
        F.coalesce(last(x["totalDiscount"], open_), F.lit(0)).alias("off"), first(x["payment"], open_).alias("payment"), first(R._group(near, R.RECEIPT_NUMBER)).alias("number"), last(hit(R.LOYALTY_KEY)).alias("key"),
        F.concat_ws("\n", first(F.when(near.rlike(DAY_ONLY), F.regexp_substr(near, F.lit(DAY_ONLY)))), last(hit(SLASHED)), last(hit(DOTTED))).alias("dates"),
    )
    sums = items.groupBy(F.col(doc_col).alias("doc")).agg(F.count("*").alias("n_items"), F.sum(F.col("price") - F.col("discount")).alias("items_sum"), F.sum("discount").alias("item_discounts"))
    found = heads.join(sums, "doc", "left").fillna(0, ["n_items", "items_sum", "item_discounts"]).withColumn("date", find_date(F.col("dates")))
    shop = F.coalesce(F.get(F.lit([label for _, label in R.STORES]), F.col("store")), F.lit(R.UNKNOWN_STORE))
    total, reference, date = F.coalesce("total", "subtotal"), F.coalesce("subtotal", "total"), F.col("date")
    key = F.concat(F.regexp_extract("key", R.LOYALTY_KEY, 1), F.lit(" "), F.replace(F.regexp_extract("key", R.LOYALTY_KEY, 2), F.lit(" "), F.lit("")))
    unique = F.when(F.col("key").isNotNull() & date.isNotNull(), F.concat_ws("|", shop, key, F.date_format(date, "yyyy-MM-dd"))).when(date.isNotNull() & total.isNotNull(), F.concat_ws("|", shop, minute_key(date), total.cast("string")))
    differs = F.concat(F.lit("Součet položek "), format_money(F.col("items_sum")), F.lit(" nesedí s celkem "), format_money(reference), F.lit(" – některá položka se možná špatně přečetla."))
    warnings = F.array_compact(F.array(F.when(F.col("n_items") == 0, R.NO_ITEMS).when(F.abs(reference - F.col("items_sum")) > R.PARSE_TOLERANCE, differs), F.when(total.isNull(), R.NO_TOTAL), F.when(date.isNull(), R.NO_DATE)))
    receipts = found.select(
        F.col("doc").alias(doc_col), shop.alias("store"), "branch", date.alias("purchased_at"), "total", "subtotal", F.when(F.col("off") > 0, F.col("off")).otherwise(F.col("item_discounts")).alias("total_discount"), "payment",
        F.col("number").alias("receipt_number"), unique.alias("unique_key"), "n_items", "items_sum", warnings.alias("warnings"),
    )
    return receipts, items
