"""Normal forms of rows and names. All of it Column -> Column of built-in expressions."""

from __future__ import annotations

import functools
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The first and the last Hangul syllable.
HANGUL = ("\uac00", "\ud7a3")


@lru_cache(1)
def _folding() -> tuple[str, str, str, dict[str, str]]:
    """Of all letters that decompose: those with one sign without marks, these signs, and the marks to drop; and those with several
    signs (Hangul syllables aside, which follow a rule). Made from the Unicode tables."""
    pairs, marks, several = {}, [], {}
    for code in range(0x110000):
        sign = chr(code)
        if unicodedata.category(sign) == "Mn":
            marks.append(sign)
        elif unicodedata.decomposition(sign) and not 0xAC00 <= code <= 0xD7A3:
            base = "".join(c for c in unicodedata.normalize("NFD", sign) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != sign:
                pairs[sign] = base
            elif base != sign:
                several[sign] = base
    return "".join(pairs), "".join(pairs.values()), "".join(marks), several


def _sign(code: Column) -> Column:
    """The sign of a code below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _jamo(syllable: Column) -> Column:
    """A Hangul syllable as its two or three letters, by the standard's arithmetic."""
    k = F.ascii(syllable) - 0xAC00
    last = k % 28
    return F.concat(_sign(0x1100 + F.floor(k / 588)), _sign(0x1161 + F.floor((k % 588) / 28)), F.when(last > 0, _sign(0x11A7 + last)).otherwise(""))


def drop_marks(text: Column) -> Column:
    """Marks dropped and letters of one base made it: all that matters where only Latin letters are looked for."""
    accented, base, marks, _ = _folding()
    return F.translate(text, accented + marks, base)


def strip_diacritics(text: Column) -> Column:
    """Letters of every script without their marks: the canonical decomposition without nonspacing marks. Letters that have no
    base, as ß, stay; spacing marks that follow one another keep the order of the text."""
    several, plain = _folding()[3], drop_marks(text)
    whole = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(whole, c), F.when(c.between(HANGUL[0], HANGUL[1]), _jamo(c)), c))
    return F.when(plain.rlike(f"[{HANGUL[0]}-{HANGUL[1]}{''.join(several)}]"), F.array_join(each, "")).otherwise(plain)


def normalize_row(row: Column) -> Column:
    """One row of a receipt: dashes and multiply signs unified, amounts split by the reader joined, white space collapsed."""
    t = F.translate(row, "—–−×|", "---x ")
    for pattern, to in ((r"(\d)\s*,\s+(\d)", "$1,$2"), (r"(\d)\s+,(\d)", "$1,$2"), (r"(^|\s)-\s+(\d)", "$1-$2"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def normalize_rows(rows: Column) -> Column:
    """``normalize_row`` of each row of an array; a pattern is tried only in arrays, and of these in rows, that have the signs it
    needs. White space of all kinds is made spaces first."""
    has = lambda t, *signs: functools.reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in signs])
    tried = lambda t, signs, *steps: F.when(has(t, *signs), functools.reduce(lambda u, step: F.regexp_replace(u, *step), steps, t)).otherwise(t)
    comma = lambda t: tried(t, (" ,", ", "), (r"(\d)\s*,\s+(\d)", "$1,$2"), (r"(\d)\s+,(\d)", "$1,$2"))
    dash = lambda t: tried(t, ("- ",), (r"(^|\s)-\s+(\d)", "$1-$2"))
    space = lambda t: tried(t, ("  ",), (r"\s+", " "))
    tidy = lambda out: F.when(F.exists(out, lambda t: has(t, " ,", ", ", "- ", "  ")), functools.reduce(F.transform, (comma, dash, space), out)).otherwise(out)
    out = F.transform(rows, lambda t: F.trim(F.translate(t, "—–−×|\t\n\x0b\f\r", "---x      ")))
    # a fold over nothing: the rows are made once, however often they are read
    return F.aggregate(F.array().cast("array<int>"), out, lambda v, _: v, tidy)


def name_key(raw: Column) -> Column:
    """The key that names are compared by: lower case, without marks, no space around dots, no punctuation at the end."""
    t = F.regexp_replace(strip_diacritics(F.lower(raw)), r"\s*\.\s*", ".")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.trim(F.regexp_replace(t, r"[.,:;*]+$", ""))


def fold(raw: Column) -> Column:
    """name_key with the signs that readers confuse made one: l, i, | and ! are 1, o is 0; no spaces."""
    return F.translate(F.replace(name_key(raw), F.lit(" "), F.lit("")), "li|!o", "11110")


def after(text: Column, sign: str) -> Column:
    """What follows the first sign; the empty string where there is none."""
    at = F.instr(text, sign)
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))


def item_detail(name: Column, raw: Column, quantity: Column, unit: Column, price: Column, label: Column, discount: Column) -> Column:
    """The line under an item: the raw name if another, quantity and unit price, the discount."""
    from paperlark.functions.money import format_money, format_quantity

    many = (quantity != 1.0) | (unit == "kg")
    amount = F.concat(format_quantity(quantity, unit), F.coalesce(F.concat(F.lit(" × "), format_money(price), F.lit("/"), unit), F.lit("")))
    return F.concat_ws(" · ", F.when(raw != name, raw), F.when(many, amount), F.when(discount > 0, F.concat(label, F.lit(" −"), format_money(discount))))
