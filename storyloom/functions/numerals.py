"""Chapter numbers in ASCII, full-width and Chinese numerals, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIGITS = "零一二三四五六七八九"
OTHER_DIGITS = {"〇": 0, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}

VALUE = {c: i for i, c in enumerate(DIGITS)} | OTHER_DIGITS
FULLWIDTH = {0xFF10 + i: str(i) for i in range(10)}


def parse_number(text: str) -> int | None:
    """The number a heading writes, or None."""
    s = text.strip().translate(FULLWIDTH)
    if s.isascii() and s.isdigit():
        return int(s)
    if not s or any(c not in VALUE and c not in UNITS for c in s):
        return None
    if not any(c in UNITS for c in s):
        return int("".join(str(VALUE[c]) for c in s))
    high, _, low = s.rpartition("万")
    parts = high.split("万") if high or "万" in s else []
    return sum(_below_ten_thousand(p) * 10000 for p in parts) + _below_ten_thousand(low)


def _below_ten_thousand(s: str) -> int:
    total, digit = 0, 0
    for c in s:
        if c in VALUE:
            digit = VALUE[c]
        else:
            total += (digit or (1 if c == "十" else 0)) * UNITS[c]
            digit = 0
    return total + digit


def write_number(n: int) -> str:
    """1 to 9999 as headings write them; others in ASCII."""
    if not 0 <= n < 10_000:
        return str(n)
    if n < 10:
        return DIGITS[n]
    out, gap, started = "", False, False
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d, n = divmod(n, unit)
        if d:
            out += ("零" if gap else "") + ("" if d == 1 and name == "十" and not started else DIGITS[d]) + name
            gap, started = False, True
        else:
            gap = started
    return out


def number_column(text: Column) -> Column:
    """parse_number as column expressions: a fold over the characters."""
    plain = F.translate(F.trim(text), "".join(map(chr, FULLWIDTH)), "0123456789")
    chars = F.split(plain, "")
    value = F.create_map(*[F.lit(x) for pair in VALUE.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    zero = lambda: F.lit(0).cast("long")
    start = F.struct(zero().alias("total"), zero().alias("section"), zero().alias("digit"))

    def step(a, c):
        of_unit = F.try_element_at(unit, c).cast("long")
        of_digit = F.try_element_at(value, c).cast("long")
        grown = a["section"] + F.when((a["digit"] == 0) & (c == "十"), 1).otherwise(a["digit"]) * of_unit
        return (
            F.when(of_digit.isNotNull(), F.struct(a["total"].alias("total"), a["section"].alias("section"), of_digit.alias("digit")))
            .when(c == "万", F.struct((a["total"] + (a["section"] + a["digit"]) * 10000).alias("total"), zero().alias("section"), zero().alias("digit")))
            .otherwise(F.struct(a["total"].alias("total"), grown.alias("section"), zero().alias("digit")))
        )

    by_unit = F.aggregate(chars, start, step, lambda a: a["total"] + a["section"] + a["digit"])
    by_digit = F.aggregate(chars, zero(), lambda a, c: a * 10 + F.try_element_at(value, c))
    known = "^[" + "".join(VALUE) + "".join(UNITS) + "]+$"
    return F.when(plain.rlike("^[0-9]+$"), plain.cast("long")).when(~plain.rlike(known), None).when(plain.rlike("[" + "".join(UNITS) + "]"), by_unit).otherwise(by_digit)


def numeral_column(n: Column) -> Column:
    """write_number as column expressions: a place each, zeros folded into one and dropped at the ends."""
    digit = lambda d: F.substring(F.lit(DIGITS), d + 1, F.lit(1))

    def place(unit: int, name: str) -> Column:
        d = F.floor(n / unit).cast("int") % 10
        return F.when(d > 0, F.concat(digit(d), F.lit(name))).otherwise(F.lit(DIGITS[0]))

    whole = F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), place(1, ""))
    folded = F.regexp_replace(F.regexp_replace(whole, f"{DIGITS[0]}+", DIGITS[0]), f"^{DIGITS[0]}|{DIGITS[0]}$", "")
    return F.when((n < 0) | (n >= 10_000), n.cast("string")).when(n == 0, F.lit(DIGITS[0])).otherwise(F.regexp_replace(folded, "^一十", "十"))
