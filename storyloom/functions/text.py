"""Column expressions over text: offsets, white space, places, excerpts, hashes, estimates.

Offsets are code points, as Spark counts them, unless a name says utf16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.arrays import running

#: Fixed value: what counts as white space at the ends of a line.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's trim knows the ASCII space only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_offset(text: Column, at: Column) -> Column:
    """The UTF-16 offset of a code point offset."""
    return utf16_length(F.substring(text, F.lit(1), at.cast("int")))


def sliced(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start.cast("int") + 1, F.greatest((end - start).cast("int"), F.lit(0)))


def excerpt(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The span with up to radius characters on both sides."""
    return sliced(text, F.greatest(start - radius, F.lit(0)), end + radius)


def occurrences(text: Column, needle: Column) -> Column:
    """Starts of the non-overlapping occurrences from the left, as array<int>: running sums of the gaps between them."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.transform(F.split(text, quoted, F.lit(-1)), F.length)
    before = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    found = F.zip_with(running(F.transform(before, lambda n: n + F.length(needle))), before, lambda at, n: at + n)
    return F.when(F.length(needle) == 0, F.array().cast("array<int>")).otherwise(found)


def matches(text: Column, pattern: str) -> Column:
    """Spans (char_start, char_end) of the pattern's matches from the left; the pattern has no groups and matches no
    empty text. Running sums of the pieces between the matches, and of the matches, are the offsets."""
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    before = F.slice(F.transform(F.split(text, F.lit(pattern), F.lit(-1)), F.length), F.lit(1), F.size(own))
    at = running(F.zip_with(before, own, lambda a, b: a + b))
    starts = F.zip_with(at, before, lambda a, b: a + b)
    return F.zip_with(starts, own, lambda start, n: F.struct(start.alias("char_start"), (start + n).alias("char_end")))


def line_at(text: Column, at: Column) -> Column:
    """(char_start, char_end) of the line that holds an offset within the text; null outside it."""
    head, tail = F.substring(text, F.lit(1), at.cast("int")), F.substring(text, at.cast("int") + 1, F.length(text))
    start = F.length(F.regexp_replace(head, "[^\\n]*\\z", ""))
    end = at.cast("int") + F.length(F.regexp_extract(tail, "\\A[^\\n]*", 0))
    return F.when((at >= 0) & (at < F.length(text)), F.struct(start.alias("char_start"), end.alias("char_end")))


def unique_at(text: Column, quote: Column) -> Column:
    """Where the quote starts if it occurs exactly once, overlaps counted; else null."""
    first = F.instr(text, quote)
    again = F.instr(F.substring(text, first + 1, F.length(text)), quote)
    return F.when((F.length(quote) > 0) & (first > 0) & (again == 0), first - 1)


def token_estimate(text: Column) -> Column:
    """An upper bound of tokens: 1 for an ASCII character, 2 for any other."""
    return F.length(text) * 2 - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space as one space; those with a line break vanish unless they part two Latin letters or digits."""
    latin = "[A-Za-z0-9]"
    kept = F.regexp_replace(text, rf"(?<={latin})\s*\n\s*(?={latin})", " ")
    gone = F.regexp_replace(kept, r"\s*\n\s*", "")
    return F.regexp_replace(gone, r"\s+", " ")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def compact(n: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    x = n.cast("double")
    return F.when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%d", n.cast("long")))


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share.cast("double") * 100)


def display_width(text: Column) -> Column:
    """Columns on a screen: wide characters take two."""
    wide = F.regexp_replace(text, r"[^\u1100-\u115F\u2E80-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE6F\uFF00-\uFF60\uFFE0-\uFFE6]", "")
    return F.length(text) + F.length(wide)


def truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def nice_step(most: Column, ticks: int) -> Column:
    """The distance of axis ticks: 1, 2 or 5 times a power of ten, so that at most so many cover 0 to most."""
    raw = most.cast("double") / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    share = raw / power
    return F.when(most > 0, power * F.when(share <= 1, 1).when(share <= 2, 2).when(share <= 5, 5).otherwise(10))
