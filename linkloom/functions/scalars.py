"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of wiki names (fixed values).
WIKI_TYPES = ["wiki", "wiktionary", "wikinews", "wikisource", "wikiquote", "wikivoyage", "wikibooks", "wikiversity", "wikimedia"]
#: Largest units first, in seconds (fixed values).
TIME_UNITS = [("year", 31_536_000), ("month", 2_628_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60), ("second", 1)]


def length_characters(text: Column) -> Column:
    return F.length(text)


def length_bytes(text: Column) -> Column:
    return F.octet_length(text)


def length_utf16(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def spaces(title: Column) -> Column:
    """A title as people read it."""
    return F.translate(title, "_", " ")


def underscores(title: Column) -> Column:
    return F.translate(title, " ", "_")


#: Units of sizes and their bytes (fixed values).
SIZE_UNITS = {"B": 1, "Bytes": 1, "b": 1, "bytes": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}
#: Names of powers of 1024 (fixed values).
BINARY_UNITS = ["Bytes", "KB", "MB", "GB", "TB", "PB", "EB"]


def parse_size(text: Column) -> Column:
    """Bytes of a size such as ``26.7 GB`` (decimal units), null if it is none.

    Number and unit stand apart, units are spelled as in SIZE_UNITS, and what
    follows the unit does not count. A size beyond a long counts as its end.
    """
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    factor = F.create_map(*(F.lit(x) for pair in SIZE_UNITS.items() for x in pair))[F.get(parts, F.lit(1))]
    # decimals keep 26.7 GB exact
    size = F.floor(F.get(parts, F.lit(0)).try_cast("decimal(18,6)") * factor.cast("decimal(19,0)"))
    return F.when(size.isNotNull(), F.least(size, F.lit((1 << 63) - 1).cast("decimal(19,0)"))).cast("bigint")


def format_bytes(n: Column) -> Column:
    """Binary units up to BINARY_UNITS' last, which a long does not exceed; at most two decimals, thousands grouped."""
    power = F.when(n > 0, sum(((n >= F.lit(1024**k).cast("bigint")).cast("int") for k in range(1, len(BINARY_UNITS))), F.lit(0))).otherwise(0)
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    text = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
    return F.concat_ws(" ", text, F.element_at(F.array(*map(F.lit, BINARY_UNITS)), power + 1))


def grouped(n: Column) -> Column:
    """Thousands grouped by an underscore."""
    return F.translate(F.format_number(n, 0), ",", "_")


def si_suffix(n: Column) -> Column:
    """One decimal and the SI letter of the magnitude."""
    out = F.format_string("%.0f", n.cast("double"))
    for factor, letter in ((10**3, "k"), (10**6, "M"), (10**9, "G"), (10**12, "T"), (10**15, "P"), (10**18, "E")):
        out = F.when(F.abs(n) >= F.lit(factor), F.concat(F.format_string("%.1f", n / F.lit(float(factor))), F.lit(letter))).otherwise(out)
    return out


def time_difference(start: Column, end: Column) -> Column:
    """Struct (n, unit) of the largest unit that fits."""
    seconds = F.abs(F.unix_timestamp(end) - F.unix_timestamp(start))
    out = F.struct(seconds.alias("n"), F.lit("second").alias("unit"))
    for unit, size in reversed(TIME_UNITS):
        out = F.when(seconds >= size, F.struct(F.floor(seconds / size).alias("n"), F.lit(unit).alias("unit"))).otherwise(out)
    return out


def dump_date(text: Column) -> Column:
    """The date of ``20240901``, null if it is none."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def wiki_prefix(name: Column) -> Column:
    """The language part of a wiki's name; an unknown ending is an error."""
    ending = "(" + "|".join(sorted(WIKI_TYPES, key=len, reverse=True)) + ")$"
    return F.when(name.rlike(ending), F.regexp_replace(name, ending, "")).otherwise(F.raise_error(F.concat(F.lit("unknown wiki type: "), name)))


def is_wiki_type(name: Column) -> Column:
    return F.exists(F.array(*map(F.lit, WIKI_TYPES)), lambda ending: F.endswith(name, ending))


def slug(text: Column) -> Column:
    return F.translate(F.lower(text), " ", "-")


def unslug(text: Column) -> Column:
    plain = F.translate(text, "-", " ")
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def map_range(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """``x`` from [low, high] to [to_low, to_high]; null and empty ranges give to_low."""
    share = F.coalesce(clamp(F.try_divide(x - low, high - low), 0.0, 1.0), F.lit(0.0))
    return F.lit(to_low) + share * F.lit(to_high - to_low)


def node_size(value: Column) -> Column:
    return clamp(F.sqrt(5 * value), 15.0, 150.0)


def percentage(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole) * 100, 2)


def chunks(values: Column, n: int) -> Column:
    """``values`` in ``n`` arrays of nearly equal sizes; the first ones get one more each of what is left over."""
    if n < 1:
        raise ValueError("at least one chunk")
    size, rest = F.floor(F.size(values) / n).cast("int"), F.size(values) % n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(values, i * size + F.least(i, rest) + 1, size + (i < rest).cast("int")))


def inner(values: Column) -> Column:
    """``values`` without both ends."""
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 2, F.lit(0)))


def second_last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-2))


def merge_lists(first: Column, second: Column) -> Column:
    """Distinct values of both arrays in order; null counts as empty."""
    return F.array_union(F.coalesce(first, F.array()), F.coalesce(second, F.array()))


def merge_maps(left: Column, right: Column, depth: int = 1) -> Column:
    """Entries of both maps; the right one wins, except that maps within are merged down to ``depth`` levels."""

    def value(key: Column, a: Column, b: Column) -> Column:
        both = merge_maps(a, b, depth - 1) if depth > 1 else b
        return F.when(~F.map_contains_key(right, key), a).when(F.map_contains_key(left, key) & a.isNotNull() & b.isNotNull(), both).otherwise(b)

    return F.map_zip_with(left, right, value)


def within_hours(time: Column, start: int | None, end: int | None) -> Column:
    """Whether a time of day is in [start, end), in whole hours; never without both ends."""
    if start is None or end is None:
        return F.lit(False)
    return (F.hour(time) >= start) & (F.hour(time) < end)


def is_schedule(text: Column) -> Column:
    """Whether a schedule has five parts."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda part: part != "")) == 5


def rgb_hex(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb.bitwiseAND(0xFFFFFF).cast("bigint")), 6, "0")))


def palette_index(category: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(category), F.lit(n))


def page_url(wiki: Column, title: Column) -> Column:
    return F.concat(F.lit("https://"), wiki_prefix(wiki), F.lit(".wikipedia.org/wiki/"), F.url_encode(underscores(title)))


def titles_in_diff(html: Column, tag: str) -> Column:
    """Texts of ``ins`` or ``del`` spans of a revision diff."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def mentioned(titles: Column, title: Column) -> Column:
    return F.exists(titles, lambda text: F.contains(text, title))
