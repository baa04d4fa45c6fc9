"""Column functions: symbols, paths, text blocks, codecs' small parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U32 = 4294967295


def pack_symbol(symbol: Column, field: Column) -> Column:
    """16 bits of symbol, 16 bits of field."""
    return symbol.cast("long").bitwiseOR(F.shiftleft(field.cast("long"), 16))


def unpack_symbol(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(65535), F.shiftrightunsigned(packed, 16)


def symbol_of(token: Column) -> Column:
    """32 bits of the token's MD5."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def mixed_symbol(sym: Column) -> Column:
    """What a symbol adds to a window's fingerprint."""
    return sym.bitwiseXOR(F.shiftleft(sym, 5).bitwiseAND(U32))


def trim_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def one_of(text: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(text.isin(*allowed), text).otherwise(default)


def header_long(text: Column, fallback: int) -> Column:
    """The number that a header starts with, else the fallback."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("bigint"), F.lit(fallback))


def extension(path: Column) -> Column:
    """Lower-case extension of the last part of a path; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def owner_and_name(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?:https?://|git@)[^/:]+[/:]([^/]+)/([^/#?]+?)(?:\.git)?/?(?:[#?].*)?$"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)


def clean_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def decode_entities(text: Column) -> Column:
    """The five entities of XML and the two quotes by number; the ampersand last, so nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&#xA;", "\n"), ("&#xD;", "\r"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def blocks(html: Column, tag: str = "code") -> Column:
    """Array of the contents of all elements of a tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1, both included, cut to what there is."""
    lines = F.split(text, "\n", -1)
    start = F.greatest(first, F.lit(1)).cast("int")
    return F.array_join(F.slice(lines, start, F.greatest(F.least(last.cast("int"), F.size(lines)) - start + 1, F.lit(0))), "\n")


# The constant of the hash, fixed by the format.
_GOLDEN = 0x9E3779B9


def vector_hash(values: Column) -> Column:
    """A 64-bit hash of an array of 32-bit numbers: from its size on, each number x turns a seed s into s ^ (x + constant + (s << 6) + (s >> 2)), all unsigned. Sums are taken in halves, as they wrap around."""
    low = lambda x: x.bitwiseAND(U32)
    high = lambda x: F.shiftrightunsigned(x, 32)

    def step(seed: Column, x: Column) -> Column:
        left, right = F.shiftleft(seed, 6), F.shiftrightunsigned(seed, 2)
        lows = low(left) + low(right) + x + F.lit(_GOLDEN)
        return seed.bitwiseXOR(F.shiftleft(high(left) + high(right) + high(lows), 32).bitwiseOR(low(lows)))

    return F.aggregate(values, F.size(values).cast("long"), step)


def path_ancestors(path: Column) -> Column:
    """Array of all folders above a path, for equality joins with folder rules."""
    parts = F.split(F.regexp_replace(path, r"^/+", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def exploded(rows: DataFrame, key: str, values: Column, pos: str, value: str) -> DataFrame:
    """(key, pos, value) for every element of an array. With a plain explode the optimizer adds a filter on the array's size and makes the whole array a second time for it; the outer form has no such filter, and its row for an empty array is dropped."""
    return rows.select(key, F.posexplode_outer(values).alias(pos, value)).where(F.col(pos).isNotNull())


def _doubled(rows: DataFrame, values: Column, width: int, out: str, join) -> DataFrame:
    """rows with out, join of all `width` neighbours of an array. Each doubling is a column of its own step, so it is made once: about 2 * log2(width) passes, no shuffle. Arrays shorter than width give an empty one."""
    rows = rows.withColumn("_power", values).withColumn("_n", F.size("_power"))

    def joined(a: str, wa: int, b: str, wb: int) -> Column:
        m = F.greatest(F.col("_n") - (wa + wb) + 1, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(wa + 1), m), join)

    have, size = 0, 1
    while True:
        if width & size:
            rows = rows.withColumn("_total", joined("_total", have, "_power", size) if have else F.col("_power"))
            have += size
        if 2 * size > width:
            return rows.withColumn(out, F.when(F.col("_n") >= width, F.col("_total")).otherwise(F.array().cast("array<bigint>"))).drop("_power", "_total", "_n")
        rows, size = rows.withColumn("_power", joined("_power", size, "_power", size)), 2 * size


def sliding_sum(rows: DataFrame, values: Column, width: int, out: str) -> DataFrame:
    return _doubled(rows, values, width, out, lambda x, y: x + y)


def sliding_hash(rows: DataFrame, values: Column, width: int, out: str) -> DataFrame:
    """Hashes of all `width` neighbours that, unlike sums, see their order."""
    return _doubled(rows, values, width, out, lambda x, y: F.xxhash64(x, y))


def sliding_least(rows: DataFrame, values: Column, width: int, out: str) -> DataFrame:
    return _doubled(rows, values, width, out, lambda x, y: F.least(x, y))
