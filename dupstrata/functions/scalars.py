"""Scalar functions over file and chunk columns, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UNTYPED, LONGEST_TYPE = "---", 5


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_type(name: str | Column) -> Column:
    """The suffix after the last dot of the base name; `---` if there is none or it has more than five characters."""
    base = F.regexp_extract(_col(name), r"[^/]*$", 0)
    at = F.length(base) - F.length(F.substring_index(base, ".", -1))
    suffix = F.when(at > 0, F.substring_index(base, ".", -1)).otherwise(F.lit(""))
    return F.when(base.isNull(), base).when((at <= 0) | (F.length(suffix) > LONGEST_TYPE), F.lit(UNTYPED)).otherwise(suffix)


def normalized_file_type(name: str | Column) -> Column:
    """file_type in lower case with `:` as `-` and one trailing `~` dropped; empty is `---`."""
    plain = F.regexp_replace(F.replace(F.lower(file_type(name)), F.lit(":"), F.lit("-")), "~$", "")
    return F.when(plain == "", F.lit(UNTYPED)).otherwise(plain)


def size_class(n: str | Column) -> Column:
    """The largest power of two that is at most n; 0 for 0; null for null."""
    c = _col(n).cast("long")
    return F.when(c <= 0, F.lit(0).cast("long")).when(c > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(c)) - 1))


def storage_unit(n: str | Column) -> Column:
    """Bytes as text: two decimals and K, M or G above 1024 of the unit below; raw up to 1024."""
    c = _col(n).cast("double")
    text = lambda power, unit: F.format_string(f"%.2f{unit}", c / float(1024**power))
    return F.when(c > 1024.0**3, text(3, "G")).when(c > 1024.0**2, text(2, "M")).when(c > 1024.0, text(1, "K")).otherwise(_col(n).cast("long").cast("string"))


def parse_storage_unit(s: str | Column) -> Column:
    """Bytes from a number with an optional suffix k, m, g or t in either case."""
    c = F.lower(F.trim(_col(s)))
    number = F.regexp_extract(c, r"^([0-9]+)[kmgt]?$", 1)
    unit = F.regexp_extract(c, r"([kmgt])$", 1)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    return F.when(number != "", number.cast("long") * F.pow(F.lit(1024.0), power).cast("long"))


def hex_digest(fp: str | Column) -> Column:
    """A binary digest as full-width lower-case hex."""
    return F.lower(F.hex(_col(fp)))


def compat_hex(fp: str | Column) -> Column:
    """Hex without leading zero bytes, as an unsigned number padded to an even length."""
    plain = F.regexp_replace(hex_digest(fp), "^(00)+", "")
    return F.when(plain == "", F.lit("00")).otherwise(plain)


def mebibytes(n: str | Column) -> Column:
    return _col(n).cast("double") / 1048576.0


def percent(part: str | Column, whole: str | Column) -> Column:
    """100 part / whole; 0 for an empty whole."""
    return F.when(_col(whole) == 0, F.lit(0.0)).otherwise(100.0 * _col(part) / _col(whole))


def java_hash(name: str | Column) -> Column:
    """The 32-bit rolling hash (31 h + c over UTF-16 units) of a name, as decimal text."""
    units = F.hex(F.encode(_col(name), "UTF-16BE"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(units, "(.{4})", "$1,"), ","), lambda u: u != ""), lambda u: F.conv(u, 16, 10).cast("long"))
    wrap = lambda v: F.pmod(v + 2147483648, F.lit(4294967296)) - 2147483648
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)).cast("string")


def directory_sha1(name: str | Column) -> Column:
    """Each component of a path hashed by itself; trailing slashes drop, a leading one hashes the empty string."""
    parts = F.split(F.regexp_replace(_col(name), "/+$", ""), "/")
    return F.array_join(F.transform(parts, lambda p: F.sha1(p.cast("binary"))), "/")


#: Ways of hiding file names; alternative spellings lead to the same function.
PRIVACY = {
    "none": lambda n: _col(n),
    "flat-default": java_hash,
    "full-default": java_hash,
    "flat-sha1": lambda n: F.sha1(_col(n).cast("binary")),
    "full-sha1": lambda n: F.sha1(_col(n).cast("binary")),
    "directory-sha1": directory_sha1,
}


def private_name(name: str | Column, mode: str = "none") -> Column:
    if mode not in PRIVACY:
        raise ValueError(f"unknown privacy mode {mode!r}; known: {', '.join(PRIVACY)}")
    return PRIVACY[mode](name)


def temporal_total(new: str | Column, size: str | Column) -> Column:
    return _col(new) * _col(size)


def temporal_real(old: str | Column, size: str | Column) -> Column:
    """What a fingerprint costs in a later generation: nothing if the earlier one holds it."""
    return F.when(F.coalesce(_col(old), F.lit(0)) > 0, F.lit(0).cast("long")).otherwise(_col(size))


SQL_FUNCTIONS = {
    "file_size_category": "CREATE OR REPLACE TEMPORARY FUNCTION file_size_category(n DOUBLE) RETURNS BIGINT RETURN CASE WHEN n <= 0 THEN 0 WHEN n > 0 THEN shiftleft(1L, length(bin(CAST(n AS BIGINT))) - 1) END",
    "temporal_redundancy": "CREATE OR REPLACE TEMPORARY FUNCTION temporal_redundancy(old_count BIGINT, new_count BIGINT, size DOUBLE) RETURNS STRUCT<total DOUBLE, real DOUBLE> RETURN named_struct('total', new_count * size, 'real', CASE WHEN coalesce(old_count, 0) > 0 THEN 0D ELSE size END)",
    "most": "CREATE OR REPLACE TEMPORARY FUNCTION most(xs ARRAY<STRING>) RETURNS STRING RETURN (SELECT mode(x, true) FROM explode(xs) AS t(x))",
}


def register(spark: SparkSession) -> None:
    """Makes the analysis functions callable by name from SQL text."""
    for text in SQL_FUNCTIONS.values():
        spark.sql(text)
