"""Column expressions: missing values, labels, buckets, hashes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canon import repr_sql, text_sql


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x) -> Column:
    """Null or nothing but white space, Unicode blanks included."""
    # A text that begins with a printable ASCII character is filled: only others need the pattern.
    return c(x).isNull() | (~F.ascii(c(x)).between(33, 126) & c(x).rlike(r"(?U)^\s*$"))


def filled(x) -> Column:
    return ~missing(x)


def listed(*cells: tuple[Column, Column]) -> Column:
    """The values whose condition holds, in order; unlike array_compact, whose filter is interpreted for every row, all of it is compiled."""
    return F.flatten(F.array(*[F.when(when, F.array(x)).otherwise(F.array()) for when, x in cells]))


def any_of(cols) -> Column:
    return reduce(lambda a, b: a | b, cols)


def all_of(cols) -> Column:
    return reduce(lambda a, b: a & b, cols)


def equals(**values) -> Column:
    """Conjunction of column = literal."""
    return all_of([F.col(k) == F.lit(v) for k, v in values.items()])


def group_value(x) -> Column:
    return F.when(missing(x), "<MISSING>").otherwise(c(x))


def percentage(n, d) -> Column:
    """Percent with six decimals; 0 where there is nothing to divide by."""
    return F.coalesce(F.bround(F.try_divide(100.0 * c(n), c(d)), 6), F.lit(0.0))


def integer(x) -> Column:
    """A whole number in text, or null."""
    return F.trim(c(x)).try_cast("bigint")


#: Protocol numbers with a name.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}


def protocol_name(n) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), c(n).cast("int"))


def epoch_utc(seconds) -> Column:
    """ISO text of epoch seconds in UTC (session time zone UTC); null outside the years 1 to 9999."""
    s = c(seconds)
    return F.when(s.between(-62135596800, 253402300799), F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def service_hint(x, part: int) -> Column:
    """Protocol (1) or port (2) of a label such as tcp/8080, lower case; null for other labels."""
    got = F.regexp_extract(c(x), r"(?i)^\s*(tcp|udp)/([0-9]+)\s*$", part)
    return F.when(got != "", F.lower(got))


def bucket(x, limits, last: str) -> Column:
    """Label of the first limit that x does not pass."""
    out = None
    for top, label in limits:
        out = F.when(c(x) <= top, label) if out is None else out.when(c(x) <= top, label)
    return out.otherwise(last)


#: Session sizes.
SESSION_SIZES = [(1, "1"), (2, "2"), (5, "3-5"), (10, "6-10")]


def hash_bucket(text, buckets: int) -> Column:
    """First 64 bits of SHA-256, modulo the number of buckets."""
    # As a signed long, which is 2^64 too small where it is below 0: decimals cost more than the hash itself.
    head = F.conv(F.substring(F.sha2(c(text), 256), 1, 16), 16, -10).cast("long")
    return F.pmod(F.pmod(head, F.lit(buckets)) + (head < 0).cast("long") * ((1 << 64) % buckets), F.lit(buckets)).cast("int")


def digest_of(namespace: str, *parts) -> Column:
    """SHA-256 of the canonical JSON list of a namespace and whole numbers or texts (Python values or columns)."""

    def cell(p):
        if isinstance(p, str):
            return F.expr(text_sql(repr_sql(p)))
        return F.lit(p).cast("string") if isinstance(p, int) else p.cast("string")

    cells = F.concat_ws(",", F.expr(text_sql(repr_sql(namespace))), *[cell(p) for p in parts])
    return F.sha2(F.concat(F.lit("["), cells, F.lit("]")), 256)


def digest_order(namespace: str, seed: int, number) -> tuple[Column, Column]:
    """Digest of [namespace, seed, number] for a stable order, and its first 64 bits as an unsigned number."""
    digest = digest_of(namespace, seed, c(number))
    return digest, F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def review_id(data_sha256: str, number) -> Column:
    """R- and a digest of the data's hash and the record's number (from 1): the same for every run over the same data."""
    if not re.fullmatch("[0-9a-f]{64}", data_sha256):
        raise ValueError("not a lowercase SHA-256")
    bad = F.raise_error(F.concat(F.lit("not a record number: "), c(number).cast("string"))).cast("string")
    return F.when(c(number) >= 1, F.concat(F.lit("R-"), digest_of("review", data_sha256, c(number)))).otherwise(bad)


def length_prefixed(*cols) -> Column:
    """Parts with their lengths before them, so that different lists of parts give different texts."""
    return F.concat(*[F.concat(F.octet_length(c(x)).cast("string"), F.lit(":"), c(x)) for x in cols])


def formula_safe(x) -> Column:
    """Text that a spreadsheet will not take for a formula."""
    return F.when(c(x).rlike(r"^[=+\-@\t\r\n']"), F.concat(F.lit("'"), c(x))).otherwise(c(x))


def port_class(x) -> Column:
    return F.when(c(x) <= 1023, "well_known").when(c(x) <= 49151, "registered").when(c(x).isNotNull(), "dynamic")


def log_ratio(a, b) -> Column:
    return F.when(c(a).isNotNull() & (c(b) > 0), F.log1p(c(a) / c(b))).otherwise(0.0)


def share(a, b, none: float = 0.5) -> Column:
    total = c(a) + c(b)
    return F.when(c(a).isNotNull() & c(b).isNotNull() & (total > 0), c(a) / total).otherwise(none)


def anomaly_band(percentile) -> Column:
    """Fixed cuts, on the unrounded percentile."""
    p = c(percentile)
    return F.when(p >= 99.9, "TOP_0_1").when(p >= 99, "TOP_1").when(p >= 95, "TOP_5").otherwise("BASELINE")


def priority(score, flag) -> Column:
    return F.bround(F.least(F.lit(100.0), 0.9 * c(score) + 10.0 * c(flag).cast("int")), 6)


def offset_time(text) -> Column:
    """Time of an ISO-8601 text that carries an offset; null for texts without one or that cannot be read."""
    return F.when(c(text).rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(c(text)))


def sorted_unique(items) -> Column:
    return F.array_sort(F.array_distinct(items))
