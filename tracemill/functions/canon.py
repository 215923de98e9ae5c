"""Canonical JSON as column expressions: keys in order at every depth, no blanks, UTF-8, one form for every number.

Expressions are written as SQL text and parsed once: a nested type gives one text, whatever the number of its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of control characters that have a short form.
SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
ESCAPES = ", ".join(["struct(chr(92) AS c, concat(chr(92), chr(92)) AS e)", "struct(chr(34) AS c, concat(chr(92), chr(34)) AS e)", *[f"struct(chr({i}) AS c, concat(chr(92), '{SHORT.get(i, f'u{i:04x}')}') AS e)" for i in range(32)]])


def let(value: str, name: str, body: str) -> str:
    """``body`` with a name for a value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def text_sql(x: str) -> str:
    """A JSON string: quotes, backslashes and control characters escaped, all others as they are."""
    # Written without a name for the text: what lambdas hold is interpreted for every row, and here only texts to be escaped need one.
    return f"""concat('"', if({x} rlike r'[\\x00-\\x1f"\\\\]', aggregate(array({ESCAPES}), {x}, (t, p) -> replace(t, p.c, p.e)), {x}), '"')"""


def name_sql(name: str) -> str:
    """A known name as a JSON string, escaped when the expression is written and not for every row."""
    short = {i: f"\\{SHORT.get(i, f'u{i:04x}')}" for i in range(32)}
    return repr_sql('"' + name.translate({92: "\\\\", 34: '\\"', **short}) + '"')


def double_sql(x: str) -> str:
    """The shortest digits of a number; plain from 1e-4 up to 1e16, else with an exponent of two digits or more.

    NaN and infinities have no JSON form and are an error. Every text gives the number again; above 2^63 the last of 17 digits may
    be the second nearest (one of 200,000 numbers tried).
    """
    # The JVM may print a digit more than needed: the fewest digits that give the number again count. Up to 2^63 the digits
    # of a large number are those of an integer.
    exact = "cast(cast(if(w >= 16 and v < 9.2e18, v, null) as bigint) as string)"
    first = f"coalesce(concat(left({exact}, 1), '.', substring({exact}, 2)), regexp_extract(t, '^([0-9.]+)E', 1))"
    fewer = lambda p: f"cast(round(try_cast(m as decimal(20, 18)), {p - 1}) as string)"
    same = lambda p: f"if(try_cast(concat({fewer(p)}, 'E', w) as double) = v, {fewer(p)}, null)"
    mantissa = f"CASE WHEN w < -300 THEN coalesce({', '.join(same(p) for p in range(1, 17))}, m) WHEN length(m) > 16 THEN coalesce({', '.join(same(p) for p in (15, 16, 17))}, m) ELSE m END"
    digits = "regexp_replace(replace(k, '.', ''), '(?<=[0-9])0+$', '')"
    whole = "if(length(d) <= w + 1, concat(rpad(d, w + 1, '0'), '.0'), concat(left(d, w + 1), '.', substring(d, w + 2)))"
    far = "concat(left(d, 1), if(length(d) > 1, concat('.', substring(d, 2)), ''), 'e', if(w < 0, '-', '+'), lpad(cast(abs(w) as string), greatest(2, length(cast(abs(w) as string))), '0'))"
    plain = f"CASE WHEN w is null THEN t WHEN w between 0 and 15 THEN {whole} WHEN w between -4 and -1 THEN concat('0.', repeat('0', -w - 1), d) ELSE {far} END"
    body = let(first, "m", let(mantissa, "k", let(digits, "d", plain)))
    body = let("cast(v as string)", "t", let("try_cast(regexp_extract(t, 'E(-?[0-9]+)$', 1) as int)", "w", body))
    bad = "cast(raise_error(concat('no JSON form of ', cast(n as string))) as string)"
    signed = f"if(isnan(n) or abs(n) = cast('inf' as double), {bad}, concat(if(cast(n as string) like '-%', '-', ''), {let('abs(n)', 'v', body)}))"
    # Numbers that the JVM prints without an exponent stay as they are; the others are few and go through lambdas.
    n = f"cast({x} as double)"
    return f"if({n} is null or {n} = 0 or (abs({n}) >= 1e-3 and abs({n}) < 1e7), cast({n} as string), {let(n, 'n', signed)})"


def canonical_sql(x: str, kind: T.DataType, depth: int = 0, fields=None) -> str:
    """The canonical JSON text of a value of a type; structs and maps by name of key, nulls as null."""
    own = f"x{depth}"
    if isinstance(kind, T.StructType):
        cell = lambda f: f"concat({name_sql(f.name)}, ':', {canonical_sql(fields(f.name) if fields else f'{x}.`{f.name}`', f.dataType, depth + 1)})"
        cells = [cell(f) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = "concat('{', array_join(array(" + ", ".join(cells) + "), ','), '}')" if cells else "'{}'"
        return body if fields else f"if({x} is null, 'null', {body})"
    if isinstance(kind, T.ArrayType):
        return f"coalesce(concat('[', array_join(transform({x}, {own} -> {canonical_sql(own, kind.elementType, depth + 1)}), ','), ']'), 'null')"
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.AtomicType):
        cell = f"concat({text_sql(f'cast({own}.key as string)')}, ':', {canonical_sql(f'{own}.value', kind.valueType, depth + 1)})"
        return f"coalesce(concat('{{', array_join(transform(sort_array(map_entries({x})), {own} -> {cell}), ','), '}}'), 'null')"
    if isinstance(kind, T.MapType):
        cell = f"concat({text_sql(f'cast(k{depth} as string)')}, ':', {canonical_sql(f'{own}[k{depth}]', kind.valueType, depth + 1)})"
        return let(x, own, f"coalesce(concat('{{', array_join(transform(array_sort(map_keys({own})), k{depth} -> {cell}), ','), '}}'), 'null')")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"coalesce({double_sql(x)}, 'null')"
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return f"coalesce(cast({x} as string), 'null')"
    return f"coalesce({text_sql(f'cast({x} as string)')}, 'null')"


def repr_sql(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def canonical_json(x: str, kind: T.DataType) -> Column:
    """The canonical JSON text of an SQL expression of a type. Numbers of single precision are printed as doubles, other types
    (dates, times, decimals) as strings."""
    return F.expr(canonical_sql(x, kind))


def row_json(schema: T.StructType) -> Column:
    """The canonical JSON text of a whole row."""
    return F.expr(canonical_sql("", schema, fields=lambda name: f"`{name}`"))


def rebuilt(text: str, kind: T.StructType) -> Column:
    """The value of a canonical JSON text (an SQL expression); null where the text does not parse or is not the canonical form of
    that value, as with keys that are absent, foreign, repeated or out of order, and with values of another type."""
    back = let(f"from_json(z, {repr_sql(kind.toDDL())})", "y", f"if({canonical_sql('y', kind)} = z, y, null)")
    return F.expr(let(text, "z", back))


def with_rebuilt(df: DataFrame, text: str, kind: T.StructType, name: str) -> DataFrame:
    """df with ``name``, the ``rebuilt`` value of a column of texts, parsed and checked in two steps, so that both are compiled."""
    parsed = df.withColumn(name, F.from_json(text, kind))
    return parsed.withColumn(name, F.when(canonical_json(f"`{name}`", kind) == F.col(text), F.col(name)))


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.IntegralType, T.BooleanType, T.StringType))


def same_text(a: str, b: str, kind: T.DataType) -> Column:
    """Whether two SQL expressions of a type have one canonical text; without writing it where equal values alone have equal texts."""
    if isinstance(kind, T.MapType) and _plain(kind.keyType) and _plain(kind.valueType):
        return F.expr(f"sort_array(map_entries({a})) <=> sort_array(map_entries({b}))")
    return F.expr(f"{a} <=> {b}") if _plain(kind) else canonical_json(a, kind) == canonical_json(b, kind)
