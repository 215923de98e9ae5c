"""Pieces of the DuckDB texts."""


def m(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def i(x: str) -> str:
    return f"try_cast(trim({x}) AS BIGINT)"


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE round(100.0 * ({n}) / ({d}), 4) END"
