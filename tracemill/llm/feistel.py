"""A keyed permutation of 0 .. n - 1 as a SQL expression: a Feistel network with cycle walking."""

from __future__ import annotations

ROUNDS = 8
WALK = 64


def feistel(x: str, n: str, seed: str, inverse: bool = False) -> str:
    """SQL for the place of ``x`` in the permutation of 0 .. n - 1 keyed by ``seed`` (all three are SQL expressions).

    Numbers are pairs (l, r) below (a, b) with a = ceil(sqrt(n)) and b = ceil(n / a), so fewer than a of the a * b
    pairs lie outside; a value that falls there is permuted again until it is below n. A walk meets only outside
    values before it ends, so WALK steps always suffice for a <= WALK, and beyond that a longer walk has a
    probability under (1 / a) ** WALK; should one occur, the expression raises an error instead of a wrong number.
    """
    a, b = f"ceil(sqrt(cast({n} as double)))", None
    b = f"ceil(cast({n} as double) / {a})"
    sign = "-" if inverse else "+"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"

    def once(v: str) -> str:
        return f"""aggregate({order}, named_struct('l', {v} div {b}, 'r', {v} % {b}), (s, i) -> if(i % 2 = 0,
            named_struct('l', pmod(s.l {sign} pmod(xxhash64(s.r, i, {seed}), {a}), {a}), 'r', s.r),
            named_struct('l', s.l, 'r', pmod(s.r {sign} pmod(xxhash64(s.l, i, {seed}), {b}), {b}))), s -> s.l * {b} + s.r)"""

    walked = f"aggregate(sequence(1, {WALK}), {once(f'cast({x} as bigint)')}, (y, k) -> if(y < {n}, y, {once('y')}), y -> if(y < {n}, y, cast(raise_error('cycle walk too long') as bigint)))"
    return walked
