"""XXH64 as DuckDB SQL, for the oracle of the SimHash operator.

Numbers are UHUGEINT, reduced to 64 bits after each product and sum; every stage of the
hash is one CTE and loops over stripes, words and bytes are list reductions.
"""

from __future__ import annotations

_MOD = "18446744073709551616::UHUGEINT"
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _mul(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) % {_MOD})"


def _add(a: str, b: str | int) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_MOD})"


def _rotate(x: str, r: int) -> str:
    return f"((({x})::UHUGEINT * {2**r}::UHUGEINT) % {_MOD} + ({x})::UHUGEINT // {2 ** (64 - r)}::UHUGEINT)"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"


def _number(at: str, n: int) -> str:
    """The little-endian number of ``n`` bytes at byte ``at`` of the hexadecimal text x."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * i + 1}, 2)" for i in range(n - 1, -1, -1)) + ")::UBIGINT"


def _round(k: str) -> str:
    return _mul(_rotate(_mul(k, P2), 31), P1)


def xxh64_ctes(source: str, seed: int) -> str:
    """CTEs up to xx (s, h): the hash of each string ``s`` of ``source``."""
    size = 2**64
    starts = [(seed + P1 + P2) % size, (seed + P2) % size, seed, (seed - P1) % size]

    def lane(i: int) -> str:
        stripes = f"list_transform(range(0, n // 32), lambda j: {_number(f'32 * j + {8 * i}', 8)}::UHUGEINT)"
        return f"list_reduce(list_prepend({starts[i]}::UHUGEINT, {stripes}), lambda a, k: {_mul(_rotate(_add('a', _mul('k', P2)), 31), P1)})"

    merged = _add(_add(_rotate("v1", 1), _rotate("v2", 7)), _add(_rotate("v3", 12), _rotate("v4", 18)))
    words = f"list_transform(range(0, (n - a) // 8), lambda j: {_round(_number('a + 8 * j', 8))})"
    return ", ".join(
        [
            f"x0 AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {source})",
            f"x1 AS (SELECT *, {lane(0)} AS v1, {lane(1)} AS v2, {lane(2)} AS v3, {lane(3)} AS v4 FROM x0)",
            f"x2 AS (SELECT s, x, n, CASE WHEN n < 32 THEN {(seed + P5) % size}::UHUGEINT ELSE list_reduce([{merged}, v1, v2, v3, v4], lambda h, v: {_add(_mul(_xor('h', _round('v')), P1), P4)}) END AS h FROM x1)",
            f"x3 AS (SELECT s, x, n, n // 32 * 32 AS a, {_add('h', 'n')} AS h FROM x2)",
            f"x4 AS (SELECT s, x, n, a + (n - a) // 8 * 8 AS a, list_reduce(list_prepend(h, {words}), lambda h, k: {_add(_mul(_rotate(_xor('h', 'k'), 27), P1), P4)}) AS h FROM x3)",
            f"x5 AS (SELECT s, x, n, CASE WHEN n - a >= 4 THEN a + 4 ELSE a END AS a, CASE WHEN n - a >= 4 THEN {_add(_mul(_rotate(_xor('h', _mul(_number('a', 4), P1)), 23), P2), P3)} ELSE h END AS h FROM x4)",
            f"x6 AS (SELECT s, list_reduce(list_prepend(h, list_transform(range(a, n), lambda j: {_mul(_number('j', 1), P5)})), lambda h, k: {_mul(_rotate(_xor('h', 'k'), 11), P1)}) AS h FROM x5)",
            f"x7 AS (SELECT s, {_mul(_xor('h', f'h // {2**33}::UHUGEINT'), P2)} AS h FROM x6)",
            f"x8 AS (SELECT s, {_mul(_xor('h', f'h // {2**29}::UHUGEINT'), P3)} AS h FROM x7)",
            f"xx AS (SELECT s, {_xor('h', f'h // {2**32}::UHUGEINT')} AS h FROM x8)",
        ]
    )
