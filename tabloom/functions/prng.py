"""Deterministic randomness: every draw is a pure function of (seed, table, column, row, salt).

Expressions are built as SQL text in one of two dialects, so that the same draw can be made by Spark and by an
independent engine. 13 hexadecimal digits of an MD5 give 52 bits, which a double holds exactly."""

from __future__ import annotations

from math import gcd

SPARK, DUCK = "spark", "duck"
SPAN = 4503599627370496  # 2 ** 52


def draw(d: str, table: str, column: str, row: str, salt: int | str = 0, seed: int = 42) -> str:
    """SQL for an integer in [0, 2**52). row is an SQL expression of an integer; salt a number or such an expression."""
    s = f"'{salt}'" if isinstance(salt, int) else f"cast({salt} as string)"
    key = f"md5(concat_ws('|', '{seed}', '{table}', '{column}', cast({row} as string), {s}))"
    return f"cast(conv(substr({key}, 1, 13), 16, 10) as bigint)" if d == SPARK else f"cast('0x' || substr({key}, 1, 13) as bigint)"


def uniform(d: str, table: str, column: str, row: str, salt: int | str = 0, seed: int = 42) -> str:
    """SQL for a double in [0, 1)."""
    return f"({draw(d, table, column, row, salt, seed)} / cast({SPAN} as double))"


def below(d: str, n: str | int, table: str, column: str, row: str, salt: int | str = 0, seed: int = 42) -> str:
    """SQL for an integer in [0, n)."""
    return f"({draw(d, table, column, row, salt, seed)} % cast({n} as bigint))"


def permutation(n: int, seed: int = 42) -> tuple[int, int]:
    """(a, b) of the bijection i -> (a * i + b) mod n of [0, n): a is coprime with n, and a * n stays below 2**63."""
    if n <= 1:
        return 1, 0
    a = (seed * 2_654_435_761 + 40_503) % min(n, 1 << 31) or 1
    while gcd(a, n) != 1:
        a += 1
    return a, (seed * 97 + n // 3) % n


def permuted(row: str, n: int, seed: int = 42) -> str:
    a, b = permutation(n, seed)
    return f"(({a} * cast({row} as bigint) + {b}) % {max(n, 1)})"


def integer_division(d: str, a: str, b: str | int) -> str:
    return f"(({a}) div {b})" if d == SPARK else f"(({a}) // {b})"
