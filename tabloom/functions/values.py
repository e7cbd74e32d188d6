"""Typed value generators as SQL expressions: one value per row, within [lo, hi); lo where lo = hi."""

from __future__ import annotations


from tabloom.functions.prng import DUCK, SPARK, below, integer_division, uniform

#: The characters of generated strings.
LETTERS = "abcdefghijklmnopqrstuvwxyz"



def _u(d: str, name: str, row: str, salt: int = 0) -> str:
    return uniform(d, "v", name, row, salt)


def _floor(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


def integer(d: str, row: str, name: str, lo: int, hi: int, kind: str = "integer") -> str:
    """Smallint, integer and bigint (VG1 to VG3). A range wider than 2**52 takes two draws."""
    if hi <= lo:
        return f"cast({lo} as {kind})"
    if hi - lo <= 1 << 52:
        return f"cast({lo} + {below(d, hi - lo, 'v', name, row)} as {kind})"
    high = (hi - lo) >> 40
    return f"cast({lo} + {below(d, high, 'v', name, row)} * {1 << 40} + {below(d, 1 << 40, 'v', name, row, 1)} as {kind})"


def distinct_integer(row: str, lo: int, kind: str = "bigint") -> str:
    """Distinct integers run upward from the first bound: lo + row."""
    return f"cast({lo} + {row} as {kind})"


def floating(d: str, row: str, name: str, lo: float, hi: float, digits: int) -> str:
    """Real (6 decimals) and double precision (15) (VG4, VG5)."""
    value = f"({lo!r} + {_u(d, name, row)} * {hi - lo!r})" if hi > lo else f"cast({lo!r} as double)"
    return f"round(cast({value} as double), {digits})"


def numeric(d: str, row: str, name: str, p: int, s: int, lo: float | None = None, hi: float | None = None) -> str:
    """VG6: by default [0, 10**(p - s) - 10**-s]; reversed bounds are swapped; half-up to the scale. Whole units of the
    last place are drawn, so that no rounding of binary fractions decides."""
    top = 10**p - 1
    a, b = (0, top) if lo is None or hi is None else sorted((round(lo * 10**s), round(hi * 10**s)))
    units = integer(d, row, name, a, b + (lo is None), "bigint")
    return f"cast(cast({units} as decimal(38, 0)) / {10**s} as decimal({p}, {s}))" if d == DUCK else f"cast(cast({units} as decimal(20, 0)) / {10**s} as decimal({p}, {s}))"


def money(d: str, row: str, name: str) -> str:
    """VG7: the full range of money, two decimals."""
    cents = integer(d, row, name, -(1 << 62), 1 << 62, "bigint")
    return f"cast({cents} as decimal(19, 0)) * cast(0.01 as decimal(3, 2))"


def text(d: str, row: str, name: str, size: int) -> str:
    """VG8: size characters of hexadecimal digests."""
    part = lambda i: f"md5(concat_ws('|', 'text', '{name}', cast({row} as string), '{i}'))"
    return f"substr(concat({', '.join(part(i) for i in range(max(1, -(-size // 32))))}), 1, {size})"


def text_between(d: str, row: str, name: str, left: str, right: str, avg: int, most: int) -> str:
    """VG9: the bounds' common prefix, one character strictly between the next ones, random characters up to
    min(avg, most), cut to most. Equal bounds give that value; neighbouring characters give the left one. Only printable
    characters: a left bound that is over counts as ending in a blank."""
    if left == right:
        return f"'{left}'"
    n = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
    a = ord(left[n]) if n < len(left) else 32
    b = ord(right[n]) if n < len(right) else 126
    mid = f"chr(cast({a + 1} + {below(d, max(1, b - a - 1), 'v', name, row)} as int))" if b - a > 1 else f"'{chr(a)}'"
    pad = max(0, min(avg, most) - n - 1)
    rest = f", {text(d, row, name + '-pad', pad)}" if pad else ""
    return f"substr(concat('{left[:n]}', {mid}{rest}), 1, {most})"


def distinct_text(d: str, row: str, name: str, size: int) -> str:
    """VG10: the row in base 26 as a fixed-width suffix makes values distinct by construction."""
    places = 7
    digit = lambda i: f"substr('{LETTERS}', cast({integer_division(d, row, 26**i)} % 26 as int) + 1, 1)"
    return f"concat({text(d, row, name, max(0, size - places)) if size > places else chr(39) * 2}, {', '.join(digit(i) for i in reversed(range(places)))})"


def boolean(d: str, row: str, name: str) -> str:
    return f"({_u(d, name, row)} < 0.5)"


def bytea(d: str, row: str, name: str, size: int) -> str:
    r"""VG12: \x and size random bytes in hexadecimal."""
    return (r"concat('\\x', " if d == SPARK else r"concat('\x', ") + text(d, row, name, 2 * size) + ")"


def date(d: str, row: str, name: str, lo: str, hi: str) -> str:
    """VG13: a day of [lo, hi); lo if hi isn't later."""
    days = f"datediff(date'{hi}', date'{lo}')" if d == SPARK else f"datediff('day', date'{lo}', date'{hi}')"
    at = f"cast(floor({_u(d, name, row)} * greatest({days}, 1)) as int)"
    return f"date_add(date'{lo}', {at})" if d == SPARK else f"cast(date'{lo}' + {at} as date)"


def timestamp(d: str, row: str, name: str, lo_us: int = 0, hi_us: int = 4_102_444_800_000_000) -> str:
    """VG14, VG15: microseconds since 1970 in UTC; by default 1970 to 2100."""
    at = integer(d, row, name, lo_us, hi_us, "bigint")
    return f"cast(timestamp_micros({at}) as timestamp_ntz)" if d == SPARK else f"make_timestamp({at})"


def timestamptz_micros(d: str, text: str) -> str:
    """Microseconds of a text with an offset like +07, which gets its minutes."""
    if d == SPARK:
        return rf"unix_micros(to_timestamp(regexp_replace({text}, '([+-]\\d\\d)$', '$1:00')))"
    return rf"epoch_us(cast(regexp_replace({text}, '([+-]\d\d)$', '\1:00') as timestamptz))"


def seconds_of_day(d: str, row: str, name: str, lo: int = 0, hi: int = 86_400) -> str:
    """VG16: a second of the day; the full day if the range is none."""
    if not 0 <= lo < hi <= 86_400:
        lo, hi = 0, 86_400
    return f"cast({lo} + {below(d, hi - lo, 'v', name, row)} as bigint)"


def clock(d: str, seconds: str) -> str:
    two = lambda x: f"lpad(cast({x} as string), 2, '0')"
    return f"concat({two(integer_division(d, seconds, 3600))}, ':', {two(integer_division(d, seconds + ' % 3600', 60))}, ':', {two(f'({seconds}) % 60')})"


def interval(d: str, row: str, name: str, lo: tuple[int, int, int, int] = (0, 0, 0, 0), hi: tuple[int, int, int, int] = (10, 12, 30, 86_400)) -> str:
    """VG18: years, months, days and seconds, each uniform between the bounds' parts, both included; ISO 8601."""
    part = [f"cast({a} + {below(d, max(1, b - a + 1), 'v', name, row, i)} as string)" for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
    return f"concat('P', {part[0]}, 'Y', {part[1]}, 'M', {part[2]}, 'DT', {part[3]}, 'S')"


def coordinate(d: str, row: str, name: str, lo: float = -1000.0, hi: float = 1000.0) -> str:
    return f"round({lo!r} + {_u(d, name, row)} * {hi - lo!r}, 6)"


def point(d: str, row: str, name: str) -> str:
    return f"concat('(', cast({integer(d, row, name + 'x', -1000, 1000, 'bigint')} as string), ',', cast({integer(d, row, name + 'y', -1000, 1000, 'bigint')} as string), ')')"


def json(d: str, row: str, name: str) -> str:
    q = '"'
    return f"concat('{{{q}id{q}:', cast({row} as string), ',{q}tag{q}:{q}', {text(d, row, name, 6)}, '{q}}}')"


def time_range(d: str, row: str, name: str) -> tuple[str, str]:
    """VG21: lower and upper bound, the lower one first."""
    a, b = (integer(d, row, f"{name}{i}", 0, 4_102_444_800_000_000, "bigint") for i in "ab")
    return f"least({a}, {b})", f"greatest({a}, {b})"


def pick(d: str, values: str, n: int | str, row: str, name: str) -> str:
    """A value of an array expression of n values, uniformly."""
    at = f"cast({below(d, n, 'v', name, row)} as int) + 1"
    return f"element_at({values}, {at})" if d == SPARK else f"({values})[{at}]"


