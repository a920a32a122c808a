"""Numbers: where Spark's own functions differ from the semantics wanted here, the rule is stated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return ((a % b) + b) % b


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def quotient(a: Column, b: Column) -> Column:
    """Integer quotient, toward zero."""
    return F.floor(F.abs(a) / F.abs(b)).cast("bigint") * F.signum(a).cast("bigint") * F.signum(b).cast("bigint")


def round_half_away(x: Column) -> Column:
    return F.round(x)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def exact_divide(a: Column, b: Column) -> Column:
    """a / b in lowest terms: struct of num and den (den > 0)."""
    g = gcd(a, b)
    sign = F.when(b < 0, -1).otherwise(1)
    return F.struct((sign * a / g).cast("bigint").alias("num"), (sign * b / g).cast("bigint").alias("den"))


@F.pandas_udf(T.LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


@F.pandas_udf(T.LongType())
def lcm(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.lcm(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def rational_add(a: Column, b: Column) -> Column:
    return _reduced(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def rational_multiply(a: Column, b: Column) -> Column:
    return _reduced(a["num"] * b["num"], a["den"] * b["den"])


def _reduced(n: Column, d: Column) -> Column:
    g = gcd(n, d)
    return F.struct((n / g).cast("bigint").alias("num"), (d / g).cast("bigint").alias("den"))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def nth_root(x: Column, n: int) -> Column:
    """The real root, of negative numbers too if n is odd."""
    root = F.pow(F.abs(x), F.lit(1.0 / n))
    return F.signum(x) * root if n % 2 else F.when(x >= 0, root)


def exact_root(x: Column, n: int) -> Column:
    """The integer root if there is one, else null."""
    r = F.round(nth_root(x, n)).cast("bigint")
    return F.when(F.pow(r.cast("double"), F.lit(n)) == x, r)


def integer_sqrt(x: Column) -> Column:
    return F.floor(F.sqrt(x))


def integer_log(x: Column, base: int = 2) -> Column:
    return F.floor(F.log(float(base), x) + 1e-12)


def scale_representative(x: Column, scale: int) -> Column:
    """The nearest multiple of `scale`; halfway between two, the one nearer to zero."""
    return (F.signum(x) * F.ceil(F.abs(x) / scale - 0.5) * scale).cast("bigint")


def is_odd(x: Column) -> Column:
    return F.abs(x % 2) == 1


def is_even(x: Column) -> Column:
    return x % 2 == 0


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def in_base(x: Column, base: int) -> Column:
    return F.lower(F.conv(x.cast("string"), 10, base))


def parse_number(s: Column, base: int = 10) -> Column:
    """The number that a text says, null if it says none."""
    if base == 10:
        return s.try_cast("double")
    digits = "0-9" if base >= 10 else f"0-{base - 1}"
    letters = "" if base <= 10 else f"a-{chr(96 + base - 10)}A-{chr(64 + base - 10)}"
    return F.when(s.rlike(f"^[+-]?[{digits}{letters}]+$"), F.conv(s, base, 10).cast("double"))


def _mask(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def flip32(x: Column) -> Column:
    """The bytes of a 32-bit number the other way round."""
    y = _mask(x.cast("bigint"), 32)
    return F.shiftleft(_mask(y, 8), 24).bitwiseOR(F.shiftleft(_mask(F.shiftright(y, 8), 8), 16)).bitwiseOR(F.shiftleft(_mask(F.shiftright(y, 16), 8), 8)).bitwiseOR(F.shiftright(y, 24))


def knuth_hash(x: Column) -> Column:
    """Multiplicative hash of a 32-bit number (the golden ratio's multiplier)."""
    return _mask(_mask(x.cast("bigint"), 32) * F.lit(2654435761).cast("bigint"), 32)


def log_of(x: Column) -> Column:
    return F.ln(x)


PI, EULER = math.pi, math.e


def numerator(x: Column) -> Column:
    """Of a fraction (struct num, den)."""
    return x["num"]


def denominator(x: Column) -> Column:
    return x["den"]


def real_part(z: Column) -> Column:
    return z["re"]


def imag_part(z: Column) -> Column:
    return z["im"]


def to_exact(x: Column, direction: int = 0) -> Column:
    """The integer of a number: toward zero, up (1) or down (-1)."""
    return (F.ceil(x) if direction > 0 else F.floor(x) if direction < 0 else truncate(x)).cast("bigint")


def random_below(n: int, seed: int | None = None) -> Column:
    """A random integer from 0 up to n."""
    return F.floor((F.rand(seed) if seed is not None else F.rand()) * n).cast("bigint")


def _let(x: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.get(F.transform(F.array(x), fn), 0)


def _plus(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64, without an overflow: the lower 32 bits first, then the upper ones with the carry."""
    low = _mask(a, 32) + _mask(b, 32)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(_mask(low, 32))


def _times(x: Column, factor: int) -> Column:
    """x times a factor below 2 ** 30, modulo 2 ** 64."""
    f = F.lit(factor).cast("bigint")
    return _plus(_mask(x, 32) * f, F.shiftleft(_mask(F.shiftrightunsigned(x, 32) * f, 32), 32))


def _mixed(y: Column, n: int) -> Column:
    return y.bitwiseXOR(F.shiftrightunsigned(y, n))


def _steps(x: Column, *steps) -> Column:
    for step in steps:
        x = _let(x, step)
    return x


def wang_hash32(x: Column) -> Column:
    """Wang's hash of a 32-bit number; the steps are not cut to 32 bits."""
    return _steps(x.cast("bigint"), lambda y: _mixed(y, 16).bitwiseXOR(F.lit(61).cast("bigint")), lambda y: _times(y, 9), lambda y: _mixed(y, 4), lambda y: _times(y, 0x27D4EB2D), lambda y: _mixed(y, 15))


def wang_hash64(x: Column) -> Column:
    """Wang's hash of a 64-bit number, as a signed one."""
    first = lambda y: _plus(F.bitwise_not(y), F.shiftleft(y, 21))
    last = lambda y: _plus(y, F.shiftleft(y, 31))
    return _steps(x.cast("bigint"), first, lambda y: _mixed(y, 24), lambda y: _times(y, 265), lambda y: _mixed(y, 14), lambda y: _times(y, 21), lambda y: _mixed(y, 28), last)


def flip64(x: Column) -> Column:
    """The bytes of a 64-bit number the other way round."""
    y = x.cast("bigint")
    return F.shiftleft(flip32(y), 32).bitwiseOR(flip32(F.shiftrightunsigned(y, 32)))


def number_text(x: Column, precision: int) -> Column:
    """A number with so many digits after the point."""
    return F.format_string(f"%.{precision}f", x.cast("double"))


def locale_text(x: Column, precision: int = 0) -> Column:
    """A number with commas between thousands."""
    return F.format_number(x, precision)
