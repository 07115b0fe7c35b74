"""Scalar functions of pixel values, codec steps and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of luminance, weights of colour conversion, and the base of the non-linear scale beyond 1.
LUMINANCE = (0.2126, 0.7152, 0.0722)
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 1.5747, -0.1873, -0.4682, 1.8556
_NEPER = 2.7182818**2.2


def displayed(v: Column, exposure: float = 0.0, gamma: float = 2.2) -> Column:
    """v * 2**exposure, not below 0, to the power 1 / gamma; a gamma of 0 or less counts as 1.  No-op steps are left out."""
    v = v.cast("double")
    if exposure:
        v = v * (2.0**exposure)
    v = F.when(v < 0, F.lit(0.0)).otherwise(v)
    inverse = 1.0 / gamma if gamma > 0 else 1.0
    return v if inverse == 1.0 else F.pow(v, F.lit(inverse))


def to_byte(v: Column) -> Column:
    """1 or more is 255, else the whole part of v * 255; NaN is 0."""
    return F.when(F.isnan(v), 0).when(v >= 1, 255).otherwise((v * 255).cast("int"))


def alpha_byte(a: Column) -> Column:
    """The whole part of a * 255, clamped to a byte; NaN is 0, no alpha is opaque."""
    a = F.coalesce(a.cast("double"), F.lit(1.0))
    return F.when(F.isnan(a), 0).otherwise(F.least(F.greatest(a * 255, F.lit(0.0)), F.lit(255.0)).cast("int"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


def bin_of(lum: Column, bins: int = 64) -> Column:
    """Histogram bin of a luminance, negative for those below the first; NaN falls into bin 0 (in Spark NaN is greater than any number)."""
    return F.when(F.isnan(lum), 0).when(lum >= 1, bins - 1).otherwise(F.greatest(lum * bins, F.lit(-(2.0**31))).cast("int"))


def to_linear(v: Column) -> Column:
    """The non-linear scale of the lossy transform codec made linear again; the sign stays."""
    a = F.abs(v)
    return F.signum(v) * F.when(a <= 1, F.pow(a, F.lit(2.2))).otherwise(F.pow(F.lit(_NEPER), a - 1))


def csc709(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of one luma and two chroma values."""
    return y + RED_CR * cr, y + GREEN_CB * cb + GREEN_CR * cr, y + BLUE_CB * cb


def half_value(bits: Column) -> Column:
    """The number that 16 bits of IEEE binary16 stand for."""
    sign = F.when(F.shiftright(bits, 15).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    small = fraction * F.lit(2.0**-24)
    normal = (1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15)
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, small).when(exponent == 31, special).otherwise(normal)


def half_bits(v: Column, compat: bool = False, nan: int = 0x7E00) -> Column:
    """The 16 bits of IEEE binary16 nearest to a number; ties go to the even one.

    compat: ties go up, and a mantissa that is rounded up to the next power of
    two is laid over the exponent's bits instead of being added to them, so it
    is lost where the exponent is odd.
    """
    v = v.cast("float").cast("double")
    a = F.abs(v)
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), 0x8000).otherwise(0)
    guess = F.greatest(F.floor(F.log2(F.greatest(a, F.lit(2.0**-30)))), F.lit(-14)).cast("int")
    two = lambda n: F.pow(F.lit(2.0), n)
    e = F.when(a >= two(guess + 1), guess + 1).when((guess > -14) & (a < two(guess)), guess - 1).otherwise(guess)
    q = a * two(10 - e)
    if compat:
        r = F.floor(q + 0.5).cast("int")
        whole = F.when(a < 2.0**-14, r).otherwise(F.shiftleft(e + 15, 10).bitwiseOR(r - 1024))
    else:
        whole = (e + 14) * 1024 + F.rint(q).cast("int")
    return F.when(F.isnan(v), F.lit(nan)).when(a >= 65536, sign + 0x7C00).otherwise(sign + F.least(whole, F.lit(0x7C00)))


def uint_value(u: Column) -> Column:
    """An unsigned 32-bit sample as a float32 share of the largest."""
    return (u * F.lit(1.0 / 4294967295.0)).cast("float")


def sign_mapped(v: Column) -> Column:
    """Ordered 16-bit code to half bits: codes with the top bit lose it, all others are negated."""
    return F.when(v.bitwiseAND(F.lit(0x8000)) != 0, v.bitwiseAND(F.lit(0x7FFF))).otherwise(F.bitwise_not(v).bitwiseAND(F.lit(0xFFFF)))


def uint16(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0xFFFF))


def int16(v: Column) -> Column:
    u = uint16(v)
    return F.when(u >= 0x8000, u - 0x10000).otherwise(u)


def haar14(low: Column, high: Column) -> tuple[Column, Column]:
    """One lifting step back, for values below 2**14."""
    low, high = int16(low), int16(high)
    a = low + high.bitwiseAND(F.lit(1)) + F.shiftright(high, 1)
    return uint16(a), uint16(a - high)


def haar16(low: Column, high: Column) -> tuple[Column, Column]:
    """One lifting step back, modulo 2**16."""
    low, high = uint16(low), uint16(high)
    b = uint16(low - F.shiftright(high, 1))
    return uint16(high + b - F.lit(0x8000)), b


def formatted_bytes(n: Column) -> Column:
    """B, KB, MB or GB, with 2, 1 or no digits as the number grows."""
    unit = F.when(n >= 1024**3, 3).when(n >= 1024**2, 2).when(n >= 1024, 1).otherwise(0)
    value = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)
    text = F.when(value >= 100, F.format_string("%.0f", value)).when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    return F.when(n <= 0, F.lit("0 B")).otherwise(F.concat(text, F.lit(" "), name))


def _fixed(n: Column, unit: int, digits: int) -> Column:
    """The whole number n / unit with so many digits as C's printf writes it: exact ties go to the even one (Java's formats round them up)."""
    scaled, per = n.cast("long") * 10**digits, F.lit(unit).cast("long")
    rest = F.pmod(scaled, per)
    whole, twice = ((scaled - rest) / per).cast("long"), 2 * rest
    up = (twice > per) | ((twice == per) & (F.pmod(whole, F.lit(2)) == 1))
    return F.format_string(f"%.{digits}f", (whole + up.cast("long")) / 10**digits)


def usage_text(n: Column) -> Column:
    """Bytes of a cache in MB with 2 digits from 1 MB on; below that in KB, with 2, 1 or no digits as the number grows."""
    mb, kb = 1 << 20, 1 << 10
    small = F.when(n >= 100 * kb, _fixed(n, kb, 0)).when(n >= 10 * kb, _fixed(n, kb, 1)).otherwise(_fixed(n, kb, 2))
    return F.when(n >= mb, F.concat(_fixed(n, mb, 2), F.lit(" MB"))).otherwise(F.concat(small, F.lit(" KB")))


def inspector_number(v: Column) -> Column:
    """Four decimals; very small and very large values in exponential form, whose exponent has no leading zero."""
    v = F.coalesce(v.cast("double"), F.lit(0.0))
    plain = F.format_string("%.4f", v)
    exponent = F.regexp_replace(F.format_string("%.4e", v), r"e([+-])0(\d)$", "e$1$2")
    return F.when(F.isnan(v), F.lit("0.0000")).when(((F.abs(v) < 0.0001) & (v != 0)) | (F.abs(v) > 99999), exponent).otherwise(plain)


def snapped(v: Column, lo: float, step: float, digits: int) -> Column:
    """v on the grid lo + n * step; halves go up."""
    return F.round(lo + F.floor((v - lo) / step + 0.5) * step, digits)


def step_digits(step: float) -> int:
    """Decimal places of a step."""
    mantissa, _, exponent = repr(float(step)).lower().partition("e-")
    places = len(mantissa.partition(".")[2].rstrip("0"))
    return places + (int(exponent) if exponent else 0)


def percent_of(v: Column, lo: float, hi: float) -> Column:
    """Where a value stands between lo and hi, in percent; the ends hold what lies beyond."""
    if hi <= lo:
        return F.lit(0.0)
    return (F.least(F.greatest(v, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) * 100


def pointed(at: Column, left: Column, width: Column, lo: float, hi: float, step: float) -> Column:
    """The value under a place on a slider, on its grid of steps."""
    if hi <= lo:
        return F.lit(lo)
    share = F.least(F.greatest((at - left) / F.greatest(width, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return snapped(lo + share * (hi - lo), lo, step, step_digits(step))


def status_of(level: Column) -> Column:
    return F.when(level == "error", "error").when(level == "warn", "warn").otherwise("ok")


def padded(n: Column, width: Column) -> Column:
    """A number with leading zeros; never cut."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, F.lit("0")))
