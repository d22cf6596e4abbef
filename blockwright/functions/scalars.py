"""Scalar column functions: number and duration texts, rates, decibels, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row: a generator keeps the optimizer from copying their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def psnr_unit(mse: Column) -> Column:
    """Decibels of a mean square error on the 0..1 scale, 120 at most."""
    return -10 * F.log10(F.greatest(mse, F.lit(1e-12)))


def psnr_255(mse: Column) -> Column:
    """Decibels on the 0..255 scale; 120 where there is no error."""
    return F.when(mse <= 0, 120.0).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / mse))


def bits_per_pixel(n_bytes: Column, w: Column, h: Column) -> Column:
    return n_bytes * 8.0 / (w * h)


def rate_axis(bpp: Column, log2: bool = False) -> Column:
    return F.log2(F.greatest(bpp, F.lit(1e-9))) if log2 else bpp


def duration_seconds(text: Column) -> Column:
    """Seconds of '5ms', '12.3s' or '1h2m3.5s'; NaN where milliseconds or plain seconds can't be read."""
    t = F.trim(text)

    def part(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(t, pattern, 1).try_cast("double"), F.lit(0.0))

    def number(cut: int) -> Column:
        return F.coalesce(F.left(t, F.length(t) - cut).try_cast("double"), F.lit(float("nan")))

    mixed = part(r"(\d+)h") * 3600 + part(r"(\d+)m") * 60 + part(r"([\d\.]+)s")
    return F.when(t.endswith("ms"), number(2) / 1000).when(t.endswith("s") & ~t.contains("m") & ~t.contains("h"), number(1)).otherwise(mixed)


def duration_text(seconds: Column) -> Column:
    """XhYmZs of seconds rounded half to even; 'nan' for null and NaN."""
    n = F.rint(seconds).cast("long")
    m, s = F.floor((n % 3600) / 60), n % 60
    h = F.floor(n / 3600)
    text = F.when(h > 0, F.concat(h, F.lit("h"), m, F.lit("m"), s, F.lit("s"))).when(m > 0, F.concat(m, F.lit("m"), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))
    return F.when(seconds.isNull() | F.isnan(seconds), "nan").otherwise(text)


def five_numbers(text: Column) -> Column:
    """The five doubles of a list text such as '20 dB, 25.5, ...': NaN for what is missing or unreadable."""
    nan = F.lit(float("nan"))
    parts = F.transform(F.split(text, ","), lambda p: F.coalesce(F.trim(F.regexp_replace(F.trim(p), "dB$", "")).try_cast("double"), nan))
    return F.slice(F.concat(parts, F.array_repeat(nan, 5)), 1, 5)


def fixed_text(x: Column, decimals: int) -> Column:
    """x with so many decimals, rounded half to even on its exact value; 'nan' for null and NaN.

    The formatter of the JVM rounds shortest decimal texts half up. Here the product with 10**decimals and
    its rounding error, which splitting x in two halves gives exactly, decide.
    """
    unit, size = 10**decimals, F.abs(x.cast("double"))
    wide = size * 134217729.0
    high = wide - (wide - size)
    product = size * float(unit)
    error = (high * float(unit) - product) + (size - high) * float(unit)
    below = F.floor(product)
    half = product - below - 0.5
    up = (half > 0) | ((half == 0) & ((error > 0) | ((error == 0) & (below % 2 == 1))))
    digits = F.lpad((below + up.cast("long")).cast("string"), F.greatest(F.length((below + up.cast("long")).cast("string")), F.lit(decimals + 1)), F.lit("0"))
    text = F.concat(F.left(digits, F.length(digits) - decimals), F.lit("."), F.right(digits, F.lit(decimals))) if decimals else digits
    signed = F.concat(F.when(x < 0, "-").otherwise(""), F.when(size == float("inf"), "inf").when(product >= 2.0**53, F.format_string(f"%.{decimals}f", size)).otherwise(text))
    return F.when(x.isNull() | F.isnan(x), "nan").otherwise(signed)


def relative(value: Column, base: Column) -> Column:
    """(value - base) / |base|, 0 where base is 0."""
    return F.when(base == 0, 0.0).otherwise((value - base) / F.nullif(F.abs(base), F.lit(0.0)))


def row_class(value: Column, base: Column, blue_above: float | None = None, use_relative: bool = False) -> Column:
    """BLUE beyond a threshold, else GREEN above the base, else RED."""
    plain = F.when(value > base, "GREEN").otherwise("RED")
    if blue_above is None:
        return plain
    return F.when((relative(value, base) if use_relative else value) > blue_above, "BLUE").otherwise(plain)


def to_bool(text: Column) -> Column:
    return F.lower(text) == "true"


def five_number_summary(v: Column) -> Column:
    """min, quartiles and max with linear interpolation, zeros where there is no value."""
    return F.coalesce(F.percentile(v, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))), F.array_repeat(F.lit(0.0), 5))
