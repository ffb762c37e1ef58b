"""Colour legends as column expressions; colours are 0xRRGGBBAA as LONG."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from . import colours as colours_

EDGE = 1e-4
TRANSPARENT = 0


def rgba(text: str) -> int:
    """#rgb, #rgba, #rrggbb or #rrggbbaa."""
    t = text.lstrip("#")
    if len(t) in (3, 4):
        t = "".join(2 * c for c in t)
    if len(t) not in (6, 8):
        raise ValueError(f"not a colour: {text}")
    return int(t.ljust(8, "f"), 16)


def hex_of(colour: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(colour)), 8, "0"))


def preset(name: str, n: int = 256) -> list[int]:
    """A built-in map by name, in any case; ``_r`` behind the name reverses it."""
    return colours_.by_name(name, n)


def ramp(colours: list[int], n: int = 256, *, reverse: bool = False, fade_in: float = 0.0, fade_out: float = 1.0) -> list[int]:
    """``n`` colours, linear between evenly spaced ones, with alpha ramps over the first part and from ``fade_out`` on."""
    out = colours_.even(colours, n)
    return colours_.faded(out[::-1] if reverse else out, fade_in, fade_out)


def sampled(spark, legend, lo: float, hi: float, n: int = 256) -> DataFrame:
    """A legend's colours in order: ``n`` evenly spaced values (k, value, colour); ``legend`` maps a column to colours."""
    value = F.lit(float(lo)) + (F.lit(float(hi)) - F.lit(float(lo))) * (F.col("id") / (n - 1))
    return spark.range(n).select(F.col("id").cast("int").alias("k"), value.alias("value")).withColumn("colour", legend(F.col("value")))


def entries(spark, bands: list[tuple[float, float, int]]) -> DataFrame:
    """The bands of a legend as rows (start, end, colour)."""
    return spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in bands], "start double, end double, colour long")


def value_range(bands: list[tuple[float, float, int]]) -> tuple[float, float]:
    return min(a for a, _, _ in bands), max(b for _, b, _ in bands)


def _mappable(value: Column, zero_is_nodata: bool) -> Column:
    bad = value.isNull() | F.isnan(value)
    return ~(bad | (value == 0) if zero_is_nodata else bad)


def linear(value: Column, lo: float, hi: float, colours: list[int], *, nodata: int = TRANSPARENT, low: int | None = None, high: int | None = None, zero_is_nodata: bool = False) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo))) if hi > lo else F.lit(0.0)
    index = F.round(share * (len(colours) - 1)).cast("int")
    colour = F.element_at(F.array(*[F.lit(c).cast("long") for c in colours]), index + 1)
    colour = F.when(value < lo - EDGE, F.lit(nodata if low is None else low)).when(value > hi + EDGE, F.lit(nodata if high is None else high)).otherwise(colour)
    return F.when(_mappable(value, zero_is_nodata), colour).otherwise(F.lit(nodata)).cast("long")


def equal_bands(lo: float, hi: float, colours: list[int]) -> list[tuple[float, float, int]]:
    if lo > hi:
        raise ValueError("the range starts above its end")
    width = (hi - lo) / len(colours)
    return [(lo + k * width, lo + (k + 1) * width, c) for k, c in enumerate(colours)]


def banded(value: Column, bands: list[tuple[float, float, int]], *, nodata: int = TRANSPARENT, low: int | None = None, high: int | None = None, zero_is_nodata: bool = False) -> Column:
    """First half-open band that holds the value; gaps are no data; ends are tolerant."""
    if any(a >= b for a, b, _ in bands):
        raise ValueError("a band is empty")
    start, end = bands[0][0], bands[-1][1]
    f = F.when(value < start - EDGE, F.lit(nodata if low is None else low)).when(value > end + EDGE, F.lit(nodata if high is None else high))
    for a, b, c in bands:
        f = f.when((value >= a) & (value < b), F.lit(c))
    f = f.when(F.abs(value - start) <= EDGE, F.lit(bands[0][2])).when(F.abs(value - end) <= EDGE, F.lit(bands[-1][2]))
    return F.when(_mappable(value, zero_is_nodata), f.otherwise(F.lit(nodata))).otherwise(F.lit(nodata)).cast("long")


def categoric(value: Column, colours: dict[int, int], *, nodata: int = TRANSPARENT, zero_is_nodata: bool = False) -> Column:
    """The value cut to an integer, by exact match."""
    table = F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable((int(k), int(c)) for k, c in colours.items())]).cast("map<bigint,bigint>")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long")
    return F.when(_mappable(value, zero_is_nodata), F.coalesce(F.try_element_at(table, whole), F.lit(nodata))).otherwise(F.lit(nodata)).cast("long")


def categoric_text(value: Column, colours: dict[str, int], *, nodata: int = TRANSPARENT) -> Column:
    table = F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(colours.items())]).cast("map<string,bigint>")
    return F.coalesce(F.try_element_at(table, value), F.lit(nodata)).cast("long")


def classified(text: str) -> list[tuple[float, float, int]]:
    """Bands from "[lo;hi;rrggbb,lo;hi;rrggbb,...]"."""
    parts = [x.split(";") for x in text.strip("[] ").split(",") if x.strip()]
    return [(float(a), float(b), rgba(c)) for a, b, c in parts]


def grey(value: Column, lo: float, hi: float) -> Column:
    """0 to 255; flat rasters are 128 and no data 0."""
    level = F.lit(128) if hi == lo else F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo))) * 255)
    return F.when(_mappable(value, False), level).otherwise(F.lit(0)).cast("int")
