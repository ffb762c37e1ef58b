"""Map algebra over cells (raster_id, row, col, value); null is "no data".

Everything here is a projection or an equi-join on the cell, so Catalyst fuses and prunes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dtypes import RANGES, SENTINELS, division_dtype, result_dtype

KEY = ["raster_id", "row", "col"]


def with_value(cells: DataFrame, value: Column) -> DataFrame:
    return cells.withColumn("value", value)


def scalar(cells: DataFrame, op: str, k: float) -> DataFrame:
    """value op k; no data propagates and division by zero gives no data."""
    v = F.col("value")
    return with_value(cells, {"add": v + k, "sub": v - k, "mul": v * k, "div": F.try_divide(v, F.lit(k))}[op])


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two rasters side by side.  A cell that only one of them has fails the job: the sizes differ."""
    left = a.select(*KEY, F.col("value").alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*KEY, F.col("value").alias("__b"), F.lit(True).alias("__in_b"))
    alone = F.col("__in_a").isNull() | F.col("__in_b").isNull()
    where = F.concat_ws(", ", F.col("raster_id").cast("string"), F.col("row").cast("string"), F.col("col").cast("string"))
    failed = F.raise_error(F.concat(F.lit("the rasters do not have the same size, at cell "), where)).cast("double")
    joined = left.join(right, KEY, "full")
    return joined.select(*KEY, F.when(alone, failed).otherwise(F.col("__a")).alias("__a"), "__b")


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """(raster_id, same): whether both rasters have the same rows and columns, by their extents alone."""
    extent = lambda d: d.groupBy("raster_id").agg(F.struct(F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.count("*")).alias("e"))
    return extent(a).join(extent(b).withColumnRenamed("e", "f"), "raster_id", "full").select("raster_id", F.coalesce(F.to_json("e") == F.to_json("f"), F.lit(False)).alias("same"))


def binary(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Cell by cell: no data if either has none, and for division by zero."""
    x, y = F.col("__a"), F.col("__b")
    f = {"add": x + y, "sub": x - y, "mul": x * y, "div": F.try_divide(x, y)}[op]
    return _both(a, b).select(*KEY, f.alias("value"))


def wrapped(value: Column, dtype: str) -> Column:
    """A whole number as the integer type's arithmetic leaves it: modulo its width; the type's sentinel is no data."""
    if dtype[0] == "f":
        return value.cast("float").cast("double") if dtype == "f32" else value
    bits, lo = int(dtype[1:]), 0 if dtype[0] == "u" else -(2 ** (int(dtype[1:]) - 1))
    number = lambda k: F.lit(str(k)).cast("decimal(38,0)")
    whole = F.pmod(value.cast("decimal(38,0)") - number(lo), number(2**bits)) + number(lo)
    return F.nullif(whole, number(SENTINELS[dtype])).cast("double")


def clamped(value: Column, dtype: str) -> Column:
    """A whole number held within the integer type's range, as inclusive sums are."""
    lo, hi = RANGES.get(dtype, (None, None))
    return value if lo is None else F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi))))


def typed_binary(a: DataFrame, b: DataFrame, op: str, left: str, right: str) -> tuple[DataFrame, str]:
    """``binary`` of rasters of pixel types ``left`` and ``right``, in the type that they promote to, which is returned too."""
    dtype = division_dtype(left, right) if op == "div" else result_dtype(left, right)
    work = dtype if op != "div" or dtype != "f32" else "f32"
    out = binary(cast(a, work), cast(b, work), op)
    return with_value(out, wrapped(F.col("value"), dtype)), dtype


def typed_inclusive(a: DataFrame, b: DataFrame, op: str, left: str, right: str) -> tuple[DataFrame, str]:
    """``inclusive`` of typed rasters; integers stop at the ends of their range."""
    dtype = result_dtype(left, right)
    out = inclusive(cast(a, dtype), cast(b, dtype), op, signed=dtype[0] != "u")
    return with_value(out, clamped(F.col("value"), dtype)), dtype


def inclusive(a: DataFrame, b: DataFrame, op: str, *, signed: bool = True) -> DataFrame:
    """Sum or difference in which one-sided no data keeps the other operand (nodata - x is -x, if signed)."""
    x, y = F.col("__a"), F.col("__b")
    if op == "add":
        f = F.coalesce(x + y, x, y)
    else:
        f = F.coalesce(x - y, x, -y if signed else F.lit(None).cast("double"))
    return _both(a, b).select(*KEY, f.alias("value"))


def cast(cells: DataFrame, dtype: str) -> DataFrame:
    """Truncate to an integer type; what the type cannot hold (or keeps for no data) becomes no data."""
    v = F.col("value")
    if dtype in ("f32", "f64"):
        return with_value(cells, v.cast("float").cast("double") if dtype == "f32" else v)
    lo, hi = RANGES[dtype]
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")
    return with_value(cells, F.when((whole >= lo) & (whole <= hi), whole))


def replace_value(cells: DataFrame, search: float, new: float) -> DataFrame:
    return with_value(cells, F.when(F.col("value") == search, F.lit(float(new))).otherwise(F.col("value")))


def replace_nodata(cells: DataFrame, new: float) -> DataFrame:
    return with_value(cells, F.coalesce("value", F.lit(float(new))))


def value_to_nodata(cells: DataFrame, value: float) -> DataFrame:
    return with_value(cells, F.nullif(F.col("value"), F.lit(float(value))))


def is_nodata(cells: DataFrame) -> DataFrame:
    return with_value(cells, F.col("value").isNull().cast("int"))


def is_data(cells: DataFrame) -> DataFrame:
    return with_value(cells, F.col("value").isNotNull().cast("int"))


def filter_values(cells: DataFrame, values: list[float]) -> DataFrame:
    """Cells whose value is not listed become no data; the grid keeps its shape."""
    return with_value(cells, F.when(F.col("value").isin([float(v) for v in values]), F.col("value")))


def scale(cells: DataFrame, dtype: str = "u8", value_range: tuple[float, float] | None = None) -> DataFrame:
    """Integers 0..MAX-1 by offset and scale, which the columns ``scale`` and ``offset`` carry for ``descale``."""
    if "scale" in cells.columns:
        raise ValueError("the raster is scaled already")
    top = float(RANGES[dtype][1])
    if value_range is None:
        limits = cells.groupBy("raster_id").agg(F.min("value").alias("offset"), F.max("value").alias("__hi"))
        cells = cells.join(limits, "raster_id")  # a row for each raster; AQE broadcasts it when it is small
    else:
        cells = cells.withColumns({"offset": F.lit(float(value_range[0])), "__hi": F.lit(float(value_range[1]))})
    step = F.when(F.col("__hi") == F.col("offset"), F.lit(1.0)).otherwise((F.col("__hi") - F.col("offset")) / top)
    cells = cells.withColumn("scale", step).drop("__hi")
    scaled = F.round(F.greatest(F.lit(0.0), F.least(F.lit(top), (F.col("value") - F.col("offset")) / F.col("scale"))))
    return with_value(cells, F.when(F.col("value").isNotNull(), scaled))


def descale(cells: DataFrame) -> DataFrame:
    return with_value(cells, F.col("value") * F.col("scale") + F.col("offset")).drop("scale", "offset")


def window(cells: DataFrame, row0: int, col0: int, row1: int, col1: int) -> DataFrame:
    """Inclusive window; range predicates reach the scan."""
    return cells.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))


def crop(cells: DataFrame) -> DataFrame:
    """Trim margins without data; rows and columns start at 0."""
    box = cells.where("value is not null").groupBy("raster_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    inside = cells.join(box, "raster_id").where("row between r0 and r1 and col between c0 and c1")
    return inside.select("raster_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "value")


def full_grid(spark, rows: int, cols: int, raster_id: str = "r", value: float | None = None) -> DataFrame:
    """Every cell of a grid, generated in parallel."""
    k = F.col("id")
    return spark.range(rows * cols).select(
        F.lit(raster_id).alias("raster_id"), F.expr(f"cast(id div {cols} as int)").alias("row"), (k % cols).cast("int").alias("col"),
        F.lit(value).cast("double").alias("value"),
    )


def read_region(cells: DataFrame, row0: int, col0: int, rows: int, cols: int) -> DataFrame:
    """A target window whose cells outside the raster are no data; indices start at the window's corner."""
    spark = cells.sparkSession
    inside = window(cells, row0, col0, row0 + rows - 1, col0 + cols - 1).select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), "value")
    return full_grid(spark, rows, cols).drop("value").join(inside, ["row", "col"], "left").select(*KEY, "value")


def diff(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cells that differ: kind data or nodata."""
    x, y = F.col("__a"), F.col("__b")
    kind = F.when(x.isNull() != y.isNull(), "nodata").when(F.abs(x - y) > tolerance, "data")
    return _both(a, b).select(*KEY, x.alias("left"), y.alias("right"), kind.alias("kind")).where("kind is not null")


def diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = F.col("__a"), F.col("__b")
    return _both(a, b).groupBy("raster_id").agg(
        F.count_if(x.eqNullSafe(y)).alias("matches"), F.count_if(x.isNull() != y.isNull()).alias("nodata_mismatches"),
        F.count_if(x != y).alias("data_mismatches"),
    )


def mosaic(parts: list[DataFrame]) -> DataFrame:
    """Later rasters overwrite earlier ones where they have data."""
    tagged = [p.select(*KEY, "value", F.lit(k).alias("__o")) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(*KEY).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("__o"))).alias("value"))


def row_of(cells: DataFrame, row: int) -> DataFrame:
    """One row in the order of its columns."""
    return cells.where(F.col("row") == row).orderBy("raster_id", "col")


def set_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with the values of ``changes`` (raster_id, row, col, value), null being no data, put in their place."""
    new = changes.select(*KEY, F.struct("value").alias("__new"))
    return cells.join(new, KEY, "left").select(*KEY, F.when(F.col("__new").isNotNull(), F.col("__new.value")).otherwise(F.col("value")).alias("value"))


def near_equal(a: DataFrame, b: DataFrame, *, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """(raster_id, equal): whether all cells agree within either tolerance; no data only equals no data."""
    x, y = F.col("__a"), F.col("__b")
    close = F.abs(x - y) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(x), F.abs(y)))
    return _both(a, b).groupBy("raster_id").agg(F.bool_and(F.coalesce(close, x.isNull() & y.isNull())).alias("equal"))
