"""Parsing of tabular text: booleans in four languages, dates, ranges, and types of columns."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

#: Words that mean true and false, and accepted date forms in order.
TRUE_WORDS = ("true", "yes", "ja", "oui", "1")
FALSE_WORDS = ("false", "no", "nee", "non", "0")
DATE_FORMS = ("yyyy-M-d H:m:s", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'")


def parse_bool(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_date(text: Column) -> Column:
    """The first form that fits; a weekday before a month by name must be the date's own."""
    bare = F.trim(F.regexp_replace(text, '^"+|"+$', ""))
    day = F.regexp_extract(bare, r"^(\w+day), [A-Z]", 1)
    found = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(bare, r"^\w+day, (?=[A-Z])", ""), F.lit(f)) for f in DATE_FORMS])
    return F.when((day == "") | (F.date_format(found, "EEEE") == day), found).cast("timestamp_ntz")


def date_of_millis(millis: Column) -> Column:
    """Milliseconds since 1970 as a date and time without zone, exact whatever the session's zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.lit(timedelta(milliseconds=1)) * millis.cast("long")


def parse_int_range(text: Column) -> Column:
    """"a-b" as struct(start, end)."""
    a, b = (F.regexp_extract(text, r"^\s*(-?\d+)\s*-\s*(-?\d+)\s*$", k).try_cast("int") for k in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


def blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def kind_of(text: Column) -> Column:
    """The first kind that a cell can be: bool, int, float, date or string."""
    t = blank(text)
    return (
        F.when(t.isNull(), F.lit(None).cast("string")).when(parse_bool(t).isNotNull(), "bool").when(t.try_cast("long").isNotNull() & t.rlike(r"^[+-]?\d+$"), "int")
        .when(t.try_cast("double").isNotNull(), "float").when(parse_date(t).isNotNull(), "date").otherwise("string")
    )


def infer_types(rows: DataFrame, sample: int = 10) -> DataFrame:
    """(column, type) by the ``sample`` first rows in the order of their cells: string over date over float over int over bool."""
    few = rows.orderBy(*rows.columns).limit(sample)
    cells = few.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in rows.columns])).alias("s")).select("s.*")
    kinds = cells.select("column", kind_of(F.col("cell")).alias("kind"))
    has = lambda k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False))
    kind = F.when(has("string"), "string").when(has("date"), "date").when(has("float"), "float").when(has("int"), "int").when(has("bool"), "bool").otherwise("string")
    return kinds.groupBy("column").agg(kind.alias("type"))


def coerce(text: Column, kind: str) -> Column:
    """A cell as the column's type; what does not fit is null."""
    t = blank(text)
    return {"string": t, "bool": parse_bool(t), "int": t.try_cast("long"), "float": t.try_cast("double"), "date": parse_date(t), "range": parse_int_range(t)}[kind]


def coerce_from(value: Column, source: str, kind: str) -> Column:
    """A field of type string, int, float or bool as another type; numbers are dates in milliseconds, non-zero is true."""
    if source == "string":
        return coerce(value, kind)
    if kind == "date":
        return date_of_millis(value.cast("long"))
    if kind == "bool":
        return value.cast("boolean") if source == "bool" else value != 0
    if kind == "string" and source == "float":  # as short as it reads back, whole numbers without a point
        return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(value.cast("string"))
    return value.try_cast({"string": "string", "int": "long", "float": "double"}[kind])


def cast_all(rows: DataFrame, dtype: str, *columns: str) -> DataFrame:
    """Numeric columns, or arrays of numbers, in another type; what it cannot hold is null."""
    kinds = dict(rows.dtypes)
    one = lambda c: F.transform(c, lambda x: x.try_cast(dtype)) if kinds[c].startswith("array") else F.col(c).try_cast(dtype)
    return rows.withColumns({c: one(c) for c in columns})


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """The chosen columns, typed, and ``_errors``: the columns whose text did not fit."""
    errors = [F.when(blank(F.col(c)).isNotNull() & coerce(F.col(c), k).isNull(), F.lit(c)) for c, k in types.items()]
    return rows.select(*[coerce(F.col(c), k).alias(c) for c, k in types.items()], F.array_compact(F.array(*errors)).alias("_errors"))


def sanitised(name: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_")
