"""Profiles, cleaning, validation and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def profile(df: DataFrame, high: float = 0.3) -> DataFrame:
    """A row for each column: rows, missing (null or empty), missing_high, distinct (null is a value), duplicates; one pass."""
    cols = df.columns
    miss = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == ""))
    aggs = [F.struct(F.count("*").alias("rows"), miss(c).alias("missing"), (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("distinct_values")).alias(c) for c in cols]
    one = df.agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in cols])).alias("x"))
    return one.select("x.column", "x.s.*").withColumns({"missing_high": F.col("missing") > high * F.col("rows"), "duplicates": F.col("rows") - F.col("distinct_values")})


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the numeric columns, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null")


def positional(df: DataFrame, columns: list[str], at: dict[str, float], span: str = "n") -> DataFrame:
    """For each column the values at index floor(p * n) of its sorted values. Distinct values are counted first, so the ranking sorts values, not rows."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("k"))
    w = Window.partitionBy("column").orderBy("value")
    ranked = counts.withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), span: F.sum("k").over(Window.partitionBy("column"))})
    value = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col(span) * p), F.col("value")))
    return ranked.groupBy("column").agg(F.max(span).alias(span), *[value(p).alias(name) for name, p in at.items()])


def iqr_outliers(df: DataFrame, columns: list[str], least: int = 11) -> DataFrame:
    """column, n, q1, q3 and the number of values beyond 1.5 times the quartiles' distance; none below `least` values."""
    q = positional(df, columns, {"q1": 0.25, "q3": 0.75})
    met = long_form(df, columns).join(F.broadcast(q), "column")  # a row for each column
    r = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - 1.5 * r) | (F.col("value") > F.col("q3") + 1.5 * r)
    return met.groupBy("column", "n", "q1", "q3").agg(F.when(F.col("n") >= least, F.count_if(out)).otherwise(F.lit(0)).alias("outliers"))


def auto_clean(df: DataFrame, columns: list[str], required: list[str] | None = None) -> DataFrame:
    """Rows with a missing required value go; numeric columns are held between their 5th and 95th positional percentile."""
    for c in required or []:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    q = positional(df, columns, {"low": 0.05, "high": 0.95}).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("_q"))
    got = df.join(F.broadcast(q))  # one row
    hold = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col("_q")[c]["low"]), F.col("_q")[c]["high"])) for c in columns}
    return got.withColumns(hold).drop("_q")


def suggest(df: DataFrame, label: str | None = None) -> DataFrame:
    """column, suggestion: encode (few distinct texts), normalise (numbers), parse_date (texts like dates)."""
    kinds = dict(df.dtypes)
    prof = profile(df)
    texts = [c for c, t in kinds.items() if t == "string"]
    dates = df.agg(*[F.avg(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}").cast("double")).alias(c) for c in texts]) if texts else None
    out = prof.select("column", F.when(F.col("column").isin([c for c, t in kinds.items() if t in NUMERIC and c != label]), "normalise").when(F.col("column").isin(texts) & (F.col("distinct_values") < 0.5 * F.col("rows")), "encode").alias("suggestion"))
    if dates is not None:
        looks = dates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("p")) for c in texts])).alias("x")).select("x.*").where("p > 0.9").select("column", F.lit("parse_date").alias("suggestion"))
        out = out.join(looks.select("column"), "column", "left_anti").unionByName(looks)
    return out.where("suggestion is not null")


def prepare(df: DataFrame, columns: list[str], required: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile, cleaned rows and suggestions for them."""
    clean = auto_clean(df, columns, required)
    return profile(df), clean, suggest(clean)


def validate(df: DataFrame, schema: dict[str, str], required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, cast; and those that don't with `errors` (column, error_type, value)."""
    errors, cast = [], {}
    for c, kind in schema.items():
        raw = F.col(c) if c in df.columns else F.lit(None).cast("string")
        cast[c] = raw.try_cast(kind)
        said = lambda e, c=c, raw=raw: F.struct(F.lit(c).alias("column"), F.lit(e).alias("error_type"), raw.cast("string").alias("value"))
        if c in (required or []):
            errors.append(F.when(raw.isNull(), said("missing")))
        errors.append(F.when(raw.isNotNull() & cast[c].isNull(), said("type")))
    got = df.withColumn("errors", F.filter(F.array(*errors), lambda x: x.isNotNull()))
    return got.where(F.size("errors") == 0).select(*[v.alias(c) for c, v in cast.items()]), got.where(F.size("errors") > 0)


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Counts by column and kind of error."""
    return rejected.select(F.explode("errors").alias("e")).groupBy("e.column", "e.error_type").agg(F.count("*").alias("rows"))


def drift(old: T.StructType, new: T.StructType) -> list[tuple[str, str]]:
    """(column, added | removed | retyped)."""
    a, b = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    return sorted([(c, "added") for c in b.keys() - a.keys()] + [(c, "removed") for c in a.keys() - b.keys()] + [(c, "retyped") for c in a.keys() & b.keys() if a[c] != b[c]])


def encoding_profile(df: DataFrame, columns: list[str], order: Column | str, within: list[str]) -> DataFrame:
    """column, distinct and run ratios, and whether a dictionary (under half distinct) or run lengths (under half runs) would pay."""
    w = Window.partitionBy(*within).orderBy(order)
    runs = df.select(*[F.col(c) for c in columns], *[(~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1)).cast("long").alias(f"_{c}") for c in columns])
    one = runs.agg(*[F.struct(F.count("*").alias("rows"), F.countDistinct(c).alias("distinct_values"), F.sum(f"_{c}").alias("runs")).alias(c) for c in columns])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in columns])).alias("x")).select("x.column", "x.s.*")
    return out.withColumns({"dictionary": F.col("distinct_values") < 0.5 * F.col("rows"), "run_length": F.col("runs") < 0.5 * F.col("rows")})
