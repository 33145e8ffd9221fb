"""Global order without a global sort: running sums and exact quantiles of whole tables.

A window without partitions, or a percentile without groups, puts a table in one task. Here values are grouped first
(in each task, then by value); approximate cuts split them into ``PARTS`` ranges; the sums of the ranges, PARTS rows,
are all that is ordered in one place, and rows are ordered inside their range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 128
_CUTS = [k / PARTS for k in range(1, PARTS)]


def _part(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def running(per: DataFrame, value: str, sums: dict[str, str]) -> DataFrame:
    """per, a row a value, with sums of columns over all rows from the largest value down to each: {out: column}."""
    cuts = per.agg(F.percentile_approx(value, _CUTS, 10_000).alias("__cuts"))  # one row of PARTS - 1 numbers
    rows = per.crossJoin(F.broadcast(cuts)).withColumn("__part", _part(F.col(value), F.col("__cuts"))).drop("__cuts")
    parts = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{o}") for o, c in sums.items()])
    above = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{o}").over(above), F.lit(0)).alias(f"__{o}") for o in sums])
    inside = Window.partitionBy("__part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(parts), "__part")
    return rows.withColumns({o: F.col(f"__{o}") + F.sum(c).over(inside) for o, c in sums.items()}).drop("__part", *[f"__{o}" for o in sums])


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: {out: (column, q)}, exact and interpolated between neighbours; NULL for a column without values."""
    columns = sorted({c for c, _ in wanted.values()})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    per = df.select(each.alias("x")).select("x.*").where("v is not null").groupBy("name", "v").agg(F.count("*").alias("c"))
    total = per.groupBy("name").agg(F.sum("c").alias("n"), F.percentile_approx("v", _CUTS, 10_000).alias("cuts"))  # a row a column
    rows = per.join(F.broadcast(total), "name").select("name", "v", "c", "n", _part(F.col("v"), F.col("cuts")).alias("part"))
    parts = rows.groupBy("name", "part").agg(F.sum("c").alias("s"), F.max("n").alias("n"))
    upto = F.sum("s").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto)  # PARTS rows a column
    asked = F.explode(F.array(*[F.struct(F.lit(o).alias("out"), F.lit(c).alias("of"), F.lit(float(q)).alias("q")) for o, (c, q) in wanted.items()]))
    parts = parts.select("*", asked.alias("a")).select("name", "part", (F.col("upto") - F.col("s")).alias("below"), "upto", "n", "a.*").where("of = name")
    at = (F.col("n") - 1) * F.col("q")
    low = F.floor(at)
    ranks = F.array(F.struct(low.alias("rank"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("rank"), (at - low).alias("w")))
    hits = parts.select("name", "part", "below", "upto", "out", F.explode(ranks).alias("r")).where("r.w > 0 and r.rank >= below and r.rank < upto")
    hits = hits.select("name", "part", "out", (F.col("r.rank") - F.col("below")).alias("rank"), F.col("r.w").alias("w"))
    inside = Window.partitionBy("name", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.join(F.broadcast(hits.select("name", "part").distinct()), ["name", "part"], "left_semi").withColumn("cum", F.sum("c").over(inside))
    met = near.join(F.broadcast(hits), ["name", "part"]).where("rank < cum and rank >= cum - c")  # two rows a quantile
    return met.agg(*[F.sum(F.when(F.col("out") == o, F.col("v") * F.col("w"))).alias(o) for o in wanted])
