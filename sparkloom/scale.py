"""Work that no task can hold: tables that end a lineage, ranks and exact percentiles of long columns, components of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is sent to all tasks, at most.
SENT = 200_000


def sent(df: DataFrame, name: str) -> DataFrame:
    """df, written, to be sent to all tasks if it has no more than SENT rows; a larger one is joined as Spark sees fit."""
    of = written(df, name)
    return F.broadcast(of) if of.count() <= SENT else of


def unsent(df: DataFrame) -> DataFrame:
    """df, as a side of a join that neither side of is sent to all tasks. Spark's own check goes by the size of files, of
    which a few MB may be hundreds in the driver's memory."""
    return df.hint("merge")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of the order's columns, written, with the range's number as _part; equal keys are in one range."""
    return written(df.repartitionByRange(*map(F.col, order)).withColumn("_part", F.spark_partition_id()), "ranged")


def running_sum(df: DataFrame, amount: str, order: list[str], by: list[str] | None = None, out: str = "before") -> DataFrame:
    """df with the sum of `amount` over the rows of the same `by` that come before in the order, as `out`; nulls sort first.

    Rows are ranged by (by, order), so no task holds a family: each range adds up its own rows, from where the ranges
    before it end. Keys (by, order) have to be distinct: add up repeated ones beforehand. A null `by` is a family like any other.
    """
    by = by or []
    part, size = own_name(df, "part"), own_name(df, "size")
    of = written(df.repartitionByRange(*(F.col(f"`{c}`") for c in (*by, *order))).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = of.groupBy(*by, part).agg(F.sum(amount).alias(size))
    family = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = sizes.select(*(F.col(c).alias(f"{c}{part}") for c in by), F.col(part).alias(f"{part}{part}"), F.coalesce(F.sum(size).over(family), F.lit(0)).alias(size))  # a row for each range and family
    same = [F.col(c).eqNullSafe(F.col(f"{c}{part}")) for c in by] + [F.col(part) == F.col(f"{part}{part}")]
    here = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return of.join(ends, _all(same)).withColumn(out, F.coalesce(F.sum(amount).over(here), F.lit(0)) + F.col(size)).select(*df.columns, out)


def least_from_above(df: DataFrame, value: str, order: str, *by: str, out: str) -> DataFrame:
    """df with the least `value` of the rows of the same `by` from this one on upwards in the order. Keys (by, order) are distinct."""
    part = own_name(df, "part")
    of = written(df.repartitionByRange(*(F.col(f"`{c}`") for c in (*by, order))).withColumn(part, F.spark_partition_id()), "ranges")
    family = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(1, Window.unboundedFollowing)
    later = of.groupBy(*by, part).agg(F.min(value).alias("low")).select(*(F.col(c).alias(f"{c}{part}") for c in by), F.col(part).alias(f"{part}{part}"), F.min("low").over(family).alias(f"{part}low"))  # a row for each range and family
    same = [F.col(c).eqNullSafe(F.col(f"{c}{part}")) for c in by] + [F.col(part) == F.col(f"{part}{part}")]
    here = Window.partitionBy(*by, part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return of.join(later, _all(same)).withColumn(out, F.least(F.min(value).over(here), F.col(f"{part}low"))).select(*df.columns, out)


def own_name(df: DataFrame, name: str) -> str:
    """A column's name that df doesn't have."""
    name = f"_{name}"
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def same_family(left: DataFrame, right: DataFrame, *by: str) -> Column:
    """Whether the rows are of one family; a null is equal to a null."""
    return _all([left[f"`{c}`"].eqNullSafe(right[f"`{c}`"]) for c in by])


#: Values of a family that a task may hold: sorted in a window, or as an array.
FAMILY = 500_000


def value_ranks(df: DataFrame, value: str, *by: str, rows: int | None = None) -> DataFrame:
    """by, value, ties, rank, n: the distinct values of each family with how many rows have them, the rank that these share (the
    highest) and the family's size. Null values have no rank.

    Equal values are one row before anything is sorted, so that a family of a million equal ones is as light as one of a single
    row. Families of more distinct values than FAMILY are ranked in ranges. rows: what df has, if it is known.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if (df.count() if rows is None else rows) <= FAMILY:
        up = family.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return distinct.select(*by, value, "ties", F.sum("ties").over(up).alias("rank"), F.sum("ties").over(family).alias("n"))
    before = running_sum(distinct, "ties", [value], list(by), out="rank").withColumn("rank", F.col("rank") + F.col("ties"))
    before = written(before, "ranks")
    sizes = before.groupBy(*(F.col(c).alias(f"{c} of") for c in by)).agg(F.max("rank").alias("n"))
    return before.join(sizes, _all([F.col(f"`{c}`").eqNullSafe(F.col(f"`{c} of`")) for c in by])).select(*(f"`{c}`" for c in by), value, "ties", "rank", "n")


#: Families that are narrowed down, at most: their searches are sent to all tasks.
_SEARCHED = 20_000


def largest_family(df: DataFrame, *by: str) -> int:
    """The rows of the largest family."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def percentiles(df: DataFrame, value: str | Column, shares: dict[str, float], *by: str, largest: int | None = None) -> DataFrame:
    """by, and a column for each name of shares: the exact percentile, linear between neighbours; families without values have no row.

    largest: the most rows that a family has, if it is known; else they are counted. Up to FAMILY rows a family's values are
    one aggregate. Larger families are narrowed down: a pass counts the values in ranges, and the next looks at the range only that
    holds the place. Nothing is sorted; what is written is the values, once, where they are read more often, and the searches, of
    which there are two for each large family and share.
    """
    of = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("value")).where("value IS NOT NULL")
    if largest is None or largest > FAMILY:
        of = written(of, "values")  # every pass reads them, and what makes them may be long
    if (largest_family(of, *by) if largest is None else largest) <= FAMILY:
        return _at_once(of, shares, *by)
    sizes = written(of.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")), "sizes")
    limit = max(FAMILY, (sizes.agg(F.sum("n")).first()[0] or 0) // _SEARCHED)
    large = sizes.where(F.col("n") > limit)
    if not by:
        return _narrowed(of, large, shares) if large.head(1) else _at_once(of, shares)
    names = F.broadcast(large.select(*by))  # _SEARCHED rows at most
    return _at_once(of.join(names, same_family(of, names, *by), "left_anti"), shares, *by).unionByName(_narrowed(of.join(names, same_family(of, names, *by), "left_semi"), large, shares, *by))


def _at_once(of: DataFrame, shares: dict[str, float], *by: str) -> DataFrame:
    every = of.groupBy(*by).agg(F.percentile("value", F.array(*(F.lit(float(q)) for q in shares.values()))).alias("found"))
    every = every.where("found IS NOT NULL")
    return every.select(*by, *(F.get("found", F.lit(k)).alias(n) for k, n in enumerate(shares)))


#: Ranges that a pass divides the values into.
_RANGES = 4_096


def _narrowed(of: DataFrame, sizes: DataFrame, shares: dict[str, float], *by: str) -> DataFrame:
    """percentiles of families of any size. of: by, value; sizes: by, n, lo, hi of those that are looked at.

    For each family and share two places are looked for, that below and that above. A search is a row: by, name, side, the place
    among the values from lo to hi, and part (how far between both places). Each pass divides lo to hi into _RANGES equal ranges, which
    is in the order of the values, and goes on with the least and the largest value of the range that holds the place; so it
    ends when both are the same.
    """
    names = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.lit(side).alias("side")) for name, q in shares.items() for side in (0, 1)))
    place = (F.col("n") - 1) * F.col("s.q")
    open_ = sizes.withColumn("s", F.explode(names)).select(
        *by, "s.name", "s.side", F.least(F.floor(place) + F.col("s.side"), F.col("n") - 1).alias("place"), (place - F.floor(place)).alias("part"), "lo", "hi")
    open_, done = written(open_, "places"), None
    while True:
        found = open_.where("lo = hi")
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("lo < hi")
        if not open_.head(1):
            break
        # Searches in the same range are one; there are two for each share and family at most.
        areas = open_.select(*(F.col(c).alias(f"{c} of") for c in by), F.col("lo").alias("from"), F.col("hi").alias("to")).distinct()
        same = _all([F.col(f"`{c}`").eqNullSafe(F.col(f"`{c} of`")) for c in by])
        mine = of.join(F.broadcast(areas), same & F.col("value").between(F.col("from"), F.col("to")))  # two rows at most for each of _SEARCHED families and share
        step = (F.col("to") / 2 - F.col("from") / 2) / _RANGES  # of halves, so that nothing overflows
        at = F.when(step > 0, F.least(F.lit(_RANGES - 1.0), F.floor((F.col("value") / 2 - F.col("from") / 2) / step).cast("double"))).otherwise((F.col("value") > F.col("from")).cast("double"))
        family = [f"`{c} of`" for c in by]
        counts = mine.select(*family, "from", "to", "value", at.cast("int").alias("at"))
        counts = counts.groupBy(*family, "from", "to", "at").agg(F.count("*").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
        up = Window.partitionBy(*family, "from", "to").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("end", F.sum("size").over(up)).withColumn("start", F.col("end") - F.col("size"))  # _RANGES rows at most
        here = open_.join(counts, same & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to")) & (F.col("place") < F.col("end")) & (F.col("place") >= F.col("start")))
        open_ = written(here.select(*by, "name", "side", (F.col("place") - F.col("start")).alias("place"), "part", F.col("low").alias("lo"), F.col("high").alias("hi")), "places")
    value = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("lo")))
    both = done.groupBy(*by).agg(*(x for name in shares for x in (value(name, 0).alias(f"{name}_0"), value(name, 1).alias(f"{name}_1"), F.max(F.when(F.col("name") == name, F.col("part"))).alias(f"{name}_part"))))
    return both.select(*by, *((F.col(f"{n}_0") + F.col(f"{n}_part") * (F.col(f"{n}_1") - F.col(f"{n}_0"))).alias(n) for n in shares))


def linked_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, label): the smallest node that each node is linked with, over any number of links.

    Labels spread to neighbours and jump to their label's label; each round is written, until one changes nothing.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("then"))
        new = written(spread.join(jump, "to").select("node", F.least("to", "then").alias("label"), (F.least("to", "then") < F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").head(1):
            return labels
