"""Feature cleaning. Each filter returns its features with `keep` and `reason`; both sides come from one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import percentiles, unsent, written

#: Values above this are detected.
DETECTED = 1e-9


def flagged(df: DataFrame, remove: Column, reason: str | Column) -> DataFrame:
    """df with keep and reason; a null condition keeps."""
    gone = F.coalesce(remove, F.lit(False))
    return df.withColumn("keep", ~gone).withColumn("reason", F.when(gone, F.lit(reason) if isinstance(reason, str) else reason))


def rsd(values: Column, ddof: int = 1) -> Column:
    """Standard deviation in percent of the mean; null for a mean of 0 or too few values."""
    return F.lit(100.0) * (F.stddev_samp(values) if ddof else F.stddev_pop(values)) / F.nullif(F.avg(values), F.lit(0.0))


def group_stats(cells: DataFrame, zero_is_missing: bool = False, ddof: int = 1, min_n: int = 1) -> DataFrame:
    """A1, A2: feature_id, grp, n, n_detected, mean, sd, rsd_pct, for each feature and group, in one shuffle.

    Null values are missing (zeros too, if so asked); a group of missing values only has a row with nulls. An empty table stays empty.
    """
    value = F.when(F.col("value") != 0, F.col("value")) if zero_is_missing else F.col("value")
    stats = cells.groupBy("feature_id", "grp").agg(
        F.count(value).alias("n"), F.count_if(F.col("value") > DETECTED).alias("n_detected"), F.avg(value).alias("mean"),
        (F.stddev_samp(value) if ddof else F.stddev_pop(value)).alias("sd"), rsd(value, ddof).alias("rsd_pct"),
    )
    return stats.withColumn("rsd_pct", F.when(F.col("n") >= min_n, F.col("rsd_pct")))


def feature_stats(cells: DataFrame) -> DataFrame:
    """A1: n, mean, min, max and median of each feature.

    Null values are missing; a feature has no more values than there are samples. An empty table stays empty.
    """
    return cells.groupBy("feature_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.median("value").alias("median"))


def contaminant_filter(features: DataFrame, contaminants: DataFrame, ppm: float = 5.0) -> DataFrame:
    """features within ppm of a contaminant's mass in the same polarity; the first in the list's order is the reason.

    contaminants: (target, name, polarity, position). Both sides are bucketed by mass, so that features meet the targets
    of their bucket and its neighbours only; the bucket is as wide as the largest target's tolerance. Features of one mass are looked
    up once, and of targets of one mass the first only.
    """
    contaminants = contaminants.groupBy("polarity", "target").agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"))
    width = contaminants.agg(F.max("target")).first()[0]
    width = max((width or 0.0) * ppm / 1e6, 1e-6)
    targets = contaminants.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("target") * (1 - ppm / 1e6) / width), F.floor(F.col("target") * (1 + ppm / 1e6) / width))))
    probe = features.select("polarity", "mz").distinct().withColumn("bucket", F.floor(F.col("mz") / width))
    near = probe.join(targets, ["polarity", "bucket"]).where(F.abs(F.col("mz") - F.col("target")) <= F.col("target") * (ppm / 1e6))
    hit = near.groupBy("polarity", "mz").agg(F.min_by("name", "position").alias("contaminant"))
    return flagged(features.join(hit, ["polarity", "mz"], "left").select(*features.columns, "contaminant"), F.col("contaminant").isNotNull(), F.concat(F.lit("Contaminant: "), "contaminant"))


def median_rsd(stats: DataFrame) -> DataFrame:
    """A3: the median RSD of each group over features: grp, median_rsd. stats: grp, rsd_pct; groups without an RSD have no row."""
    return percentiles(stats, "rsd_pct", {"median_rsd": 0.5}, "grp")


def flat_filter(cells: DataFrame, features: DataFrame, flat_rsd: float = 0.05, unstable_rsd: float = 1.2) -> DataFrame:
    """features that are flat at a low level, saturated, or unstable at a low level; standards are spared.

    Features without a value stay, as do all if none has one; a mean at a quantile counts as beyond it.
    """
    seen = cells.where(F.col("value") > DETECTED).groupBy("feature_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    seen = written(seen.withColumn("rsd", F.when(F.col("n") >= 3, F.col("sd") / F.col("mean"))), "seen")
    limits = percentiles(seen, "mean", {"q10": 0.1, "q99": 0.99})
    of = seen.join(F.broadcast(limits), F.lit(True), "left")  # limits is one row at most
    flat = F.col("rsd") < flat_rsd
    reason = (
        F.when(flat & (F.col("mean") <= F.col("q10")), "flat at a low level")
        .when((F.col("rsd") > unstable_rsd) & (F.col("mean") <= F.col("q10")), "unstable at a low level")
        .when(flat & (F.col("mean") >= F.col("q99")), "saturated")
    )
    found = of.where(reason.isNotNull()).select("feature_id", reason.alias("_why"))
    return flagged(features.join(unsent(found), "feature_id", "left"), F.col("_why").isNotNull() & ~F.coalesce("is_standard", F.lit(False)), F.col("_why")).drop("_why")


def repeated_mass_filter(features: DataFrame, low: float = 1e5, min_n: int = 3, spread: float = 2.0) -> DataFrame:
    """of three or more features of one rounded mass, all low and alike, the fullest and then highest stays.

    features: with mz, n_missing, mean. Features without a mass stay.
    """
    unknown, features = features.where("mz IS NULL"), features.where("mz IS NOT NULL")
    bucket = Window.partitionBy("bucket")
    best = bucket.orderBy("n_missing", F.col("mean").desc_nulls_last(), "feature_id")
    of = features.withColumn("bucket", F.round("mz", 2)).withColumn("rank", F.row_number().over(best)).withColumn("size", F.count("*").over(bucket))
    top, bottom = F.max("mean").over(bucket), F.min("mean").over(bucket)
    alike = (F.col("size") >= min_n) & (top < low) & (top / F.nullif(bottom, F.lit(0.0)) <= spread) & F.col("bucket").isNotNull()
    named = flagged(of.withColumn("alike", alike), F.col("alike") & (F.col("rank") > 1), "repeated low mass").drop("bucket", "rank", "size", "alike")
    return named.unionByName(flagged(unknown, F.lit(False), "repeated low mass"))


def qc_filter(stats: DataFrame, features: DataFrame, groups: DataFrame, limit: float = 75.0, stable: float = 30.0) -> DataFrame:
    """features with a QC RSD over the limit, unless some group is stable; standards are spared.

    stats: of group_stats; groups: (grp, size, is_qc). With under 3 QC samples nothing is removed. Adds qc_rsd, rescued and qc_samples, in the
    place of columns of that name; features without a row in stats stay.
    """
    of = stats.join(F.broadcast(groups), "grp")  # a row for each sample group
    judged = of.groupBy("feature_id").agg(
        F.max(F.when(F.col("is_qc") & (F.col("n_detected") >= 2), F.col("rsd_pct"))).alias("_qc_rsd"),
        F.coalesce(F.bool_or(~F.col("is_qc") & (F.col("size") >= 3) & (F.col("n_detected") >= 2) & (F.col("rsd_pct") < stable)), F.lit(False)).alias("_rescued"),
        F.max(F.when(F.col("is_qc"), F.col("size"))).alias("_qc_samples"),
    )
    remove = (F.col("_qc_rsd") > limit) & ~F.col("_rescued") & (F.col("_qc_samples") >= 3) & ~F.col("is_standard")
    own = [c for c in features.columns if c not in ("qc_rsd", "rescued", "qc_samples")]
    of = flagged(features.select(*own).join(unsent(judged), "feature_id", "left"), remove, "QC RSD")
    return of.withColumnsRenamed({f"_{c}": c for c in ("qc_rsd", "rescued", "qc_samples")})


def minimum_filter(features: DataFrame, lowest: float = 4000.0) -> DataFrame:
    """a mean below the lowest.

    A null mean stays, and a mean that is the lowest.
    """
    return flagged(features, F.col("mean") < lowest, "low mean")


def detection_filter(stats: DataFrame, features: DataFrame, groups: DataFrame, percent: float = 85.0) -> DataFrame:
    """features that no group detects in so many percent of its samples; standards are spared.

    groups: grp, size. A feature without a row in stats is detected by none; a rate that is the limit is enough.
    """
    rate = F.lit(100.0) * F.col("n_detected") / F.col("size")
    best = stats.join(F.broadcast(groups), "grp").groupBy("feature_id").agg(F.max(rate).alias("best_rate"))
    return flagged(features.join(unsent(best), "feature_id", "left"), (F.coalesce("best_rate", F.lit(0.0)) < percent) & ~F.col("is_standard"), "detection rate")


def standard_text(*columns: str) -> Column:
    """rows whose text names an internal standard.

    Null texts name none.
    """
    return F.exists(F.array(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns)), lambda x: x.contains("internal standard") | x.contains("avanti splash"))


def final_qc_filter(features: DataFrame, limit: float = 30.0) -> DataFrame:
    """a QC RSD over the limit, of features with three or more QC values.

    A null RSD stays, and one that is the limit.
    """
    return flagged(features, (F.col("qc_detected") >= 3) & (F.col("qc_rsd") > limit), "final QC RSD")


def final_group_filter(stats: DataFrame, features: DataFrame, limit: float = 50.0) -> DataFrame:
    """features with group RSDs, all of which are over the limit; QC aside.

    Features whose RSDs are all null stay.
    """
    of = stats.where("grp != 'QC'").groupBy("feature_id").agg(F.min("rsd_pct").alias("lowest_rsd"), F.max("rsd_pct").alias("highest_rsd"))
    return flagged(features.join(unsent(of), "feature_id", "left"), F.col("lowest_rsd") > limit, "final group RSD")


def report_filter(features: DataFrame, limit: float = 30.0) -> DataFrame:
    """standards, blank annotations, and an RSD of the limit or more before normalization.

    A null RSD stays.
    """
    blank = F.trim(F.coalesce("annotation", F.lit(""))) == ""
    reason = F.when(F.col("is_standard"), "internal standard").when(blank, "no annotation").when(F.col("qc_rsd") >= limit, "RSD before normalization")
    return flagged(features, reason.isNotNull(), reason)


def extreme_filter(cells: DataFrame, limit: float = 4.0) -> DataFrame:
    """features with a value over so many standard deviations from their mean: (feature_id, highest_z, keep, reason).

    Null values are missing; features without spread stay; a feature's rows are as many as its samples. An empty table stays empty.
    """
    of = Window.partitionBy("feature_id")
    z = (F.col("value") - F.avg("value").over(of)) / F.nullif(F.stddev_pop("value").over(of), F.lit(0.0))
    return flagged(cells.select("feature_id", F.abs(z).alias("z")).groupBy("feature_id").agg(F.max("z").alias("highest_z")), F.col("highest_z") > limit, "extreme value")


def reliable_standards(cells: DataFrame, n_samples: int, lowest: float = 5000.0, qc: float = 35.0, sample: float = 120.0) -> DataFrame:
    """the standards of the strictest rule that any passes: complete and stable, then stable, then all.

    For each polarity; null and low values are missing. Without standards there is no row.
    """
    of = cells.groupBy("polarity", "feature_id").agg(
        F.count_if(F.col("value") >= lowest).alias("high"),
        rsd(F.when(F.col("is_qc"), F.col("value"))).alias("qc_rsd"), rsd(F.when(~F.col("is_qc"), F.col("value"))).alias("sample_rsd"),
    )
    stable = F.coalesce((F.col("qc_rsd") < qc) & (F.col("sample_rsd") < sample), F.lit(False))
    tier = F.when(stable & (F.col("high") == n_samples), 1).when(stable, 2).otherwise(3)
    ranked = of.withColumn("tier", tier).withColumn("strictest", F.min("tier").over(Window.partitionBy("polarity")))
    return ranked.where("tier = strictest").select("polarity", "feature_id", "tier", "qc_rsd", "sample_rsd")


def sample_outliers(totals: DataFrame, fence: float = 1.5) -> DataFrame:
    """samples of groups of four or more whose total is beyond Tukey's fences. totals: (sample_id, grp, total).

    A total on a fence is inside; null totals have a null flag. An empty table stays empty.
    """
    q = totals.groupBy("grp").agg(F.count("*").alias("size"), F.percentile("total", F.lit(0.25)).alias("q1"), F.percentile("total", F.lit(0.75)).alias("q3"))
    reach = fence * (F.col("q3") - F.col("q1"))
    out = (F.col("size") >= 4) & ~F.col("total").between(F.col("q1") - reach, F.col("q3") + reach)
    return totals.join(F.broadcast(q), "grp").select("sample_id", "grp", "total", out.alias("is_outlier"))


def funnel(flags: DataFrame, steps: Sequence[str]) -> DataFrame:
    """how many features are left after each step. flags: a boolean column for each step; each feature counts up to the first that fails."""
    failed = F.coalesce(*(F.when(~F.col(s), F.lit(k)) for k, s in enumerate(steps)), F.lit(len(steps)))
    counted = flags.select(failed.alias("failed")).agg(*(F.count_if(F.col("failed") > k).alias(s) for k, s in enumerate(steps)))
    return counted.unpivot([], list(steps), "step", "remaining")


def restore_missing(final: DataFrame, before: DataFrame) -> DataFrame:
    """final values, null where the cell was missing before imputation. Both: (feature_id, sample_id, value).

    Cells that `before` lacks were missing; a cell that it has twice is returned twice. An empty table stays empty.
    """
    known = before.where(F.col("value").isNotNull()).select("feature_id", "sample_id", F.lit(True).alias("known"))
    return final.join(known, ["feature_id", "sample_id"], "left").select("feature_id", "sample_id", F.when(F.col("known"), F.col("value")).alias("value"))
