"""Totals, shares, ratios and detection over classes, chains and groups.

Cells are (feature_id, sample_id, value, grp, lipid_class, carbons, dbe, ...), one row for each value that is present.
Sums go over (sample, label) first, which is small, and everything else is computed from them.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import largest_family, percentiles, sent, written
from .group_tests import group_moments, welch

# Class ratios and product/substrate ratios as (numerator, denominator).
CLASS_RATIOS = (
    ("FA", "TG"), ("MG", "TG"), ("DG", "TG"), ("DG", "PC"), ("DG", "PE"), ("DG", "PA"), ("CL", "PG"), ("PE", "PG"), ("PE", "PS"), ("PE", "PA"),
    ("PG", "PA"), ("PS", "PA"), ("SM", "Cer"), ("CE", "ST"),
)
PRODUCT_RATIOS = (
    ("PC", "PE"), ("PE", "PS, PS-NAc"), ("PS", "PA"), ("PE", "PA"), ("PG", "PA"), ("CL", "PG"), ("MLCL", "CL"), ("DLCL", "CL"), ("DG", "PA"),
    ("TG", "DG"), ("PE", "PG"), ("LPE", "PE"), ("LPC", "PC"), ("LPG", "PG"), ("LPA", "PA"), ("PEth", "PC"), ("PEth", "PG"), ("PEth", "CL"),
)
EPSILON = 1e-9
# Categories of classes.
CATEGORIES = {"FA": "FA", "TG": "GL", "DG": "GL", "MG": "GL", "PC": "GP", "PE": "GP", "CL": "GP", "PG": "GP", "PS": "GP", "PI": "GP", "PA": "GP", "SM": "SL", "Cer": "SL", "HexCer": "SL", "CE": "ST", "ST": "ST"}


def mapped(key: Column, values: dict[str, str], otherwise: Column | str) -> Column:
    """A small map, as a literal of the query; with `otherwise` for other keys and nulls."""
    table = F.create_map(*(F.lit(x) for x in chain(*values.items())))
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def sample_totals(cells: DataFrame) -> DataFrame:
    """A4: sample_id, grp, total.

    Null values are missing; the total of missing values only is null. An empty table stays empty.
    """
    return cells.groupBy("sample_id", "grp").agg(F.sum("value").alias("total"))


def group_totals(cells: DataFrame) -> DataFrame:
    """A5: for each group of samples: n, mean, sd, stderr and RSD of the samples' totals.

    With one sample a group's deviations are null. An empty table stays empty.
    """
    sd = F.stddev_samp("total")
    return sample_totals(cells).groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("total").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("*"))).alias("stderr"), (100 * sd / F.avg("total")).alias("rsd_pct"))


def group_changes(cells: DataFrame, with_p: bool = True) -> DataFrame:
    """A5: fold change and log2 of the groups' mean totals, with Welch's t, df and p, for both directions of each pair.

    With under two samples on a side t, df and p are null. One group has no row.
    """
    of = sample_totals(cells).select(F.lit(0).alias("_all"), "grp", F.col("total").alias("value"))
    one = welch(group_moments(of, "_all"), "_all", with_p=with_p)
    p = ["p"] * with_p
    there = one.select("grp1", "grp2", "mean1", "mean2", "t", "df", *p)
    back = one.select(F.col("grp2").alias("grp1"), F.col("grp1").alias("grp2"), F.col("mean2").alias("mean1"), F.col("mean1").alias("mean2"), (-F.col("t")).alias("t"), "df", *p)
    ratio = F.col("mean1") / F.nullif("mean2", F.lit(0.0))
    return there.unionByName(back).select("grp1", "grp2", ratio.alias("fold_change"), F.log2(ratio).alias("log2fc"), "t", "df", *p)


def annotation_counts(features: DataFrame, *by: str) -> DataFrame:
    """Counts of each combination and all margins; a margin's label is `all`.

    A null label is a label of its own. An empty table has the margin of 0 features.
    """
    counts = features.cube(*by).agg(F.count("*").alias("n"), *(F.grouping(b).alias(f"_{b}") for b in by))
    return counts.select(*(F.when(F.col(f"_{b}") == 1, "all").otherwise(F.col(b)).alias(b) for b in by), "n")


def removal_counts(flags: DataFrame, least: int = 5, top: int = 12) -> DataFrame:
    """Kept and removed for each headgroup and adduct with `least` features or more, the `top` largest."""
    of = flags.groupBy("lipid_class", "adduct").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("removed"))
    return of.where(F.col("kept") + F.col("removed") >= least).orderBy((F.col("kept") + F.col("removed")).desc(), "lipid_class", "adduct").limit(top)


def reason_counts(ledger: DataFrame) -> DataFrame:
    """Features removed for each step and reason.

    A feature that a step has twice for one reason counts once; an empty ledger has no row.
    """
    return ledger.groupBy("step", "reason").agg(F.count_distinct("feature_id").alias("removed"))


def species_per_class(features: DataFrame) -> DataFrame:
    """A8.

    How many distinct annotations each class has; null annotations don't count, and a null class is a class.
    """
    return features.groupBy("lipid_class").agg(F.count_distinct("annotation").alias("species"))


def class_totals(cells: DataFrame, label: str = "lipid_class") -> DataFrame:
    """For each label and group, mean, median and sd of the samples' totals, mean and sd of percents of the sample, and the
    median's percent of the group's medians."""
    of = cells.groupBy("sample_id", "grp", label).agg(F.sum("value").alias("total"))
    of = of.withColumn("percent", 100 * F.col("total") / F.sum("total").over(Window.partitionBy("sample_id")))
    out = of.groupBy(label, "grp").agg(
        F.avg("total").alias("mean"), F.median("total").alias("median"), F.stddev_samp("total").alias("sd"), F.avg("percent").alias("mean_percent"), F.stddev_samp("percent").alias("sd_percent"))
    return out.withColumn("median_percent", 100 * F.col("median") / F.nullif(F.sum("median").over(Window.partitionBy("grp")), F.lit(0.0)))


def enrichment(cells: DataFrame, label: str) -> DataFrame:
    """A10: each label's mean share of a sample for each group, and log2 of it over the mean of the groups' shares.

    The total of missing values only stays null, as does a share of it; a share of 0 has no log2. An empty table stays empty.
    """
    of = cells.groupBy("sample_id", "grp", label).agg(F.sum("value").alias("total"))
    share = of.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy("sample_id")))
    by_group = share.groupBy("grp", label).agg(F.avg("share").alias("share"))
    return by_group.withColumn("log2_enrichment", F.log2(F.col("share") / F.avg("share").over(Window.partitionBy(label))))


def saturation(cells: DataFrame, by: str = "grp") -> DataFrame:
    """Double bonds for each carbon, weighted with the group's mean abundance, for each class and group; or each class and sample.

    Features without abundance or carbons are left out, and so are classes of such only.
    """
    of = cells.groupBy("feature_id", by, "lipid_class", "carbons", "dbe").agg(F.avg("value").alias("w")).where("w > 0 AND carbons > 0")
    return of.groupBy("lipid_class", by).agg((F.sum(F.col("w") * F.col("dbe") / F.col("carbons")) / F.sum("w")).alias("saturation_index"))


def bin_composition(cells: DataFrame, field: str = "carbons") -> DataFrame:
    """Mean over samples of the totals for each class, group and number of carbons (or double bonds).

    Samples without a cell of the number don't count in its mean; a null number is one of its own.
    """
    of = cells.groupBy("sample_id", "grp", "lipid_class", field).agg(F.sum("value").alias("total"))
    return of.groupBy("lipid_class", "grp", field).agg(F.avg("total").alias("mean"))


def weighted_line(x: Column, y: Column, w: Column) -> tuple[Column, Column, Column]:
    """Aggregates for a weighted regression of y on x: slope, intercept, r2."""
    s = {k: F.sum(v) for k, v in {"w": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y}.items()}
    sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / s["w"], s["xy"] - s["x"] * s["y"] / s["w"], s["yy"] - s["y"] * s["y"] / s["w"]
    slope = sxy / F.when(sxx > 1e-9, sxx)
    return slope, (s["y"] - slope * s["x"]) / s["w"], sxy * sxy / (F.when(sxx > 1e-9, sxx) * F.when(syy > 1e-9, syy))


def class_trends(cells: DataFrame) -> DataFrame:
    """For each class and group the weighted mean carbons, double bonds and double bonds for each carbon, the shift of the first
    against the groups' mean, and slope, intercept, r2 and n of three regressions of abundance: on carbons and on double
    bonds (of bins, weighted with their features), and on double bonds for each carbon (of features, weighted with abundance).
    """
    of = cells.groupBy("feature_id", "grp", "lipid_class", "carbons", "dbe").agg(F.avg("value").alias("a"))
    of = of.withColumn("ratio", F.col("dbe") / F.nullif("carbons", F.lit(0)))
    mean = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("a") * F.col(c))) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("a"))), F.lit(0.0))
    slope, intercept, r2 = weighted_line(F.col("ratio"), F.col("a"), F.greatest(F.lit(0.0), F.col("a")))
    out = of.groupBy("lipid_class", "grp").agg(mean("carbons").alias("mean_carbons"), mean("dbe").alias("mean_dbe"), mean("ratio").alias("mean_ratio"), F.count("ratio").alias("ratio_n"))
    ratios = of.where("ratio IS NOT NULL").groupBy("lipid_class", "grp").agg(slope.alias("ratio_slope"), intercept.alias("ratio_intercept"), r2.alias("ratio_r2"))
    out = out.join(ratios, ["lipid_class", "grp"], "left")
    for field in ("carbons", "dbe"):
        bins = of.where(F.col(field).isNotNull()).groupBy("lipid_class", "grp", field).agg(F.sum("a").alias("y"), F.count("*").alias("w"))
        slope, intercept, r2 = weighted_line(F.col(field).cast("double"), F.col("y"), F.col("w").cast("double"))
        line = bins.groupBy("lipid_class", "grp").agg(slope.alias(f"{field}_slope"), intercept.alias(f"{field}_intercept"), r2.alias(f"{field}_r2"), F.count("*").alias(f"{field}_n"))
        out = out.join(line, ["lipid_class", "grp"], "left")
    return out.withColumn("carbons_shift", F.col("mean_carbons") - F.avg("mean_carbons").over(Window.partitionBy("lipid_class")))


def surface(cells: DataFrame) -> DataFrame:
    """A14.

    The mean value for each class, group, carbons and double bonds; null values are missing, and null numbers one of their own.
    """
    return cells.groupBy("lipid_class", "grp", "carbons", "dbe").agg(F.avg("value").alias("mean"))


def bin_matrix(cells: DataFrame, bin_of: Column, least: int = 3) -> DataFrame:
    """The total for each sample and carbon bin, of bins with three features or more.

    Samples without a cell of a bin have no row.
    """
    of = cells.withColumn("carbon_bin", bin_of)
    large = of.groupBy("carbon_bin").agg(F.count_distinct("feature_id").alias("n")).where(F.col("n") >= least)
    return of.groupBy("sample_id", "carbon_bin").agg(F.sum("value").alias("total")).join(F.broadcast(large.select("carbon_bin")), "carbon_bin")  # 13 bins


def motif_summary(cells: DataFrame, motifs: Column) -> DataFrame:
    """For each motif of a name its features, samples, and the mean, median and highest total of a sample.

    Names without motifs have no row; a feature with a motif twice counts once, as motifs are distinct.
    """
    of = cells.select("feature_id", "sample_id", "value", F.explode(motifs).alias("motif"))
    totals = of.groupBy("motif", "sample_id").agg(F.sum("value").alias("total")).groupBy("motif").agg(F.count("*").alias("n_samples"), F.avg("total").alias("mean"), F.median("total").alias("median"), F.max("total").alias("highest"))
    return totals.join(of.groupBy("motif").agg(F.count_distinct("feature_id").alias("n_features")), "motif")


def motif_cells(cells: DataFrame, motifs: Column) -> DataFrame:
    """A row for each cell and motif of its feature's name, with the motif's own carbons and dbe, so that totals, enrichment and surfaces can be made of motifs."""
    part = lambda k: F.regexp_extract("motif", r"(\d+):(\d+)", k).cast("int")
    return cells.withColumn("motif", F.explode(motifs)).withColumns({"carbons": part(1), "dbe": part(2)})


def motif_enrichment(cells: DataFrame, motifs: Column) -> DataFrame:
    """Motif, carbons, dbe, grp, share, log2_enrichment: the surface of motifs over carbons and double bonds."""
    of = enrichment(motif_cells(cells, motifs), "motif")
    return of.withColumns({"carbons": F.split_part("motif", F.lit(":"), F.lit(1)).cast("int"), "dbe": F.split_part("motif", F.lit(":"), F.lit(2)).cast("int")})


def class_ratios(cells: DataFrame, ratios: tuple[tuple[str, str], ...] = CLASS_RATIOS) -> DataFrame:
    """The ratio of class totals, and its log2, for each sample; a ratio without either class is left out.

    Null totals leave a ratio out too; a small constant on both sides keeps ratios of 0 finite.
    """
    totals = cells.groupBy("sample_id", "grp", "lipid_class").agg(F.sum("value").alias("total"))
    both = {c for r in ratios for c in r}
    wide = totals.where(F.col("lipid_class").isin(*both)).groupBy("sample_id", "grp").agg(F.map_from_entries(F.collect_list(F.struct("lipid_class", "total"))).alias("m"))
    each = wide.select("sample_id", "grp", F.explode(F.array(*(F.struct(F.lit(f"{a}/{b.split(chr(44))[0]}").alias("ratio"), F.try_element_at("m", F.lit(a)).alias("num"), F.try_element_at("m", F.lit(b)).alias("den")) for a, b in ratios))).alias("r")).select("sample_id", "grp", "r.*")
    known = each.where("num IS NOT NULL AND den IS NOT NULL")
    value = (F.col("num") + EPSILON) / (F.col("den") + EPSILON)
    return known.select("sample_id", "grp", "ratio", value.alias("value"), F.log2(value).alias("log2_value"))


def feature_ratio(cells: DataFrame, numerator: Column, denominator: Column, name: str) -> DataFrame:
    """The ratio of two parts of each class, such as unsaturated and saturated, for each sample."""
    of = cells.groupBy("sample_id", "grp", "lipid_class").agg(F.sum(F.when(numerator, F.col("value"))).alias("num"), F.sum(F.when(denominator, F.col("value"))).alias("den"))
    value = (F.col("num") + EPSILON) / (F.col("den") + EPSILON)
    return of.where("num IS NOT NULL AND den IS NOT NULL").select("sample_id", "grp", "lipid_class", F.lit(name).alias("ratio"), value.alias("value"), F.log2(value).alias("log2_value"))


def annotation_ratios(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ratio of two annotations' totals for each sample. cells: with annotation; pairs: ratio, numerator, denominator, of any number.

    Pairs of which a side is in no sample, or null, have no row; an empty table gives an empty result.
    """
    pairs = sent(pairs.select("ratio", "numerator", "denominator"), "pairs")
    totals = cells.groupBy("sample_id", "grp", "annotation").agg(F.sum("value").alias("total"))
    a = totals.join(pairs, F.col("annotation") == F.col("numerator")).select("sample_id", "grp", "ratio", F.col("total").alias("num"))
    b = totals.join(pairs, F.col("annotation") == F.col("denominator")).select("sample_id", "ratio", F.col("total").alias("den"))
    value = (F.col("num") + EPSILON) / (F.col("den") + EPSILON)
    return a.join(b, ["sample_id", "ratio"]).select("sample_id", "grp", "ratio", value.alias("value"), F.log2(value).alias("log2_value"))


def structural_ratios(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Ratios of two parts of a class (or of all classes), for each sample: sample_id, grp, lipid_class, ratio, value, log2_value.

    Unsaturated to saturated, long to short (by the median carbons of the class's features), odd to even, plasmenyl to
    other; and the last two over all classes, as the class `all`. A ratio without features on a side is left out.
    cells: with carbons, dbe, is_plasmenyl; features: lipid_class, carbons.
    """
    middle = features.where("carbons IS NOT NULL").groupBy("lipid_class").agg(F.median("carbons").alias("mid"), F.count("*").alias("known"))
    of = cells.join(F.broadcast(middle), "lipid_class", "left")  # a row for each class
    c, plas = F.col("carbons"), F.coalesce("is_plasmenyl", F.lit(False))
    parts = {
        "unsaturated/saturated": (F.col("dbe") > 0, F.col("dbe") == 0), "long/short": ((F.col("known") >= 2) & (c > F.col("mid")), (F.col("known") >= 2) & (c <= F.col("mid"))),
        "odd/even": (c % 2 == 1, c % 2 == 0), "plasmenyl/other": (plas, ~plas),
    }
    sums = [F.sum(F.when(side, F.col("value"))).alias(f"{k}{n}") for n, sides in enumerate(parts.values()) for k, side in zip("ab", sides)]
    by_class = of.groupBy("sample_id", "grp", "lipid_class").agg(*sums)
    whole = of.groupBy("sample_id", "grp").agg(*sums[4:]).select("sample_id", "grp", F.lit("all").alias("lipid_class"), *(F.lit(None).cast("double").alias(x) for x in ("a0", "b0", "a1", "b1")), "a2", "b2", "a3", "b3")
    every = by_class.unionByName(whole)
    rows = every.select("sample_id", "grp", "lipid_class", F.explode(F.array(*(F.struct(F.lit(name).alias("ratio"), F.col(f"a{n}").alias("num"), F.col(f"b{n}").alias("den")) for n, name in enumerate(parts)))).alias("r")).select("sample_id", "grp", "lipid_class", "r.*")
    value = (F.col("num") + EPSILON) / (F.col("den") + EPSILON)
    return rows.where("num IS NOT NULL AND den IS NOT NULL").select("sample_id", "grp", "lipid_class", "ratio", value.alias("value"), F.log2(value).alias("log2_value"))


def ratio_means(ratios: DataFrame, *by: str) -> DataFrame:
    """The groups' mean ratios and mean log2 ratios.

    Null ratios don't count. An empty table stays empty.
    """
    return ratios.groupBy(*by, "grp").agg(F.avg("value").alias("mean_value"), F.avg("log2_value").alias("mean_log2"))


def detection(cells: DataFrame, groups: DataFrame, share: float = 0.8) -> DataFrame:
    """feature_id, grp for groups in which at least `share` of the samples (and one) detect the feature. groups: (grp, size).

    Nulls and zeros are not detected; a rate that is the share is enough.
    """
    counts = cells.where(F.col("value") > 0).groupBy("feature_id", "grp").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(groups), "grp").where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("size")))).select("feature_id", "grp")


def intersections(detected: DataFrame) -> DataFrame:
    """How many features each combination of groups has.

    Features that no group detects are in no combination.
    """
    of = detected.groupBy("feature_id").agg(F.array_join(F.sort_array(F.collect_set("grp")), " & ").alias("groups"))
    return of.groupBy("groups").agg(F.count("*").alias("n"))


def class_intersections(detected: DataFrame, features: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(features by class and combination of groups, and the same of the `top` largest combinations and classes only).

    Ties at the cut go to the first names.
    """
    of = detected.groupBy("feature_id").agg(F.array_join(F.sort_array(F.collect_set("grp")), " & ").alias("groups")).join(features.select("feature_id", "lipid_class"), "feature_id")
    counts = of.groupBy("groups", "lipid_class").agg(F.count("*").alias("n"))
    largest = lambda c: counts.groupBy(c).agg(F.sum("n").alias("_n")).orderBy(F.col("_n").desc(), c).limit(top).select(c)
    return counts, counts.join(F.broadcast(largest("groups")), "groups").join(F.broadcast(largest("lipid_class")), "lipid_class")


def unique_features(detected: DataFrame, features: DataFrame) -> DataFrame:
    """The features that only one group detects, by group and class, with the percent of the group's."""
    one = detected.groupBy("feature_id").agg(F.count("*").alias("k"), F.min("grp").alias("grp")).where("k = 1")
    of = one.join(features.select("feature_id", "lipid_class"), "feature_id").groupBy("grp", "lipid_class").agg(F.count("*").alias("n"))
    return of.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def undetected(detected: DataFrame, features: DataFrame) -> DataFrame:
    """Features that no group detects.

    An empty table of detections leaves all.
    """
    return features.join(detected.select("feature_id").distinct(), "feature_id", "left_anti").select("feature_id", "lipid_class")


def missingness(cells: DataFrame, groups: DataFrame, n_features: Column) -> DataFrame:
    """Percent of missing values for each sample.

    Nulls and zeros are missing; samples without any value have no row.
    """
    of = cells.where(F.col("value") > 0).groupBy("sample_id", "grp").agg(F.count("*").alias("n"))
    return of.select("sample_id", "grp", (100 * (1 - F.col("n") / n_features)).alias("missing_pct"))


def detection_rates(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Detected and missing rate of each feature in each group, 0 where it is never detected.

    Nulls and zeros are missing; features without a cell are unknown here. An empty table stays empty.
    """
    counts = cells.where(F.col("value") > 0).groupBy("feature_id", "grp").agg(F.count("*").alias("n"))
    grid = cells.select("feature_id").distinct().crossJoin(F.broadcast(groups))  # a feature's row for each of the few groups
    of = grid.join(counts, ["feature_id", "grp"], "left").withColumn("detected", F.coalesce("n", F.lit(0)))
    rate = F.col("detected") / F.col("size")
    return of.select("feature_id", "grp", "detected", "size", rate.alias("detection_rate"), (1 - rate).alias("missing_rate"))


def overlap(detected: DataFrame) -> DataFrame:
    """For each pair of groups the features of the first only, of both, of the second only, and of either.

    A pair without shared features has 0; one group has no row.
    """
    sizes = detected.groupBy("grp").agg(F.count("*").alias("n"))
    right = detected.select("feature_id", F.col("grp").alias("grp2"))
    shared = detected.select("feature_id", F.col("grp").alias("grp1")).join(right, "feature_id").where("grp1 < grp2").groupBy("grp1", "grp2").agg(F.count("*").alias("shared"))
    a, b = sizes.select(F.col("grp").alias("grp1"), F.col("n").alias("n1")), sizes.select(F.col("grp").alias("grp2"), F.col("n").alias("n2"))
    of = a.join(F.broadcast(b), F.col("grp1") < F.col("grp2")).join(shared, ["grp1", "grp2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return of.select("grp1", "grp2", (F.col("n1") - F.col("shared")).alias("only1"), "shared", (F.col("n2") - F.col("shared")).alias("only2"), (F.col("n1") + F.col("n2") - F.col("shared")).alias("either"))


def comparison_summary(volcano: DataFrame) -> DataFrame:
    """Features up, down and unchanged in each comparison.

    Other or null directions don't count. An empty table stays empty.
    """
    return volcano.groupBy("grp1", "grp2").agg(F.count_if(F.col("direction") == "Up").alias("up"), F.count_if(F.col("direction") == "Down").alias("down"), F.count_if(F.col("direction") == "Not significant").alias("unchanged"))


def combined_table(comparisons: DataFrame, features: DataFrame, names: list[tuple[str, str]], *values: str) -> DataFrame:
    """A row for each feature with the values of each comparison as columns, value_grp1_grp2; null where it has none.

    comparisons: feature_id, grp1, grp2 and the values; names: the pairs of groups, which are known beforehand.
    """
    pair = F.concat_ws("_", "grp1", "grp2")
    wide = comparisons.groupBy("feature_id").agg(*(F.max(F.when(pair == f"{a}_{b}", F.col(v))).alias(f"{v}_{a}_{b}") for a, b in names for v in values))
    return wide.join(features.groupBy("feature_id").agg(F.first("lipid_class", ignorenulls=True).alias("lipid_class")), "feature_id", "left")


def comparison_effects(table: DataFrame, top: float = 0.9) -> DataFrame:
    """For each comparison and class: features, those with p < .05 (also by direction), those in the strongest tenth by |g|,
    changes up and down with their shares, and medians. table: grp1, grp2, lipid_class, log2fc, g, p.

    Null and blank classes are Unknown; null p are not low, null g not strong, and null changes neither up nor down. An empty table stays empty.
    """
    key = ["grp1", "grp2"]
    table = table.withColumn("lipid_class", F.coalesce(F.nullif(F.trim("lipid_class"), F.lit("")), F.lit("Unknown")))
    table = written(table.select(*key, "lipid_class", "log2fc", "g", "p"), "table")  # read several times below
    largest = largest_family(table, *key)
    of = table.join(sent(percentiles(table, F.abs("g"), {"cut": top}, *key, largest=largest), "cuts"), key, "left")
    low, up, down = F.coalesce(F.col("p") < 0.05, F.lit(False)), F.count_if(F.col("log2fc") > 0), F.count_if(F.col("log2fc") < 0)
    out = of.groupBy(*key, "lipid_class").agg(
        F.count("*").alias("n"), F.count_if(low).alias("n_low_p"), F.count_if(F.abs("g") >= F.col("cut")).alias("n_strong"), up.alias("up"), down.alias("down"),
        F.count_if(low & (F.col("log2fc") > 0)).alias("low_p_up"), F.count_if(low & (F.col("log2fc") < 0)).alias("low_p_down"), F.avg("log2fc").alias("mean_log2fc"),
    )
    for value, name in ((F.col("log2fc"), "median_log2fc"), (F.abs("log2fc"), "median_abs_log2fc"), (F.abs("g"), "median_abs_g")):
        out = out.join(percentiles(table, value, {name: 0.5}, *key, "lipid_class", largest=largest), [*key, "lipid_class"], "left")
    return out.withColumns({"up_share": F.col("up") / F.col("n"), "down_share": F.col("down") / F.col("n"), "same_direction": F.greatest("up", "down") / F.col("n")})


def class_effects(table: DataFrame, top: float = 0.9) -> DataFrame:
    """For each class of a comparison: features, those in the strongest tenth, median and mean change, up and down.

    table: (feature_id, lipid_class, log2fc).
    """
    table = written(table.select("lipid_class", "log2fc"), "table")  # read several times below
    largest = largest_family(table)
    of = table.join(F.broadcast(percentiles(table, F.abs("log2fc"), {"cut": top}, largest=largest)), F.lit(True), "left")  # one row
    out = of.groupBy("lipid_class").agg(
        F.count("*").alias("n"), F.count_if(F.abs("log2fc") >= F.col("cut")).alias("n_strong"), F.avg("log2fc").alias("mean_log2fc"),
        F.count_if(F.col("log2fc") > 0).alias("up"), F.count_if(F.col("log2fc") < 0).alias("down"),
    )
    for value, name in ((F.col("log2fc"), "median_log2fc"), (F.abs("log2fc"), "median_abs")):
        out = out.join(percentiles(table, value, {name: 0.5}, "lipid_class", largest=largest), "lipid_class", "left")
    return out


def design_check(samples: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Warnings for missing columns, missing or few QC samples, and small groups."""
    sizes = samples.groupBy("grp", "is_qc").agg(F.count("*").alias("n"))
    small = sizes.where("n < 3").select(F.when(F.col("is_qc"), F.concat(F.lit("fewer than 3 QC samples: "), F.col("n").cast("string"))).otherwise(F.concat(F.lit("fewer than 3 samples in "), "grp")).alias("warning"))
    none = samples.agg(F.count_if("is_qc").alias("n")).where("n = 0").select(F.lit("no QC samples").alias("warning"))
    absent = samples.sparkSession.createDataFrame([(f"no column {c}",) for c in required if c not in samples.columns], "warning string")
    return small.unionByName(none).unionByName(absent)


def class_directions(table: DataFrame) -> DataFrame:
    """Features up, down and unchanged in each class. table: lipid_class, direction.

    A null class is a class; classes lack no column.
    """
    counts = table.groupBy("lipid_class").pivot("direction", ["Up", "Down", "Not significant"]).count().na.fill(0)
    return counts.select("lipid_class", F.col("Up").alias("up"), F.col("Down").alias("down"), F.col("Not significant").alias("unchanged"))
