"""Group tests for each feature: t, ranks, variances, Kruskal-Wallis, detection, false-discovery rates.

Cells are (feature_id, sample_id, value, grp); a null value is missing. Everything of a feature is computed from sums of
(feature, group), so that a test costs one shuffle on feature_id; a feature has no more rows than there are samples.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_p, f_p, normal_p, signed_rank_p, t_p, t_p_batches
from ..scale import FAMILY, least_from_above, own_name, value_ranks, written


def group_moments(cells: DataFrame, *key: str) -> DataFrame:
    return cells.groupBy(*key, "grp").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def pairs(of: DataFrame, *key: str) -> DataFrame:
    """Each pair of groups of a key, the first by name as 1: columns x1, x2 for each column x of `of`."""
    rest = [c for c in of.columns if c not in key]
    left, right = (of.select(*key, *(F.col(c).alias(f"{c}{k}") for c in rest)) for k in (1, 2))
    return left.join(right, list(key)).where("grp1 < grp2")


def welch(moments: DataFrame, *key: str, with_p: bool = True) -> DataFrame:
    """T, df and p of Welch's test for each key and pair of groups; null with under two values on a side.

    With both deviations under 1e-12 p is 1 and t is null.
    """
    of = pairs(moments, *key)
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    flat = (F.col("var1") < 1e-24) & (F.col("var2") < 1e-24)
    of = of.withColumn("t", F.when(enough & ~flat, (F.col("mean1") - F.col("mean2")) / F.sqrt(e1 + e2)))
    of = of.withColumn("df", F.when(enough & ~flat, (e1 + e2) ** 2 / (e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))))
    return of.withColumn("p", F.when(enough & flat, F.lit(1.0)).otherwise(t_p("t", "df"))) if with_p else of


def student(moments: DataFrame, *key: str) -> DataFrame:
    """T and df with a pooled variance."""
    of = pairs(moments, *key)
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / df
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2) & (pooled >= 1e-24)
    return of.withColumn("t", F.when(enough, (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))).withColumn("df", F.when(enough, df.cast("double")))


def hedges(moments: DataFrame, *key: str) -> DataFrame:
    """T4: the standardized difference with the small-sample correction; null up to three values, 0 without spread."""
    of = pairs(moments, *key)
    n = F.col("n1") + F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (n - 2))
    g = F.when(pooled < 1e-12, F.lit(0.0)).otherwise((F.col("mean1") - F.col("mean2")) / pooled * (1 - F.lit(3.0) / (4 * n - 9)))
    return of.withColumn("g", F.when((n > 3) & (F.col("n1") >= 2) & (F.col("n2") >= 2), g))


def _average_rank(of: DataFrame, *key: str) -> DataFrame:
    """of with rank (ties share their mean) and ties (rows with the same value in the key)."""
    by_value = Window.partitionBy(*key).orderBy("value")
    of = of.withColumn("ties", F.count("*").over(Window.partitionBy(*key, "value")))
    return of.withColumn("rank", F.rank().over(by_value) + (F.col("ties") - 1) / F.lit(2.0))


def mann_whitney(cells: DataFrame, with_p: bool = True) -> DataFrame:
    """feature_id, grp1, grp2, u, z, effect (2u/(n1 n2) - 1) and p, normal with ties and no continuity correction."""
    groups = cells.select("feature_id", "grp").distinct()
    sides = pairs(groups, "feature_id")
    known = cells.where(F.col("value").isNotNull()).select("feature_id", "grp", "value")
    of = sides.join(known, "feature_id").where("grp = grp1 OR grp = grp2")
    ranked = _average_rank(of, "feature_id", "grp1", "grp2")
    first = F.col("grp") == F.col("grp1")
    sums = ranked.groupBy("feature_id", "grp1", "grp2").agg(
        F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"), F.sum(F.when(first, F.col("rank"))).alias("r1"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    out = sums.withColumn("u", F.when((n1 > 0) & (n2 > 0), F.col("r1") - n1 * (n1 + 1) / F.lit(2.0)))
    sd = F.sqrt(n1 * n2 / F.lit(12.0) * (n + 1 - F.col("tie") / (n * (n - 1))))
    out = out.withColumn("z", F.when((n > 1) & (sd > 0), (F.col("u") - n1 * n2 / F.lit(2.0)) / sd)).withColumn("effect", 2 * F.col("u") / F.nullif(n1 * n2, F.lit(0)) - 1)
    out = out.drop("r1", "tie")
    return out.withColumn("p", normal_p("z")) if with_p else out


def kruskal(cells: DataFrame, *key: str, closed_form: bool = False) -> DataFrame:
    """Key, k, n, h (with ties) and p over the groups that have data; null for under two groups or equal values.

    closed_form: for three groups p is exp(-h/2), without Python.
    """
    key = key or ("feature_id",)
    ranked = _average_rank(cells.where(F.col("value").isNotNull()), *key)
    by_group = ranked.groupBy(*key, "grp").agg(F.count("*").alias("n"), F.sum("rank").alias("r"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"))
    sums = by_group.groupBy(*key).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") ** 2 / F.col("n")).alias("rr"), F.sum("tie").alias("tie"))
    n = F.col("n")
    correction = 1 - F.col("tie") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / F.nullif(correction, F.lit(0.0))
    out = sums.select(*key, "k", "n", F.when((F.col("k") >= 2) & (n > 2), h).alias("h"))
    return out.withColumn("p", F.when(F.col("k") == 3, F.exp(-F.col("h") / 2)) if closed_form else chi2_p("h", F.col("k") - 1))


def brown_forsythe(cells: DataFrame, with_p: bool = True) -> DataFrame:
    """The analysis of variance of distances from the group median: feature_id, f, d1, d2, p."""
    mid = cells.groupBy("feature_id", "grp").agg(F.median("value").alias("mid"))
    far = cells.join(mid, ["feature_id", "grp"]).select("feature_id", "grp", F.abs(F.col("value") - F.col("mid")).alias("value"))
    by_group = far.groupBy("feature_id", "grp").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    sums = by_group.where("n > 0").groupBy("feature_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") ** 2 / F.col("n")).alias("between"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    within = F.col("ss") - F.col("between")
    f = ((F.col("between") - F.col("s") ** 2 / F.col("n")) / d1) / (within / d2)
    out = sums.select("feature_id", F.when((d1 > 0) & (d2 > 0) & (within > 1e-9 * F.col("ss")), f).alias("f"), d1.alias("d1"), d2.alias("d2"))
    return out.withColumn("p", f_p("f", "d1", "d2")) if with_p else out


def fold_change(cells: DataFrame) -> DataFrame:
    """T5: log2 of the ratio of the groups' medians of non-zero values, with 1 % of the pooled median added, within +-20."""
    known = cells.select("feature_id", "grp", F.nullif("value", F.lit(0.0)).alias("value"))
    mids = pairs(known.groupBy("feature_id", "grp").agg(F.median("value").alias("mid")), "feature_id")
    pooled = mids.join(known, "feature_id").where("grp = grp1 OR grp = grp2").groupBy("feature_id", "grp1", "grp2").agg(F.median("value").alias("pool"))
    of = mids.join(pooled, ["feature_id", "grp1", "grp2"])
    eps = F.lit(0.01) * F.coalesce("pool", F.lit(0.0)) + 1e-9
    ratio = (F.coalesce("mid1", F.lit(0.0)) + eps) / (F.coalesce("mid2", F.lit(0.0)) + eps)
    return of.select("feature_id", "grp1", "grp2", F.log2(F.least(F.lit(1e6), F.greatest(F.lit(1e-6), ratio))).alias("log2fc"))


def benjamini_hochberg(tests: DataFrame, *family: str, p: str = "p", out: str = "fdr") -> DataFrame:
    """Tests with the false-discovery rate within each family; null for a null p.

    Distinct p are ranked, with how many tests have each, and tests take their rate by a join; so equal p, however many,
    are one row. A family of more distinct p than a task may hold is ranked in ranges, and the least from above is taken in
    ranges too. A null family is a family; columns may have any names but `out`, which is replaced; an empty table stays empty.
    """
    tests = written(tests.drop(out), "tests")  # read twice below
    names = {c: own_name(tests, f"family{k}") for k, c in enumerate(family)}
    mine, rate = own_name(tests, "p"), own_name(tests, "rate")
    rows = tests.count()
    of = tests.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{p}`").alias(mine))
    of = value_ranks(of, mine, *names.values(), rows=rows).withColumn("raw", F.col(mine) * F.col("n") / F.col("rank"))
    if rows <= FAMILY:
        above = (Window.partitionBy(*names.values()) if names else Window.partitionBy(F.lit(0))).orderBy(F.col(mine).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        of = of.withColumn("least", F.min("raw").over(above))
    else:
        of = least_from_above(of, "raw", mine, *names.values(), out="least")
    of = of.select(*names.values(), mine, F.least(F.lit(1.0), "least").alias(rate))
    same = reduce(and_, [tests[f"`{c}`"].eqNullSafe(of[n]) for c, n in names.items()], tests[f"`{p}`"] == of[mine])
    return tests.join(of, same, "left").select(*(tests[f"`{c}`"] for c in tests.columns), F.col(rate).alias(out))


def gate(omnibus: DataFrame, pairwise: DataFrame, *key: str, alpha: float = 0.05) -> DataFrame:
    """Pairwise tests with both rates; significant if both are under alpha."""
    first = benjamini_hochberg(omnibus, out="omnibus_fdr").select(*key, F.col("p").alias("omnibus_p"), "omnibus_fdr")
    second = benjamini_hochberg(pairwise, out="fdr")
    return second.join(first, list(key)).withColumn("significant", F.coalesce((F.col("omnibus_fdr") < alpha) & (F.col("fdr") < alpha), F.lit(False)))


def _sides(cells: DataFrame) -> DataFrame:
    """feature_id, grp1, grp2, and n, mean, var and v (the values in their order) of both groups, from one row a feature: no join of groups."""
    of = cells.withColumn("value", F.col("value").cast("double"))
    of = of.groupBy("feature_id", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.sort_array(F.collect_list("value")).alias("v"))
    of = of.groupBy("feature_id").agg(F.collect_list(F.struct("grp", "n", "mean", "var", "v")).alias("all"))
    of = of.select("feature_id", F.explode("all").alias("x"), "all").select("feature_id", "x", F.explode(F.filter("all", lambda y: y["grp"] > F.col("x.grp"))).alias("y"))
    return of.select("feature_id", *(F.col(f"{s}.{c}").alias(f"{c}{k}") for c in ("grp", "n", "mean", "var", "v") for k, s in ((1, "x"), (2, "y"))))


def _middle(v: Column) -> Column:
    """The median of an array that is in its order; null without values."""
    a, b = F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")), F.get(v, F.floor(F.size(v) / 2).cast("int"))
    return F.when(F.size(v) > 0, F.when(a == b, a).otherwise(0.5 * a + 0.5 * b))


def _rank_sums(v1: Column, v2: Column) -> Column:
    """r1 and tie of mann_whitney, by one walk through both sides' values in their order: a run of equal ones shares its mean rank."""
    tagged = F.sort_array(F.concat(F.transform(v1, lambda x: F.struct(x.alias("value"), F.lit(1.0).alias("first"))), F.transform(v2, lambda x: F.struct(x.alias("value"), F.lit(0.0).alias("first")))))
    state = lambda value, ties, mine, before, r1, tie: F.struct(value.alias("value"), ties.alias("ties"), mine.alias("mine"), before.alias("before"), r1.alias("r1"), tie.alias("tie"))
    r1 = lambda s: s["r1"] + s["mine"] * (s["before"] + (s["ties"] + 1) / 2)
    tie = lambda s: s["tie"] + s["ties"] * (s["ties"] * s["ties"] - 1)
    zero, one = F.lit(0.0), F.lit(1.0)

    def step(s: Column, x: Column) -> Column:
        longer = state(s["value"], s["ties"] + one, s["mine"] + x["first"], s["before"], s["r1"], s["tie"])
        return F.when(s["value"] == x["value"], longer).otherwise(state(x["value"], one, x["first"], s["before"] + s["ties"], r1(s), tie(s)))

    return F.aggregate(tagged, state(F.lit(None).cast("double"), zero, zero, zero, zero, zero), step, lambda s: F.struct(r1(s).alias("r1"), tie(s).alias("tie")))


def _volcano_columns(cells: DataFrame) -> DataFrame:
    """volcano_statistics with u_z, and whether both sides are flat. All of it is of a feature's own values, so it costs one shuffle on feature_id."""
    of, (n1, n2) = _sides(cells), (F.col("n1"), F.col("n2"))
    n, enough = n1 + n2, (n1 >= 2) & (n2 >= 2)
    e1, e2 = F.col("var1") / n1, F.col("var2") / n2
    flat = enough & (F.col("var1") < 1e-24) & (F.col("var2") < 1e-24)
    pooled = F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n - 2))
    g = F.when(pooled < 1e-12, F.lit(0.0)).otherwise((F.col("mean1") - F.col("mean2")) / pooled * (1 - F.lit(3.0) / (4 * n - 9)))
    known1, known2 = (F.array_remove(c, 0.0) for c in ("v1", "v2"))
    eps = F.lit(0.01) * F.coalesce(_middle(F.sort_array(F.concat(known1, known2))), F.lit(0.0)) + 1e-9
    ratio = (F.coalesce(_middle(known1), F.lit(0.0)) + eps) / (F.coalesce(_middle(known2), F.lit(0.0)) + eps)
    of = of.withColumns({
        "flat": F.coalesce(flat, F.lit(False)), "t": F.when(enough & ~flat, (F.col("mean1") - F.col("mean2")) / F.sqrt(e1 + e2)),
        "df": F.when(enough & ~flat, (e1 + e2) ** 2 / (e1**2 / (n1 - 1) + e2**2 / (n2 - 1))), "log2fc": F.log2(F.least(F.lit(1e6), F.greatest(F.lit(1e-6), ratio))),
        "g": F.when((n > 3) & enough, g), "ranks": F.when((n1 > 0) & (n2 > 0), _rank_sums(F.col("v1"), F.col("v2"))),
    })
    sd = F.sqrt(n1 * n2 / F.lit(12.0) * (n + 1 - F.col("ranks.tie") / (n * (n - 1))))
    of = of.withColumn("u", F.col("ranks.r1") - n1 * (n1 + 1) / F.lit(2.0))
    of = of.withColumn("u_z", F.when((n > 1) & (sd > 0), (F.col("u") - n1 * n2 / F.lit(2.0)) / sd)).withColumn("effect", 2 * F.col("u") / F.nullif(n1 * n2, F.lit(0)) - 1)
    unclear = F.col("effect").isNull() | (F.coalesce(F.signum("log2fc"), F.lit(0.0)) == 0)
    agrees = F.when(unclear, "Undetermined").when(F.signum("effect") == F.signum("log2fc"), "Yes").otherwise("No")
    return of.select("feature_id", "grp1", "grp2", "t", "df", "log2fc", "g", "effect", "u_z", agrees.alias("direction_agrees"), "flat")


def volcano_statistics(cells: DataFrame) -> DataFrame:
    """T9 without p: Welch's t and df, fold change, Hedges' g, the rank-biserial effect, and whether that has the fold change's direction.

    direction_agrees: Yes, No, or Undetermined without an effect or a change.
    """
    return _volcano_columns(cells).drop("flat")


def volcano(cells: DataFrame, alpha: float = 0.05, change: float = 1.5, effect: float = 0.8) -> DataFrame:
    """For each feature and pair of groups, Welch's test, fold change, Hedges' g, rates, the direction, and whether the rank test bears it out.

    robustness: Supported or Discordant where Welch's test or its rate is significant and the rank test is too, by
    direction; Not supported where the rank test is not; Not evaluated elsewhere.
    """
    of = _volcano_columns(cells)
    of = of.withColumn("p", F.when(F.col("flat"), F.lit(1.0)).otherwise(t_p_batches("t", "df"))).drop("flat")
    of = benjamini_hochberg(of, "grp1", "grp2").withColumn("rank_p", normal_p("u_z")).drop("u_z")
    strong = (F.abs("log2fc") >= F.log2(F.lit(change))) & (F.col("p") < alpha) & (F.col("fdr") < alpha)
    direction = F.when(strong & (F.col("log2fc") > 0), "Up").when(strong, "Down").otherwise("Not significant")
    primary, ranks = F.coalesce((F.col("p") < 0.05) | (F.col("fdr") < 0.05), F.lit(False)), F.coalesce(F.col("rank_p") < alpha, F.lit(False))
    robust = F.when(~primary, "Not evaluated").when(ranks & (F.col("direction_agrees") == "Yes"), "Supported").when(ranks & (F.col("direction_agrees") == "No"), "Discordant").otherwise("Not supported")
    return of.withColumns({"direction": direction, "large_effect": F.coalesce(F.abs("g") >= effect, F.lit(False)), "robustness": robust})


def presence(counts: DataFrame) -> DataFrame:
    """Chi-squared of detected and missing by group. counts: (feature_id, grp, detected, size); Yates for two groups."""
    total = counts.groupBy("feature_id").agg(F.sum("detected").alias("d"), F.sum("size").alias("s"), F.count("*").alias("k"))
    of = counts.join(total, "feature_id")
    share = F.col("d") / F.col("s")
    off = F.abs(F.col("detected") - F.col("size") * share)
    off = F.when(F.col("k") == 2, F.greatest(F.lit(0.0), off - F.least(F.lit(0.5), off))).otherwise(off)
    part = off**2 / F.nullif(F.col("size") * share * (1 - share), F.lit(0.0))
    return of.groupBy("feature_id").agg(F.sum(part).alias("chi2"), (F.max("k") - 1).alias("df"))


def hurdle(cells: DataFrame, counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Presence or level differs: rates of the presence test and of Kruskal-Wallis on groups with two values or more."""
    p1 = benjamini_hochberg(presence(counts).withColumn("p", chi2_p("chi2", "df"))).select("feature_id", "chi2", F.col("fdr").alias("presence_fdr"))
    enough = cells.where(F.col("value").isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy("feature_id", "grp"))).where("_n >= 2")
    p2 = benjamini_hochberg(kruskal(enough)).select("feature_id", "h", F.col("fdr").alias("level_fdr"))
    return p1.join(p2, "feature_id", "left").withColumn("differs", F.coalesce(F.col("presence_fdr") < alpha, F.lit(False)) | F.coalesce(F.col("level_fdr") < alpha, F.lit(False)))


def neighbours(table: DataFrame, carbons: int = 2, dbe: int = 1) -> DataFrame:
    """For each feature, the features of its class with near carbons and double bonds, itself among them.

    table: (feature_id, lipid_class, carbons, dbe, log2fc). What is near depends on class, carbons and double bonds alone, so counts and
    medians are made once for each such cell, from the distinct values of the cells that it reaches, and features look theirs up.
    """
    cell = ["lipid_class", "carbons", "dbe"]
    table = written(table.select("feature_id", *cell, "log2fc", F.signum("log2fc").alias("sign")), "table")  # read three times below
    around = lambda c, k: F.explode(F.sequence(F.col(c) - k, F.col(c) + k)).alias(c)

    def reached(*value: str) -> DataFrame:
        of = table.groupBy(*cell, *value).agg(F.count("*").alias("n"))
        return of.select("lipid_class", around("carbons", carbons), "dbe", *value, "n").select("lipid_class", "carbons", around("dbe", dbe), *value, "n")

    middle = reached("log2fc").groupBy(*cell).agg(F.sum("n").alias("n_near"), F.sum(F.when(F.col("log2fc").isNotNull(), F.col("n"))).alias("_known"), F.percentile("log2fc", F.lit(0.5), F.col("n")).alias("median_near"))
    alike = reached("sign").where("sign IS NOT NULL").groupBy(*cell, "sign").agg(F.sum("n").alias("_same"))
    of = table.join(middle, cell).join(alike, [*cell, "sign"], "left")
    share = F.when(F.col("sign").isNotNull(), F.coalesce("_same", F.lit(0)) / F.col("_known"))
    of = of.select("feature_id", "n_near", share.alias("same_direction"), "median_near")
    return of.withColumn("coherent", (F.col("n_near") >= 2) & (F.col("same_direction") >= 0.7))


def class_coherence(table: DataFrame) -> DataFrame:
    """Classes of three or more features of which 70 % change in one direction."""
    up = F.avg((F.col("log2fc") > 0).cast("double"))
    of = table.groupBy("lipid_class").agg(F.count("*").alias("n"), up.alias("share_up"))
    return of.withColumn("coherent", (F.col("n") >= 3) & (F.greatest(F.col("share_up"), 1 - F.col("share_up")) >= 0.7))


def signed_rank(before: Column, after: Column) -> Column:
    return after - before


def wilcoxon(pairs_: DataFrame, *key: str, with_p: bool = True) -> DataFrame:
    """The signed-rank test of paired values: key, n, w_plus, w_minus, z, p. pairs_: key, before, after.

    Pairs without a difference are left out; under three pairs p is null. p is exact without ties up to 50 pairs, else normal.
    """
    of = pairs_.select(*key, signed_rank(F.col("before"), F.col("after")).alias("d")).where("d != 0").withColumn("value", F.abs("d"))
    ranked = _average_rank(of, *key)
    sums = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("tie") / F.lit(48.0))
    out = sums.withColumn("z", F.when(n >= 3, (F.least("w_plus", "w_minus") - n * (n + 1) / F.lit(4.0)) / F.nullif(sd, F.lit(0.0))))
    exact = (F.col("tie") == 0) & n.between(3, 50)
    out = out.withColumn("p", F.when(exact, signed_rank_p("n", F.least("w_plus", "w_minus"))).otherwise(normal_p("z"))) if with_p else out
    return out.drop("tie")


def top_features(tests: DataFrame, n: int, *by: str, least: int = 1, digits: int = 12) -> DataFrame:
    """The n tests with the lowest p, of all or of each `by` with `least` tests or more, with their place as rank.

    Of all, the first n are taken before they are numbered. Ties go to the smaller feature_id; null p are left out.
    """
    p = F.round("p", digits)
    known = tests.where(F.col("p").isNotNull())
    if not by:
        return known.orderBy(p, "feature_id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(p, "feature_id")))
    large = known.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(p, "feature_id"))
    return known.join(large, list(by)).withColumn("rank", place).where(F.col("rank") <= n)


def ordered_table(tests: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """Tests in the order of fdr, then the largest change, nulls last; with n, the first n, of each `by` if it is given."""
    order = [F.round("fdr", 12).asc_nulls_last(), F.round(F.abs("log2fc"), 9).desc_nulls_last(), "feature_id"]
    if n is None:
        return tests.orderBy(*by, *order)
    if not by:
        return tests.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return tests.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def top_hits(sources: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """The n best of each source by fdr, then p, in one table: source, id, effect, p, fdr, place.

    sources: tables of id (string), effect, p, fdr. The order of the whole is that of fdr, then p, nulls last.
    """
    order = [F.round("fdr", 12).asc_nulls_last(), F.round("p", 12).asc_nulls_last(), "id"]
    best = [df.orderBy(*order).limit(n).select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), F.col("effect").cast("double").alias("effect"), "p", "fdr") for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, best)
    return every.withColumn("place", F.row_number().over(Window.orderBy(*order[:2], "source", "id")))  # n rows of each source
