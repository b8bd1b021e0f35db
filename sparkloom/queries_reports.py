"""More registered queries: names of all kinds, appended matches, reports, and variants of operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import names as N
from .operators import annotate, composition, multivariate, normalize
from .operators import group_tests as tests
from .queries import (
    CATEGORY_SQL, CCS, CHANGE, CHOICE, CLASS_SQL, DETECTED, KRUSKAL, LIBRARY, MOMENTS, PRESENCE, SCORED, SIDES, ZG, _elimination_sql, _scaled, cells, change, detected, library, off_ccs, presence_counts, query, r, scored, standards,
    gated, moderated, side, sql_gate, sql_moderated, targets, tested, top_ids, TESTED,
)
from .scale import scratch, unsent
from .sources import tables

# Names of all kinds


@query(X.NAMED_SQL + r"""
, t AS (SELECT feature_id, lipid_class, CASE WHEN name IS NULL THEN '' WHEN trim(name) IN ('cholestenone', 'Cholestenone') THEN 'ST 27:2;O (Cholestenone)' ELSE trim(replace(replace(trim(name), '-SN1', ''), '-SN2', '')) END AS name, name AS raw FROM nm)
, p AS (SELECT feature_id, lipid_class, name, raw, regexp_extract_all(name, '(\d+):(\d+)', 1)::INT[] AS cs, regexp_extract_all(name, '(\d+):(\d+)', 2)::INT[] AS ds,
  CASE WHEN strpos(name, ';') = 0 OR strpos(substr(name, strpos(name, ';') + 1), '/') > 0 THEN '' ELSE trim(substr(name, strpos(name, ';') + 1)) END AS mods FROM t)
SELECT feature_id, name, regexp_replace(split_part(name, ' ', 1), '\[D\d+\]', '') || CASE WHEN regexp_matches(name, '\bO-') THEN ' O-' ELSE '' END AS headgroup,
  len(cs) AS n_acyls, CASE WHEN len(cs) > 0 THEN list_sum(cs) END AS carbons, CASE WHEN len(ds) > 0 THEN list_sum(ds) END AS dbe,
  CASE WHEN len(cs) = 0 THEN '' WHEN list_sum(cs) % 2 = 1 THEN 'odd' ELSE 'even' END AS parity, coalesce(list_sum(ds) >= 2, FALSE) AS is_pufa, mods,
  coalesce(list_sum(list_transform(range(1, 1 + len(regexp_extract_all(mods, '[A-Za-z]+'))), lambda i: coalesce(nullif(regexp_extract_all(mods, '(\d*)([A-Za-z]+)(\d*)', 3)[i], '')::INT, nullif(regexp_extract_all(mods, '(\d*)([A-Za-z]+)(\d*)', 1)[i], '')::INT, 1))), 0)::INT AS n_mods,
  NOT (lipid_class IN ('HexCer', 'LacCer', 'GlcCer', 'GalCer', 'SM', 'Cer', 'ACer') AND mods IN ('O2', 'O3')) AND regexp_matches(upper(mods), '\bO\d*\b|OH|OXO') AS is_oxidized,
  CASE WHEN regexp_matches(coalesce(raw, ''), '\[D\d+\]') THEN 'IS' WHEN feature_id % 3 = 0 THEN 'MS/MS match' WHEN feature_id % 7 = 0 THEN 'Target List match (MS, RT, CCS)' ELSE '' END AS kind
FROM p""")
def p1_p8_names_of_all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    chains, mods = N.acyls(name), N.modifications(name)
    c, d = N.total(chains, "carbons"), N.total(chains, "dbe")
    score, source = F.when(F.col("feature_id") % 3 == 0, 9.0), F.when(F.col("feature_id") % 7 == 0, "my target list").otherwise("library")
    of = X.named(spark, sf).withColumn("kind", N.annotation_type(F.coalesce("name", F.lit("")), score, source)).withColumn("name", N.tidy(F.coalesce("name", F.lit(""))))
    return of.select(
        "feature_id", "name", N.headgroup(name).alias("headgroup"), F.size(chains).cast("long").alias("n_acyls"), c.alias("carbons"), d.alias("dbe"), N.parity(c).alias("parity"), N.is_polyunsaturated(d).alias("is_pufa"),
        mods.alias("mods"), N.n_modifications(mods).alias("n_mods"), N.is_oxidized(mods, F.col("lipid_class")).alias("is_oxidized"), "kind",
    )


@query(X.NAMED_SQL + r"""
, hd AS (SELECT feature_id, name, coalesce(regexp_replace(split_part(trim(name), ' ', 1), '\[D\d+\]', ''), '') AS h FROM nm)
SELECT feature_id, CASE WHEN h = '' THEN '' WHEN h IN ('PC', 'Cer', 'CL', 'TG') THEN h WHEN h = 'PE' AND regexp_matches(name, '\bO-') THEN 'PE ethers' WHEN contains(name, 'sterol') THEN 'ST' ELSE 'Other' END AS lipid_class FROM hd""")
def p12_class_of_headgroup(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("PC", "PC"), ("Cer", "Cer"), ("CL", "CL"), ("TG", "TG"), ("PE O-", "PE ethers")], "headgroup string, lipid_class string")
    of = X.named(spark, sf).select("feature_id", F.col("name").alias("annotation"), N.headgroup(F.col("name")).alias("headgroup"))
    return annotate.with_class(of, known, searched=True).select("feature_id", "lipid_class")


@query(X.NAMED_SQL + r"SELECT feature_id, nullif(regexp_extract(name, '(\d+)\s*:\s*(\d+)', 1), '')::DOUBLE AS carbons, CASE WHEN feature_id % 2 = 0 THEN 1.0 ELSE NULL END::DOUBLE AS dbe FROM nm")
def p23_counts_from_names(spark: SparkSession, sf: str) -> DataFrame:
    of = X.named(spark, sf).withColumns({"carbons": F.when(F.col("feature_id") < 0, 1.0), "dbe": F.when(F.col("feature_id") % 2 == 0, 1.0)})
    of = annotate.counts_from_names(annotate.counts_from_names(of, "carbons", 1, "name"), "dbe", 2, "name")
    return of.select("feature_id", "carbons", "dbe")


@query("""SELECT feature_id, lipid_class AS raw, CASE lipid_class WHEN 'Cer' THEN 'Cer' ELSE lipid_class END AS appended, 'HexCer, GlcCer' AS alias, 'FAL, FOH' AS twice, CASE WHEN feature_id % 2 = 0 THEN 'Other' ELSE 'PS, PS-NAc' END AS other FROM features""")
def p22_class_groups(spark: SparkSession, sf: str) -> DataFrame:
    f = X.features(spark, sf)
    name = F.when(F.col("feature_id") % 2 == 0, "none such").otherwise("PS ")
    return f.select("feature_id", F.col("lipid_class").alias("raw"), N.class_group(F.col("lipid_class")).alias("appended"), N.class_group(F.lit("H")).alias("alias"), N.class_group(F.lit("FAL")).alias("twice"), N.class_group(name, "other").alias("other"))


@query(X.NAMED_SQL + r"""
, m AS (SELECT feature_id, list_distinct(regexp_extract_all(coalesce(name, ''), '\d{1,2}:\d{1,2}')) AS f, coalesce(name, '') AS name FROM nm)
SELECT feature_id, CASE WHEN len(f) >= 2 OR regexp_matches(name, '[_/;]') OR feature_id % 3 = 0 THEN len(f) ELSE 0 END AS n_motifs FROM m""")
def p24_motif_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    return X.named(spark, sf).select("feature_id", F.size(N.motifs(F.col("name"), F.col("feature_id") % 6 == 0, F.col("feature_id") % 6 == 3)).cast("long").alias("n_motifs"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS feature_id, p_partkey, p_name FROM part")
def s1_read_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_features(spark, f"{sf}/part.parquet", "p_partkey").select("feature_id", "p_partkey", "p_name")


@query("SELECT feature_id, polarity, CASE WHEN msms_score >= 300 THEN 'kept' ELSE 'removed' END AS step FROM features")
def s10_stage_written_and_read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "stage")
    tables.write_stage(X.features(spark, sf).select("feature_id", "polarity", F.when(F.col("msms_score") >= 300, "kept").otherwise("removed").alias("step")), path, "polarity", "step")
    return spark.read.parquet(path).select("feature_id", "polarity", "step")


@query("SELECT sample_id, feature_id // 100 AS block, count(*) AS n, round(sum(value), 2) AS total FROM intensity GROUP BY ALL")
def s3_samples_by_features(spark: SparkSession, sf: str) -> DataFrame:
    of = tables.to_samples(X.intensity(spark, sf), 100)
    total = F.aggregate(F.map_values("features"), F.lit(0.0), lambda s, x: s + x)
    return of.select("sample_id", "block", F.size("features").cast("long").alias("n"), r(total, 2).alias("total"))


@query("SELECT trim(s_name) AS sample_id, 'g' || (s_suppkey % 4) AS grp FROM supplier")
def s4_first_group_of_a_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    first = s.select(F.concat(F.lit(" "), "s_name").alias("Sample"), F.concat(F.lit("g"), (F.col("s_suppkey") % 4).cast("string")).alias("Group"), F.col("s_suppkey").alias("line"))
    later = first.withColumns({"Group": F.lit("a later one"), "line": F.col("line") + 1_000_000_000})
    return tables.read_groups(first.unionByName(later), position="line").select("sample_id", "grp")


@query("SELECT upper(lipid_class) AS lipid_class, p AS polarity, length(lipid_class) / 4.0::DOUBLE + CASE WHEN p = 'Neg' THEN 0.5 ELSE 0 END AS sensitivity FROM (SELECT DISTINCT lipid_class FROM features) CROSS JOIN (VALUES ('Pos'), ('Neg')) v(p) WHERE NOT (p = 'Neg' AND lipid_class = 'TG')")
def s6_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    raw = X.features(spark, sf).select("lipid_class").distinct().select(F.concat("lipid_class", F.lit(" ")).alias("lipid_class"), (F.length("lipid_class") / 4.0).cast("string").alias("Pos"), F.when(F.col("lipid_class") != "TG", (F.length("lipid_class") / 4.0 + 0.5).cast("string")).otherwise("NA").alias("Neg"))
    return tables.read_sensitivity(raw, "Pos", "Neg")


# Matches and metadata


@query(LIBRARY + """, un AS (SELECT * FROM features WHERE feature_id % 4 <> 0), hit AS (SELECT f.feature_id, lib_id, t.adduct, f.is_standard FROM un f JOIN th t ON t.polarity = f.polarity AND theo BETWEEN f.mz - 0.004 AND f.mz + 0.004 WHERE abs(f.mz - theo) <= 0.003 AND abs(f.mz - theo) / theo * 1e6 <= 3.3)
SELECT feature_id, CASE WHEN feature_id % 4 = 0 THEN annotation ELSE '' END AS annotation, adduct, CASE WHEN is_standard THEN 'IS' ELSE '' END AS annotation_type, lipid_class, NULL::INT AS dbe, FALSE AS found FROM features
UNION ALL SELECT h.feature_id, 'PC ' || (h.lib_id % 40) || ':' || (h.lib_id % 5) || '_18:1', h.adduct, CASE WHEN h.is_standard THEN 'IS' ELSE 'MS match' END, CASE WHEN h.lib_id % 4 = 1 THEN 'PC' ELSE 'PC' END, (h.lib_id % 5 + 1)::INT, TRUE FROM hit h""")
def j1_u4_append_matches(spark: SparkSession, sf: str) -> DataFrame:
    f = X.features(spark, sf).withColumns({"annotation": F.when(F.col("feature_id") % 4 == 0, F.col("annotation")).otherwise(""), "annotation_type": F.when(F.col("is_standard"), "IS").otherwise(""), "dbe": F.lit(None).cast("int")})
    lib = library(spark, sf).withColumn("annotation", F.format_string("PC %d:%d_18:1", F.col("lib_id") % 40, F.col("lib_id") % 5))
    known = spark.createDataFrame([("PC", "PC")], "headgroup string, lipid_class string")
    return annotate.annotated(f, lib, known, ppm=3.3).select("feature_id", "annotation", "adduct", "annotation_type", "lipid_class", "dbe", (F.coalesce("annotation_source", F.lit("")) == "library").alias("found"))


@query("SELECT feature_id, 'low score' AS reason FROM features WHERE msms_score < 300 UNION SELECT feature_id, 'light' FROM features WHERE neutral_mass < 910 UNION SELECT feature_id, 'low score' FROM features WHERE msms_score < 100")
def u4_joined_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda where, reason: X.features(spark, sf).where(where).select("feature_id", F.lit("cleaning").alias("step"), F.lit(reason).alias("reason"))
    return annotate.joined_ledgers(one("msms_score < 300", "low score"), one("neutral_mass < 910", "light"), one("msms_score < 100", "low score")).select("feature_id", "reason")


@query("SELECT 'cleaning' AS step, CASE WHEN msms_score < 300 THEN 'low score' ELSE 'light' END AS reason, count(*) AS removed FROM features WHERE msms_score < 300 OR neutral_mass < 910 GROUP BY ALL")
def a7_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    of = X.features(spark, sf).where("msms_score < 300 OR neutral_mass < 910").select("feature_id", F.lit("cleaning").alias("step"), F.when(F.col("msms_score") < 300, "low score").otherwise("light").alias("reason"))
    return composition.reason_counts(of.unionByName(of))


@query("SELECT f.feature_id, m.lipid_class, m.carbons, f.msms_score FROM features f LEFT JOIN features m ON m.feature_id = f.feature_id AND m.feature_id % 5 <> 0")
def j4_attach_metadata(spark: SparkSession, sf: str) -> DataFrame:
    f = X.features(spark, sf)
    first = f.where("feature_id % 5 <> 0").select("feature_id", "lipid_class", "carbons", F.lit(1).alias("line"))
    later = f.where("feature_id % 5 <> 0").select("feature_id", F.lit("later").alias("lipid_class"), F.lit(0).alias("carbons"), F.lit(2).alias("line"))
    return annotate.attach(f.select("feature_id", "msms_score", F.lit("old").alias("lipid_class")), first.unionByName(later), "line")


# Scores of other organisms, and lines of a measured library


@query(SCORED.replace("least(1, 0.25 + CASE WHEN lipid_class IN ('TG', 'FA') THEN 0.1 ELSE 0 END)", "least(1, 0.25 + CASE WHEN lipid_class IN ('TG', 'FA') THEN 0.1 ELSE 0 END + CASE WHEN lipid_class IN ('PC', 'TG') THEN 0.8 ELSE 0 END)") + "SELECT feature_id, round(score, 6) AS score FROM sc")
def f10_score_bacterial(spark: SparkSession, sf: str) -> DataFrame:
    f = X.features(spark, sf).withColumns({"adduct_penalty": F.lit(0.25), "sensitivity": F.lit(0.25), "n_acyls": F.lit(1), "is_plasmenyl": F.lit(False), "n_modifications": F.lit(0), "modifications": F.lit("")})
    return annotate.score(f, "bacterial").select("feature_id", r("score").alias("score"))


@query(SCORED.replace("features), sc AS", "features), sc AS").replace("greatest(0, 100 - p1 - 0.25 - p2 - p3 - p4 - p5)", "greatest(0, 100 - p1 - (feature_id % 5) * 0.25 - p2 - p3 - p4 - p5 - CASE WHEN feature_id % 3 = 0 THEN 6 ELSE 0 END - CASE WHEN feature_id % 4 = 0 THEN 0 WHEN feature_id % 4 = 1 THEN 1 ELSE (feature_id % 4) / 6.0 END - CASE WHEN feature_id % 7 = 0 THEN 10 ELSE 0 END)") + "SELECT feature_id, round(score, 6) AS score FROM sc")
def f10_score_fungal(spark: SparkSession, sf: str) -> DataFrame:
    """All parts of the penalty vary: adduct, plasmenyl, modifications and abbreviation too."""
    n = (F.col("feature_id") % 4).cast("int")
    f = X.features(spark, sf).withColumns({
        "adduct_penalty": (F.col("feature_id") % 5) * F.lit(0.25), "sensitivity": F.lit(0.25), "n_acyls": F.lit(1), "is_plasmenyl": F.col("feature_id") % 3 == 0, "n_modifications": n,
        "modifications": F.when(n == 1, "Br").otherwise("O"), "annotation": F.when(F.col("feature_id") % 7 == 0, "NoAbbrev: x").otherwise(F.col("annotation")),
    })
    return annotate.score(f, "fungal").select("feature_id", r("score").alias("score"))


@query(CCS.format(key="lipid_class").replace("l AS (SELECT lipid_class, regr_slope(c, carbons) AS b, regr_intercept(c, carbons) AS a, count(*) AS size FROM c0 GROUP BY lipid_class)", "l0 AS (SELECT lipid_class, regr_slope(c, carbons) AS b, regr_intercept(c, carbons) AS a, count(*) AS size FROM c0 GROUP BY lipid_class), lb AS (SELECT lipid_class, regr_slope(ccs, carbons) AS b, regr_intercept(ccs, carbons) AS a FROM features WHERE lipid_class IN ('PC', 'SM') GROUP BY lipid_class HAVING count(*) >= 6), l AS (SELECT lipid_class, coalesce(lb.b, l0.b) AS b, coalesce(lb.a, l0.a) AS a, size FROM l0 LEFT JOIN lb USING (lipid_class))")
       + "SELECT feature_id, NOT (size >= 12 AND abs(e) > 2 AND off / greatest(0.75, 1.4826 * mad) >= 5 AND NOT is_standard) AS keep, round(off / greatest(0.75, 1.4826 * mad), 5) AS robust_z FROM o JOIN ma USING (lipid_class)")
def f15_ccs_of_a_library(spark: SparkSession, sf: str) -> DataFrame:
    measured = X.features(spark, sf).where("lipid_class IN ('PC', 'SM')").select("lipid_class", "carbons", "ccs")
    return annotate.ccs_filter(off_ccs(spark, sf), "lipid_class", limit=5.0, library=measured).select("feature_id", "keep", r("robust_z", 5).alias("robust_z"))


# Reports


@query(", t AS (SELECT sample_id, grp, sum(value) AS total FROM cells GROUP BY ALL), m AS (SELECT grp, avg(total) AS m, var_samp(total) AS v, count(*) AS n FROM t GROUP BY grp) SELECT a.grp AS grp1, b.grp AS grp2, round(a.m / b.m, 6) AS fold_change, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 6) AS df FROM m a JOIN m b ON a.grp <> b.grp WHERE a.n > 1 AND b.n > 1")
def a5_group_tests(spark: SparkSession, sf: str) -> DataFrame:
    of = composition.group_changes(cells(spark, sf), with_p=False).where("t IS NOT NULL")
    return of.select("grp1", "grp2", r("fold_change").alias("fold_change"), r("t").alias("t"), r("df").alias("df"))


@query(CLASS_SQL.replace("SELECT lipid_class, grp, round(avg(total), 4)", ", md AS (SELECT lipid_class, grp, median(total) AS m FROM p GROUP BY ALL) SELECT lipid_class, grp, round(100 * m / sum(m) OVER (PARTITION BY grp), 6) AS median_percent FROM md --"))
def a9_median_percents(spark: SparkSession, sf: str) -> DataFrame:
    return composition.class_totals(cells(spark, sf)).select("lipid_class", "grp", r("median_percent").alias("median_percent"))


@query("SELECT lipid_class, sample_id, round(sum(value * dbe / carbons) / sum(value), 6) AS saturation_index FROM cells WHERE value > 0 GROUP BY ALL")
def a11_saturation_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    return composition.saturation(cells(spark, sf), "sample_id").withColumn("saturation_index", r("saturation_index"))


@query(""", o AS (SELECT feature_id, grp, lipid_class, carbons, dbe, dbe / carbons::DOUBLE AS x, avg(value) / 1e6 AS a FROM cells GROUP BY ALL),
b AS (SELECT lipid_class, grp, dbe::DOUBLE AS x, sum(a) AS y, count(*)::DOUBLE AS w FROM o GROUP BY ALL),
s1 AS (SELECT lipid_class, grp, count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM b GROUP BY ALL),
s2 AS (SELECT lipid_class, grp, count(*) AS n, sum(a) AS w, sum(a * x) AS wx, sum(a * a) AS wy, sum(a * x * x) AS xx, sum(a * x * a) AS xy FROM o GROUP BY ALL)
SELECT lipid_class, grp, s1.n AS dbe_n, s2.n AS ratio_n, round(s2.wx / s2.w, 6) AS mean_ratio, round(CASE WHEN s1.xx - s1.wx ** 2 / s1.w > 1e-9 THEN (s1.xy - s1.wx * s1.wy / s1.w) / (s1.xx - s1.wx ** 2 / s1.w) END, 6) AS dbe_slope,
  round(CASE WHEN s2.xx - s2.wx ** 2 / s2.w > 1e-9 THEN (s2.xy - s2.wx * s2.wy / s2.w) / (s2.xx - s2.wx ** 2 / s2.w) END, 5) AS ratio_slope FROM s1 JOIN s2 USING (lipid_class, grp)""")
def a13_other_regressions(spark: SparkSession, sf: str) -> DataFrame:
    of = composition.class_trends(cells(spark, sf).withColumn("value", F.col("value") / 1e6))
    return of.select("lipid_class", "grp", "dbe_n", "ratio_n", r("mean_ratio").alias("mean_ratio"), r("dbe_slope").alias("dbe_slope"), r("ratio_slope", 5).alias("ratio_slope"))


def motif_name() -> Column:
    return F.concat("lipid_class", F.lit(" "), F.col("carbons").cast("string"), F.lit(":"), F.col("dbe").cast("string"), F.lit("_16:0"))


@query(""", x AS (SELECT sample_id, grp, value, unnest(list_distinct([carbons || ':' || dbe, '16:0'])) AS motif FROM cells), t AS (SELECT sample_id, grp, motif, sum(value) AS v FROM x GROUP BY ALL), p AS (SELECT *, v / sum(v) OVER (PARTITION BY sample_id) AS share FROM t), g AS (SELECT grp, motif, avg(share) AS share FROM p GROUP BY ALL)
SELECT grp, motif, split_part(motif, ':', 1)::INT AS carbons, split_part(motif, ':', 2)::INT AS dbe, round(share, 6) AS share, round(log2(share / avg(share) OVER (PARTITION BY motif)), 5) AS log2_enrichment FROM g""")
def a16_motif_surface(spark: SparkSession, sf: str) -> DataFrame:
    return composition.motif_enrichment(cells(spark, sf), N.motifs(motif_name())).select("grp", "motif", "carbons", "dbe", r("share").alias("share"), r("log2_enrichment", 5).alias("log2_enrichment"))


RATIOS = """, x AS (SELECT c.*, feature_id % 3 = 0 AS plas, mid, known FROM cells c LEFT JOIN (SELECT lipid_class, median(carbons) AS mid, count(*) AS known FROM features GROUP BY lipid_class) USING (lipid_class)),
e AS (SELECT sample_id, grp, lipid_class, sum(value) FILTER (dbe > 0) AS a0, sum(value) FILTER (dbe = 0) AS b0, sum(value) FILTER (known >= 2 AND carbons > mid) AS a1, sum(value) FILTER (known >= 2 AND carbons <= mid) AS b1, sum(value) FILTER (carbons % 2 = 1) AS a2, sum(value) FILTER (carbons % 2 = 0) AS b2, sum(value) FILTER (plas) AS a3, sum(value) FILTER (NOT plas) AS b3 FROM x GROUP BY ALL
  UNION ALL SELECT sample_id, grp, 'all', NULL, NULL, NULL, NULL, sum(value) FILTER (carbons % 2 = 1), sum(value) FILTER (carbons % 2 = 0), sum(value) FILTER (plas), sum(value) FILTER (NOT plas) FROM x GROUP BY ALL),
l AS (SELECT sample_id, grp, lipid_class, 'unsaturated/saturated' AS ratio, a0 AS a, b0 AS b FROM e UNION ALL SELECT sample_id, grp, lipid_class, 'long/short', a1, b1 FROM e UNION ALL SELECT sample_id, grp, lipid_class, 'odd/even', a2, b2 FROM e UNION ALL SELECT sample_id, grp, lipid_class, 'plasmenyl/other', a3, b3 FROM e),
rt AS (SELECT sample_id, grp, lipid_class, ratio, (a + 1e-9) / (b + 1e-9) AS value FROM l WHERE a IS NOT NULL AND b IS NOT NULL) """


def structural(spark: SparkSession, sf: str) -> DataFrame:
    return composition.structural_ratios(cells(spark, sf).withColumn("is_plasmenyl", F.col("feature_id") % 3 == 0), X.features(spark, sf))


@query(RATIOS + "SELECT sample_id, lipid_class, ratio, round(value, 6) AS value, round(log2(value), 6) AS log2_value FROM rt")
def a17_structural_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return structural(spark, sf).select("sample_id", "lipid_class", "ratio", r("value").alias("value"), r("log2_value").alias("log2_value"))


@query(RATIOS + "SELECT grp, lipid_class, ratio, round(avg(value), 6) AS mean_value, round(avg(log2(value)), 6) AS mean_log2 FROM rt GROUP BY ALL")
def a17_ratio_means(spark: SparkSession, sf: str) -> DataFrame:
    return composition.ratio_means(structural(spark, sf), "lipid_class", "ratio").withColumns({"mean_value": r("mean_value"), "mean_log2": r("mean_log2")})


@query(", t AS (SELECT sample_id, grp, lipid_class AS c, sum(value) AS v FROM cells GROUP BY ALL) SELECT x.sample_id, x.grp, x.c || '/' || y.c AS ratio, round((x.v + 1e-9) / (y.v + 1e-9), 6) AS value FROM t x JOIN t y USING (sample_id) WHERE (x.c = 'PC' AND y.c = 'PE') OR (x.c = 'TG' AND y.c = 'DG')")
def a17_product_ratios(spark: SparkSession, sf: str) -> DataFrame:
    of = cells(spark, sf).withColumn("lipid_class", N.class_group(F.col("lipid_class")))
    return composition.class_ratios(of, composition.PRODUCT_RATIOS).select("sample_id", "grp", "ratio", r("value").alias("value"))


@query(", a AS (SELECT sample_id, grp, annotation, sum(value) AS v FROM cells JOIN features USING (feature_id) GROUP BY ALL), d AS (SELECT annotation AS n, lead(annotation) OVER (ORDER BY annotation) AS d FROM (SELECT annotation FROM features GROUP BY annotation HAVING count(*) > 1)) SELECT x.sample_id, n || '/' || d AS ratio, round((x.v + 1e-9) / (y.v + 1e-9), 6) AS value FROM d JOIN a x ON x.annotation = n JOIN a y ON y.annotation = d AND y.sample_id = x.sample_id")
def a17_annotation_ratios(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    f = X.features(spark, sf).select("feature_id", "annotation")
    names = f.groupBy("annotation").count().where("count > 1").select("annotation")
    pairs = names.select(F.col("annotation").alias("numerator"), F.lead("annotation").over(Window.orderBy("annotation")).alias("denominator")).where("denominator IS NOT NULL").withColumn("ratio", F.concat_ws("/", "numerator", "denominator"))
    return composition.annotation_ratios(cells(spark, sf).join(f, "feature_id"), pairs).select("sample_id", "ratio", r("value").alias("value"))


HEDGES = MOMENTS + ", hg AS (SELECT feature_id, grp1, grp2, CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4 * (n1 + n2) - 9)) END AS g, ln(m1 / m2) AS lf FROM pr) "


@query(HEDGES + KRUSKAL.split(", rk AS", 1)[0] + ", rk AS" + KRUSKAL.split(", rk AS", 1)[1] + """, q AS (SELECT grp1, grp2, quantile_cont(abs(g), 0.9) AS cut FROM hg GROUP BY ALL)
SELECT grp1, grp2, lipid_class, count(*) AS n, count(*) FILTER (p < 0.05) AS n_low_p, count(*) FILTER (abs(g) >= cut - 1e-9) AS n_strong, count(*) FILTER (lf > 0) AS up, count(*) FILTER (lf < 0) AS down, count(*) FILTER (p < 0.05 AND lf > 0) AS low_p_up, round(median(abs(g)), 5) AS median_abs_g, round(count(*) FILTER (lf > 0) / count(*)::DOUBLE, 6) AS up_share
FROM hg JOIN features USING (feature_id) JOIN kp USING (feature_id) JOIN q USING (grp1, grp2) GROUP BY ALL""")
def a22_comparison_effects(spark: SparkSession, sf: str) -> DataFrame:
    """The p of a feature is that of its Kruskal-Wallis test, which SQL can express."""
    of = tests.hedges(tests.group_moments(tested(spark, sf), "feature_id"), "feature_id").withColumn("log2fc", F.log(F.col("mean1") / F.col("mean2"))).select("feature_id", "grp1", "grp2", "log2fc", F.round("g", 12).alias("g"))
    p = tests.kruskal(tested(spark, sf), closed_form=True).select("feature_id", "p")
    out = composition.comparison_effects(of.join(p, "feature_id").join(X.features(spark, sf).select("feature_id", "lipid_class"), "feature_id"))
    return out.select("grp1", "grp2", "lipid_class", "n", "n_low_p", "n_strong", "up", "down", "low_p_up", r("median_abs_g", 5).alias("median_abs_g"), r("up_share").alias("up_share"))


@query(DETECTED + ", s AS (SELECT feature_id, string_agg(grp, ' & ' ORDER BY grp) AS groups FROM dt GROUP BY feature_id), c AS (SELECT groups, lipid_class, count(*) AS n FROM s JOIN features USING (feature_id) GROUP BY ALL) SELECT * FROM c WHERE groups IN (SELECT groups FROM c GROUP BY groups ORDER BY sum(n) DESC, groups LIMIT 20) AND lipid_class IN (SELECT lipid_class FROM c GROUP BY lipid_class ORDER BY sum(n) DESC, lipid_class LIMIT 20)")
def a24_class_intersections(spark: SparkSession, sf: str) -> DataFrame:
    return composition.class_intersections(detected(spark, sf), X.features(spark, sf))[1].select("groups", "lipid_class", "n")


@query(HEDGES + "SELECT feature_id, lipid_class, " + ", ".join(f"round(max(g) FILTER (grp1 = '{a}' AND grp2 = '{b}'), 6) AS g_{a}_{b}, max(n1) FILTER (grp1 = '{a}' AND grp2 = '{b}') AS n1_{a}_{b}" for a, b in (("A", "B"), ("A", "C"), ("B", "C"))) + " FROM hg JOIN (SELECT feature_id, grp1, grp2, n1 FROM pr) USING (feature_id, grp1, grp2) JOIN features USING (feature_id) GROUP BY ALL")
def a25_combined_table(spark: SparkSession, sf: str) -> DataFrame:
    names = [("A", "B"), ("A", "C"), ("B", "C")]
    of = tests.hedges(tests.group_moments(tested(spark, sf), "feature_id"), "feature_id")
    wide = composition.combined_table(of, X.features(spark, sf), names, "g", "n1")
    return wide.select("feature_id", "lipid_class", *(r(f"g_{a}_{b}").alias(f"g_{a}_{b}") for a, b in names), *(f"n1_{a}_{b}" for a, b in names))


@query("SELECT 'no column ' || c AS warning FROM (VALUES ('batch'), ('inj_order')) v(c) UNION ALL SELECT 'fewer than 3 QC samples: 1' FROM supplier WHERE s_suppkey = 0")
def a26_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    of = spark.read.parquet(f"{sf}/supplier.parquet").select(F.lit("A").alias("grp"), (F.col("s_suppkey") == 0).alias("is_qc")).withColumn("grp", F.when(F.col("is_qc"), "QC").otherwise("A"))
    return composition.design_check(of, ("grp", "batch", "inj_order"))


# Choices, orders, tops


@query("SELECT feature_id, standard_id, 'mean' AS stage FROM (SELECT DISTINCT feature_id, polarity FROM cells) JOIN (SELECT polarity, standard_id FROM (SELECT polarity, feature_id AS standard_id, avg(value) AS m FROM cells WHERE is_standard GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY polarity ORDER BY round(m, 9) DESC, standard_id DESC) = 1) USING (polarity)")
def n3_without_qc_samples(spark: SparkSession, sf: str) -> DataFrame:
    every = cells(spark, sf).withColumn("is_qc", F.lit(False))
    return normalize.choose_standard(every, standards(spark, sf)).select("feature_id", "standard_id", "stage")


@query(CHOICE + "SELECT feature_id, standard_id, round(before, 6) AS rsd_before, round(after, 6) AS rsd_after, coalesce(after <= before * 1.2, FALSE) AS within FROM ra JOIN rb USING (feature_id) WHERE after IS NOT NULL")
def n3_audit(spark: SparkSession, sf: str) -> DataFrame:
    of = normalize.standard_candidates(cells(spark, sf), standards(spark, sf))
    return of.select("feature_id", "standard_id", r("rsd_before").alias("rsd_before"), r("rsd_after").alias("rsd_after"), "within")


@query("SELECT grp, n, w, round(least(1, 2 * (SELECT count(*) FROM (SELECT m, (SELECT coalesce(sum(k + 1), 0) FROM range(n) t(k) WHERE (m >> k) & 1 = 1) AS s FROM range((2 ** n)::BIGINT) u(m)) WHERE s <= w) / 2.0 ** n), 9) AS p FROM (SELECT grp, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w FROM (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) AS rk FROM (SELECT grp, sample_id, sum(value) FILTER (dbe > 2) * 1.5 - sum(value) AS d FROM cells GROUP BY ALL) WHERE d <> 0) GROUP BY grp) WHERE n >= 3")
def n9_exact_p(spark: SparkSession, sf: str) -> DataFrame:
    of = cells(spark, sf).groupBy("grp", "sample_id").agg(F.sum("value").alias("before"), (F.sum(F.when(F.col("dbe") > 2, F.col("value"))) * 1.5).alias("after"))
    return tests.wilcoxon(of, "grp").where("n >= 3").select("grp", "n", F.least("w_plus", "w_minus").alias("w"), r("p", 9).alias("p"))


@query(", m AS (SELECT polarity, lipid_class, feature_id, median(value) AS md, count(*) FILTER (value > 0) / count(*)::DOUBLE AS dr, 100 * stddev_samp(value) / avg(value) AS rsd FROM cells GROUP BY ALL) SELECT polarity, lipid_class, feature_id, round(md, 4) AS median FROM m QUALIFY row_number() OVER (PARTITION BY polarity, lipid_class ORDER BY round(md, 6) DESC, dr DESC, round(rsd, 6), feature_id) = 1")
def w4_main_ions(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.main_ions(cells(spark, sf), "polarity", "lipid_class").select("polarity", "lipid_class", "feature_id", r("median", 4).alias("median"))


@query(KRUSKAL + f", k AS (SELECT feature_id, {CATEGORY_SQL} AS category, round(p, 9) AS p FROM kp JOIN features USING (feature_id) WHERE p IS NOT NULL) SELECT category, feature_id, row_number() OVER (PARTITION BY category ORDER BY p, feature_id) AS rank FROM k WHERE category IN (SELECT category FROM k GROUP BY category HAVING count(*) >= 15) QUALIFY rank <= 10 UNION ALL SELECT 'all', feature_id, row_number() OVER (ORDER BY p, feature_id) FROM (SELECT * FROM k ORDER BY p, feature_id LIMIT 50)")
def w6_top_of_categories(spark: SparkSession, sf: str) -> DataFrame:
    category = composition.mapped(F.col("lipid_class"), composition.CATEGORIES, "Other").alias("category")
    of = tests.kruskal(tested(spark, sf), closed_form=True).join(X.features(spark, sf).select("feature_id", category), "feature_id")
    some = tests.top_features(of, 10, "category", least=15, digits=9).select("category", "feature_id", "rank")
    return some.unionByName(tests.top_features(of, 50, digits=9).select(F.lit("all").alias("category"), "feature_id", "rank"))


BINS = ", bn AS (SELECT CASE WHEN carbons <= 16 THEN '11-16C' WHEN carbons <= 22 THEN '17-22C' WHEN carbons <= 28 THEN '23-28C' WHEN carbons <= 34 THEN '29-34C' WHEN carbons <= 40 THEN '35-40C' WHEN carbons <= 46 THEN '41-46C' WHEN carbons <= 52 THEN '47-52C' ELSE '53-58C' END AS feature_id, sample_id, grp, sum(value) AS value, count(DISTINCT feature_id) AS nf FROM cells WHERE grp <> 'QC' GROUP BY ALL) "


@query(BINS + KRUSKAL.replace("FROM cells WHERE grp <> 'QC'", "FROM bn") + "SELECT feature_id AS carbon_bin, round(h, 6) AS h, row_number() OVER (ORDER BY round(p, 9), feature_id) AS rank FROM kp WHERE p IS NOT NULL")
def w6_top_carbon_bins(spark: SparkSession, sf: str) -> DataFrame:
    every = tested(spark, sf)
    of = composition.bin_matrix(every, N.carbon_bin(F.col("carbons")), least=1).join(F.broadcast(X.samples(spark).select("sample_id", "grp")), "sample_id").withColumnRenamed("carbon_bin", "feature_id").withColumnRenamed("total", "value")
    return tests.top_features(tests.kruskal(of, closed_form=True), 100, digits=9).select(F.col("feature_id").alias("carbon_bin"), r("h").alias("h"), "rank")


FDR = ", o AS (SELECT *, round(p, 12) AS pr FROM kp), q AS (SELECT *, pr * count(*) OVER (PARTITION BY p IS NULL) / count(*) OVER (PARTITION BY p IS NULL ORDER BY pr) AS raw FROM o), fd AS (SELECT feature_id, pr AS p, CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY p IS NULL ORDER BY pr DESC)) END AS fdr FROM q) "


@query(CHANGE + KRUSKAL + FDR + ", w AS (SELECT feature_id, lipid_class, round(fdr, 6) AS fdr, row_number() OVER (PARTITION BY lipid_class ORDER BY round(fdr, 12) NULLS LAST, round(abs(log2fc), 9) DESC NULLS LAST, feature_id) AS place FROM fd JOIN lf USING (feature_id)) SELECT * FROM w WHERE place <= 12")
def w7_first_of_each_class(spark: SparkSession, sf: str) -> DataFrame:
    p = tests.benjamini_hochberg(tests.kruskal(tested(spark, sf), closed_form=True).withColumn("p", r("p", 12))).select("feature_id", "fdr")
    return tests.ordered_table(change(spark, sf).join(p, "feature_id"), "lipid_class", n=12).select("feature_id", "lipid_class", r("fdr").alias("fdr"), "place")


def _with_fdr(of: DataFrame) -> DataFrame:
    return tests.benjamini_hochberg(of.withColumn("p", r("p", 12)))


def _sql_source(name: str, rows: str) -> str:
    """SQL of the ten best of a table of id, effect and p, with rates."""
    return f"(SELECT '{name}' AS source, id::VARCHAR AS id, effect, p, fdr FROM (SELECT id, effect, p, CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY p IS NULL ORDER BY p DESC)) END AS fdr FROM (SELECT *, p * count(*) OVER (PARTITION BY p IS NULL) / count(*) OVER (PARTITION BY p IS NULL ORDER BY p) AS raw FROM ({rows}))) ORDER BY round(fdr, 12) NULLS LAST, round(p, 12) NULLS LAST, id::VARCHAR LIMIT 10)"


def _sql_kruskal(table: str) -> str:
    body = KRUSKAL.replace("FROM cells WHERE grp <> 'QC'", f"FROM {table}").lstrip()[1:]
    return f"WITH {body} SELECT feature_id AS id, NULL::DOUBLE AS effect, round(p, 12) AS p FROM kp"


HITS = (
    ", tc AS (SELECT * FROM cells WHERE grp <> 'QC'), cl AS (SELECT lipid_class AS feature_id, sample_id, grp, sum(value) AS value FROM tc GROUP BY ALL), rl AS (SELECT x.feature_id || '/' || y.feature_id AS feature_id, x.sample_id, x.grp, log2((x.value + 1e-9) / (y.value + 1e-9)) AS value FROM cl x JOIN cl y USING (sample_id) WHERE (x.feature_id, y.feature_id) IN (('FA', 'TG'), ('DG', 'TG'), ('DG', 'PC'), ('DG', 'PE'), ('SM', 'Cer')))"
    + PRESENCE.split("\nSELECT")[0]
    + ", cx AS (SELECT feature_id, sum((d - size * s) ** 2 / nullif(size * s * (1 - s), 0)) AS chi2 FROM ct JOIN tt USING (feature_id) GROUP BY feature_id) SELECT source, id, round(fdr, 6) AS fdr, row_number() OVER (ORDER BY round(fdr, 12) NULLS LAST, round(p, 12) NULLS LAST, source, id) AS place FROM ("
    + " UNION ALL ".join([_sql_source("Feature", _sql_kruskal("tc")), _sql_source("Class", _sql_kruskal("cl")), _sql_source("Ratio", _sql_kruskal("rl")), _sql_source("Presence", "SELECT feature_id AS id, NULL::DOUBLE AS effect, round(exp(-round(chi2, 9) / 2), 12) AS p FROM cx")])
    + ")"
)


@query(HITS)
def w8_top_hits(spark: SparkSession, sf: str) -> DataFrame:
    every = tested(spark, sf)
    of = lambda df, c: _with_fdr(tests.kruskal(df, c, closed_form=True)).select(F.col(c).cast("string").alias("id"), F.lit(None).cast("double").alias("effect"), "p", "fdr")
    totals = every.groupBy("sample_id", "grp", "lipid_class").agg(F.sum("value").alias("value"))
    ratios = composition.class_ratios(every).select("sample_id", "grp", "ratio", F.col("log2_value").alias("value"))
    presence = _with_fdr(tests.presence(presence_counts(spark, sf)).withColumn("p", F.exp(-F.round("chi2", 9) / 2))).select(F.col("feature_id").cast("string").alias("id"), F.lit(None).cast("double").alias("effect"), "p", "fdr")  # three groups
    return tests.top_hits({"Feature": of(every, "feature_id"), "Class": of(totals, "lipid_class"), "Ratio": of(ratios, "ratio"), "Presence": presence}).select("source", "id", r("fdr").alias("fdr"), "place")


# Gates of other labels, and the volcano's statistics


@query(TESTED + sql_gate("tc", "feature_id"))
def t8_gate_of_features(spark: SparkSession, sf: str) -> DataFrame:
    return gated(tested(spark, sf), "feature_id")


@query(RATIOS + ", lr AS (SELECT lipid_class || ' ' || ratio AS label, sample_id, grp, log2(value) AS value FROM rt WHERE grp <> 'QC') " + sql_gate("lr", "label"))
def t8_gate_of_ratios(spark: SparkSession, sf: str) -> DataFrame:
    of = structural(spark, sf).where("grp <> 'QC'").select(F.concat_ws(" ", "lipid_class", "ratio").alias("label"), "sample_id", "grp", F.col("log2_value").alias("value"))
    return gated(of, "label")


@query(", mt AS (SELECT motif, sample_id, grp, sum(value) AS value FROM (SELECT sample_id, grp, value, unnest(list_distinct([carbons || ':' || dbe, '16:0'])) AS motif FROM cells WHERE grp <> 'QC') GROUP BY ALL) " + sql_gate("mt", "motif"))
def t8_gate_of_motifs(spark: SparkSession, sf: str) -> DataFrame:
    of = composition.motif_cells(tested(spark, sf), N.motifs(motif_name())).groupBy("motif", "sample_id", "grp").agg(F.sum("value").alias("value"))
    return gated(of, "motif")


@query(HEDGES + """, md AS (SELECT feature_id, grp, median(nullif(value, 0)) AS m FROM cells WHERE grp <> 'QC' GROUP BY ALL), po AS (SELECT pr.feature_id, grp1, grp2, a.m AS a, b.m AS b, 0.01 * median(nullif(value, 0)) + 1e-9 AS eps FROM pr JOIN md a ON a.feature_id = pr.feature_id AND a.grp = grp1 JOIN md b ON b.feature_id = pr.feature_id AND b.grp = grp2 JOIN cells c ON c.feature_id = pr.feature_id AND c.grp IN (grp1, grp2) GROUP BY ALL),
fc AS (SELECT feature_id, grp1, grp2, log2((a + eps) / (b + eps)) AS l FROM po), ef AS (SELECT pr.feature_id, grp1, grp2, 2 * avg(CASE WHEN x.value > y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0.0 END) - 1 AS e FROM pr JOIN cells x ON x.feature_id = pr.feature_id AND x.grp = grp1 JOIN cells y ON y.feature_id = pr.feature_id AND y.grp = grp2 GROUP BY ALL)
SELECT feature_id, grp1, grp2, round(l, 6) AS log2fc, round(g, 6) AS g, round(e, 6) AS effect, CASE WHEN l = 0 THEN 'Undetermined' WHEN sign(round(e, 9)) = sign(l) THEN 'Yes' ELSE 'No' END AS direction_agrees FROM fc JOIN hg USING (feature_id, grp1, grp2) JOIN ef USING (feature_id, grp1, grp2)""")
def t9_volcano_statistics(spark: SparkSession, sf: str) -> DataFrame:
    of = tests.volcano_statistics(tested(spark, sf))
    return of.select("feature_id", "grp1", "grp2", r("log2fc").alias("log2fc"), r("g").alias("g"), r("effect").alias("effect"), "direction_agrees")


@query(sql_moderated("inj_order"))
def t11_numeric_batch(spark: SparkSession, sf: str) -> DataFrame:
    return moderated(spark, sf, X.samples(spark).withColumn("batch", F.col("inj_order").cast("string")))


@query(ZG.split(", g AS (")[0] + ", x AS (SELECT a.sample_id AS s1, b.sample_id AS s2, corr(a.z, b.z) AS r FROM za a JOIN za b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY ALL), bo AS (SELECT s1 AS s, r FROM x UNION ALL SELECT s2, r FROM x), t AS (SELECT s FROM bo GROUP BY s ORDER BY round(avg(abs(r)), 9) DESC, s LIMIT 10) SELECT s1, s2, round(r, 6) AS r FROM x WHERE s1 IN (FROM t) AND s2 IN (FROM t)")
def t16_strongest_samples(spark: SparkSession, sf: str) -> DataFrame:
    return multivariate.sample_correlations(_scaled(spark, sf), 10).select("s1", "s2", r("r").alias("r"))


@query(", gd AS (SELECT f.feature_id, f.lipid_class, s.sample_id, i.value FROM (SELECT DISTINCT feature_id, lipid_class FROM cells) f CROSS JOIN (SELECT * FROM samples WHERE grp = 'A') s LEFT JOIN (SELECT * FROM intensity WHERE value > 0) i ON i.feature_id = f.feature_id AND i.sample_id = s.sample_id), k AS (SELECT gd.feature_id, gd.lipid_class, gd.sample_id, coalesce(value, m) AS value FROM gd JOIN (SELECT feature_id, min(value) AS m FROM gd GROUP BY feature_id) USING (feature_id) WHERE m IS NOT NULL), c AS (SELECT a.lipid_class, a.feature_id AS id1, b.feature_id AS id2, CASE WHEN var_pop(a.value) > 1e-6 AND var_pop(b.value) > 1e-6 THEN corr(a.value, b.value) END AS r FROM k a JOIN k b ON a.sample_id = b.sample_id AND a.lipid_class = b.lipid_class AND a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) >= 3) SELECT lipid_class, id1, id2, round(r, 5) AS r FROM c")
def t16_correlations_of_a_group(spark: SparkSession, sf: str) -> DataFrame:
    filled = normalize.fill_minimum(cells(spark, sf).where("grp = 'A'"), X.samples(spark).where("grp = 'A'"), cells(spark, sf).select("feature_id").distinct())
    of = filled.join(X.features(spark, sf).select("feature_id", "lipid_class"), "feature_id")
    return multivariate.class_correlations(of).select("lipid_class", "id1", "id2", r("r", 5).alias("r"))


TOP = KRUSKAL + ", tp AS (SELECT feature_id FROM kp WHERE p IS NOT NULL ORDER BY round(p, 12), feature_id LIMIT 50)"


@query(TOP + ", k AS (SELECT feature_id, sample_id, value FROM cells JOIN tp USING (feature_id) WHERE value > 0), c AS (SELECT a.feature_id AS id1, b.feature_id AS id2, count(*) AS n, corr(a.value, b.value) AS r FROM k a JOIN k b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) >= 3) SELECT id1, id2, n, round(r, 6) AS r FROM c")
def t13_top_features(spark: SparkSession, sf: str) -> DataFrame:
    """The correlations of the 50 features that tell the groups apart best, of any class."""
    top = tests.top_features(tests.kruskal(tested(spark, sf), closed_form=True), 50).select("feature_id")
    of = cells(spark, sf).join(F.broadcast(top), "feature_id").withColumn("lipid_class", F.lit("all"))  # 50 rows
    return multivariate.class_correlations(of).select("id1", "id2", "n", r("r").alias("r"))


@query(", k AS (SELECT lipid_class, grp, feature_id, sample_id, value FROM cells WHERE value > 0), c AS (SELECT a.lipid_class, a.grp, a.feature_id, b.feature_id AS id2, corr(a.value, b.value) AS r FROM k a JOIN k b ON a.sample_id = b.sample_id AND a.lipid_class = b.lipid_class AND a.feature_id < b.feature_id GROUP BY ALL HAVING count(*) >= 3) SELECT lipid_class, grp, count(r) AS pairs, round(avg(r), 4) AS mean_r, round(avg(abs(r)), 4) AS mean_abs_r FROM c GROUP BY ALL")
def t13_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of each class's correlations inside each group of samples."""
    of = cells(spark, sf).withColumn("lipid_class", F.concat_ws("|", "lipid_class", "grp"))
    out = multivariate.class_correlation_summary(of, median=False)
    part = lambda k: F.split_part("lipid_class", F.lit("|"), F.lit(k))
    return out.select(part(1).alias("lipid_class"), part(2).alias("grp"), "pairs", r("mean_r", 4).alias("mean_r"), r("mean_abs_r", 4).alias("mean_abs_r"))


@query("SELECT feature_id, sample_id, value FROM cells JOIN (SELECT feature_id, msms_score FROM features) USING (feature_id) WHERE msms_score > 400")
def s11_high_confidence(spark: SparkSession, sf: str) -> DataFrame:
    tier = X.features(spark, sf).select("feature_id", N.annotation_tier(F.lit(""), F.col("msms_score")).alias("annotation_tier"))
    return tables.variant(cells(spark, sf).join(tier, "feature_id"), with_qc=True, high_confidence=True).select("feature_id", "sample_id", "value")


# Projections


@query(ZG + "SELECT s1, s2, round(distance, 4) AS distance FROM ds")
def m1_distances_of_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All components reproduce the samples' distances, whatever their signs."""
    names, scores, _ = multivariate.principal_components(multivariate.gram(_scaled(spark, sf)), k=20)
    of = spark.createDataFrame([(int(s), [float(x) for x in row]) for s, row in zip(names, scores, strict=True)], "s int, v array<double>")
    a, b = (of.select(F.col("s").alias(f"s{k}"), F.col("v").alias(f"v{k}")) for k in (1, 2))
    square = F.aggregate(F.zip_with("v1", "v2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(F.broadcast(b), F.col("s1") < F.col("s2")).select("s1", "s2", r(F.sqrt(square), 4).alias("distance"))  # a row for each sample


@query()
def m1_loadings(spark: SparkSession, sf: str) -> DataFrame:
    z = _scaled(spark, sf)
    names, scores, _ = multivariate.principal_components(multivariate.gram(z))
    return multivariate.loadings(z, names, scores)


@query(ZG.split(", g AS (")[0] + " SELECT feature_id, sample_id, round(z, 5) AS z FROM za")
def m1_cells_of_components(spark: SparkSession, sf: str) -> DataFrame:
    """All components' scores times loadings are the scaled cells again, whatever the signs."""
    z = _scaled(spark, sf)
    names, scores, _ = multivariate.principal_components(multivariate.gram(z), k=20)
    of = spark.createDataFrame([(int(s), f"pc{a + 1}", float(x)) for s, row in zip(names, scores, strict=True) for a, x in enumerate(row)], "sample_id int, component string, score double")
    again = multivariate.loadings(z, names, scores).join(F.broadcast(of), "component").groupBy("feature_id", "sample_id").agg(F.sum(F.col("loading") * F.col("score")).alias("z"))  # a row for each sample and component
    return z.select("feature_id", "sample_id").join(again, ["feature_id", "sample_id"]).select("feature_id", "sample_id", r("z", 5).alias("z"))


@query()
def m1_without_outliers(spark: SparkSession, sf: str) -> DataFrame:
    every, without = multivariate.components_without_outliers(X.intensity(spark, sf), alpha=0.3)
    part = lambda of, name: of.select(F.lit(name).alias("part"), "sample_id", "pc1", "pc2", "pc3")
    return part(every, "all").unionByName(part(without, "without outliers"))


@query(ZG + """, sn AS (SELECT grp, count(*) AS n FROM samples WHERE sample_id IN (SELECT sample_id FROM intensity) GROUP BY grp), w AS (SELECT a.grp, sum(distance ** 2) AS q FROM ds JOIN samples a ON a.sample_id = s1 JOIN samples b ON b.sample_id = s2 WHERE a.grp = b.grp GROUP BY a.grp),
v AS (SELECT sum(q / n) AS ssw FROM w JOIN sn USING (grp)), c AS (SELECT sum(n) AS n, count(*) AS k FROM sn), t AS (SELECT sum(distance ** 2) AS t FROM ds) SELECT round(((t / n - ssw) / (k - 1)) / (ssw / (n - k)), 6) AS f FROM t, v, c""")
def m3_permanova_of_values(spark: SparkSession, sf: str) -> DataFrame:
    """The pseudo-F without distances."""
    return multivariate.permanova_of_values(_scaled(spark, sf), X.samples(spark), 200).select(r("f").alias("f"))


@query(", o AS (SELECT sample_id, sum(value) / 1e6 AS a, count(*)::DOUBLE AS b FROM intensity GROUP BY sample_id), m AS (SELECT avg(a) AS m1, avg(b) AS m2, var_samp(a) AS v1, var_samp(b) AS v2, covar_samp(a, b) AS c FROM o) SELECT sample_id, round((v2 * (a - m1) ** 2 - 2 * c * (a - m1) * (b - m2) + v1 * (b - m2) ** 2) / (v1 * v2 - c * c), 5) AS d2 FROM o CROSS JOIN m")
def m4_squared_distances(spark: SparkSession, sf: str) -> DataFrame:
    of = X.intensity(spark, sf).groupBy("sample_id").agg((F.sum("value") / 1e6).alias("pc1"), F.count("*").cast("double").alias("pc2"))
    return multivariate.mahalanobis_outliers(of).select("sample_id", r("d2", 5).alias("d2"))


def _grouped(spark: SparkSession) -> DataFrame:
    return X.samples(spark).where("NOT is_qc").select("sample_id", "grp")


@query()
def m6_forest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return multivariate.prediction_metrics(multivariate.forest_predictions(_scaled(spark, sf), _grouped(spark), top_ids(spark, sf)))


@query()
def m6_forest_importances(spark: SparkSession, sf: str) -> DataFrame:
    return multivariate.forest_importances(_scaled(spark, sf), _grouped(spark), top_ids(spark, sf))


@query()
def m7_q2(spark: SparkSession, sf: str) -> DataFrame:
    return multivariate.discriminant_q2(multivariate.gram(_scaled(spark, sf)), _grouped(spark))


@query(", o AS (SELECT lipid_class AS grp, ['PC', 'PE', 'TG', 'DG', 'SM', 'Cer', 'CL', 'FA'][(feature_id // 2 + CASE WHEN carbons % 3 = 0 THEN dbe ELSE 0 END) % 8 + 1] AS predicted FROM features), t AS (SELECT grp, count(*) AS n, count(*) FILTER (grp = predicted) AS hit FROM o GROUP BY grp), s AS (SELECT predicted AS grp, count(*) AS said FROM o GROUP BY predicted) SELECT round(sum(hit) / sum(n), 9) AS accuracy, round(avg(2.0 * hit / (n + coalesce(said, 0))), 9) AS macro_f1 FROM t LEFT JOIN s USING (grp)")
def m6_metrics_of_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The measures of predictions that are right for two features of three, and off by the double bonds for the others."""
    guess = F.expr(f"element_at({X._array(X.CLASSES)}, cast((feature_id div 2 + if(carbons % 3 = 0, dbe, 0)) % 8 + 1 AS int))")
    of = multivariate.prediction_metrics(X.features(spark, sf).select(F.col("lipid_class").alias("grp"), guess.alias("predicted")))
    return of.select(r("accuracy", 9).alias("accuracy"), r("macro_f1", 9).alias("macro_f1"))


@query(", f AS (SELECT quantile_cont(value, 0.01) AS p1 FROM cells WHERE value > 0) SELECT feature_id, sample_id, round(log2(value + p1), 9) AS log2_value, round(log10(value + 1), 9) AS log10_value FROM cells CROSS JOIN f")
def p26_logarithms(spark: SparkSession, sf: str) -> DataFrame:
    of = multivariate.log_values(cells(spark, sf)).withColumnRenamed("log_value", "log2_value")
    return multivariate.log_values(of, 10).select("feature_id", "sample_id", r("log2_value", 9).alias("log2_value"), r("log_value", 9).alias("log10_value"))


# Whole flows


def _study(spark: SparkSession, sf: str):  # noqa: ANN202
    """The features of one polarity, taken through all steps; a third of them have no annotation at first."""
    from .plans import flows

    f = X.features(spark, sf).where("polarity = 'Pos'").withColumns({
        "annotation": F.when((F.col("feature_id") % 3 == 0) & ~F.col("is_standard"), "").otherwise(F.col("annotation")), "annotation_type": F.when(F.col("is_standard"), "IS").otherwise("MS/MS match"),
    })
    samples = X.samples(spark)
    of = X.intensity(spark, sf).join(F.broadcast(samples), "sample_id").join(unsent(f.select("feature_id", "lipid_class")), "feature_id")
    study = flows.Study(f, of, samples.groupBy("grp", "is_qc").agg(F.count("*").alias("size")))
    flows.cleanse(study, targets(spark, sf).where("position % 200 = 0"))
    lib = library(spark, sf).withColumn("annotation", F.format_string("PC %d:%d_18:1", 14 + F.col("lib_id") % 8 * 2, F.col("lib_id") % 3))
    windows = spark.createDataFrame([(c, f"{lo}-{hi}C", 0.0, 0.85) for c in X.CLASSES for lo, hi in N.CARBON_BINS[2:-1]], "lipid_class string, carbon_bin string, lo double, hi double")
    ranks = tables.read_adduct_ranks(spark.createDataFrame([(c, "[M+H]+", "[M+Na]+", "[M+NH4]+") for c in X.CLASSES if c != "CL"], "lipid_class string, P0 string, P2 string, P3 string"))
    sensitivities = spark.createDataFrame([("Pos", c, 0.1 * k) for k, c in enumerate(X.CLASSES)], "polarity string, lipid_class string, sensitivity double")
    flows.identify(study, lib, spark.createDataFrame([("PC", "PC")], "headgroup string, lipid_class string"), cutoff=70.0, windows=windows, ranks=ranks, sensitivities=sensitivities)
    flows.collapse(study)
    return flows, study, samples


@query()
def flow_annotated_table(spark: SparkSession, sf: str) -> DataFrame:
    """The final table of a polarity, and what was removed: feature_id, step (kept for what is left), reason (its species)."""
    flows, study, _ = _study(spark, sf)
    flows.finalize(study)
    kept = flows.final_table(study).select("feature_id", F.lit("kept").alias("step"), F.col("species").alias("reason"))
    return kept.unionByName(study.ledger())


@query()
def flow_normalized_cells(spark: SparkSession, sf: str) -> DataFrame:
    flows, study, samples = _study(spark, sf)
    stock = study.features.where("is_standard").select(F.col("feature_id").alias("standard_id"), F.lit(2.5).alias("conc"))
    return flows.normalized(study, samples, stock, 2.0)


SIDES_OF_A_STUDY = SIDES.replace("round(msms_score / 1000, 3) AS quality FROM features", "0.4::DOUBLE * least(1, greatest(0, msms_score / 1000)) + 0.2::DOUBLE * least(1, greatest(0, 1 - msigma / 250)) + 0.2::DOUBLE * least(1, greatest(0, 1 - abs(dmz_ppm) / 5)) + 0.2::DOUBLE * least(1, greatest(0, 1 - (feature_id % 40)::DOUBLE / 30)) AS quality FROM features WHERE dbe < 7")


@query(SIDES_OF_A_STUDY + _elimination_sql().rsplit(" SELECT CASE WHEN", 1)[0] + """, nc AS (SELECT feature_id, count(*) AS n_cells FROM intensity GROUP BY feature_id)
SELECT CASE WHEN polarity = 'Pos' THEN 'P_' ELSE 'N_' END || feature_id AS feature_id, dbe < 7 AS annotated, coalesce(n_cells, 0) AS n_cells FROM features LEFT JOIN nc USING (feature_id) WHERE feature_id NOT IN (SELECT id FROM go) AND (SELECT count(*) FROM x11) + (SELECT count(*) FROM y11) = 0""")
def flow_merged_study(spark: SparkSession, sf: str) -> DataFrame:
    """Both polarities as one study: the better side of what both have, unknown features, and how many cells each has."""
    from .plans import flows

    def one(polarity: str) -> DataFrame:
        more = X.features(spark, sf).select("feature_id", "dbe", "msms_score", "msigma", "dmz_ppm", (F.col("feature_id") % 40).cast("double").alias("qc_rsd"))
        return side(spark, sf, polarity).join(more, "feature_id").withColumn("annotation", F.when(F.col("dbe") < 7, F.col("annotation")).otherwise("unknown"))

    pos, neg = one("Pos"), one("Neg")
    cell = X.intensity(spark, sf)
    of = flows.merge_polarities(pos, neg, *(cell.join(x.select("feature_id"), "feature_id", "left_semi") for x in (pos, neg)))
    counts = of.cells.groupBy("feature_id").agg(F.count("*").alias("n_cells"))
    every = of.known.select("feature_id", F.lit(True).alias("annotated")).unionByName(of.unknown.select("feature_id", F.lit(False).alias("annotated")))
    return every.join(counts, "feature_id", "left").na.fill(0, ["n_cells"])


@query()
def flow_differential_report(spark: SparkSession, sf: str) -> DataFrame:
    """The best hits of all analyses of a study."""
    from .plans import flows

    return flows.differential_report(tested(spark, sf), X.features(spark, sf))["top"]
