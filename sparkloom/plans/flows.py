"""From a polarity's feature table to its final annotated and normalized table, and from there to a differential report.

A flow holds the order of the operators, which matters: quantiles and medians depend on what was removed before. What a
step keeps is written before the next one reads it, so that no step is worked out twice, and what it removes goes to one
ledger of feature_id, step and reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import annotate, clean, composition, merge, normalize, plausibility
from ..operators import group_tests as tests
from ..scale import unsent, written


@dataclass
class Study:
    """Features that are left, and the ledgers of those that are not.

    features: feature_id, polarity, annotation, annotation_type, adduct, lipid_class, carbons, dbe, mz, neutral_mass, rt_min, rt_s, ccs,
    is_standard and more; cells: feature_id, sample_id, value, grp, is_qc, inj_order; groups: grp, size, is_qc.
    """

    features: DataFrame
    cells: DataFrame
    groups: DataFrame
    ledgers: list[DataFrame] = field(default_factory=list)

    def step(self, name: str, flagged: DataFrame) -> None:
        """Keeps the features of a flagged table, with their columns, and notes the others."""
        columns = self.features.columns
        of = written(flagged.select(*columns, "keep", F.coalesce("reason", F.lit(name)).alias("reason")), name)
        self.ledgers.append(of.where("NOT keep").select("feature_id", F.lit(name).alias("step"), "reason"))
        self.features = of.where("keep").select(*columns)

    def only(self, name: str, kept: DataFrame) -> None:
        """Keeps the features whose kept_id is their own."""
        of = self.features.join(unsent(kept), "feature_id", "left").withColumn("keep", F.coalesce(F.col("kept_id") == F.col("feature_id"), F.lit(True)))
        self.step(name, of.withColumn("reason", F.concat(F.lit("same as "), F.col("kept_id").cast("string"))))

    def n_samples(self) -> int:
        """The samples of all groups, QC samples among them."""
        return self.groups.agg(F.sum("size")).first()[0] or 0

    def left(self) -> DataFrame:
        return self.cells.join(unsent(self.features.select("feature_id").distinct()), "feature_id", "left_semi")

    def ledger(self) -> DataFrame:
        return annotate.joined_ledgers(*self.ledgers)


def cleanse(study: Study, contaminants: DataFrame, lowest: float = 4000.0) -> None:
    """F1 to F6, in this order. A study without features or cells stays empty."""
    n_samples = study.n_samples()
    stats = written(clean.group_stats(study.cells), "stats")
    means = written(clean.feature_stats(study.cells).select("feature_id", (n_samples - F.col("n")).alias("n_missing"), "mean"), "means")
    study.step("contaminant", clean.contaminant_filter(study.features, contaminants))
    study.step("flat", clean.flat_filter(study.left(), study.features))
    study.step("repeated mass", clean.repeated_mass_filter(study.features.join(unsent(means), "feature_id", "left")))
    study.step("QC", clean.qc_filter(stats, study.features, study.groups))
    study.step("mean", clean.minimum_filter(study.features.join(unsent(means.select("feature_id", "mean")), "feature_id", "left"), lowest))
    study.step("detection", clean.detection_filter(stats, study.features, study.groups))


def _listed(rows: DataFrame, ranks: DataFrame | None, sensitivities: DataFrame | None) -> DataFrame:
    """F9 and the classes' sensitivity: annotated rows whose adduct is listed, with adduct_penalty and sensitivity; classes are compared in upper case."""
    blank = F.trim(F.coalesce("annotation", F.lit(""))) == ""
    if ranks is None:
        rows = rows.withColumn("adduct_penalty", F.lit(0.0))
    else:
        kept = annotate.whitelist_filter(rows.withColumn("_class", F.col("lipid_class")).withColumn("lipid_class", F.upper("lipid_class")), ranks)
        rows = kept.where(F.col("keep") | blank).withColumn("lipid_class", F.col("_class")).select(*rows.columns, "adduct_penalty")
    if sensitivities is None:
        return rows.withColumn("sensitivity", F.lit(0.0))
    own = sensitivities.select(F.col("polarity").alias("_polarity"), F.upper("lipid_class").alias("_class"), "sensitivity")
    return rows.join(own, (F.col("polarity") == F.col("_polarity")) & (F.upper("lipid_class") == F.col("_class")), "left").drop("_polarity", "_class")


def identify(
    study: Study, library: DataFrame, headgroups: DataFrame, organism: str = "mammalian", cutoff: float = 70.0,
    windows: DataFrame | None = None, ranks: DataFrame | None = None, sensitivities: DataFrame | None = None,
) -> None:
    """Matches are appended, sifted by retention windows and listed adducts, scored and sifted
    again, and the best of a feature stays.

    windows: lipid_class, carbon_bin, lo, hi (F8); ranks: polarity, lipid_class, adduct, rank (F9); sensitivities: polarity, lipid_class,
    sensitivity. A table that is not given filters nothing and costs nothing. Removals before the best is chosen are those of
    rows, of which a feature may have several; a feature is in the ledger if it has no row left. Features without annotation pass.
    """
    before = study.features
    rows = annotate.annotated(before, library, headgroups)
    name = F.col("annotation")
    chains, mods = N.acyls(name), N.modifications(name)
    rows = rows.withColumns({
        "carbons": F.coalesce("carbons", N.total(chains, "carbons")), "dbe": F.coalesce("dbe", N.total(chains, "dbe")), "n_acyls": F.size(chains), "is_plasmenyl": N.is_ether(name), "modifications": mods,
        "n_modifications": N.n_modifications(mods),
    })
    if windows is not None:
        rows = annotate.window_filter(rows, windows).where("keep").select(*rows.columns)
    scored = written(annotate.score(_listed(rows, ranks, sensitivities), organism), "scored")
    blank = F.trim(F.coalesce("annotation", F.lit(""))) == ""
    good = plausibility.plausibility_filter(scored, organism).where("keep").drop("keep", "reasons")
    good = annotate.kendrick_filter(good).where("keep").drop("keep", "reason", "kmd")
    best = annotate.best_annotation(annotate.cutoff_filter(good, cutoff).where("keep").drop("keep", "reason"))
    study.features = written(best.withColumn("annotation", F.when(blank, F.lit("")).otherwise(F.col("annotation"))), "best")
    gone = before.join(unsent(study.features.select("feature_id")), "feature_id", "left_anti")
    study.ledgers.append(gone.select("feature_id", F.lit("annotation").alias("step"), F.lit("implausible or low score").alias("reason")))
    study.step("CCS", annotate.ccs_filter(study.features, "lipid_class", "adduct"))


def collapse(study: Study) -> None:
    """W3, then W2: of what is one feature twice, the better one."""
    of, n_samples = study.left(), study.n_samples()
    spread = of.groupBy("feature_id").agg(
        clean.rsd(F.when(F.col("is_qc"), F.col("value"))).alias("qc_rsd"), clean.rsd(F.when(~F.col("is_qc"), F.col("value"))).alias("sample_rsd"), F.median("value").alias("median"),
        (n_samples - F.count("value")).alias("n_missing"), F.avg("value").alias("mean"))
    spread = written(spread, "spread")
    study.only("correlated", merge.collapse_correlated(study.features.drop(*spread.columns[1:]).join(unsent(spread), "feature_id"), of))
    study.only("adduct", merge.collapse_adducts(study.features.drop(*spread.columns[1:]).join(unsent(spread), "feature_id")))


def normalized(study: Study, samples: DataFrame, stock: DataFrame | None = None, dilution: float | None = None) -> DataFrame:
    """feature_id, sample_id, value of the features that are left. samples: sample_id, grp, is_qc, inj_order.

    With stock (standard_id, conc) values are amounts before they are divided by medians. Without standards nothing can be divided, and no cell is left.
    """
    of = study.features.select("feature_id", "polarity", "lipid_class", "is_standard")
    full = written(normalize.impute_detection_limit(study.left(), samples), "imputed")
    design = F.broadcast(samples.select("sample_id", "is_qc", "inj_order"))  # a row for each sample
    cells = written(full.join(unsent(of), "feature_id").join(design, "sample_id"), "cells")
    standards = cells.where("is_standard").select(F.col("feature_id").alias("standard_id"), "polarity", "sample_id", "value")
    voted = normalize.vote(normalize.choose_standard(cells, standards), of).select("feature_id", F.col("voted_id").alias("standard_id"))
    ratios = normalize.divide_by_standard(cells, voted, standards)
    ratios = written(ratios if stock is None else normalize.semi_quantify(ratios, stock, dilution).select(*ratios.columns), "ratios")
    by_median = normalize.median_normalize(ratios.join(unsent(of), "feature_id"))
    by_class = written(normalize.class_median_normalize(by_median).join(design, "sample_id"), "normalized")
    return normalize.drift_correct(by_class.where("value IS NOT NULL"))


def finalize(study: Study) -> None:
    """the RSDs that are left, standards and unknown features."""
    stats = written(clean.group_stats(study.left()), "stats")
    qc = stats.where("grp = 'QC'").select("feature_id", F.col("n_detected").alias("qc_detected"), F.col("rsd_pct").alias("qc_rsd"))
    own = [c for c in study.features.columns if c not in ("qc_detected", "qc_rsd")]
    study.features = study.features.select(*own)
    study.step("final QC", clean.final_qc_filter(study.features.join(unsent(qc), "feature_id", "left")))
    study.step("final groups", clean.final_group_filter(stats, study.features))
    study.step("report", clean.report_filter(study.features.join(unsent(qc), "feature_id", "left")))


def final_table(study: Study) -> DataFrame:
    """The features that are left, with the species and the level that their names tell."""
    name, head = F.col("annotation"), N.headgroup(F.col("annotation"))
    level = N.annotation_level(N.n_chains(F.col("lipid_class"), head, name), name)
    return study.features.withColumns({"species": N.species_label(head, F.col("carbons"), F.col("dbe"), N.modifications(name), name), "level": level})


@dataclass
class Merged:
    """Both polarities as one table: annotated features, unknown ones, what was removed from which side, and the cells of what is left."""

    known: DataFrame
    unknown: DataFrame
    removed: DataFrame
    cells: DataFrame
    absent: DataFrame


def merge_polarities(pos: DataFrame, neg: DataFrame, pos_cells: DataFrame, neg_cells: DataFrame, best: bool = True, **limits: float) -> Merged:
    """The final tables of both polarities as one study.

    pos, neg: feature_id, annotation, lipid_class, headgroup, level, rt_min, neutral_mass, msms_score, msigma, dmz_ppm, qc_rsd and more;
    cells: feature_id, sample_id, value. Ids get P_ and N_. Annotated features that are found in both polarities keep the better one,
    over any chain of pairs; with best=False all stay. Unknown features all stay. absent: ids of features that have no cell.
    Either side may be empty.
    """
    sides = []
    for df in (pos, neg):
        known, unknown = merge.split_known(df)
        quality = N.quality(F.col("msms_score"), F.col("msigma"), F.col("dmz_ppm"), F.col("qc_rsd"))
        sides.append((written(known.withColumn("quality", quality), "known"), unknown))
    (one, one_unknown), (two, two_unknown) = sides
    needed = ["feature_id", "annotation", "lipid_class", "headgroup", "level", "rt_min", "neutral_mass", "quality"]
    gone = merge.losers(one.select(*needed), two.select(*needed), **limits) if best else None
    if gone is None:
        gone = one.select(F.lit("1").alias("side"), "feature_id").limit(0)
    gone = written(gone, "removed")
    keep = lambda df, k: df.join(gone.where(F.col("side") == k).select("feature_id"), "feature_id", "left_anti")
    known = written(merge.union_polarities(keep(one, "1"), keep(two, "2")), "merged")
    unknown = merge.union_polarities(one_unknown, two_unknown)
    ids = known.select("feature_id").unionByName(unknown.select("feature_id"))
    cells, absent = merge.aligned(merge.union_polarities(pos_cells, neg_cells), ids)
    removed = gone.select(F.when(F.col("side") == "1", "Pos").otherwise("Neg").alias("polarity"), "feature_id")
    return Merged(known, unknown, removed, cells, absent)


def differential_report(cells: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """T9 with T10 and A22, A9, A17 with T8, and W8, of cells without QC samples: tables by name.

    cells: feature_id, sample_id, grp, value, lipid_class; features: feature_id, lipid_class.
    """
    volcano = written(tests.volcano(cells), "volcano")
    table = volcano.join(features.select("feature_id", "lipid_class"), "feature_id")
    totals = written(cells.groupBy("sample_id", "grp", "lipid_class").agg(F.sum("value").alias("value")), "totals")  # a row for each sample and class
    ratios = composition.class_ratios(totals).select("sample_id", "grp", "ratio", F.col("log2_value").alias("value"))
    gates = {k: written(tests.gate(tests.kruskal(of, k), tests.welch(tests.group_moments(of, k), k), k), "gate") for k, of in (("lipid_class", totals), ("ratio", ratios))}
    hit = lambda of, k: of.select(F.col(k).cast("string").alias("id"), F.lit(None).cast("double").alias("effect"), F.col("omnibus_p").alias("p"), F.col("omnibus_fdr").alias("fdr")).distinct()
    best = tests.top_hits({
        "Feature": volcano.select(F.concat_ws(" ", F.col("feature_id").cast("string"), "grp1", "grp2").alias("id"), F.col("log2fc").alias("effect"), "p", "fdr"),
        "Class": hit(gates["lipid_class"], "lipid_class"), "Ratio": hit(gates["ratio"], "ratio"),
    })
    return {"volcano": volcano, "classes": composition.comparison_effects(table), "totals": composition.class_totals(cells), "class_gate": gates["lipid_class"], "ratio_gate": gates["ratio"], "top": best}
