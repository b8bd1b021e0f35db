"""Annotation: exact-mass search, scores, windows and outliers of class trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import acyls, carbon_bin, carbon_ratio, class_of, first_chain, headgroup, is_oxidized, is_polyunsaturated, kendrick_defect, modifications, n_modifications, parity, total
from ..scale import largest_family, percentiles, written
from .clean import flagged

# Masses, and adduct models as (polarity, adduct, molecules, added mass, charge).
H, NH4, NA, NA2H, FORMATE, OH = 1.007825, 18.033823, 22.989769, 44.971714, 44.998201, 17.002740
ADDUCT_MODELS = (
    ("Pos", "[M+H]+", 1, H, 1), ("Pos", "[M+NH4]+", 1, NH4, 1), ("Pos", "[M-H2O+H]+", 1, -OH, 1), ("Pos", "[M+Na]+", 1, NA, 1),
    ("Pos", "[M+2Na-H]+", 1, NA2H, 1), ("Pos", "[2M+H]+", 2, H, 1), ("Pos", "[3M+H]+", 3, H, 1), ("Pos", "[2M+NH4]+", 2, NH4, 1),
    ("Pos", "[3M+NH4]+", 3, NH4, 1), ("Pos", "[2M+Na]+", 2, NA, 1), ("Pos", "[3M+Na]+", 3, NA, 1), ("Pos", "[2M+2Na-H]+", 2, NA2H, 1),
    ("Pos", "[M+2H]2+", 1, 2 * H, 2), ("Pos", "[M+2NH4]2+", 1, 2 * NH4, 2), ("Neg", "[M-H]-", 1, -H, -1), ("Neg", "[M+HCOO]-", 1, FORMATE, -1),
    ("Neg", "[2M-H]-", 2, -H, -1), ("Neg", "[2M+HCOO]-", 2, FORMATE, -1), ("Neg", "[3M-H]-", 3, -H, -1), ("Neg", "[3M+HCOO]-", 3, FORMATE, -1),
    ("Neg", "[M-2H]2-", 1, -2 * H, -2), ("Neg", "[M+2HCOO]2-", 1, 2 * FORMATE, -2),
)


def theoretical_mz(library: DataFrame) -> DataFrame:
    """The m/z of each library mass with each adduct. library: (lib_id, neutral_mass)."""
    models = library.sparkSession.createDataFrame(ADDUCT_MODELS, "polarity string, adduct string, molecules int, added double, charge int")
    mz = (F.col("molecules") * F.col("neutral_mass") + F.col("added")) / F.abs("charge")
    return library.crossJoin(F.broadcast(models)).select("lib_id", "polarity", "adduct", mz.alias("theo_mz"))  # 22 models


#: Matches of a mass in a part, and matches of a task.
_PART, _MATCHES = 256, 1_000_000


def mass_search(features: DataFrame, library: DataFrame, da: float = 0.003, ppm: float = 3.0) -> DataFrame:
    """feature_id, lib_id, adduct, theo_mz, delta, ppm for each library mass and adduct within both tolerances.

    A range join as an equi-join: masses go to buckets twice as wide as the reach, and a feature's mass to the one or two
    buckets that its reach touches. Each mass is looked up once, however many features have it.
    """
    of = _with_matches(features.select("feature_id", "polarity", "mz"), _matches(features, library, da, ppm))
    return of.select("feature_id", "lib_id", "adduct", "theo_mz", "delta", "ppm")


def _matches(features: DataFrame, library: DataFrame, da: float, ppm: float) -> DataFrame:
    """polarity, mz, lib_id, adduct, theo_mz, delta, ppm for each mass of the features."""
    width = 2 * da
    theory = theoretical_mz(library).withColumn("bucket", F.floor(F.col("theo_mz") / width))
    lo, hi = F.floor((F.col("mz") - da) / width), F.floor((F.col("mz") + da) / width)
    probe = features.select("polarity", "mz").distinct().withColumn("bucket", F.explode(F.array_distinct(F.array(lo, hi))))
    delta = F.col("mz") - F.col("theo_mz")
    of = probe.join(theory, ["polarity", "bucket"]).withColumn("delta", delta).withColumn("ppm", F.abs(F.col("delta")) / F.col("theo_mz") * 1e6)
    return of.where((F.abs("delta") <= da) & (F.col("ppm") <= ppm)).select("polarity", "mz", "lib_id", "adduct", "theo_mz", "delta", "ppm")


def _with_matches(features: DataFrame, matches: DataFrame) -> DataFrame:
    """features, which have no other columns of the matches, a row for each match of their mass. A mass's matches are cut in parts of about _PART, which its features all meet, and
    tasks are as many as the matches need: both sides are small beside what they make, so their size tells nothing."""
    mass = ["polarity", "mz"]
    matches = written(matches, "matches")  # read three times below
    sizes = written(matches.groupBy(*mass).agg(F.count("*").alias("_n")).withColumn("_mass", F.monotonically_increasing_id()), "masses")
    total = features.join(sizes, mass).agg(F.sum("_n")).first()[0] or 0
    tasks, key, parts = int(min(2_000, 1 + total // _MATCHES)), ["_mass", "_part"], sizes.select(*mass, "_mass", F.ceil(F.col("_n") / _PART).alias("_parts"))
    even = lambda df: df.repartition(tasks, *key) if tasks > 1 else df
    left = even(features.join(parts, mass).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts"))
    right = even(matches.join(parts, mass).withColumn("_part", F.pmod(F.xxhash64("lib_id", "adduct"), F.col("_parts"))).drop("_parts", *mass))
    return left.join(right.hint("merge"), key).drop(*key)


def window_filter(features: DataFrame, windows: DataFrame) -> DataFrame:
    """F8: annotated features outside the window of their class and carbon bin, or without one. windows: (lipid_class, carbon_bin, lo, hi)."""
    near = windows.select(F.upper("lipid_class").alias("_class"), F.upper("carbon_bin").alias("_bin"), "lo", "hi")
    of = features.withColumn("_own", F.upper(carbon_bin(F.col("carbons")))).join(near, (F.upper("lipid_class") == F.col("_class")) & (F.col("_own") == F.col("_bin")), "left")
    inside = F.coalesce(F.col("rt_min").between(F.col("lo"), F.col("hi")), F.lit(False))
    return flagged(of, ~inside & (F.coalesce("annotation", F.lit("")) != ""), "outside the retention window").drop("_class", "_bin", "_own", "lo", "hi")


def whitelist_filter(features: DataFrame, ranks: DataFrame) -> DataFrame:
    """the adduct's penalty by its rank (0 to 4) for class and polarity; adducts that are not listed are removed."""
    of = features.join(ranks, ["polarity", "lipid_class", "adduct"], "left").withColumn("adduct_penalty", F.coalesce(F.col("rank") * F.lit(0.25), F.lit(1.0)))
    return flagged(of, F.col("rank").isNull(), "adduct not listed")


# Steps of the mass-error penalty, classes by what is added to the sensitivity penalty (upper case).
MZ_STEPS = ((0.8, 0.0), (1.6, 0.2), (2.4, 0.4), (3.2, 0.6), (4.0, 0.8))
# The classes stand in upper case, as they are compared; mixed-case ones can't be met so and are left out.
RARE = {
    0.9: ("DGTA", "PGS", "PT", "NAPE", "SLBPA", "PPA", "LSM", "PGP", "DGTS", "GP", "DGMG", "MGMG", "DGCC"),
    0.75: ("SQDG", "DGDG", "SQMG", "SPBP", "PIP"),
    0.5: ("FAG", "NAT"),
    0.25: ("CDP-DG", "LPG", "MGDG", "LPI"),
    0.1: ("LPIM", "LPA", "NAE", "LPS", "MG", "SPB", "TG", "FA", "PK", "ST"),
}
UNCOMMON = {
    "mammalian": {
        0.9: ("WE", "WD", "FAL", "FOH", "PK", "PR", "SL", "GP", "DGTS", "NAT", "SQDG", "SMGDG", "MIPC", "HC", "LSM", "CDP-DG", "DGCC", "MGMG", "DGMG", "MGDG", "DGDG", "PIM", "HBMP", "NAE", "PIP"),
        0.8: ("LPA", "LPS", "LPI", "NA", "SPB", "ST"),
    },
    "bacterial": {
        0.9: ("WE", "FAL", "FOH", "PK", "GP", "DGTS", "NAT", "SQDG", "SMGDG", "MIPC", "HC", "LSM", "DGCC", "MGMG", "DGMG", "MGDG", "DGDG", "PIM", "HBMP", "NAE", "PIP"),
        0.8: ("LPS", "LPI", "NA", "SPB", "ST", "PC", "TG"),
        0.35: ("PS", "PI", "LPA"),
        0.2: ("BMP", "CAR", "MG"),
    },
    "fungal": {
        0.9: ("WE", "FAL", "FOH", "PK", "PR", "SL", "GP", "DGTS", "NAT", "SQDG", "SMGDG", "MIPC", "HC", "LSM", "CDP-DG", "DGCC", "MGMG", "DGMG", "MGDG", "DGDG", "PIM", "HBMP", "NAE", "PIP"),
        0.8: ("LPA", "LPS", "LPI", "NA", "SPB", "ST"),
        0.35: ("PS", "PI"),
    },
}
WEIGHTS = {"adduct": 1.0, "mz_error": 1.0, "ratio": 1.0, "parity": 1.0, "modifications": 1.0, "plasmenyl": 6.0, "sensitivity": 1.0, "acyls": 1.0, "abbreviation": 10.0}


def _first(value: Column, steps: dict[float, tuple[str, ...]], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for score, names in reversed(steps.items()):
        out = F.when(value.isin(*names), F.lit(score)).otherwise(out)
    return out


def mz_error_penalty(ppm: Column) -> Column:
    out = F.lit(1.0)
    for limit, penalty in reversed(MZ_STEPS):
        out = F.when(ppm <= limit, F.lit(penalty)).otherwise(out)
    return F.when(ppm.isNull(), F.lit(1.0)).otherwise(out)


def sensitivity_penalty(base: Column, lipid_class: Column, organism: str) -> Column:
    name = F.upper(F.trim(lipid_class))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(base, F.lit(1.0)) + _first(name, RARE, 0.0) + _first(name, UNCOMMON[organism], 0.0)))


def penalties(organism: str = "mammalian") -> dict[str, Column]:
    """the parts of an annotation's penalty, over adduct_penalty, dmz_ppm, sensitivity, lipid_class, carbons, dbe,
    n_acyls, is_plasmenyl, n_modifications, modifications and annotation."""
    c, d, n, mods = F.col("carbons"), F.col("dbe"), F.col("n_acyls"), F.coalesce("modifications", F.lit(""))
    ratio = c / F.nullif(d, F.lit(0))
    odd_elements = "S|Br|Cl|As|Si|F|I|T|G" + ("|Gly|Leu" if organism == "bacterial" else "")
    words = "medication|contaminant" + ("|plant" if organism == "bacterial" else "")
    plausible = ((F.col("lipid_class") == "FA") & c.between(14, 20)) | ((n == 2) & c.between(28, 48)) | ((n == 3) & c.between(41, 60)) | ((n == 4) & c.between(56, 76))
    name = F.coalesce("annotation", F.lit(""))
    return {
        "mz_error": mz_error_penalty(F.col("dmz_ppm")),
        "adduct": F.coalesce("adduct_penalty", F.lit(1.0)),
        "sensitivity": sensitivity_penalty(F.col("sensitivity"), F.col("lipid_class"), organism),
        "parity": F.when(c % 2 == 0, 0.0).otherwise(1.0),
        "plasmenyl": F.when(F.col("is_plasmenyl"), 1.0).otherwise(0.0),
        "modifications": F.when(F.coalesce("n_modifications", F.lit(0)) == 0, 0.0).when(mods.rlike(odd_elements) | name.rlike(words), 1.0).otherwise(F.least(F.lit(1.0), F.col("n_modifications") / F.lit(6.0))),
        "ratio": F.when(ratio.between(8, 36), 0.0).when((ratio >= 3.5) & (ratio < 8), 0.5).otherwise(1.0),
        "acyls": F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).when(plausible, 0.0).otherwise(0.5),
        "abbreviation": F.when(F.upper(name).contains("NOABBR"), 1.0).otherwise(0.0),
    }


def score(features: DataFrame, organism: str = "mammalian", weights: dict[str, float] | None = None) -> DataFrame:
    """100 less the weighted penalties, 0 at least, and the penalties as a map."""
    w = WEIGHTS | (weights or {})
    parts = {k: F.lit(w[k]) * v for k, v in penalties(organism).items()}
    of = features.withColumn("penalties", F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v))))
    return of.withColumn("score", F.greatest(F.lit(0.0), 100 - sum((F.col("penalties")[k] for k in parts), F.lit(0.0))))


def kendrick_filter(features: DataFrame, tolerance: float = 0.95, least: int = 7) -> DataFrame:
    """features whose Kendrick defect is off their class's median; classes of up to six features pass, and rows without a class.

    A feature without a mass is removed if its class has a median. An empty table stays empty.
    """
    of = features.withColumn("kmd", kendrick_defect(F.col("neutral_mass")))
    sizes = of.groupBy("lipid_class").agg(F.count("kmd").alias("size"))
    mids = percentiles(of, "kmd", {"mid": 0.5}, "lipid_class").join(sizes, "lipid_class")  # a row for each class
    far = (F.col("size") >= least) & (F.coalesce(F.abs(F.col("kmd") - F.col("mid")), F.lit(float("inf"))) > tolerance)
    return flagged(of.join(F.broadcast(mids), "lipid_class", "left"), far, "Kendrick defect").drop("mid", "size")


def cutoff_filter(features: DataFrame, lowest: float = 70.0) -> DataFrame:
    """annotated features with a score under the lowest."""
    return flagged(features, (F.coalesce("annotation", F.lit("")) != "") & (F.col("score") < lowest), "low score")


def ccs_filter(features: DataFrame, *key: str, scaled: bool = True, far: float = 2.0, limit: float = 15.0, least: int = 12, floor: float = 0.75, library: DataFrame | None = None, least_library: int = 6) -> DataFrame:
    """Features whose collision cross section is off the line over carbons of their class (and adduct).

    A line by least squares for each key of `least` features or more, then robust z of the residuals from their median and
    MAD: removed if the residual is over `far` and z at least `limit`. Not scaled (F16): if the distance from the median
    is over `limit` times the MAD. Standards are spared. library: measured rows (key, carbons, ccs); where a key has
    `least_library` of them, the line is theirs.
    """
    line = features.groupBy(*key).agg(F.regr_slope("ccs", "carbons").alias("slope"), F.regr_intercept("ccs", "carbons").alias("at0"), F.count("ccs").alias("size"))
    if library is not None:
        measured = library.where("ccs IS NOT NULL AND carbons IS NOT NULL").groupBy(*key).agg(F.regr_slope("ccs", "carbons").alias("_b"), F.regr_intercept("ccs", "carbons").alias("_a"), F.count("*").alias("_n")).where(F.col("_n") >= least_library)
        line = line.join(measured, list(key), "left").select(*key, F.when(F.col("_n").isNotNull(), F.col("_b")).otherwise(F.col("slope")).alias("slope"), F.when(F.col("_n").isNotNull(), F.col("_a")).otherwise(F.col("at0")).alias("at0"), "size")
    of = features.join(F.broadcast(line), list(key), "left").withColumn("residual", F.col("ccs") - (F.col("slope") * F.col("carbons") + F.col("at0")))
    largest = largest_family(features, *key)
    of = of.join(F.broadcast(percentiles(of, "residual", {"mid": 0.5}, *key, largest=largest)), list(key), "left").withColumn("off", F.abs(F.col("residual") - F.col("mid")))
    of = of.join(F.broadcast(percentiles(of, "off", {"mad": 0.5}, *key, largest=largest)), list(key), "left")
    if scaled:
        of = of.withColumn("robust_z", F.col("off") / F.greatest(F.lit(floor), F.lit(1.4826) * F.col("mad")))
        remove = (F.abs("residual") > far) & (F.col("robust_z") >= limit)
    else:
        of = of.withColumn("robust_z", F.col("off") / F.nullif("mad", F.lit(0.0)))
        remove = F.col("robust_z") > limit
    return flagged(of, (F.col("size") >= least) & remove & ~F.col("is_standard"), "CCS off its class").drop("slope", "at0", "size", "mid", "off", "mad")


def best_annotation(features: DataFrame) -> DataFrame:
    """One row for each feature_id: annotated first, standards, MS/MS, MS, others, then the score; null ids all stay."""
    kind = F.col("annotation_type")
    priority = F.when(kind == "IS", 0).when(kind == "MS/MS match", 1).when(kind == "MS match", 2).otherwise(3)
    order = [(F.coalesce("annotation", F.lit("")) == "").asc(), priority, F.col("score").desc_nulls_last(), "annotation"]
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy(*order))
    named = features.where("feature_id IS NOT NULL").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return named.unionByName(features.where("feature_id IS NULL"))


def with_class(features: DataFrame, headgroups: DataFrame, searched: bool = False) -> DataFrame:
    """Features with lipid_class by their headgroup. headgroups: (headgroup, lipid_class), of which one row of a headgroup counts."""
    known = headgroups.groupBy(F.trim("headgroup").alias("_head")).agg(F.min("lipid_class").alias("_class"))
    of = features.drop("lipid_class").join(known, F.trim("headgroup") == F.col("_head"), "left")
    name = F.coalesce("annotation", F.lit("")) if searched else None
    return of.withColumn("lipid_class", class_of(F.col("headgroup"), F.col("_class"), name)).drop("_head", "_class")


def counts_from_names(features: DataFrame, column: str, part: int, text: str = "annotation", coverage: float | None = 0.05) -> DataFrame:
    """A column of carbons (part 1) or double bonds (part 2), filled from the text where under `coverage` of the rows have it; always if that is None."""
    filled = F.coalesce(F.col(column).cast("double"), first_chain(F.col(text), part))
    if coverage is None:
        return features.withColumn(column, filled)
    share = features.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("_share"))
    return features.crossJoin(F.broadcast(share)).withColumn(column, F.when(F.col("_share") < coverage, filled).otherwise(F.col(column).cast("double"))).drop("_share")  # one row


#: Types of annotation that a search never overwrites.
KEPT_TYPES = ("IS", "MS/MS match", "Target list")


def annotated(features: DataFrame, library: DataFrame, headgroups: DataFrame, da: float = 0.003, ppm: float = 3.0) -> DataFrame:
    """Features, and a row more for each match of one without an annotation, with what the library's name says.

    features: feature_id, polarity, mz, annotation, annotation_type, ...; library: lib_id, annotation, neutral_mass; headgroups: as in
    with_class. A match has the library's name, mass and adduct, its parts by P2 to P9, and the type `MS match`, unless
    its feature's type is kept. Originals stay as they are; other columns are those of the feature.
    """
    blank = F.trim(F.coalesce("annotation", F.lit(""))) == ""
    named = library.select("lib_id", F.col("annotation").alias("_name"), F.col("neutral_mass").alias("_mass"))
    name = F.coalesce("_name", F.lit(""))
    chains, mods = acyls(name), modifications(name)
    c, d = total(chains, "carbons"), total(chains, "dbe")
    # What a name says is made once for each library row, not for each match.
    said = named.select("lib_id", "_mass", name.alias("annotation"), headgroup(name).alias("headgroup"), c.alias("carbons"), d.alias("dbe"), mods.alias("modifications"), n_modifications(mods).alias("n_modifications"),
                        parity(c).alias("parity"), is_polyunsaturated(d).alias("is_pufa"), carbon_ratio(c, d).alias("carbon_ratio"))
    said = with_class(said, headgroups, searched=True).withColumn("is_oxidized", is_oxidized(F.col("modifications"), F.col("lipid_class")))
    said = said.withColumnsRenamed({"_mass": "neutral_mass"})
    probe = features.where(blank)
    hits = _matches(probe, library, da, ppm).withColumns({"dmz_mda": F.col("delta") * 1000, "dmz_ppm": F.col("delta") / F.col("theo_mz") * 1e6})
    hits = hits.join(said, "lib_id").withColumn("annotation_source", F.lit("library")).drop("theo_mz", "delta", "ppm")
    rest = [x for x in probe.columns if x in ("polarity", "mz") or x not in hits.columns]
    new = _with_matches(probe.select(*rest), hits).drop("lib_id")
    kept = F.coalesce(F.col("annotation_type").isin(*KEPT_TYPES), F.lit(False))
    new = new.withColumn("annotation_type", F.when(kept, F.col("annotation_type")).otherwise("MS match"))
    return features.unionByName(new, allowMissingColumns=True)


def joined_ledgers(*ledgers: DataFrame) -> DataFrame:
    """U4: one ledger of all removals, feature_id, step and reason, each once."""
    out = ledgers[0].select("feature_id", "step", "reason")
    for more in ledgers[1:]:
        out = out.unionByName(more.select("feature_id", "step", "reason"))
    return out.distinct()


def attach(table: DataFrame, meta: DataFrame, position: str, key: str = "feature_id") -> DataFrame:
    """The metadata's columns and then the table's, of each of the table's rows; of metadata rows with one key the first by position.

    A column of both is the metadata's; keys that it lacks have nulls.
    """
    columns = [c for c in meta.columns if c not in (key, position)]
    first = meta.groupBy(key).agg(F.min_by(F.struct(*columns), position).alias("_meta"))
    rest = [c for c in table.columns if c != key and c not in columns]
    return table.select(key, *rest).join(first, key, "left").select(key, *(F.col(f"_meta.{c}").alias(c) for c in columns), *rest)
