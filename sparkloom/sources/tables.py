"""Reading feature tables and reference lists, and writing stages and ledgers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scale import ranged

_DROPPED = ("Flags", "Boxplot", "AQ")
_MISSING = ("", "nan", "na", "n/a", "none", "null")


#: Types of a feature table's columns, by their names there and here; sample columns are numbers, and others texts.
TYPES = {
    "long": ("UniqueID", "feature_id"),
    "integer": ("carbons", "dbe", "n_modifications", "# of modifications", "Number of carbons in fatty acyls", "Double bond equivalents"),
    "double": ("RT (min)", "m/z", "Neutral mass", "Δm/z (mDa)", "Δm/z (ppm)", "MS/MS score", "mSigma", "CCS (Å²)", "rt_min", "rt_s", "mz", "neutral_mass", "dmz_mda", "dmz_ppm", "msms_score", "msigma", "ccs"),
    "boolean": ("is_standard", "is_pufa", "is_plasmenyl", "is_oxidized"),
}


def feature_schema(columns: list[str], pattern: str = r"^[PN]_") -> StructType:
    """The types of a feature table's columns."""
    kinds = {name: kind for kind, names in TYPES.items() for name in names}
    out = StructType()
    for c in columns:
        out.add(c, kinds.get(c, "double" if re.match(pattern, c) else "string"))
    return out


def read_features(spark: SparkSession, path: str, key: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A wide feature table from Parquet or CSV. Without an id of its own, rows are numbered by the key's order.

    A CSV's types are the schema's, or those that its columns' names tell, of which only the header is read beforehand; a field that is
    not of its column's type (blank, NA) is null. An empty table stays empty.
    """
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        types = schema or feature_schema(spark.read.csv(path, header=True).columns)
        df = spark.read.csv(path, header=True, schema=types, mode="PERMISSIVE", nanValue="NaN")
    df = df.drop(*_DROPPED)
    if "feature_id" in df.columns:
        return df
    if key is None:
        raise ValueError("a table without feature_id needs a key to number its rows by")
    # Ranges of the key, which are written, are numbered in parallel, each from where those before it end.
    parts = ranged(df, key)
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row for each range
    return inside.join(F.broadcast(before), "_part").withColumn("feature_id", F.col("_at") + F.coalesce("before", F.lit(0))).drop("_part", "_at", "before")


def known(column: str) -> Column:
    """A number, or null for blanks, NA and NaN."""
    text = F.trim(F.col(column).cast("string"))
    number = F.when(~F.lower(text).isin(*_MISSING), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def to_long(wide: DataFrame, ids: list[str], pattern: str = r"^[PN]_") -> DataFrame:
    """Sample columns (by their names' prefix) as rows: ids, sample_id, value; missing values are left out."""
    names = [c for c in wide.columns if re.match(pattern, c) and c not in ids]
    plain = wide.select(*ids, *(known(c).alias(c) for c in names))
    return plain.unpivot(ids, names, "sample_id", "value").where("value IS NOT NULL") if names else plain.select(*ids, F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("double").alias("value")).limit(0)


def to_wide(cells: DataFrame, samples: list[str]) -> DataFrame:
    """S3: a column for each of the given samples."""
    return cells.groupBy("feature_id").pivot("sample_id", samples).agg(F.first("value"))


def to_samples(cells: DataFrame, block: int = 1000) -> DataFrame:
    """S3: sample_id, block, features: samples by features, in blocks of so many ids, each a map from feature_id to value."""
    of = cells.groupBy("sample_id", F.floor(F.col("feature_id") / block).alias("block"))
    return of.agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("features"))


def read_groups(df: DataFrame, sample: str = "Sample", group: str = "Group", position: str | None = None) -> DataFrame:
    """Trimmed samples and groups, is_qc, is_blank and a key to match by; of a sample's rows the first stays, by the
    column that tells their order, or by group without one."""
    place = F.col(position or group)
    of = df.select(F.trim(sample).alias("sample_id"), F.trim(group).alias("grp"), place.alias("_place")).where("sample_id <> ''")
    one = of.groupBy("sample_id").agg(F.min_by("grp", F.struct("_place", "grp")).alias("grp"))
    return one.select("sample_id", "grp", F.lower("sample_id").alias("match_key"), (F.lower("grp") == "qc").alias("is_qc"), F.lower("grp").contains("blank").alias("is_blank"))


def read_contaminants(df: DataFrame) -> DataFrame:
    """Name, target, polarity (Pos or Neg), position; rows without a mass or polarity are left out."""
    p = F.lower(F.trim(F.col("polarity").cast("string")))
    polarity = F.when(p.isin("pos", "positive", "+", "1"), "Pos").when(p.isin("neg", "negative", "-", "-1"), "Neg")
    return df.select("name", F.col("mz").try_cast("double").alias("target"), polarity.alias("polarity"), F.col("position")).where("target IS NOT NULL AND polarity IS NOT NULL")


def read_adduct_ranks(df: DataFrame) -> DataFrame:
    """(polarity, lipid_class, adduct, rank) from columns P0..P4 and N0..N4 of comma lists; the last rank of an adduct counts."""
    names = [c for c in df.columns if re.fullmatch(r"[PN][0-4]", c)]
    long = df.select(F.upper(F.trim("lipid_class")).alias("lipid_class"), *names).unpivot(["lipid_class"], names, "place", "adducts").where("adducts IS NOT NULL")
    each = long.select("lipid_class", F.when(F.col("place").startswith("P"), "Pos").otherwise("Neg").alias("polarity"), F.substring("place", 2, 1).cast("int").alias("rank"), F.explode(F.split("adducts", r"\s*,\s*")).alias("adduct"))
    return each.where("trim(adduct) <> ''").groupBy("polarity", "lipid_class", F.trim("adduct").alias("adduct")).agg(F.max("rank").alias("rank"))


def read_sensitivity(df: DataFrame, positive: str, negative: str) -> DataFrame:
    """(lipid_class, polarity, sensitivity) from a column for each polarity; what is no number is left out."""
    of = df.select(F.upper(F.trim("lipid_class")).alias("lipid_class"), known(positive).alias("Pos"), known(negative).alias("Neg"))
    return of.unpivot(["lipid_class"], ["Pos", "Neg"], "polarity", "sensitivity").where("sensitivity IS NOT NULL")


def read_windows(groups: DataFrame, windows: DataFrame) -> DataFrame:
    """(lipid_class, carbon_bin, lo, hi). groups: lipid_class and a group id for each bin (0 for none); windows: group_id, lo, hi."""
    bins = [c for c in groups.columns if c != "lipid_class"]
    of = groups.select("lipid_class", *(F.col(f"`{b}`").cast("int").alias(b) for b in bins)).unpivot(["lipid_class"], bins, "carbon_bin", "group_id").where("group_id > 0")
    return of.join(windows, "group_id").select(F.upper("lipid_class").alias("lipid_class"), F.upper("carbon_bin").alias("carbon_bin"), "lo", "hi")


def read_class_standards(df: DataFrame, surviving: DataFrame, columns: list[str]) -> DataFrame:
    """(lipid_class, polarity, pref, is_name) of the standards that survive, in the columns' order."""
    each = df.select("lipid_class", "polarity", F.posexplode(F.array(*columns)).alias("pref", "is_name")).where("is_name IS NOT NULL AND trim(is_name) <> ''")
    return each.join(surviving, "is_name", "left_semi").select("lipid_class", "polarity", "pref", "is_name")


def read_headgroups(df: DataFrame) -> DataFrame:
    """(headgroup, lipid_class) from all columns but the first, lipid_class."""
    names = [c for c in df.columns if c != "lipid_class"]
    return df.unpivot(["lipid_class"], names, "_", "headgroup").where("trim(headgroup) <> ''").select(F.trim("headgroup").alias("headgroup"), "lipid_class").distinct()


def write_stage(df: DataFrame, path: str, *by: str) -> None:
    """A stage's table or ledger, partitioned on disk."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def variant(cells: DataFrame, with_qc: bool = False, groups: list[str] | None = None, high_confidence: bool = False) -> DataFrame:
    """Cells without QC samples, of chosen groups, of high-confidence features only."""
    of = cells if with_qc else cells.where("NOT is_qc")
    of = of.where(F.col("grp").isin(*groups)) if groups else of
    return of.where(F.lower("annotation_tier").contains("high")) if high_confidence else of
