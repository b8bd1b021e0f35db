"""Feature-table relations derived from the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("PC", "PE", "TG", "DG", "SM", "Cer", "CL", "FA")
POSITIVE_ADDUCTS = ("[M+H]+", "[M+Na]+", "[M+NH4]+")
NEGATIVE_ADDUCTS = ("[M-H]-", "[M+HCOO]-", "[M-H2O-H]-")
GROUPS = ("QC", "A", "B", "C")


def _array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each feature: names, masses, retention time and annotation scores."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").withColumn("h", F.expr("p_partkey div 2"))
    named = part.selectExpr(
        "p_partkey AS feature_id",
        "if(p_partkey % 2 = 0, 'Pos', 'Neg') AS polarity",
        f"element_at({_array(CLASSES)}, cast(h % 8 + 1 AS int)) AS lipid_class",
        "cast(12 + (p_partkey div 3) % 44 AS int) AS carbons",
        "cast((p_partkey div 5) % 8 AS int) AS dbe",
        "cast((p_size % 10) * 6 AS double) AS rt_s",
        "(p_size % 10) * 6 / 60.0D AS rt_min",
        "900 + (h % 500) / 10.0D AS neutral_mass",
        f"if(p_partkey % 2 = 0, element_at({_array(POSITIVE_ADDUCTS)}, cast(h % 3 + 1 AS int)), element_at({_array(NEGATIVE_ADDUCTS)}, cast(h % 3 + 1 AS int))) AS adduct",
        "cast((h * 37) % 900 AS double) AS msms_score",
        "cast(h % 11 - 5 AS double) AS dmz_ppm",
        "cast(h % 250 AS double) AS msigma",
        "200 + 2 * (12 + (p_partkey div 3) % 44) + (h % 7) * 1.0D AS ccs",
        "p_partkey % 97 = 0 AS is_standard",
    )
    return named.selectExpr(
        "*",
        "concat(if(is_standard, '[D7]', ''), lipid_class, ' ', carbons, ':', dbe) AS annotation",
        "neutral_mass + if(polarity = 'Pos', 1.007825D, -1.007825D) AS mz",
    )


def samples(spark: SparkSession) -> DataFrame:
    """Twenty samples in four groups of five; QC is one of them."""
    return spark.range(20).selectExpr("cast(id AS int) AS sample_id", f"element_at({_array(GROUPS)}, cast(id % 4 + 1 AS int)) AS grp", "cast(id AS double) AS inj_order", "id % 4 = 0 AS is_qc", "if(id < 10, 'b1', 'b2') AS batch")


def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, sample_id, value: one row for each cell that is present. Cells are placed by feature, so that what groups by it needs no other shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_extendedprice")
    lines = lines.select(F.col("l_partkey").alias("feature_id"), (F.col("l_suppkey") % 20).cast("int").alias("sample_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    cents = lines.repartition("feature_id").groupBy("feature_id", "sample_id").agg(F.sum("cents").alias("cents"))
    return cents.select("feature_id", "sample_id", (F.col("cents") / F.lit(100.0)).alias("value"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same three relations for DuckDB, to stand at the head of a query.
SQL = f"""
WITH RECURSIVE p0 AS (SELECT p_partkey, p_size, p_partkey // 2 AS h FROM part),
p1 AS (SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 2 = 0 THEN 'Pos' ELSE 'Neg' END AS polarity,
  ({_list(CLASSES)})[h % 8 + 1] AS lipid_class, (12 + (p_partkey // 3) % 44)::INT AS carbons, ((p_partkey // 5) % 8)::INT AS dbe,
  ((p_size % 10) * 6)::DOUBLE AS rt_s, (p_size % 10) * 6 / 60.0::DOUBLE AS rt_min, 900 + (h % 500) / 10.0::DOUBLE AS neutral_mass,
  CASE WHEN p_partkey % 2 = 0 THEN ({_list(POSITIVE_ADDUCTS)})[h % 3 + 1] ELSE ({_list(NEGATIVE_ADDUCTS)})[h % 3 + 1] END AS adduct,
  ((h * 37) % 900)::DOUBLE AS msms_score, (h % 11 - 5)::DOUBLE AS dmz_ppm, (h % 250)::DOUBLE AS msigma,
  (200 + 2 * (12 + (p_partkey // 3) % 44) + (h % 7))::DOUBLE AS ccs, p_partkey % 97 = 0 AS is_standard FROM p0),
features AS (SELECT *, CASE WHEN is_standard THEN '[D7]' ELSE '' END || lipid_class || ' ' || carbons || ':' || dbe AS annotation,
  neutral_mass + CASE WHEN polarity = 'Pos' THEN 1.007825::DOUBLE ELSE -1.007825::DOUBLE END AS mz FROM p1),
samples AS (SELECT i::INT AS sample_id, ({_list(GROUPS)})[i % 4 + 1] AS grp, i::DOUBLE AS inj_order, i % 4 = 0 AS is_qc,
  CASE WHEN i < 10 THEN 'b1' ELSE 'b2' END AS batch FROM range(20) t(i)),
intensity AS (SELECT l_partkey AS feature_id, (l_suppkey % 20)::INT AS sample_id, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS value
  FROM lineitem GROUP BY 1, 2),
cells AS (SELECT i.feature_id, i.sample_id, i.value, s.grp, s.is_qc, f.lipid_class, f.polarity, f.carbons, f.dbe, f.is_standard
  FROM intensity i JOIN samples s USING (sample_id) JOIN features f USING (feature_id))
"""


#: Names as they come: ethers, several chains, modifications, deuterium tags, marks of positions, blanks and nothing.
NAMES = (
    "concat('PC ', c1, ':', d1, '_', c2, ':', d2)", "concat('PE O-', c1, ':', d1, '_', c2, ':', d2)", "concat('[D7]PC ', c1, ':', d1, '_18:1')", "concat('Cer ', c1, ':', d1, ';O2/', c2, ':0')",
    "concat('  FA ', c1, ':', d1, ';O', 1 + d2, '  ')", "concat('CL ', c1, ':', d1, '_18:2_16:0_', c2, ':', d2)", "concat('TG ', c1, ':', d1, '_16:0_', c2, ':', d2, '-SN1')",
    "'cholestenone'", "concat('ST ', c1, ':', d1, ';2OH;OOH')", "''", "cast(null as {text})", "concat('SM ', c1 + c2, ':', d1, ';O2')", "'unknown'",
)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, name, lipid_class: names of all kinds, by the feature's number."""
    cases = " ".join(f"WHEN {k} THEN {e.format(text='string')}" for k, e in enumerate(NAMES))
    of = features(spark, sf_dir).selectExpr("feature_id", "lipid_class", "cast(12 + feature_id % 13 AS int) AS c1", "cast(feature_id % 5 AS int) AS d1", "cast(14 + feature_id % 11 AS int) AS c2", "cast(feature_id % 4 AS int) AS d2")
    return of.selectExpr("feature_id", "lipid_class", f"CASE feature_id % {len(NAMES)} {cases} END AS name")


NAMED_SQL = SQL + f""", nm AS (SELECT feature_id, lipid_class, CASE feature_id % {len(NAMES)} {' '.join(f"WHEN {k} THEN {e.format(text='varchar')}" for k, e in enumerate(NAMES))} END AS name
  FROM (SELECT feature_id, lipid_class, 12 + feature_id % 13 AS c1, feature_id % 5 AS d1, 14 + feature_id % 11 AS c2, feature_id % 4 AS d2 FROM features)) """


#: Starts of names that rules on plausibility are about, and what may follow the first chain.
RULE_STARTS = (
    "PC ", "PC O-", "PE ", "PE O-", "PA ", "PG ", "PS ", "PI ", "PIP ", "PIP3 ", "BMP ", "CL ", "MLCL ", "TG ", "TG O-", "DG ", "DG O-", "MG ", "SM ", "Cer ", "CerP ", "HexCer ", "Hex2Cer ", "SHexCer ",
    "ACer ", "SPB ", "SPBP ", "FA ", "FAL ", "FOH ", "FAHFA ", "HC ", "FAG ", "SFE ", "WE ", "WD ", "CAR ", "Car ", "CoA ", "NA ", "NAE ", "NAT ", "CE ", "ST ", "LPC ", "LPE ", "LPA ", "LPC O-", "LPI ",
    "PE-NMe ", "PE-NMe2 ", "PE-N[FA] ", "PEth ", "PIM1 ", "IPC ", "MIPC ", "PK ", "PR ", "SL ", "SQDG ", "HexDG ", "DGTS ", "PnC ", "NoAbbrev:", "DEET ", "fungi ", "plant ", "Hex(2)Cer ", "LBPA ", "GlcADG ",
)
RULE_ENDS = ("", "_18:1", "/16:0", "/25:0", ";O", ";O2", ";O3/16:0;O", ";O7", ";O12", ";Gly", ";Tau", ";Hex", "_27:0", "_12:0", ";N4", "_8:0_7:0", "/31:0", "_20:5")


def _rule_names(list_: object) -> str:
    starts, ends = (list_(x) for x in (RULE_STARTS, RULE_ENDS))
    return f"""concat({starts}, 1 + (feature_id * 7 + rep * 31) % 90, ':', (feature_id * 5 + rep * 3) % 17, {ends})"""


def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, annotation, lipid_class, polarity, rt_min: 20 names for each feature, of all starts, sizes and ends."""
    at = iter((f"cast((feature_id + 13 * rep) % {len(RULE_STARTS)} + 1 AS int)", f"cast((feature_id * 3 + rep) % {len(RULE_ENDS)} + 1 AS int)"))
    name = _rule_names(lambda x: f"element_at({_array(x)}, {next(at)})")
    return features(spark, sf_dir).selectExpr("*", "explode(sequence(0, 19)) AS rep").selectExpr("feature_id * 20 + rep AS feature_id", f"{name} AS annotation", "lipid_class", "polarity", "rt_min")


def _rule_names_sql() -> str:
    at = iter((f"(feature_id + 13 * rep) % {len(RULE_STARTS)} + 1", f"(feature_id * 3 + rep) % {len(RULE_ENDS)} + 1"))
    name = _rule_names(lambda x: f"({_list(x)})[{next(at)}]")
    return f", rn AS (SELECT feature_id * 20 + rep AS feature_id, {name} AS annotation, lipid_class, polarity FROM features CROSS JOIN range(20) t(rep)) "


RULE_NAMES_SQL = _rule_names_sql()
