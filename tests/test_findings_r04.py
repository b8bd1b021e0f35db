"""What a reading of round 4 found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.operators import group_tests, merge, multivariate, normalize


def _table(seed, copies, columns=6, share=0.3):
    """Rows of which `copies` each have values in the same columns; one is flat."""
    rng = np.random.default_rng(seed)
    gone = np.tile(rng.random((12, columns)) < share, (copies, 1))
    table = np.where(gone, np.nan, rng.choice([1.0, 2.0, 5.0, 7.5], gone.shape) + rng.random(gone.shape) * (rng.random(gone.shape) < 0.7))
    table[3] = np.where(np.isnan(table[3]), np.nan, 4.0)
    return table


def _pairs(table, first, second, within):
    for i in first:
        for j in second:
            both = ~np.isnan(table[i]) & ~np.isnan(table[j])
            x, y = table[i][both], table[j][both]
            if (i < j or not within) and both.sum() >= 3 and np.ptp(x) > 1e-9 and np.ptp(y) > 1e-9:
                yield np.corrcoef(x, y)[0, 1]


@pytest.mark.parametrize("copies", [1, 9])
def test_pairs_of_shared_masks_are_one_product(monkeypatch, copies):
    """each pair had six products of its own; rows with values in the same columns share all but one of them. Sums are those of single pairs."""
    six = []
    products = multivariate.six_products
    monkeypatch.setattr(multivariate, "six_products", lambda a, *more: (six.append(len(a)), products(a, *more))[1])
    table = _table(6 + copies, copies)
    for strip in (5, 16, 4_096):
        monkeypatch.setattr(multivariate, "_STRIP", strip)
        for first, second in ((np.arange(0, len(table), 2), np.arange(1, len(table), 2)), (np.arange(len(table)),) * 2):
            want = np.sort(list(_pairs(table, first, second, first is second)))
            assert len(want) > 20
            six.clear()
            got = multivariate.pair_sums(table, first, second, first is second, 3)
            assert bool(six) == (copies == 1)
            assert got[0] == len(want) and abs(got[1] - want.sum()) < 1e-9 and abs(got[2] - np.abs(want).sum()) < 1e-9
            seen = []
            assert multivariate.pair_sums(table, first, second, first is second, 3, lambda r: seen.append(r.copy())) == (0, 0.0, 0.0)
            assert np.allclose(np.sort(np.concatenate(seen)), want, atol=1e-9)


def test_groups_of_blocks_have_their_own_tasks(spark):
    """Spark joined partitions by their few bytes, so that at 6 times sf0.1 ten tasks had the work of 320 groups."""
    rows = [(f, f"{f % 12}", s, 1.0 + (f * 7 + s * s) % 11) for f in range(60) for s in range(4)]
    cells = spark.createDataFrame(rows, "feature_id long, lipid_class string, sample_id int, value double")
    placed, _ = multivariate._blocks_of_classes(cells, False, 2, "lipid_class")
    assert placed.rdd.getNumPartitions() == 12 * 6  # three blocks a class


def test_blocks_of_very_large_classes_stay_few(spark, monkeypatch):
    """F8: a feature's array was sent to as many blocks as its class has 16,384 features, and written there too: 55 of 900,000 features."""
    names, write = [], multivariate.written
    monkeypatch.setattr(multivariate, "written", lambda df, name: (names.append(name), write(df, name))[1])
    one = spark.range(200_000).selectExpr("id AS feature_id", "'A' AS lipid_class", "cast(id % 3 AS int) AS sample_id", "1D + id AS value")
    placed, _ = multivariate._blocks_of_classes(one, False, multivariate._BLOCK, "lipid_class")
    assert placed.count() == 8 * 200_000
    rng = random.Random(8)
    rows = [(f, "AB"[f % 2], k, rng.choice([1.0, 2.0, rng.uniform(1, 9)])) for f in range(40) for k in range(6) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "feature_id long, lipid_class string, sample_id int, value double")
    got = {r["lipid_class"]: r for r in multivariate.class_correlation_summary(cells, block=7).collect()}
    want = {}
    for r in multivariate.class_correlations(cells).where("r IS NOT NULL").collect():
        want.setdefault(r["lipid_class"], []).append(r["r"])
    assert {k: (r["pairs"], round(r["median_r"], 9), round(r["mean_r"], 9)) for k, r in got.items()} == {k: (len(x), round(float(np.median(x)), 9), round(float(np.mean(x)), 9)) for k, x in want.items()}
    assert "placed" not in names


def test_features_with_values_in_the_same_samples_share_a_block(spark):
    """features were dealt to blocks by their ids, so that those of one mask, which share sums, were apart; a mask that many have is dealt to all blocks."""
    rows = spark.range(36_000).selectExpr("id AS feature_id", "'A' AS lipid_class", "if(id % 2 = 0, 4095, cast(id * 7919 % 4093 AS int)) AS mask")
    cells = rows.select("feature_id", "lipid_class", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("sample_id"), "mask").where("(mask >> sample_id) & 1 = 1").selectExpr("feature_id", "lipid_class", "sample_id", "1D + feature_id AS value")
    placed, _ = multivariate._blocks_of_classes(cells, False, multivariate._BLOCK, "lipid_class")
    own = placed.where("x = y").select("feature_id", "x").join(rows, "feature_id")
    by = {r["mask"]: r["n"] for r in own.groupBy("mask").agg(F.countDistinct("x").alias("n")).collect()}
    assert by.pop(4095) == 8 and set(by.values()) == {1}
    sizes = [r["count"] for r in own.groupBy("x").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes) and sum(sizes) == rows.where("mask > 0").count()


@pytest.mark.parametrize("r", [0.3, 0.8, 0.99])
def test_features_that_are_one_already_are_not_compared(monkeypatch, r):
    """all pairs of a cell were compared, also those of features that other links had joined; what is one is what all pairs would join."""
    looked = []
    products = merge.six_products
    monkeypatch.setattr(merge, "six_products", lambda a, m1, b, *more: (looked.append(len(a) * b.shape[1]), products(a, m1, b, *more))[1])
    rng = np.random.default_rng(10)
    table = np.where(rng.random((90, 8)) < 0.25, np.nan, rng.normal(size=(90, 8)) + rng.normal(size=(3, 8)).repeat(30, axis=0))
    rt = rng.choice([0.0, 0.2, 0.4], 90)
    every = np.arange(90)
    for first, second in ((every, every), (every[::2], every[1::2])):
        root = list(range(90))

        def of(k):
            while root[k] != k:
                k = root[k]
            return k

        for i in first:
            for j in second:
                both = ~np.isnan(table[i]) & ~np.isnan(table[j])
                if i != j and both.sum() >= 4 and abs(rt[i] - rt[j]) <= 0.3 and np.corrcoef(table[i][both], table[j][both])[0, 1] >= r:
                    root[of(i)] = of(j)
        got = merge.linked_rows(table, rt, first, second, first is second, 0.3, r, 4)
        want = [of(k) for k in range(90)]
        assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want))
    looked.clear()
    alike = np.outer(1 + rng.random(3_000), np.arange(6.0)) + rng.normal(size=(3_000, 6))
    assert len(set(merge.linked_rows(alike, np.zeros(3_000), np.arange(3_000), np.arange(3_000), True, 0.3, 0.5, 4))) == 1
    assert sum(looked) < 3_000 * 3_000 / 2 / 10


def test_rates_of_pairs_take_no_more_columns_than_the_result(spark, monkeypatch):
    """each pair was written and shuffled for its rate with r, n, z and the difference, none of which t14_differential_correlation returns."""
    seen, write = [], group_tests.written
    monkeypatch.setattr(group_tests, "written", lambda df, name: (seen.append(df.columns), write(df, name))[1])
    rng = random.Random(4)
    rows = [(f, "PC", s, "AB"[s % 2], rng.uniform(1, 9)) for f in range(9) for s in range(12)]
    monkeypatch.setattr(queries, "cells", lambda spark, sf: spark.createDataFrame(rows, "feature_id long, lipid_class string, sample_id int, grp string, value double"))
    got = {(r["id1"], r["id2"]): (r["p"], r["fdr"]) for r in queries.QUERIES["t14_differential_correlation"](spark, "").collect()}
    assert seen[0] == ["lipid_class", "id1", "id2", "p"] and len(got) == 36
    every = multivariate.differential_correlation(queries.cells(spark, ""), "A", "B")
    assert got == {(r["id1"], r["id2"]): (round(r["p"], 7), round(r["fdr"], 7)) for r in every.collect()} and "z" in every.columns


def test_standards_meet_features_in_large_groups(spark):
    """features and standards met in groups of 1,024 of each, as a group's pairs left it at once, so each array was shuffled to many; now some rows at a time leave it."""
    cells = spark.range(3_000).selectExpr("id AS feature_id", "explode(sequence(0, 2)) AS sample_id").selectExpr("*", "'Pos' AS polarity", "'PC' AS lipid_class", "true AS is_qc", "1D + (feature_id * 7 + sample_id * sample_id) % 11 AS value")
    standards = cells.where("feature_id < 1500").selectExpr("feature_id AS standard_id", "polarity", "sample_id", "value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        of = normalize.standard_candidates(cells, standards).select("feature_id", "standard_id").withColumn("part", F.spark_partition_id())
        got = of.agg(F.count("*"), F.countDistinct("feature_id"), F.countDistinct("standard_id"), F.countDistinct("part")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[:] == (4_500_000, 3_000, 1_500, 1)
