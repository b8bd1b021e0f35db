"""Merging the two polarities, and collapsing what is the same feature twice."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import linked_components, unsent, written
from .multivariate import centred, six_products


#: Features of the second side in a part of a cell, and candidates of a task.
_PART, _CANDIDATES = 1_024, 5_000_000


def pair(pos: DataFrame, neg: DataFrame, rt: float = 0.2, da: float = 0.005, ppm: float = 5.0, heaviest: float = 10_000.0) -> DataFrame:
    """Pairs of features of the two polarities within rt minutes, and within da or ppm (of the positive mass).

    Cells of mass are as wide as the reach at the heaviest mass that is looked for, and cells of time as rt; heavier features
    get more cells, none is lost. Columns of both sides get 1 (positive) and 2 (negative) at their end. The negative features of a
    dense cell are cut in parts of about _PART, which the positive ones all meet, and tasks are as many as the candidates need: the
    inputs are small beside the pairs, so their size tells nothing.
    """
    width, step = max(da, ppm * heaviest / 1e6), max(rt, 1e-3)
    left = pos.select(*(F.col(c).alias(f"{c}1") for c in pos.columns))
    right = neg.select(*(F.col(c).alias(f"{c}2") for c in neg.columns))
    right = right.withColumn("_mass", F.floor(F.col("neutral_mass2") / width)).withColumn("_time", F.floor(F.col("rt_min2") / step))

    def touched(column: str, reach: Column, size: float) -> Column:
        slack = reach + F.lit(1e-9) * (1 + F.abs(column))
        return F.explode(F.sequence(F.floor((F.col(column) - slack) / size), F.floor((F.col(column) + slack) / size)))

    left = left.withColumn("_mass", touched("neutral_mass1", F.greatest(F.lit(da), F.col("neutral_mass1") * ppm / 1e6), width)).withColumn("_time", touched("rt_min1", F.lit(rt), step))
    cell = ["_mass", "_time"]
    cells = right.groupBy(*cell).agg(F.count("*").alias("_n")).join(left.groupBy(*cell).agg(F.count("*").alias("_m")), cell)
    cells = written(cells.select(*cell, F.ceil(F.col("_n") / _PART).cast("int").alias("_parts"), (F.col("_n") * F.col("_m").cast("double")).alias("_pairs")), "cells")
    tasks = int(min(2_000, 1 + (cells.agg(F.sum("_pairs")).first()[0] or 0) // _CANDIDATES))
    cells, key = cells.drop("_pairs").hint("merge"), [*cell, "_part"]
    even = lambda df: df.repartition(tasks, *key) if tasks > 1 else df
    left = even(left.join(cells, cell).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
    right = even(right.join(cells, cell).withColumn("_part", F.pmod(F.xxhash64("feature_id2"), F.col("_parts").cast("long")).cast("int")).drop("_parts"))
    gap = F.abs(F.col("neutral_mass1") - F.col("neutral_mass2"))
    near = (F.abs(F.col("rt_min1") - F.col("rt_min2")) <= rt) & ((gap <= da) | (gap / F.col("neutral_mass1") * 1e6 <= ppm))
    return left.join(right.hint("merge"), key).where(near).drop(*key)


def compatible(pairs: DataFrame) -> DataFrame:
    """Pairs of one annotation, or of one class and headgroup with a side at molecular level, whose quality gets a tenth more."""
    same = F.col("annotation1") == F.col("annotation2")
    kin = (F.col("lipid_class1") == F.col("lipid_class2")) & (F.col("headgroup1") == F.col("headgroup2"))
    molecular1, molecular2 = (F.col(f"level{k}") == "Molecular level" for k in (1, 2))
    of = pairs.where(same | (kin & (molecular1 | molecular2)))
    more = lambda k, m: F.col(f"quality{k}") * F.when(~same & m, 1.1).otherwise(1.0)
    return of.withColumn("quality1", more(1, molecular1)).withColumn("quality2", more(2, molecular2))


#: Pairs of a component that one task resolves.
COMPONENT = 100_000


def _resolved(pairs: list[tuple[object, object, bool]]) -> list[tuple[str, object]]:
    """The (side, id) that are removed from a component of pairs (id1, id2, whether the first wins).

    Each keeps how many of its pairs it wins; what wins none goes, and only its partners are looked at again.
    """
    of: dict[tuple[str, object], list[int]] = {}
    for k, (one, two, _) in enumerate(pairs):
        of.setdefault(("1", one), []).append(k)
        of.setdefault(("2", two), []).append(k)
    wins = {x: sum(pairs[k][2] == (x[0] == "1") for k in mine) for x, mine in of.items()}
    left, open_, gone = [True] * len(pairs), [x for x, n in wins.items() if n == 0], set()
    while open_:
        x = open_.pop()
        if x in gone or wins[x] > 0 or not any(left[k] for k in of[x]):
            continue
        gone.add(x)
        for k in of[x]:
            if left[k]:
                left[k] = False
                one, two, first = pairs[k]
                other = ("2", two) if x[0] == "1" else ("1", one)
                if first == (other[0] == "1"):
                    wins[other] -= 1
                    if not wins[other]:
                        open_.append(other)
    return sorted(gone, key=str)


def eliminate(pairs: DataFrame, component: int | None = None) -> DataFrame:
    """The ids that lose: (feature_id1 or feature_id2, as side and feature_id).

    A pair's winner has the better quality, the positive one if they are equal; a pair without a quality is won by the negative
    one. A feature in a pair that wins none of its pairs is removed, and with it its pairs; this is repeated until nothing more
    goes; one that has no pair left stays. Features that pairs link, over any number of them, depend on each other
    and on no others: a component of up to COMPONENT pairs is resolved in one task, however long its chains of removals are.
    Pairs of larger ones are counted in rounds, of which each touches only the partners of what went in the last.
    An empty table removes nothing.
    """
    limit = COMPONENT if component is None else component
    won = F.coalesce(F.col("quality1") >= F.col("quality2"), F.lit(False))
    left = written(pairs.select("feature_id1", "feature_id2", won.alias("first")).distinct(), "pairs")
    kind = dict(left.dtypes)["feature_id1"]
    node = lambda k: F.concat(F.lit(f"{k}|"), F.col(f"feature_id{k}").cast("string"))
    labels = linked_components(left.select(node(1).alias("a"), node(2).alias("b")))
    placed = left.withColumn("node", node(1)).join(labels, "node").drop("node")
    sizes = placed.groupBy("label").agg(F.count("*").alias("size"))
    placed = written(placed.join(sizes, "label"), "components")

    def resolve(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_resolved(list(zip(block["feature_id1"].tolist(), block["feature_id2"].tolist(), block["first"].tolist()))), columns=["side", "feature_id"])

    gone = written(placed.where(F.col("size") <= limit).groupBy("label").applyInPandas(resolve, f"side string, feature_id {kind}"), "losers")
    large = placed.where(F.col("size") > limit).select("feature_id1", "feature_id2", "first")
    return gone.unionByName(_in_rounds(written(large, "pairs"))) if large.head(1) else gone


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """eliminate, by counts of wins that change with what goes: a round reads the pairs of the last round's losers only."""
    sides = pairs.select(F.lit("1").alias("side"), F.col("feature_id1").alias("feature_id"), F.col("feature_id2").alias("other"), F.col("first").alias("won")).unionByName(
        pairs.select(F.lit("2").alias("side"), F.col("feature_id2").alias("feature_id"), F.col("feature_id1").alias("other"), (~F.col("first")).alias("won"))
    )
    sides = written(sides, "sides")
    wins = written(sides.groupBy("side", "feature_id").agg(F.count_if("won").alias("wins"), F.count("*").alias("pairs")), "wins")
    gone, new = None, written(wins.where("wins = 0").select("side", "feature_id"), "losers")
    while new.head(1):
        gone = new if gone is None else gone.unionByName(new)
        # The pairs of those that go, as their partners see them; a pair of two that go together counts once for each.
        theirs = sides.join(new, ["side", "feature_id"]).select(F.when(F.col("side") == "1", "2").otherwise("1").alias("side"), F.col("other").alias("feature_id"), (~F.col("won")).alias("won"))
        lost = theirs.groupBy("side", "feature_id").agg(F.count_if("won").alias("fewer"), F.count("*").alias("gone"))
        wins = written(wins.join(new, ["side", "feature_id"], "left_anti").join(lost, ["side", "feature_id"], "left").select(
            "side", "feature_id", (F.col("wins") - F.coalesce("fewer", F.lit(0))).alias("wins"), (F.col("pairs") - F.coalesce("gone", F.lit(0))).alias("pairs"), F.coalesce("fewer", F.lit(0)).alias("fewer")), "wins")
        new = written(wins.where("wins = 0 AND fewer > 0 AND pairs > 0").select("side", "feature_id"), "losers")
        wins = wins.drop("fewer")
    return gone if gone is not None else new


def union_polarities(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Both tables with ids P_ and N_; columns that one lacks are null."""
    named = lambda df, p: df.withColumn("feature_id", F.concat(F.lit(p), F.col("feature_id").cast("string")))
    return named(pos, "P_").unionByName(named(neg, "N_"), allowMissingColumns=True)


#: What features of one place have in common: the same partners, with the same factors to their qualities.
PLACE = ["rt_min", "neutral_mass", "annotation", "lipid_class", "headgroup", "level"]


def losers(pos: DataFrame, neg: DataFrame, component: int | None = None, **limits: float) -> DataFrame:
    """eliminate(compatible(pair(pos, neg))), side and feature_id, without a row a pair of features.

    pos, neg: feature_id (once on each side), PLACE, quality. Features of one place have the same partners, and of two the better
    one wins whatever the other wins. So only pairs of places are made, a place loses its features in the order of their
    qualities, and what counts of its partners is the worst that each has left. Equal qualities go together. A component of places
    of up to COMPONENT pairs and qualities is resolved in one task; of larger ones each round takes from a place all that lose to what
    its partners have.
    """
    limit = COMPONENT if component is None else component
    sides, levels, places = {}, {}, {}
    for k, df in (("1", pos), ("2", neg)):
        sides[k] = df.select("feature_id", *PLACE, F.col("quality").cast("double").alias("quality"))
        of = sides[k].groupBy(*PLACE, "quality").agg(F.min("feature_id").alias("id"))
        levels[k] = written(of.withColumn("place", F.min("id").over(Window.partitionBy(*PLACE))), "qualities")
        places[k] = levels[k].select(F.col("place").alias("feature_id"), *PLACE, F.lit(1.0).alias("quality")).distinct()
    links = compatible(pair(places["1"], places["2"], **limits))  # of a quality of 1 the factor is left
    links = written(links.select(F.col("feature_id1").alias("one"), F.col("feature_id2").alias("two"), F.col("quality1").alias("f1"), F.col("quality2").alias("f2")), "links")
    node = lambda k, c: F.concat(F.lit(f"{k}|"), F.col(c).cast("string"))
    labels = linked_components(links.select(node("1", "one").alias("a"), node("2", "two").alias("b")))
    # In a pair a null quality loses on the positive side and wins on the negative one; NaN is above all numbers.
    tier = lambda k: F.when(F.col("quality").isNull(), 0 if k == "1" else 3).when(F.isnan("quality"), 2).otherwise(1)
    known = lambda k: F.when(tier(k) == 1, F.col("quality")).otherwise(0.0)
    rows = [levels[k].select(F.lit(k).alias("side"), "place", "id", tier(k).alias("tier"), known(k).alias("v")).withColumn("node", node(k, "place")).join(labels, "node").drop("node") for k in "12"]
    rows = written(rows[0].unionByName(rows[1]), "rows")
    links = written(links.withColumn("node", node("1", "one")).join(labels, "node").drop("node"), "links")
    count = lambda df: df.groupBy("label").agg(F.count("*").alias("n"))
    sizes = written(count(links).unionByName(count(rows)).groupBy("label").agg(F.sum("n").alias("size")), "sizes")
    small = sizes.where(F.col("size") <= limit)
    total = small.agg(F.sum("size")).first()[0] or 0
    groups = int(1 + total // max(limit, 1))
    kind = dict(levels["1"].dtypes)["id"]

    def resolve(of: pd.DataFrame, all_links: pd.DataFrame) -> pd.DataFrame:
        return _resolved_places(of, all_links)

    # Components are independent of each other, so a group may hold several.
    spread = lambda df: df.join(small, "label", "left_semi").withColumn("group", F.pmod(F.xxhash64("label"), F.lit(groups))).repartition(min(groups, 1_000), "group").groupBy("group")
    gone = spread(rows).cogroup(spread(links)).applyInPandas(resolve, f"side string, id {kind}")
    large = sizes.where(F.col("size") > limit).select("label")
    if large.head(1):
        gone = gone.unionByName(_places_in_rounds(rows.join(large, "label").drop("label"), links.join(large, "label").drop("label")))
    gone = written(gone, "losers")
    out = []
    for k in "12":
        lost = levels[k].join(gone.where(F.col("side") == k).select("id"), "id", "left_semi").select(*(F.col(c).alias(f"{c} of") for c in (*PLACE, "quality")))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"`{c} of`")) for c in (*PLACE, "quality")])
        out.append(sides[k].join(lost, same, "left_semi").select(F.lit(k).alias("side"), "feature_id"))
    return out[0].unionByName(out[1])


def _resolved_places(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """The qualities that go, as side and id. rows: side, place, id, tier, v; links: one, two, f1, f2.

    Each place keeps how many partners' worst its own worst beats; where that is none, its worst goes, and only its partners change.
    """
    rows = rows.sort_values(["side", "place", "tier", "v"], ignore_index=True)
    new = ((rows["side"] != rows["side"].shift()) | (rows["place"] != rows["place"].shift())).to_numpy(bool)
    at = np.flatnonzero(new)
    end, first_side = np.append(at[1:], len(rows)), (rows["side"] == "1").to_numpy()[at] if len(rows) else np.zeros(0, bool)
    number = {(s, p): k for k, (s, p) in enumerate(zip(rows["side"].to_numpy()[at].tolist(), rows["place"].to_numpy()[at].tolist()))}
    one = np.array([number["1", p] for p in links["one"].tolist()], int)
    two = np.array([number["2", p] for p in links["two"].tolist()], int)
    f1, f2 = links["f1"].to_numpy(float), links["f2"].to_numpy(float)
    tier, v, head, left = rows["tier"].to_numpy(), rows["v"].to_numpy(float), at.copy(), np.ones(len(at), bool)

    def beats(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
        """Whether the worst of positive places wins against that of negative ones."""
        ta, tb = tier[head[a]], tier[head[b]]
        return (ta > tb) | ((ta == tb) & (v[head[a]] * fa >= v[head[b]] * fb))

    won = beats(one, two, f1, f2)
    wins = np.bincount(one[won], minlength=len(at)) + np.bincount(two[~won], minlength=len(at))
    pairs = np.bincount(one, minlength=len(at)) + np.bincount(two, minlength=len(at))
    order = np.argsort(np.r_[one, two], kind="stable")
    partner, own, other = np.r_[two, one][order], np.r_[f1, f2][order], np.r_[f2, f1][order]
    ends = np.cumsum(pairs)
    starts, open_ = ends - pairs, np.flatnonzero(wins == 0).tolist()
    while open_:
        k = open_.pop()
        if not left[k] or wins[k] or not pairs[k]:
            continue
        mine = np.arange(starts[k], ends[k])
        mine = mine[left[partner[mine]]]
        near = partner[mine]
        head[k] += 1
        if head[k] == end[k]:
            left[k] = False
            pairs[near] -= 1
            lost = near
        else:
            here = np.full(len(near), k)
            won = beats(here, near, own[mine], other[mine]) if first_side[k] else ~beats(near, here, other[mine], own[mine])
            wins[k], lost = won.sum(), near[won]
            if not wins[k]:
                open_.append(k)
        wins[lost] -= 1
        open_ += lost[wins[lost] == 0].tolist()
    gone = np.concatenate([np.arange(a, h) for a, h in zip(at, head)]) if len(at) else np.zeros(0, int)
    return rows.loc[gone, ["side", "id"]]


def _places_in_rounds(rows: DataFrame, links: DataFrame) -> DataFrame:
    """_resolved_places of components that no task holds: a round takes from each losing place all that lose to the worst of its partners."""
    order = Window.partitionBy("side", "place").orderBy("tier", "v")
    rows = written(rows.withColumn("rank", F.row_number().over(order)), "ranked")
    both = links.select(F.lit("1").alias("side"), F.col("one").alias("place"), F.col("two").alias("other"), F.col("f1").alias("own"), F.col("f2").alias("its")).unionByName(
        links.select(F.lit("2").alias("side"), F.col("two").alias("place"), F.col("one").alias("other"), F.col("f2").alias("own"), F.col("f1").alias("its")))
    both = written(both, "sides")
    heads = written(rows.where("rank = 1"), "heads")
    while True:
        theirs = heads.select(F.when(F.col("side") == "1", "2").otherwise("1").alias("side"), F.col("place").alias("other"), F.col("tier").alias("t"), F.col("v").alias("w"))
        worst = both.join(theirs, ["side", "other"]).groupBy("side", "place", "own").agg(F.min(F.struct(F.col("t"), (F.col("w") * F.col("its")).alias("w"))).alias("worst"))
        mine = F.struct(F.col("tier").alias("t"), (F.col("v") * F.col("own")).alias("w"))
        wins = F.when(F.col("side") == "1", mine >= F.col("worst")).otherwise(mine > F.col("worst"))
        worst = written(worst, "worst")
        lost = heads.select("side", "place", "tier", "v").join(worst, ["side", "place"]).groupBy("side", "place").agg(F.bool_or(wins).alias("wins")).where("NOT wins").select("side", "place")
        lost = written(lost, "lost")
        if not lost.head(1):
            break
        after = rows.join(lost, ["side", "place"]).join(worst, ["side", "place"]).where(wins).groupBy("side", "place").agg(F.min("rank").alias("rank"))
        heads = written(heads.join(lost, ["side", "place"], "left_anti").unionByName(rows.join(after, ["side", "place", "rank"]).select(*heads.columns)), "heads")
    kept = heads.select("side", "place", F.col("rank").alias("kept"))
    return rows.join(kept, ["side", "place"], "left").where("kept IS NULL OR rank < kept").select("side", "id")


def merge_best(pos: DataFrame, neg: DataFrame, **limits: float) -> DataFrame:
    """Annotated features of both polarities, the worse of what is found in both removed; then U1."""
    gone = written(losers(pos, neg, **limits), "removed")  # read twice below
    keep = lambda df, k: df.join(gone.where(F.col("side") == k).select("feature_id"), "feature_id", "left_anti")
    return union_polarities(keep(pos, "1"), keep(neg, "2"))


def aligned(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table's rows for the ids, and the ids that it lacks."""
    return table.join(ids, "feature_id", "left_semi"), ids.join(table, "feature_id", "left_anti")


def split_known(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotated and unknown features."""
    unknown = F.lower(F.trim(F.coalesce("annotation", F.lit("")))).isin("", "nan", "na", "none", "unknown")
    return features.where(~unknown), features.where(unknown)


def _blocks(features: DataFrame, key: str | list[str], rt: str, gap: float | Column) -> DataFrame:
    """features with `block`: runs of a key's rows in which no two neighbours in rt are more than gap apart."""
    order = Window.partitionBy(key).orderBy(rt, "feature_id")
    starts = F.coalesce((F.col(rt) - F.lag(rt).over(order) > gap).cast("int"), F.lit(0))
    return features.withColumn("_start", starts).withColumn("block", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


#: Rows of a block that one task goes through; larger blocks are gone through in ranges of time.
BLOCK = 20_000


def _anchored(block: pd.DataFrame, carried: pd.DataFrame, seconds: float, ppm: float, mda: float) -> pd.DataFrame:
    """block with anchor: the earliest row left takes those within its reach. carried: anchors of before, which come first."""
    block = block.sort_values(["rt_s", "feature_id"], ignore_index=True)
    carried = carried.sort_values(["rt_s", "feature_id"], ignore_index=True)
    rt, mass, ids = block["rt_s"].to_numpy(), block["neutral_mass"].to_numpy(), block["feature_id"].tolist()
    anchor = np.full(len(block), None, object)
    free = np.ones(len(block), bool)

    def take(own: object, at: float, m: float, start: int) -> None:
        end = int(np.searchsorted(rt, at + seconds, "right")) + 1
        off = np.abs(mass[start:end] - m)
        mine = start + np.flatnonzero(free[start:end] & (rt[start:end] - at <= seconds) & ((off <= mda / 1000) | (off / m * 1e6 <= ppm)))
        anchor[mine], free[mine] = own, False

    for own, at, m in zip(carried["feature_id"].tolist(), carried["rt_s"].tolist(), carried["neutral_mass"].tolist()):
        take(own, at, m, 0)
    for k in range(len(block)):
        if free[k]:
            take(ids[k], rt[k], mass[k], k)
    return block.assign(anchor=pd.Series(anchor.tolist(), index=block.index, dtype=block["feature_id"].dtype))


def collapse_adducts(features: DataFrame, seconds: float = 6.0, ppm: float = 5.0, mda: float = 5.0, most: int | None = None) -> DataFrame:
    """Of one annotation's rows near in time and mass, the best. features: feature_id, annotation, annotation_type,
    rt_s, neutral_mass, n_missing, mean. Returns feature_id, kept_id.

    The earliest row left is the anchor; rows within 6 s and 5 ppm or 5 mDa of it are its group, of which the best by
    type, missing values and mean stays. Standards, unknown rows and rows without time or mass stay alone; ties go to the smaller id; an
    empty table stays empty. An anchor reaches across no gap of over 6 s in time, and none of over 5 mDa and 5 ppm in mass, so
    rows between such gaps, in both, are a block. A block of up to BLOCK rows is gone through in one task. Larger ones are cut in
    ranges of 6 s: an anchor reaches into the next range at most, so a round goes through one range of each block, with the
    anchors of the range before, and hands its own on.
    """
    limit = BLOCK if most is None else most
    alone = (F.coalesce("annotation", F.lit("")) == "") | (F.col("annotation_type") == "IS") | F.col("rt_s").isNull() | F.col("neutral_mass").isNull()
    alone = F.coalesce(alone, F.lit(False))
    by_type = F.when(F.col("annotation_type") == "MS/MS match", 0).when(F.col("annotation_type") == "MS match", 1).otherwise(2)
    named = features.where(~alone).withColumn("priority", by_type)
    by_mass = _blocks(named, "annotation", "neutral_mass", F.greatest(F.lit(mda / 1000), F.col("neutral_mass") * (ppm / 1e6))).withColumnRenamed("block", "mass_block")
    named = _blocks(by_mass, ["annotation", "mass_block"], "rt_s", seconds)
    kind, key = dict(features.dtypes)["feature_id"], ["annotation", "mass_block", "block"]
    rows = written(named.select(*key, "feature_id", F.col("rt_s").cast("double").alias("rt_s"), F.col("neutral_mass").cast("double").alias("neutral_mass"), "priority", "n_missing", "mean"), "adducts")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("size"), F.min("rt_s").alias("start"))
    sized = rows.join(unsent(sizes), key)
    schema = f"feature_id {kind}, rt_s double, neutral_mass double, anchor {kind}"
    shown = ["feature_id", "rt_s", "neutral_mass", "anchor"]
    none = pd.DataFrame({"feature_id": [], "rt_s": [], "neutral_mass": []})
    found = sized.where(F.col("size") <= limit).select(*key, "feature_id", "rt_s", "neutral_mass").groupBy(*key).applyInPandas(lambda b: _anchored(b, none, seconds, ppm, mda)[shown], schema).select("feature_id", "anchor")

    large = sized.where(F.col("size") > limit).select(*key, "feature_id", "rt_s", "neutral_mass", F.floor((F.col("rt_s") - F.col("start")) / (seconds * (1 + 1e-9))).alias("part"))
    last = large.agg(F.max("part")).first()[0]
    if last is not None:
        large, carried = written(large, "ranges"), None
        with_key = ", ".join(f"{c} {dict(large.dtypes)[c]}" for c in key) + ", " + schema

        def go_on(names: tuple, block: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            out = _anchored(block, before, seconds, ppm, mda)[shown] if len(block) else none.assign(anchor=[])
            for c, v in zip(key, names):
                out[c] = v
            return out[[*key, *shown]]

        for part in range(int(last) + 1):
            here = large.where(F.col("part") == part).drop("part")
            before = carried if carried is not None else here.limit(0)
            done = written(here.groupBy(*key).cogroup(before.groupBy(*key)).applyInPandas(go_on, with_key), "anchored")
            found, carried = found.unionByName(done.select("feature_id", "anchor")), done.where("feature_id = anchor").drop("anchor")
    best = found.join(unsent(rows.select("feature_id", "priority", "n_missing", "mean")), "feature_id").groupBy("anchor").agg(
        F.min(F.struct("priority", "n_missing", (-F.col("mean")).alias("less"), "feature_id")).alias("best"))
    merged = found.join(unsent(best), "anchor").select("feature_id", F.col("best.feature_id").alias("kept_id"))
    return merged.unionByName(features.where(alone).select("feature_id", F.col("feature_id").alias("kept_id")))


#: Features of a cell of time that one task holds: fewer of many samples, but not under the second.
CELL, CELL_LEAST, CELL_VALUES = 32_768, 4_096, 1 << 22


def linked_rows(table: np.ndarray, rt: np.ndarray, first: np.ndarray, second: np.ndarray, within: bool, minutes: float, r: float, least: int) -> np.ndarray:
    """A label for each row of a table, the same for those that are linked over any number of links of first and second (the same rows, if they are one tile).

    A pair of rows that are one already is not looked at. Some rows at a time are compared with all columns that are not in the largest component
    so far, and then with that one's, until each of them is in it.
    """
    there, table = centred(table)
    known, label = there.astype(float), np.arange(len(table))

    def join(some: np.ndarray, columns: np.ndarray) -> None:
        for at in range(0, len(columns), 2_048):
            part = columns[at : at + 2_048]
            b, m = np.ascontiguousarray(table[part].T), np.ascontiguousarray(known[part].T)
            n, found = six_products(table[some], known[some], b, m, b * b)
            near = (np.abs(rt[some][:, None] - rt[part][None, :]) <= minutes) & (n >= least) & (found >= r) & (label[some][:, None] != label[part][None, :])
            for k in np.flatnonzero(near.any(1)):
                new = np.zeros(len(label), bool)
                new[label[part[near[k]]]] = True
                new[label[some[k]]] = True
                label[new[label]] = label[some[k]]

    for at in range(0, len(first), 16):
        some = first[at : at + 16]
        columns = second[second > some[0]] if within else second
        mine = label[columns] == np.bincount(label).argmax()
        join(some, columns[~mine])
        largest = columns[mine]
        for k in range(0, len(largest), 256):
            left = some[label[some] != label[largest[0]]]
            if not len(left):
                break
            join(left, largest[k : k + 256])
    return label


def collapse_correlated(features: DataFrame, cells: DataFrame, minutes: float = 0.3, r: float = 0.9, least: int = 4, cell: int | None = None) -> DataFrame:
    """feature_id, kept_id: of one annotation and class, rows that are near in time and correlate are one feature.

    features: feature_id, annotation, lipid_class, rt_min, qc_rsd, sample_rsd, median; cells: feature_id, sample_id,
    value. Pairs within 0.3 min are linked if log10(x + 1) correlates by 0.9 over four values or more; of what is linked,
    over any number of links, the one with the lowest QC RSD, sample RSD and highest median stays (nulls last, ties to the smaller id).
    Rows without annotation or time stay alone, as do those without values; an empty table stays empty.

    Time is cut in cells as wide as the reach, so both of a pair are in one cell or in neighbours. A cell is cut in tiles
    of about CELL features, and each two tiles that pairs may be in are a group; each pair is in one group. There a feature is compared with
    others until it is known to be one with them: pairs that other links have joined change nothing. What is shuffled is a feature's array for each
    tile that it meets, and for a group's features the smallest of those that they are one with: fewer rows than it has features.
    """
    features = written(features.select("feature_id", "annotation", "lipid_class", "rt_min", "qc_rsd", "sample_rsd", "median"), "features")  # read three times
    packed = cells.where("value > 0").groupBy("feature_id").agg(F.collect_list(F.struct("sample_id", F.log10(F.col("value") + 1).alias("v"))).alias("c"))
    packed = written(packed.select("feature_id", F.col("c.sample_id").alias("samples"), F.col("c.v").alias("values")), "packed")
    widest = packed.agg(F.max(F.size("values"))).first()[0] or 1
    size = max(CELL_LEAST, min(CELL, CELL_VALUES // widest)) if cell is None else cell
    named = features.where("annotation <> '' AND rt_min IS NOT NULL").select(F.concat_ws("|", "annotation", "lipid_class").alias("name"), "feature_id", F.col("rt_min").cast("double").alias("rt"))
    named = named.withColumn("at", F.floor(F.col("rt") / (minutes * (1 + 1e-9))))
    tiles = written(named.groupBy("name", "at").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles")), "tiles")
    beside = lambda step, column: tiles.select("name", (F.col("at") - step).alias("at"), F.col("tiles").alias(column))
    mine = named.join(tiles, ["name", "at"]).join(beside(1, "later"), ["name", "at"], "left").join(beside(-1, "earlier"), ["name", "at"], "left")
    mine = written(mine.withColumn("own", F.pmod(F.xxhash64("feature_id"), F.col("tiles")).cast("int")), "placed")
    tile = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = ["name", "feature_id", "rt"]
    met = F.col("met")
    within = mine.withColumn("met", tile(F.col("tiles"))).select(*base, "at", F.lit(0).alias("next"), F.least("own", "met").alias("x"), F.greatest("own", "met").alias("y"), (F.col("own") > met).cast("int").alias("side"))
    ahead = mine.where("later IS NOT NULL").withColumn("met", tile(F.col("later"))).select(*base, "at", F.lit(1).alias("next"), F.col("own").alias("x"), met.alias("y"), F.lit(0).alias("side"))
    behind = mine.where("earlier IS NOT NULL").withColumn("met", tile(F.col("earlier"))).select(*base, (F.col("at") - 1).alias("at"), F.lit(1).alias("next"), met.alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"))
    rows = within.unionByName(ahead).unionByName(behind).join(unsent(packed), "feature_id")
    kind = dict(features.dtypes)["feature_id"]

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("feature_id")
        samples, values = (group.column(k).combine_chunks() for k in ("samples", "values"))
        flat, size = samples.flatten(), samples.value_lengths().to_numpy(zero_copy_only=False)
        names = pc.unique(flat)
        table = np.full((len(group), len(names)), np.nan)
        table[np.repeat(np.arange(len(group)), size), pc.index_in(flat, names).to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
        side, rt, within = group.column("side").to_numpy(), group.column("rt").to_numpy(), not group.column("next")[0].as_py() and group.column("x")[0] == group.column("y")[0]
        label = linked_rows(table, rt, np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1)), within, minutes, r, least)
        root = np.full(len(group), len(group))
        np.minimum.at(root, label, np.arange(len(group)))  # rows are in the order of their ids
        two = np.flatnonzero(root[label] < np.arange(len(group)))
        return pa.table({"a": group.column("feature_id").take(pa.array(root[label[two]])), "b": group.column("feature_id").take(pa.array(two))})

    linked = rows.groupBy("name", "at", "next", "x", "y").applyInArrow(link, f"a {kind}, b {kind}")
    of = linked_components(linked).select(F.col("node").alias("feature_id"), F.col("label").alias("component")).join(unsent(features), "feature_id")
    order = F.struct(*(x.alias(f"k{i}") for i, x in enumerate(y for c, way in (("qc_rsd", 1), ("sample_rsd", 1), ("median", -1)) for y in (F.col(c).isNull(), way * F.col(c)))), "feature_id")
    best = of.groupBy("component").agg(F.min(order).alias("best"))
    kept = of.select("feature_id", "component").join(unsent(best), "component").select("feature_id", F.col("best.feature_id").alias("kept_id"))
    return features.select("feature_id").join(unsent(kept), "feature_id", "left").select("feature_id", F.coalesce("kept_id", "feature_id").alias("kept_id"))
