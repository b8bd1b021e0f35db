"""Scaling, correlation and sample-level projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_p, t_p_batches
from ..scale import percentiles, written
from .group_tests import benjamini_hochberg

#: Samples whose matrix may be on the driver.
MOST_SAMPLES = 5_000


def autoscale(cells: DataFrame) -> DataFrame:
    """Z of each value over its feature, 0 for features without spread: feature_id, sample_id, z."""
    of = Window.partitionBy("feature_id")
    sd = F.stddev_pop("value").over(of)
    return cells.select("feature_id", "sample_id", F.when(sd > 1e-12, (F.col("value") - F.avg("value").over(of)) / sd).otherwise(0.0).alias("z"))


def log_values(cells: DataFrame, base: int = 2, added: float | None = None) -> DataFrame:
    """Cells with the logarithm of value + added to the base of 2 or 10, as log_value; values under 0 have none.

    Without `added` it is 1 for base 10, and for base 2 the lowest percentile of the values above 0, exact over all cells (0 if
    there are none). Null values have no logarithm, nor have zeros to which nothing is added; an empty table stays empty.
    """
    if base not in (2, 10):
        raise ValueError("the base is 2 or 10")
    if added is None and base == 2:
        low = percentiles(cells.where("value > 0"), "value", {"_added": 0.01})
        of = cells.join(F.broadcast(low), F.lit(True), "left").withColumn("_added", F.coalesce("_added", F.lit(0.0)))  # one row
    else:
        of = cells.withColumn("_added", F.lit(float(1 if added is None else added)))
    x = F.col("value") + F.col("_added")
    return of.withColumn("log_value", F.when((F.col("value") >= 0) & (x > 0), F.log2(x) if base == 2 else F.log10(x))).drop("_added")


def correlations(table: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many columns some rows of a table share with others, and their correlation over these: NaN is missing, and the correlation without spread."""
    found = [x[1:] for x in correlation_rows(table, first, second, max(1, len(first)))]
    return found[0] if found else (np.zeros((0, len(second))), np.zeros((0, len(second))))


def correlation_rows(table: np.ndarray, first: np.ndarray, second: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """correlations of some rows of first at a time: the rows, and both."""
    there, table = centred(table)
    m2, b = np.ascontiguousarray(there[second].T.astype(float)), np.ascontiguousarray(table[second].T)
    bb = b * b
    for at in range(0, len(first), rows):
        some = first[at : at + rows]
        yield some, *six_products(table[some], there[some].astype(float), b, m2, bb)


def centred(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values a table has, and how far they are from their row's mean, 0 where there is none."""
    there = ~np.isnan(table)
    mean = np.where(there, table, 0.0).sum(1, keepdims=True) / np.maximum(there.sum(1, keepdims=True), 1)
    return there, np.where(there, table - mean, 0.0)


def six_products(a: np.ndarray, m1: np.ndarray, b: np.ndarray, m2: np.ndarray, bb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """correlations of centred rows a (m1: what they have) with columns b (m2; bb: their squares). In place, as memory is what it waits for."""
    n, sx, sy, xy = m1 @ m2, a @ m2, m1 @ b, a @ b
    shared = np.maximum(n, 1)
    moved = sx * sy
    moved /= shared
    xy -= moved
    square, flat, product = moved, None, None
    for total, squares in ((sx, (a * a) @ m2), (sy, m1 @ bb)):
        np.multiply(total, total, out=square)
        square /= shared
        np.subtract(squares, square, out=total)  # the sum of squares around the mean
        squares *= 1e-12
        low = total <= squares
        flat = low if flat is None else np.logical_or(flat, low, out=flat)
        product = total if product is None else np.multiply(product, total, out=product)
    product[flat] = 1.0
    xy /= np.sqrt(product, out=product)
    xy[flat] = np.nan
    return n, xy


#: Features of a block, and values of it, at most; features of the second block that are compared at a time, and of the first.
_BLOCK, _VALUES, _STRIP, _ROWS = 131_072, 1 << 22, 4_096, 8
#: Tasks that the groups of two blocks are dealt to, at most.
_TASKS = 4_096


def _tiles(table: np.ndarray, first: np.ndarray, second: np.ndarray, within: bool, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """correlation_rows of a strip of second at a time: the rows of both sides, and both. Inside a block strips leave out rows that come after them."""
    for at in range(0, len(second), _STRIP):
        part = second[at : at + _STRIP]
        for some, n, r in correlation_rows(table, first[first < part[-1]] if within else first, part, rows):
            yield some, part, n, r


def class_correlations(cells: DataFrame, least: int = 3, ranks: bool = False, block: int = _BLOCK, label: str = "lipid_class") -> DataFrame:
    """Label, id1, id2, n, r: the correlation of each pair of features of a class over their shared samples; with ranks, Spearman's.

    Values of 0 or less are missing; pairs with under `least` shared samples are left out, and r is null without
    spread. A feature's values are one array. A class is cut into blocks of about `block` features (fewer of many samples), and each pair of
    blocks is a group, of which numpy makes all products, 8 rows at a time; what is shuffled is an array for each block of the class.
    """
    placed, kinds = _blocks_of_classes(cells, ranks, block, label)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, table, first, second, within, _ = _block_tables(pa.Table.from_batches(batches), label)
        for some, part, n, r in _tiles(table, first, second, within, _ROWS):
            i, j = np.nonzero((n >= least) & (some[:, None] < part[None, :] if within else True))
            one, two, r = some[i], part[j], np.clip(r[i, j], -1, 1)
            columns = [names.take(pa.array(np.zeros(len(i), int))), ids.take(pa.array(np.minimum(one, two))), ids.take(pa.array(np.maximum(one, two))), pa.array(n[i, j].astype(np.int64)), pa.array(r, mask=np.isnan(r))]
            yield from pa.table(columns, names=[label, "id1", "id2", "n", "r"]).combine_chunks().to_batches()

    return placed.groupBy(label, "x", "y").applyInArrow(compare, f"`{label}` {kinds[label]}, id1 {kinds['feature_id']}, id2 {kinds['feature_id']}, n long, r double")


def _blocks_of_classes(cells: DataFrame, ranks: bool, block: int, label: str) -> tuple[DataFrame, dict[str, str]]:
    """A feature's values above 0, or their ranks, for each pair of blocks (x, y) of its class; side tells which of both is its own.

    Features with values in the same samples are in one block, unless they are more than a 32th of it. Only `packed` is written: an array for each
    block of a class is many times as much, so what goes over the blocks again deals it again.
    """
    known = cells.where("value > 0")
    if ranks:
        order = Window.partitionBy("feature_id").orderBy("value")
        known = known.withColumn("value", F.rank().over(order) + (F.count("*").over(Window.partitionBy("feature_id", "value")) - 1) / F.lit(2.0))
    packed = known.groupBy(label, "feature_id").agg(F.collect_list(F.struct("sample_id", F.col("value").cast("double").alias("value"))).alias("c"))
    packed = written(packed.select(label, "feature_id", F.col("c.sample_id").alias("samples"), F.col("c.value").alias("values")), "packed")
    packed = packed.withColumn("mask", F.xxhash64(F.sort_array("samples")))
    most = F.least(F.lit(block), F.greatest(F.lit(4_096), F.least(F.ceil(F.col("size") / 8), F.lit(_VALUES) / F.col("widest"))))  # blocks are small as long as a class has few
    blocks = packed.groupBy(label).agg(F.count("*").alias("size"), F.max(F.size("values")).alias("widest")).select(label, "size", F.ceil(F.col("size") / most).cast("int").alias("nb"))
    blocks = written(blocks, "blocks")
    groups = blocks.agg(F.sum(F.col("nb") * (F.col("nb") + 1) / 2)).first()[0] or 1
    blocks = F.broadcast(blocks)  # a row for each class
    common = packed.groupBy(label, "mask").agg(F.count("*").alias("of")).join(blocks.where("nb > 1"), label).where(F.col("of") * 32 * F.col("nb") > F.col("size"))
    common = F.broadcast(common.select(label, "mask", F.lit(True).alias("common")))  # 32 rows for each block at most
    dealt = F.xxhash64(F.when(F.col("common"), F.col("feature_id").cast("string")).otherwise(F.col("mask").cast("string")))
    mine = packed.join(blocks.drop("size"), label).join(common, [label, "mask"], "left").withColumn("mine", F.pmod(dealt, F.col("nb").cast("long")).cast("int"))
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = each.select(label, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "feature_id", "samples", "values")
    # Spark joins partitions by their bytes, but a group's work is their square.
    return placed.repartition(int(min(groups, _TASKS)), label, "x", "y"), dict(placed.dtypes)


def _block_tables(group: pa.Table, label: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, bool, pa.Array]:
    """The class, the ids in their order, the values by sample (NaN where missing), the rows of both blocks, whether they are one, and the samples."""
    group = group.sort_by("feature_id")
    samples, values = (group.column(k).combine_chunks() for k in ("samples", "values"))
    flat, size = samples.flatten(), samples.value_lengths().to_numpy(zero_copy_only=False)
    names = pc.unique(flat)
    table = np.full((len(group), len(names)), np.nan)
    table[np.repeat(np.arange(len(group)), size), pc.index_in(flat, names).to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
    within, side = group.column("x")[0] == group.column("y")[0], group.column("side").to_numpy()
    return group.column(label), group.column("feature_id"), table, np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1)), within, names


#: The ranges that r is counted in; the rows of one mask from which their partners' values are scaled for that mask, and how many of them are compared at a time.
_PLACES, _SHARED, _TOGETHER = 1 << 16, 4, 32


def _by_mask(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of what they have, and where a new mask begins; at the end their number."""
    bits = np.packbits(there, axis=1)
    order = np.lexsort(bits.T) if bits.shape[1] else np.arange(len(there))
    new = (bits[order][1:] != bits[order][:-1]).any(1)
    return order, np.r_[0, np.flatnonzero(new) + 1, len(there)] if len(there) else np.zeros(1, int)


def pair_sums(table: np.ndarray, first: np.ndarray, second: np.ndarray, within: bool, least: int, see: Callable[[np.ndarray], None] | None = None) -> tuple[int, float, float]:
    """Of the pairs of rows of first and second (each pair once, if they are one block) with `least` shared columns and a correlation: how many there are, and
    the sums of r and of |r|. With see all are 0, and see is given the r of each pair, some at a time.

    Rows of one mask share columns with all rows of another, so both sides are in the order of their masks. For a mask of the first the columns of
    second are centred and scaled over what they share, once for all rows of the mask; r is then one product, to be divided by the deviation of
    the first row, which there is one of for each mask of second. Rows of rare masks go by all six products.
    """
    there, table = centred(table)
    (of1, masks1), (of2, masks2) = (_by_mask(there[x]) for x in (first, second))
    x1, m1, x2, m2 = table[first[of1]], there[first[of1]].astype(float), table[second[of2]], there[second[of2]].astype(float)
    sizes = np.diff(masks1)
    shared = [(a, b) for a, b, n in zip(masks1[:-1].tolist(), masks1[1:].tolist(), sizes.tolist()) if n >= _SHARED]
    rare = np.flatnonzero(np.repeat(sizes < _SHARED, sizes))
    pairs, total, absolute = 0, 0.0, 0.0

    def seen(r: np.ndarray) -> None:
        nonlocal pairs, total, absolute
        if see is not None:
            see(r)
        else:
            pairs, total, absolute = pairs + len(r), total + float(r.sum()), absolute + float(np.abs(r).sum())

    for c0 in range(0, len(x2), _STRIP):
        c1 = min(c0 + _STRIP, len(x2))
        places, b, mb = np.arange(c0, c1), np.ascontiguousarray(x2[c0:c1].T), np.ascontiguousarray(m2[c0:c1].T)
        starts = np.r_[c0, masks2[(masks2 > c0) & (masks2 < c1)]]
        lengths, masks = np.diff(np.r_[starts, c1]), m2[starts]
        for q0, q1 in shared:
            q1 = min(q1, c1 - 1) if within else q1  # later rows have had these columns
            if q0 >= q1:
                break
            have = np.flatnonzero(m1[q0])
            n = masks[:, have].sum(1)
            enough = n >= least
            if not enough.any():
                continue
            z, mz, of, long, at = b[have], mb[have], masks[:, have], lengths, places
            if not enough.all():
                kept = np.repeat(enough, lengths)
                z, mz, of, long, at, n = z[:, kept], mz[:, kept], of[enough], lengths[enough], places[kept], n[enough]
            low = 1e-12 * np.einsum("kj,kj->j", z, z)
            mz *= z.sum(0) / np.repeat(n, long)
            z -= mz
            square = np.einsum("kj,kj->j", z, z)
            good = square > low
            all_good = good.all()
            z *= np.divide(1.0, np.sqrt(square), out=np.zeros(len(square)), where=good)
            runs = np.r_[0, np.cumsum(long)[:-1]]
            mask_of, z_sums, goods = np.repeat(np.arange(len(long)), long), np.add.reduceat(z, runs, axis=1), np.add.reduceat(good.astype(float), runs)
            many = max(_TOGETHER, (1 << 18) // len(long) // _TOGETHER * _TOGETHER)
            for a in range(q0, q1, many):
                x = x1[a : min(a + many, q1)][:, have]
                squares = (x * x) @ of.T
                around = squares - (x @ of.T) ** 2 / n
                spread = around > 1e-12 * squares
                scale = np.divide(1.0, np.sqrt(np.maximum(around, 0)), out=np.zeros(around.shape), where=spread)
                for k in range(0, len(x), _TOGETHER):
                    some, by = x[k : k + _TOGETHER], scale[k : k + _TOGETHER]
                    fit = spread[k : k + _TOGETHER]
                    start = 0
                    if within and a + k + len(some) > c0:  # columns up to the last of the rows by themselves, of which a pair is there twice
                        own, start = np.searchsorted(at, (a + k, a + k + len(some))).tolist()
                        r, near = some @ z[:, own:start], mask_of[own:start]
                        r *= by[:, near]
                        seen(r[fit[:, near] & good[own:start] & (at[own:start] > np.arange(a + k, a + k + len(some))[:, None])])
                    r, near = some @ z[:, start:], mask_of[start:]
                    if see is not None:
                        r *= np.take(by, near, axis=1)
                        seen(r.ravel() if all_good and fit.all() else r[np.take(fit, near, axis=1) & good[start:]])
                    elif start or len(runs) * 8 > r.shape[1]:
                        r *= np.take(by, near, axis=1)
                        pairs += int((fit @ (goods if not start else np.bincount(near, weights=good[start:], minlength=len(runs)))).sum())
                        total += float(r.sum())
                        absolute += float(np.abs(r, out=r).sum())
                    else:
                        pairs += int((fit @ goods).sum())
                        total += float((by * (some @ z_sums)).sum())
                        absolute += float((by * np.add.reduceat(np.abs(r, out=r), runs, axis=1)).sum())
        squares = b * b
        others = rare[rare < c1 - 1] if within else rare
        for k in range(0, len(others), _ROWS):
            some = others[k : k + _ROWS]
            start = max(0, int(some[0]) + 1 - c0) if within else 0
            n, r = six_products(x1[some], m1[some], b[:, start:], mb[:, start:], squares[:, start:])
            fit = (n >= least) & ~np.isnan(r)
            seen(r[fit & (places[start:] > some[:, None]) if within else fit])
    return pairs, total, absolute


def class_correlation_summary(cells: DataFrame, least: int = 3, ranks: bool = False, median: bool = True, label: str = "lipid_class", block: int = _BLOCK) -> DataFrame:
    """correlation_summary of class_correlations, of which no row is made.

    A group of two blocks is its pairs' count and sums, and the counts of r in ranges as wide as 2 / 65,536. The median's two places are in one
    or two ranges of a class; a second pass gives the values in these ranges with their counts, and no others. Without `median` there is none.
    """
    placed, kinds = _blocks_of_classes(cells, ranks, block, label)
    place_of = lambda r: ((r + 1) * (_PLACES / 2)).astype(np.int64)

    def sums(group: pa.Table) -> pa.Table:
        names, _, table, first, second, within, _ = _block_tables(group, label)
        counts, found = np.zeros(_PLACES + 1, np.int64), np.zeros(3)

        def count(r: np.ndarray) -> None:
            np.add(counts, np.bincount(place_of(r), minlength=_PLACES + 1), out=counts)
            found[1] += r.sum()
            found[2] += np.abs(r, out=r).sum()

        pairs, total, absolute = pair_sums(table, first, second, within, least, count if median else None)
        if median:
            counts[-2:] = counts[-2:].sum(), 0  # r = 1 is in the last range
            pairs, total, absolute = int(counts.sum()), float(found[1]), float(found[2])
        at = np.flatnonzero(counts)
        head, zeros = names.take(pa.array([0])), names.take(pa.array(np.zeros(len(at), int)))
        first = pa.table([head, pa.array([-1], pa.int64()), pa.array([pairs], pa.int64()), pa.array([total]), pa.array([absolute])], names=[label, "at", "size", "total", "absolute"])
        return pa.concat_tables([first, pa.table([zeros, pa.array(at), pa.array(counts[at]), pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.float64())], names=first.column_names)])

    found = placed.groupBy(label, "x", "y").applyInArrow(sums, f"`{label}` {kinds[label]}, at long, size long, total double, absolute double")
    found = written(found.groupBy(label, "at").agg(F.sum("size").alias("size"), F.sum("total").alias("total"), F.sum("absolute").alias("absolute")), "sums")
    out = found.where("at = -1 AND size > 0").select(label, F.col("size").alias("pairs"), (F.col("total") / F.col("size")).alias("mean_r"), (F.col("absolute") / F.col("size")).alias("mean_abs_r"))
    if not median:
        return out
    up = Window.partitionBy(label).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # _PLACES rows at most
    ends = found.where("at >= 0").withColumn("end", F.sum("size").over(up)).withColumn("start", F.col("end") - F.col("size")).join(out.select(label, "pairs"), label)
    places = (F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2))
    needed = ends.where(((F.col("start") <= places[0]) & (F.col("end") > places[0])) | ((F.col("start") <= places[1]) & (F.col("end") > places[1])))
    needed = needed.groupBy(label).agg(F.collect_list("at").alias("ranges"), F.min("start").alias("start"))
    aimed = placed.join(F.broadcast(needed.select(label, "ranges")), label)  # a row for each class

    def values(group: pa.Table) -> pa.Table:
        want, kept = np.array(group.column("ranges")[0].as_py()), []
        low, high = want.min() / (_PLACES / 2) - 1 - 1e-9, (want.max() + 1) / (_PLACES / 2) - 1 + 1e-9
        _, _, table, first, second, within, _ = _block_tables(group, label)

        def keep(r: np.ndarray) -> None:
            r = np.clip(r[(r >= low) & (r <= high)], -1, 1)
            kept.append(r[np.isin(np.minimum(place_of(r), _PLACES - 1), want)])

        pair_sums(table, first, second, within, least, keep)
        r, n = np.unique(np.concatenate(kept) if kept else np.zeros(0), return_counts=True)
        return pa.table([group.column(label).take(pa.array(np.zeros(len(r), int))), pa.array(r), pa.array(n.astype(np.int64))], names=[label, "r", "n"])

    near = aimed.groupBy(label, "x", "y").applyInArrow(values, f"`{label}` {kinds[label]}, r double, n long").groupBy(label, "r").agg(F.sum("n").alias("n"))
    before = near.join(F.broadcast(needed.select(label, "start")), label).join(F.broadcast(out.select(label, "pairs")), label)  # a row for each class
    up = Window.partitionBy(label).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the values of a range or two
    before = before.withColumn("end", F.col("start") + F.sum("n").over(up))
    at = lambda p: F.min(F.when(F.col("end") > p, F.col("r")))
    return out.join(before.groupBy(label).agg(((at(places[0]) + at(places[1])) / 2).alias("median_r")), label)


def correlation_summary(correlations: DataFrame) -> DataFrame:
    """Pairs, mean, median and mean absolute correlation for each class; pairs without a correlation don't count."""
    correlations = written(correlations.where("r IS NOT NULL").select("lipid_class", "r"), "correlations")  # read twice, and costly to make
    sums = correlations.groupBy("lipid_class").agg(F.count("r").alias("pairs"), F.avg("r").alias("mean_r"), F.avg(F.abs("r")).alias("mean_abs_r"))
    return sums.join(percentiles(correlations, "r", {"median_r": 0.5}, "lipid_class"), "lipid_class")


def differential_correlation(cells: DataFrame, group1: str, group2: str, with_p: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """Fisher's z of the difference of two groups' correlations, p and rate, for pairs with four samples or more in both.

    Pairs without a correlation in one of the groups are left out. Both groups' correlations of a pair are made side by side in the
    blocks of class_correlations, so no pair is shuffled for z. Rates need all p in order: with only, a pair is shuffled with these columns and p.
    """
    of = cells.where(F.col("grp").isin(group1, group2)).withColumn("sample_id", F.concat(F.when(F.col("grp") == group1, "1|").otherwise("2|"), F.col("sample_id").cast("string")))
    placed, kinds = _blocks_of_classes(of, False, _BLOCK, "lipid_class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, table, first, second, within, samples = _block_tables(pa.Table.from_batches(batches), "lipid_class")
        mine = pc.starts_with(samples, "1|").to_numpy(zero_copy_only=False).astype(bool)
        for (some, part, n1, r1), (_, _, n2, r2) in zip(_tiles(table[:, mine], first, second, within, _ROWS), _tiles(table[:, ~mine], first, second, within, _ROWS)):
            i, j = np.nonzero((n1 >= 4) & (n2 >= 4) & ~np.isnan(r1) & ~np.isnan(r2) & (some[:, None] < part[None, :] if within else True))
            one, two = some[i], part[j]
            columns = [names.take(pa.array(np.zeros(len(i), int))), ids.take(pa.array(np.minimum(one, two))), ids.take(pa.array(np.maximum(one, two)))]
            columns += [pa.array(x) for r, n in ((r1, n1), (r2, n2)) for x in (np.clip(r[i, j], -1, 1), n[i, j].astype(np.int64))]
            yield from pa.table(columns, names=["lipid_class", "id1", "id2", "r1", "n1", "r2", "n2"]).combine_chunks().to_batches()

    schema = f"lipid_class {kinds['lipid_class']}, id1 {kinds['feature_id']}, id2 {kinds['feature_id']}, r1 double, n1 long, r2 double, n2 long"
    of = placed.groupBy("lipid_class", "x", "y").applyInArrow(compare, schema)
    edge = lambda c: F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col(c)))
    z = (F.atanh(edge("r1")) - F.atanh(edge("r2"))) / F.sqrt(1 / (F.col("n1") - 3) + 1 / (F.col("n2") - 3))
    of = of.withColumn("delta_r", F.col("r1") - F.col("r2")).withColumn("z", z)
    return benjamini_hochberg(of.withColumn("p", normal_p("z")).select(*(of.columns if only is None else only), "p")) if with_p else of


def class_trajectory(cells: DataFrame) -> DataFrame:
    """The mean of a class's z (sample deviation) for each sample, then for each group."""
    of = Window.partitionBy("feature_id")
    z = (F.col("value") - F.avg("value").over(of)) / F.nullif(F.stddev_samp("value").over(of), F.lit(0.0))
    per_sample = cells.withColumn("z", z).groupBy("lipid_class", "grp", "sample_id").agg(F.avg("z").alias("z"))
    return per_sample.groupBy("lipid_class", "grp").agg(F.avg("z").alias("score"))


def gram(z: DataFrame) -> DataFrame:
    """M2: the products of each pair of samples over features: s1, s2, g, with s1 <= s2.

    A feature's row has as many values as there are samples; each partition adds its features' outer products in numpy,
    so that what is shuffled is one matrix a partition, whatever the number of features.
    """
    packed = z.groupBy("feature_id").agg(F.collect_list(F.struct("sample_id", "z")).alias("c"))
    kind = dict(z.dtypes)["sample_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict = {}
        total = np.zeros((0, 0))
        for batch in batches:
            for c in batch["c"]:
                at = [ids.setdefault(x["sample_id"], len(ids)) for x in c]
                if len(ids) > len(total):
                    grown = np.zeros((len(ids), len(ids)))
                    grown[: len(total), : len(total)] = total
                    total = grown
                v = np.array([x["z"] for x in c])
                total[np.ix_(at, at)] += np.outer(v, v)
        names = list(ids)
        yield pd.DataFrame([(a, b, total[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if a <= b], columns=["s1", "s2", "g"])

    return packed.select("c").mapInPandas(run, f"s1 {kind}, s2 {kind}, g double").groupBy("s1", "s2").agg(F.sum("g").alias("g"))


def distances(products: DataFrame) -> DataFrame:
    """M2: Euclidean distances of samples: s1, s2, distance, for s1 < s2."""
    own = products.where("s1 = s2")
    a, b = own.select(F.col("s1"), F.col("g").alias("g1")), own.select(F.col("s1").alias("s2"), F.col("g").alias("g2"))
    square = F.col("g1") + F.col("g2") - 2 * F.col("g")
    return products.where("s1 < s2").join(F.broadcast(a), "s1").join(F.broadcast(b), "s2").select("s1", "s2", F.sqrt(F.greatest(F.lit(0.0), square)).alias("distance"))  # a row for each sample


def _matrix(rows: DataFrame, value: str, names: list, most: int = MOST_SAMPLES) -> np.ndarray:
    """s1, s2, value as a symmetric matrix on the driver, of at most `most` samples; ValueError for more."""
    if len(names) > most:
        raise ValueError(f"more than {most} samples")
    at = pd.Index(names)
    found = rows.select("s1", "s2", F.col(value).cast("double").alias("v")).toArrow()  # a row for each pair of samples
    i, j, v = at.get_indexer(found["s1"].to_pylist()), at.get_indexer(found["s2"].to_pylist()), found["v"].to_numpy()
    ok = (i >= 0) & (j >= 0)
    out = np.zeros((len(names), len(names)))
    out[i[ok], j[ok]] = out[j[ok], i[ok]] = v[ok]
    return out


def principal_components(products: DataFrame, k: int = 3, most: int = MOST_SAMPLES) -> tuple[list, np.ndarray, np.ndarray]:
    """M1: (samples, scores, share of variance) of the first k components, from the samples' products.

    The matrix of samples goes to the driver, if there are no more than `most`. Signs are such that each component's
    largest score is positive. An empty table has no samples, and scores of shape (0, k).
    """
    own = [r["s"] for r in products.where("s1 = s2").select(F.col("s1").alias("s")).distinct().orderBy("s").limit(most + 1).collect()]
    if not own:
        return [], np.zeros((0, k)), np.zeros(k)
    g = _matrix(products, "g", own, most)
    middle = np.eye(len(own)) - 1 / len(own)
    values, vectors = np.linalg.eigh(middle @ g @ middle)
    values, vectors = np.clip(values[::-1][:k], 0, None), vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    trace = np.trace(middle @ g @ middle)
    return own, vectors * np.sqrt(values), values / trace if trace > 0 else values


def iterated_components(z: DataFrame, k: int = 3, passes: int = 60, tolerance: float = 1e-9, spare: int = 4) -> tuple[DataFrame, list[float]]:
    """M1 for any number of samples: (sample_id, pc1 to pck) and the share of variance of each, by iteration of a block of directions.

    z: feature_id, sample_id, z; cells that are missing are 0. A pass multiplies the long table with a thin matrix of k + spare columns, on the
    side of the samples and then of the features, each a join and an aggregate; only sums of pairs of columns go to the driver. It
    ends when none of the k variances changes by more than the tolerance, or after so many passes. Signs are those of principal_components. Components
    beyond the rank are 0; an empty table has no rows, and shares of 0.
    """
    m = k + spare
    cells = written(z.select("feature_id", "sample_id", F.col("z").cast("double").alias("z")).where("z IS NOT NULL"), "z")
    names = [f"v{j}" for j in range(m)]
    # Any start will do; this one depends on the samples only.
    v = cells.select("sample_id").distinct().select("sample_id", *(((F.pmod(F.xxhash64("sample_id", F.lit(j)), F.lit(1 << 20)) + 0.5) / (1 << 20) - 0.5).alias(n) for j, n in enumerate(names)))
    v, before = written(v, "directions"), None

    def moments(of: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        row = of.agg(*(F.sum(F.col(a) * F.col(b)) for a in left for b in right)).first()
        return np.array([x or 0.0 for x in row], float).reshape(len(left), len(right))

    def times(of: DataFrame, matrix: np.ndarray, means: np.ndarray, out: list[str]) -> list:
        """The columns of `of`, less their means, times a small matrix."""
        return [sum(((F.col(n) - float(means[i])) * float(matrix[i, j]) for i, n in enumerate(names)), F.lit(0.0)).alias(c) for j, c in enumerate(out)]

    def whitened(of: DataFrame) -> DataFrame:
        n = of.count()
        means = np.array([x or 0.0 for x in of.agg(*(F.avg(c) for c in names)).first()], float)
        values, vectors = np.linalg.eigh(moments(of, names, names) - n * np.outer(means, means))
        scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        return written(of.select("sample_id", *times(of, vectors * scale, means, names)), "directions")

    v = whitened(v)
    for _ in range(passes):
        thin = cells.join(v, "sample_id").groupBy("feature_id").agg(*(F.sum(F.col("z") * F.col(n)).alias(n) for n in names))
        next_ = written(cells.join(thin, "feature_id").groupBy("sample_id").agg(*(F.sum(F.col("z") * F.col(n)).alias(n) for n in names)), "products")
        both = v.join(next_.select("sample_id", *(F.col(n).alias(f"u{n}") for n in names)), "sample_id")
        inner = moments(both, names, [f"u{n}" for n in names])  # v is centred, so the mean of the products has no part in it
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        if before is not None and np.abs(values[:k] - before[:k]).max() <= tolerance * max(values[0], 1e-300):
            break
        before, v = values, whitened(next_)
    named = [f"pc{j + 1}" for j in range(k)]
    n = v.count()
    scores = v.select("sample_id", *times(v, vectors[:, :k] * np.sqrt(values[:k]), np.zeros(m), named))
    total = cells.agg(F.sum(F.col("z") ** 2)).first()[0] or 0.0
    spread = cells.groupBy("feature_id").agg((F.sum("z") ** 2).alias("s")).agg(F.sum("s")).first()[0] or 0.0
    total -= spread / max(1, n)
    turn = scores.agg(*(F.max_by(F.signum(c), F.abs(F.round(c, 9))) for c in named)).first()
    scores = scores.select("sample_id", *((F.col(c) * F.lit(float(t or 1.0))).alias(c) for c, t in zip(named, turn)))
    return scores, [float(x / total) if total > 0 else 0.0 for x in values[:k]]


def components_without_outliers(cells: DataFrame, k: int = 3, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """M1: scores (sample_id, pc1 to pck, is_outlier) of all samples, and those of the samples that are no outliers in the first two
    components (M4), scaled anew without them.

    cells: feature_id, sample_id, value. Up to MOST_SAMPLES samples the samples' products are used, beyond an iteration. Without outliers both
    are of the same samples; with fewer than two samples left the second table is empty.
    """
    def scored(of: DataFrame) -> DataFrame:
        z = written(autoscale(of), "scaled")
        if z.select("sample_id").distinct().limit(MOST_SAMPLES + 1).count() > MOST_SAMPLES:
            return iterated_components(z, k)[0]
        names, scores, _ = principal_components(gram(z), k)
        scores = np.pad(scores, ((0, 0), (0, k - scores.shape[1])))
        return z.sparkSession.createDataFrame([(s, *map(float, row)) for s, row in zip(names, scores, strict=True)], f"sample_id {dict(of.dtypes)['sample_id']}, " + ", ".join(f"pc{j + 1} double" for j in range(k)))

    every = written(scored(cells), "scores")
    marked = written(every.join(mahalanobis_outliers(every, alpha).select("sample_id", "is_outlier"), "sample_id"), "scores")
    left = marked.where("NOT is_outlier").select("sample_id")
    if left.limit(2).count() < 2:
        return marked, every.limit(0)
    return marked, scored(cells.join(left, "sample_id", "left_semi"))


def loadings(z: DataFrame, names: list, scores: np.ndarray) -> DataFrame:
    """M1: feature_id, component, loading: each feature's weight in each component of principal_components; 0 for one without spread.

    One aggregate over the features' rows; the scores are sent to all tasks, a row for each sample.
    """
    square = (scores**2).sum(0)
    parts = np.divide(scores, square, out=np.zeros_like(scores), where=square > 1e-18)
    parts = parts - parts.mean(0) if len(parts) else parts
    named = [f"pc{a + 1}" for a in range(scores.shape[1])]
    by_sample = z.sparkSession.createDataFrame([(s, *map(float, row)) for s, row in zip(names, parts, strict=True)], f"sample_id {dict(z.dtypes)['sample_id']}, " + ", ".join(f"{c} double" for c in named))
    sums = z.join(F.broadcast(by_sample), "sample_id").groupBy("feature_id").agg(*(F.sum(F.col("z") * F.col(c)).alias(c) for c in named))
    return sums.unpivot(["feature_id"], named, "component", "loading")


def permanova_f(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """M3: the pseudo-F of groups from distances. pairs: s1, s2, distance; samples: sample_id, grp."""
    a, b = (samples.select(F.col("sample_id").alias(f"s{k}"), F.col("grp").alias(f"g{k}")) for k in (1, 2))
    of = pairs.join(F.broadcast(a), "s1").join(F.broadcast(b), "s2")
    sizes = samples.groupBy("grp").agg(F.count("*").alias("size"))
    total = of.agg(F.sum(F.col("distance") ** 2).alias("all_square"))
    within = of.where("g1 = g2").groupBy(F.col("g1").alias("grp")).agg(F.sum(F.col("distance") ** 2).alias("square")).join(sizes, "grp").agg(F.sum(F.col("square") / F.col("size")).alias("ssw"))
    n = sizes.agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    one = total.crossJoin(within).crossJoin(n)  # one row each
    sst = F.col("all_square") / F.col("n")
    return one.select(sst.alias("sst"), "ssw", (((sst - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"))


def permanova_p(pairs: DataFrame, samples: DataFrame, permutations: int = 1000, seed: int = 0) -> DataFrame:
    """M3: f and the share of label permutations with as large a pseudo-F.

    Distances of at most MOST_SAMPLES samples go to the driver, and from there to all tasks; permutations are spread over
    tasks as rows. Without distances, or with one group, f and p are null.
    """
    labels = {r["sample_id"]: r["grp"] for r in samples.limit(MOST_SAMPLES + 1).collect()}
    names = sorted(labels, key=str)
    d2 = _matrix(pairs, "distance", names) ** 2
    if not 1 < len(set(labels.values())) < len(names) or not d2.any():
        return samples.sparkSession.createDataFrame([(None, None)], "f double, p double")
    codes = np.unique([labels[s] for s in names], return_inverse=True)[1]

    def pseudo_f(c: np.ndarray) -> float:
        n, k = len(c), c.max() + 1
        sst = d2.sum() / 2 / n
        ssw = sum(d2[np.ix_(c == g, c == g)].sum() / 2 / (c == g).sum() for g in range(k))
        return ((sst - ssw) / (k - 1)) / (ssw / (n - k))

    observed = pseudo_f(codes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [pseudo_f(np.random.default_rng((seed, int(i))).permutation(codes)) >= observed - 1e-12 for i in batch["id"]]
            yield pd.DataFrame({"hit": np.array(hits, np.int64)})

    spark = samples.sparkSession
    return spark.range(permutations).mapInPandas(run, "hit long").agg(F.lit(float(observed)).alias("f"), ((F.sum("hit") + 1) / F.lit(permutations + 1.0)).alias("p"))


def permanova_of_values(z: DataFrame, samples: DataFrame, permutations: int = 1000, seed: int = 0) -> DataFrame:
    """M3 without distances, for any number of samples: f and the share of label permutations with as large a pseudo-F, as permanova_p gives them.

    z: feature_id, sample_id, z, of which missing cells are 0; samples: sample_id, grp; those without any cell are left out. For Euclidean distances what is between groups follows from
    the groups' sums: a feature's values are an array, and a batch of features times the groups of a block of permutations is one product. What
    a task returns is a number for each permutation. With one group, or as many groups as samples, or no values, f and p are null.
    """
    seen = samples.join(z.where("z IS NOT NULL").select("sample_id").distinct(), "sample_id", "left_semi")
    labels = {r["sample_id"]: r["grp"] for r in seen.toLocalIterator()}  # a label for each sample
    names = sorted(labels, key=str)
    spark = samples.sparkSession
    if not 1 < len(set(labels.values())) < len(names):
        return spark.createDataFrame([(None, None)], "f double, p double")
    codes = np.unique([labels[s] for s in names], return_inverse=True)[1].astype(np.int32)
    n, k, block = len(codes), int(codes.max()) + 1, 32
    place = spark.createDataFrame([(s, i) for i, s in enumerate(names)], f"sample_id {dict(samples.dtypes)['sample_id']}, place int")
    packed = z.where("z IS NOT NULL").join(place, "sample_id").groupBy("feature_id").agg(F.collect_list(F.struct("place", F.col("z").cast("double").alias("z"))).alias("c")).select("c.place", "c.z")
    shared = spark.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = shared.value, np.bincount(shared.value, minlength=k)
        between, square, sums = np.zeros(permutations + 1), 0.0, 0.0
        rows = max(1, min(1_024, (1 << 22) // n))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                lengths = batch.column(0).value_lengths().to_numpy()
                table = np.zeros((batch.num_rows, n))
                table[np.repeat(np.arange(batch.num_rows), lengths), batch.column(0).flatten().to_numpy()] = batch.column(1).flatten().to_numpy()
                square, sums = square + float((table**2).sum()), sums + float((table.sum(1) ** 2).sum())
                for first in range(0, permutations + 1, block):
                    last = min(first + block, permutations + 1)
                    dealt = np.stack([own if i == 0 else np.random.default_rng((seed, i - 1)).permutation(own) for i in range(first, last)])
                    groups = np.zeros((n, (last - first) * k))
                    groups[np.tile(np.arange(n), last - first), (np.arange(last - first)[:, None] * k + dealt).ravel()] = 1.0
                    between[first:last] += (((table @ groups) ** 2).sum(0).reshape(-1, k) / sizes).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(permutations + 3)), pa.array(np.append(between, [square, sums]))], names=["i", "x"])

    found = {r["i"]: r["x"] for r in packed.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}  # a row for each permutation
    x = np.array([found.get(i, 0.0) for i in range(permutations + 3)])
    between, square, sums = x[: permutations + 1], x[-2], x[-1]
    sst, ssw = square - sums / n, square - between
    if sst <= 1e-12 * max(square, 1e-300):
        return spark.createDataFrame([(None, None)], "f double, p double")
    f = ((sst - ssw) / (k - 1)) / (ssw / (n - k))
    return spark.createDataFrame([(float(f[0]), float(((f[1:] >= f[0] - 1e-12).sum() + 1) / (permutations + 1)))], "f double, p double")


def silhouette(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """M5: the mean silhouette of the groups, from distances."""
    both = pairs.unionByName(pairs.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "distance"))
    a, b = (samples.select(F.col("sample_id").alias(f"s{k}"), F.col("grp").alias(f"g{k}")) for k in (1, 2))
    of = both.join(F.broadcast(a), "s1").join(F.broadcast(b), "s2").groupBy("s1", "g1", "g2").agg(F.avg("distance").alias("d"))
    each = of.groupBy("s1").agg(F.max(F.when(F.col("g1") == F.col("g2"), F.col("d"))).alias("own"), F.min(F.when(F.col("g1") != F.col("g2"), F.col("d"))).alias("other"))
    value = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return each.agg(F.avg(value).alias("silhouette"))


def _batch_columns(rows: list) -> dict:
    """For each sample its batch as a number, if nine in ten are numbers (others get the median), else as 0/1 columns."""
    def number(x: object) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return float("nan")

    values = np.array([number(r["batch"]) for r in rows])
    if len(values) and np.isfinite(values).mean() >= 0.9:
        filled = np.where(np.isfinite(values), values, np.median(values[np.isfinite(values)]))
        return {r["sample_id"]: [v] for r, v in zip(rows, filled.tolist(), strict=True)} if np.ptp(filled) > 0 else {r["sample_id"]: [] for r in rows}
    names = sorted({str(r["batch"]) for r in rows})[1:]
    return {r["sample_id"]: [float(str(r["batch"]) == b) for b in names] for r in rows}


def _inverses(design: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of samples that are there whether they allow a full fit, and the inverse of their design's products, all in one stack."""
    x, n, inverse = design * there[:, :, None], there.sum(1), np.zeros((len(there), design.shape[1], design.shape[1]))
    full = (n >= 3) & (n > design.shape[1])
    full[full] = np.linalg.matrix_rank(x[full]) == design.shape[1]
    inverse[full] = np.linalg.inv(x[full].transpose(0, 2, 1) @ x[full])
    return full, inverse


def moderated_test(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """log2 values on group and batch for each feature, with variances shrunk to a common prior; each pair of groups is contrasted.

    samples: sample_id, grp, batch (at most MOST_SAMPLES, sent to all tasks). Returns feature_id, grp1, grp2, effect, t, df, p and
    fdr (within each pair of groups). The prior is the mean of log variances, with 2 over their variance as degrees of freedom,
    between 4 and 100; with under ten features the median and 4. Features lacking values for a full fit are left out, and
    those without a residual. Values that are null or in no sample don't count; an empty table gives an empty result.

    The design's products are inverted once for each set of samples that a batch's features have, all sets in one stack, and the
    fits of all features of a batch are two products, of which missing values have no part.
    """
    rows = samples.orderBy("sample_id").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    groups = sorted({r["grp"] for r in rows})
    batch = _batch_columns(rows)
    design = np.array([[1.0, *(float(r["grp"] == g) for g in groups[1:]), *batch[r["sample_id"]]] for r in rows]) if rows else np.zeros((0, 1))
    place = samples.sparkSession.createDataFrame([(r["sample_id"], i) for i, r in enumerate(rows)], f"sample_id {dict(samples.dtypes)['sample_id']}, place int")
    first = percentiles(cells.where("value > 0"), "value", {"p1": 0.01}).first()
    floor = first["p1"] if first else 0.0
    known = cells.where("value IS NOT NULL").join(F.broadcast(place), "sample_id")  # a row for each sample
    packed = known.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("place", F.log2(F.col("value") + floor).alias("y")))).alias("c"))
    packed = packed.select("feature_id", F.col("c.place").alias("places"), F.col("c.y").alias("y"))
    ways = {}
    for i, a in enumerate(groups):
        for j in range(i + 1, len(groups)):
            way = np.zeros(design.shape[1])
            way[j] = -1.0
            if i:
                way[i] = 1.0
            ways[a, groups[j]] = way
    kind = dict(cells.dtypes)["feature_id"]

    names = [pa.array(x) for x in zip(*ways)] or [pa.array([], pa.string())] * 2
    way = np.array(list(ways.values())).reshape(len(ways), design.shape[1])
    step = max(1, (1 << 22) // max(1, design.size))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            lengths, flat, values = part.column(1).value_lengths().to_numpy(), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
            there, y = np.zeros((len(lengths), len(rows)), bool), np.zeros((len(lengths), len(rows)))
            row = np.repeat(np.arange(len(lengths)), lengths)
            there[row, flat], y[row, flat] = True, values
            _, one, pattern = np.unique(np.packbits(there, axis=1).view(f"V{-(-len(rows) // 8)}").ravel() if len(rows) else np.zeros(len(lengths)), return_index=True, return_inverse=True)
            full, inverse = _inverses(design, there[one])
            mine = np.flatnonzero(full[pattern])
            if not len(mine) or not len(ways):
                continue
            of, y, there, n = pattern[mine], y[mine], there[mine], there[mine].sum(1)
            beta = np.einsum("kij,kj->ki", inverse[of], y @ design)
            s2 = (np.where(there, y - beta @ design.T, 0.0) ** 2).sum(1) / (n - design.shape[1])
            v = np.einsum("wi,kij,wj->kw", way, inverse, way, optimize=True)[of]
            m, k = len(mine), len(ways)
            columns = [part.column(0).take(pa.array(np.repeat(mine, k))), *(x.take(pa.array(np.tile(np.arange(k), m))) for x in names), *(pa.array(x.ravel()) for x in (beta @ way.T, v)), pa.array(np.repeat(s2, k)), pa.array(np.repeat((n - design.shape[1]).astype(np.int32), k))]
            yield pa.RecordBatch.from_arrays(columns, names=["feature_id", "grp1", "grp2", "effect", "v", "s2", "df"])

    fits = written(packed.mapInArrow(fit, f"feature_id {kind}, grp1 string, grp2 string, effect double, v double, s2 double, df int").where("s2 > 0"), "fits")
    one = fits.groupBy("feature_id").agg(F.first("s2").alias("s2"))
    prior = one.agg(F.count("*").alias("k"), F.avg(F.log("s2")).alias("m"), F.var_samp(F.log("s2")).alias("w")).join(one.limit(10).agg(F.median("s2").alias("mid")))  # the median counts with under ten features only
    d0 = F.when(F.col("k") < 10, F.lit(4.0)).otherwise(F.greatest(F.lit(4.0), F.least(F.lit(100.0), 2 / F.greatest(F.col("w"), F.lit(1e-6)))))
    of = fits.crossJoin(F.broadcast(prior.select(F.when(F.col("k") < 10, F.col("mid")).otherwise(F.exp("m")).alias("s0"), d0.alias("d0"))))  # one row
    s2 = (F.col("d0") * F.col("s0") + F.col("df") * F.col("s2")) / (F.col("d0") + F.col("df"))
    out = of.select("feature_id", "grp1", "grp2", "effect", (F.col("effect") / F.sqrt(s2 * F.col("v"))).alias("t"), (F.col("d0") + F.col("df")).alias("df"))
    return benjamini_hochberg(out.withColumn("p", t_p_batches("t", "df")), "grp1", "grp2")


def mahalanobis_outliers(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """M4: samples whose squared distance in two components is beyond the chi-squared quantile, -2 ln(alpha).

    scores: sample_id, pc1, pc2.
    """
    m = scores.agg(
        F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"), F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"), F.covar_samp("pc1", "pc2").alias("c"))
    of = scores.crossJoin(F.broadcast(m))  # one row
    a, b, det = F.col("pc1") - F.col("m1"), F.col("pc2") - F.col("m2"), F.col("v1") * F.col("v2") - F.col("c") ** 2
    square = (F.col("v2") * a * a - 2 * F.col("c") * a * b + F.col("v1") * b * b) / F.when(det > 1e-18, det)
    return of.select("sample_id", square.alias("d2"), F.coalesce(square > F.lit(float(-2 * np.log(alpha))), F.lit(False)).alias("is_outlier"))


def sample_correlations(z: DataFrame, top: int | None = None) -> DataFrame:
    """The correlation of each pair of samples over features; with top, of the samples with the highest mean |r|."""
    of = pair_correlations(z)
    if top is None:
        return of
    both = of.select("s1", "r").unionByName(of.select(F.col("s2").alias("s1"), "r"))
    best = both.groupBy("s1").agg(F.avg(F.abs("r")).alias("strength")).orderBy(F.round("strength", 9).desc(), "s1").limit(top).select("s1")
    return of.join(F.broadcast(best), "s1").join(F.broadcast(best.withColumnRenamed("s1", "s2")), "s2").select("s1", "s2", "r", "n")


def _forest_rows(cells: DataFrame, samples: DataFrame, features: list, folds: int, seed: int) -> tuple[DataFrame, list]:
    """A row for each sample: label, weight, features as a vector, fold; and the groups by label."""
    from pyspark.ml.functions import array_to_vector

    wide = cells.where(F.col("feature_id").isin(*features)).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "z"))).alias("m"))
    vector = array_to_vector(F.array(*(F.coalesce(F.try_element_at("m", F.lit(f)), F.lit(0.0)) for f in features)))
    names = [r["grp"] for r in samples.select("grp").distinct().orderBy("grp").collect()]
    codes = F.array_position(F.array(*map(F.lit, names)), F.col("grp")) - 1
    sizes = samples.groupBy("grp").agg(F.count("*").alias("size"))
    of = samples.join(wide, "sample_id").join(F.broadcast(sizes), "grp")
    deal = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("sample_id", F.lit(seed)))) % folds
    return of.select("sample_id", "grp", codes.cast("double").alias("label"), (1 / F.col("size")).alias("weight"), vector.alias("features"), deal.alias("fold")), names


def forest_importances(cells: DataFrame, samples: DataFrame, features: list, trees: int = 500, seed: int = 0) -> DataFrame:
    """M6: feature_id, importance in a forest of all samples, which add up to 1."""
    from pyspark.ml.classification import RandomForestClassifier

    of, _ = _forest_rows(cells, samples, features, 2, seed)
    model = RandomForestClassifier(numTrees=trees, weightCol="weight", seed=seed).fit(of)
    kind = dict(cells.dtypes)["feature_id"]
    return cells.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())], f"feature_id {kind}, importance double")


def forest_predictions(cells: DataFrame, samples: DataFrame, features: list, folds: int = 3, trees: int = 500, seed: int = 0) -> DataFrame:
    """M6: the group that a random forest predicts for each sample when its fold is left out: sample_id, grp, predicted.

    features: the ids that are columns of the model, chosen beforehand (W6). Classes weigh the same; folds are dealt
    within each group.
    """
    from pyspark.ml.classification import RandomForestClassifier

    of, names = _forest_rows(cells, samples, features, folds, seed)
    of = of.cache()  # a row for each sample
    out = None
    for k in range(folds):
        model = RandomForestClassifier(numTrees=trees, weightCol="weight", seed=seed).fit(of.where(F.col("fold") != k))
        part = model.transform(of.where(F.col("fold") == k)).select("sample_id", "grp", F.element_at(F.array(*map(F.lit, names)), (F.col("prediction") + 1).cast("int")).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def discriminant_components(products: DataFrame, z: DataFrame, samples: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """M7: (sample_id, component, score) and (feature_id, vip) of a projection that follows the groups.

    The samples' products are enough for the scores: with the groups as 0/1 columns y, a component is the products
    times the leading direction of y, made orthogonal to those before it. A feature's weight is its sum over samples of z
    times that direction, one aggregate; VIP weighs squared weights with what each component explains of y. At most
    MOST_SAMPLES samples; without samples, or with one group, both tables are empty.
    """
    groups = {r["sample_id"]: r["grp"] for r in samples.limit(MOST_SAMPLES + 1).collect()}
    names = sorted(groups, key=str)
    g = _matrix(products, "g", names)
    y = np.array([[float(groups[s] == c) for c in sorted(set(groups.values()))] for s in names])
    y = y - y.mean(0) if names else y.reshape(0, 0)
    middle = np.eye(len(names)) - 1 / max(1, len(names))
    g, scores, directions, explained = middle @ g @ middle, [], [], []
    for _ in range(k if y.shape[1] > 1 else 0):
        values, vectors = np.linalg.eigh(y.T @ g @ y)
        u = y @ vectors[:, -1]
        t = g @ u
        if (norm := np.linalg.norm(t)) < 1e-12:
            break
        t = t / norm
        away = np.eye(len(names)) - np.outer(t, t)
        directions.append(u.copy())
        scores.append(t)
        explained.append(float(((y.T @ t) ** 2).sum()))
        g, y = away @ g @ away, away @ y
    spark = samples.sparkSession
    if not scores:
        empty = f"sample_id {dict(z.dtypes)['sample_id']}, component int, score double"
        return spark.createDataFrame([], empty), z.select("feature_id", F.lit(0.0).alias("vip")).limit(0)
    done = np.eye(len(names))
    weights = []
    for t, u in zip(scores, directions, strict=True):
        weights.append(middle @ done @ u)
        done = (np.eye(len(names)) - np.outer(t, t)) @ done
    kind = dict(z.dtypes)["sample_id"]
    by_sample = spark.createDataFrame([(s, *(float(w[i]) for w in weights)) for i, s in enumerate(names)], f"sample_id {kind}, " + ", ".join(f"w{a} double" for a in range(len(weights))))
    sums = z.join(F.broadcast(by_sample), "sample_id").groupBy("feature_id").agg(*(F.sum(F.col("z") * F.col(f"w{a}")).alias(f"w{a}") for a in range(len(weights))))
    norms = sums.agg(F.count("*").alias("p"), *(F.sum(F.col(f"w{a}") ** 2).alias(f"n{a}") for a in range(len(weights))))
    part = sum((F.lit(e) * F.col(f"w{a}") ** 2 / F.col(f"n{a}") for a, e in enumerate(explained)), F.lit(0.0))
    vip = sums.crossJoin(F.broadcast(norms)).select("feature_id", F.sqrt(F.col("p") * part / F.lit(sum(explained) or 1.0)).alias("vip"))  # one row
    table = spark.createDataFrame([(s, a + 1, float(t[i])) for a, t in enumerate(scores) for i, s in enumerate(names)], f"sample_id {kind}, component int, score double")
    return table, vip


def discriminant_q2(products: DataFrame, samples: DataFrame, k: int = 2, folds: int = 5, seed: int = 0) -> DataFrame:
    """M7: q2 and accuracy of the projection when a sample's fold is left out: one row; q2 is null with one group.

    A left-out sample's scores follow from its products with the others, so no feature is read again. Folds are dealt by
    a hash of the sample. A prediction is the group whose column the regression on the scores gives the highest value.
    """
    groups = {r["sample_id"]: r["grp"] for r in samples.limit(MOST_SAMPLES + 1).collect()}
    names = sorted(groups, key=str)
    g = _matrix(products, "g", names)
    classes = sorted(set(groups.values()))
    y = np.array([[float(groups[s] == c) for c in classes] for s in names]).reshape(len(names), len(classes))
    fold = np.random.default_rng(seed).permutation(len(names)) % max(2, min(folds, len(names) or 2))
    found = np.zeros_like(y)
    for f in sorted(set(fold.tolist())) if len(classes) > 1 else ():
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        mean = y[inside].mean(0)
        own = g[np.ix_(inside, inside)]
        cross = g[np.ix_(outside, inside)]
        cross = cross - cross.mean(1, keepdims=True) - own.mean(0)[None, :] + own.mean()
        own = own - own.mean(0)[None, :] - own.mean(1)[:, None] + own.mean()
        left, fit = y[inside] - mean, np.zeros((len(outside), len(classes)))
        for _ in range(k):
            vectors = np.linalg.eigh(left.T @ own @ left)[1]
            u = left @ vectors[:, -1]
            t = own @ u
            if (size := float(t @ t)) < 1e-18:
                break
            there, q = cross @ u, left.T @ t / size
            fit += np.outer(there, q)
            cross = cross - np.outer(there, t @ own) / size
            away = np.eye(len(inside)) - np.outer(t, t) / size
            own, left = away @ own @ away, left - np.outer(t, q)
            cross = cross @ away
        found[outside] = mean + fit
    total = float(((y - y.mean(0)) ** 2).sum()) if len(names) else 0.0
    q2 = 1 - float(((y - found) ** 2).sum()) / total if total > 0 else None
    accuracy = float((found.argmax(1) == y.argmax(1)).mean()) if total > 0 else None
    return samples.sparkSession.createDataFrame([(q2, accuracy)], "q2 double, accuracy double")


def prediction_metrics(predictions: DataFrame) -> DataFrame:
    """M6: accuracy and macro-F1 of predictions (grp, predicted): one row."""
    counts = predictions.groupBy("grp", "predicted").agg(F.count("*").alias("n"))  # a row for each pair of groups
    hit = F.sum(F.when(F.col("grp") == F.col("predicted"), F.col("n")).otherwise(0))
    truth = counts.groupBy("grp").agg(F.sum("n").alias("n_true"), hit.alias("hit"))
    said = counts.groupBy(F.col("predicted").alias("grp")).agg(F.sum("n").alias("n_said"))
    f1 = 2 * F.col("hit") / (F.col("n_true") + F.coalesce("n_said", F.lit(0)))
    return truth.join(F.broadcast(said), "grp", "left").agg((F.sum("hit") / F.sum("n_true")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def pair_correlations(z: DataFrame) -> DataFrame:
    """s1, s2, r, n: the correlation of each pair of samples over the features that both have.

    Each partition adds up its features' sums and products in numpy, as gram does, so what is shuffled is one matrix a
    partition; the number of samples bounds it.
    """
    packed = z.groupBy("feature_id").agg(F.collect_list(F.struct("sample_id", "z")).alias("c"))
    kind = dict(z.dtypes)["sample_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict = {}
        total = np.zeros((4, 0, 0))
        for batch in batches:
            for c in batch["c"]:
                at = [ids.setdefault(x["sample_id"], len(ids)) for x in c]
                if len(ids) > total.shape[1]:
                    grown = np.zeros((4, len(ids), len(ids)))
                    grown[:, : total.shape[1], : total.shape[1]] = total
                    total = grown
                v = np.array([x["z"] for x in c])
                one = np.ones(len(v))
                for k, (x, y) in enumerate(((one, one), (v, one), (v * v, one), (v, v))):
                    total[k][np.ix_(at, at)] += np.outer(x, y)
        names = list(ids)
        rows = [(a, b, *(float(total[k, i, j]) for k in range(4)), float(total[1, j, i]), float(total[2, j, i])) for i, a in enumerate(names) for j, b in enumerate(names) if a < b]
        yield pd.DataFrame(rows, columns=["s1", "s2", "n", "x", "xx", "xy", "y", "yy"])

    sums = packed.select("c").mapInPandas(run, f"s1 {kind}, s2 {kind}, n double, x double, xx double, xy double, y double, yy double")
    t = sums.groupBy("s1", "s2").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx", "xy", "y", "yy"))).where("n > 0")
    vx, vy = F.col("xx") - F.col("x") ** 2 / F.col("n"), F.col("yy") - F.col("y") ** 2 / F.col("n")
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(F.when((vx > 1e-12) & (vy > 1e-12), vx * vy))
    return t.select("s1", "s2", r.alias("r"), F.col("n").cast("long").alias("n"))
