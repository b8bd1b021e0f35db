"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

Texts become sets of hashed 5-word shingles. Equal sets form a class, of which the smallest id goes on. Bands of a
MinHash signature propose pairs; an odd sketch (the parity bitmap of the signature's samples) estimates a pair's
similarity from the population count of an XOR, and pairs far below the threshold go; the others are confirmed on
their full sets. Pairs of a bucket are never rows. Members are first compared with a few leaders, which merges most of
them; each bucket's largest component then meets the bucket's other members, and these meet among themselves, by
sketches in blocks of a bounded size. Texts are read again only for members that have a promising partner in a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import WordHashes, as_bytes, lists, mix, shingle_set, signed, written

WIDTH, THRESHOLD = 5, (75, 100)
#: A pair at the threshold shares none of 32 bands of 4 rows with a probability of (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
SAMPLES, BITS = BANDS * ROWS, 512
#: Five standard deviations (of 128 samples at 0.75: 0.038) under the threshold.
MARGIN = 0.20
#: Differing bits of two sketches that stand for the threshold less the margin.
MOST_DIFFERING = int(BITS / 2 * (1 - np.exp((THRESHOLD[0] / THRESHOLD[1] - MARGIN - 1) * 4 * SAMPLES / BITS)))
#: Leaders of a bucket, with which its members are compared before all remaining pairs are tried.
LEADERS = 3
#: Members of a component that is compared as a whole, at least, and of a block, about.
LARGE, BLOCK = 16, 512
#: Members of a bucket whose pairs are rows, at most.
SMALL = 16
#: Pairs of one text that meet in a task, at most.
PAIRS_PER_TASK = 200

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)[:, None]
_STRETCH = 8192


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The signature of a set that is not empty; long sets are taken in blocks."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    return np.minimum.reduce([(x[:, k : k + _STRETCH] * _A + _B).min(axis=1) for k in range(0, x.shape[1], _STRETCH)])


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def odd_sketches(signatures: np.ndarray) -> np.ndarray:
    """The parity of the number of samples that fall on each of BITS bits, as 64-bit words."""
    at = (mix(signatures.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))[None, :]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    n = len(signatures)
    parity = np.bincount((at + (np.arange(n) * BITS)[:, None]).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view(np.uint64)


def estimate(differing: Column) -> Column:
    """The similarity that so many differing bits of two odd sketches stand for."""
    return 1 + F.lit(BITS / (4 * SAMPLES)) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * differing / BITS))


def differing_bits(left: Column, right: Column) -> Column:
    return sum((F.bit_count(left[k].bitwiseXOR(right[k])) for k in range(1, BITS // 64)), F.bit_count(left[0].bitwiseXOR(right[0])))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, h1, h2 (a 128-bit key of the set), bands, odd; the last four are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, keys, rows, empty = [], [], [], []
                for text in as_bytes(batch.column(1)):
                    s = shingle_set(text, WIDTH, cache)
                    sizes.append(len(s))
                    empty.append(not len(s))
                    keys.append((int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))))
                    rows.append(minhash(s) if len(s) else np.zeros(SAMPLES, np.uint32))
                signatures, keys = np.array(rows).reshape(-1, SAMPLES), signed(np.array(keys, np.uint64).reshape(-1, 2))
                null = pa.array(empty)
                none = lambda column: pa.compute.if_else(null, pa.scalar(None, column.type), column)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), none(pa.array(keys[:, 0])), none(pa.array(keys[:, 1])), none(lists(signed(bands(signatures)))), none(lists(signed(odd_sketches(signatures))))],
                    names=["id", "n_shingles", "h1", "h2", "bands", "odd"],
                )

    import pyarrow.compute  # noqa: F401

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, h1 long, h2 long, bands array<long>, odd array<long>")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets reach the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. texts: (id, text).

    A text with many pairs goes to as many tasks as its pairs need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, kept = WordHashes(), (None, None)
        for batch in batches:
            good = []
            for left, right in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                if left != kept[0]:
                    kept = (left, shingle_set(left, WIDTH, cache))
                other = shingle_set(right, WIDTH, cache)
                good.append(_linked(kept[1], other))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("shares"))
    left = texts.join(shares.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.col("text").alias("left"), "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares").cast("long")).cast("int")).join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "share", "right")
    both = right.join(left, ["a", "share"]).select("a", "b", "left", "right")
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _promising(pairs: DataFrame, about: DataFrame) -> DataFrame:
    a, b = about.select(F.col("id").alias("a"), F.col("odd").alias("odd_a")), about.select(F.col("id").alias("b"), F.col("odd").alias("odd_b"))
    near = differing_bits(F.col("odd_a"), F.col("odd_b")) <= MOST_DIFFERING
    return pairs.distinct().join(a, "a").join(b, "b").where(near).select("a", "b").distinct()


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Each member with each of LEADERS leaders of its bucket, if they are not in one component yet.

    A leader is first by a hash that is the same in all buckets, so that the buckets of a group have the same leaders.
    """
    first = members.groupBy("key").agg(*(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "label")).alias(f"l{k}") for k in range(LEADERS)))
    leaders = first.select("key", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"l{k}.id").alias("lead"), F.col(f"l{k}.label").alias("of")) for k in range(LEADERS))))).alias("x")).select("key", "x.lead", "x.of")
    return members.join(leaders, "key").where("label != of").select(*_ordered(F.col("id"), F.col("lead"))).distinct()


def _compared(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between members of different components that meet in a group, one for each component at least.

    members: group columns g, x, y, and side, id, label, odd, bands, band. A group has two sides, whose members are compared with
    each other, or one, whose members are compared among themselves; a group is of a bounded size. Sketches only are sent to
    the groups first. Members that have a promising partner of another component there are sent once more, with their
    texts, and promising pairs are confirmed on full sets, the closest first, until the two components are one.
    Where band is given, a pair is tried in the first bucket that it shares, and in no other.
    """
    kind = dict(members.dtypes)["id"]
    key = ["g", "x", "y"]

    def close(left: pd.DataFrame, right: pd.DataFrame, within: bool) -> Iterator[tuple[int, np.ndarray]]:
        """For each place of right: the places of left that are promising partners, the closest first."""
        a, b = (np.array(list(f["odd"]), np.int64).view(np.uint64).reshape(-1, BITS // 64) for f in (left, right))
        la, lb = (f["label"].to_numpy() for f in (left, right))
        band = int(left["band"].iloc[0])
        ka, kb = (np.array(list(f["bands"]), np.int64).reshape(len(f), -1)[:, : max(0, band)] for f in (left, right))
        for j in range(len(b)):
            end = j if within else len(a)
            differing = np.bitwise_count(a[:end] ^ b[j][None, :]).sum(1, dtype=np.int64)
            at = np.flatnonzero((differing <= MOST_DIFFERING) & (la[:end] != lb[j]))
            if band > 0 and len(at):
                at = at[~(ka[at] == kb[j][None, :]).any(1)]
            yield j, at[np.argsort(differing[at], kind="stable")]

    def sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
        group = group.sort_values("id", kind="stable")
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        return (left, left, True) if int(group["x"].iloc[0]) == int(group["y"].iloc[0]) else (left, right, False)

    def wanted(group: pd.DataFrame) -> pd.DataFrame:
        left, right, within = sides(group)
        asked: set = set()
        if len(left) and len(right):
            for j, at in close(left, right, within):
                if len(at):
                    asked.add((int(right["side"].iloc[j]), right["id"].iloc[j]))
                    asked.update((0, i) for i in left["id"].to_numpy()[at].tolist())
        first = group.iloc[0]
        return pd.DataFrame([(first["g"], first["x"], first["y"], side, i) for side, i in asked], columns=[*key, "side", "id"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right, within = sides(group)
        out, cache = [], WordHashes()
        if len(left) and len(right):
            ids, names = left["id"].tolist(), right["id"].tolist()
            of_left, of_right = left["label"].tolist(), right["label"].tolist()
            up: dict = {}

            def root(label: object) -> object:
                while label in up:
                    label = up[label]
                return label

            sets: dict[int, np.ndarray] = {}
            left_texts, right_texts = left["text"].tolist(), right["text"].tolist()
            for j, at in close(left, right, within):
                mine = None
                for k in at.tolist():
                    if (x := root(of_left[k])) == (y := root(of_right[j])):
                        continue
                    if k not in sets:
                        sets[k] = shingle_set(left_texts[k].encode(), WIDTH, cache)
                    mine = shingle_set(right_texts[j].encode(), WIDTH, cache) if mine is None else mine
                    if _linked(sets[k], mine):
                        up[x] = y
                        out.append((ids[k], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    asked = written(members.groupBy(*key).applyInPandas(wanted, f"g long, x int, y int, side int, id {kind}"), "asked")
    full = members.join(asked, [*key, "side", "id"], "left_semi").join(texts, "id")
    return full.groupBy(*key).applyInPandas(compare, f"a {kind}, b {kind}")


def _block(n: Column | str) -> Column:
    return F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("long")).cast("int")


def _blocks(n: Column | str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int") - 1))


def _with_large(pairs: DataFrame, members: DataFrame, sizes: DataFrame, about: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between large components and the members of others that share buckets with them.

    pairs: large (a label), id; members: id, label; sizes: label, size; about: id, odd, bands. Both sides are cut into blocks of
    about BLOCK members, and each pair of blocks is a group. Each id is compared with every member of the component.
    """
    counts = pairs.groupBy("large").agg(F.count("*").alias("others")).join(sizes.select(F.col("label").alias("large"), "size"), "large")
    own = members.select("id", "label").join(counts.withColumnRenamed("large", "label"), "label").select(F.col("label").alias("g"), _block("size").alias("x"), _blocks("others").alias("y"), F.lit(0).alias("side"), "id", "label")
    rest = pairs.join(counts, "large").join(members, "id").select(F.col("large").alias("g"), _blocks("size").alias("x"), _block("others").alias("y"), F.lit(1).alias("side"), "id", "label")
    groups = own.unionByName(rest).withColumns({"g": F.xxhash64("g"), "y": (-1 - F.col("y")).cast("int"), "band": F.lit(-1)})
    return _compared(groups.join(about, "id"), texts)


def _in_buckets(rows: DataFrame, about: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between members of a bucket that are in different components. rows: key, band, id, label.

    The pairs of a bucket of at most SMALL members are rows, of which there are at most SMALL / 2 for a member. A bucket of
    at most BLOCK members is a group; a larger one is cut into blocks, of which each pair is a group.
    """
    open_ = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "n")
    sized = written(rows.join(open_, "key"), "sized")
    small = sized.where(F.col("n") <= SMALL).select("key", "id", "label")
    pairs = small.join(small.select("key", F.col("id").alias("other"), F.col("label").alias("of")), "key").where("id < other and label != of").select(F.col("id").alias("a"), F.col("other").alias("b"))
    mine = sized.where(F.col("n") > SMALL).withColumn("mine", _block("n")).withColumn("other", _blocks("n"))
    placed = mine.select(F.col("key").alias("g"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "label", "band")
    return confirm(written(_promising(pairs, about), "pairs"), texts).unionByName(_compared(placed.join(about, "id"), texts))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, classes, labels): sketches of all rows; (h1, h2, rep) for each distinct set; (node, label) for linked reps."""
    sketches = written(sketch(docs, id_col, text_col), "sketches")
    named = sketches.where("n_shingles > 0 and id is not null")
    classes = written(named.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    reps = named.join(classes.select("rep", F.col("h1").alias("x1"), F.col("h2").alias("x2")), (F.col("id") == F.col("rep")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))).select("id", "bands", "odd").dropDuplicates(["id"])
    keyed = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = written(keyed.join(shared, "key"), "members")
    found = members.select("id").distinct()
    texts = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(found, "id", "left_semi").dropDuplicates(["id"]), "texts")
    about = written(reps.join(found, "id", "left_semi").select("id", "odd", "bands"), "about")

    # An id on several rows with different texts ties their classes together.
    sets = named.select("id", "h1", "h2").distinct()
    twice = sets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    tied = sets.join(twice, "id", "left_semi").join(classes, ["h1", "h2"]).where("id != rep")
    labels = connected_components(tied.select(F.col("id").alias("a"), F.col("rep").alias("b")))

    def merged(edges: DataFrame) -> DataFrame:
        return connected_components(edges.unionByName(labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))))

    def labelled(of: DataFrame) -> DataFrame:
        """of with the labels so far, and the buckets that still hold more than one component."""
        left = of.join(labels.select(F.col("node").alias("id"), F.col("label").alias("known")), "id", "left").select("key", "band", "id", F.coalesce("known", "id").alias("label"))
        open_ = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        return written(left.join(open_, "key"), "open")

    labels = merged(confirm(written(_promising(_leader_pairs(labelled(members)), about), "pairs"), texts))
    # Each bucket's largest component meets the bucket's other members: most of them join it.
    open_ = labelled(members)
    of = written(found.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label")), "components")
    sizes = of.groupBy("label").agg(F.count("*").alias("size"))
    top = open_.select("key", "label").distinct().join(sizes, "label").groupBy("key").agg(F.max(F.struct("size", "label")).alias("top")).where(F.col("top.size") >= LARGE).select("key", F.col("top.label").alias("large"))
    others = written(open_.join(top, "key", "left").where(F.col("large").isNull() | (F.col("label") != F.col("large"))), "others")
    pairs = written(others.where(F.col("large").isNotNull()).select("large", "id").distinct(), "pairs")
    labels = merged(_with_large(pairs, of, sizes, about, texts))
    # Those others meet among themselves.
    now = others.select("key", "band", "id", F.col("label").alias("before")).join(labels.select(F.col("node").alias("id"), F.col("label").alias("known")), "id", "left")
    labels = merged(_in_buckets(written(now.select("key", "band", "id", F.coalesce("known", "before").alias("label")), "rest"), about, texts))
    return sketches, classes, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_shingles, component_id (the smallest id reachable over links, itself included), kept.

    Two rows are linked if 100 * intersection >= 75 * union of their sets of distinct 5-word shingles (A-Z in lower
    case, words between ASCII white space; a text of fewer words is one shingle). Null and empty texts have no shingles
    and are linked with nothing. A row with a null id stands alone: its component is null and it is kept. Repeated rows
    are each returned; an id on rows with different texts links them. An empty table gives an empty result. Columns
    other than the two named are not read.
    """
    sketches, classes, labels = links(docs, id_col, text_col)
    component = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component_id"))
    return sketches.select("id", "n_shingles", "h1", "h2").join(component, ["h1", "h2"], "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their group, with all their columns; of rows with one id, all stay."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
