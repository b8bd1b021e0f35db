"""Source divergence audit: how far the words of a language's sources are from each other, and from the language as a whole.

CountVectorizer makes an exact sparse vector of each document, over the terms that enough documents of its language have.
Vectors are summed up by source, inside each task first. Sources are then compared in blocks of terms and of sources, by the
terms that one of the two has; for all others both are at the value of a count of 0, and the difference is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_bytes, written

#: Documents of the language that have a kept term, at least. Added to each count. What a share of 1 is worth.
MIN_DOCS, ADDED, ONE = 30, 5, 1_000_000_000
#: Terms of the largest excess that a source is given.
TOP_TERMS = 50
#: Terms that one vocabulary holds: it is on the driver and on each executor. More are counted in slices of their hashes.
SLICE_TERMS = 1_000_000
#: Terms and sources of a block, in which sources are compared.
TERM_BLOCK, SOURCE_BLOCK = 1_024, 128
#: Sums that a task holds before it returns them; texts whose terms are made at a time.
_HELD, _ROWS = 1_500_000, 256

#: ASCII letters in lower case, bytes of other characters as they are, the rest as 0.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256)], np.uint8)
_END = "\x00"  # of a language's name; a term has no control characters


def split_terms(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of texts, one text after the other, and how many each has. No text is null."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    lower = _LETTERS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = lower != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < len(lower)]
    first[borders] = inside[borders]  # a text's first character begins a term, whatever the text before ends with
    starts = np.append(np.flatnonzero(first[inside]), int(inside.sum())).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.tobytes()), pa.py_buffer(lower[inside].tobytes()))
    return found, np.diff(np.searchsorted(np.flatnonzero(first), ends))


def _plain(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def terms(plain: DataFrame, k: int = 0, n: int = 1, once: bool = False) -> DataFrame:
    """lang, source, terms: the terms of each text (once: each once), each after its language, so that one vocabulary keeps
    languages apart; of n slices of them the k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):  # few texts at a time, so that their terms are few
                batch = whole.slice(start, _ROWS)
                found, counts = split_terms(batch.column(2).cast(pa.string()))
                rows, flat = np.repeat(np.arange(batch.num_rows), counts), pc.dictionary_encode(pc.binary_join_element_wise(batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts))), found, _END))
                code = flat.indices.to_numpy()
                if n > 1:
                    mine = np.array([xxhash.xxh3_64_intdigest(t) % n == k for t in as_bytes(flat.dictionary)], bool)[code]
                    rows, code = rows[mine], code[mine]
                if once:
                    both = np.unique((rows << 32) | code)
                    rows, code = both >> 32, both & 0xFFFFFFFF
                ends = np.append(0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), flat.dictionary.take(pa.array(code)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], names=["lang", "source", "terms"])

    return plain.mapInArrow(run, "lang string, source string, terms array<string>")


def _vocabulary(plain: DataFrame, k: int, n: int, min_docs: int):  # noqa: ANN202
    """The fitted model of a slice of the terms, or None where no term is kept."""
    try:
        return CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1).fit(terms(plain, k, n, once=True))
    except IllegalArgumentException as e:
        if "vocabulary" not in str(e).lower():
            raise
        return None


def _sums(vectors: DataFrame) -> DataFrame:
    """lang, source, place, count: sums of the vectors of each source; a task returns a row for each of its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, value = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
            key, at = np.unique(key, return_inverse=True)
            total, known = np.bincount(at, value, len(key)), list(names)
            columns = [pa.array([x[c] for x in known], pa.string()).take(pa.array(key >> 32)) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(key & 0xFFFFFFFF), pa.array(total.astype(np.int64))], names=["lang", "source", "place", "count"])

        for batch in batches:
            group = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            vector = batch.column(2)
            places, values = vector.field("indices"), vector.field("values")
            rows = np.repeat(group, places.value_lengths().to_numpy(zero_copy_only=False))
            held.append(((rows << 32) | places.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()))
            if sum(len(k) for k, _ in held) > _HELD:
                yield out()
                names, held = {}, []
        if held:
            yield out()

    return vectors.mapInArrow(run, "lang string, source string, place long, count long")


def source_counts(docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame]:
    """(place, lang, term) of the kept terms, and (lang, source, place, count): a source's occurrences of each, where it has any.

    Both are written. A term is kept if `min_docs` documents of its language have it.
    """
    plain = _plain(docs, lang_col, source_col, text_col)
    spark, slices, vocabulary, counts, first, k = docs.sparkSession, 1, None, None, 0, 0
    while k < slices:
        try:
            model = _vocabulary(plain, k, slices, min_docs)
            size = len(model.vocabulary) if model else 0
        except PySparkException as e:
            if "maxResultSize" not in str(e):
                raise
            size = 4 * slice_terms  # more than the driver takes: in quarters
        if size > slice_terms:
            slices, vocabulary, counts, first, k = slices * -(-size // slice_terms) + 1, None, None, 0, 0
            continue
        k += 1
        if not size:
            continue
        named = [t.rpartition(_END) for t in model.vocabulary]
        table = pa.table({"place": pa.array(range(first, first + size), pa.int64()), "lang": pa.array([x[0] for x in named], pa.string()), "term": pa.array([x[2] for x in named], pa.string())})
        part = written(_sums(model.transform(terms(plain, k - 1, slices)).select("lang", "source", "vector")).groupBy("lang", "source", "place").agg(F.sum("count").alias("count")), "sums").withColumn("place", F.col("place") + first)
        words = written(spark.createDataFrame(table), "vocabulary")
        vocabulary, counts = (words, part) if vocabulary is None else (vocabulary.unionByName(words), counts.unionByName(part))
        first += size
    if vocabulary is None:
        return spark.createDataFrame([], "place long, lang string, term string"), spark.createDataFrame([], "lang string, source string, place long, count long")
    return vocabulary, counts


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(ONE * (count + ADDED) / (total + ADDED * size)), exactly."""
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(38, 0)) * ({count} + {ADDED})) div CAST({total} + {ADDED} * {size} AS DECIMAL(38, 0))")


def _compared(cells: DataFrame, groups: DataFrame, term_block: int, source_block: int) -> DataFrame:
    """lang, source, other, excess: the sum over kept terms of the difference of shares, less the difference at a count of 0.

    cells: (lang, source, place, share); groups: (lang, source, base), base being the share of a count of 0. A task has a block
    of terms, and one or two blocks of the language's sources, as a matrix; sources without any of the terms are in it too.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("lang")) / source_block)).cast("int")
    placed = written(groups.select("lang", "source", "base", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "sources")
    met = placed.select("lang", "source", "base", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    met = met.select("lang", "source", "base", "own", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"))
    tiled = cells.withColumn("tile", F.expr(f"place div {term_block}"))
    tiles = tiled.select("lang", "tile").distinct()
    heads = met.join(tiles, "lang").select("lang", "tile", "a", "b", "source", "own", "base", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("share"))
    rows = tiled.join(met, ["lang", "source"]).select("lang", "tile", "a", "b", "source", "own", "base", "place", "share").unionByName(heads)

    def compare(table: pa.Table) -> pa.Table:
        lang, place = table["lang"][0].as_py(), table["place"]
        head = pc.is_null(place)
        top = table.filter(head)
        names, base, own = top["source"].to_pylist(), top["base"].to_numpy(), top["own"].to_numpy()
        at, body = {n: i for i, n in enumerate(names)}, table.filter(pc.invert(head))
        known, column = np.unique(body["place"].to_numpy(), return_inverse=True)
        shares = np.repeat(base[:, None], len(known), 1)
        shares[[at[n] for n in body["source"].to_pylist()], column] = body["share"].to_numpy()
        one, two, excess = [], [], []
        for i in range(len(names)):
            other = np.flatnonzero(own != own[i]) if len(set(own)) > 1 else np.arange(len(names))
            other = other[other > i]
            far = np.abs(shares[other] - shares[i]).sum(1) - len(known) * np.abs(base[other] - base[i])
            for x, y in ((np.full(len(other), i), other), (other, np.full(len(other), i))):
                one.append(x), two.append(y), excess.append(far)
        taken = lambda x: [names[i] for i in np.concatenate(x).tolist()]
        return pa.table({"lang": pa.array([lang] * sum(map(len, one)), pa.string()), "source": pa.array(taken(one), pa.string()), "other": pa.array(taken(two), pa.string()), "excess": pa.array(np.concatenate(excess).astype(np.int64))})

    each = rows.groupBy("lang", "tile", "a", "b").applyInArrow(compare, "lang string, source string, other string, excess long")
    return each.groupBy("lang", "source", "other").agg(F.sum("excess").alias("excess"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               slice_terms: int = SLICE_TERMS, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: item is each other source of the language, value the sum of differences between their smoothed shares of all
    kept terms. Part term: the `top` terms whose share in the source is furthest above that in the language. Shares are whole
    numbers of billionths. Null texts, languages and sources are like empty ones; a source without kept terms has pairs, and a
    language with one source has none; repeated rows each count. Empty tables give an empty result; other columns are not read.
    """
    vocabulary, counts = source_counts(docs, min_docs, lang_col, source_col, text_col, slice_terms)
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("size"))
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))
    base = F.when(F.col("size") > 0, _share("0", "total", "size")).otherwise(0)
    groups = written(groups.withColumn("base", base), "groups")
    cells = written(counts.join(groups, ["lang", "source"]).select("lang", "source", "place", _share("count", "total", "size").alias("share"), "count"), "cells")

    whole = counts.groupBy("lang", "place").agg(F.sum("count").alias("count")).join(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("size").alias("size")), "lang")
    named = vocabulary.select("place", "term").join(whole.select("place", _share("count", "total", "size").alias("usual")), "place")
    above = cells.join(named, "place").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("usual")).alias("value")).where("value > 0")

    one, two = (groups.select("lang", F.col("source").alias(n), F.col("base").alias(f"{n}_base"), "size") for n in ("source", "other"))
    both = one.join(two.drop("size"), "lang").where("source <> other").join(_compared(cells, groups, term_block, source_block), ["lang", "source", "other"], "left")
    apart = F.col("size") * F.abs(F.col("source_base") - F.col("other_base")) + F.coalesce("excess", F.lit(0))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), apart.cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranks = F.row_number().over(order)
    return pairs.withColumn("rank", ranks).unionByName(above.withColumn("rank", ranks).where(F.col("rank") <= top))
