"""Phrase collocation mining with counting quotient filters.

Words that are frequent enough to be in a phrase have numbers. A phrase's numbers are packed to one integer, which is
permuted: a bijection, so nothing is lost. Its first bits, the quotient, say where it is in a filter, and the rest, the
remainder, is kept whole beside a count. Tasks fill filters, filters are dealt out by the first bits of the quotient, and
the sorted filters of a shard are merged, which adds up equal entries. Longer phrases are counted only where
both phrases that they are made of, without their last and their first word, are frequent; the others can't be.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_bytes, mix, written

LEAST, LONGEST, TOP = 30, 4, 2_000
#: A candidate goes if a longer one that holds it occurs INSIDE times a hundredth as often. What a score is multiplied by.
INSIDE, SCALE = 80, 2_000_000
#: Bytes of words that are numbered in one pass over the texts; more words are numbered in as many passes as it takes.
DICTIONARY_BYTES = 48 << 20
#: Parts that words are numbered in.
PARTS = 64
#: Phrases of the text that a task holds before it makes a filter of them; occurrences that a shard merges, about; shards at least, in bits.
HELD, SHARD, LEAST_BITS = 1 << 19, 4 << 20, 7
#: Texts that are taken apart at a time.
ROWS = 256
#: Bits of the table of frequent phrases that is shipped, at least and at most (bounds of 128 KB and 64 MB).
TABLE_BITS = (20, 29)

_STOP = b"\xff"  # in no text: the end of a piece
_PLAIN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHE_LIMIT = 200_000


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, with _STOP between pieces."""
    return text.translate(_PLAIN).replace(_STOP, b" \xff ").split(b" ") if text else []


# The filters


class Permutation:
    """A bijection of `bits` bits (an even number, up to 128), as two halves, and its inverse: four rounds of a Feistel network."""

    def __init__(self, bits: int):
        self.half = np.uint64(bits // 2)
        self.mask = np.uint64((1 << (bits // 2)) - 1)

    def _round(self, x: np.ndarray, k: int) -> np.ndarray:
        return (mix(x + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) >> np.uint64(64 - int(self.half))) & self.mask

    def forward(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in (1, 3):
            left = left ^ self._round(right, k)
            right = right ^ self._round(left, k + 1)
        return left, right

    def back(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in (3, 1):
            right = right ^ self._round(left, k + 1)
            left = left ^ self._round(right, k)
        return left, right


def counted(left: np.ndarray, right: np.ndarray, half: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts."""
    counts = np.ones(len(left), np.int64) if counts is None else counts
    if 2 * half <= 64:
        key = (left << np.uint64(half)) | right
        order = np.argsort(key, kind="stable")  # runs that are in order are merged
    else:
        order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    starts = np.flatnonzero(new)
    return left[starts], right[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _narrow(x: np.ndarray, bits: int) -> bytes:
    """The low bytes of each number, as many as the bits need."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _wide(data: bytes, n: int, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8").reshape(n).astype(np.uint64)


def filter_of(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, shard: int, shard_bits: int) -> bytes:
    """A shard's sorted entries as a counting quotient filter.

    The quotient is the shard and the next bits of the left half, about as many as tell the entries apart. Kept are the number
    of entries of each quotient, of each entry the remainder (the rest of the left half, and the right half), and its count: a
    byte, or 255 and the whole count in a list of its own.
    """
    n = len(left)
    bits = min(half, shard_bits + max(0, n.bit_length() - 2))
    rest = half - bits
    runs = np.bincount((left >> np.uint64(rest)).astype(np.int64) - (shard << (bits - shard_bits)), minlength=1 << (bits - shard_bits))
    kind = np.dtype("<u1" if runs.max(initial=0) < 256 else "<u8")
    small = np.minimum(counts, 255).astype(np.uint8)
    body = [runs.astype(kind).tobytes(), _narrow(left & np.uint64((1 << rest) - 1), rest), _narrow(right, half), small.tobytes(), counts[small == 255].astype("<i8").tobytes()]
    return struct.pack("<QIBBBB", n, shard, bits, shard_bits, kind.itemsize, half) + b"".join(body)


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A filter's entries, in order: left and right half, and count."""
    n, shard, bits, shard_bits, size, half = struct.unpack_from("<QIBBBB", data)
    at, rest = struct.calcsize("<QIBBBB"), half - bits
    cut = lambda length: data[at : at + length]
    quotients = 1 << (bits - shard_bits)
    runs = np.frombuffer(cut(quotients * size), f"<u{size}").astype(np.int64)
    at += quotients * size
    low = _wide(cut(n * -(-rest // 8)), n, rest) if rest else np.zeros(n, np.uint64)
    at += n * -(-rest // 8)
    right = _wide(cut(n * -(-half // 8)), n, half)
    at += n * -(-half // 8)
    counts = np.frombuffer(cut(n), np.uint8).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(data[at:], "<i8")
    quotient = np.repeat(np.arange(quotients, dtype=np.uint64), runs) + np.uint64(shard << (bits - shard_bits))
    return (quotient << np.uint64(rest)) | low, right, counts


# Words and their numbers


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f over all texts. docs: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, of in counts.items():
                of.pop(_STOP, None), of.pop(b"", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.array(list(of), pa.string()), pa.array(list(of.values()), pa.int64())], names=["lang", "word", "f"])
            counts.clear()

        for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                counts.setdefault(lang, Counter()).update(pieces(text))
            if sum(map(len, counts.values())) > _CACHE_LIMIT:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """words with id, from 1 without gaps; parts of them are numbered by themselves, each after the last of those before."""
    of = written(words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(PARTS)).cast("int")), "frequent")
    sizes = of.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # PARTS rows
    return written(of.join(before, "part").withColumn("id", F.row_number().over(Window.partitionBy("part").orderBy("lang", "word")) + F.col("before")).drop("before"), "words")


def encoded(docs: DataFrame, words: DataFrame) -> DataFrame:
    """ids: the numbers of each text's words, 0 for words without one and between pieces, in a written table.

    Where the words are more than DICTIONARY_BYTES, a part of them is looked up in each pass, and the table is written again.
    """
    sizes = {r["part"]: r["size"] for r in words.groupBy("part").agg(F.sum(F.octet_length("word") + 100).alias("size")).collect()}  # PARTS rows at most
    passes: list[list[int]] = [[]]
    for part, size in sorted(sizes.items()):
        if passes[-1] and sum(sizes[p] for p in passes[-1]) + size > DICTIONARY_BYTES:
            passes.append([])
        passes[-1].append(part)
    spark, of = docs.sparkSession, docs
    for k, parts in enumerate(passes):
        table: dict[str, dict[bytes, int]] = {}
        for r in words.where(F.col("part").isin(parts)).select("lang", "word", "id").toLocalIterator() if parts else ():
            table.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        shared, last, again = spark.sparkContext.broadcast(table), k == len(passes) - 1, k > 0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, again=again) -> Iterator[pa.RecordBatch]:
            none: dict[bytes, int] = {}
            for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
                ids = []
                for row, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)):
                    get = shared.value.get(lang, none).get
                    found = np.array([get(w, 0) for w in pieces(text) if w], np.int64)
                    if again and len(found):
                        found = np.maximum(found, np.array(batch.column(2)[row].as_py(), np.int64))
                    if last and len(found):
                        found = found[(found != 0) | (np.append(found[1:], 0) != 0)]  # of a run of zeros one stays
                    ids.append(found)
                flat, ends = np.concatenate(ids) if ids else np.empty(0, np.int64), np.append(0, np.cumsum([len(x) for x in ids]))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([listed] if last else [batch.column(0), batch.column(1), listed], names=["ids"] if last else ["lang", "text", "ids"])

        of = written(of.mapInArrow(run, "ids array<long>" if last else "lang string, text string, ids array<long>"), "ids")
    return of


# Counting


def _windows(ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of m words of a sequence with zeros between pieces, as places of their first words; and the sequence."""
    n = len(ids) - m + 1
    if n <= 0:
        return np.empty(0, np.int64), ids
    ok = ids[:n] != 0
    for k in range(1, m):
        ok &= ids[k : n + k] != 0
    return np.flatnonzero(ok), ids


def packed(parts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """m numbers of `bits` bits each as halves of m * bits bits: two numbers, or one and a half, or one, in each."""
    m = len(parts)
    parts = [p.astype(np.uint64) for p in parts]
    b = np.uint64(bits)
    if m == 2:
        return parts[0], parts[1]
    if m == 4:
        return (parts[0] << b) | parts[1], (parts[2] << b) | parts[3]
    low = np.uint64(bits // 2)
    return (parts[0] << (b - low)) | (parts[1] >> low), ((parts[1] & np.uint64((1 << (bits // 2)) - 1)) << b) | parts[2]


def unpacked(left: np.ndarray, right: np.ndarray, m: int, bits: int) -> list[np.ndarray]:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    if m == 2:
        return [left, right]
    if m == 4:
        return [left >> b, left & mask, right >> b, right & mask]
    low = np.uint64(bits // 2)
    high = b - low
    return [left >> high, ((left & np.uint64((1 << int(high)) - 1)) << low) | (right >> b), right & mask]


def _spot(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """A place in a table of 2^bits bits for each phrase."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out + p.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def phrase_table(found: DataFrame, m: int, n: int) -> tuple[np.ndarray, int]:
    """Which spots the phrases of m words have: a bit for each spot, of a size that is bounded by TABLE_BITS."""
    bits = min(max(TABLE_BITS[0], (16 * n).bit_length()), TABLE_BITS[1])
    names = [f"w{k}" for k in range(1, m + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _spot([c.to_numpy(zero_copy_only=False) for c in batch.columns], bits)
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 15), pa.array(spot & 0x7FFF)], names=["page", "bit"])

    pages = found.select(*names).mapInArrow(run, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros(1 << bits >> 3, np.uint8)
    for r in pages.toLocalIterator():
        page = np.frombuffer(r["bits"], np.uint8)[: 1 << 12]
        table[r["page"] << 12 : (r["page"] << 12) + len(page)] = page
    return table, bits


def _in_table(table: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def phrase_counts(ids: DataFrame, m: int, bits: int, occurrences: int, least: int, shorter: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """w1 to w4 (0 beyond the m-th) and f of the phrases of m words that occur `least` times or more, in a written table."""
    half = m * bits // 2
    shard_bits = min(half, max(LEAST_BITS, (occurrences // SHARD).bit_length()))
    shared = ids.sparkSession.sparkContext.broadcast(shorter)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation, held = Permutation(2 * half), []

        def out() -> pa.RecordBatch:
            left, right, counts = counted(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), half)
            shard = (left >> np.uint64(half - shard_bits)).astype(np.int64)
            starts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
            made = [(int(shard[a]), filter_of(left[a:b], right[a:b], counts[a:b], half, int(shard[a]), shard_bits)) for a, b in zip(starts, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int32()), pa.array([f for _, f in made], pa.binary())], names=["shard", "filter"])

        for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
            column = batch.column(0)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            # Texts one after the other, with a zero after each.
            flat = np.insert(column.flatten().to_numpy(), np.cumsum(lengths), 0)
            for start in range(0, len(flat), HELD):
                part = flat[start : start + HELD + m - 1]
                at, _ = _windows(part, m)
                if shorter is not None and len(at):
                    table, size = shared.value
                    ok = _in_table(table, _spot([part[at + k] for k in range(m - 1)], size))
                    at = at[ok]
                    at = at[_in_table(table, _spot([part[at + k] for k in range(1, m)], size))]
                if len(at):
                    held.append(permutation.forward(*packed([part[at + k] for k in range(m)], bits)))
                if sum(len(x) for x, _ in held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        sorted_ = [entries(x) for x in table["filter"].to_pylist()]
        left, right, counts = counted(*(np.concatenate([x[k] for x in sorted_]) for k in (0, 1)), half, np.concatenate([x[2] for x in sorted_]))
        often = counts >= least
        words = unpacked(*Permutation(2 * half).back(left[often], right[often]), m, bits)
        words = [w.astype(np.int64) for w in words] + [np.zeros(int(often.sum()), np.int64)] * (LONGEST - m)
        return pa.table({**{f"w{k}": w for k, w in enumerate(words, 1)}, "f": counts[often]})

    filters = ids.mapInArrow(fill, "shard int, filter binary")
    return written(filters.groupBy("shard").applyInArrow(merge, "w1 long, w2 long, w3 long, w4 long, f long"), "phrases")


# Phrases


def _within(candidates: DataFrame) -> DataFrame:
    """w1 to w4, longer: how often the most frequent longer candidate occurs that holds the phrase."""
    words = [F.col(f"w{k}") for k in range(1, LONGEST + 1)]
    zero = F.lit(0).cast("long")
    parts = []
    for length in range(2, LONGEST):
        for start in range(LONGEST - length + 1):
            inside = words[start : start + length] + [zero] * (LONGEST - length)
            held = (F.col("m") > length) & (F.col("m") >= start + length)
            parts.append(F.when(held, F.struct(*(w.alias(f"w{k}") for k, w in enumerate(inside, 1)))))
    of = candidates.select("f", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*", "f")
    return of.groupBy(*(f"w{k}" for k in range(1, LONGEST + 1))).agg(F.max("f").alias("longer"))


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of two to four words of each language.

    a is how often a phrase occurs, l and r its two parts at the cut with the lowest score, n the words of the language. Pieces
    end at .,;:!? and line ends. Null texts are empty, and those without a language are of `und`; words of any length count;
    repeated rows each count; languages without phrases have no row. Empty tables give an empty result; other columns are not read.
    """
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    every = written(word_counts(plain), "word_counts")
    totals = written(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = numbered(every.where(F.col("f") >= least))
    occurrences, n_words = int(totals.agg(F.sum("n")).first()[0] or 0), words.count()
    bits = max(8, n_words.bit_length())
    bits += bits % 2
    ids = encoded(plain, words)
    zero = F.lit(0).cast("long")
    found = words.select(F.lit(1).alias("m"), F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), "f")
    shorter = None
    for m in range(2, LONGEST + 1):
        of = phrase_counts(ids, m, bits, occurrences, least, shorter)
        found = found.unionByName(of.withColumn("m", F.lit(m)))
        if m < LONGEST:
            shorter = phrase_table(of, m, of.count())

    key = [f"w{k}" for k in range(1, LONGEST + 1)]
    candidates = found.where("m > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    word = F.array(*key)
    padded = lambda c: [F.coalesce(F.get(c, F.lit(i)), zero) for i in range(LONGEST)]
    sides = [F.slice(word, F.lit(1), F.col("k")), F.slice(word, F.col("k") + 1, F.col("m") - F.col("k"))]
    cuts = cuts.select("m", *key, F.col("f").alias("a"), "k", *(c.alias(f"{s}{i}") for s, side in zip("lr", sides) for i, c in enumerate(padded(side), 1)))
    for s in "lr":
        part = found.select(*(F.col(c).alias(f"{s}{c[1:]}") for c in key), F.col("f").alias(s))
        cuts = cuts.join(part, [f"{s}{c[1:]}" for c in key])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(38, 0)) * a) div CAST(l + r AS DECIMAL(38, 0))")
    scored = cuts.select(*key, "m", "a", score.alias("score"), "k", "l", "r").groupBy(*key).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("m").alias("m"))
    kept = scored.join(_within(candidates), key, "left").where(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(38, 0)) < {INSIDE} * CAST(a AS DECIMAL(38, 0))")
    kept = kept.select(*key, "m", "a", "cut.score", "cut.l", "cut.r").join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    # Those that can be among the first, with all that are level with the last of them; then their words.
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    first = written(kept.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place"), "first")
    for k in range(2, LONGEST + 1):
        first = first.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}")), f"w{k}", "left")
    named = first.join(totals, "lang").withColumn("phrase", F.concat_ws(" ", *(f"t{k}" for k in range(1, LONGEST + 1))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
