"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A benchmark item's seeds are its 3-grams that are rare in the corpus, and of every two neighbouring ones the rarer, so
that an item of common 3-grams, or one that very many texts copy, has seeds too; the others are seeds where two of an item's
are near each other. A text that has a seed is aligned with the item around it, word by word, and is contaminated if the
local alignment's score reaches a share of the item's own. Items of one or two words are looked for as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import BROADCAST_LIMIT, WordHashes, as_bytes, gram_hashes, word_hashes

WIDTH = 3
#: A 3-gram is rare if it is in such a share of the corpus's rows, or so many rows, at most.
RARE, RARE_ROWS = 0.01, 100
#: Of so many neighbouring 3-grams of an item the rarest is a seed, rare or not.
NEIGHBOURS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of an item aligned with itself.
MIN_SCORE = 0.5
#: Bytes of benchmark texts that are matched in one pass over the corpus; more are taken in blocks.
BLOCK_BYTES = BROADCAST_LIMIT // 8

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits, _ and other characters beyond ASCII; A-Z in lower case."""
    return text.translate(_PLAIN).split() if text else []


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, where it ends in the passage), of two arrays of word hashes; gaps cost the same each."""
    n = len(passage)
    steps = -GAP * np.arange(n + 1, dtype=np.int64)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item's row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Grams:
    """Which of a set of hashes are in an array: a table of their low bits first, which few others pass."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = hashes
        self.mask = np.uint64((1 << max(16, min(24, (64 * max(1, len(hashes))).bit_length()))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[hashes & self.mask] = True

    def find(self, grams: np.ndarray) -> tuple[list[int], list[int]]:
        """Positions of the grams that are in the set, and their places in it."""
        at = np.flatnonzero(self.table[grams & self.mask])
        if not len(at):
            return [], []
        k = np.searchsorted(self.sorted, grams[at])
        k[k == len(self.sorted)] = 0
        same = self.sorted[k] == grams[at]
        return at[same].tolist(), k[same].tolist()


def spans(starts: list[tuple[int, bool]], size: int) -> list[tuple[int, int]]:
    """Windows around the places where an item of `size` words would begin, those that overlap as one: (place, whether its seed counts alone).

    An alignment that reaches the least score has as many gaps as the item has words at most, so it lies within as many
    words around the place that one of its seeds points to. A window of one seed that doesn't count alone is none.
    """
    out: list[list[int]] = []
    for start, alone in sorted(starts):
        lo, hi = max(0, start - size), start + 2 * size
        if out and lo <= out[-1][1]:
            out[-1][1:] = [hi, out[-1][2] + 1 + alone]
        else:
            out.append([lo, hi, 1 + alone])
    return [(lo, hi) for lo, hi, n in out if n > 1]


class Seeds:
    """Items, and which of their seeds is where."""

    def __init__(self, items: list[tuple[object, np.ndarray]], frequency: dict[int, int], rows: int):
        self.items = items
        at: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        self.short: dict[int, list[object]] = defaultdict(list)  # items of one or two words, by their hash
        for k, (name, hashed) in enumerate(items):
            if len(hashed) < WIDTH:
                self.short[int(gram_hashes(hashed, WIDTH)[0])].append(name)
                continue
            grams = gram_hashes(hashed, WIDTH).tolist()
            chosen = {p for p, g in enumerate(grams) if frequency.get(g, 0) <= max(RARE * rows, RARE_ROWS)}
            for start in range(max(1, len(grams) - NEIGHBOURS + 1)):
                chosen.add(min(range(start, min(start + NEIGHBOURS, len(grams))), key=lambda p: (frequency.get(grams[p], 0), grams[p], p)))
            for p, g in enumerate(grams):
                at[g].append((k, p, p in chosen))
        self.at = dict(at)
        self.grams = Grams(np.array(sorted(self.at), np.uint64))
        self.whole = Grams(np.array(sorted(self.short), np.uint64))

    def find(self, hashed: np.ndarray) -> list[tuple[object, float, int, int]]:
        """(item, score, first word, word after the last) of the items that a text contains, of short ones where each is first."""
        out = []
        for width in range(1, WIDTH) if self.short else ():
            first: dict[object, int] = {}
            for position, gram in zip(*self.whole.find(gram_hashes(hashed, width))) if len(hashed) >= width else ():
                for name in self.short[int(self.whole.sorted[gram])]:
                    first.setdefault(name, position)
            out += [(name, 1.0, position, position + width) for name, position in first.items()]
        if len(hashed) < WIDTH:
            return out
        windows: dict[int, list[tuple[int, bool]]] = defaultdict(list)
        for position, gram in zip(*self.grams.find(gram_hashes(hashed, WIDTH))):
            for item, offset, alone in self.at[int(self.grams.sorted[gram])]:
                windows[item].append((position - offset, alone))
        for item, starts in windows.items():
            name, own = self.items[item]
            best = (0, 0)
            for lo, hi in spans(starts, len(own)):
                if np.isin(own, hashed[lo:hi]).sum() < MIN_SCORE * len(own):
                    continue  # a match is worth MATCH at most, so the score can't be reached
                score, end = smith_waterman(own, hashed[lo:hi])
                best = max(best, (score, lo + end))
            if best[0] >= MIN_SCORE * MATCH * len(own):
                lo = max(0, best[1] - 2 * len(own))  # an alignment has as many words at most, and as many gaps
                _, back = smith_waterman(own[::-1], hashed[lo : best[1]][::-1])  # the same alignment, from its end
                out.append((name, best[0] / (MATCH * len(own)), best[1] - back, best[1]))
        return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The items of one word or more, in blocks of a bounded size."""
    sized = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    cache = WordHashes()
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(blocks)) == k) if blocks > 1 else sized
        items = [(r["id"], word_hashes(words(r["text"].encode()), cache)) for r in rows.collect()]
        yield sorted((x for x in items if len(x[1])), key=lambda x: str(x[0]))


def _frequencies(docs: DataFrame, text_col: str, items: list[tuple[object, np.ndarray]]) -> tuple[dict[int, int], int]:
    """In how many rows of the whole corpus each 3-gram of the items is, and the number of rows."""
    wanted = np.unique(np.concatenate([gram_hashes(h, WIDTH) for _, h in items if len(h) >= WIDTH] or [np.empty(0, np.uint64)]))
    if not len(wanted):
        return {}, 0
    shared = docs.sparkSession.sparkContext.broadcast(Grams(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHashes(), Counter()
        for batch in batches:
            counts[-1] += batch.num_rows
            for text in as_bytes(batch.column(0)):
                _, found = shared.value.find(gram_hashes(word_hashes(words(text), cache), WIDTH))
                counts.update(set(found))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram long, n long")
    found = {r["gram"]: r["n"] for r in each.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each wanted 3-gram
    rows = found.pop(-1, 0)
    return {int(wanted[g]): n for g, n in found.items()}, rows


def _seeds(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator[Seeds]:
    for items in _items(benchmark, item_col, item_text_col):
        yield Seeds(items, *_frequencies(docs, text_col, items))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, item_col, score, start_word, end_word: the items that each row's text contains, whole or edited.

    score: the best local alignment's, 1 for an item that is contained as it is; start_word and end_word count words
    without punctuation. Rows without text contain nothing; items that are null, have a null id or no word are in no text,
    and those of one or two words in the texts that have them as they are. A null row id is returned as it is; repeated rows are each returned; of equal items each is returned.
    Empty tables give an empty result. Columns other than the four named are not read.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, start_word long, end_word long"
    item_type, out = to_arrow_type(benchmark.schema[item_col].dataType), None
    for seeds in _seeds(docs, benchmark, text_col, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                at, found = [], []
                for row, text in enumerate(as_bytes(batch.column(1))):
                    hits = shared.value.find(word_hashes(words(text), cache))
                    at += [row] * len(hits)
                    found += hits
                item, score, start, end = zip(*found) if found else ((),) * 4
                kinds = (item_type, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, k) for x, k in zip((item, score, start, end), kinds))], names=[id_col, item_col, "score", "start_word", "end_word"])

        part = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns.

    Rows without text stay, as do rows with a null id or extra columns; of repeated rows all stay or all go. Items that are null,
    have a null id or no word are in no text, and those of one or two words in the texts that have them as they are. Empty tables give docs as it is.
    """
    t = docs.columns.index(text_col)
    source = docs
    for seeds in _seeds(source, benchmark, text_col, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                clean = [not shared.value.find(word_hashes(words(text), cache)) for text in as_bytes(batch.column(t))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
