"""Mixing sources to target weights, by systematic sampling.

A source's target over its size is the number of copies that is expected of each of its documents. Inside a source, the
expected copies are added up document after document, one random offset is added, and a document is taken once for each
whole number that the sum passes at it. All of this is integer arithmetic: the sums are fractions of one denominator.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import running_sum
from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in the order of their names, again from the first after the last.
WEIGHTS = (3, 1, 2)
#: What is shared out, as a part of all sizes, and what a source gets at most, as a multiple of its own.
SHARE, MOST = Fraction(3, 2), 2
SEED = 11
#: Rows that one row is repeated to at a time.
_CHUNK = 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _wide(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def source_targets(sized: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """source_col, source_size, source_rows, num, den, target = num / den: what each source gives, in words.

    sized: (source_col, size, n_rows), n_rows rows of that size. Sources take weights in the order of their names by code point, a null one last. A source's
    target is its weight's share of what is to be given, and MOST times its size at most; what is beyond is shared again by
    weight among the others, until none is above. Sources are rows: a round is one aggregate, and only its sums go to the driver.
    """
    sources = written(sized.groupBy(source_col).agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.sum("n_rows").alias("source_rows")), "sources")
    place = running_sum(sources.select(source_col, F.col(source_col).isNull().alias("last"), F.lit(1).alias("one")), "one", ["last", source_col], out="place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    place = place.select(F.col(source_col).alias("name"), weight.cast("long").alias("weight"))
    of = written(sources.join(place, sources[source_col].eqNullSafe(place["name"])).drop("name"), "weighted")
    total, every = of.agg(F.sum(_wide("source_size")), F.sum(_wide("weight"))).first()
    num, den = share.numerator * int(total or 0), share.denominator * int(every or 1)
    while True:
        above = _wide("weight") * _wide(F.lit(str(num))) > _wide("source_size") * _wide(F.lit(str(most * den)))
        capped, left = of.agg(F.sum(F.when(above, _wide("source_size"))), F.sum(F.when(~above, _wide("weight")))).first()
        new = (share.numerator * int(total or 0) - share.denominator * most * int(capped or 0), share.denominator * int(left or 1))
        if new[0] * den == num * new[1] or left is None:
            break
        num, den = new
    top, bottom = F.when(above, _wide("source_size") * most).otherwise(_wide("weight") * _wide(F.lit(str(num)))), F.when(above, _wide(F.lit("1"))).otherwise(_wide(F.lit(str(den))))
    return of.select(source_col, "source_size", "source_rows", top.alias("num"), bottom.alias("den"), (top.cast("double") / bottom.cast("double")).alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """A random number of 60 bits for each source: digits of the MD5 of the seed and its name."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return _wide(F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """A row for each document: id, source, size, mark (a hash of the text), n_rows (rows that are the same), rank (of the first of them), source_size,
    source_rows, target, offset, step, base.

    Ranks go by size, then id. In the order of the sum, a source's even ranks come first, then its odd ones from the last to the first: sizes rise
    and fall, so what is taken is nearer the target than with sizes that only rise. The document at a place (from 0) is taken once for each whole
    number in (offset + place * step, offset + (place + 1) * step], all over base.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = sized.select("id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    groups = written(sized.groupBy("id", "source", "size", "mark").agg(F.count("*").alias("n_rows")), "sized")
    targets = source_targets(groups.select("source", "size", "n_rows")).withColumnRenamed("source", "name")
    ranked = running_sum(groups.withColumn("none", F.col("source").isNull()), "n_rows", ["size", "id", "mark"], ["none", "source"], out="rank").drop("none")
    of = ranked.join(targets, ranked["source"].eqNullSafe(targets["name"])).drop("name").withColumnRenamed("num", "step")
    # A document's expected copies are num / (den * source_size); those of a source without words are 0 / 1.
    of = of.withColumn("base", F.greatest(_wide(F.lit("1")), F.col("den") * _wide("source_size"))).withColumn("step", F.when(F.col("source_size") > 0, F.col("step")).otherwise(_wide(F.lit("0"))))
    return of.withColumn("offset", _offset(F.col("source"), seed) % F.col("base")).drop("den")


def _between(start: str, end: str) -> str:
    """How often the documents from one place to before another are taken."""
    return f"(offset + cast({end} AS decimal(38, 0)) * step) div base - (offset + cast({start} AS decimal(38, 0)) * step) div base"


def _copies_of_row(rank: str) -> Column:
    place = f"if({rank} % 2 = 0, {rank} div 2, source_rows - 1 - {rank} div 2)"
    return F.expr(_between(place, f"{place} + 1"))


def _copies_of_group() -> Column:
    """Of all n_rows rows: those of even rank are neighbours, and those of odd rank are."""
    even, odd = ("(rank + 1) div 2", "(rank + n_rows + 1) div 2"), ("rank div 2", "(rank + n_rows) div 2")
    return F.expr(f"{_between(*even)} + {_between(f'source_rows - {odd[1]}', f'source_rows - {odd[0]}')}")


def _repeated(df: DataFrame, times: str, index: str) -> DataFrame:
    """Each row of df as often as its column `times` says, numbered from 0; made in runs, so that no row holds a long array."""
    zero = F.lit(0).cast("long")
    runs = df.where(F.col(times) > 0).withColumn(index, F.explode(F.sequence(zero, F.expr(f"({times} - 1) div {_CHUNK}"))))
    run, place = F.col(index) * _CHUNK, f"{index}_place"
    of = runs.withColumn(place, F.explode(F.sequence(zero, F.least(F.lit(_CHUNK).cast("long"), F.col(times) - run) - 1)))
    return of.withColumn(index, run + F.col(place)).drop(place)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """For each row: id_col, size, source_size, target (its source's), taken: the words that the mix takes of it, repeats counted.

    Null texts have size 0, and so no words to take; a null id is an id, a null source a source, an empty one another. Repeated
    rows have ranks of their own. Empty tables give an empty result; other columns are not read.
    """
    rows = _repeated(plan(docs, id_col, text_col, source_col, seed), "n_rows", "_row").withColumn("_rank", F.col("rank") + F.col("_row"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies_of_row("_rank")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with all columns and its copy's number as copy.

    Rows of the same id, source and text count as one document of as many expected copies; which of them is returned doesn't
    matter. A column of docs named copy is lost.
    """
    whole = plan(docs, id_col, text_col, source_col, seed).withColumn("_copies", _copies_of_group()).where("_copies > 0")
    whole = whole.select(*(F.col(c).alias(f"_plan_{c}") for c in ("id", "source", "mark")), F.col("n_rows").alias("_n_rows"), "_copies")
    same = docs[id_col].eqNullSafe(whole["_plan_id"]) & docs[source_col].cast("string").eqNullSafe(whole["_plan_source"]) & (F.xxhash64(docs[text_col].cast("string")) == whole["_plan_mark"])
    found = docs.join(whole, same)
    once = found.where("_n_rows = 1").unionByName(found.where("_n_rows > 1").dropDuplicates(["_plan_id", "_plan_source", "_plan_mark"]))
    return _repeated(once, "_copies", "copy").select(*(f"`{c}`" for c in docs.columns if c != "copy"), "copy")
