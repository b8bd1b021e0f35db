"""Recurring lines by a log-template tree.

Lines are parsed to a fixed depth: by their number of tokens, then by their leading tokens; a token that holds a digit
is a variable field and counts as a wildcard. Lines of a leaf that are equal, wildcards aside, are one template. The
other lines of a leaf are grouped by the tokens that they share: where one token holds in most of a group's lines at
enough positions, these positions are a generalised template, and the others become wildcards; groups without such a
template, or of which most lines don't fit it, are divided further by the tokens at one position. A template recurs if it is found in
documents of several different bodies (so that copies of one document, which are for other operators, count once); it
is dropped from all documents but the first.

Texts are parsed once, to a written table of lines; all else are aggregates and joins of that table, and each text is
joined to the templates that it loses. So the result is the same at any size, and Spark chooses how to join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, written

#: Leading tokens that lead to a leaf, beside the number of tokens.
DEPTH = 3
#: Lines of fewer tokens are never dropped.
MIN_TOKENS = 3
#: Documents of different bodies in which a template recurs.
MIN_DOCS = 5
#: Share of a group's lines that have the same token at a position that stays.
STAYS = 0.6
#: Share of the positions that must stay for a template. Lines with more fields than the rest are templates as they are.
SIMILARITY = 0.5

_DIGITS = b"0123456789"
_WILD = b"<*>"


def _hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def parse(line: bytes) -> tuple[int | None, int, bytes] | None:
    """(leaf, template, the line's tokens between blanks, fields as wildcards); None for too few tokens.

    A line of fields mostly is a template with its digits, and has no leaf.
    """
    flat = b" ".join(line.split())
    size = flat.count(b" ") + 1
    if size < MIN_TOKENS:
        return None
    if len(flat.translate(None, _DIGITS)) != len(flat):
        tokens = [t if len(t.translate(None, _DIGITS)) == len(t) else _WILD for t in flat.split(b" ")]
        if tokens.count(_WILD) > (1 - SIMILARITY) * size:
            return None, _hash(flat), flat
        flat = b" ".join(tokens)
    leading = flat.split(b" ", DEPTH)[:DEPTH]
    return _hash(b"%d %s" % (size, b" ".join(leading))), _hash(flat), flat


def bodies(templates: list[int]) -> list[int]:
    """For each of a document's distinct lines a key of all its other lines: the sum of their templates, 0 if there is none."""
    total = sum(templates)
    return [(total - t + (1 << 63)) % (1 << 64) - (1 << 63) for t in templates]


def _row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart that share an id, or have none."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, leaf, template, body, flat: the distinct lines of each row; flat is null where there is no leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                at, leaf, template, body, flat = [], [], [], [], []
                for row, text in enumerate(as_bytes(batch.column(2))):
                    found = {p[1]: p for line in (text or b"").split(b"\n") if line and (p := parse(line))}
                    if found:
                        at += [row] * len(found)
                        leaf += [p[0] for p in found.values()]
                        template += found
                        body += bodies(list(found))
                        flat += [p[2] if p[0] is not None else None for p in found.values()]
                rows = pa.array(at, pa.int64())
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x, pa.int64()) for x in (leaf, template, body)), pa.array(flat, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "leaf", "template", "body", "flat"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, leaf long, template long, body long, flat string")


def _recurring(lines: DataFrame, key: str) -> DataFrame:
    """key, first: keys found in MIN_DOCS bodies or more, and the smallest id that has them.

    Counted in two steps, so that a very common line is spread by its bodies first.
    """
    each = lines.groupBy(key, "body").agg(F.min("id").alias("first"))
    return each.groupBy(key).agg(F.count("*").alias("bodies"), F.min("first").alias("first")).where(F.col("bodies") >= MIN_DOCS).select(key, "first")


def _tokens() -> Column:
    return F.transform(F.split("flat", " "), lambda t: F.xxhash64(t))


def _verdicts(nodes: DataFrame) -> DataFrame:
    """node, kept (position and token of what stays, null if that is no template), split (the position to divide by, null if there is none).

    The tokens of a node are counted by position and token, then by position, then by node, so no task has a node's lines.
    Positions to divide by are those where no token stays; of them that with the least even lines, and the first of equals.
    """
    each = nodes.select("node", F.posexplode(_tokens()).alias("position", "token"))
    counts = each.groupBy("node", "position", "token").agg(F.count("*").alias("n"))
    position = counts.groupBy("node", "position").agg(F.sum("n").alias("lines"), F.max(F.struct("n", "token")).alias("top"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    share, wild = F.col("top.n") / F.col("lines"), F.col("top.token") == F.xxhash64(F.lit(_WILD.decode()))
    node = position.groupBy("node").agg(
        F.count("*").alias("size"), F.sort_array(F.collect_list(F.when((share >= STAYS) & ~wild, F.struct("position", F.col("top.token").alias("token"))))).alias("kept"),
        F.max(F.when(share < STAYS, F.struct("squares", (-F.col("position")).alias("at")))).alias("open"),
    )
    enough = (F.size("kept") >= SIMILARITY * F.col("size")) & (F.size("kept") > DEPTH)
    return node.select("node", F.when(enough, F.col("kept")).alias("kept"), (-F.col("open.at")).alias("split"))


def generalised(rest: DataFrame) -> DataFrame | None:
    """template, node: the lines that fit a generalised template, which is named by its node; None if there are none.

    rest: template, leaf, flat, bodies (few, for a line that does not recur as it is), a row for each distinct line. In a
    round, of each node whose template fits half of its lines or more, or that has no position to divide by, the lines that
    fit are taken, and in the first case the others are a new node; all other nodes are divided. So a node has at most
    STAYS of the lines of the one before, and rounds are few. A node of fewer than MIN_DOCS bodies ends. What is known of
    nodes is written before lines are joined to it: so a short list is sent to the lines, and a join with a long one can be split.
    """
    found: DataFrame | None = None

    def open_(of: DataFrame) -> DataFrame:
        live = of.select("node", F.explode("bodies").alias("body")).distinct().groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).select("node")
        return written(of.join(written(live, "live"), "node", "left_semi"), "nodes")

    nodes = open_(rest.select("template", "flat", "bodies", F.col("leaf").alias("node")))
    while nodes.head(1):
        judged = nodes.join(written(_verdicts(nodes), "verdicts"), "node").withColumn("tokens", _tokens())
        fits = F.coalesce(F.forall("kept", lambda k: F.get("tokens", k["position"]) == k["token"]), F.lit(False))
        judged = written(judged.withColumn("fits", fits).withColumn("child", F.xxhash64("node", "split", F.get("tokens", F.col("split")))).drop("tokens", "kept"), "judged")
        shares = judged.groupBy("node").agg((2 * F.count_if("fits") >= F.count("*")).alias("mostly"))
        judged = judged.join(written(shares, "shares"), "node").withColumn("taken", F.col("fits") & (F.col("mostly") | F.col("split").isNull()))
        now = judged.where("taken").select("template", "node")
        found = now if found is None else found.unionByName(now)
        child = F.when(F.col("mostly"), F.xxhash64("node", F.lit("others"))).otherwise(F.col("child"))
        nodes = open_(judged.where("not taken and (mostly or split is not null)").select("template", "flat", "bodies", child.alias("node")))
    return found


def losses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, gone: for each row that loses lines, told by its id and _row_key, the templates that it loses."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    same = written(_recurring(lines, "template"), "templates")
    elsewhere = F.col("id").isNull() | (F.col("first") != F.col("id"))
    gone = lines.select("id", "key", "template").join(same, "template").where(elsewhere).select("id", "key", "template")
    # Of lines that don't recur as they are, those of leaves that several bodies have; each distinct line is one row, with its bodies.
    rest = lines.where("leaf is not null").join(same.select("template"), "template", "left_anti")
    leaves = written(_recurring(rest.select("leaf", "body", "id"), "leaf").select("leaf"), "leaves")  # its size is known, and texts need not move to a short list
    some = rest.join(leaves, "leaf", "left_semi")
    found = generalised(written(some.groupBy("template").agg(F.first("leaf").alias("leaf"), F.first("flat").alias("flat"), F.collect_set("body").alias("bodies")), "rest"))
    if found is not None:
        own = written(lines.select("id", "key", "template", "body").join(found, "template"), "fitting")
        gone = gone.unionByName(own.join(_recurring(own, "node"), "node").where(elsewhere).select("id", "key", "template"))
    return gone.groupBy("id", "key").agg(F.collect_set("template").alias("gone"))


def strip(text: bytes, gone: set[int]) -> tuple[bytes, int]:
    """(the text without the lines of these templates, their number)."""
    lines = text.split(b"\n")
    kept = [line for line in lines if not (line and (p := parse(line)) and p[1] in gone)]
    return (b"\n".join(kept), len(lines) - len(kept)) if len(kept) < len(lines) else (text, 0)


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with recurring lines dropped from the text; all rows and columns stay. With counts, n_lines and n_dropped too.

    A line's template is dropped from every row but those with the smallest id that has it. A row with a null id is
    never the first, and loses all templates that recur. Null texts stay null with 0 lines, empty ones empty with 1; lines
    of under 3 tokens stay; texts and lines may be of any length. Repeated rows are one body, and lose the same. An empty table gives an
    empty result. A column of docs named n_lines or n_dropped clashes with counts only, and is left out then; other
    columns may have any name.
    """
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    own = ["_id", "_key", "_gone"]
    while set(own) & set(docs.columns):
        own = [f"_{c}" for c in own]
    i, k, g = own
    lost = losses(docs, id_col, text_col).toDF(i, k, g)
    joined = docs.join(lost, (_row_key(id_col, text_col) == F.col(k)) & F.col(id_col).eqNullSafe(F.col(i)), "left").select(*(docs[c] for c in docs.columns), g)
    t = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, dropped = [], [], []
            for text, gone in zip(as_bytes(batch.column(t)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                left, lost = strip(text, set(gone)) if gone else (text, 0)
                texts.append(left), n.append(0 if text is None else text.count(b"\n") + 1), dropped.append(lost)
            columns = [*batch.columns[:-1]]
            columns[t] = pa.array(texts, pa.binary()).cast(pa.string())
            if counts:
                columns += [pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *(["n_lines", "n_dropped"] if counts else [])])

    more = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
