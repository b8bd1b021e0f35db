"""Quality rules as a short-circuit cascade.

Each rule rejects a text. A run over a sample measures what a rule costs and how many texts it rejects; the rules
then run in the order of rejections per second, and the first that rejects ends the work on a text. The order
changes the time only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_stats as S
from .shared import as_bytes

#: Rows of the sample on which the cascade is ordered.
SAMPLE_ROWS = 256


class Text:
    """A text and the figures that rules ask for, each computed when it is first asked for."""

    __slots__ = ("raw", "_words", "_lines", "_known")

    def __init__(self, raw: bytes | None):
        self.raw, self._words, self._lines, self._known = raw or b"", None, None, {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    @property
    def lines(self) -> list[bytes]:
        if self._lines is None:
            self._lines = S.lines_with_words(self.raw)
        return self._lines

    def figure(self, name: str) -> int:
        if name not in self._known:
            self._known[name] = FIGURES[name](self)
        return self._known[name]


FIGURES: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: S.word_chars(t.raw),
    "n_symbols": lambda t: S.count(t.raw, S.SYMBOLS),
    "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
    "n_repeat_words": lambda t: S.repeated_words(t.words),
    "n_lines": lambda t: len(t.lines),
    "n_upper": lambda t: S.count(t.raw, S._UPPER),
    "n_lower": lambda t: S.count(t.raw, S._LOWER),
}

#: The contract's own figures, in the order of its columns.
BASE_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules of the base verdict.
BASE: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.figure("n_words") < 20,
    "repeated_words": lambda t: 100 * t.figure("n_repeat_words") > 30 * t.figure("n_words"),
}

#: Further rules; a text must pass them too. Whole-number comparisons, so that any engine agrees.
FURTHER: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 100 * t.figure("n_symbols") > 10 * t.figure("word_chars"),
    "shouting": lambda t: 100 * t.figure("n_upper") > 50 * (t.figure("n_upper") + t.figure("n_lower")),
    "duplicate_lines": lambda t: 100 * t.figure("n_dup_lines") > 50 * t.figure("n_lines"),
    "word_length": lambda t: not 2 * t.figure("n_words") <= t.figure("word_chars") <= 25 * t.figure("n_words"),
}

RULES = BASE | FURTHER


def measure(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rule, seconds, rejected, seen: what each rule costs and rejects, on about `sample_rows` rows from all over docs.

    A rule is timed on a fresh text, so that the figures that it shares with others count for it as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                seen += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    rejected[name] += rule(Text(raw))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "seconds": list(spent.values()), "rejected": list(rejected.values()), "seen": [seen] * len(RULES)})

    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(share, 7)
    each = sample.mapInArrow(run, "rule string, seconds double, rejected long, seen long")
    return each.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen"))


def order(costs: list[tuple[str, float, int, int]]) -> list[str]:
    """Rules by rejections per second, the most first; ties, and rules that rejected nothing, by cost, then name."""
    return [name for name, *_ in sorted(costs, key=lambda c: (-c[2] / max(c[1], 1e-9), c[1], c[0]))]


def cascade(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    rows = measure(docs, text_col, sample_rows).collect()  # a row for each rule
    known = [(r["rule"], r["seconds"], r["rejected"], r["seen"]) for r in rows]
    return order(known) + [x for x in RULES if x not in {k[0] for k in known}]


def _rejecting(text: Text, rules: list[str]) -> str | None:
    return next((name for name in rules if RULES[name](text)), None)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[str] | None = None, reasons: bool = False) -> DataFrame:
    """For each row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; with reasons, rejected_by.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: false if base_failed, else
    whether no rule of the cascade rejects. rejected_by: the first rule, in the order of RULES, that rejects (null if kept).
    Nulls and empty texts have no words and fail; a null id, repeated rows and long texts are like any other row.
    An empty table gives an empty result; columns other than the two named are not read.
    """
    rules = list(rules or cascade(docs, text_col))
    further = [r for r in rules if r in FURTHER]
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*BASE_FIGURES, "base_failed", "kept", *["rejected_by"] * reasons)}
            for raw in as_bytes(batch.column(1)):
                text = Text(raw)
                for name in BASE_FIGURES:
                    out[name].append(text.figure(name))
                failed = _rejecting(text, list(BASE))
                by = failed or _rejecting(text, further)
                out["base_failed"].append(failed is not None)
                out["kept"].append(by is None)
                if reasons:
                    out["rejected_by"].append(by and _rejecting(text, list(RULES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if k == "rejected_by" else pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in out.items())], names=[id_col, *out])

    schema = f"`{id_col}` {id_type}, {', '.join(f'{k} long' for k in BASE_FIGURES)}, base_failed boolean, kept boolean" + ", rejected_by string" * reasons
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; the cascade stops at the first rejection.

    Null and empty texts go; null ids, repeated rows and long texts are like any other row; an empty table stays empty.
    """
    rules = list(rules or cascade(docs, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_rejecting(Text(raw), rules) is None for raw in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
