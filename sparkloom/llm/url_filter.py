"""URL filters: rules for hosts and paths, then naive Bayes over words of segmented hosts and path tokens.

Host names are cut into words by a unigram model (the most probable cut, found by Viterbi), with word counts from the
pages themselves. A multinomial naive Bayes scores the words; it begins with labelled names, which are a parameter, and
is then fitted on all hosts as it judges them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: (host, path, verdict); a rule fits its host and all subdomains, where the url's path starts with its own.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Labelled names that the classifier begins with, if no others are given.
BLOCKED_NAMES = (
    "casino-bonus", "online-casino", "poker-win", "free-spins", "slots-jackpot", "sports-bets", "betting-odds", "lottery-win",
    "herbal-pills", "buy-pills", "online-pharmacy", "viagra-shop", "diet-pills", "payday-loans", "fast-loans", "replica-watches",
    "adult-video", "adult-chat", "xxx-video", "porn-tube", "sex-cams", "escort-girls", "hot-dating", "spam-mail", "spam-links",
    "link-farm", "click-ads", "ads-server", "ads-banner", "track-clicks", "web-tracker", "malware-site", "free-warez", "crack-keys",
    "quick-bets", "win-prizes",
)
ALLOWED_NAMES = (
    "daily-news", "city-library", "music-school", "garden-club", "history-museum", "travel-guide", "weather-report", "science-journal",
    "open-source", "code-review", "recipe-book", "health-service", "public-radio", "town-council", "art-gallery", "book-store",
    "photo-album", "football-club", "language-course", "math-forum", "bird-watch", "law-office", "train-times", "film-review",
    "animal-shelter", "coffee-house", "stone-bridge", "river-valley", "north-coast", "green-energy", "local-history", "high-street",
    "free-software", "online-course", "video-lecture", "mail-list",
)

#: Words of a host are at most so long; longer runs of letters are cut letter by letter or into known words.
LONGEST = 24
#: Share of blocked hosts before anything is known, and what is added to each count.
PRIOR, SMOOTHING = 0.2, 0.5
_DIGITS = "<num>"


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to / ? # or the end, A-Z in lower case; then up to ? # or the end."""
    host, path = (F.coalesce(F.regexp_extract(url, _URL, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def vocabulary(pages: DataFrame, html_col: str = "html", names: tuple[tuple[str, ...], tuple[str, ...]] = (BLOCKED_NAMES, ALLOWED_NAMES)) -> DataFrame:
    """word, n: letter runs of all pages' visible text, and of the names that the classifier begins with."""
    text = F.regexp_replace(F.col(html_col).cast("string"), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,%d}" % LONGEST), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    spark = pages.sparkSession
    own = spark.createDataFrame([(w,) for name in (*names[0], *names[1]) for w in name.split("-")], "word string").groupBy("word").agg(F.count("*").alias("n"))
    return counted.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def cut(run: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most probable cut of a run of letters; known: counts of words by (start, end).

    An unknown word of k letters counts as 10^(1 - k); of equal cuts, that with the longer last words is taken.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = known.get((start, end), 0.0) or 10.0 ** (1 - (end - start))
            options.append((best[start][0] - math.log(n / total), start))
        best.append(min(options))
    out, end = [], len(run)
    while end:
        start = best[end][1]
        out.append(run[start:end])
        end = start
    return out[::-1]


def segment(runs: DataFrame, words: DataFrame) -> DataFrame:
    """runs(run) -> (run, words). words: (word, n). Each run meets the words that are parts of it, and no others."""
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1)
    size = F.length("run")
    part = runs.select("run", F.explode(F.sequence(F.lit(0), size - 1)).alias("start")).select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("start")))).alias("size"))
    named = part.select("run", "start", "size", F.expr("substring(run, start + 1, size)").alias("word")).join(words, "word")
    found = named.groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("found"))

    @F.pandas_udf("array<string>")
    def viterbi(run: pd.Series, found: pd.Series) -> pd.Series:
        known = ([] if f is None else f for f in found)
        return pd.Series([cut(r, {(x["start"], x["start"] + x["size"]): float(x["n"]) for x in f}, total) for r, f in zip(run, known)])

    return runs.join(found, "run", "left").select("run", viterbi("run", "found").alias("words"))


def _weights(blocked: Column, allowed: Column, counts: DataFrame) -> DataFrame:
    """word, weight: the log odds of a blocked page for each word, from its counts."""
    totals = counts.agg(F.sum(blocked).alias("tb"), F.sum(allowed).alias("ta"), F.count("*").alias("v")).first()
    tb, ta, v = (float(totals[k] or 0) for k in ("tb", "ta", "v"))
    odds = F.log((blocked + SMOOTHING) / F.lit(tb + SMOOTHING * v)) - F.log((allowed + SMOOTHING) / F.lit(ta + SMOOTHING * v)) if v else F.lit(0.0)
    return counts.select("word", odds.alias("weight"))


def _first_weights(spark: SparkSession, names: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    rows = [(w, 1 - k, k) for k in (0, 1) for n in names[k] for w in n.split("-")]
    counts = spark.createDataFrame(rows, "word string, b long, a long").groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return _weights(F.col("b"), F.col("a"), counts)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, names: tuple[tuple[str, ...], tuple[str, ...]] = (BLOCKED_NAMES, ALLOWED_NAMES)) -> DataFrame:
    """For each row: id_col, host, path, rule, verdict, words (of the host), score.

    rule: the longest that fits (null if none); verdict: the rule's, or block where the score (the log odds of a blocked
    page) is above 0, else allow. names: blocked and allowed names, of words with hyphens between them, that the classifier
    begins with; both hold a word at least. A null url, or one without ://, has an empty host and path, no words, and is allowed
    unless a rule fits. Null ids and repeated rows are like any other row; a host may be of any length; words of over 24
    letters are cut. Without html the host's words are those of the built-in names. An empty table gives an empty result.
    Columns other than the three named are not read.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    parsed = written(pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")), "urls")
    words = written(vocabulary(pages, html_col, names), "words")
    urls = written(parsed.groupBy("host", "path").agg(F.count("*").alias("n")), "hosts")
    letters = lambda c: F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))
    hosts = urls.groupBy("host").agg(F.sum("n").alias("n")).withColumn("runs", letters("host"))
    each = hosts.select("host", "n", F.posexplode("runs").alias("at", "run"))
    cuts = written(segment(each.select("run").distinct(), words), "cuts")
    spelled = written(each.join(cuts, "run").select("host", "n", "at", "words"), "spelled")
    prior = math.log(PRIOR / (1 - PRIOR))

    def totals(of: DataFrame, weights: DataFrame, *key: str) -> DataFrame:
        return of.join(weights, "word").groupBy(*key).agg(F.sum("weight").alias("total"))

    host_words = spelled.select("host", "n", F.explode("words").alias("word"))
    first = totals(host_words, _first_weights(pages.sparkSession, names), "host").select("host", (F.col("total") + prior > 0).alias("bad"))
    marked = written(hosts.select("host").join(first, "host", "left").select("host", F.coalesce("bad", F.lit(False)).alias("bad")), "marked")
    tokens = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.when(t.rlike(r"^\p{N}+$"), F.lit(_DIGITS)).otherwise(t))
    path_words = urls.select("host", "path", "n", F.explode(tokens).alias("word"))
    # A path's words are told from a host's by a mark before them.
    seen = host_words.select("host", "n", "word").unionByName(path_words.select("host", "n", F.concat(F.lit("/"), "word").alias("word")))
    counts = seen.join(marked, "host").groupBy("word").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a"))
    weights = written(_weights(F.col("b"), F.col("a"), written(counts, "counts")), "weights")
    share = hosts.join(marked, "host").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum("n")).first()
    p = ((share[0] or 0) + SMOOTHING) / ((share[1] or 0) + 2 * SMOOTHING)
    by_host = totals(host_words, weights, "host").withColumnRenamed("total", "host_total")
    by_path = totals(path_words.select("host", "path", F.concat(F.lit("/"), "word").alias("word")), weights, "host", "path").withColumnRenamed("total", "path_total")
    text = spelled.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    scored = urls.join(by_path, ["host", "path"], "left").join(by_host, "host", "left").join(text, "host", "left").select(
        "host", "path", F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        F.when(F.col("host_total").isNull(), F.lit(float("-inf"))).otherwise(F.lit(math.log(p / (1 - p))) + F.col("host_total") + F.coalesce("path_total", F.lit(0.0))).alias("score"),
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    # Rows without a url share a key; they have no words, and are not joined.
    named = parsed.where(F.col("host") != "").join(scored, ["host", "path"])
    nameless = parsed.where(F.col("host") == "").withColumns({"words": F.array().cast("array<string>"), "score": F.lit(float("-inf"))}).select("host", "path", "_id", "words", "score")
    return named.select(*nameless.columns).unionByName(nameless).select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score"
    )
