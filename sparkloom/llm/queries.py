"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, divergence, line_dedup, mixing, near_dedup, quality_model, quality_rules, sentencepiece_bpe, sharding, toxicity, url_filter, warc

#: The shards that the query places documents in.
SHARDS = [f"shard-{k:02d}" for k in range(64)]
#: The vocabulary's file.
VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring(table(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op7_url_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality_rule_ensemble, op2_warc_zstd, op3_decontamination, op4_odd_sketch_dedup, op5_toxicity_factorization, op6_line_templates,
    op7_url_segmentation, op8_sentencepiece, op9_sharding, op10_quality_cascade, op11_systematic_mixing, op12_source_divergence, op13_collocations, pipeline,
)}


SQL_OP2 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
last AS (SELECT x, max(page_id) AS m FROM d GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(d.x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM d JOIN last USING (x)
"""

SQL_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::UBIGINT[] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i+4], ' ')))) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
rare AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
r AS MATERIALIZED (SELECT g.* FROM g JOIN rare USING (s)),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

SQL_OP10 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS g FROM w WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS low
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 10 * word_chars) AND NOT (100 * up > 50 * (up + low))
  AND NOT (100 * n_dup_lines > 50 * n_lines) AND word_chars BETWEEN 2 * n_words AND 25 * n_words AS kept
FROM b
"""


SQL_OP11 = r"""
WITH w AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS z, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT *, ([3, 1, 2])[(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::HUGEINT AS wt FROM s),
t AS (SELECT *, row_number() OVER o AS k, 3 * sum(z) OVER () - 4 * coalesce(sum(z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  2 * sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM r WINDOW o AS (ORDER BY z * 6 // wt, source NULLS LAST)),
l AS (SELECT num, den FROM t WHERE num * wt <= 2 * z * den ORDER BY k LIMIT 1),
f AS (SELECT source, z, n, wt, CASE WHEN l.num * wt > 2 * z * l.den THEN 2 * z ELSE l.num * wt END AS num, CASE WHEN l.num * wt > 2 * z * l.den THEN 1::HUGEINT ELSE l.den END AS den FROM r, l),
g AS (SELECT source, z, n, num::DOUBLE / den::DOUBLE AS target, CASE WHEN z > 0 THEN num ELSE 0 END AS step, greatest(1::HUGEINT, den * z) AS base,
  ('0x' || substr(md5('11|' || coalesce('=' || source, '')), 1, 15))::BIGINT::HUGEINT AS u FROM f),
d AS (SELECT w.doc_id, w.size, g.*, row_number() OVER (PARTITION BY w.source ORDER BY w.size, w.doc_id) - 1 AS k FROM w JOIN g ON w.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, CASE WHEN k % 2 = 0 THEN k // 2 ELSE n - 1 - k // 2 END::HUGEINT AS place, u % base AS o FROM d)
SELECT doc_id, size, z::BIGINT AS source_size, target, (size * ((o + (place + 1) * step) // base - (o + place * step) // base))::BIGINT AS taken FROM p
"""

SQL_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
c AS MATERIALIZED (SELECT i, lang, source, t, count(*) AS c FROM (SELECT i, lang, source, unnest(ws) AS t FROM d) GROUP BY ALL),
v AS MATERIALIZED (SELECT lang, t FROM c GROUP BY lang, t HAVING count(*) >= 30),
s AS MATERIALIZED (SELECT lang, source, t, sum(c) AS c FROM c JOIN v USING (lang, t) GROUP BY ALL),
g AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM s GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM v GROUP BY ALL) USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, v.t, coalesce(s.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(s.c, 0) + 5)) // (coalesce(g.n, 0) + 5 * g.v) AS p FROM g JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.t = v.t),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, t, sum(c) AS c FROM s GROUP BY ALL)),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS o, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.o = b.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM e
QUALIFY part = 'pair' OR rank <= 50
"""

SQL_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
x AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM x GROUP BY 1),
f AS MATERIALIZED (
  SELECT lang, m, g, count(*)::HUGEINT AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS g FROM x, (SELECT unnest([1, 2, 3, 4]) AS m))
  GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, m, g, f AS a, string_split(g, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score FROM k JOIN f l ON l.lang = k.lang AND l.m = k.k AND l.g = array_to_string(ws[1:k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.m = k.m - k.k AND r.g = array_to_string(ws[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, m, g ORDER BY score, k) = 1),
h AS (SELECT lang, m, g, max(a) AS a FROM (
  SELECT lang, w AS m, unnest(list_transform(range(1, m - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))) AS g, a FROM (SELECT *, unnest(range(2, m)) AS w FROM c)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.g)::BIGINT AS rank, b.g AS phrase, b.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM b JOIN n USING (lang) LEFT JOIN h ON h.lang = b.lang AND h.m = b.m AND h.g = b.g WHERE h.a IS NULL OR 100 * h.a < 80 * b.a
QUALIFY rank <= 2000
"""


def sql_op9() -> str:
    """The table is written out: SQL checks the placement, tests check the table."""
    slots = sharding.lookup_table(SHARDS)
    return f"""
WITH d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {len(slots)})::INT AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(({slots})[slot + 1]::VARCHAR, 2, '0') AS shard FROM d
"""


def sql() -> dict[str, str]:
    return {"op2_warc_zstd": SQL_OP2, "op4_odd_sketch_dedup": SQL_OP4, "op9_sharding": sql_op9(), "op10_quality_cascade": SQL_OP10,
            "op11_systematic_mixing": SQL_OP11, "op12_source_divergence": SQL_OP12, "op13_collocations": SQL_OP13}
