"""Bound queries of the corpus operators, with their oracle SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlog.llm import centroids, decontaminate, jaccard, merkle, packing, pieces, quality, sharding, substrings, suffixes, topk, url_filter, warc

cloudpickle.register_pickle_by_value(sys.modules["decisionlog.llm"])  # tasks need no copy of the package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host, path prefix)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SHARDS = [f"shard-{k:02d}" for k in range(48)]

OP1_SQL = """
WITH parts AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
won AS (
  SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict FROM parts JOIN rules r
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url),
keyed AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM keyed WHERE contains(url, 'utm_source=') AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM keyed k LEFT JOIN won w USING (page_id, url) LEFT JOIN listed l USING (canonical)"""


@query(OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the rules; others are blocked if any page carries their URL in a tracked link (``utm_source``)."""
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    listed = pages.filter(url.contains("utm_source=")).select(url_filter.canonical(url_filter.host(url), url_filter.path(url)))
    return url_filter.filter_urls(pages, listed, URL_RULES).drop("possible")


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best piece ids, the next paths with their scores, and whether decoding gives the text back."""
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "score", "ids", "alternatives", "lossless")


@query()
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot and shard, and its shard once one more is added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    placed = sharding.place(sharding.place(docs, ["doc_id"], SHARDS), ["doc_id"], [*SHARDS, "shard-48"], name="shard_after")
    return placed.withColumn("slot", sharding.slot_of([F.col("doc_id")])).withColumn("moves", F.col("shard") != F.col("shard_after"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS least FROM w) WHERE least < doc_id), range(0, 13) AS r(k)),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query(OP5_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_report(table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents, their id and position lines as digests."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    digests = {"ids": F.sha2("ids", 256), "positions": F.sha2("positions", 256)}
    return packed.withColumns(digests)


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
reach AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN reach USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)) AS kept
FROM f"""


@query(OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i+least(10, len(words))-1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i+n-1], ' ') AS gram FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, item_id, dw.n AS n, i FROM dw JOIN bw USING (n, gram)),
hit AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query(OP8_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_report(table(spark, sf_dir, "documents"))


@query()
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_sql(k: int = 40, rounds: int = 5) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY draw) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS draw FROM v ORDER BY draw LIMIT {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min(d * 64 + c) AS best FROM (SELECT vec_id, c, CAST(list_dot_product(CAST(v.v AS DOUBLE[]), CAST(v.v AS DOUBLE[]))
  + list_dot_product(CAST(c.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) - 2 * list_dot_product(CAST(v.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS d FROM v, c{r} AS c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(moved, v) AS v FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n + n) % n)) // n) ORDER BY i) AS moved
  FROM (SELECT best % 64 AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id), range(1, 65) AS r(i) GROUP BY ALL) GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, best // 64 AS distance, CAST(sum(best // 64) OVER (PARTITION BY best % 64) AS BIGINT) AS cluster_inertia,
  CAST(sum(best // 64) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best % 64 = c"""


@query(op11_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


@query(OP12_SQL)
def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def _h(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


#: parity of the CRC-32 of a decimal number, byte by byte and bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
  lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (a & 1::UBIGINT)))))"""

OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, sha256({_h("doc_id")} || {_h("source")} || {_h("lang")} || {_h("n_chars")} || {_h("text")}) AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN sha256({_h("doc_id")} || {_h("source")} || {_h("lang")} || {_h("n_chars")} || {_h("replace(text, chr(10), '')")}) END AS other FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
low AS (SELECT source, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
heads AS MATERIALIZED (SELECT source, lvl AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, n, h FROM heads
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
nodes AS MATERIALIZED (SELECT source, lvl, pos, h FROM low WHERE n > 1 UNION ALL SELECT heads.source, height + high.lvl, high.pos, high.h FROM heads, high WHERE high.n > 1),
walk AS (SELECT doc_id, p.source, 0 AS lvl, p.pos AS pos, height, heads.pos AS top, coalesce(other, leaf) AS h FROM p JOIN heads ON p.source IS NOT DISTINCT FROM heads.source
  UNION ALL SELECT doc_id, w.source, w.lvl + 1, CASE WHEN w.lvl + 1 = height THEN top ELSE w.pos // 3 END, height, top, sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.h ELSE s.h END, '' ORDER BY s.pos))
  FROM walk w JOIN nodes s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.pos // 3 = s.pos // 3 GROUP BY doc_id, w.source, w.lvl, w.pos, height, top),
mates AS (SELECT doc_id, sha256(coalesce(string_agg(s.h, '' ORDER BY w.lvl, s.pos), '')) AS proof FROM walk w LEFT JOIN nodes s
  ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.pos // 3 = s.pos // 3 AND w.pos <> s.pos GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, lvl) AS folded FROM walk GROUP BY doc_id)
SELECT p.doc_id, leaf, heads.h AS subroot, high.h AS root, proof AS proof_sha256, folded AS folded_root, folded = high.h AS verified
FROM p JOIN heads ON p.source IS NOT DISTINCT FROM heads.source JOIN mates ON mates.doc_id = p.doc_id JOIN ends ON ends.doc_id = p.doc_id, high WHERE high.n = 1"""


@query(OP13_SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded again from texts of which some lost their line breaks."""
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(table(spark, sf_dir, "documents"), cut)
