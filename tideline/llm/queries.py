"""Registered queries of this subpackage: name -> fn(spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import collocations, mixing, multi_index, ngram_join, packing, prefix_trie, quality_gam, quality_rules, repeated_phrases, simple8b, slots, token_counts, url_lists
from tideline.llm.frames import table
from tideline.session import run_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Python workers of this machine find the package wherever the driver was started
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_crf_line_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, content share and verdict of every document."""
    documents = table(sf_dir, spark, "documents").select("doc_id", "text")
    field = quality_rules.fit_rules(documents, table(sf_dir, spark, "labels"))
    return quality_rules.judged(documents, field).drop("text")


#: The first day of captures and list entries, which the pages do not carry; both are drawn over a leap year by md5.
START, DAYS = "2024-01-01", 366


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page with a day of fetching."""
    day = F.conv(F.substring(F.md5(F.concat(F.lit("fetch"), F.col("page_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("int") % DAYS
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), day).alias("fetch_date"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list as large as the pages: every page gives one entry for its page, folder, host or parent domain."""
    digits = F.md5(F.concat(F.lit("entry"), F.col("page_id").cast("string")).cast("binary"))
    part = lambda at, many: F.conv(F.substring(digits, at, many), 16, 10).cast("int")
    url = F.col("url")
    kind = F.when(part(1, 1) < 6, "page").when(part(1, 1) < 10, "folder").when(part(1, 1) < 15, "host").otherwise("domain")
    parent = F.get(url_lists.domains_of(url_lists.host_of(url)), F.lit(1))
    pattern = F.when(kind == "page", url_lists.page_of(url)).when(kind == "folder", url_lists.folder_of(url)).when(kind == "host", url_lists.host_of(url)).otherwise(parent)
    action = F.when(part(2, 1) < 7, "block").when(part(2, 1) < 10, "allow").otherwise("remove")
    return pages.select(kind.alias("kind"), pattern.alias("pattern"), action.alias("action"), F.date_add(F.lit(START).cast("date"), part(3, 6) % DAYS).alias("on_date"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5('entry' || page_id) AS e,
         DATE '2024-01-01' + CAST(('0x' || substr(md5('fetch' || page_id), 1, 6))::BIGINT % 366 AS INT) AS fetch_date,
         nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
q AS (
  SELECT *, host || path AS page,
         CASE WHEN regexp_extract(path, '^/([^/]+)', 1) <> '' THEN host || '/' || regexp_extract(path, '^/([^/]+)', 1) END AS folder,
         string_split(host, '.') AS labels,
         ('0x' || substr(e, 1, 1))::INT AS k, ('0x' || substr(e, 2, 1))::INT AS a,
         DATE '2024-01-01' + CAST(('0x' || substr(e, 3, 6))::BIGINT % 366 AS INT) AS on_date
  FROM p),
entries AS (
  SELECT CASE WHEN k < 6 THEN 'page' WHEN k < 10 THEN 'folder' WHEN k < 15 THEN 'host' ELSE 'domain' END AS kind,
         CASE WHEN k < 6 THEN page WHEN k < 10 THEN folder WHEN k < 15 THEN host
              WHEN len(labels) >= 3 THEN array_to_string(labels[2:], '.') END AS pattern,
         CASE WHEN a < 7 THEN 2 WHEN a < 10 THEN 1 ELSE 0 END AS strict, on_date
  FROM q),
daily AS (SELECT kind, pattern, on_date, max(strict) AS strict FROM entries WHERE pattern IS NOT NULL GROUP BY ALL),
runs AS (SELECT *, lag(strict) OVER (PARTITION BY kind, pattern ORDER BY on_date) AS before FROM daily),
changes AS (SELECT * FROM runs WHERE before IS NULL OR before <> strict),
asked AS (
  SELECT page_id, fetch_date, 4000 AS level, 'page' AS kind, page AS pattern FROM q
  UNION ALL SELECT page_id, fetch_date, 3000, 'folder', folder FROM q
  UNION ALL SELECT page_id, fetch_date, 2000, 'host', host FROM q
  UNION ALL SELECT page_id, fetch_date, 1000 + len(labels) - i + 1, 'domain', array_to_string(labels[i:], '.')
            FROM (SELECT *, unnest(range(1, len(labels))) AS i FROM q)),
hits AS (
  SELECT s.page_id, s.level, s.kind, s.pattern, c.strict, c.on_date AS since
  FROM asked s ASOF JOIN changes c ON s.kind = c.kind AND s.pattern = c.pattern AND s.fetch_date >= c.on_date),
best AS (
  SELECT page_id, count(*) AS n_active, max(level) AS level, arg_max(kind, level) AS kind, arg_max(pattern, level) AS pattern,
         arg_max(strict, level) AS strict, arg_max(since, level) AS since
  FROM hits WHERE strict > 0 GROUP BY page_id)
SELECT q.page_id, q.url, q.fetch_date, coalesce(n_active, 0)::BIGINT AS n_active, kind, pattern,
       CASE strict WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS action, since, coalesce(strict <> 2, true) AS kept
FROM q LEFT JOIN best USING (page_id)
"""


@query("op2_temporal_list_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page held against the list entries that were active on its day of fetching."""
    pages = table(sf_dir, spark, "pages").select("page_id", "url")
    return url_lists.verdicts(page_captures(pages), list_entries(pages), "page_id", "url", "fetch_date")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS key, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS tie
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
c AS (SELECT *, (total - stopped) / open * w >= cap AS capped FROM r),
t AS (
  SELECT key, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w END AS target
  FROM c),
x AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(target / t.source_size * 16777216)::BIGINT ELSE 0 END AS rate,
         ('0x' || substr(md5('0' || key), 1, 6))::BIGINT AS u,
         row_number() OVER (PARTITION BY key ORDER BY size, tie, doc_id) - 1 AS rank
  FROM d JOIN t USING (key))
SELECT doc_id, size, source_size, target, ((rank + 1) * rate + u) // 16777216 - (rank * rate + u) // 16777216 AS copies,
       (((rank + 1) * rate + u) // 16777216 - (rank * rate + u) // 16777216) * size AS taken
FROM x
"""


@query("op3_systematic_mix", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is taken when sources weigh 5, 2, 1, repeating."""
    return mixing.mix_plan(table(sf_dir, spark, "documents"), weights=(5, 2, 1), max_repeat=3)


@query("op4_inverted_multi_index")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return multi_index.nearest_rows(table(sf_dir, spark, "embeddings"), every=20, top=20)


@query("op5_simple8b_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Simple-8b token files and read back."""
    path = run_dir(spark, "token-files")
    return simple8b.token_file_digests(table(sf_dir, spark, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op6_virtual_slots")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 24 under a rebalanced slot map."""
    return slots.sharded(table(sf_dir, spark, "documents"), run_dir(spark, "slot-map"), shards=24)


@query("op7_differencing_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in windows of 1024 tokens."""
    return packing.packed_pieces(table(sf_dir, spark, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


@query("op8_rank_merge_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether it has more than 512."""
    return token_counts.token_counts(table(sf_dir, spark, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op9_count_tree_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-copy component of every document."""
    return ngram_join.jaccard_components(table(sf_dir, spark, "documents"), size=5)


@query("op10_additive_quality_model")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from labels outside the held-out quarter."""
    documents = table(sf_dir, spark, "documents").select("doc_id", "text")
    labels = table(sf_dir, spark, "labels").filter(~quality_gam.held_out(F.col("doc_id")))
    model = quality_gam.fit_quality(documents, labels)
    rows = quality_gam.scored(documents, model).select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM i, (VALUES (1), (2), (3), (4)) v(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS x FROM g WHERE m > 1 AND f >= 30),
b AS (SELECT *, unnest(range(1, m + 1)) AS lo FROM c),
e AS (SELECT *, unnest(range(lo + 1, m + 1)) AS hi FROM b),
longer AS (SELECT lang, array_to_string(x[lo:hi], ' ') AS phrase, max(a) AS longer FROM e WHERE hi - lo + 1 < m GROUP BY ALL),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, (2000000::HUGEINT * k.a // (l.f + r.f))::BIGINT AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(x[:k], ' ')
         JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(x[k + 1 :], ' ')
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
  FROM s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_stripe_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return collocations.collocations(table(sf_dir, spark, "documents"), least=30, top=2000)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT *, CASE WHEN i + 49 <= n THEN string_agg(word, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM s WHERE win IS NOT NULL GROUP BY win),
h AS (SELECT s.row, s.i, s.word, coalesce(f.first < s.doc_id, false) AS hit FROM s LEFT JOIN f USING (win)),
g AS (SELECT row, i, word, max(hit::INT) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
t AS (SELECT row, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (row)
"""


@query("op12_phrase_automata", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that an earlier one holds."""
    return repeated_phrases.without_repeats(table(sf_dir, spark, "documents"), window=50, with_text=False).drop("kept_text")


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) % 9 AS h
  FROM t),
r AS (
  SELECT ids.c, 0 AS own, t.i, t.k, t.text FROM ids JOIN t ON t.c = ids.c - ((ids.c % 5) + 5) % 5 AND t.i <= h
  UNION ALL SELECT ids.c, 1, t.i, t.k, t.text FROM ids JOIN t ON t.c = ids.c AND t.i > h),
p AS (
  SELECT c, 0::BIGINT AS d, '' AS key, 0 AS bytes FROM ids
  UNION ALL SELECT c, row_number() OVER o, string_agg(k, '') OVER o, strlen(text) FROM r WINDOW o AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
node AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM p GROUP BY d, key),
kids AS (SELECT substr(key, 1, 32 * (d - 1)::INT) AS key, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
ends AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, d, key FROM p QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY key),
each AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (key)),
up AS (SELECT substr(key, 1, 32 * e) AS key, n, bytes, d, kids FROM (SELECT *, unnest(range(0, d + 1))::INT AS e FROM each)),
subtree AS (SELECT key, sum((kids = 0)::INT)::BIGINT AS leaves, sum((n - 1) * bytes)::BIGINT AS saved FROM up GROUP BY key)
SELECT e.conv_id, e.d AS depth, a.conv_id AS parent_conv_id, e.n AS n_convs, e.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM each e JOIN subtree s USING (key) LEFT JOIN ends USING (key) LEFT JOIN node a ON e.d > 0 AND a.key = substr(e.key, 1, 32 * (e.d - 1)::INT) AND a.d = e.d - 1
"""


@query("op13_skeleton_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(sf_dir, spark, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to packed pieces."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
