"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from qforge.llm import (bpe, cover_tree, jaccard_join, k2_treap, license_scan, line_dedup, m_tree, mixing, runs, token_count, toxicity,
                        url_filter, warc)
from qforge.llm.common import Scratch, table

REGISTRY = {}


def query(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@query("op1_bpe_encode_decode")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=())
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar_texts(docs, width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.toxicity_scores(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


@query("op4_mixing")
def op4(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_counts")
def op5(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_warc")
def op6(spark, sf_dir):
    path = Scratch(spark, "warc").path("archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_exact_top_k")
def op7(spark, sf_dir):
    return m_tree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op8_embedding_near_dedup")
def op8(spark, sf_dir):
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op9_url_filter")
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_line_dedup")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs, min_sites=None).select(
        "doc_id", "n_lines", "n_removed", F.md5("clean_text").alias("clean_md5"))


@query("op11_license_scan")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("licenses")
    return license_scan.scan_licenses(docs).select(
        "doc_id", found.n_words.alias("n_words"), found.n_base.alias("n_base"), found.first_word.alias("first_word"),
        found.last_word.alias("last_word"), F.array_join(found.base_labels, ",").alias("base_labels"),
        F.array_join(found.labels, ",").alias("labels"), found.score.alias("score"))


def tenth_made_periodic(docs):
    """Of every tenth document by checksum of its id, the words from a certain
    one on repeat in a certain period; all other texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("words").cast("long")
    changed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    on = F.coalesce(h % 10 == 0, F.lit(False))
    return (docs.withColumn("words", F.when(on, words)).withColumn("a", F.when(n > 0, g % n))
            .withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
            .withColumn("text", F.when(on & (n > 0), F.array_join(changed, " ")).otherwise(F.col("text")))
            .select("doc_id", "text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = tenth_made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs_ = F.col("periodic.runs")
    lines = F.transform(runs_, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))

    def order(a, b):
        x, y = a.length * b.period, b.length * a.period
        return (F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1))
                .when(a.period != b.period, F.when(a.period < b.period, -1).otherwise(1)).otherwise(0))
    top = F.get(F.array_sort(runs_, order), 0)
    return (runs.periodic_runs(docs).select("doc_id", F.size(runs_).cast("long").alias("n_runs"), top.alias("top"),
                                            F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                                            F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                    F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))


@query("op13_ranked_search")
def op13(spark, sf_dir):
    index = k2_treap.index_documents(table(spark, sf_dir, "documents"), Scratch(spark, "lexical").path("index"))
    return k2_treap.search(index, table(spark, sf_dir, "benchmark"))


SQL = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
c AS (  -- every possible number of capped sources, in the order in which they reach their caps
  SELECT *, 2 * source_size / weight AS at_cap,
         1.5 * sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s),
l AS (SELECT arg_min((total - capped)::DOUBLE / weight_left, at_cap) AS level FROM c
      WHERE (total - capped)::DOUBLE / weight_left * weight < 2 * source_size),
t AS (SELECT source, source_size, least(2.0 * source_size, coalesce(level * weight, 2.0 * source_size))::DOUBLE AS target FROM s LEFT JOIN l ON true),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
             target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS budget FROM t),
g AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
first_over AS (
  SELECT w.source, min(h) AS h, arg_min(upto, h) AS upto, arg_min(words, h) AS words, any_value(budget) AS budget
  FROM g JOIN w ON g.source IS NOT DISTINCT FROM w.source WHERE upto > budget GROUP BY w.source),
lim AS (
  SELECT w.source, CASE WHEN f.h IS NULL THEN 1::BIGINT << 53
                        WHEN abs(f.upto - f.budget) < abs(f.upto - f.words - f.budget) THEN f.h + 1 ELSE f.h END AS threshold
  FROM w LEFT JOIN first_over f ON w.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN h < threshold THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN lim ON d.source IS NOT DISTINCT FROM lim.source
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS digest, sha256(b) AS k FROM p),
m AS (SELECT k, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY k)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d LEFT JOIN m USING (k)
""",
    "op7_exact_top_k": r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda y: coalesce(isfinite(y), false)), false)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score, c.r AS cr
      FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20
""",
    "op8_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT r, label, x, len(x) AS n FROM v
      WHERE label IS NOT NULL AND len(x) > 0 AND NOT list_contains(list_transform(x, lambda y: coalesce(isfinite(y), false)), false)
        AND list_contains(list_transform(x, lambda y: y <> 0), true)),
p AS (SELECT a.r AS i, b.r AS j FROM g a JOIN g b ON a.label = b.label AND a.n = b.n AND a.r <> b.r
      WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
reach AS (SELECT i, i AS j FROM p UNION SELECT reach.i, p.j FROM reach JOIN p ON reach.j = p.i),
c AS (SELECT reach.i AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.j GROUP BY reach.i),
n AS (SELECT i AS r, count(*) AS n_links FROM p GROUP BY i)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN c USING (r)
""",
    "op9_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
    "op10_line_dedup": r"""
WITH v AS (SELECT text, min('s' || source) AS voice_s, count(*) FILTER (source IS NULL) AS nulls FROM documents WHERE text IS NOT NULL GROUP BY text),
voice AS (SELECT text, CASE WHEN nulls > 0 THEN least(coalesce(voice_s, 'null'), 'null') ELSE voice_s END AS site FROM v),
l AS (SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line, site FROM voice),
few AS (SELECT least(10, greatest(3, (count(DISTINCT site) + 1) // 2)) AS sites FROM l WHERE line <> ''),
bad AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= (SELECT sites FROM few)),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
x AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
y AS (SELECT r, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_removed,
             coalesce(string_agg(x.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS clean
      FROM x LEFT JOIN bad b ON trim(x.line, ' ' || chr(9) || chr(13)) = b.line GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, md5(clean) AS clean_md5
FROM d LEFT JOIN y USING (r)
""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
q AS (
  SELECT i, item_id, unnest(list_distinct(t)) AS term FROM (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
p AS (SELECT r, unnest(t) AS term FROM d),
f AS (SELECT r, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
m AS (SELECT r, doc_id, 50 + ((50 * len(t) * n) // l) AS m FROM d, s WHERE len(t) > 0),
x AS (SELECT q.i, q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q.i, q.item_id, m.r, m.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
""",
}
