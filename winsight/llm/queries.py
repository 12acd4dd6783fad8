"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from winsight.llm import langid, toxicity
from winsight.llm.centroids import cluster
from winsight.llm.decontaminate import scan
from winsight.llm.exact import exact_dedup
from winsight.llm.licences import scan_licences
from winsight.llm.lines import dedup_lines
from winsight.llm.mixing import plan_mix
from winsight.llm.neighbours import nearest_neighbours
from winsight.llm.preferences import format_preferences, swapped_answers
from winsight.llm.repeats import remove_repeats
from winsight.llm.simhash import near_duplicates
from winsight.llm.spelling import spelling_variants


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preferences(spark, sf_dir):
    """The table marks no preferences: a conversation is chosen over itself with its neighbour's last answer."""
    turns = swapped_answers(_t(spark, sf_dir, "conversations"))
    out = format_preferences(turns, F.col("pair"), F.col("chosen"))
    spans = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return out.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


SQL_OP1 = """
WITH l AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1),
u AS (SELECT conv_id AS pair, true AS c, turn, role, text FROM conversations
      UNION ALL SELECT conv_id, false, turn, role, text FROM conversations LEFT JOIN l USING (conv_id) WHERE last_turn IS NULL OR turn < last_turn
      UNION ALL SELECT a.conv_id, false, a.last_turn, 'assistant', b.answer FROM l a JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
t AS (SELECT pair, c, role, text, row_number() OVER (PARTITION BY pair, c ORDER BY turn, role, text) AS i,
             '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS r,
             length(coalesce(role, '')) + 5 AS head FROM u),
m AS (SELECT a.pair, min(a.i) AS i FROM t a JOIN t b ON a.pair = b.pair AND a.i = b.i AND a.c AND NOT b.c
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
n AS (SELECT pair, coalesce(any_value(m.i) - 1, least(count(*) FILTER (c), count(*) FILTER (NOT c))) AS n
      FROM t LEFT JOIN m USING (pair) GROUP BY 1),
x AS (SELECT *, sum(CASE WHEN t.i > n THEN length(r) ELSE 0 END) OVER (PARTITION BY pair, c ORDER BY i) AS e FROM t JOIN n USING (pair)),
y AS (SELECT *, (e - length(r) + head)::BIGINT || '-' || e::BIGINT AS span FROM x)
SELECT pair, any_value(n)::BIGINT AS prompt_turns, coalesce(string_agg(r, '' ORDER BY i) FILTER (c AND i <= n), '') AS prompt,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (c AND i > n), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (NOT c AND i > n), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (c AND i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (NOT c AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY pair
"""


def op2_suffix_dedup(spark, sf_dir):
    return remove_repeats(_t(spark, sf_dir, "documents"))


# every 200-byte string by itself: starts that occur twice, runs of covered bytes, what lies between them
SQL_OP2 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS s FROM h)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, true) AS new FROM w SEMI JOIN r USING (k)),
g AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM p),
a AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY ALL),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM a),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM c JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""


def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_lines_removed").alias("lines_removed"),
                      F.col("_chunks_removed").alias("chunks_removed"),
                      F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


# lines, the rolling value over three line hashes, chunks, first occurrences
SQL_OP3 = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
v AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS v FROM l),
r AS (SELECT *, v + 31 * coalesce(lag(v) OVER d, 0) + 961 * coalesce(lag(v, 2) OVER d, 0) AS r,
             lead(i) OVER d IS NULL AS last FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum((r % 4 = 0 OR last)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r),
k AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY ALL),
f AS (SELECT *, n >= 2 AND regexp_matches(t, '[^ \t\n\r\x0b\x0c]')
             AND row_number() OVER (PARTITION BY t ORDER BY doc_id, chunk) > 1 AS gone FROM k)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS lines_removed,
       count(*) FILTER (gone) AS chunks_removed,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op4_decontaminate(spark, sf_dir):
    out = scan(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), n=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL_OP4 = r"""
WITH
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win
      FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i))),
h AS (SELECT doc_id, s, x.k, item_id FROM x JOIN i ON x.k = i.k AND x.win = i.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op5_simhash(spark, sf_dir):
    return near_duplicates(_t(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op6_mix(spark, sf_dir):
    return plan_mix(_t(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


def op7_licences(spark, sf_dir):
    """The table has no paths: a document's is its source, a folder of a hundred ids, and its id."""
    docs = _t(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"))


def op8_language(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op9_toxicity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _t(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(_t(spark, sf_dir, "documents"), keep="max")


SQL_OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op11_neighbours(spark, sf_dir):
    """Every vector whose id is divisible by 100, against all."""
    return nearest_neighbours(_t(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op12_clusters(spark, sf_dir):
    return cluster(_t(spark, sf_dir, "embeddings"))


# one round: every vector measured against every centroid (a row per centroid and component), then the floor of the means
_ROUND = """
a{r} AS (SELECT row, min(struct_pack(distance, cluster)) AS best FROM
         (SELECT row, cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY 1),
m{r} AS (SELECT a.best.cluster AS cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} a USING (row) GROUP BY ALL),
c{n} AS (SELECT cluster, i, CASE WHEN m.n IS NULL THEN c.x ELSE (s - (s % m.n + m.n) % m.n) // m.n END AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, i)),"""

SQL_OP12 = """
WITH k AS (SELECT vec_id, embedding AS e, row_number() OVER () AS row FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT row, i, floor(64 * e[i]::DOUBLE)::BIGINT AS x FROM k, range(1, 65) t(i)),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM k),
c0 AS (SELECT cluster, i, x FROM v JOIN s USING (row) WHERE cluster < 16),""" + "".join(_ROUND.format(r=r, n=r + 1) for r in range(4)) + """
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY 1),
f AS (SELECT vec_id, best.cluster::INT AS "cluster", best.distance AS distance FROM a3 JOIN k USING (row))
SELECT *, (sum(distance) OVER (PARTITION BY "cluster"))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia
FROM f JOIN h USING ("cluster")
"""


def op13_spellings(spark, sf_dir):
    return spelling_variants(_t(spark, sf_dir, "documents"), min_chars=5, min_count=3, slips=97)


# CRC-32 byte by byte over a table that is made here; near words through all single deletions
SQL_OP13 = r"""
WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
o AS (SELECT doc_id, run, count(*) AS k FROM (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
      WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM o),
h AS (SELECT run, k, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                         lambda c, y: xor(c // 256, tab[xor(c, y) % 256 + 1]), 4294967295), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
      FROM h GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5),
g AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM g a JOIN w b ON a.less = b.word
      UNION SELECT b.word, a.word, a.n FROM g a JOIN w b ON a.less = b.word),
m AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, w := other)) AS best FROM p GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n
      FROM w LEFT JOIN m USING (word)),
c AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN c USING (word) JOIN f r ON r.word = c.root WHERE r.form IS NULL
"""


def queries() -> dict:
    return {
        "op1_preferences": op1_preferences,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_simhash": op5_simhash,
        "op6_mix": op6_mix,
        "op7_licences": op7_licences,
        "op8_language": op8_language,
        "op9_toxicity": op9_toxicity,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_neighbours": op11_neighbours,
        "op12_clusters": op12_clusters,
        "op13_spellings": op13_spellings,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_preferences": SQL_OP1,
        "op2_suffix_dedup": SQL_OP2,
        "op3_line_dedup": SQL_OP3,
        "op4_decontaminate": SQL_OP4,
        "op10_exact_dedup": SQL_OP10,
        "op12_clusters": SQL_OP12,
        "op13_spellings": SQL_OP13,
    }
