"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import ann, bwt_dedup, decontaminate, html_wrap, langid, packing, pii, prefix_trie, quality, runs, simhash, substring_dedup, topk
from lamella.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrap.main_text(table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return rows.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20, head=F.crc32(conv.cast("string")) % 4)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.whole(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse(runs.rewritten(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_langid, op2_packing, op3_substring_dedup, op4_decontaminate, op5_pii, op6_quality, op7_html, op8_ann, op9_simhash, op10_bwt_dedup, op11_prefix_trie, op12_topk, op13_runs)}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + k AS j FROM g JOIN f USING (g), (SELECT unnest(range(13)) AS k) WHERE least < doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.j) AS kept FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.j = a.j WHERE r.j IS NULL GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    # crc32 bit by bit; a node is its list of turns
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t.r, t.x) AS ts,
 xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda k, i: xor(k >> 1, 3988292384 * (k & 1))))) % 4 AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(coalesce(p.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN c AS p ON p.conv_id = c.conv_id - c.conv_id % 20),
d AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM b),
p AS (SELECT conv_id, depth, ts[1:depth] AS k, ts[1:depth - 1] AS pk, depth = len(ts) AS ends FROM d),
n AS (SELECT depth, k, any_value(CASE WHEN depth > 0 THEN pk END) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs,
 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
 CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(k[depth].x, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY depth, k),
f AS (SELECT n.*, (SELECT count(*) FROM n AS m WHERE m.depth = n.depth + 1 AND m.pk = n.k) AS n_children FROM n),
s AS (SELECT a.depth, a.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
 FROM n AS a JOIN f ON f.depth >= a.depth AND f.k[1:a.depth] = a.k GROUP BY a.depth, a.k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.depth = f.depth AND s.k = f.k LEFT JOIN n AS q ON q.depth = f.depth - 1 AND q.k = f.pk""",
    "op12_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.row AS row, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
 FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, row) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
