"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import infill, language, mixing, neighbours, packing, pii, prefix_trie, quality, simhash, substring, token_counts, topk, toxicity
from tallyspark.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_mix_sources, op3_simhash_near_dedup, op4_personal_data, op5_quality, op6_language_id, op7_best_fit_packing,
        op8_nearest_neighbours, op9_exact_top_k, op10_toxicity, op11_fill_in_middle, op12_token_counts, op13_conversation_trie,
    )  # fmt: skip
}

#: DuckDB's SQL for the operators that SQL can express; tests compare the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
place AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS win FROM place WHERE p + 49 <= len(words)),
low AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win),
hit AS (SELECT doc_id, p FROM win JOIN low USING (win) WHERE doc_id > low),
last AS (SELECT place.doc_id, place.p, place.words[place.p] AS word, max(hit.p) OVER (PARTITION BY place.doc_id ORDER BY place.p) AS hit
         FROM place LEFT JOIN hit ON place.doc_id = hit.doc_id AND place.p = hit.p),
gone AS (SELECT *, coalesce(p - hit < 50, FALSE) AS gone FROM last),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS starts FROM gone),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_intervals,
                string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM edge GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_intervals, 0) AS n_intervals
FROM w LEFT JOIN sums ON w.doc_id = sums.doc_id""",
    "op9_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                  WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""",
    "op13_conversation_trie": r"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
             FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list_transform(range(256), lambda k: list_reduce([CAST(k AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
ids AS (SELECT DISTINCT conv_id FROM own),
heads AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS BIGINT) + 1])), 4294967295) % 4 AS h FROM ids, crc),
built AS (SELECT h.conv_id, b.role, b.text, b.pos FROM heads h JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20 AND b.pos <= h.h
          UNION ALL SELECT h.conv_id, o.role, o.text, o.pos FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, text, sha256(length(role) || ':' || role || text) AS turn FROM built),
paths AS (SELECT conv_id, depth, text, list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
          UNION ALL SELECT conv_id, 0, '', CAST([] AS VARCHAR[]) FROM ids),
longest AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^ 	-]+')) AS words,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l.conv_id IS NOT NULL), '') AS ends
          FROM paths LEFT JOIN longest l USING (conv_id, depth) GROUP BY path, depth),
kin AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kin USING (path)),
up AS (SELECT unnest(list_transform(range(depth + 1), lambda k: path[:k])) AS path, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM sized),
sums AS (SELECT path, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY path)
SELECT s.conv_id, s.depth, above.conv_id AS parent_conv_id, s.n_convs, s.n_children, sums.n_leaves, sums.saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN sums ON sums.path = s.path LEFT JOIN nodes above ON s.depth > 0 AND above.path = s.path[:s.depth - 1]""",
}
