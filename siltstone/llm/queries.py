"""The queries of this subpackage: one a operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import chat, dualtree, exact, fingerprint, mixing, nearjoin, packing, quality, signs, structure, substring, suffix, tokenfile
from siltstone.llm.tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(_table(spark, sf_dir, "documents"), window=35)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_groups(_table(spark, sf_dir, "documents"), percent=85, size=3)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.through_file(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), kind="word", end_id=1)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), kind="byte", end_id=2, capacity=1024)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(_table(spark, sf_dir, "documents"), window=100)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return structure.report(turns, structure.damage(turns))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.clusters(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signs.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fingerprints, op2_substring_dedup, op3_minhash_dedup, op4_exact_dedup, op5_chat_perspectives, op6_token_ids, op7_packing, op8_quality, op9_mixing, op10_suffix_dedup, op11_structure_repair, op12_centroid_clusters, op13_near_vectors)
    return {f.__name__: f for f in own}


OP4 = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

OP5 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
s AS (SELECT t.conv_id, speaker, turn, role, text, role = speaker AS trained,
  CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A') || '|>' || chr(10) END AS header
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
r AS (SELECT *, header || replace(text, '<|', '<||') || chr(10) || '<|end|>' || chr(10) AS rendered FROM s),
o AS (SELECT *, length(rendered)::BIGINT AS n_chars, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r)
SELECT conv_id, speaker, turn, role, rendered, start, n_chars, trained,
  CASE WHEN trained THEN start + length(header) END::BIGINT AS mask_start, CASE WHEN trained THEN start + n_chars END::BIGINT AS mask_end FROM o
"""

OP9 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][rnk % 3 + 1]::DOUBLE AS w, [-0.5, 0.0, 0.5][rnk % 3 + 1]::DOUBLE AS g, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
  / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level AS found FROM l WHERE level <= cap / w ORDER BY cap / w, rnk LIMIT 1),
t AS (SELECT source, source_size, g, coalesce(least(cap, found * w), cap) AS target FROM l LEFT JOIN f ON true),
b AS (SELECT d.*, t.source_size, t.target, t.g, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - done)) AS one, greatest(0, least(size, round(target)::BIGINT - done - source_size)) AS two FROM b)
SELECT doc_id, source, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN CASE WHEN g = 0 THEN done / target ELSE (sqrt((1 - g) * (1 - g) + 4 * g * (done / target)) - (1 - g)) / (2 * g) + 0.0 END END::DOUBLE AS position,
  CASE WHEN two > 0 THEN CASE WHEN g = 0 THEN (done + source_size) / target ELSE (sqrt((1 - g) * (1 - g) + 4 * g * ((done + source_size) / target)) - (1 - g)) / (2 * g) + 0.0 END END::DOUBLE AS position_again, mark
FROM k
"""


ROUND = """
a{r} AS (SELECT v.n, arg_min(c.num, struct_pack(d := list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), num := c.num)) AS num FROM v CROSS JOIN c{p} c GROUP BY v.n),
m{r} AS (SELECT num, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM (SELECT a.num, unnest(v.q) AS x, unnest(range(1, 65)) AS pos FROM a{r} a JOIN v USING (n)) GROUP BY num, pos),
t{r} AS (SELECT num, list((s - ((s % k) + k) % k) // k ORDER BY pos) AS q FROM m{r} GROUP BY num),
c{r} AS (SELECT num, coalesce(t{r}.q, c{p}.q) AS q FROM c{p} LEFT JOIN t{r} USING (num)),"""

OP12 = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS num, q FROM v QUALIFY num < 16),""" + "".join(ROUND.format(r=r, p=r - 1) for r in (1, 2, 3)) + """
f AS (SELECT v.n, v.vec_id, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), num := c.num)) AS best FROM v CROSS JOIN c3 c GROUP BY v.n, v.vec_id)
SELECT vec_id, CAST(best.num AS INTEGER) AS "cluster", best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.num) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256 FROM f JOIN c3 ON c3.num = best.num
"""

OP13 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: coalesce(CAST(x AS DOUBLE), CAST('nan' AS DOUBLE))) AS x,
  len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
o AS (SELECT n, x FROM v WHERE ok),
l AS (SELECT a.n AS a, b.n AS b FROM o a JOIN o b ON a.n <> b.n AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT n AS root, n FROM v UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.n),
g AS (SELECT r.root AS n, min(v.vec_id) AS component_id FROM r JOIN v ON v.n = r.n GROUP BY r.root),
k AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN g USING (n) LEFT JOIN k USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4, "op5_chat_perspectives": OP5, "op9_mixing": OP9, "op12_centroid_clusters": OP12, "op13_near_vectors": OP13}
