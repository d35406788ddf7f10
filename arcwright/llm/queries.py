"""The queries of this subpackage and their SQL; __spark_entry__.py adds them where the subpackage is present."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, embedding, hostrep, langid, licenses, lm, minhash, quantize, search, suffixdedup, tokenfile, toxicity
from .common import read


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 7 = 2")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 4 = 2")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 3 = 1", threshold=0.7)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removals(read(spark, sf_dir, "documents"), size=50)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(read(spark, sf_dir, "documents"), size=5, percent=85)


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.links(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.written(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.codes(read(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrep.judged(read(spark, sf_dir, "pages"), hostrep.labelled(read(spark, sf_dir, "labels")), hostrep.rules_table(spark, hostrep.RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_array": op6_suffix_array,
    "op7_minhash": op7_minhash,
    "op8_embedding": op8_embedding,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_url_filter": op13_url_filter,
}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(10, len(w)) AS m, unnest([array_to_string(w[k:k + least(10, len(w)) - 1], ' ') FOR k IN range(1, len(w) - least(10, len(w)) + 2)]) AS s FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
x AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p))),
f AS (SELECT x.doc_id, x.m, x.k, p.item FROM x JOIN p ON x.m = p.m AND x.s = p.s),
h AS (SELECT doc_id, count(DISTINCT z) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS z FROM f) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS c FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(c, v.vec_id) AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT w.doc_id, p FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
i AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g),
j AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM j GROUP BY doc_id, k),
x AS (SELECT r.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS b FROM r),
t AS (SELECT x.doc_id, count(*) AS spans, sum(z - a) AS gone, max(z) AS z, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept FROM x JOIN d USING (doc_id) GROUP BY x.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * t.z + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op3_license_scan": licenses.oracle_sql(), "op6_suffix_array": OP6_SQL, "op7_minhash": OP7_SQL, "op8_embedding": OP8_SQL, "op11_lexical_search": search.oracle_sql(), "op12_vector_codes": quantize.oracle_sql(), "op13_url_filter": hostrep.oracle_sql()}
