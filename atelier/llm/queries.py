"""The registered queries of the operators: thin digests with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language, lm_scoring, packing, permutation_index, pii, substring_dedup, token_files, url_filter
from .common import scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A public tokenizer's file; ATELIER_TOKENIZERS names another folder."""
    if folder := os.environ.get("ATELIER_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


#: The rules that the query is asked for.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select(F.col("page_id").cast("long").alias("page_id"), "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.p_block")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), uri, tokenizer("byte_bpe_50k.json"), end=0)
    return token_files.read_tokens(spark, uri)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "n_links")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.KINDS))
    n = [F.size(F.filter("pii", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *n, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score(docs, lm_scoring.train(docs.where(_remainder(5) != 1)))
    return scored.select("doc_id", F.coalesce(_remainder(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end=2, with_ids=False).drop("ids")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "found.contaminated")


def language_model(docs: DataFrame) -> dict:
    """Learns from documents whose crc32 remainder by 3 is not 1."""
    return language.train(docs.where(_remainder(3) != 1))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language_model(docs))
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(_table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeated_passages(docs).drop("id")


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_files": op2_token_files,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii": op4_pii,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_language": op8_language,
    "op9_permutation_index": op9_permutation_index,
    "op10_substring_dedup": op10_substring_dedup,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM
    (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM sized))),
found AS (SELECT r, p, places.n AS n, item_id FROM places JOIN windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
link AS MATERIALIZED (SELECT x, y FROM half UNION SELECT y, x FROM half),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM link l WHERE l.x = reach.x) AS n_links FROM reach GROUP BY x
"""

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op7_decontaminate": OP7_SQL,
}
