"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

Every stage but the last returns the columns of documents; nulls, repeated rows, very long texts, ties and empty tables pass as each
operator's docstring says. Repeated rows are one document from the near-duplicate stage on; of rows that agree in doc_id and text but
not in other columns the one whose columns have the least hash stays, whatever the order of the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.llm import decontaminate, jaccard_join, language, packing, pii
from atelier.llm.common import free, stored
from atelier.llm.queries import language_model, tokenizer

#: Of the tokenizer's pieces a worker keeps fewer here, as the executor's memory has grown in the stages before.
KNOWN_PIECES = 250_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one or several languages; those without a letter (`und`) go. Without labelled rows all stay."""
    model = language_model(docs)
    if not model["langs"]:
        return docs
    name = free(docs, "_language")
    found = language.identify(docs, model, result_col=name)
    return found.where(F.col(f"`{name}`")["lang"] != language.UND).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id stays (nulls last), of repeated rows one."""
    kept = jaccard_join.near_duplicates(docs).where(F.col("id") == F.col("keeper")).select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h")).distinct()
    h, row = free(docs, "_h"), free(docs, "_row")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(h) == F.col("kept_h"))
    rows = docs.withColumn(h, jaccard_join.text_hash("text")).join(kept, same, "left_semi")
    order = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")))
    one = rows.groupBy("doc_id", h).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias(row))
    return one.select(*(F.col(row)[c].alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty lies in windows of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = free(docs, "_found")
    found = decontaminate.decontaminate(docs, benchmark, result_col=name)
    return found.where(~F.col(f"`{name}`")["contaminated"]).drop(name)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms are replaced in the text; n_chars follows. What a mask sets free is masked in turn."""
    spans, once, more = (free(docs, name) for name in ("_pii", "_once", "_more"))
    masked = pii.find(docs, result_col=spans).withColumn(once, pii.sanitise(F.coalesce("text", F.lit("")), F.col(spans)))
    masked = masked.withColumn(more, F.when(F.size(spans) > 0, pii.base_spans(F.col(once))))
    clean = F.when(F.size(more) > 0, pii.sanitise(F.col(once), F.col(more))).otherwise(F.col(once))
    text = F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))
    n = F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return masked.select(*(text.alias("text") if c == "text" else n.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens with their ids; packing.sequences puts them together."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end=2, known=KNOWN_PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", sanitised),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model and the near-duplicate components can't be expressed in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None
