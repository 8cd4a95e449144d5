"""Documents to training text: toxic ones out, one of each near-duplicate group, secrets hidden,
sources mixed to target weights, and the tokens of what is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.llm import bpe, minhash, mixing, secret_scan, toxicity
from wardflow.llm.queries import RANKS, table, trained
from wardflow.sources.scratch import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model, fitted on the labelled rows of ``sf_dir``, doesn't reject.

    Null and empty texts stay; rows that repeat are judged each on its own, and an empty table stays empty.
    """
    return toxicity.clean(docs, trained(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, of its smallest doc_id; rows without doc_id stay.

    Rows that repeat a doc_id are documents of their own, each by its text; with one text they are copies.
    """
    known = docs.where("doc_id IS NOT NULL")
    repeated = written(known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("copy_id")), "repeated")
    if repeated.isEmpty():
        extra = minhash.near_duplicate_groups(docs).where("NOT kept").select(F.col("doc_id").alias("copy_id")).distinct()
        return docs.join(extra, docs["doc_id"] == extra["copy_id"], "left_anti")
    # ids don't name rows here: one row for each id and text, and a number for each
    number, packed = (max(docs.columns, key=len) + end for end in ("_n", "_s"))
    others = F.struct(F.lit(0).alias(packed), *(c for c in docs.columns if c not in ("doc_id", "text")))
    same = docs["doc_id"] == repeated["copy_id"]
    # the first of equal rows in the order of what else they hold
    once = docs.join(repeated, same, "left_semi").groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias(packed))
    once = once.select(*(F.col(c) if c in ("doc_id", "text") else F.col(packed)[c].alias(c) for c in docs.columns))
    rows = docs.join(repeated, same, "left_anti").unionByName(once)
    rows = written(rows.withColumn(number, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    groups = minhash.near_duplicate_groups(rows.select(F.col(number).alias("doc_id"), "text"))
    groups = written(groups.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"), F.col("component_id").alias("c")), "copies")
    narrow = rows.select(F.col(number).alias("n"), "doc_id", F.sha2("text", 256).alias("digest"))
    first = groups.join(narrow, "n").groupBy("c").agg(F.min(F.struct("doc_id", "digest", "n"))["n"].alias("n"))
    extra = groups.join(first, "n", "left_anti").select(F.col("n").alias("copy_id"))
    return rows.join(extra, rows[number] == extra["copy_id"], "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with secrets replaced by a mark and ``n_chars`` of the new text; null stays null."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; of repeated rows each on its own, null sources as one source."""
    return mixing.repeated(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decodes``: packed ids, and whether they read back as the text.

    A row for each row, repeated ones too; a null text has no ids.  An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", "text")
    both = bpe.encode_column(rows, public_tokenizers.path(RANKS), check="decodes")
    return both.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("byte_bpe", as_tokens),
]

#: The first stage is a trained classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
