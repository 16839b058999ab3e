"""A training corpus from raw documents: language ID, line dedup, near-duplicate removal, mixing, tokens.

Each stage gets the documents that its predecessor kept, as a table; all but the last return the columns of documents.
Columns beyond those are left behind, whatever their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import bpe, langid, line_dedup, mixing, ngram_join
from orbweave.plans.shared import drop_table, materialize, splittable_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly, with that language; without letters or on a narrow margin they go.

    So null and empty texts go, and all documents if no row has a language to learn from. Repeated rows and rows
    without doc_id are judged alike by their texts, as whole as they are long.
    """
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs)).where("NOT rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of templates that recur; what is left empty goes.

    A null or empty text that has lost no line stays. Copies of a whole text are one text here and stay for the next
    stage; rows without doc_id come first where it is decided which line of a template stays.
    """
    kept = line_dedup.drop_recurring_lines(docs.select(*COLUMNS)).where("lines_dropped = 0 OR trim(text) <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links by shared word 5-grams.

    Rows without doc_id link with nothing and all stay as documents of their own. Rows that share a doc_id are judged
    each by its own text, under a key of doc_id and text; a group's first document is that of the smallest doc_id. Of
    rows that repeat both doc_id and text, or a text without doc_id, one stays.
    """
    ngram_join.release(spark)  # what the stage before has shuffled
    docs = docs.select(*COLUMNS)
    shared = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared-ids")
    held = ngram_join.small(shared)
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(held, "doc_id", "left_anti").withColumn("key", F.col("doc_id"))
    # Keys of rows that share a doc_id: hashes, which meet no other key but by a chance of 1 in 2^64 for each pair.
    several = docs.select("doc_id", "text").join(held, "doc_id", "left_semi").withColumn("key", F.xxhash64(F.lit("key"), "doc_id", "text"))
    texts = own.select(F.col("key").alias("doc_id"), "text").unionByName(several.select(F.col("key").alias("doc_id"), "text"))
    labels = materialize(ngram_join.components(texts).select(F.col("doc_id").alias("key"), "component_id").distinct(), "components")
    again = materialize(several.select("key", "doc_id").distinct(), "shared-keys")
    named = labels.join(ngram_join.small(again), "key", "left").withColumn("doc_id", F.coalesce("doc_id", "key"))
    # Groups of one need no comparison; of the others all but the first go.
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first.key").alias("first"))
    gone = materialize(splittable_join(named, first, "component_id").where("key <> first").select("key"), "dropped-keys")
    gone = ngram_join.small(gone)
    alone = docs.where("doc_id IS NOT NULL").join(held, "doc_id", "left_anti").join(gone.withColumnRenamed("key", "doc_id"), "doc_id", "left_anti")
    kept = docs.join(held, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("key", F.xxhash64(F.lit("key"), "doc_id", "text")).join(gone, "key", "left_anti")
    return alone.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"])).unionByName(kept.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources have their target weights, in a global shuffle.

    Rows of one doc_id have one count; each row without one draws for itself. A null source counts with those that the
    weights don't name. Texts don't matter.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the hashes of the ids and of the text decoded from them.

    Every row is kept; a null text counts as empty and has no tokens.
    """
    out = bpe.encode_documents(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Language ID and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out  # reads what the stage before has written
        before, docs = docs, materialize(out, f"stage-{name}")
        drop_table(before)
