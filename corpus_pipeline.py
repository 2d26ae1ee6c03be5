"""From raw documents to piece ids, in stages that each write what the next one reads.

Each stage works on everything that the one before kept. The near-duplicate stage keeps exactly one row of each group, also
of rows that repeat an id and of documents without an id; a document without an id goes if one with an id is its near copy.
Texts without words are in no group and stay. Extra columns stay, but a stage's own results take the place of columns with
their names (``spans``, ``kept`` and ``kept_text`` of the repeated passages).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.llm import decontaminate, near_dedup, pieces, ranker, suffixes
from touchline.llm.queries import PIECES, table, tokenizer
from touchline.llm.spread import keep
from touchline.session import configure, fresh_path

QUALITY = 0.3
SIMILARITY = 80


def quality(spark, docs, sf_dir):
    """Documents that the pairwise ranking does not reject."""
    model = ranker.learn(keep(ranker.featured(docs), "features"), table(spark, sf_dir, "labels"), cut=QUALITY)
    return ranker.with_quality(docs, *model, name="_score").where(F.col("_score") >= QUALITY).drop("_score")


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near copies: the smallest id, then the least hash of the text and of the whole row."""
    found = near_dedup.components_of(docs, percent=SIMILARITY).where(F.col("kept") & F.col("root").isNotNull())
    first = found.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("text_key").alias("_key"))
    kept = first.select(F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_no_id"), "_key")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Rows that are equal in everything are interchangeable, so a hash of the row is key enough.
    id_ = F.col("doc_id").cast("long")
    rows = docs.where(worded).withColumns({
        "_id": F.coalesce(id_, F.lit(0)), "_no_id": id_.isNull(), "_key": F.xxhash64("text"), "_row": F.xxhash64(*docs.columns),
    })
    order = Window.partitionBy("_id", "_no_id", "_key").orderBy("_row")
    single = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return single.join(kept, ["_id", "_no_id", "_key"], "left_semi").select(docs.columns).unionByName(docs.where(~worded))


def repeated_passages(spark, docs, sf_dir):
    """Texts without the strings of 200 bytes that occur elsewhere."""
    names = docs.columns
    found = suffixes.remove_repeats(docs)
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(names)


def decontamination(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def encode(spark, docs, sf_dir):
    """Piece ids of what is left."""
    return pieces.encode(docs, tokenizer(PIECES))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encode", encode),
]
ORACLE_SQL = None  # a trained ranking and a latent search are not SQL; the tests compare with brute force


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written in the shared folder and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
