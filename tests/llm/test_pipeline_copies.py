"""One row of each group of copies keeps its text, whatever the ids."""

import random

import corpus_pipeline
from cases import documents, prose
from pyspark.sql import functions as F


def test_one_copy_keeps_its_text_after_repeated_passages(spark, tmp_path):
    rng = random.Random(60)
    twice, hot, nameless, same_id, clean = (prose(rng, 100) for _ in range(5))
    rows = [(1, twice), (1, twice)] + [(2, hot)] * 30 + [(None, nameless)] * 2 + [(None, nameless + " end")]
    rows += [(3, same_id), (3, same_id + " end"), (4, clean), (None, prose(rng, 60)), (5, ""), (5, ""), (6, None), (None, " \n")]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id()))
    docs.write.parquet(f"{tmp_path}/in")
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), str(tmp_path))
    assert kept.columns == docs.columns
    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    out = corpus_pipeline.repeated_passages(spark, kept, str(tmp_path)).collect()
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in out if (r["text"] or "").strip())
    assert [d for d, _ in texts] == [0, 0, 1, 2, 3, 4]
    assert {t.removesuffix(" end") for _, t in texts} >= {twice, hot, nameless, same_id, clean}
    assert sum(not (r["text"] or "").strip() for r in out) == 4  # texts without words are in no group
