import random

import corpus_pipeline
import public_tokenizers
from cases import awkward, documents, prose
from pyspark.sql import functions as F

from touchline.llm import pieces


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30)
    passage = prose(rng, 70)
    rows = awkward(rng) + [(1000 + k, prose(rng, rng.randint(30, 120))) for k in range(120)]
    rows += [(2000 + k, " | ".join(prose(rng, 40).split())) for k in range(60)]
    rows += [(3000, prose(rng, 40) + " " + item + " " + prose(rng, 40))]
    base = prose(rng, 100)
    rows += [(4000, base), (4001, base + " end"), (None, base), (4003, base.replace(" ", "\n"))]
    rows += [(5000, prose(rng, 50) + " " + passage + " " + prose(rng, 50)), (5001, prose(rng, 60) + " " + passage)]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.lit("s"))
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = [(1000 + k, 1) for k in range(120)] + [(2000 + k, 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    current, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, sf).write.parquet(f"{sf}/{k}")
        current = spark.read.parquet(f"{sf}/{k}")
        assert current.columns == docs.columns + (["ids"] if name == "encode" else [])
        seen[name] = {r["doc_id"]: r["text"] for r in current.select("doc_id", "text").collect()}
    clean = {1000 + k for k in range(120)}
    assert not any(2000 <= (d or 0) < 2060 for d in seen["quality"]) and clean <= set(seen["quality"])
    kept = set(seen["near_duplicates"])
    assert 4000 in kept and not kept & {4001, 4003} and clean <= kept
    assert base not in [t for d, t in seen["near_duplicates"].items() if d is None]
    assert all(passage[5:300] not in seen["repeated_passages"][d] for d in (5000, 5001))
    assert seen["repeated_passages"][1000] == seen["near_duplicates"][1000]
    assert 3000 not in seen["decontamination"] and clean <= set(seen["decontamination"])
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(current.withColumnRenamed("text", "given"), model).collect()
    assert all(r["text"] == r["given"] for r in back)
