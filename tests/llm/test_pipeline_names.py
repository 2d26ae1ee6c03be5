"""The stages on texts take empty tables and extra columns whose names they use themselves."""

import random

import corpus_pipeline
import pytest
from cases import documents, prose
from pyspark.sql import functions as F


@pytest.mark.parametrize("empty", [False, True])
def test_near_duplicates_and_passages_keep_other_columns(spark, tmp_path, empty):
    rng = random.Random(61)
    rows = [] if empty else [(k, prose(rng, 40)) for k in range(6)] + [(9, None), (None, "")]
    docs = documents(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("spans", "kept_text", "matches", "ids"):
        docs = docs.withColumn(name, F.lit("own"))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) == len(rows) and all(r["matches"] == r["ids"] == "own" for r in found)
        if stage is corpus_pipeline.near_duplicates:
            assert all(r["spans"] == r["kept_text"] == "own" for r in found)
        else:  # the operator's own results take the place of columns with their names
            assert all(r["spans"] == [] and r["kept_text"] == r["text"] for r in found)
