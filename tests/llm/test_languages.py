"""Languages against a plain version of the vectors and the nearest centroid, and by held-out accuracy."""

import math
import random
import unicodedata
import zlib

import numpy as np
from cases import awkward, documents
from pyspark.sql import functions as F

from touchline.llm import languages
from touchline.llm.queries import QUERIES, table

ALPHABETS = {"aa": "abcdefgh", "bb": "ghijklm", "cc": "αβγδεζ", "dd": "абвгде"}


def sentence(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))).capitalize() for _ in range(n))


def labelled(spark, rng, n=120):
    rows = [(k, sentence(rng, ALPHABETS[name], rng.randint(3, 60)), name) for k, name in enumerate(sorted(ALPHABETS) * n)]
    rows += [(None, "null id", "aa"), (9001, None, "bb"), (9002, "12 34", "cc"), (9003, "no label", None), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def mixed(gram):
    h = len(gram)
    for c in gram:
        h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x85EBCA77 & 0xFFFFFFFF) >> 20


def plain_vector(text, idf):
    points = [0]
    for c in text:
        small = c.lower() if unicodedata.category(c)[0] in "LM" else ""
        points.append(ord(small if len(small) == 1 else c) if small else 0)
    points.append(0)
    counts = {}
    for k in languages.SIZES:
        for i in range(len(points) - 1 if k < 3 else len(points) - k + 1):
            gram = points[i : i + k]
            if len(gram) == k and any(gram) and all(gram[1:-1]):
                place = mixed(gram)
                counts[place] = counts.get(place, 0) + 1
    weights = {p: math.log1p(c) * float(idf[p]) for p, c in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {p: w / length for p, w in weights.items()}


def test_predictions_equal_a_plain_nearest_centroid(spark):
    rng = random.Random(12)
    model = languages.learn(labelled(spark, rng).repartition(3))
    assert model.languages == sorted(ALPHABETS)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and (np.diff(model.owner) >= 0).all()
    rows = awkward(rng) + [(20, "ß İ ǅ"), (21, "été"), (22, "a"), (23, "word1word"), (24, "x" * 3_000_000), (25, "ab " * 1_200_000)]
    rows += [(100 + k, sentence(rng, rng.choice(list(ALPHABETS.values())), 12)) for k in range(40)]
    found = {(r.doc_id, r.text): r for r in languages.identify(documents(spark, rows, extra=True), model).collect()}
    assert len(found) == len(set(rows))
    for id_, text in rows:
        got = found[id_, text]
        assert got.kept == "own"
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (got.lang_pred, got.lang_score, got.lang_rejected) == ("und", 0.0, False)
            continue
        vector = plain_vector(text, model.idf)
        cosines = [sum(w * float(c[p]) for p, w in vector.items()) for c in model.centroids]
        best = max(cosines)
        assert abs(got.lang_score - best) < 1e-4
        assert got.lang_pred in {model.languages[model.owner[k]] for k, c in enumerate(cosines) if c > best - 1e-4}


def test_rejects_texts_far_from_all_centroids(spark):
    model = languages.learn(labelled(spark, random.Random(3)))
    rows = [(1, "qqzz xxww zzqq wxyq qzwx"), (2, sentence(random.Random(4), ALPHABETS["aa"], 30))]
    found = languages.identify(documents(spark, rows), model).orderBy("doc_id").collect()
    assert [r.lang_rejected for r in found] == [True, False]
    assert [r.lang_pred for r in languages.identify(documents(spark, rows), model, reject=True).orderBy("doc_id").collect()] == ["und", "aa"]


def test_partitions_don_t_change_the_model(spark):
    docs = labelled(spark, random.Random(8))
    one, many = languages.learn(docs.repartition(1)), languages.learn(docs.repartition(7))
    assert np.array_equal(one.idf, many.idf)
    assert np.allclose(one.centroids, many.centroids, atol=1e-4)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert languages.learn(nothing) is None
    assert languages.learn(spark.createDataFrame([(1, "12", "aa"), (2, None, "aa")], nothing.schema)) is None
    found = languages.identify(documents(spark, [(1, "some text"), (2, None)]), None).collect()
    assert [(r.lang_pred, r.lang_score) for r in found] == [("und", 0.0)] * 2
    assert languages.identify(documents(spark, []), None).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op12_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out and r.lang is not None]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_the_language_of_a_row_is_not_read_for_its_prediction(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs.withColumn("lang", F.when(~out, F.col("lang"))).withColumn("source", F.lit(None).cast("string")).write.parquet(str(tmp_path / "b/documents.parquet"))
    a, b = (sorted(tuple(r) for r in QUERIES["op12_language_id"](spark, str(tmp_path / x)).select("doc_id", "lang_pred").collect()) for x in "ab")
    assert a == b
