import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, documents, lowered, prose

from touchline.llm import attention, decontaminate, packing, ranker, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _labels(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def _out(doc_id, parts=5, remainder=0):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % parts == remainder


def test_quality_on_held_out_documents(spark):
    rng = random.Random(11)
    rows, labels = awkward(rng), []
    for k in range(100, 500):
        bad = k % 4 == 0
        text = prose(rng, rng.randint(20, 120))
        rows.append((k, " | ".join(text.split()) if bad and k % 8 else " ".join([text.split()[0]] * 90) if bad else text))
        labels.append((k, int(not bad)))
    labels += [(100, 0), (100, 1), (None, 1), (101, None), (9999, 1)]
    got = {r["doc_id"]: r for r in ranker.rank_quality(documents(spark, rows, extra=True), _labels(spark, labels, "quality")).collect()}
    assert len(got) == len({d for d, _ in rows})
    tested = [(got[k]["predicted"], int(k % 4 != 0)) for k in range(100, 500) if _out(k)]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested) > 40
    assert all(0 <= r["score"] <= 1 and r["held_out"] == _out(d) and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(12)
    rows, labels = awkward(rng), []
    for k in range(100, 900):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic = k % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Wretched", "vileness", "vilely", "scumbag"]))
        rows.append((k, " ".join(words)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(toxic)))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(documents(spark, rows, extra=True), _labels(spark, labels, "toxic")).collect()}
    tested = [(got[k]["predicted"], int(k % 5 == 0)) for k in range(100, 900) if _out(k)]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested) > 100
    assert 0 <= got[2]["score"] < 0.5 and got[1]["score"] == got[2]["score"]


@pytest.mark.parametrize("with_labels", [True, False])
def test_no_documents_or_no_labels(spark, with_labels):
    docs = documents(spark, [] if with_labels else [(1, "a b"), (None, None)])
    rows = [(1, 1)] if with_labels else []
    assert ranker.rank_quality(docs, _labels(spark, rows, "quality")).count() == docs.count()
    scores = toxicity.score_toxicity(docs, _labels(spark, rows, "toxic")).collect()
    assert [r["predicted"] for r in scores] == [0] * docs.count()


def test_the_corrected_risk_is_not_fooled_by_unlabelled_positives():
    rng = np.random.default_rng(1)
    positive = (rng.random((200, 20)) < np.r_[np.full(10, 0.5), np.full(10, 0.1)]).astype(np.float32)
    hidden = (rng.random((100, 20)) < np.r_[np.full(10, 0.5), np.full(10, 0.1)]).astype(np.float32)
    negative = (rng.random((300, 20)) < np.r_[np.full(10, 0.02), np.full(10, 0.1)]).astype(np.float32)
    w, b = toxicity.fit(positive, np.vstack([hidden, negative]), 0.25)
    assert (hidden @ w + b > 0).mean() >= 0.85 and (negative @ w + b > 0).mean() < 0.1


def test_benchmark_passages_and_paraphrases(spark):
    rng = random.Random(13)
    items = [(k, prose(rng, rng.randint(15, 50))) for k in range(30)] + [(90, None), (91, ""), (None, "x y z"), (92, prose(rng, 9)), (93, prose(rng, 4))]
    rows = awkward(rng) + [(1000 + k, prose(rng, rng.randint(30, 400))) for k in range(150)]
    want = {}
    for k, text in items:
        if k is not None and text:
            words = text.split()
            if len(words) > 30:
                words[len(words) // 2] = "changed"
            rows.append((2000 + k, prose(rng, rng.randint(0, 50)) + " " + " ".join(words) + "\n" + prose(rng, 40)))
            want[2000 + k] = [k]
    docs = documents(spark, rows, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench, block_items=12)
    assert found.columns == [*[c for c in docs.columns if c != "matches"], "matches", "contaminated"]
    got = {r["doc_id"]: sorted(m["item_id"] for m in r["matches"]) for r in found.collect() if r["contaminated"]}
    assert got == want
    assert decontaminate.find_leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0


def test_common_words_against_the_table():
    rng = random.Random(14)
    for _ in range(50):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_words(a, b) == table[-1][-1]


def test_gradients_against_differences():
    counts = np.arange(1, 301)[::-1].astype(float)
    model = attention.Model(counts)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, alone, targets, weight, _ = attention.blocks([[1, 2, 3, 250], list(range(100))], 0)
    _, g = model.gradients(ids, alone, targets, weight)
    rng = np.random.default_rng(2)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        at = int(rng.integers(len(flat))) if name != "embed" else 2 * attention.WIDTH + 3
        kept, size = flat[at], 1e-5
        flat[at] = kept + size
        up, _ = model.gradients(ids, alone, targets, weight)
        flat[at] = kept - size
        down, _ = model.gradients(ids, alone, targets, weight)
        flat[at] = kept
        assert g[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * size), abs=1e-5), name


def test_short_cuts_equal_the_plain_forward_pass():
    model = attention.Model(np.ones(200))
    ids, alone, targets, *_ = attention.blocks([list(range(150)), [3] * 70], 0)
    top = model.forward(ids, alone)[-1]
    np.testing.assert_allclose(model.hidden(ids, alone), top, rtol=1e-4, atol=1e-5)
    classes = model.classes[targets.reshape(-1)]
    plain = model.log_probabilities(top)[np.arange(len(classes)), classes]
    np.testing.assert_allclose(model.class_logs(top, classes), plain, rtol=1e-4, atol=1e-5)
    model.p["out"] = model.p["out"] * 1000  # rows on very different scales
    plain = model.log_probabilities(top)[np.arange(len(classes)), classes]
    np.testing.assert_allclose(model.class_logs(top, classes), plain, rtol=1e-4, atol=1e-2)


def test_windows_score_each_id_once_and_causally():
    model = attention.Model(np.ones(50))
    texts = [[], [5], list(range(1, 40)), [7] * 200]
    together = model.score(texts, 0)
    alone = [model.score([t], 0)[0] for t in texts]
    np.testing.assert_allclose(together, alone, rtol=1e-5)
    *_, weight, owner = attention.blocks(texts, 0)
    assert [int(weight[owner == k].sum()) for k in range(4)] == [len(t) + 1 for t in texts]
    first, second = (model.score([x], 0)[0] for x in ([1, 2, 3, 4], [1, 2, 3, 9]))
    shared = model.score([[1, 2, 3]], 0)[0]
    assert first < 0 and second < 0 and shared < 0
    # the chances of all possible next ids add up to one
    top = model.forward(*attention.blocks([[1, 2]], 0)[:2])[-1]
    logs = model.log_probabilities(top)[2]
    assert np.exp(logs[model.classes] + model.within).sum() == pytest.approx(1, abs=1e-4)


def test_counts_and_scores_of_whole_texts(spark):
    rng = random.Random(15)
    rows = awkward(rng) + [(100 + k, prose(rng, rng.randint(5, 200))) for k in range(60)]
    out = attention.score_texts(documents(spark, rows, extra=True), RANKS, public_tokenizers.PATTERN, most_documents=40, frequent=50)
    counts = Counter()
    for d, t in rows:
        if not _out(d, 7, 2):
            counts.update([*lowered(t), "\0end"])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), _out(d, 7, 2), len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 5))
        for d, w in ((d, [*lowered(t), "\0end"]) for d, t in rows)
    )
    got = out.collect()
    assert sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got
    ) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_training_lowers_the_loss():
    encoding, end = packing.ranks_encoding(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(16)
    texts = [attention.subwords(prose(rng, 150), encoding) for _ in range(60)]
    counts = np.bincount([i for t in texts for i in t], minlength=end + 1)
    model = attention.Model(counts)
    held = attention.subwords(prose(rng, 300), encoding)
    before = model.score([held], end)[0]
    model.train(*attention.blocks(texts, end)[:4], steps=120)
    assert model.score([held], end)[0] > before + 20


def test_scores_of_an_empty_table(spark):
    assert attention.score_texts(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
