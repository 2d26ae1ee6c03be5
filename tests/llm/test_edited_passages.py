"""Edited passages against a search that tries every window."""

import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, prose

from touchline.llm import decontaminate as d
from touchline.llm.words import hashed_words, text_bytes


def _hashes(texts):
    return hashed_words(*text_bytes(pa.array(texts, pa.string())))


def _edited(rng, text, step):
    words = text.split()
    for k in range(step - 1, len(words), step):
        words[k] = prose(rng, 1) + "x"
    return " ".join(words)


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("step", [5, 6, 7, 8])
def test_every_few_words_changed(spark, step):
    rng = random.Random(30 + step)
    items = [(k, prose(rng, rng.randint(15, 50))) for k in range(40)]
    rows, want = [(1000 + k, prose(rng, rng.randint(30, 300))) for k in range(80)], {}
    for k, text in items:
        passage = _edited(rng, text, step)
        rows.append((2000 + k, prose(rng, rng.randint(0, 40)) + " " + passage + " " + prose(rng, 30)))
        if _longest(text.lower().split(), passage.lower().split()) >= d.COMMON * len(text.split()):
            want[2000 + k] = [k]
    assert len(want) >= 30
    found = d.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in found.collect() if r["contaminated"]}
    assert {k: v for k, v in got.items() if k in want} == want and not any(k < 2000 for k in got)


@pytest.mark.parametrize("span", [d.RANGE, 50])
def test_equals_all_windows_and_words_around(monkeypatch, span):
    monkeypatch.setattr(d, "RANGE", span)
    rng = random.Random(40)
    texts = [prose(rng, n) for n in (1, 3, 6, 7, 9, 14, 15, 22, 40)]
    docs = ["", *texts, *(prose(rng, 100) for _ in range(10))]
    docs += [prose(rng, 12) + " " + _edited(rng, t, s) + " " + prose(rng, 9) for t in texts[3:] for s in (2, 3, 4, 5)]
    docs += [" ".join(t.split()[: len(t.split()) // 3] + prose(rng, 6).split() + t.split()[len(t.split()) // 2 :]) for t in texts[4:]]
    projection = np.random.default_rng(3).standard_normal((d.TERMS, d.RANK + d.REST)).astype(np.float32)
    items = d.Items(list(range(len(texts))), texts, projection)
    hashes, at = _hashes(docs)
    got = [{k: m["common"] for k, m in x.items()} for x in items.search(hashes, at)]
    want = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        best = {}
        for item, own in enumerate(items.words):
            width = min(d.WINDOW, len(own))
            if high - low < width:
                continue
            near = d._windows(projection[d._terms(hashes[low:high])], width) @ d._windows(projection[d._terms(np.array(own, np.uint64))], width).T
            for word, place in zip(*np.nonzero(near >= d.COSINE), strict=True):
                begin, slack = low + int(word) - int(place), max(4, len(own) // 4)
                around = hashes[max(low, begin - slack) : min(high, begin + len(own) + slack)].tolist()
                share, answer = _longest(own, around) / len(own), items.answers[item]
                if share >= d.COMMON or (share >= d.PARAPHRASE and _longest(answer, around) == len(answer)):
                    best[item] = max(share, best.get(item, 0))
        want.append(best)
    assert got == want and sum(map(len, want)) > 20
