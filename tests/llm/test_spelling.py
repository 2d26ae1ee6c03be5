"""Spelling groups against all pairs of words, counted and compared in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from cases import awkward, documents, prose

from touchline.llm import spelling
from touchline.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute_counts(rows, every=97):
    counts = Counter()
    for id_, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [n, len(others)]
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (w, forms[w], root, *out[w], counts.get(forms[w]))
    return sorted(map(repr, out.values()))


def corpus(rng):
    stems = ["straße", "naïveté", "colour", "ÉCOLE", "running", "aaaaa", "aaaaaa", "abab" * 3, "müller", "a×b÷cd"]
    words = []
    for stem in stems:
        for _ in range(25):
            w = list(stem)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(at, rng.choice("abxé"))
                elif kind == 1 and len(w) > 1:
                    del w[at]
                else:
                    w[at] = rng.choice("abxé")
            words += ["".join(w)] * rng.randint(1, 12)
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40]) + " " + prose(rng, 200)) for k in range(40)]
    return rows + awkward(rng) + [(None, "x" * 30_000 + " " + "x" * 29_999), (77, ("y" * 20_000 + "-") * 3 + ("y" * 20_001 + "-") * 7)]


@pytest.mark.parametrize("shared", [2, 64])
def test_groups_equal_all_pairs(spark, shared):
    rows = corpus(random.Random(13))
    counts = brute_counts(rows)
    assert len(counts) > 150
    words = spelling.word_counts(documents(spark, rows, extra=True).repartition(5), slip_every=97)
    assert {r.word: r.n for r in words.collect()} == counts
    found = spelling.spelling_variants(words, shared=shared).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(counts)


def test_every_pair_is_found_once_when_a_chunk_is_shared(spark):
    # One stem and one ending for all words: both chunks are shared by everything, so all halves are split on.
    rng = random.Random(5)
    words = {"common" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 7))) + "ending" for _ in range(400)}
    table = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    found = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(table, shared=4).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_work_follows_the_number_of_words(spark):
    # Candidates of a shared stem, before the edit distance is looked at, at four times the words.
    def candidates(n):
        words = [("stemstem" + format(k * 2654435761 % 2**32, "08x"), 3) for k in range(n)]
        rows = spelling._chunked(spelling._halved(spark.createDataFrame(
            [(w, c, len(w) + d, not d, 0, len(w) + d) for w, c in words for d in (0, 1)], "word string, n long, length int, long boolean, i int, j int"
        )))
        total = 0
        while True:
            sizes = rows.groupBy("key").count()
            small = rows.join(sizes, "key").where(f"count <= {spelling.SHARED} or j - i = 1").select("key", "count").distinct()
            total += sum(r["count"] ** 2 for r in small.collect())
            rows = rows.join(sizes, "key").where(f"count > {spelling.SHARED} and j - i > 1").drop("count")
            if rows.isEmpty():
                return total
            rows = spelling._chunked(spelling._halved(rows))

    assert candidates(8000) < 8 * candidates(2000)


def test_query_on_a_table(spark, tmp_path):
    rows = corpus(random.Random(31))
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(brute_counts(rows))


def test_empty_table(spark):
    words = spelling.word_counts(documents(spark, []))
    assert spelling.spelling_variants(words).collect() == []
    assert spelling.word_counts(documents(spark, [(1, None), (2, "")]), least_count=1).collect() == []
