import hashlib
import itertools
import random

import numpy as np
import pytest
from cases import awkward, documents, lowered, prose

from touchline.llm import near_dedup, suffixes


def _shingles(text):
    words = lowered(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _components(rows, percent=85):
    sets = [(d, _shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(sets[a][1] & sets[b][1])
        if sets[a][1] and sets[b][1] and 100 * common >= percent * (len(sets[a][1]) + len(sets[b][1]) - common):
            root[max(find(a), find(b))] = min(find(a), find(b))
    lowest = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            lowest[find(k)] = min(lowest.get(find(k), d), d)
    return sorted(((d, len(s), lowest.get(find(k)) if s else d) for k, (d, s) in enumerate(sets)), key=str)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = awkward(rng)
    base = prose(rng, 120).split()
    for k in range(60):  # a chain and a crowd around one base
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((100 + k, " ".join(words).title() if k % 5 == 0 else " ".join(words)))
    rows += [(300 + k, prose(rng, 50)) for k in range(40)]
    got = near_dedup.near_duplicates(documents(spark, rows, extra=True))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == _components(rows)


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(4)
    base = prose(rng, 150).split()
    rows = []
    for k in range(50):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == _components(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.unique(both[:700]), np.unique(both[200:])
    one, two = (near_dedup.super_minhash(x, np.array([0, len(x)]), 512)[0] for x in (a, b))
    assert abs((one == two).mean() - 500 / 900) < 0.08


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def _removed(rows, width):
    seen = {}
    for k, (_, text) in enumerate(rows):
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            seen.setdefault(raw[i : i + width], []).append((k, i))
    cover = [np.zeros(len((t or "").encode()) + 1, dtype=int) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + width] = 1
    out = []
    for (d, t), c in zip(rows, cover, strict=True):
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        kept = raw[c[:-1] == 0].tobytes()
        out.append((d, int(c[:-1].sum()), int((np.diff(np.append(0, c)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "gram", "often"), [(200, 80, 20_000), (200, 80, 1), (40, 16, 2)])
def test_repeats_against_brute_force(spark, width, gram, often):
    rng = random.Random(5)
    rows = awkward(rng)
    passage = prose(rng, 80)
    rows += [(20 + k, prose(rng, k) + " " + passage[k : 380 - k] + " " + prose(rng, 30)) for k in range(25)]
    rows += [(60, passage + passage), (61, "ab" * 700), (62, "ab" * 300 + "c"), (63, "\x00" * 450), (64, "é" * 300)]
    _same_as_brute_force(spark, rows, width, gram, often)


def _same_as_brute_force(spark, rows, width, gram, often):
    got = suffixes.remove_repeats(documents(spark, rows, extra=True), width, gram, often)
    found = sorted(
        ((r["doc_id"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()),
        key=str,
    )
    assert found == _removed(rows, width)


RUNS = ["=" * 3_000, "-. " * 1_200, "ab" * 130, "=" * 200, "=" * 201, "x" + "-. " * 90 + "y", "é" * 400, "abcdefg " * 60 + "=" * 700]


@pytest.mark.parametrize("often", [20_000, 3])
def test_runs_and_periods_against_brute_force(spark, often):
    rows = [(k, text) for k, text in enumerate(RUNS)]
    _same_as_brute_force(spark, rows, 200, 74, often)


def test_runs_of_one_character_stay_small():
    rng = random.Random(8)
    for text in ("=" * 200_000, "-. " * 70_000, prose(rng, 30_000)):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        windows = suffixes.anchors(data, np.array([0, len(data)]))[2]
        assert windows.sum() == len(data) - suffixes.WIDTH + 1
        assert (windows + suffixes.WIDTH - 1).sum() < 5 * len(data)


def test_two_stage_order_sorts_suffixes():
    rng = random.Random(6)
    for _ in range(20):
        body = bytes(rng.choice(b"ab\x00c") for _ in range(120))
        text = np.concatenate([[0], np.frombuffer(body, dtype=np.uint8).astype(np.uint16) + 1, [0]]).astype(np.uint16)
        wanted = np.ones(len(text), dtype=bool)
        wanted[0] = False
        order = suffixes.two_stage_order(text, wanted, 60)
        key = [tuple(text[i : i + 61]) for i in order if i < 60]
        assert key == sorted(key)


def test_repeats_of_an_empty_table(spark):
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0
