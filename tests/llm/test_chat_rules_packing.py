import itertools
import random

import numpy as np
import public_tokenizers
from cases import awkward, documents, prose

from touchline.llm import chat, packing, quality_rules


def _cheapest(roles):
    """Least cost over every choice of options."""
    best = {0: 0}
    for role in roles:
        following = {}
        for state, cost in best.items():
            for more, _, _, to in chat.options(role, state):
                following[to] = min(following.get(to, 10**9), cost + more)
        best = following
    return min(cost + int(chat.FINAL[state]) for state, cost in best.items())


def _legal(rendered):
    roles = [line[2:-2] for line in rendered.split("\n") if line.startswith("<|") and line != "<|end|>"]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and len(roles) % 2 == 0 and roles


def test_repairs_are_legal_and_cheapest(spark):
    rng = random.Random(7)
    names = ["system", "user", "assistant", None, "tool", " USER "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(names), rng.choice(["hi", "", None, "x <|user|> y"])))
    rows += [(None, 0, "user", "n"), (500, None, "assistant", "z"), (500, 1, "user", "a"), (500, 1, "user", "a")]
    rows += [(900, k, names[k % 3], f"t{k}") for k in range(400)]  # one conversation over several slices
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).toPandas()
    assert len(got) == len(rows)
    number = {"system": 1, "user": 2, "assistant": 3}
    for conv, part in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]),)), key=lambda r: r[0]):
        part = sorted(part, key=lambda r: (r[1] is not None, r[1] or 0, number.get((r[2] or "").strip().lower(), 0)))
        own = got[got.conv_id.isna()] if conv is None else got[got.conv_id == conv]
        own = own.sort_values("place")
        assert own.cost.sum() == _cheapest([number.get((r[2] or "").strip().lower(), 0) for r in part]), conv
        assert _legal("".join(own.rendered)), conv


def test_chats_of_an_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ledger_measures_and_ablations(spark):
    rng = random.Random(8)
    rows = awkward(rng) + [(50, "x y z v w " * 40), (51, "SHOUT!! " * 3 + prose(rng, 5)), (52, "same line\n" * 30), (53, "a | b | c # " * 20)]
    entries = quality_rules.ledger(documents(spark, rows, extra=True)).cache()
    by = {r["doc_id"]: r for r in entries.collect()}
    assert (by[50]["n_words"], by[50]["n_repeat_words"]) == (200, 200)
    assert by[52]["n_dup_lines"] == 29 and by[1]["n_words"] == by[2]["n_words"] == 0
    assert by[9]["word_chars"] == sum(len(w) for w in "é😀 ▁x \x00 ñ".split(" "))
    bits, policy = quality_rules.BITS, quality_rules.mask("web-1")
    for r in quality_rules.ablations(entries, "web-1").collect():
        mine = [e["fail_bits"] & policy for e in entries.collect()]
        bit = bits[r["rule"]]
        assert r["n_failed"] == sum(b & bit != 0 for b in mine)
        assert r["n_failed_alone"] == sum(b == bit for b in mine)
        assert r["n_kept_without"] == sum(b & ~bit == 0 for b in mine)
    assert quality_rules.ledger(documents(spark, [])).count() == 0


def test_packing_is_lossless_and_best_fit(spark):
    rng = random.Random(9)
    rows = awkward(rng) + [(100 + k, prose(rng, rng.randint(1, 300))) for k in range(80)]
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    packed = packing.pack(documents(spark, rows, extra=True), ranks, public_tokenizers.PATTERN, row_ids=128, window_ids=4000).cache()
    encoding, end = packing.ranks_encoding(ranks, public_tokenizers.PATTERN)
    want = sorted((str(d), np.array([*(encoding.encode_ordinary(t) if t else ()), end], dtype="<u2").tobytes().hex().upper()) for d, t in rows)
    got = sorted((str(r["doc_id"]), r["ids_hex"]) for r in packing.unpack(packed, 128).collect())
    assert got == want
    for r in packed.collect():
        assert len(r["ids"]) == len(r["positions"]) == 256 and r["cu_seqlens"][-1] == r["n_ids"] <= 128
        places = np.frombuffer(r["positions"], dtype="<u2")
        for a, b in itertools.pairwise(r["cu_seqlens"]):
            assert places[a:b].tolist() == list(range(b - a))
    assert packing.pack(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_segment_tree_finds_the_tightest_row():
    rng = random.Random(10)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    rows, open_rows = packing.best_fit(lengths, 64), []
    for item in sorted(range(300), key=lambda i: -lengths[i]):
        fitting = [room for room in open_rows if room >= lengths[item]]
        room = min(fitting, default=64)
        if fitting:
            open_rows.remove(room)
        open_rows.append(room - lengths[item])
    assert sorted(64 - sum(lengths[i] for i in row) for row in rows) == sorted(open_rows)
    assert sorted(i for row in rows for i in row) == list(range(300))
