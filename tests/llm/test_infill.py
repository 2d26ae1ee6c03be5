"""Infilling against plain slices of code points, words and lines, and the wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import awkward, documents, prose

from touchline.llm import infill
from touchline.llm.wavelet import WaveletMatrix


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_rank_select_and_bisection_equal_counting(size):
    rng = np.random.default_rng(size)
    symbols = rng.integers(0, 6, size).astype(np.uint8)
    matrix, at = WaveletMatrix(symbols, 3), np.arange(size + 1)
    for s in range(8):
        before = np.concatenate([[0], np.cumsum(symbols == s)])
        assert (matrix.rank(s, at) == before).all()
        places = np.flatnonzero(symbols == s)
        assert (matrix.select(s, np.arange(len(places))) == places).all()
    for some in [(1, 2, 3), (0,), (0, 1, 2, 3, 4, 5), ()]:
        before = np.concatenate([[0], np.cumsum(np.isin(symbols, some))])
        assert (matrix.ranks(some, at) == before).all()
        wanted = np.arange(before[-1] + 2)
        found = matrix.bisect(some, np.zeros_like(wanted), np.full_like(wanted, size), wanted)
        assert found.tolist() == [next((p for p in range(size + 1) if before[p] >= w), size) for w in wanted]


def pieces(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    blank = text[: len(text) - sum(map(len, words))]
    return [blank + words[0], *words[1:]] if words else [blank] if blank else []


def brute(id_, text, unit="char"):
    text = text or ""
    digest = hashlib.sha256(b"1:" + (b"" if id_ is None else str(id_).encode())).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = pieces(text, unit)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_outputs_equal_plain_slices(spark, unit):
    rng = random.Random(11)
    rows = awkward(rng) + [
        (11, "x<P>y"), (12, "<S"), (13, "<M> z"), (14, "\n\n\n"), (15, "a\nb\n"), (16, " \n lead"), (17, "é" * 90_000 + " ü\n" * 50_000),
        (18, "  "), (19, "<P"), (20, "😀́<"), (21, "  word"),
    ] + [(100 + k, prose(rng, rng.randint(1, 40)) + "\n" * rng.randint(0, 2) + "ñ😀 é") for k in range(300)]
    made = infill.fill_in_middle(documents(spark, rows, extra=True).repartition(3), unit)
    found = made.withColumn("back", infill.restore()).collect()
    assert sorted(map(repr, (
        (r.doc_id, r.text, r.fim_units, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_output, r.back, r.kept) for r in found
    ))) == sorted(map(repr, ((i, t, *brute(i, t, unit), t or "", "own") for i, t in rows)))
    assert {"plain", "psm", "spm"} == {r.fim_form for r in found}


def test_new_columns_replace_and_empty_tables_stay(spark):
    rows = [(1, "one two"), (2, None)]
    again = infill.fill_in_middle(infill.fill_in_middle(documents(spark, rows)))
    assert again.columns == ["doc_id", "text", *infill.COLUMNS]
    assert [tuple(r)[2:] for r in again.orderBy("doc_id").collect()] == [brute(i, t) for i, t in rows]
    assert infill.fill_in_middle(documents(spark, [])).collect() == []


def test_shares_of_forms(spark):
    rows = [(k, "some words here") for k in range(4000)]
    forms = [r.fim_form for r in infill.fill_in_middle(documents(spark, rows)).collect()]
    assert abs(forms.count("plain") / 4000 - 0.1) < 0.02 and abs(forms.count("spm") / 4000 - 0.18) < 0.03
