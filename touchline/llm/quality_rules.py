"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; a policy is a named, versioned set of rules, so a new
policy or an ablation is bit arithmetic on the ledger and reads no text again.

Words are runs of bytes other than space and 0x09-0x0D. Defined results: null
and empty texts have no words and fail the length rule; repeated rows are judged
alike; extra columns pass through (one called like a ledger column is replaced).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaim",
]
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER = re.compile(r"[a-zß-öø-ÿ]")

# Rules in bit order; each says when a document fails.
RULES = {
    "few_words": lambda c: c("n_words") < 10,
    "repeated_words": lambda c: 100 * c("n_repeat_words") > 20 * c("n_words"),
    "short_mean_word": lambda c: c("word_chars") < 2 * c("n_words"),
    "long_mean_word": lambda c: c("word_chars") > 15 * c("n_words"),
    "symbols": lambda c: 100 * c("n_symbols") > 10 * c("n_words"),
    "repeated_lines": lambda c: 100 * c("n_dup_lines") > 30 * c("n_lines"),
    "shouting": lambda c: 100 * c("n_upper") > 30 * (c("n_upper") + c("n_lower")),
    "exclamations": lambda c: 100 * c("n_exclaim") > 10 * c("n_words"),
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base-1": BASE,
    "web-1": tuple(RULES),
}


def mask(policy: str) -> int:
    return reduce(int.__or__, (BITS[name] for name in POLICIES[policy]), 0)


def _measure(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [line for line in text.split("\n") if line.encode().split()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        edge = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(np.fromiter((found[w] > 1 for w in windows), dtype=bool, count=len(windows)))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        repeated = int((np.cumsum(edge) > 0).sum())
    return (
        n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines),
        len(_UPPER.findall(text)), len(_LOWER.findall(text)), text.count("!"),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """One column per measurement, for whole texts."""
    kept = docs.drop(*MEASURES)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [_measure(t or "") for t in part.column(text).to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *MEASURES])

    return kept.mapInArrow(run, schema)


def failures(column=F.col) -> Column:
    """The failure bits from the measurements."""
    bits = (F.when(rule(column), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items())
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with every measurement and one ``fail_bits`` value."""
    return measure(docs, text).withColumn("fail_bits", failures())


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many fail it, fail it alone, and are kept without it. One aggregation."""
    whole = mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(whole))
    sums = []
    for name in POLICIES[policy]:
        bit = BITS[name]
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.sum((bits.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias("n_failed"),
                F.sum((bits == bit).cast("long")).alias("n_failed_alone"),
                F.sum((bits.bitwiseAND(F.lit(whole & ~bit)) == 0).cast("long")).alias("n_kept_without"),
            )
        )
    return entries.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))
