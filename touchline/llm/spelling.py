"""Groups of spelling variants: words one edit apart, joined on asymmetric chunks.

The longer word of a pair contributes two disjoint chunks, its first and its second half; the other one contributes its
positional grams of the same lengths. One inserted, deleted or replaced letter touches one chunk only, so the other chunk is
a gram of the other word, shifted by one at most: the first half by nothing, the second half by the difference of the
lengths. Grams at other places of that range can't belong to a pair one edit apart and aren't built.

A chunk that many words share (an ending, a common stem) is split on: the half that the edit is in is halved again, and the
half of it that stays whole joins the chunk. This goes on for as long as a chunk has more than ``SHARED`` words, down to one
open letter. A chunk then holds at most as many words as there are letters, so all work follows the number of words, whatever
their distribution, and no pair is lost. Every pair is found exactly once, in the part that holds its first difference, and
confirmed by the edit distance of both words.

Words are counted with partial sums; only different words with enough occurrences are joined. The driver sees row counts.

Defined results: null and empty texts and texts without letters give no words; a null id counts as an empty one; repeated
rows count as often as they occur; of equally frequent near words the first in code-point order is the form; very long words
are words like others; an empty table gives an empty table; only id and text are read, so names of other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.spread import keep

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
SHARED = 64


def word_counts(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", slip_every: int = 0,
    least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n) of the lower-cased runs of letters.

    With ``slip_every`` one letter is taken out of the runs whose hash with the document's id is a multiple of it.
    """
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))
    lowered = F.translate("run", CAPITALS, CAPITALS.lower())
    words = docs.select(F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.select("id", lowered.alias("word"))
    if slip_every:
        drawn = words.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "word"), "utf-8")))
        at = (F.col("h") % F.length("word")).cast("int")
        rest = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = drawn.select(F.when(F.col("h") % slip_every == 0, rest).otherwise(F.col("word")).alias("word"))
    counted = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _part(word: str, start: Column, end: Column) -> Column:
    """Letters ``start`` (from 0) to ``end`` of a word."""
    return F.substring(word, start + 1, F.greatest(end - start, F.lit(0)))


def _chunked(rows: DataFrame) -> DataFrame:
    """The key of each row: length of the longer word, the open part [i, j) of it, and all that lies outside."""
    i, j, longer, own = F.col("i"), F.col("j"), F.col("length"), F.length("word")
    shift = own - longer  # 0, or -1 for the shorter word of a pair
    return rows.withColumn("key", F.xxhash64("length", "i", "j", _part("word", F.lit(0), i), _part("word", j + shift, own)))


def _halved(rows: DataFrame) -> DataFrame:
    middle = ((F.col("i") + F.col("j")) / 2).cast("int")
    parts = F.array(F.struct(F.col("i").alias("i"), middle.alias("j")), F.struct(middle.alias("i"), F.col("j").alias("j")))
    return rows.select("word", "n", "length", "long", F.explode(parts).alias("p")).select("word", "n", "length", "long", "p.i", "p.j")


def near_pairs(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of words at an edit distance of one, once; ``a`` is the longer or the first."""
    size = F.length("word")
    roles = F.explode(F.array(F.struct(size.alias("length"), F.lit(True).alias("long")), F.struct((size + 1).alias("length"), F.lit(False).alias("long"))))
    whole = words.where(size > 0).select("word", "n", roles.alias("r")).select("word", "n", "r.length", "r.long", F.lit(0).alias("i"), F.col("r.length").alias("j"))
    rows, found = _halved(whole), []
    while True:
        keyed = _chunked(rows)
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("long").alias("n_long"))
        partners = counts.where("n_rows > 1 and n_long > 0").select("key", (F.col("n_rows") > shared).alias("many"))
        marked = keep(keyed.join(partners, "key"), "spelling-chunks")
        open_ = F.col("many") & (F.col("j") - F.col("i") > 1)
        found.append(_pairs(marked.where(~open_)))
        split = marked.where(open_)
        if split.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = _halved(split)


def _pairs(marked: DataFrame) -> DataFrame:
    names = ("key", "length", "i", "j")
    a = marked.where("long").select(*names, F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = marked.select("key", *(F.col(c).alias(f"_{c}") for c in names[1:]), F.col("long").alias("_long"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    i, j = F.col("i"), F.col("j")
    # The first difference lies in the open part: what is before it is equal (the key says so), what ends with it is not.
    first = _part("a", F.lit(0), j) != _part("b", F.lit(0), j)
    same = (F.col("length") == F.col("_length")) & (i == F.col("_i")) & (j == F.col("_j"))
    once = ~F.col("_long") | (F.col("a") < F.col("b"))
    equal = (_part("a", F.lit(0), i) == _part("b", F.lit(0), i)) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(same & once & first & equal).select("a", "a_n", "b", "b_n")


def spelling_variants(words: DataFrame, ratio: int = RATIO, shared: int = SHARED) -> DataFrame:
    """word, n, n_near, form (the most frequent near word, if ``ratio`` times as frequent), form_n and root.

    Forms are followed to the last one by doubling; counts at least double on the way, so a few rounds are enough.
    """
    words = keep(words, "spelling-words")
    pairs = near_pairs(words, shared)
    both = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    ))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    follows = -F.col("best.less") >= ratio * F.col("n")
    formed = keep(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    reached = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        following = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = keep(step, "spelling-roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return formed.join(reached, "word", "left").withColumn("root", F.coalesce("root", "word"))
