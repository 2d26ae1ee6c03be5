"""The training-data operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    attention, chat, decontaminate, infill, languages, near_dedup, packing, pieces, quality_rules, ranker, spelling, suffixes, toxicity,
)
from touchline.session import configure

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op1_sentencepiece")
def sentencepiece_ids(spark, sf):
    """Ids of every text, and whether they decode to it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = tokenizer(PIECES)
    coded = pieces.decode(pieces.encode(docs, model).withColumnRenamed("text", "given"), model)
    return coded.select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), F.col("text").eqNullSafe(F.col("given")).alias("restored")
    )


OP5_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    row_number() over () as rid
  from documents),
lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from w)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
wins as (
  select rid, i, array_to_string(words[i:i + 4], ' ') as win
  from (select rid, words, unnest(range(1, len(words) - 3)) as i from w)),
marked as (select rid, i, count(*) over (partition by rid, win) as n from wins),
covered as (
  select rid, count(distinct i + k) as n_repeat_words
  from (select rid, i, unnest([0, 1, 2, 3, 4]) as k from marked where n > 1) group by rid),
m as (
  select doc_id, len(words) as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    len(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) as n_upper,
    len(regexp_replace(text, '[^a-zß-öø-ÿ]', '', 'g')) as n_lower,
    len(regexp_replace(text, '[^!]', '', 'g')) as n_exclaim
  from w left join lines using (rid) left join covered using (rid)),
b as (
  select *, (n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint
    + 4 * (word_chars < 2 * n_words)::bigint + 8 * (word_chars > 15 * n_words)::bigint
    + 16 * (100 * n_symbols > 10 * n_words)::bigint + 32 * (100 * n_dup_lines > 30 * n_lines)::bigint
    + 64 * (100 * n_upper > 30 * (n_upper + n_lower))::bigint + 128 * (100 * n_exclaim > 10 * n_words)::bigint as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed,
  fail_bits = 0 as kept, fail_bits
from b
"""


@query("op5_quality_rules", OP5_SQL)
def quality_ledger(spark, sf):
    """The rule ledger of every text with the verdict of the web policy."""
    entries = quality_rules.ledger(table(spark, sf, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.verdict("base-1")).alias("base_failed"), quality_rules.verdict("web-1").alias("kept"), "fail_bits",
    )


@query("op9_packing")
def packed_rows(spark, sf):
    """Every text as token ids, packed."""
    import public_tokenizers

    return packing.pack(table(spark, sf, "documents"), tokenizer(RANKS), public_tokenizers.PATTERN)


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') as words from documents),
s as (
  select distinct doc_id, shingle from (
    select doc_id, unnest(case when len(words) >= 5
      then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w)),
n as (select doc_id, count(*) as n from s group by 1),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, to_id) as (
  select doc_id, doc_id from documents union select r.doc_id, w.b from reach r join ways w on w.a = r.to_id),
least_id as (select doc_id, min(to_id) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n on n.doc_id = d.doc_id join least_id l on l.doc_id = d.doc_id
"""


@query("op6_near_dedup", OP6_SQL)
def near_duplicate_groups(spark, sf):
    """Component of near copies of every document."""
    return near_dedup.near_duplicates(table(spark, sf, "documents"), percent=85).drop("text_key")


OP3_SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
windows as (
  select doc_id, i, md5(substr(hx, 2 * i + 1, 400)) as h
  from (select doc_id, hx, unnest(range(0, greatest(n_bytes - 199, 0))) as i from t)),
again as (select doc_id, i from (select *, count(*) over (partition by h) as c from windows) where c > 1),
marked as (
  select *, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end as fresh from again),
runs as (
  select doc_id, min(i) as a, max(i) + 200 as b from (
    select *, sum(fresh) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
edges as (
  select doc_id, 0 as place, 0 as kind from t union all select doc_id, b, 0 from runs
  union all select doc_id, a, 1 from runs union all select doc_id, n_bytes, 1 from t),
pieces as (
  select doc_id, place as a, lead(place) over (partition by doc_id order by place, kind) as b, kind from edges),
kept as (
  select p.doc_id, string_agg(substr(hx, 2 * a + 1, 2 * (b - a)), '' order by a) as hx
  from pieces p join t on t.doc_id = p.doc_id where kind = 0 group by 1),
gone as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from runs group by 1)
select t.doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept.hx, ''))) as kept_sha256
from t left join gone on gone.doc_id = t.doc_id left join kept on kept.doc_id = t.doc_id
"""


@query("op3_suffix_dedup", OP3_SQL)
def repeated_passages(spark, sf):
    """What is left of every text without the strings of 200 bytes that occur elsewhere."""
    docs = suffixes.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_toxicity")
def toxicity_scores(spark, sf):
    """Toxicity of every text."""
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_quality_ranker")
def quality_scores(spark, sf):
    """Quality of every text."""
    return ranker.rank_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_chat_format")
def repaired_chats(spark, sf):
    """Every turn with its repair and its piece of the rendered conversation."""
    return chat.format_chats(table(spark, sf, "conversations"))


@query("op7_decontaminate")
def benchmark_leaks(spark, sf):
    """Benchmark items found in every text."""
    found = decontaminate.find_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "contaminated", F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"),
        F.array_max("matches.common").alias("common"),
    )


@query("op10_attention_scores")
def language_model_scores(spark, sf):
    """Word-count and attention-model log10 probability of every text."""
    import public_tokenizers

    return attention.score_texts(table(spark, sf, "documents"), tokenizer(RANKS), public_tokenizers.PATTERN)


OP11_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents),
u as (
  select doc_id, text, length(text)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (
  select *, substring(text, 1, a) as x, substring(text, a + 1, b - a) as y, substring(text, b + 1, n - b) as z from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y when 'spm' then '<S>' || z || '<P>' || x || '<M>' || y
    else text end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


@query("op11_fill_in_middle", OP11_SQL)
def rearranged_texts(spark, sf):
    """Digest of every text rearranged for infilling, and of the text restored from that."""
    made = infill.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(F.encode(text, "utf-8"), 256)
    return made.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"), digest(F.col("fim_output")).alias("output_sha256"),
        digest(infill.restore()).alias("restored_sha256"),
    )


@query("op12_language_id")
def language_of_texts(spark, sf):
    """Language of every text by its nearest centroid."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = languages.learn(docs.where(~F.col("held_out")))
    named = languages.identify(docs.drop("lang"), model)
    return named.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query("op13_spelling_variants")
def spelling_groups(spark, sf):
    """Every frequent word with its near words, its form and the last form."""
    words = spelling.word_counts(table(spark, sf, "documents"), slip_every=97)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
