"""Registered queries of the text operators: thin, over whole tables, with the columns their contracts name."""

import atexit
import os
import re
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import basketlens
from basketlens.llm import (
    chat,
    chunk_dedup,
    exact_dedup,
    fingerprints,
    hard_negatives,
    language_id,
    mixing,
    ngram_join,
    personal_data,
    pieces,
    quality_rules,
    target_sampling,
    training_order,
)
from basketlens.llm.common import bound_batches, saved, table

#: The vocabulary of the piece encoder; another file is chosen by this variable of the environment.
VOCABULARY = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose tasks import it, unless they share its folder; bound the batches they are given."""
    bound_batches(spark)
    root = str(Path(basketlens.__file__).parent.parent)
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.TemporaryDirectory()
    atexit.register(folder.cleanup)
    path = os.path.join(folder.name, "basketlens.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(Path(root, "basketlens").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    vocabulary = pieces.Vocabulary.load(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, vocabulary, back=True)
    return both.select(
        "row.doc_id",
        F.length("row.text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("row.text")).alias("round_trip"),
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.fit(docs))
    base, spans = personal_data.spans_text("base"), personal_data.spans_text("spans")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("row.doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text", language_id.held_out().alias("held_out")), language_id.fit_on_rest(docs))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like control strings, formatted and read back."""
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turns = chat.canonical_turns(chat.as_records(rows))
    return chat.read_back(saved(chat.formatted_turns(turns), "formatted"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier text, and where that stands."""
    found = chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "first_id", "first_start")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the piece ids of all texts, read back: where each sequence stands, whose texts start in it, and its digest."""
    tokens = training_order.piece_tokens(spark, pieces.Vocabulary.load(VOCABULARY))
    folder, index = training_order.write_shards(table(spark, sf_dir, "documents"), tokens=tokens)
    rows = training_order.read_slots(folder, index, tokens=tokens)
    return rows.select("slot", "sequence", "shard", "byte_offset", "n_tokens", "doc_ids", F.sha2("tokens", 256).alias("tokens_sha256"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("n_edited_changes", F.size("edited_changes").cast("long")).drop("edited_changes")


def mixing_rates(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), keep_others: bool = True) -> DataFrame:
    """Rates by the domains of the labelled table: toxic, good and plain; toxic text gives way.

    With ``keep_others`` every document that is not mostly toxic, and any that is labelled clean, stays.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    domains = mixing.fit_domains(docs, labels.select("doc_id", domain.alias("domain")))
    clean = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic = 0").select("doc_id")
    return mixing.mix(docs, domains, less={"toxic": 0.1}, carry=carry, keep_others=keep_others, spared=clean if keep_others else None)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ("source",), keep_others=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For anchors among the embeddings: their positives, and the hardest rows of other labels below each."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), label.alias("label"))
    found = hard_negatives.mine(given, F.col("id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *counts, "base_failed", "kept", F.round("character_distance", 6).alias("character_distance"), F.round("word_distance", 6).alias("word_distance"))


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the rank of those drawn."""
    return target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_QUERIES = [
    op1_ngram_join,
    op2_chat,
    op3_pieces,
    op4_personal_data,
    op5_repeated_passages,
    op6_language_id,
    op7_exact_dedup,
    op8_training_order,
    op9_fingerprints,
    op10_mixing,
    op11_hard_negatives,
    op12_quality_rules,
    op13_target_sampling,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query: Callable) -> Callable:
        return lambda spark, sf_dir: (ship(spark), query(spark, sf_dir))[1]

    return {q.__name__: shipped(q) for q in _QUERIES}


_SPACES = r"[\x20\x09-\x0D]+"

_OP1 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
runs as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from runs group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y
  from runs a join runs b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n
  having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, l.y from reach r join links l on r.y = l.x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.y) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id join reach r on r.x = d.doc_id
group by d.doc_id, s.n
"""

_OP7 = rf"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g') as body from documents),
g as (
  select doc_id, body, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size
  from d window w as (partition by body order by n desc, doc_id))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from g
"""


def _escaped_length(text: str) -> str:
    """Characters of a text in the template: its own, one per backslash and one per control string."""
    control = "|".join(re.sub(r"([\[\]|<>/_])", r"\\\1", c) for c in sorted(chat.CONTROL, key=len, reverse=True))
    return f"length({text}) + length({text}) - length(replace({text}, chr(92), '')) + len(regexp_extract_all({text}, '{control}'))"


_OP2 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) as turns_sha256,
  cast(sum(case when r = 'assistant' then length(x) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn, r, x), '')) as loss_sha256,
  cast(sum({len(chat.TURN) + len(chat.END) + 2} + {_escaped_length("r")} + {_escaped_length("x")}) as bigint) as formatted_chars
from t group by conv_id
"""


_OP11 = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, c.vec_id, c.label,
    cast(list_sum([a.q[i] * c.q[i] for i in range(1, len(a.q) + 1)]) as bigint) as score
  from r a join r c on a.vec_id % 50 = 0),
p as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score
  from s where label = anchor_label and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

# CRC-32 by its table, which follows from the polynomial, over the distinct words only.
_OP13 = r"""
with recursive bits as (
  select b, 0 as k, cast(b as bigint) as c from range(256) t(b)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by b) as entries from bits where k = 8),
words as (
  select 'd' as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
held as (select side, doc_id, unnest(w) as word from words),
counts as (select side, doc_id, word, count(*) as n from held group by all),
hexed as (select distinct word, hex(encode(word)) as h from counts),
coded as (
  select word, xor(list_reduce(
      list_prepend(4294967295, [cast('0x' || substr(h, 2 * i - 1, 2) as bigint) for i in range(1, len(h) // 2 + 1)]),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from hexed, crc),
found as (select side, doc_id, bucket, sum(n) as n from counts join coded using (word) group by all),
shares as (
  select b as bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 'b'), 0) as t
  from range(10000) r(b) left join found on bucket = b group by b),
gains as (
  select bucket, cast(floor(1000 * ln(
    (cast(t as double) + 1) * cast((sum(s) over ()) + 10000 as double) / ((cast(s as double) + 1) * cast((sum(t) over ()) + 10000 as double)))) as bigint) as gain
  from shares),
mean as (
  select doc_id, cast(sum(n) as bigint) as n_features, cast(floor(cast(sum(n * gain) as double) / cast(sum(n) as double)) as bigint) as weight
  from found join gains using (bucket) where side = 'd' group by doc_id),
scored as (
  select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from documents d left join mean m on m.doc_id = d.doc_id)
select doc_id, n_features, weight, score,
  case when n_features >= 20 and row_number() over (order by n_features >= 20 desc, score desc, doc_id) <= 10 * (count(*) filter (n_features >= 20) over ()) // 100
    then row_number() over (order by n_features >= 20 desc, score desc, doc_id) end as rank
from scored
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1, "op2_chat": _OP2, "op7_exact_dedup": _OP7, "op11_hard_negatives": _OP11, "op13_target_sampling": _OP13}
