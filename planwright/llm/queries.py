"""The thin queries of the operators, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, fingerprint, lm, mixing, neardup, packing, quality_knn, rules, token_output, toxicity

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
#: Words in the longest gram of the language model.
ORDER = 3


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_id_output(common.read(spark, sf_dir, "documents"), tokenizer_path())


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(common.read(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.katz_scores(common.read(spark, sf_dir, "documents"), order=ORDER)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.held_out_score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.read(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE)


PROBE = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat.digest(chat.format_chats(rows.unionByName(probe))).drop("escape_level", "identical")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(common.read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_report(common.read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_ids, op3_near_dedup, op4_katz, op5_quality, op6_packing, op7_chat, op8_quality_rules, op9_mixing, op10_fingerprints)}


def _op7_sql() -> str:
    probe = "select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'"
    escaped = r"regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g')"
    bare = r"regexp_matches(text, '### |</turn>')"
    role = r"coalesce(replace(replace(role, '\', '\\'), chr(10), '\n'), '\0')"
    return f"""
with r as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations union all {probe}
), f as (select conv_id, bool_or({bare}) as escaped from r group by conv_id)
select r.conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(4 + length({role}) + 2 + length(case when escaped then {escaped} else text end) + 9)::bigint as formatted_chars
from r join f on r.conv_id is not distinct from f.conv_id group by r.conv_id"""


OP3_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), e as (select doc_id, len(s) as n, unnest(s) as sh from s),
p as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.sh = b.sh and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l as (select a, b from p union all select b, a from p),
r(node, label) as (select doc_id, doc_id from s union select l.b, r.label from r join l on l.a = r.node),
c as (select node, min(label) as label from r group by node)
select s.doc_id, len(s.s) as n_shingles, c.label as component_id, s.doc_id = c.label as kept from s join c on c.node = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3_SQL, "op7_chat": _op7_sql()}
