"""The queries of this subpackage, and their SQL for DuckDB where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import brown, chat, decontam, lines, pieces, repetition, simhash, toxicity, urlfilter, warc

#: The rules that op1_url_filter applies.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The SentencePiece model that op4_sentencepiece and the pipeline use.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: What conversation -1 says in both of its turns.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; the block list holds the canonical URLs that several pages share."""
    pages = table(spark, sf_dir, "pages")
    form = urlfilter.canonical(urlfilter.host(F.col("url")), urlfilter.path(F.col("url")))
    listed = pages.groupBy(form.alias("canonical")).count().where("count > 1").select("canonical")
    return urlfilter.filter_urls(pages, listed, URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document, as a digest, and the numbers of the lines that went."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.md5("text").alias("text_md5"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.with_tokens(table(spark, sf_dir, "documents"), MODEL_PATH)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), max_distance=4, shingle=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return chat.digests(chat.format_conversations(rows.union(own)))


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_repetition": op5_repetition,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_brown": op10_brown,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
with own as (
  select page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
form as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as canonical from own),
listed as (select canonical from form where canonical <> '' group by 1 having count(*) > 1),
rules(action, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (select f.host, f.path, arg_max(struct_pack(rule := r.host || r.path, action := r.action), length(r.host || r.path)) as best
  from (select distinct host, path from form) f join rules r on (f.host = r.host or ends_with(f.host, '.' || r.host)) and starts_with(f.path, r.path) group by all)
select f.page_id, f.host, f.path, fit.best.rule as rule, coalesce(fit.best.action, case when l.canonical is not null then 'block' else 'allow' end) as verdict, l.canonical is not null as is_listed
from form f left join fit on f.host = fit.host and f.path = fit.path left join listed l on f.canonical = l.canonical
""",
    "op9_chat": r"""
with own as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, length('<|im_start|>') + length(url_encode(role)) + 1 + length(regexp_replace(replace(text, '\', '\\'), '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>', '\0!', 'g')) + length('<|im_end|>') + 1 as n from own)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from sized group by conv_id
""",
}
