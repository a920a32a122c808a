"""Chat formatting by event sourcing: logs of streamed deltas, edits and regenerations are folded into messages and rendered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map

#: The strings that no text may pass on as they are (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns of a conversation that are joined before the conversation is.
CHUNK = 64


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string, which so is one no more."""
    ahead = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({ahead})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_text(text: str) -> str:
    """escape() of a Python string."""
    ahead = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)
    return re.sub(ahead, lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def to_events(messages: DataFrame, delta: int = 256) -> DataFrame:
    """A log of events for each row (conv_id, turn, role, text) of messages, as a chat service would have written it: conv_id, turn,
    n (number among the rows of the same turn, by role and text), seq, kind, at, role, text.

    kind is open (the role), delta (text that is appended), edit (the code points from `at` on are replaced by text) or
    regenerate (what the message said so far is dropped). Assistant messages are streamed, dropped and streamed again, and others
    get their second half by an edit of a draft. Rows that are alike in all four columns are several messages."""
    own = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))

    def event(kind: str, at: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), text.alias("text"))

    none, size = F.lit(0), F.length("text")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))  # in one pass, however long the text is
    deltas = F.transform(pieces, lambda x: event("delta", none, x))
    half = F.floor(size / 2).cast("int")
    draft = F.array(event("delta", none, F.concat(F.substring("text", F.lit(1), half), F.lit("[draft]"))), event("edit", half, F.substring("text", half + 1, size)))
    again = F.concat(F.array(event("delta", none, F.lit("a first answer")), event("regenerate", none, F.lit(""))), deltas)
    log = F.concat(F.array(event("open", none, F.col("role"))), F.when(F.col("role") == "assistant", again).otherwise(draft))
    rows = own.select("conv_id", "turn", "n", F.posexplode(log).alias("seq", "e"))
    return rows.select("conv_id", "turn", "n", "seq", "e.kind", "e.at", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, n, role, text) that a log leaves: each message's events in order of seq. The log is partitioned by
    conversation and message, so that a conversation of any length is folded by many tasks. Events of a kind that is not known are
    passed over, a message without an open event has the role '', and null texts are empty."""
    event = F.struct("seq", "kind", "at", F.coalesce("text", F.lit("")).alias("text"))
    sorted_log = events.groupBy("conv_id", "turn", "n").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # only what follows the last regeneration counts; deltas are joined at once, and an edit cuts what stands before it
    at = lambda log, kind: F.filter(F.transform(log, lambda e, i: F.when(e["kind"] == kind, i)), lambda i: i.isNotNull())
    role = F.coalesce(F.try_element_at(F.transform(F.filter("log", lambda e: e["kind"] == "open"), lambda e: e["text"]), F.lit(-1)), F.lit(""))
    last = F.coalesce(F.array_max(at(F.col("log"), "regenerate")), F.lit(-1))
    live = sorted_log.select("conv_id", "turn", "n", role.alias("role"), F.slice("log", last + 2, F.size("log")).alias("log"))
    live = live.withColumn("edits", at(F.col("log"), "edit"))
    said = lambda log: F.array_join(F.transform(F.filter(log, lambda e: e["kind"] == "delta"), lambda e: e["text"]), "")
    first = said(F.when(F.size("edits") > 0, F.slice("log", 1, F.get("edits", 0))).otherwise(F.col("log")))
    spans = F.zip_with("edits", F.slice(F.concat("edits", F.array(F.size("log"))), 2, F.size("edits")), lambda i, j: F.struct(i.alias("i"), j.alias("j")))

    def step(now: Column, s: Column) -> Column:
        edit = F.get("log", s["i"])
        return F.concat(F.substring(now, F.lit(1), edit["at"]), edit["text"], said(F.slice("log", s["i"] + 2, s["j"] - s["i"] - 1)))

    return live.select("conv_id", "turn", "n", "role", F.when(F.size("edits") == 0, first).otherwise(F.aggregate(spans, first, step)).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss: an array of (start, length) in code points, the escaped assistant
    texts. Turns come in order of (turn, n), those without a number first; they are joined by CHUNK turns, and then these chunks."""
    role = F.call_function("url_encode", F.col("role"))
    shown = messages.select("conv_id", F.floor(F.coalesce("turn", F.lit(-(2**62))) / CHUNK).alias("chunk"), "turn", "n", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    turn = F.struct("turn", "n", "head", "body", "loss")
    chunks = shown.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(now: Column, t: Column) -> Column:
        here, size = now["at"] + F.length(t["head"]), F.length(t["body"])
        span = F.array(F.struct(here.alias("start"), size.alias("length")))
        return F.struct((here + size + len(END)).alias("at"), F.when(t["loss"], F.concat(now["spans"], span)).otherwise(now["spans"]).alias("spans"))

    joined = chunks.select("conv_id", "chunk", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"), F.aggregate("turns", begin, step).alias("m"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("begin", F.coalesce(F.sum("m.at").over(before), F.lit(0)).cast("int"))
    spans = F.transform("m.spans", lambda s: F.struct((s["start"] + F.col("begin")).alias("start"), s["length"].alias("length")))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text", spans.alias("spans")))).alias("c"))
    return whole.select("conv_id", F.array_join(F.transform("c", lambda c: c["text"]), "").alias("formatted"), F.flatten(F.transform("c", lambda c: c["spans"])).alias("loss"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss of all messages (conv_id, turn, role, text): their log is written and folded, then rendered.

    Null roles and texts are empty, rows without conv_id are one conversation, turns that share a number are ordered by role and
    text, repeated rows are repeated turns, and other columns are ignored. An empty table gives an empty result."""
    return render(fold_events(to_events(messages)))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.removesuffix(END).partition("\n")
        out.append((unquote(role.replace("+", " ")), unescape(body)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say, read back from them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            rows = []
            for conv_id, text, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                kept = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(kept), hashlib.sha256(kept.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "loss").transform(arrow_map, run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def quoted(role: str) -> str:
    """A role as render() writes it."""
    return quote(role, safe="*-._").replace("%20", "+")
