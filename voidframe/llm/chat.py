"""Chat formatting: conversations as windows of whole turns within a token budget, with a loss mask.

A turn is written as <|im_start|>role<|im_sep|>text<|im_end|>. Control strings inside roles and texts are escaped: a backslash goes after their
first character, one more if some are there already, so `unescape` gives back every text exactly and no text can open or close a turn.

Prefix sums of the turns' tokens (`plans.order.running`: a conversation is cut into ranges of turns, so none has to fit a task) cut a conversation
into blocks of BLOCK budgets; inside a block, windows are filled greedily with whole turns. A window that doesn't begin the conversation starts
with the system turn (the first turn, if its role is system) and with the latest turns before it, `history` tokens at most. These repeated turns
are outside the loss mask, so each assistant turn is a target exactly once. A turn that is larger than a window is a window of its own.

Order and odd rows: turns go by `turn`, null first, then role, then MD5 of the text; equal rows stay as often as they occur. A null role or text is
empty; a null conv_id is a conversation like others. A text of any length is kept whole, in one row. Without rows there are no windows. Other columns
of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import in_parts, running

# The markers of this template, and control strings of common templates.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (OPEN, MIDDLE, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_AFTER = "(?:" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
ESCAPE, UNESCAPE = rf"([<\[])(\\*{_AFTER})", rf"([<\[])\\(\\*{_AFTER})"
#: Pieces of which a turn's tokens are counted, and what its markers cost besides.
TOKEN, MARKS = r"\p{L}{1,5}|\p{N}{1,3}|[^\p{L}\p{N}\x00-\x20]", 4
BUDGET, HISTORY, BLOCK = 512, 128, 16


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def token_estimate(text: Column) -> Column:
    """Pieces of up to five letters or three digits, and other signs: near what subword vocabularies make of a text."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def turns(conversations: DataFrame, tokens=token_estimate) -> DataFrame:
    """Each turn with at (its number in the conversation), start (tokens before it), start_all (tokens of its conversation) and its formatted piece."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.select(F.struct("conv_id").alias("_c"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_id"))
    own = own.withColumns({"cost": (tokens(F.col("text")) + MARKS).cast("long"), "_tie": F.md5(F.col("text").cast("binary"))})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_tie"), F.col("_id")]
    cut = in_parts(own, F.col("_c"), *order)
    at = running(cut, ["_c"], order, {"at": ("sum", F.lit(1).cast("long")), "start": ("sum", F.col("cost"))}, whole=True)
    lead = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    return at.withColumns({"_lead": lead, "_text": escape(F.col("text"))}).select(
        "_c", "at", "start", "start_all", "cost",
        F.concat("_lead", "_text", F.lit(CLOSE)).alias("piece"),
        F.length("_lead").cast("long").alias("lead"),
        F.length("_text").cast("long").alias("chars"),
        (F.col("role") == "assistant").alias("target"),
        ((F.col("at") == 0) & (F.col("role") == "system")).alias("system"),
    )


def _starts(own: Column, room: Column, budget: int) -> Column:
    """(at, start) of each window's first turn: a fold that fills windows greedily."""
    here = lambda t: F.struct(t["at"].alias("at"), t["start"].alias("start"))
    empty = F.struct(F.lit(0).cast("long").alias("fill"), F.lit(-1).cast("long").alias("room"), F.expr("cast(array() as array<struct<at: bigint, start: bigint>>)").alias("starts"))

    def step(s: Column, t: Column) -> Column:
        fits = s["fill"] + t["cost"] <= s["room"]
        more = F.struct((s["fill"] + t["cost"]).alias("fill"), s["room"].alias("room"), s["starts"].alias("starts"))
        new = F.struct(t["cost"].alias("fill"), F.when(t["at"] == 0, F.lit(budget).cast("long")).otherwise(room).alias("room"), F.array_append(s["starts"], here(t)).alias("starts"))
        return F.when(fits, more).otherwise(new)

    return F.aggregate(own, empty, step, lambda s: s["starts"])


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_estimate) -> DataFrame:
    """conv_id, first_turn, next_turn (exclusive), context (leading turns that are repeated), tokens, formatted, and loss: the (start, length) spans of
    the assistant texts in code points of formatted. history must be less than budget."""
    span = budget * BLOCK
    each = turns(conversations, tokens).withColumn("_own", F.floor(F.col("start") / span))
    last = F.floor((F.col("start_all") - 1) / span)
    seen = F.when(F.col("system") & (last > 0), F.sequence(F.lit(0).cast("long"), last))
    seen = F.coalesce(seen, F.when((F.col("_own") + 1) * span - F.col("start") <= history, F.array(F.col("_own"), F.col("_own") + 1)), F.array("_own"))
    dealt = each.select("*", F.explode(seen).alias("_block")).withColumn("own", F.col("_own") == F.col("_block"))
    turn = F.struct("at", "start", "cost", "piece", "lead", "chars", "target", "system", "own")
    blocks = dealt.groupBy("_c", "_block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    system = F.aggregate(F.filter("turns", lambda t: t["system"]), F.lit(0).cast("long"), lambda n, t: n + t["cost"])
    blocks = blocks.withColumn("own", F.filter("turns", lambda t: t["own"])).where(F.size("own") > 0)
    blocks = blocks.withColumns({"starts": _starts(F.col("own"), F.lit(budget - history).cast("long") - system, budget), "_end": F.element_at("own", -1)["at"] + 1})

    def window(first: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1)["at"], F.col("_end"))
        before = F.filter("turns", lambda t: (t["at"] < first["at"]) & (t["system"] | (t["start"] >= first["start"] - history)))
        return F.struct(first["at"].alias("first_turn"), end.alias("next_turn"), F.size(before).alias("context"), F.concat(before, F.filter("own", lambda t: (t["at"] >= first["at"]) & (t["at"] < end))).alias("members"))

    out = blocks.select("_c", F.explode(F.transform("starts", window)).alias("w")).select("_c", "w.*")
    at = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("loss"))

    def walk(s: Column, t: Column) -> Column:
        spans = F.when(t["target"] & (t["at"] >= F.col("first_turn")), F.array_append(s["loss"], F.struct((s["pos"] + t["lead"]).alias("start"), t["chars"].alias("length")))).otherwise(s["loss"])
        return F.struct((s["pos"] + t["lead"] + t["chars"] + len(CLOSE)).alias("pos"), spans.alias("loss"))

    return out.select(
        F.col("_c.conv_id").alias("conv_id"), "first_turn", "next_turn", "context",
        F.aggregate("members", F.lit(0).cast("long"), lambda n, t: n + t["cost"]).alias("tokens"),
        F.array_join(F.transform("members", lambda t: t["piece"]), "").alias("formatted"),
        F.aggregate("members", at, walk, lambda s: s["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with turns (role and text of those that are not repeated) and targets (the texts under the mask), read from formatted and loss."""
    parts = F.slice(F.split("formatted", re.escape(OPEN)), F.col("context") + 2, F.size("members"))
    turn = lambda p: F.struct(unescape(F.split_part(p, F.lit(MIDDLE), F.lit(1))).alias("role"), unescape(F.split_part(F.split_part(p, F.lit(MIDDLE), F.lit(2)), F.lit(CLOSE), F.lit(1))).alias("text"))
    targets = F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumn("members", F.split("formatted", re.escape(OPEN))).withColumns({"turns": F.transform(parts, turn), "targets": targets}).drop("members")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts look like control strings."""
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def digest(conversations: DataFrame) -> DataFrame:
    """The query's columns. A digest of a whole conversation needs its texts in one row, up to 2 GB: what the query asks for, not the operator."""
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(planted(conversations.sparkSession))
    read = read_back(windows(every)).select(
        "conv_id",
        F.struct(
            "first_turn",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("targets", "").alias("loss"),
        ).alias("w"),
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    by = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    joined = lambda part: F.array_join(F.transform("w", lambda w: w[part]), "")
    out = by.select("conv_id", "n_turns", "formatted_chars", joined("said").alias("said"), joined("loss").alias("loss"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_SQL_AFTER, _SQL_TOKEN = _AFTER.replace("'", "''"), TOKEN

SQL = rf"""
with recursive raw as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as k
  from raw
), c as (
  select *, {MARKS} + len(regexp_extract_all(text, '{_SQL_TOKEN}')) as cost,
    {len(OPEN + MIDDLE + CLOSE)} + length(regexp_replace(role, '([<\[])(\\*{_SQL_AFTER})', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*{_SQL_AFTER})', '\1\\\2', 'g')) as piece
  from t
), p as (
  select *, cast(sum(cost) over (partition by conv_id order by k) - cost as bigint) as start, k = 0 and role = 'system' as sys,
    cast(coalesce(sum(case when k = 0 and role = 'system' then cost end) over (partition by conv_id), 0) as bigint) as sys_cost
  from c
), q as (select *, start // {BUDGET * BLOCK} as block from p
), g(conv_id, k, block, first, fill, room) as (
  select conv_id, k, block, k, cost, cast({BUDGET} as bigint) from q where k = 0
  union all
  select q.conv_id, q.k, q.block,
    case when q.block = g.block and g.fill + q.cost <= g.room then g.first else q.k end,
    case when q.block = g.block and g.fill + q.cost <= g.room then g.fill + q.cost else q.cost end,
    case when q.block = g.block and g.fill + q.cost <= g.room then g.room else {BUDGET - HISTORY} - q.sys_cost end
  from g join q on q.conv_id = g.conv_id and q.k = g.k + 1
), w as (
  select g.conv_id, g.first, min(q.start) as start, sum(q.piece) as own from g join q on q.conv_id = g.conv_id and q.k = g.k group by 1, 2
), h as (
  select w.conv_id, w.first, sum(q.piece) as repeated from w join q on q.conv_id = w.conv_id and q.k < w.first and (q.sys or q.start >= w.start - {HISTORY}) group by 1, 2
), f as (
  select w.conv_id, cast(sum(w.own) + sum(coalesce(h.repeated, 0)) as bigint) as formatted_chars from w left join h on h.conv_id = w.conv_id and h.first = w.first group by 1
), d as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '') as loss
  from t group by 1
)
select d.conv_id, d.n_turns, d.turns_sha256, cast(length(d.loss) as bigint) as loss_chars, sha256(d.loss) as loss_sha256, f.formatted_chars
from d join f on f.conv_id = d.conv_id
"""
