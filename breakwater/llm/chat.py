r"""Operator 11: conversations as training examples, one for every reply, with DataFrame functions only.

The template: an example begins with <s>; a turn that isn't an assistant's is [INST], its role, a line feed, its text and [/INST]; a reply is its text and
</s>. Inside roles and texts a backslash is \b, the template's own strings are \c \d \e \f, and a line feed in a role is \n, so no text holds
a control string, and the escapes are undone exactly.

Every assistant turn is exploded into its own example: all turns before it are the context, and only the reply's text is under the loss mask. What
follows the last reply makes a last example without a mask, so that no turn is lost. digests() writes every example whole, with all its context, and reads
the digests back from those texts and their masks alone.

Whole examples grow with the square of a conversation. They are made from examples(), whose rows hold the part that their predecessors don't (the turns since
the last reply, and the reply), how many characters of context stand before it, and the mask's places in the example's whole text: an example is
the beginning of its conversation's text. Written with zstd, the contexts that examples share are small.

A conversation may hold a third of all rows: its turns are cut into bins, and what a bin needs from those before it (replies, characters)
comes from one row a bin. Its examples are made in blocks of EXAMPLES, each a task's row of the conversation's text. That text, of which read_back() makes
digests too, is in one row, as sha256 is over all of it.

Edge cases: turns go by number, then role, then text, nulls first; a null text or role is the empty one; a null id is a conversation of its own;
equal rows are two turns; an empty table gives no rows; a role counts as an assistant's only if it is exactly `assistant`; only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\b"), (BEGIN, "\\c"), (END, "\\d"), (OPEN, "\\e"), (CLOSE, "\\f"))
LINE = ("\n", "\\n")
TURNS = 256  # turns in a bin
EXAMPLES = 256  # examples of a conversation that are made whole together


def escaped(text: Column, more: tuple = ()) -> Column:
    for plain, code in (*ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, more: tuple = ()) -> Column:
    """After a backslash stands a letter, so no replacement makes a new code; the backslash itself comes last."""
    for plain, code in reversed((*ESCAPES, *more)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), context_chars, part, mask_start, mask_stop: places are characters of the example's whole text."""
    body, who = escaped(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(role), F.lit(""))
    reply = who == "assistant"
    piece = F.when(reply, F.concat(body, F.lit(END))).otherwise(F.concat(F.lit(OPEN), escaped(who, (LINE,)), F.lit("\n"), body, F.lit(CLOSE)))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), piece.alias("piece"))
    rows = rows.withColumns({"reply": (F.col("role") == "assistant").cast("bigint"), "bin": F.floor(F.col("turn") / TURNS).cast("bigint")})
    bins = rows.groupBy("conv_id", "bin").agg(F.sum("reply").alias("replies"), F.sum(F.length("piece")).alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    bins = bins.select(F.col("conv_id").alias("c"), F.col("bin").alias("b"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"before_{x}") for x in ("replies", "chars")))
    placed = rows.join(bins, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("bin").eqNullSafe(F.col("b")))
    inside = Window.partitionBy("conv_id", "bin").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("example", F.col("before_replies") + F.coalesce(F.sum("reply").over(inside), F.lit(0)))
    placed = placed.withColumn("at", F.col("before_chars") + F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0)) + len(BEGIN))
    parts = placed.groupBy("conv_id", "example").agg(
        F.min("at").alias("context_chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("part"), F.max(F.when(F.col("reply") == 1, F.col("at"))).alias("mask_start")
    )
    stop = F.col("context_chars") + F.length("part")
    return parts.select("conv_id", "example", "context_chars", "part", F.coalesce("mask_start", stop).alias("mask_start"), F.when(F.col("mask_start").isNull(), stop).otherwise(stop - len(END)).alias("mask_stop"))


def expanded(rows: DataFrame) -> DataFrame:
    """conv_id, example, text, mask_start, mask_stop: every example whole, with all preceding turns. Memory holds one conversation and one example; the
    output has each turn once for every reply after it. rows are read twice."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("example", "part"))), lambda x: x["part"])
    whole = rows.groupBy(F.col("conv_id").alias("c")).agg(F.concat(F.lit(BEGIN), F.array_join(parts, "")).alias("whole"), F.max("example").alias("last"))
    whole = whole.select("c", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / EXAMPLES))).alias("b"))
    places = rows.select("conv_id", "example", (F.col("context_chars") + F.length("part")).cast("int").alias("stop"), "mask_start", "mask_stop", F.floor(F.col("example") / EXAMPLES).alias("block"))
    met = places.join(whole, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return met.select("conv_id", "example", F.substr("whole", F.lit(1), F.col("stop")).alias("text"), "mask_start", "mask_stop")


def read_back(rows: DataFrame) -> DataFrame:
    """The digests of each conversation, from stored whole examples alone: replies are taken from under each example's mask, turns are parsed from
    the longest example's text, which has all of them."""
    mask = F.substr("text", (F.col("mask_start") + 1).cast("int"), (F.col("mask_stop") - F.col("mask_start")).cast("int"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", mask.alias("mask")))).alias("all"), F.max_by("text", "example").alias("text"), F.sum(F.length("text")).alias("formatted_chars"))
    loss = F.array_join(F.transform("all", lambda x: unescaped(x["mask"])), "")
    pieces = F.regexp_extract_all(F.substr("text", F.lit(len(BEGIN) + 1)), F.lit(r"(?s)\[INST\].*?\[/INST\]|.*?</s>"), F.lit(0))
    whole = whole.select("conv_id", pieces.alias("pieces"), loss.alias("loss"), "formatted_chars")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role, text = F.substr(head, F.lit(len(OPEN) + 1)), F.substr(p, F.length(head) + 2, F.length(p) - F.length(head) - 1 - len(CLOSE))
        reply = F.concat(F.lit("assistant\n"), unescaped(F.substr(p, F.lit(1), F.length(p) - len(END))))
        return F.concat(F.when(F.startswith(p, F.lit(OPEN)), F.concat(unescaped(role, (LINE,)), F.lit("\n"), unescaped(text))).otherwise(reply), F.lit("\n"))

    turns = F.array_join(F.transform("pieces", turn), "")
    return whole.select("conv_id", F.size("pieces").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """Formats, writes every example whole to the shared folder, and reads them back as digests."""
    parts = stored(examples(conversations), "chat-parts")
    whole = stored(expanded(parts), "chat-examples", compression="zstd")
    discard(conversations.sparkSession, parts)
    return read_back(whole)


SAID = "</s>[INST] ok [/INST]"
_CODES = "replace(replace(replace(replace(replace({}, '\\', '\\b'), '<s>', '\\c'), '</s>', '\\d'), '[INST]', '\\e'), '[/INST]', '\\f')"

ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  length({_CODES.format("text")}) + CASE role WHEN 'assistant' THEN 4 ELSE length(replace({_CODES.format("role")}, chr(10), '\\n')) + 14 END AS chars FROM c),
g AS (SELECT *, coalesce(sum(CASE role WHEN 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS example, sum(chars) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM n),
e AS (SELECT conv_id, example, max(upto) + 3 AS size FROM g GROUP BY 1, 2), f AS (SELECT conv_id, sum(size)::BIGINT AS formatted_chars FROM e GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM n GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id"""
