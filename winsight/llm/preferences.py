"""Preference formatting: one prompt, two masked completions.

The prompt is the longest run of turns that the chosen and the rejected
conversation have in common from the start; it is rendered once.  Each
completion is the rest of its conversation, with the character ranges a model
is trained on: the assistant's turns and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The turn template and the role that is trained on.
OPEN, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(AFTER_ROLE), F.coalesce(t["text"], F.lit("")), F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """``array<struct<start,end>>`` of the trained characters of the rendered turns."""
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + len(OPEN) + len(AFTER_ROLE)
    body = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, t):
        start, end = acc["at"] + head(t), acc["at"] + head(t) + body(t)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add)["spans"]


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """One row per pair: ``pair, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``pair`` names the pair a turn belongs to and ``chosen`` tells the two
    sides apart.  A turn is shared when role and text are equal (null equals
    null).  Defined results: a side without turns has an empty completion and
    the prompt is empty; if one side continues the other, the shorter one's
    completion is empty; null role or text is rendered as nothing; turns with
    the same number are put in order by role and text; repeated rows are
    turns of their own; a null side counts as rejected; turns of a null pair
    make one pair; an empty table gives an empty result.
    """
    rows = turns.select(pair.alias("pair"), F.coalesce(chosen, F.lit(False)).alias("_side"), F.col(turn_col).alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    both = rows.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("_side", "turn", "role", "text"))).alias("_turns"))
    both = both.select("pair", F.filter("_turns", lambda t: t["_side"]).alias("_c"), F.filter("_turns", lambda t: ~t["_side"]).alias("_r"))
    least = F.least(F.size("_c"), F.size("_r"))
    same = F.zip_with(F.slice("_c", F.lit(1), least), F.slice("_r", F.lit(1), least),
                      lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    both = both.withColumn("_n", F.when(differs > 0, differs - 1).otherwise(least).cast("int"))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    both = both.select("pair", "_n", F.slice("_c", F.lit(1), F.col("_n")).alias("_p"), rest("_c").alias("_cr"), rest("_r").alias("_rr"))
    return both.select("pair", F.col("_n").cast("long").alias("prompt_turns"), _render(F.col("_p")).alias("prompt"),
                       _render(F.col("_cr")).alias("chosen"), _render(F.col("_rr")).alias("rejected"),
                       _mask(F.col("_cr")).alias("chosen_mask"), _mask(F.col("_rr")).alias("rejected_mask"))


def swapped_answers(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """Preference turns ``pair, chosen, turn, role, text`` out of plain conversations, one pair per conversation.

    Chosen is the conversation as it is; rejected is the conversation up to
    its last answer, with the last answer of its neighbour (ids 2k and 2k + 1
    are neighbours) in place of it.  A conversation without an answer is
    rejected as it is; without a neighbour's answer the rejected side stops
    before its own.  Of several last answers of one turn number the greatest
    text counts.
    """
    t = conversations.select(F.col(id_col).cast("long").alias("pair"), F.col(turn_col).alias("turn"),
                             F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    last = (t.where(F.col("role") == TRAINED).groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("m"))
            .select(F.col("pair").alias("own"), F.col("m.turn").alias("at"), F.col("m.text").alias("answer")))
    before = t.join(last, t["pair"].eqNullSafe(last["own"]), "left").where(F.col("at").isNull() | (F.col("turn") < F.col("at")))
    other = last.select(F.col("own").bitwiseXOR(F.lit(1)).alias("pair"), F.col("answer").alias("text"))
    answers = last.select(F.col("own").alias("pair"), F.col("at").alias("turn"), F.lit(TRAINED).alias("role")).join(other, "pair")
    columns = ["pair", "chosen", "turn", "role", "text"]
    return (t.withColumn("chosen", F.lit(True)).select(*columns)
            .unionByName(before.withColumn("chosen", F.lit(False)).select(*columns))
            .unionByName(answers.withColumn("chosen", F.lit(False)).select(*columns)))
