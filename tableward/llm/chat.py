"""Chat formatting by perspective rotation, in DataFrame expressions only.

Every speaker of a dialogue gets a rendering of it: the speaker's own turns are the assistant's and
are trained on, the other speakers are users called by name, and context turns (system) stay what
they are.  A rendering comes in parts of ``PART_TURNS`` turns, so that a dialogue of any length
makes rows of bounded size; most dialogues have one part.

The place of a turn in its dialogue comes from sums over ranges of the (dialogue, turn) order, so a
dialogue that holds a large share of the rows is neither sorted nor gathered in one task.

Contract: turns are ordered by number (null first), then speaker, then text.  Rows that are equal in
dialogue, number, speaker and text are one turn.  A null text is empty, a null speaker is called
``unknown``.  Rows with a null dialogue form one dialogue.  A dialogue of context turns alone has
no rendering.  Texts are rendered whole, with markers in them left as they are.  An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableward.functions.ordered import running_totals

CONTEXT = ("system",)
PART_TURNS = 64
OPEN, CLOSE, UNKNOWN = "<|im_start|>", "<|im_end|>", "unknown"


def rotate(df: DataFrame, dialogue: str, turn: str, speaker: str, text: str, context: tuple[str, ...] = CONTEXT,
           part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue, perspective and part: ``dialogue``, ``perspective``, ``part``,
    ``n_turns``, ``n_trained``, ``rendered`` and ``spans``, the (start, length) in characters of
    what is trained on."""
    turns = df.select(
        F.col(dialogue).alias("dialogue"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("speaker"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("said"),
    ).groupBy("dialogue", "said").agg(F.lit(1).cast("long").alias("one"))
    placed = running_totals(turns, ["dialogue"], "said", ["one"]).select(
        "dialogue", "said", (F.col("cum_one") - 1).alias("at"))
    speakers = (turns.filter(~F.col("said.speaker").isin(*context)).groupBy("dialogue", "said.speaker").agg(F.lit(1))
                .select(F.col("dialogue").alias("_d"), F.col("speaker").alias("perspective")))
    own = F.col("said.speaker") == F.col("perspective")
    header = (F.when(own, F.lit("assistant")).when(F.col("said.speaker").isin(*context), F.lit("system"))
              .otherwise(F.concat(F.lit("user name="), F.col("said.speaker"))))
    message = F.struct("at", F.concat(F.lit(OPEN), header, F.lit("\n")).alias("head"),
                       F.col("said.text").alias("body"), own.alias("trained"))
    parts = (placed.join(speakers, F.col("dialogue").eqNullSafe(F.col("_d")))
             .groupBy("dialogue", "perspective", F.floor(F.col("at") / part_turns).cast("long").alias("part"))
             .agg(F.sort_array(F.collect_list(message)).alias("messages")))
    end = CLOSE + "\n"
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["body"], F.lit(end))), "")
    # The close marker of an own turn is trained on, as it says when to stop.
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate("messages", start, lambda acc, m: F.struct(
        (acc["at"] + F.length(m["head"]) + F.length(m["body"]) + len(end)).cast("long").alias("at"),
        F.when(m["trained"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(m["head"])).cast("long").alias("start"),
            (F.length(m["body"]) + len(CLOSE)).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return parts.select(
        F.col("dialogue").alias(dialogue), "perspective", "part", F.size("messages").cast("long").alias("n_turns"),
        F.size(F.filter("messages", lambda m: m["trained"])).cast("long").alias("n_trained"),
        rendered.alias("rendered"), spans.alias("spans"))
