"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; system messages stay system messages and are no
participant.  The result has a row per (conversation, speaker, message) with the message's
rendering, its place in the rendered dialogue, and the character span that is trained on:
the assistant's content and its end marker.  Joining the renderings in order of ``start``
gives the dialogue.  Rows, not one string per dialogue, because one conversation may hold a
third of all messages.

Defined cases: a null text is empty, a null role is the participant ``unknown``, null
conversation ids form one conversation, null turns come first; messages of one turn are
ordered by role, then text; repeated rows are repeated messages; a conversation of system
messages alone yields nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import running_start

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_SLICE = 1024


def rotate(messages: DataFrame) -> DataFrame:
    """Every dialogue from every participant's point of view, a row per message."""
    said = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.coalesce("turn", F.lit(-1)) / TURNS_PER_SLICE).cast("bigint").alias("_cut"))
    speakers = said.filter("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    views = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("role") == F.col("speaker")
    head = F.when(F.col("role") == "system", F.lit(f"{OPEN}system\n")).when(own, F.lit(f"{OPEN}assistant\n")).otherwise(
        F.concat(F.lit(f"{OPEN}user name="), F.col("role"), F.lit("\n")))
    views = views.withColumns({
        "chat_role": F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise("user"),
        "rendered": F.concat(head, F.col("text"), F.lit(f"{CLOSE}\n")),
        "_head": F.length(head).cast("bigint"),
    }).withColumn("_len", F.length("rendered").cast("bigint"))
    placed = running_start(views, ["conv_id", "speaker"], "_cut",
                           [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "_len", "start")
    trained = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "speaker", "turn", "role", "chat_role", "rendered", "start",
        (F.col("start") + F.col("_len")).alias("end"),
        F.when(trained, F.col("start") + F.col("_head")).otherwise(F.col("start")).alias("mask_from"),
        F.when(trained, F.col("start") + F.col("_len") - 1).otherwise(F.col("start")).alias("mask_to"))
