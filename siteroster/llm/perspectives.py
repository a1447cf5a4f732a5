"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every speaker of a conversation the whole dialogue is rendered with that speaker as the assistant and
the others as named users. The result is long: one row per conversation, perspective and turn, with the
rendered piece, its character range in the rendered dialogue, and the range that a model learns from.
Joining the pieces in order of ``position`` gives the dialogue; no dialogue is ever gathered into one row.

Narrators (``system``) speak to all and have no perspective of their own. A NULL speaker is the speaker
``unknown``; a NULL text is empty. NULL conversation ids form one conversation. Turns are ordered by turn
(NULL first), speaker, then text; equal rows stand side by side. The markers of the template cannot come
from a text: ``<|`` inside a text or name becomes ``< |``, and line ends inside a name become spaces. An empty table
gives no rows; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.operators.running import running

NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
           text: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """(conversation, perspective, position, turn, speaker, as_role, piece, start, end, learn_start, learn_end).

    ``learn_start`` and ``learn_end`` bound the assistant's own words with the closing marker and are NULL
    elsewhere. Conversations without a speaker besides narrators give no rows.
    """
    def plain(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    said = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"),
        F.translate(plain(F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))), "\r\n", "  ").alias("speaker"),
        plain(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    speakers = (said.filter(~F.col("speaker").isin(*narrators)).groupBy("conversation", F.col("speaker").alias("perspective"))
                .agg(F.lit(1).alias("_one")).select(F.col("conversation").alias("_conversation"), "perspective"))
    seen = said.join(speakers, F.col("conversation").eqNullSafe(F.col("_conversation"))).drop("_conversation")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*narrators), F.col("speaker")).otherwise("user")
    named = F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise("")
    head = F.concat(F.lit(OPEN), role, named, F.lit("\n"))
    rendered = seen.select("conversation", "perspective", "turn", "speaker", "said", role.alias("as_role"),
                           F.length(head).alias("_head"), F.concat(head, F.col("said"), F.lit(CLOSE)).alias("piece"))
    placed = running(rendered, ["turn", "speaker", "said"], ["conversation", "perspective"],
                     sums={"start": F.length("piece").cast("long"), "position": F.lit(1).cast("long")})
    end = F.col("start") + F.length("piece")
    learns = F.col("as_role") == "assistant"
    return placed.select(
        F.col("conversation").alias(conversation), "perspective", "position", "turn", "speaker", "as_role", "piece", "start",
        end.alias("end"), F.when(learns, F.col("start") + F.col("_head")).alias("learn_start"),
        F.when(learns, end - 1).alias("learn_end"))
