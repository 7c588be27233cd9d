"""Multi-party perspective rotation of conversations (DataFrame operations only).

For every participant (role) of a conversation, its turns are rendered with that participant as the assistant and
all others as named users: "<|assistant|>\\n{text}\\n<|end|>\\n" or "<|user name={role}|>\\n{text}\\n<|end|>\\n". A row is one turn
seen by one participant, with where it starts in the whole rendering (in code points), so a rendering is its rows in
order and no conversation is ever gathered in one task. A text or role can't forge a mark: "<|" in a text is written "<||" (so any
run of bars after "<" loses one when it is read back), and "%", "|" and line feeds in a role are written %25, %7C and %0A; only the participant's own turns are trained on, and the mask
span of such a turn is its text and end mark, without the header.

Defined cases: null text is the empty text; a null role takes part as a participant named "unknown"; null turns come
first; rows that repeat a turn stay, in order of role and text; null conversation ids form one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import running_sum


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = 512) -> DataFrame:
    """conv_id, speaker, turn, role, rendered, start, n_chars, trained, mask_start, mask_end."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    cast = rows.select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    seen = rows.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("role") == F.col("speaker")
    shown = F.replace("text", F.lit("<|"), F.lit("<||"))
    name = F.replace(F.replace(F.replace("role", F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("\n"), F.lit("%0A"))
    header = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    seen = seen.withColumn("_header", F.length(header).cast("long")).withColumn("rendered", F.concat(header, shown, F.lit("\n<|end|>\n")))
    seen = seen.withColumn("n_chars", F.length("rendered").cast("long")).withColumn("trained", own)
    seen = seen.withColumn("_stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**40))) / stretch))  # turns of one stretch are summed in one task
    seen = running_sum(seen, "n_chars", ["conv_id", "speaker"], "_stretch", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "start")
    return seen.select("conv_id", "speaker", "turn", "role", "rendered", "start", "n_chars", "trained",
                       F.when(own, F.col("start") + F.col("_header")).alias("mask_start"), F.when(own, F.col("start") + F.col("n_chars")).alias("mask_end"))
