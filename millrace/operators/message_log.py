"""An incremental log of chat messages: aligned ids, masks and positions, and where they differ from the whole text's.

A turn is tokenised behind a short fixed history, and its own ids are what comes after the longest common prefix with
that history's ids; this costs in proportion to the turn, not to the conversation before it.  A prefix shorter than the history
(the tokeniser joined ids across the border) is flagged at its turn.  At the end the log is compared with the ids of the
whole text, as inference would see it, with some ids around the first difference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text


@dataclass(frozen=True)
class Template:
    """How a turn is written: {role} before and {end} behind its text; history is what turns are tokenised behind."""

    before: str = "<{role}>\n"
    end: str = "</turn>\n"
    answering: str = "assistant"
    history: str = "<system>\nYou help.</turn>\n<user>\nI am a user.</turn>\n"

    def opened(self, role: Column) -> Column:
        left, _, right = self.before.partition("{role}")
        return F.concat(F.lit(left), role, F.lit(right))

    @property
    def prompt(self) -> str:
        """What asks for an answer."""
        return self.before.replace("{role}", self.answering)


def spaced_words(x: Column) -> Column:
    """Words with the blanks behind them: what is joined gives the text again."""
    return F.regexp_extract_all(x, F.lit(r"\S+\s*|\s+"), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first ids two arrays share."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def cut(c: Column, start: Column, most: int) -> Column:
    return F.slice(c, start + 1, F.lit(most))


def message_log(turns: DataFrame, tokens: Callable[[Column], Column] = spaced_words, template: Template = Template(), longest: int = 32_768, longest_response: int = 8_192, around: int = 10, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row a conversation: ids, attention_mask, loss_mask and position_ids (aligned, at most `longest`), prompt_length, response_ids and
    response_loss_mask (at most `longest_response`), flagged_turns, and same_as_whole with the first difference on either side.

    Loss is on what assistants say and on what ends their turns.  An answer's turn starts with what asks for it, without loss.  The prompt is all
    before the first answer, with what asks for it, also where none follows.  Empty tool turns are left out.  A null text is empty, a null role an
    empty one; a conversation of no turns gives no row.  Turns of one number stay in the order of their role and text."""
    role, said = text("role"), text("text")
    answer = role == template.answering
    tool = (role == "tool") & (said == "")
    body = F.concat(said, F.lit(template.end))
    rows = turns.where(~tool).select(conv, turn, role.alias("_role"), body.alias("_body"), answer.alias("_answer"))
    rows = rows.withColumn("_open", template.opened(F.col("_role")))
    # two histories: the ids of a question come behind the plain one, those of an answer behind what asks for it
    rows = rows.withColumn("_base", tokens(F.when(F.col("_answer"), template.history + template.prompt).otherwise(template.history)))
    rows = rows.withColumn("_all", tokens(F.concat(F.lit(template.history), "_open", "_body"))).withColumn("_shared", common_prefix(F.col("_base"), F.col("_all")))
    rows = rows.withColumn("_own", F.slice("_all", F.col("_shared") + 1, F.greatest(F.size("_all") - F.col("_shared"), F.lit(0))))
    rows = rows.withColumn("_flag", F.col("_shared") < F.size("_base"))
    asked = tokens(F.lit(template.prompt))
    packed = F.struct(turn, "_role", "_body", F.col("_answer").alias("answer"), "_open", F.when(F.col("_answer"), asked).otherwise(F.slice(asked, 1, 0)).alias("ask"), F.col("_own").alias("own"), F.col("_flag").alias("flag"))
    logs = rows.groupBy(conv).agg(F.sort_array(F.collect_list(packed)).alias("_t"))

    first_answer = F.array_position(F.transform("_t", lambda t: t["answer"]), True).cast("int")
    logs = logs.withColumn("_first", F.when(first_answer > 0, first_answer - 1).otherwise(F.size("_t")))
    size_of = lambda part: F.aggregate(F.slice("_t", F.lit(1), F.col("_first")), F.lit(0), lambda n, t: n + F.size(t["ask"]) + F.size(t["own"])) + part
    logs = logs.withColumn("prompt_length", size_of(F.when(F.col("_first") < F.size("_t"), F.size(asked)).otherwise(0)))
    ids = F.flatten(F.transform("_t", lambda t: F.concat(t["ask"], t["own"])))
    loss = F.flatten(F.transform("_t", lambda t: F.concat(F.array_repeat(F.lit(0), F.size(t["ask"])), F.array_repeat(F.when(t["answer"], 1).otherwise(0), F.size(t["own"])))))
    logs = logs.withColumn("_ids", ids).withColumn("_loss", loss)
    logs = logs.withColumn("_whole", tokens(F.array_join(F.transform("_t", lambda t: F.concat(t["_open"], t["_body"])), "")))
    logs = logs.withColumn("_same", common_prefix(F.col("_ids"), F.col("_whole")))
    differ = F.greatest(F.size("_ids"), F.size("_whole")) > F.col("_same")
    near = lambda c: F.when(differ, F.slice(c, F.greatest(F.col("_same") - around, F.lit(0)) + 1, F.lit(2 * around)))
    start = F.col("prompt_length")
    return logs.select(
        conv,
        F.slice("_ids", 1, longest).alias("ids"),
        F.array_repeat(F.lit(1), F.least(F.size("_ids"), F.lit(longest))).alias("attention_mask"),
        F.slice("_loss", 1, longest).alias("loss_mask"),
        F.when(F.size("_ids") > 0, F.sequence(F.lit(0), F.least(F.size("_ids"), F.lit(longest)) - 1)).otherwise(F.array().cast("array<int>")).alias("position_ids"),
        "prompt_length",
        cut(F.slice("_ids", 1, longest), start, longest_response).alias("response_ids"),
        cut(F.slice("_loss", 1, longest), start, longest_response).alias("response_loss_mask"),
        F.transform(F.filter("_t", lambda t: t["flag"]), lambda t: t[turn]).alias("flagged_turns"),
        (~differ).alias("same_as_whole"),
        near("_ids").alias("log_chunk"),
        near("_whole").alias("whole_chunk"),
    )
