"""Chat rows: messages, media placeholders, token and loss masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDIA = r"(?=<image>|<video>)|(?<=<image>|<video>)"


def messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row a conversation: messages as array<struct<role, content>> in the order of turns."""
    picked = F.sort_array(F.collect_list(F.struct(turn, F.col("role"), F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(picked.alias("_m")).select(conv, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def parts(content: Column, images: Column | None = None) -> Column:
    """array<struct<type, text, image>>: the text cut at its placeholders, the n-th of which takes the n-th image.
    Refused unless there are as many images as placeholders."""
    pieces = F.filter(F.split(content, MEDIA), lambda p: p != "")
    images = F.array().cast("array<string>") if images is None else images
    count = F.size(F.filter(pieces, lambda p: p == "<image>"))
    before = lambda i: F.size(F.filter(F.slice(pieces, 1, i + 1), lambda p: p == "<image>"))
    none = F.lit(None).cast("string")

    def part(p, i):
        image = F.struct(F.lit("image").alias("type"), none.alias("text"), F.try_element_at(images, before(i)).alias("image"))
        video = F.struct(F.lit("video").alias("type"), none.alias("text"), none.alias("image"))
        return F.when(p == "<image>", image).when(p == "<video>", video).otherwise(F.struct(F.lit("text").alias("type"), p.alias("text"), none.alias("image")))

    return F.when(count == F.size(images), F.transform(pieces, part)).otherwise(F.raise_error(F.lit("as many images as placeholders are needed")).cast("array<struct<type:string,text:string,image:string>>"))


#: A message's content as typed parts.
PARTS = "array<struct<type:string,text:string,image:string>>"


def part(kind: Column, text: Column, image: Column) -> Column:
    return F.struct(kind.alias("type"), text.cast("string").alias("text"), image.cast("string").alias("image"))


def swapped_images(messages: Column, images: Column) -> Column:
    """Messages (role, content as typed parts) whose n-th image part, counted over all of them, gets the n-th of other images.

    A message whose content is null stays; refused unless there are as many images as image parts."""
    count = lambda c: F.size(F.filter(c, lambda p: p["type"] == "image"))
    shown = lambda c: F.coalesce(F.when(c.isNotNull(), count(c)), F.lit(0))
    total = lambda m: F.aggregate(m, F.lit(0), lambda n, x: n + shown(x["content"]))

    def swap(message, k):
        before = total(F.slice(messages, F.lit(1), k))
        place = lambda i: before + count(F.slice(message["content"], F.lit(1), i + 1))
        none = F.lit(None)
        new = F.transform(message["content"], lambda p, i: F.when(p["type"] == "image", part(p["type"], none, F.try_element_at(images, place(i)))).otherwise(part(p["type"], p["text"], p["image"])))
        return F.struct(message["role"].alias("role"), new.alias("content"))

    wrong = F.raise_error(F.format_string("%d teacher images for %d in the prompt", F.coalesce(F.size(images), F.lit(0)), total(messages))).cast(f"array<struct<role:string,content:{PARTS}>>")
    return F.when(total(messages) == F.coalesce(F.size(images), F.lit(0)), F.transform(messages, swap)).otherwise(wrong)


def templated_messages(messages: Column, images: Column) -> Column:
    """Messages of plain texts as typed parts: each <image>, counted over all of them, takes the next of the images; refused unless they are as many."""
    pieces = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"(?=<image>)|(?<=<image>)"), lambda p: p != "")
    parted = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.transform(pieces(m["content"]), lambda p: part(F.when(p == "<image>", "image").otherwise("text"), F.when(p != "<image>", p), F.lit(None))).alias("content")))
    return swapped_images(parted, images)


def hinted_messages(messages: Column, answer: Column, template: str) -> Column:
    """Messages whose last one gets the template, with {answer} filled in, as one more text part."""
    hint = F.replace(F.lit(template), F.lit("{answer}"), answer)
    return F.transform(messages, lambda m, k: F.struct(m["role"].alias("role"), F.when(k == F.size(messages) - 1, F.array_append(F.coalesce(m["content"], F.array().cast(PARTS)), part(F.lit("text"), hint, F.lit(None)))).otherwise(m["content"]).alias("content")))


def reprompted_messages(messages: Column, prompt: Column, solution: Column, feedback: Column, reprompt: str, solution_template: str, feedback_template: str, feedback_only_without_solution: bool = False) -> Column:
    """Messages of plain texts whose last one asks anew: by the template reprompt over the prompt, a solution's and a feedback's section; the prompt itself with neither."""
    with_feedback = feedback.isNotNull() & (solution.isNull() if feedback_only_without_solution else F.lit(True))
    section = lambda there, template, name, value: F.when(there, F.replace(F.lit(template), F.lit("{" + name + "}"), value)).otherwise("")
    parts = {"{prompt}": prompt, "{solution}": section(solution.isNotNull(), solution_template, "successful_previous_attempt", solution), "{feedback}": section(with_feedback, feedback_template, "feedback_raw", feedback)}
    pieces = [parts.get(p, F.lit(p)) for p in re.split(r"(\{prompt\}|\{solution\}|\{feedback\})", reprompt) if p]  # at once: what is put in isn't looked at again
    asked = F.when(with_feedback | solution.isNotNull(), F.concat(*pieces)).otherwise(prompt)
    rest = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.array_append(rest, F.struct(F.lit("user").alias("role"), asked.alias("content")))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def loss_masked(turns: DataFrame, tokens=whitespace_tokens, prefix: int = 1, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """tokens and loss_mask of each conversation: a turn is `prefix` role tokens, then its text's; loss is taken on
    the texts of assistant turns alone."""
    text = tokens(F.col("text"))
    ids = F.concat(F.array_repeat(F.concat(F.lit("<"), F.col("role"), F.lit(">")), prefix), text)
    mask = F.concat(F.array_repeat(F.lit(0), prefix), F.transform(text, lambda _: F.when(F.col("role") == "assistant", 1).otherwise(0)))
    rows = turns.select(conv, turn, ids.alias("t"), mask.alias("m"))
    got = rows.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "t", "m"))).alias("r"))
    return got.select(conv, F.flatten(F.transform("r", lambda x: x["t"])).alias("tokens"), F.flatten(F.transform("r", lambda x: x["m"])).alias("loss_mask"))


def preference_pack(prompt: Column, chosen: Column, rejected: Column, length: int, pad: int = 0) -> Column:
    """[prompt + chosen, prompt + rejected], each cut and filled on the right to `length`."""
    from ..functions import sequences as S

    one = lambda answer: S.pad(S.truncate(F.concat(prompt, answer), length), length, pad)
    return F.array(one(chosen), one(rejected))


def last_assistant(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The text of each conversation's last assistant turn."""
    return turns.groupBy(conv).agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col(turn))).alias("text"), F.count_if(F.col("role") == "assistant").alias("answers"))


def best_so_far(calls: DataFrame, instance: str, order: str, reward: str) -> DataFrame:
    """A tool's reward a call: 0 if it betters the instance's best so far, else -0.05."""
    from pyspark.sql import Window

    w = Window.partitionBy(instance).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max(reward).over(w), F.lit(0.0))
    return calls.withColumn("tool_reward", F.when(F.col(reward) > best, 0.0).otherwise(-0.05))
