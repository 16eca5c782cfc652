"""Text graders and extractors as Column expressions.

Patterns that must equal the graders' own are stated as they are.  Blanks are Unicode white
space, as in the graders.  Nulls give the empty string or null, as each function says.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .braces import bound

#: Markers, and the patterns of the answer formats.
THINK_END, OPEN, CLOSE, MARK = "</think>", "<answer>", "</answer>", "Answer:"
ERRORS = ("[API_ERROR]", "[FUTURE_ERROR]")
LETTER = r"(?<![A-Za-z])([A-E])(?![A-Za-z])"
OPTION = (r"\(([A-Z])\)", r"([A-Z])[\.\)\s]", r"([A-Z])")
GOLD_OPTION = r"^[ (\[]*([A-F])(?:(?=$)|[\.\)\]]|(?:[\:\-]\s+))"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
CLIP_CHARS = 300
#: Unicode white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(WHITE))


def find(x: Column, part: str) -> Column:
    """Position counted from 1, 0 if the part isn't there."""
    return F.instr(x, part)


def find_last(x: Column, part: str) -> Column:
    back = F.instr(F.reverse(x), part[::-1])
    return F.when(back > 0, F.length(x) - back - len(part) + 2).otherwise(0)


def after(x: Column, at: Column, part: str) -> Column:
    return F.substring(x, at + len(part), F.length(x))


def without_thoughts(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)^.*</think>", "")


def between_last(x: Column) -> Column:
    """What the last opened answer holds, if it is closed; else the text."""
    start = find_last(x, OPEN)
    rest = after(x, start, OPEN)
    end = find(rest, CLOSE)
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1)).otherwise(x)


def unwrap(answer) -> Column:
    """The deciding part: behind thoughts, in the last answer tag, behind the last mark."""
    return strip(F.regexp_replace(between_last(without_thoughts(text(answer))), r"(?s)^.*Answer:", ""))


def is_error(answer) -> Column:
    start = F.regexp_replace(text(answer), r"(?U)^\s+", "")
    return F.coalesce(start.startswith(ERRORS[0]) | start.startswith(ERRORS[1]), F.lit(False))


def should_retry(answer) -> Column:
    """Null, blank or an error: to be asked again."""
    return col(answer).isNull() | (strip(text(answer)) == "") | is_error(answer)


def first_group(x: Column, pattern: str, group: int = 1) -> Column:
    """Null where the pattern isn't found.  The group must not be able to match nothing."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def predicted_letter(answer) -> Column:
    """The first standalone A to E of the deciding part; null for blanks and errors.  The article "A" counts."""
    return F.when(~should_retry(answer), first_group(unwrap(answer), LETTER))


def first_option(x) -> Column:
    """A letter in parentheses, else before a sign or blank, else any capital; empty if there is none."""
    x = text(x)
    return F.coalesce(*[first_group(x, p) for p in OPTION], F.lit(""))


def gold_option(x) -> Column:
    return F.coalesce(first_group(strip(text(x)), GOLD_OPTION), F.lit(""))


def letter_match(gold, answer) -> Column:
    g = gold_option(gold)
    return (g != "") & (g == first_option(answer))


def yes_no(x) -> Column:
    """yes or no by prefix, then by last word; else the trimmed text."""
    begins = lambda t, word: F.lower(F.left(t, F.lit(len(word)))) == word
    marked = lambda t: strip(F.regexp_replace(F.regexp_replace(F.substring(t, F.lit(7), F.length(t)), "^:+", ""), r"^\*+", ""))

    def said(r):
        tail = strip(F.regexp_replace(F.regexp_replace(r["t"], r"\.+$", ""), r"\*+$", ""))
        last = F.lower(F.regexp_replace(F.element_at(F.split(tail, r"(?U)\s+"), -1), r"^\*+|\*+$", ""))
        return F.when(begins(r["t"], "yes"), "yes").when(begins(r["t"], "no"), "no").otherwise(bound(last, lambda w: F.when(w.isin("yes", "no"), w).otherwise(strip(r["raw"]))))

    start = lambda raw: bound(strip(F.regexp_replace(raw, r"^\*+", "")), lambda t: F.when(begins(t, "answer"), marked(t)).otherwise(t))
    return bound(text(x), lambda raw: bound(F.struct(raw.alias("raw"), start(raw).alias("t")), said))


def two_choice(x) -> Column:
    """(a) or (b), in parentheses or standing alone; else empty."""
    found = lambda t: F.coalesce(first_group(t, r"\(([ab])\)"), first_group(t, r"(?U)\b([ab])\b"))
    return bound(bound(F.lower(strip(text(x))), found), lambda f: F.when(f.isNotNull(), F.concat(F.lit("("), f, F.lit(")"))).otherwise(""))


def judged_part(x, keep_mark: bool = True) -> Column:
    """The first answer tag's content (closed by the first closing tag), else from the first mark on, else the text."""
    x = text(x)
    start, end = find(x, OPEN), find(x, CLOSE)
    mark = find(x, MARK)
    inside = F.when(end >= start + len(OPEN), F.substring(x, start + len(OPEN), end - start - len(OPEN))).otherwise("")
    marked = F.substring(x, mark, F.length(x)) if keep_mark else after(x, mark, MARK)
    closed = (start > 0) & (end > 0) & (F.lit(True) if keep_mark else end > start)
    return strip(F.when(closed, inside).when(mark > 0, marked).otherwise(x))


def model_answer(x) -> Column:
    """The last answer tag's content, else from the first mark on, else the text."""
    x = text(x)
    inner = between_last(x)
    mark = find(x, MARK)
    return strip(F.when(inner != x, inner).when(mark > 0, F.substring(x, mark, F.length(x))).otherwise(x))


def verdict(x) -> Column:
    """Yes or No, the first one behind the thoughts; else the text."""
    body = strip(without_thoughts(strip(text(x))))
    return F.coalesce(F.initcap(first_group(body, r"(?iU)\b(yes|no)\b")), body)


def is_correct(judge) -> Column:
    return F.lower(F.trim(text(judge))) == "yes"


def graded(kind, gold, answer) -> Column:
    """struct<judge, judge_source, extracted_answer>: the rules in turn; what none decides is left to a model (source "llm", judge null)."""
    part = judged_part(answer)
    k = F.lower(text(kind))
    answer_of = lambda ok, source: F.struct(F.when(ok, "Yes").otherwise("No").alias("judge"), F.lit(source).alias("judge_source"), part.alias("extracted_answer"))
    left = F.struct(F.lit(None).cast("string").alias("judge"), F.lit("llm").alias("judge_source"), part.alias("extracted_answer"))
    return F.when(k == "pope", answer_of(yes_no(part) == F.lower(strip(text(gold))), "pope_exact")).when(k == "mmvp", answer_of((two_choice(part) != "") & (two_choice(part) == two_choice(gold)), "mmvp_option")).when(strip(part) == strip(text(gold)), answer_of(F.lit(True), "mathruler")).when(letter_match(gold, part), answer_of(F.lit(True), "first letter")).otherwise(left)


def free_form(x) -> Column:
    """Lower case, ASCII letters and digits alone, no articles, single blanks."""
    x = F.regexp_replace(strip(F.lower(text(x))), r"(?U)[^a-z0-9\s]", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def qa_form(x) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    x = F.translate(F.lower(text(x)), string.punctuation, "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def exact_match(prediction, golds) -> Column:
    p = qa_form(prediction)
    return F.exists(col(golds), lambda g: qa_form(g) == p)


def contained_match(prediction, golds) -> Column:
    p = qa_form(prediction)
    return F.exists(col(golds), lambda g: F.contains(p, qa_form(g)))


def tagged_answer(x) -> Column:
    """The last tagged answer, trimmed; null if there is none."""
    found = F.regexp_extract_all(text(x), F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


def occurrences(x: Column, part: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def qa_score(x, golds, contained: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    """score for a match of the last tagged answer, a quarter of it for more than ten tags of a kind (exact matches), format_score for another answer, 0 for none."""
    answer, raw = tagged_answer(x), text(x)
    hit = contained_match(answer, golds) if contained else exact_match(answer, golds)
    many = (occurrences(raw, OPEN) > 10) | (occurrences(raw, CLOSE) > 10)
    value = F.lit(score) if contained else F.when(many, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(hit, value).otherwise(format_score)


def number_answer(x, flexible: bool = False) -> Column:
    """Of the last 300 characters: the last "#### n" without commas, or the last number that isn't a lone point."""
    tail = text(x)
    tail = F.when(F.length(tail) > CLIP_CHARS, F.substring(tail, -CLIP_CHARS, CLIP_CHARS)).otherwise(tail)
    if not flexible:
        found = F.regexp_extract_all(tail, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1))
        return F.when(F.size(found) > 0, F.translate(F.element_at(found, -1), ",$", ""))
    found = F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    good = F.filter(found, lambda v: ~v.isin("", "."))
    return F.when(F.size(good) > 0, F.element_at(good, -1)).when(F.size(found) > 0, F.element_at(found, 1))


def number_score(x, gold, flexible: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    answer = number_answer(x, flexible)
    return F.when(answer.isNull(), 0.0).when(answer == text(gold), score).otherwise(format_score)


def letter_last(x) -> Column:
    """The last standalone A to D in upper case, else the text without its outer points."""
    found = F.regexp_extract_all(F.upper(text(x)), F.lit(r"(?U)\b(A|B|C|D)\b"), F.lit(1))
    rest = F.regexp_replace(strip(text(x)), r"^\.+|\.+$", "")
    return F.regexp_replace(F.regexp_replace(F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise(rest), r"\.+$", ""), "/+$", "")


def xml_answer(x) -> Column:
    return strip(F.element_at(F.split(F.element_at(F.split(text(x), OPEN), -1), CLOSE), 1))


def xml_format_ok(x) -> Column:
    return F.rlike(text(x), F.lit(r"(?U)<answer>\s*(A|B|C|D)\s*</answer>\n?\z"))


def ten_choice(x) -> Column:
    """"answer is X", else "Answer: X", else the last standalone A to J; empty if there is none."""
    x = text(x)
    alone = F.regexp_extract_all(x, F.lit(r"(?U)\b([A-J])\b"), F.lit(1))
    return F.coalesce(first_group(x, r"(?iU)answer is \(?([A-J])\)?"), first_group(x, r"(?iU)Answer:\s*([A-J])"), F.try_element_at(alone, F.lit(-1)), F.lit(""))


def actions(x) -> Column:
    return F.regexp_extract_all(text(x), F.lit(r"(?U)Action:\s*(\w+)"), F.lit(1))


def same_actions(a, b) -> Column:
    return F.array_sort(actions(a)) == F.array_sort(actions(b))


def action_format_ok(x) -> Column:
    return F.rlike(text(x), F.lit(r"(?s)Action:.*?\nAction Input:"))


def parsed_number(x) -> Column:
    """The first number, as a decimal; null if there is none."""
    found = first_group(F.replace(text(x), F.lit("−"), F.lit("-")), NUMBER, 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("decimal(38,18)")


def plain_form(x) -> Column:
    """Lower case, no ASCII punctuation, single blanks."""
    return strip(F.regexp_replace(F.translate(F.lower(strip(text(x))), string.punctuation, ""), r"(?U)\s+", " "))


def mixed_score(x, gold, question_type) -> Column:
    """struct<score, pred, judge_source>: option letters for multiple choice, else numbers, else the plain form."""
    part = judged_part(x, keep_mark=False)
    mine, right = first_option(part), gold_option(gold)
    a, b = parsed_number(part), parsed_number(gold)
    one = lambda ok, pred, source: F.struct(F.when(ok, 1.0).otherwise(0.0).alias("score"), pred.alias("pred"), F.lit(source).alias("judge_source"))
    mcq = F.lower(strip(text(question_type))) == "mcq"
    return F.when(mcq, one((mine != "") & (right != "") & (mine == right), F.when(mine != "", mine).otherwise(part), "mcq_rule")).when(a.isNotNull() & b.isNotNull(), one(a == b, part, "numeric_rule")).otherwise(one(plain_form(part) == plain_form(gold), part, "normalized_em"))


def without_trace(x) -> Column:
    """The text without <think> ... </think>."""
    return strip(F.regexp_replace(text(x), r"(?s)<think>.*?</think>", ""))


def hint_error(x, least: int = 100) -> Column:
    """[ERR:too-short:n] in place of a hint of fewer characters."""
    x = strip(text(x))
    return F.when(F.length(x) < least, F.concat(F.lit("[ERR:too-short:"), F.length(x).cast("string"), F.lit("]"))).otherwise(x)


def hint_is_usable(x, least: int = 100) -> Column:
    x = text(x)
    return ~x.startswith("[ERR:") & (F.length(strip(x)) >= least)


def outer_json(x) -> Column:
    """From the first { to the last }; null without them."""
    x = text(x)
    a, b = find(x, "{"), find_last(x, "}")
    return F.when((a > 0) & (b > a), F.substring(x, a, b - a + 1))


def tool_calls(x) -> Column:
    """array<struct<name, arguments>> of the well-formed <tool_call> blocks; arguments as JSON text."""
    found = F.regexp_extract_all(text(x), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(found, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_tool_calls(x) -> Column:
    return F.regexp_replace(text(x), r"(?s)<tool_call>.*?</tool_call>", "")


# The marks of the channel format's thoughts and calls.
THOUGHT = r"(?s)(<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>"
CALL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def channel_calls(x) -> Column:
    """array<struct<name, arguments>> of the calls outside thoughts; arguments as they are, JSON or not."""
    said = F.regexp_replace(text(x), THOUGHT, "")
    names, arguments = (F.regexp_extract_all(said, F.lit(CALL), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(names.alias("name"), arguments.alias("arguments"))


def without_channel_calls(x) -> Column:
    """The text without thoughts and calls."""
    return F.regexp_replace(F.regexp_replace(text(x), THOUGHT, ""), CALL, "")


def passages(titles, bodies) -> Column:
    """"Doc i (Title: t)" and the passage, each on its line."""
    z = F.arrays_zip(col(titles).alias("t"), col(bodies).alias("b"))
    return F.array_join(F.transform(z, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), d["t"], F.lit(")\n"), d["b"], F.lit("\n\n"))), "")


def sample_uid(benchmark, keys: list[str], row: list[str]) -> Column:
    """benchmark:key:value of the first key that isn't empty; else the SHA-1 of the row's sorted JSON."""
    first = [F.when(text(k) != "", F.concat(text(benchmark), F.lit(f":{k}:"), text(k))) for k in keys]
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.to_json(F.array(text(k))).substr(F.lit(2), F.length(F.to_json(F.array(text(k)))) - 2)) for k in sorted(row)]), F.lit("}"))
    return F.coalesce(*first, F.concat(text(benchmark), F.lit(":sha1:"), F.sha1(whole)))


def options_of(x) -> Column:
    """map of letter to option text of a question with at least two labelled options; else null."""
    found = F.regexp_extract_all(text(x), F.lit(r"(?sU)\b([A-F])[\.\)]\s*(.*?)(?=\s*\b[A-F][\.\)]|\z)"), F.lit(0))
    letters = F.transform(found, lambda o: F.substring(o, 1, 1))
    bodies = F.transform(found, lambda o: strip(F.regexp_replace(strip(F.regexp_replace(o, r"^[A-F][\.\)]\s*", "")), r"[,;]+$", "")))
    return F.when((F.size(found) >= 2) & (F.size(F.array_distinct(letters)) == F.size(letters)), F.map_from_arrays(letters, bodies))
