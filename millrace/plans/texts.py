"""Queries over text graders (survey block 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import query
from .tables import table

#: Answers in all formats, a literal for each document; the same text in both dialects.
ANSWER = """CASE doc_id % 14
 WHEN 0 THEN '<think>maybe A</think><answer>(B) yes</answer>' WHEN 1 THEN 'Answer: B' WHEN 2 THEN 'I think it is C) because'
 WHEN 3 THEN ' [API_ERROR] timeout' WHEN 4 THEN '  ' WHEN 5 THEN '**Answer: Yes.**' WHEN 6 THEN 'No, it is not (a)'
 WHEN 7 THEN 'well, the answer is (D), or E' WHEN 8 THEN 'so #### 1,234' WHEN 9 THEN 'x = 3.5 and then -7.'
 WHEN 10 THEN '<answer>The cat, sat</answer> then <answer>A dog!</answer>' WHEN 11 THEN 'it must be, yes'
 WHEN 12 THEN concat('<answer> ', substr('ABCD', CAST(doc_id % 4 + 1 AS INT), 1), ' </answer>')
 ELSE '{"a": {"b": 1}} and <tool_call>{"name": "find"}</tool_call>' END"""
GOLD = "substr('ABCDE', CAST({id} % 5 + 1 AS INT), 1)"
#: Beside the literals, all documents and all turns of conversations are graded as whole texts.
ROWS = [
    ("documents", ["doc_id", "'made' AS origin", "lang", "text", f"{ANSWER} AS answer", f"{GOLD.format(id='doc_id')} AS gold"]),
    ("documents", ["doc_id", "'text' AS origin", "lang", "text", "text AS answer", f"{GOLD.format(id='doc_id')} AS gold"]),
    ("conversations", ["conv_id * 10000 + turn AS doc_id", "'turn' AS origin", "role AS lang", "text", "text AS answer", f"{GOLD.format(id='(conv_id + turn)')} AS gold"]),
]
UNION = " UNION ALL ".join(f"SELECT {', '.join(columns)} FROM {name}" for name, columns in ROWS)
BASE = f"ans AS (SELECT doc_id, origin, lang, coalesce(text, '') AS text, coalesce(answer, '') AS answer, gold FROM ({UNION}))"
#: Unicode white space, and the text without it at its ends.
WS = "[\\t-\\r \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Letters, digits, marks and connectors: what a word boundary parts from the rest.
WORD = "\\pL\\pN\\pM_"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def answers(spark, sf_dir):
    made, whole, turn = (table(spark, sf_dir, name).selectExpr(*columns) for name, columns in ROWS)
    return made.union(whole).union(turn)


def text_query(name: str, sql: str, columns, before: str = ""):
    """doc_id, origin and some columns of the answers; sql: the same columns."""

    @query(name, f"WITH {BASE}{before} SELECT doc_id, origin, {sql} FROM {'step' if before else 'ans'}")
    def run(spark, sf_dir):
        rows = answers(spark, sf_dir).withColumn("question_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")))
        return rows.select("doc_id", "origin", *[c.alias(n) for n, c in columns().items()])

    return run


UNWRAP = f""",
 think AS (SELECT *, regexp_replace(answer, '^(?s:.*)</think>', '') AS t FROM ans),
 tag AS (SELECT *, CASE WHEN strpos(t, '<answer>') > 0 AND strpos(list_last(string_split(t, '<answer>')), '</answer>') > 0
   THEN string_split(list_last(string_split(t, '<answer>')), '</answer>')[1] ELSE t END AS u FROM think),
 step AS (SELECT *, {stripped("regexp_replace(u, '^(?s:.*)Answer:', '')")} AS body FROM tag)"""
RETRY = f"({stripped('answer')} = '' OR regexp_matches(answer, '^{WS}*\\[(API|FUTURE)_ERROR\\]'))"
text_query("text_unwrap", "body", lambda: {"body": T.unwrap("answer")}, UNWRAP)
text_query("text_predicted_letter", f"CASE WHEN NOT {RETRY} THEN nullif(regexp_extract(body, '(?:^|[^A-Za-z])([A-E])(?:[^A-Za-z]|$)', 1), '') END AS letter", lambda: {"letter": T.predicted_letter("answer")}, UNWRAP)
text_query("text_should_retry", f"{RETRY} AS retry", lambda: {"retry": T.should_retry("answer")})
OPTION = "coalesce(nullif(regexp_extract({x}, '\\(([A-Z])\\)', 1), ''), nullif(regexp_extract({x}, '([A-Z])[\\.\\)\\s\\x0B]', 1), ''), regexp_extract({x}, '([A-Z])', 1))"
GOLD_OPTION = "regexp_extract({x}, '^[ (\\[]*([A-F])(?:$|[\\.\\)\\]]|[\\:\\-][\\s\\x0B]+)', 1)"
text_query("text_first_option", OPTION.format(x="answer") + " AS option", lambda: {"option": T.first_option("answer")})
text_query("text_gold_option", GOLD_OPTION.format(x=stripped("answer").replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}") + " AS option", lambda: {"option": T.gold_option("answer")})
text_query("text_letter_match", f"gold = {OPTION.format(x='answer')} AS matched", lambda: {"matched": T.letter_match("gold", "answer")})
START, END = "strpos(answer, '<answer>')", "strpos(answer, '</answer>')"
PART = f"""CASE WHEN {START} > 0 AND {END} >= {START} + 8 THEN substr(answer, {START} + 8, {END} - {START} - 8)
   WHEN {START} > 0 AND {END} > 0 THEN '' WHEN strpos(answer, 'Answer:') > 0 THEN substr(answer, strpos(answer, 'Answer:')) ELSE answer END"""
JUDGED = f""",
 step AS (SELECT *, {stripped(PART)} AS part FROM ans)"""
text_query("text_judged_part", "part", lambda: {"part": T.judged_part("answer")}, JUDGED)
text_query("text_grade_letters", f"part, CASE WHEN part = gold THEN 'mathruler' WHEN gold = {OPTION.format(x='part')} THEN 'first letter' ELSE 'llm' END AS source", lambda: {"part": T.judged_part("answer"), "source": T.graded(F.lit("vstar"), "gold", "answer")["judge_source"]}, JUDGED)
ALONE = f"(?:^|[^{WORD}])({{x}})(?:[^{WORD}]|$)"
AB, YN = ALONE.format(x="[ab]"), "(?i)" + ALONE.format(x="yes|no")
text_query("text_two_choice", f"CASE WHEN regexp_matches(lower(answer), '\\(([ab])\\)') THEN '(' || regexp_extract(lower(answer), '\\(([ab])\\)', 1) || ')' WHEN regexp_matches(lower(answer), '{AB}') THEN '(' || regexp_extract(lower(answer), '{AB}', 1) || ')' ELSE '' END AS choice", lambda: {"choice": T.two_choice("answer")})
YES = f""",
 a AS (SELECT *, {stripped("regexp_replace(answer, '^[*]+', '')")} AS t FROM ans),
 b AS (SELECT *, CASE WHEN lower(t) LIKE 'answer%' THEN {stripped("regexp_replace(regexp_replace(substr(t, 7), '^:+', ''), '^[*]+', '')")} ELSE t END AS t2 FROM a),
 step AS (SELECT *, lower(regexp_replace(list_last(regexp_split_to_array({stripped("regexp_replace(regexp_replace(t2, '[.]+$', ''), '[*]+$', '')")}, '{WS}+')), '^[*]+|[*]+$', '', 'g')) AS tail FROM b)"""
text_query("text_yes_no", f"CASE WHEN lower(t2) LIKE 'yes%' THEN 'yes' WHEN lower(t2) LIKE 'no%' THEN 'no' WHEN tail IN ('yes', 'no') THEN tail ELSE {stripped('answer')} END AS said", lambda: {"said": T.yes_no("answer")}, YES)
text_query("text_verdict", f"CASE WHEN regexp_matches(t, '{YN}') THEN CASE lower(regexp_extract(t, '{YN}', 1)) WHEN 'yes' THEN 'Yes' ELSE 'No' END ELSE {stripped('t')} END AS verdict", lambda: {"verdict": T.verdict("answer")}, ",\n step AS (SELECT *, regexp_replace(answer, '^(?s:.*)</think>', '') AS t FROM ans)")
FREE = f"regexp_replace(regexp_replace(regexp_replace({stripped('lower(answer)')}, '[^a-z0-9{WS[1:-1]}]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '{WS}+', ' ', 'g')"
text_query("text_free_form", stripped(FREE) + " AS form", lambda: {"form": T.free_form("answer")})
text_query("text_number_strict", "CASE WHEN regexp_matches(right(answer, 300), '#### (\\-?[0-9\\.\\,]+)') THEN replace(list_last(regexp_extract_all(right(answer, 300), '#### (\\-?[0-9\\.\\,]+)', 1)), ',', '') END AS number", lambda: {"number": T.number_answer("answer")})
text_query("text_number_flexible", "CASE WHEN len(n) > 0 THEN coalesce(list_last(list_filter(n, lambda x: x NOT IN ('', '.'))), n[1]) END AS number", lambda: {"number": T.number_answer("answer", flexible=True)}, ",\n step AS (SELECT *, regexp_extract_all(right(answer, 300), '(\\-?[0-9\\.\\,]+)', 1) AS n FROM ans)")
text_query("text_number_score", "CASE WHEN replace(list_last(n), ',', '') = '1234' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score", lambda: {"score": T.number_score("answer", F.lit("1234"))}, ",\n step AS (SELECT *, regexp_extract_all(right(answer, 300), '#### (\\-?[0-9\\.\\,]+)', 1) AS n FROM ans)")
TAGGED = ",\n tags AS (SELECT *, regexp_extract_all(answer, '(?s)<answer>(.*?)</answer>', 1) AS f FROM ans),\n step AS (SELECT *, CASE WHEN len(f) > 0 THEN " + stripped("list_last(f)") + " END AS tagged FROM tags)"
text_query("text_tagged_answer", "tagged", lambda: {"tagged": T.tagged_answer("answer")}, TAGGED)
PUNCTUATION = "[!-/:-@\\[-`{-~]"
QA = f"{TAGGED}, forms AS (SELECT *, {stripped(f"regexp_replace(regexp_replace(regexp_replace(lower(tagged), '{PUNCTUATION}', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '{WS}+', ' ', 'g')")} AS form FROM step)".replace(" step AS", " tagged_ AS").replace("FROM step)", "FROM tagged_)").replace("forms AS", "step AS")
text_query("text_qa_scores", "CASE WHEN coalesce(form IN ('dog', 'bird'), FALSE) THEN CASE WHEN len(string_split(answer, '<answer>')) > 11 OR len(string_split(answer, '</answer>')) > 11 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS em, CASE WHEN coalesce(contains(form, 'dog'), FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sub", lambda: {"em": T.qa_score("answer", F.array(F.lit("the Dog"), F.lit("bird"))), "sub": T.qa_score("answer", F.array(F.lit("dog")), contained=True)}, QA)
text_query("text_xml_answer", stripped("string_split(list_last(string_split(answer, '<answer>')), '</answer>')[1]") + f" AS pred, regexp_matches(answer, '<answer>{WS}*(A|B|C|D){WS}*</answer>\\n?$') AS good_format", lambda: {"pred": T.xml_answer("answer"), "good_format": T.xml_format_ok("answer")})
text_query("text_is_correct", "lower(trim(answer)) = 'yes' AS correct, lower(trim('Yes ')) = 'yes' AS always", lambda: {"correct": T.is_correct("answer"), "always": T.is_correct(F.lit("Yes "))})
text_query("text_hint_error", "CASE WHEN length(h) < 100 THEN '[ERR:too-short:' || length(h) || ']' ELSE h END AS hint, length(h) >= 100 AND NOT starts_with(answer, '[ERR:') AS usable", lambda: {"hint": T.hint_error("answer"), "usable": T.hint_is_usable("answer")}, f",\n step AS (SELECT *, {stripped('answer')} AS h FROM ans)")
text_query("text_without_trace", stripped("regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g')") + " AS plain", lambda: {"plain": T.without_trace("answer")})
#: Neighbouring letters share the sign between them, so signs are doubled before single letters are looked for.
SPACED = f"regexp_replace({{x}}, '([^{WORD}])', '\\1\\1', 'g')"
LONE = f"list_last(regexp_extract_all({SPACED}, '{ALONE.format(x='{letters}')}', 1))"
lone = lambda x, letters: LONE.replace("{x}", x).replace("{letters}", letters)
text_query("text_letter_last", f"regexp_replace(regexp_replace(coalesce({lone('upper(answer)', '[A-D]')}, regexp_replace({stripped('answer')}, '^[.]+|[.]+$', '', 'g')), '[.]+$', ''), '/+$', '') AS pred", lambda: {"pred": T.letter_last("answer")})
text_query("text_ten_choice", f"coalesce(nullif(regexp_extract(answer, '(?i)answer is \\(?([A-J])\\)?', 1), ''), nullif(regexp_extract(answer, '(?i)Answer:{WS}*([A-J])', 1), ''), {lone('answer', '[A-J]')}, '') AS pred", lambda: {"pred": T.ten_choice("answer")})
text_query(
    "text_model_answer",
    stripped("CASE WHEN u <> answer THEN u WHEN strpos(answer, 'Answer:') > 0 THEN substr(answer, strpos(answer, 'Answer:')) ELSE answer END") + " AS part",
    lambda: {"part": T.model_answer("answer")},
    ",\n step AS (SELECT *, CASE WHEN strpos(answer, '<answer>') > 0 AND strpos(list_last(string_split(answer, '<answer>')), '</answer>') > 0 THEN string_split(list_last(string_split(answer, '<answer>')), '</answer>')[1] ELSE answer END AS u FROM ans)",
)
MIXED_PART = f"""CASE WHEN {START} > 0 AND {END} >= {START} + 8 THEN substr(answer, {START} + 8, {END} - {START} - 8)
   WHEN strpos(answer, 'Answer:') > 0 THEN substr(answer, strpos(answer, 'Answer:') + 7) ELSE answer END"""
text_query(
    "text_mixed_score",
    f"CASE WHEN mine = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN mine <> '' THEN mine ELSE part END AS pred, 'mcq_rule' AS judge_source",
    lambda: {n: T.mixed_score("answer", "gold", F.lit("mcq"))[n] for n in ("score", "pred", "judge_source")},
    f",\n parts AS (SELECT *, {stripped(MIXED_PART)} AS part FROM ans),\n step AS (SELECT *, {OPTION.format(x='part')} AS mine FROM parts)",
)
PARSED = "TRY_CAST(replace(nullif(regexp_extract(replace({x}, '−', '-'), '-?[0-9]+(?:,[0-9][0-9][0-9])*(?:\\.[0-9]+)?'), ''), ',', '') AS DECIMAL(38, 18))"
text_query("text_parsed_number", PARSED.format(x="answer") + "::DOUBLE AS number", lambda: {"number": T.parsed_number("answer").cast("double")})
text_query("text_outer_json", "CASE WHEN strpos(answer, '{') > 0 AND length(answer) - strpos(reverse(answer), '}') + 1 > strpos(answer, '{') AND strpos(answer, '}') > 0 THEN substr(answer, strpos(answer, '{'), length(answer) - strpos(reverse(answer), '}') + 2 - strpos(answer, '{')) END AS found", lambda: {"found": T.outer_json("answer")})


def acted():
    """An answer between two actions, or before one."""
    return F.concat(F.when(F.col("doc_id") % 2 == 0, "Action: find\nAction Input: {}\n").otherwise(""), T.text("answer"), F.lit("\nAction: open"))


text_query("text_actions", f"array_to_string(regexp_extract_all(said, 'Action:{WS}*([{WORD}]+)', 1), ',') AS names, regexp_matches(said, '(?s)Action:.*?\\nAction Input:') AS good_format", lambda: {"names": F.array_join(T.actions(acted()), ","), "good_format": T.action_format_ok(acted())}, ",\n step AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Action: find' || chr(10) || 'Action Input: {}' || chr(10) ELSE '' END || answer || chr(10) || 'Action: open' AS said FROM ans)")
text_query("text_tool_calls", "CASE WHEN doc_id % 2 = 0 THEN 'search' END AS name, regexp_replace(answer || 'done ', '(?s)<tool_call>.*?</tool_call>', '', 'g') AS rest", lambda: {"name": F.try_element_at(T.tool_calls(F.concat(F.lit("done "), F.when(F.col("doc_id") % 2 == 0, '<tool_call>{"name": "search", "arguments": {"q": 1}}</tool_call>').otherwise("<tool_call>{bad</tool_call>"))), F.lit(1))["name"], "rest": T.without_tool_calls(F.concat(T.text("answer"), F.lit("done <tool_call>{bad</tool_call>")))})
text_query("text_passages", "'Doc 1 (Title: ' || lang || ')' || chr(10) || answer || chr(10) || chr(10) || 'Doc 2 (Title: x)' || chr(10) || 'y' || chr(10) || chr(10) AS shown", lambda: {"shown": T.passages(F.array("lang", F.lit("x")), F.array(T.text("answer"), F.lit("y")))})
text_query("text_sample_uid", "CASE WHEN doc_id % 2 = 0 THEN 'b:question_id:' || doc_id ELSE 'b:sha1:' || sha1('{\"gold\": \"' || gold || '\", \"lang\": \"' || lang || '\"}') END AS uid", lambda: {"uid": T.sample_uid(F.lit("b"), ["question_id"], ["lang", "gold"])})
