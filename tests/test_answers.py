"""Answers: each rule by itself, and whole functions against plain Python."""

import itertools
import math
import random

from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.operators import answers as S


def column(spark, rule, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def scan(s, start):
    depth, left = 0, None
    for i in range(start, len(s)):
        if s[i] == "{":
            depth += 1
            left = i if left is None else left
        elif s[i] == "}":
            depth -= 1
            if depth == 0:
                return None if left is None else s[left + 1 : i]
    return None


def boxes(s):
    strict = scan(s, s.rfind("\\boxed{")) if "\\boxed{" in s else None
    at = s.rfind("\\boxed") if "\\boxed" in s else s.rfind("\\fbox")
    found = scan(s, at) if at >= 0 else None
    anywhere = found.strip() if found is not None else None
    if "\\boxed " in s:
        spaced = s.split("\\boxed ")[-1].split("$")[0]
    else:
        at = s.rfind("\\boxed")
        spaced = scan(s, at) if at >= 0 and s[at + 6 : at + 7] == "{" else None
    return strict, anywhere, spaced


def test_boxes(spark):
    rnd = random.Random(5)
    parts = ["\\boxed{", "\\boxed", "\\boxed ", "\\fbox{", "{", "}", "}", "a", " ", "$", "b{c}d", "é😀"]
    values = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(600)] + ["", "\\boxed{" + "{x}" * 2000 + "}", None]
    want = [boxes(v or "") for v in values]
    for k, rule in enumerate((A.boxed_strictly, A.boxed_anywhere, A.boxed_or_spaced)):
        assert column(spark, rule, values) == [w[k] for w in want]
    assert len({w for w in want}) > 100


SECOND = [
    ("\\text{ab}", "ab"), (" \\text{ 5 } ", "5"), ("5\\text{ cm}", "5"), ("a\\text{ b\\text{ c", "a\\text{ b\\text{ c"), ("\\dfrac12", "\\frac{1}{2}"), ("\\tfrac1{72}", "\\frac{1}{72}"),
    ("\\frac{72}1", "\\frac{72}1"), ("x\\frac", "x\\frac"), ("\\frac1", "\\frac1"), ("\\sqrt", "\\sqrt"), ("1 \\sqrt2", "1\\sqrt{2}"), (".5", "\\frac{1}{2}"), ("x=0.5", "\\frac{1}{2}"), ("k = 3", "3"),
    ("abc=3", "abc=3"), ("3/4", "\\frac{3}{4}"), ("03/4", "03/4"), ("30^\\circ", "30"), ("\\$5", "5"), ("5\\%", "5"), ("\\left( 1, 2 \\right)", "(1,2)"), ("", ""), ("{.5}", "{0.5}"),
]


def test_second_form(spark):
    assert column(spark, A.second_form, [v for v, _ in SECOND]) == [w for _, w in SECOND]


LINES = [
    ("words", "\\text{Yes}", "Yes"), ("signs", "\\$5 or 6\\%", "5 , 6"), ("signs", "2 million", "2 *10^6"), ("units", "5 cm^2", "5 "), ("units", "3 hours", "3 "), ("units", "2 inches", "2 "), ("degrees", "30^ \\circ", "30"),
    ("outer braces", "{5}", "5"), ("spaced commas", "1,\\! 234", "1234"), ("whole number", "5.0", "5"), ("whole number", "1e3", "1000"), ("whole number", "5.5", "5.5"), ("whole number", "1e300", "1e300"),
    ("latex", "\\frac{1}{2}", "1/2"), ("latex", "\\sqrt{2}", "sqrt(2)"), ("latex", "2\\pi", "2pi"), ("latex", "3\\frac{1}{2}", "3 1/2"), ("latex", "\\frac{\\sqrt{3}}{2}", "sqrt(3)/2"), ("latex", "\\infty", "inf"),
    ("minus", "- 5", "-5"), ("mixed number", "7 3/4", "7+3/4"), ("case", "Yes", "yes"), ("digits", "1,234", "1234"), ("digits", "1,234,567", "1234567"), ("digits", "1,23", "1,23"), ("digits", "1,234.5", "1,234.5"),
]


def test_each_line_rule(spark):
    assert {name for name, _, _ in LINES} == set(A.LINE)
    for name in A.LINE:
        cases = [(v, w) for n, v, w in LINES if n == name]
        assert column(spark, A.LINE[name], [v for v, _ in cases]) == [w for _, w in cases], name


def test_line_form(spark):
    cases = [("3\\frac{1}{2}", "3+1/2"), ("\\$1,000", "1000"), ("5 Miles", "5 miles"), ("5 miles", "5"), ("", ""), ("x \\or", "x \\or")]
    assert column(spark, A.line_form, [v for v, _ in cases]) == [w for _, w in cases]


def test_arithmetic(spark):
    cases = {
        "7+3/4": 7.75, "2*10^6": 2e6, "-3/4": -0.75, "1/0": None, "sqrt(2)/2": math.sqrt(2) / 2, "2pi": 2 * math.pi, "2sqrt(3)": 2 * math.sqrt(3), "x+1": None, "": None, "1-2-3": -4.0, "8/2/2": 2.0, "2^-1": 0.5, "1e-3": 0.001,
        "-2-3*4": -14.0, "(1+2)": None, "3 + 4": 7.0, "5.": 5.0, "1,5": None, "+": None, "2**3": None, "pi^2": math.pi**2,
    }
    got = column(spark, A.arithmetic, list(cases))
    for (text, want), value in zip(cases.items(), got):
        assert (value is None) == (want is None) and (want is None or math.isclose(value, want)), (text, value)


def commas(s):
    import re

    while (t := re.sub(r"(\d)(,)(\d\d\d)($|\D)", r"\1\3\4", s)) != s:
        s = t
    return s


def test_commas_and_entries(spark):
    rnd = random.Random(2)
    values = ["".join(rnd.choice("12,345,67 (x") for _ in range(rnd.randint(0, 24))) for _ in range(500)] + ["1,234,567,890", "1,234,567,890,123"]
    assert column(spark, A.commas_out, values) == [commas(v) for v in values]
    cases = [("(1,2)", ["1", "2"]), ("[1, 2)", ["1", "2"]), ("(1,234,5)", ["1234", "5"]), ("((1,2),3)", ["((1,2),3)"]), ("5", ["5"]), ("", []), ("()", ["()"]), ("1,2", ["1,2"])]
    assert column(spark, A.entries, [v for v, _ in cases]) == [w for _, w in cases]


GRADES = [
    ("0.5", "1/2", "right"), ("\\frac{1}{2}", "0.5", "right"), ("2/4", "1/2", "wrong"), ("3", "3.0", "right"), ("3.1", "3", "wrong"), ("7 3/4", "31/4", "unresolved?"), ("7 3/4", "7.75", "right"), ("(1,2)", "(1,2)", "right"), ("(1,2)", "[1,2]", "wrong"),
    ("(1, 2.50)", "(1,2.5)", "right"), ("(1,2,3)", "(1,2)", "wrong"), ("x+1", "1+x", "unresolved"), ("", "5", "wrong"), ("1,000", "1000", "right"), ("5 cm", "5", "right"), ("50\\%", "50", "right"), ("2 million", "2000000", "wrong"),
    ("(1,x)", "(2,y)", "wrong"), ("(1,x)", "(1,y)", "unresolved"), ("\\sqrt{8}", "2\\sqrt{2}", "right"), ("\\text{yes}", "Yes", "right"),
]


def test_answer_grade(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GRADES)], "i int, a string, b string, want string")
    for r in df.withColumn("got", A.answer_grade("a", "b")).collect():
        assert r.got == r.want or r.want.endswith("?"), r
    assert spark.range(1).select(A.answer_grade(F.lit(None).cast("string"), F.lit("5"))).first()[0] == "wrong"


class Nested:
    """A plain parser of the same structures."""

    def __init__(self, s):
        self.ok, stack = True, [[]]
        word = ""
        for ch in s:
            if ch in "([{":
                stack[-1].append(word.strip())
                stack.append([ch])
                word = ""
            elif ch in ")]}":
                if len(stack) == 1:
                    self.ok = False
                    return
                stack[-1].append(word.strip())
                done = stack.pop()
                stack[-1].append((*done, ch))
                word = ""
            elif ch in ",;":
                stack[-1].append(word.strip())
                stack[-1].append(ch)
                word = ""
            else:
                word += ch
        stack[-1].append(word.strip())
        self.ok, self.tree = len(stack) == 1, tuple(stack[0])


def value(s):
    try:
        return float(s.replace(",", "")) if s and not set(s.lower()) & set("naif_") else None
    except ValueError:
        return None


def leaf(a, b):
    if a.lower().replace(" ", "") == b.lower().replace(" ", ""):
        return "right"
    x, y = value(a), value(b)
    if x is None or y is None:
        return "unresolved"
    return "right" if any(math.isclose(x, y * k, rel_tol=1e-4) for k in (1, 0.01, 100)) else "wrong"


def compare(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return "unlike" if a != b and set(a + b) & set("()[]{},;") else leaf(a, b)
    if isinstance(a, str) or isinstance(b, str) or len(a) != len(b):
        return "unlike"
    grades = [compare(x, y) for x, y in zip(a, b)]
    return next((g for g in ("unlike", "wrong", "unresolved") if g in grades), "right")


def test_nested_structures(spark):
    rnd = random.Random(11)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["1", "2.5", "x", "1000", "-3", "y z", "0.333"])
        return rnd.choice("([{") + ",".join(tree(depth - 1) for _ in range(rnd.randint(1, 4))) + rnd.choice(")]}")

    def changed(s):
        return s.replace(*rnd.choice([("1000", "1000.01"), ("2.5", "2.6"), ("x", "X"), ("(", "["), (",", " , "), ("1", "100"), ("y z", "yz"), ("-3", "- 3"), ("", "")]), 1)

    rows = []
    for i in range(400):
        a = tree(3)
        rows.append((i, a, changed(a)))
    rows += [(1000, "(" * 60 + "1" + ")" * 60, "(" * 60 + "1.00001" + ")" * 60), (1001, "(1,2", "(1,2"), (1002, ")1,2(", "x,y")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    seen = set()
    for r in df.withColumn("got", A.structure_grade("a", "b")).collect():
        a, b = Nested(r.a), Nested(r.b)
        bare = lambda s: s.replace(" ", "")
        if leaf(r.a, r.b) != "unresolved" or not (a.ok and b.ok) or bare(r.a) == bare(r.b):
            want = leaf(r.a, r.b)
        else:
            want = compare(a.tree, b.tree)
            if want == "unlike":
                assert r.got in ("wrong", "unresolved") or "," not in r.a, r
                continue
        seen.add(want)
        assert r.got == want, r
    assert seen == {"right", "wrong", "unresolved"}


STRUCTURES = [
    ("[0,1)", "[0,1)", "right"), ("[0,1)", "[0,1]", "wrong"), ("Interval.Ropen(0, 1)", "[0, 1.00001)", "right"), ("Interval.open(0,1)", "(0,1)", "right"), ("Interval.Lopen(0,1)", "[0,1)", "wrong"), ("Interval(0,1)", "[0,1]", "right"),
    ("Matrix([[1, 2], [3, 4]])", "\\begin{pmatrix} 1 & 2 \\\\ 3 & 4 \\end{pmatrix}", "right"), ("[[1,2],[3,5]]", "\\begin{pmatrix} 1 & 2 \\\\ 3 & 4 \\end{pmatrix}", "wrong"), ("[[1,2,3,4]]", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "wrong"),
    ("Point(1, 2)", "(1,2)", "right"), ("(3)", "3", "right"), ("[x]", "x", "right"), ("\\{1,2\\}", "{1,2}", "right"), ("1, 2", "1,2", "right"), ("1,x", "1, y", "unresolved"), ("2\\pi", "6.2832", "right"), ("\\pi/2", "1.5708", "right"),
    ("$5", "5", "right"), ("5\\%", "5", "right"), ("0.05", "5\\%", "right"), ("12_8", "12", "right"), ("1,234", "1234", "right"), ("abc", "ABC", "right"), ("x^2", "x*x", "unresolved"), ("(1,(2,3))", "(1,(2,3.0001))", "right"), ("(1,(2,3))", "((1,2),3)", "wrong"), ("", "", "right"), ("0", "0.0", "right"),
]


def test_structures(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(STRUCTURES)], "i int, a string, b string, want string")
    assert [(r.a, r.b, r.got) for r in df.withColumn("got", A.structure_grade("a", "b")).orderBy("i").collect()] == [g for g in STRUCTURES]


def marked(response):
    """The cascade, in plain Python."""
    hit, steps = False, []
    for marks, keep in ((A.LEADING, True), (A.TRAILING, False), (None, None), (A.WORDS, True)):
        if marks is None:
            inner = boxes(response)[1]
            if inner:
                response, hit = inner, True
                steps.append("boxed")
            if ". " in response:
                response = response[: response.rfind(". ")].strip()
            continue
        for m in marks:
            at = response.lower().rfind(m)
            if at >= 0:
                response = (response[at + len(m) :] if keep else response[:at]).strip()
                hit = True
                steps.append(m)
    return hit and any(c.isdigit() for c in response), response, steps


def test_marked_answer(spark):
    rnd = random.Random(7)
    parts = [*A.LEADING, *A.TRAILING, *A.WORDS, "\\boxed{", "}", "5", "x", ". ", "\n", " ", "So ", "ANSWER: ", "٣", "12.5"]
    values = ["".join(rnd.choices(parts, k=rnd.randint(0, 8))) for _ in range(500)] + ["", "The answer is: 5. Done.", "word " * 3000 + "the answer is 7"]
    got = column(spark, A.marked_answer, values)
    assert [(g.matched, g.answer, list(g.steps)) for g in got] == [marked(v) for v in values]


def test_scores(spark):
    rows = [("Step 2: so \\boxed{\\frac{1}{2}}", "0.5"), ("the answer is 3 apples.", "3"), ("the answer is \\pi", "3.14"), ("no", "5"), ("\\boxed{(1,2)}", "(1,2.00001)")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = S.marked_scores(df, "a", "b").orderBy("i").collect()
    assert [(g.grade, g.good_format) for g in got] == [("right", True), ("unresolved", False), ("right", True), ("unresolved", False), ("right", True)]
    assert got[0].pred == "\\frac{1}{2}" and got[0].pred_steps == ["boxed"]
    rows = [("\\boxed{5}", "5", None, None), ("\\boxed{5", "5", "train", None), ("\\boxed{5" + " " * 100, "5", "train", True), ("x" * 300 + "\\boxed{5.0}", "5", "test", False), ("\\boxed{5}" + "x" * 100, "5", "test", False), ("\\boxed{6}", "5", "test", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, split string, cut boolean")
    names = ["score", "acc", "pred", "incorrect_format", "truncated", "truncated_and_missing_answer", "feedback"]
    got = [tuple(r) for r in S.feedback_scores(df, "a", "b", F.col("split"), F.col("cut"), penalty=0.5, correctness_feedback=True).orderBy("i").select(names).collect()]
    assert got == [
        (1.0, 1.0, "5", 0, 0, 0, ""), (-0.5, 0.0, "", 1, 0, 0, S.FORMAT_FEEDBACK), (0.0, 0.0, "", 1, 1, 1, S.TRUNCATED_FEEDBACK), (1.0, 1.0, "5.0", 0, 0, 0, ""), (0.0, 0.0, "", 1, 0, 0, S.FORMAT_FEEDBACK),
        (0.0, 0.0, "6", 0, 0, 0, S.WRONG_FEEDBACK + "5."),
    ]


def test_nulls(spark):
    pairs = list(itertools.product(["(1,2)", "1", "x", "", None], repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("g", A.structure_grade("a", "b"))
    rows = S.feedback_scores(S.marked_scores(df, "a", "b").drop("pred"), "a", "b").collect()
    assert len(rows) == 25 and all(v is not None for r in rows for k, v in r.asDict().items() if k not in "ab")
