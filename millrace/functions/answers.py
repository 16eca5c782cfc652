"""Mathematical answers: where they stand in a text, their second normal form, and whether two of them are the same.

All of it is built-in expressions.  Boxes are found by the running depth of braces, brackets are matched by a fold over a
text's delimiters, so that long texts cost in proportion to what they hold of these.  There is no symbolic algebra:
answers that only it could tell apart or alike are "unresolved", never "wrong".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .braces import bound, braced
from .latex import PLAIN, normal, pairs, pattern, where
from .text import strip, text

RIGHT, WRONG, OPEN = "right", "wrong", "unresolved"
PI = "3.141592653589793"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def number(c: Column) -> Column:
    """A plain number as a double, else null; words like infinity are none."""
    c = F.trim(c)
    return F.when(F.rlike(c, F.lit(rf"^{NUMBER}\z")), c.try_cast("double"))


def whole(x: Column) -> Column:
    """Whether a double is a whole number but for 1e-7."""
    return F.abs(x - F.round(x)) <= 1e-7


# Boxes


def boxed_strictly(x) -> Column:
    r"""What the last "\boxed{" holds; null if there is none, or it isn't closed."""
    return bound(text(x), lambda c: F.when(F.contains(c, F.lit("\\boxed{")), bound(F.concat(F.lit("{"), F.substring_index(c, "\\boxed{", -1)), braced)))


def boxed_anywhere(x) -> Column:
    r"""What the first braces behind the last "\boxed" hold, without blanks around; "\fbox" counts where there is no "\boxed"."""
    tail = lambda c: F.when(F.contains(c, F.lit("\\boxed")), F.substring_index(c, "\\boxed", -1)).when(F.contains(c, F.lit("\\fbox")), F.substring_index(c, "\\fbox", -1))
    return bound(text(x), lambda c: F.when(F.contains(c, F.lit("box")), bound(tail(c), lambda t: strip(braced(t)))))


def boxed_or_spaced(x) -> Column:
    r"""What stands behind the last "\boxed " up to a dollar sign, if there is one; else what the last "\boxed{" holds, if that is the last "\boxed"."""
    spaced = lambda c: F.substring_index(F.substring_index(c, "\\boxed ", -1), "$", 1)
    tight = lambda c: bound(F.substring_index(c, "\\boxed", -1), lambda t: F.when(t.startswith("{"), braced(t)))
    return bound(text(x), lambda c: F.when(F.contains(c, F.lit("\\boxed ")), spaced(c)).when(F.contains(c, F.lit("\\boxed")), tight(c)))


# The second normal form

TEXT = r"^\\text\{(.+?)\}\z"


def unworded(c: Column) -> Column:
    r"""What a \text around all of it holds."""
    return where(lambda x: x.startswith("\\text{"), pattern(TEXT, "$1"))(c)


def second_form(x) -> Column:
    """The plain form of an answer without a \\text around it; an answer that the plain form has no rule for stays as it is.

    Those are: two units in words, a root or fraction without anything behind it."""

    def form(c):
        joined = normal(c, {k: PLAIN[k] for k in ("sizes", "unit in words", "points", "leading point", "short left side")})

        def fractions(r, bare):
            latex = lambda x, rule: F.contains(x, F.lit("\\")) & F.rlike(x, F.lit(rule))
            odd = latex(bare, r"\\frac[^{](\\frac|\z)")
            rest = normal(bare, {k: PLAIN[k] for k in ("short root", "short fraction", "short numerator")})
            ends = lambda f: normal(f, {k: PLAIN[k] for k in ("half", "slash")})
            faulty = latex(r, r"\\sqrt(\\sqrt|\z)") | latex(bare, r"\\frac(\\frac|\z)")
            return F.when(faulty, c).when(odd, ends(normal(bare, {"short root": PLAIN["short root"]}))).otherwise(ends(rest))

        units = F.size(F.split(F.replace(c, F.lit("\n"), F.lit("")), r"\Q\text{ \E", -1)) - 1
        without_blanks = lambda r: bound(F.replace(r, F.lit(" "), F.lit("")), lambda bare: fractions(r, bare))
        return F.when(F.contains(c, F.lit("\\")) & (units > 1), c).otherwise(bound(joined, without_blanks))

    return bound(strip(unworded(strip(text(x)))), form)


# Words for powers of ten, units in the order in which they are taken out, and signs of parsed LaTeX.
POWERS = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter",
]
SIGNS = [("√", "sqrt"), ("π", "pi"), ("∞", "inf"), ("∪", "U"), ("·", "*"), ("×", "*")]
#: LaTeX commands and what they read as.
COMMANDS = [("\\left", ""), ("\\right", ""), ("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*"), ("\\le", "<="), ("\\ge", ">="), ("\\,", ""), ("\\ ", " "), ("\\{", "{"), ("\\}", "}")]
#: How deeply fractions and roots are read within each other.
NESTED = 6


def read_latex(c: Column) -> Column:
    """LaTeX as a line of arithmetic: a fraction is a/b, a root sqrt(a); words keep their letters, other commands stay."""
    c = pairs([("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\frac", " \\frac")])(c)
    for _ in range(NESTED):
        c = pattern(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")(pattern(r"\\sqrt\{([^{}]*)\}", "√($1)")(pattern(r"\\(?:text|mathrm|mathbf|textbf)\{([^{}]*)\}", "$1")(c)))
    c = pattern(r"\\frac(\d)(\d)", "$1/$2")(pattern(r"\\sqrt(\d)", "√($1)")(c))
    return F.trim(pairs([*COMMANDS, *SIGNS])(c))


def commas_out(c: Column) -> Column:
    """Without commas between a digit and three more; those of tuples stay.  Neighbouring ones go in turns, as the rule is."""
    turns = lambda x: reduce(lambda x, _: F.regexp_replace(x, r"(\d),(\d\d\d)($|\D)", "$1$2$3"), range(4), x)
    return where(lambda x: F.contains(x, F.lit(",")) & F.rlike(x, F.lit(r"\d,\d\d\d")), turns)(c)


def number_with_commas(c: Column) -> Column:
    """A plain number without such commas; a text with any other sign is none, whatever its commas are."""
    return F.when(F.rlike(c, F.lit(r"^[ \d.,eE+-]+\z")), number(commas_out(c)))


def short_whole(c: Column) -> Column:
    """A whole number, however it is written, in digits; up to 2^53."""
    return bound(number(c), lambda n: F.when((F.abs(n) <= 2.0**53) & whole(n), F.round(n).cast("long").cast("string")).otherwise(c))


LINE = {
    "words": unworded,
    "signs": pairs([("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), *POWERS]),
    "units": lambda c: F.aggregate(F.array(*map(F.lit, UNITS)), c, lambda x, unit: F.when(F.contains(x, unit), F.regexp_replace(x, F.concat(unit, F.lit(r"(es)?(s)? *(\^[0-9]+)?")), F.lit(""))).otherwise(x)),
    "degrees": pattern(r"\^ *\\circ", "", "\\circ"),
    "outer braces": where(lambda c: c.startswith("{"), pattern(r"(?s)^\{(.*)\}\z", "$1")),
    "spaced commas": pattern(r",\\! *", "", ",\\!"),
    "whole number": lambda c: bound(c, short_whole),
    "latex": where(lambda c: F.contains(c, F.lit("\\")), read_latex),
    "minus": pattern("- *", "-", "- "),
    "mixed number": pattern("([0-9]) +([0-9])", "$1+$2"),
    "case": F.lower,
    "digits": lambda c: bound(c, lambda r: F.when(whole(number_with_commas(r)), short_whole(F.replace(r, F.lit(","), F.lit("")))).otherwise(r)),
}


def line_form(x) -> Column:
    """An answer as a line of arithmetic in lower case, without units, signs of money and shares."""
    return reduce(lambda c, rule: bound(c, rule), LINE.values(), text(x))


# Values


def factor(c: Column) -> Column:
    """A number, pi, the root of a number, or a power of one of these; else null."""
    base, power = F.regexp_extract(c, r"^([^^]*)", 1), F.regexp_extract(c, r"\^\(?([^()^]*)\)?\z", 1)
    root = F.regexp_extract(base, r"^sqrt\(([^()]*)\)\z", 1)
    value = F.when(base == "pi", F.lit(float(PI))).when(root != "", F.sqrt(number(root))).otherwise(number(F.regexp_replace(base, r"^\(([^()]*)\)\z", "$1")))
    return F.when(F.contains(c, F.lit("^")), F.when(number(power).isNotNull(), F.pow(value, number(power)))).otherwise(value)


def product(c: Column) -> Column:
    """Of factors with * and / between them, from the left; null if one isn't known or is a divisor 0."""
    signed = F.regexp_extract_all(F.regexp_replace(c, r"^[+-]+", ""), F.lit(r"[*/]?[^*/]+|[*/]"), F.lit(0))
    value = lambda f: factor(F.regexp_replace(f, r"^[*/]", ""))
    all_of = F.aggregate(signed, F.lit(1.0), lambda a, f: F.when(f.startswith("/"), F.try_divide(a, value(f))).otherwise(a * value(f)))
    return F.when(F.size(signed) > 0, all_of * F.when(F.rlike(c, F.lit(r"^\+*-")), -1.0).otherwise(1.0))


def arithmetic(x: Column) -> Column:
    """The value of sums of products of numbers, roots and pi, without brackets; else null."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"(\d|\))(sqrt|pi)", "$1*$2")
    terms = lambda c: F.regexp_extract_all(c, F.lit(r"(?:^|[+-])(?:[*/^(]-|e-|[^+-])+"), F.lit(0))

    def value(c):
        parts = terms(c)
        total = F.aggregate(parts, F.lit(0.0), lambda a, t: a + product(t))
        return F.when((c != "") & (F.array_join(parts, "") == c), total)

    return F.coalesce(number(x), F.when(F.rlike(x, F.lit(r"^[\sa-z0-9.+*/^()-]+\z")) & (F.length(x) <= 200), bound(bare(x), value)))


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Whether numbers are as near as a relative tolerance of the larger one."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


# Rules for answers


def entries(c: Column) -> Column:
    """The entries of a tuple or an interval whose brackets are its ends and nothing else's; else the answer alone."""
    inner = lambda r: F.substring(r, F.lit(2), F.length(r) - 2)
    return bound(commas_out(c), lambda r: F.when(r == "", F.array().cast("array<string>")).when(F.rlike(r, F.lit(r"(?s)^[()\[\]][^()\[\]]+[()\[\]]\z")), F.transform(F.split(inner(r), ",", -1), strip)).otherwise(F.array(r)))


def is_fraction(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^-?[0-9]+.?/0*[1-9][0-9]*.?\z"))


def whole_text(c: Column) -> Column:
    return F.coalesce(whole(number_with_commas(c)), F.lit(False))


def entry_grade(gold: Column, given: Column) -> Column:
    """What is written alike is right.  Fractions must be, whole numbers only fit whole numbers; of others the values decide."""
    values = F.struct(arithmetic(gold).alias("a"), arithmetic(given).alias("b"))
    by_value = bound(values, lambda v: F.when(v["a"].isNotNull() & v["b"].isNotNull(), F.when(near(v["a"], v["b"], 1e-9), RIGHT).otherwise(WRONG)).otherwise(OPEN))
    return (
        F.when(gold == given, RIGHT)
        .when(is_fraction(gold) & is_fraction(given), WRONG)
        .when(whole_text(gold) != whole_text(given), WRONG).otherwise(by_value)
    )


def all_of(grades: Column) -> Column:
    """Wrong if one is, else unresolved if one is, else right."""
    return bound(grades, lambda g: F.when(F.array_contains(g, WRONG), WRONG).when(F.array_contains(g, OPEN), OPEN).otherwise(RIGHT))


def answer_grade(given, gold) -> Column:
    """"right" by either normal form; tuples entry by entry with the same ends and as many entries; a null answer is wrong."""
    column = lambda x: F.col(x) if isinstance(x, str) else x

    def by_entries(f):
        ends = lambda c: F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
        lists = F.struct(entries(f["gold"]).alias("gold"), entries(f["given"]).alias("given"))

        def compare(e):
            unlike = (F.size(e["gold"]) != F.size(e["given"])) | ((F.size(e["gold"]) > 1) & (ends(f["gold"]) != ends(f["given"])))
            return F.when(unlike, WRONG).otherwise(all_of(F.zip_with(e["gold"], e["given"], entry_grade)))

        return F.when(f["gold"] == f["given"], RIGHT).when(f["given"] == "", WRONG).otherwise(bound(lists, compare))

    def by_forms(p):
        lines = F.struct(line_form(p["gold"]).alias("gold"), line_form(p["given"]).alias("given"))
        alike = (p["given"] == text(p["gold"])) | (second_form(p["given"]) == second_form(p["gold"]))
        return F.when(p["given"].isNull(), WRONG).when(alike, RIGHT).otherwise(bound(lines, by_entries))

    return bound(F.struct(column(given).alias("given"), column(gold).alias("gold")), by_forms)


# Structures

#: How a delimiter is told: commas and line ends part entries, brackets hold them.
OPENING, CLOSING = "([{", ")]}"


def structure_text(c: Column) -> Column:
    """Matrices and intervals by name as nested brackets: rows in [ ], a row's entries parted by commas."""
    c = pairs([("\\left", ""), ("\\right", ""), ("\\{", "{"), ("\\}", "}")])(c)
    c = pattern(r"\\begin\{[pb]?matrix\}", "[[", "matrix}")(pattern(r"(?:\\\\)?\s*\\end\{[pb]?matrix\}", "]]", "matrix}")(c))
    c = where(lambda x: F.contains(x, F.lit("[[")), pairs([("\\\\", "],["), ("&", ",")]))(c)
    for name, ends in (("Interval", "[]"), ("Interval.Ropen", "[)"), ("Interval.Lopen", "(]"), ("Interval.open", "()")):
        c = pattern(rf"(?s)^\Q{name}(\E(.*)\)\z", f"{ends[0]}$1{ends[1]}", f"{name}(")(c)
    return pattern(r"(?s)^Point(\(.*\))\z", "$1", "Point(")(pattern(r"(?s)^Matrix\((\[.*\])\)\z", "$1", "Matrix(")(c))


def parsed(c: Column) -> Column:
    """struct<skeleton, leaves>: a text's delimiters in order, each with its depth, and what stands between them, blanks taken off.

    Null where brackets aren't balanced: a bracket may end with the other kind, as half-open intervals do, but not with none.
    A comma belongs to the brackets around it, so that equal skeletons are equal nested arrays, with equal ends."""

    def step(s, mark):
        up, down = F.instr(F.lit(OPENING), mark) > 0, F.instr(F.lit(CLOSING), mark) > 0
        depth = s["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

    def parts(s):
        leaves = F.transform(F.split(s["text"], r"[()\[\]{},;]", -1), strip)
        depths = F.aggregate(s["marks"], F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step)
        balanced = bound(depths, lambda d: (d["depth"] == 0) & (d["low"] == 0))
        return F.when(balanced, F.struct(F.array_join(s["marks"], "").alias("skeleton"), leaves.alias("leaves")))

    marks = lambda c: F.struct(c.alias("text"), F.regexp_extract_all(c, F.lit(r"[()\[\]{},;]"), F.lit(0)).alias("marks"))
    return bound(c, lambda c: bound(marks(c), parts))


def pi_value(c: Column, pi: str) -> Column:
    r"""\pi as a number: a factor behind a digit, else on its own."""
    return F.replace(F.regexp_replace(c, r"(\d)\\pi", f"$1*{pi}"), F.lit("\\pi"), F.lit(f"1*{pi}"))


def answer_value(c: Column, pi: str = PI) -> Column:
    """The number that an answer is: commas, one money or percent sign, a base behind "_" and multiples of pi allowed; else null."""
    def value(bare):
        with_commas = F.when(F.rlike(bare, F.lit(r"^[ \d.,{}eE+-]+\z")), number(pairs([("{,}", ""), (",", "")])(bare)))
        base = F.when(F.contains(bare, F.lit("_")), number(F.substring_index(bare, "_", 1))).otherwise(with_commas)
        return F.coalesce(base, F.when(F.contains(bare, F.lit("\\pi")), arithmetic(read_latex(pi_value(bare, pi)))), F.when(F.contains(bare, F.lit("frac")), arithmetic(read_latex(bare))))

    money = where(lambda x: x.startswith("$"), pattern(r"^\$(?=\d)", ""))
    return bound(pattern(r"^(\d+(?:\.\d+)?)\\?%\z", "$1", "%")(money(strip(c))), value)


def leaf_grade(a: Column, b: Column, tolerance: float, pi: str = PI) -> Column:
    """By text (case and blanks aside), then by number: equal, or a hundred times more or less, within a relative tolerance."""
    bare = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    values = F.struct(answer_value(a, pi).alias("a"), answer_value(b, pi).alias("b"))
    close = lambda v: near(v["a"], v["b"], tolerance) | near(v["a"], v["b"] / 100, tolerance) | near(v["a"], v["b"] * 100, tolerance)
    by_value = bound(values, lambda v: F.when(v["a"].isNotNull() & v["b"].isNotNull(), F.when(close(v), RIGHT).otherwise(WRONG)).otherwise(OPEN))
    return F.when((bare(a) == bare(b)) | (strip(F.lower(a)) == strip(F.lower(b))), RIGHT).otherwise(by_value)


def structure_grade(given, gold, tolerance: float = 1e-4, pi: str = PI) -> Column:
    """Whether two answers are equal: as texts or numbers, else as nested structures, entry by entry.

    Sets, tuples, intervals and matrices are equal if their brackets, open and closed ends apart, are the same and all their
    entries are; one entry in brackets of one kind is the entry.  Different brackets are wrong if both are structures."""

    def whole_answer(p):
        single = lambda c: pattern(r"^[(\[]([^()\[\],]*)[)\]]\z", "$1")(c)
        structured = F.struct(parsed(structure_text(p["a"])).alias("a"), parsed(structure_text(p["b"])).alias("b"))
        braces = lambda c: pattern(r"[{}()]", "")(c)

        def nested(s):
            both = s["a"].isNotNull() & s["b"].isNotNull() & ((s["a"]["skeleton"] != "") | (s["b"]["skeleton"] != ""))
            leaves = all_of(F.zip_with(s["a"]["leaves"], s["b"]["leaves"], lambda x, y: leaf_grade(x, y, tolerance, pi)))
            # unlike skeletons only tell lists with commas apart: f(x) may well equal a name without brackets
            lists = (F.instr(s["a"]["skeleton"], ",") > F.lit(0)) & (F.instr(s["b"]["skeleton"], ",") > F.lit(0))
            return F.when(both & (s["a"]["skeleton"] == s["b"]["skeleton"]), leaves).when(both & lists, WRONG).otherwise(OPEN)

        singles = F.struct(single(p["a"]).alias("a"), single(p["b"]).alias("b"))
        alone = bound(singles, lambda s: leaf_grade(s["a"], s["b"], tolerance, pi))
        same = (braces(F.replace(p["a"], F.lit(" "), F.lit(""))) == braces(F.replace(p["b"], F.lit(" "), F.lit("")))) & (F.instr(p["b"], ",") == 0)
        return bound(alone, lambda g: F.when(g != OPEN, g).when(same, RIGHT).otherwise(bound(structured, nested)))

    return bound(F.struct(strip(text(given)).alias("a"), strip(text(gold)).alias("b")), whole_answer)


# Answers behind markers

# What an answer stands behind, before, and behind again, in the order in which they are looked for.
LEADING = ["answer:", "answer is", "answers are"]
TRAILING = ["is answer", "is the answer", "are answers", "are the answers"]
WORDS = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


def cascade(state: Column, markers: list[str], keep_behind: bool) -> Column:
    """The state after all markers: of a text that holds one, what stands behind (or before) its last place goes on to the next."""

    def step(s, marker):
        back = lambda low: F.call_function("instr", F.reverse(low), F.reverse(marker))

        def moved(at):
            size = F.length(s["rest"]) - at + 1
            rest = F.right(s["rest"], at - 1) if keep_behind else F.left(s["rest"], size - F.length(marker))
            return F.when(at > 0, F.struct(strip(rest).alias("rest"), F.array_append(s["steps"], marker).alias("steps"))).otherwise(s)

        return bound(F.lower(s["rest"]), lambda low: F.when(F.contains(low, marker), bound(back(low), moved)).otherwise(s))

    return F.aggregate(F.array(*map(F.lit, markers)), state, step)


def marked_answer(x) -> Column:
    """struct<matched, answer, steps>: the answer behind the markers of a text, and which of them it was found by, in order.

    A box's contents come before a sentence's end and the last words; an answer without a digit doesn't count as matched."""
    none = F.array().cast("array<string>")
    begun = F.struct(text(x).alias("rest"), none.alias("steps"))

    def boxed_rest(s):
        return bound(boxed_anywhere(s["rest"]), lambda b: F.when(b != "", F.struct(b.alias("rest"), F.array_append(s["steps"], F.lit("boxed")).alias("steps"))).otherwise(s))

    def sentence(s):
        back = F.instr(F.reverse(s["rest"]), " .")
        return F.when(back > 0, F.struct(strip(F.left(s["rest"], F.length(s["rest"]) - back - 1)).alias("rest"), s["steps"].alias("steps"))).otherwise(s)

    found = cascade(cascade(begun, LEADING, True), TRAILING, False)
    found = cascade(bound(bound(found, boxed_rest), sentence), WORDS, True)
    matched = lambda s: (F.size(s["steps"]) > 0) & F.rlike(s["rest"], F.lit(r"\p{Nd}"))
    return bound(found, lambda s: F.struct(matched(s).alias("matched"), s["rest"].alias("answer"), s["steps"].alias("steps")))
