"""Operator 1, personal data by weak supervision, with DataFrame functions only.

Candidates are what five patterns find: e-mail addresses, IP addresses, card numbers, phone
numbers (each also where it fails its check) and secrets, long runs of letters and digits.
Four labelers vote on each, for (1), against (-1) or not at all (0):

- regex: does it pass the strict form of its kind;
- gazetteer: are its parts in lists (ends of domains, first digits of cards, country codes, ...);
- context: do the words before it announce such a thing;
- shape: do its characters and neighbours look like one.

The whole table's candidates are counted by kind, votes and features (a table whose size is
bounded by their numbers, not by the input).  Expectation-maximisation over these counts
estimates how often each labeler is right and how frequent true spans of each kind are, and
gives each combination a probability.  A logistic regression on votes and features, trained
on these soft labels, is the final classifier; its weights go into the plan as literals.

Spans that pass their base rule always stay (see BASE); the classifier adds spans of secrets and
of candidates that fail it.  Positions are code points, ends exclusive.

Matches are consumed from left to right and a failing match isn't tried again from within.
The patterns below are possessive and look behind, so that they take linear time and
no stack on very long runs; they match the same as the plain ones.

Null and empty texts have no spans.  Equal rows get equal results; an empty table gives no rows.  A very long text is scanned in
one task.  Only `text` is read and the named columns are returned; one that is called `pii` comes out as `pii_input`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, passed_names

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL, NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{NAME}++(?:\.{NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+(?![A-Za-z0-9_])",
}
#: A cheap test that a text without candidates fails.
HINTS = {"email": "@", "phone": "+"}

#: Lists of the gazetteer and context labelers.
DOMAIN_ENDS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"]
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_STARTS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30)"
CONTEXT = {
    "email": r"(?i)(e-?mail|contact|correo|courriel|write to|@)\W{0,4}$",
    "ip": r"(?i)(\bip|address|host|server|adresse)\W{0,4}$",
    "card": r"(?i)(card|visa|credit|karte|carte|tarjeta|pan)\W{0,4}$",
    "phone": r"(?i)(phone|tel|call|mobile|fax|telefon|téléphone|llame)\W{0,4}$",
    "secret": r"(?i)(token|secret|password|passwd|api[_-]?key|key|bearer)\W{0,6}$",
}
BEFORE = 24
#: Matches of a text that are walked at once.
BLOCK = 128
#: Characters of the stretches that a text is cut into for redaction.
STRETCH = 512
#: Spans of a block whose reach is looked up at once.
SPAN_BLOCK = 512
FEATURES = {"kind": 5, "regex": 3, "gazetteer": 3, "context": 3, "shape": 3, "length": 4, "left": 3, "right": 3}
THRESHOLD = 0.5


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, s, before, after>> of the pattern's matches, from what lies between them; before and after
    are the nearest characters of that."""
    pattern = PATTERNS[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    # places are sums of lengths: of the blocks of matches before, and within the block; each array is bound once, by a
    # transform over a single element
    sum_of = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    sizes = lambda block: F.transform(block, lambda m: F.length(m["gap"]) + F.length(m["s"]))

    def cut(x):
        last = F.floor((F.size(x["s"]) - 1) / BLOCK).cast("int")
        one = lambda b: F.transform(F.slice(x["s"], b * BLOCK + 1, BLOCK), lambda m, k: F.struct(m.alias("s"), x["g"][b * BLOCK + k].alias("gap"), x["g"][b * BLOCK + k + 1].alias("next")))
        return F.when(F.size(x["s"]) > 0, F.transform(F.sequence(F.lit(0), last), one))

    def located(y):
        def block(ms, b):
            z = F.struct(ms.alias("ms"), sizes(ms).alias("sizes"), sum_of(F.slice(y["totals"], 1, b)).alias("before"))
            return F.transform(F.array(z), lambda v: F.transform(v["ms"], lambda m, k: match(m, v["before"] + sum_of(F.slice(v["sizes"], 1, k)) + F.length(m["gap"]))))[0]

        return F.flatten(F.transform(y["blocks"], block))

    def match(m, start):
        return F.struct(start.alias("start"), (start + F.length(m["s"])).alias("end"), m["s"].alias("s"), F.right(m["gap"], F.lit(BEFORE)).alias("before"), F.left(m["next"], F.lit(3)).alias("after"))

    none = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")
    blocks = F.transform(F.array(F.struct(found.alias("s"), gaps.alias("g"))), cut)
    bound = F.transform(blocks, lambda x: F.struct(x.alias("blocks"), F.transform(x, lambda ms: sum_of(sizes(ms))).alias("totals")))
    walked = F.coalesce(F.transform(bound, located)[0], none)
    hint = text.contains(HINTS[kind]) if kind in HINTS else F.rlike(text, F.lit(pattern))
    return F.when(hint, walked).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Is the number's checksum divisible by ten, every second digit from the right doubled?"""
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    chars = F.transform(F.sequence(F.lit(1), F.length(number)), lambda k: F.substring(F.reverse(number), k, F.lit(1)))
    return F.aggregate(F.transform(chars, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_rule(kind: str, s: Column) -> Column:
    """BASE: the checks that a match of the kind must pass; secrets are none."""
    n = F.length(digits(s))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return n.between(14, 19) & luhn(digits(s))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(False)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, s: Column, before: Column, after: Column) -> dict[str, Column]:
    base, n = base_rule(kind, s), F.length(digits(s))
    context = vote(F.rlike(before, F.lit(CONTEXT[kind])), F.rlike(before, F.lit(r"[0-9A-Za-z][./#-]$")))
    if kind == "email":
        end = F.element_at(F.split(s, r"\."), -1)
        return {"regex": vote(F.rlike(s, F.lit(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$")), F.lit(True)), "gazetteer": vote(F.lower(end).isin(DOMAIN_ENDS), F.rlike(end, F.lit("[0-9]"))), "context": context, "shape": vote(~F.rlike(s, F.lit(r"\.\.|\.@|^\.")), F.lit(True))}
    if kind == "ip":
        return {"regex": vote(base, F.lit(True)), "gazetteer": vote(~F.rlike(s, F.lit(r"^(0|22[4-9]|2[3-5][0-9])\.")), F.lit(True)), "context": context, "shape": vote(~F.rlike(s, F.lit(r"(^|\.)0[0-9]")) & ~F.rlike(after, F.lit(r"^\.[0-9]")), F.lit(True))}
    if kind == "card":
        return {"regex": vote(base, F.lit(True)), "gazetteer": vote(F.rlike(s, F.lit(CARD_STARTS)), F.lit(True)), "context": context, "shape": vote(F.rlike(s, F.lit(r"^([0-9]{4}[\x20-]){3}[0-9]{1,4}$")), n < 14)}
    if kind == "phone":
        return {"regex": vote(base, F.lit(True)), "gazetteer": vote(F.rlike(s, F.lit(COUNTRY_CODES)), F.lit(True)), "context": context, "shape": vote(F.rlike(s, F.lit(r"^\+[0-9]{1,3}[\x20.(-]")) & n.between(9, 15), n < 8)}
    mixed = F.rlike(s, F.lit("[0-9]")) & F.rlike(s, F.lit("[A-Za-z]"))
    return {"regex": vote(F.rlike(s, F.lit(r"^([0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).{24,})$")), ~mixed), "gazetteer": vote(F.rlike(s, F.lit(r"^(sk|pk|ghp|xox|AKIA|AIza)")), ~mixed), "context": context, "shape": vote(mixed & (n * 4 >= F.length(s)), ~mixed)}


def candidates(text: Column) -> Column:
    """All candidates of a text, as one array of structs."""

    def of(kind: str) -> Column:
        def look(m):
            s, start, end = m["s"], m["start"], m["end"]
            before, after = m["before"], m["after"]
            edge = lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"^[\s\"'(<,;:!?)>]")), 1).otherwise(2)
            v = votes(kind, s, before, after)
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), base_rule(kind, s).alias("base"),
                *[(v[x] + 1).alias(x) for x in ("regex", "gazetteer", "context", "shape")],
                F.when(F.length(s) < 12, 0).when(F.length(s) < 20, 1).when(F.length(s) < 40, 2).otherwise(3).alias("length"),
                edge(F.right(before, F.lit(1))).alias("left"), edge(after).alias("right"),
            )

        return F.transform(matches(text, kind), look)

    return F.concat(*map(of, KINDS))


def expectation_maximisation(counts: np.ndarray, table: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability of each row (kind and four votes, 0..2 for against, none, for) that its candidates are true.

    Labelers are independent given the truth; each has a rate of being right when it votes.  Rates start at
    0.8 and stay above one half, so that the two classes can't change places."""
    kinds, v = table[:, 0], table[:, 1:5]
    prior, right = np.full(len(KINDS), 0.5), np.full(4, 0.8)
    p = np.zeros(len(counts))
    for _ in range(rounds):
        up, down = np.log(right), np.log(1 - right)
        true = np.log(prior[kinds]) + np.where(v == 2, up, 0).sum(1) + np.where(v == 0, down, 0).sum(1)
        false = np.log(1 - prior[kinds]) + np.where(v == 2, down, 0).sum(1) + np.where(v == 0, up, 0).sum(1)
        p = 1 / (1 + np.exp(np.clip(false - true, -500, 500)))
        w = counts[:, None]
        agree = (w * np.where(v == 2, p[:, None], np.where(v == 0, 1 - p[:, None], 0))).sum(0)
        right = np.clip((agree + 8) / ((w * (v != 1)).sum(0) + 10), 0.55, 0.99)
        share = np.bincount(kinds, counts * p, len(KINDS)) + 1
        prior = np.clip(share / (np.bincount(kinds, counts, len(KINDS)) + 2), 0.01, 0.99)
    return p


def span_classifier(counts: np.ndarray, table: np.ndarray, p: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression on one-hot features, by Newton steps with a ridge; weights by feature value, then the bias."""
    offsets = np.cumsum([0, *FEATURES.values()])
    x = np.zeros((len(table), offsets[-1] + 1))
    for k in range(len(FEATURES)):
        x[np.arange(len(table)), offsets[k] + table[:, k]] = 1
    x[:, -1] = 1
    w, weight = np.zeros(x.shape[1]), counts / max(counts.sum(), 1) * min(counts.sum(), 1e4)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (p - q)) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame) -> np.ndarray:
    """The final classifier's weights, from the counts of all candidates."""
    names = list(FEATURES)
    text = F.col("text").cast("string")
    each = docs.select(F.explode(candidates(text)).alias("c")).select(*[F.col(f"c.{n}") for n in names])
    rows = each.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most the product of FEATURES, whatever the input
    if not rows:
        return np.zeros(sum(FEATURES.values()) + 1)
    rows.sort()
    table = np.array([r[:-1] for r in rows], np.int64)
    counts = np.array([r[-1] for r in rows], float)
    return span_classifier(counts, table, expectation_maximisation(counts, table))


def chosen(text: Column, weights: np.ndarray) -> Column:
    """The spans that stay: base ones, and those that the classifier adds; sorted by start, then kind."""
    offsets = np.cumsum([0, *FEATURES.values()]).tolist()

    def score(c):
        total = F.lit(float(weights[-1]))
        for name, at, size in zip(FEATURES, offsets, FEATURES.values()):
            total = total + F.element_at(F.array(*[F.lit(float(w)) for w in weights[at : at + size]]), c[name] + 1)
        return total

    limit = math.log(THRESHOLD / (1 - THRESHOLD))
    added = lambda c: c["base"] | (score(c) > limit)
    return F.array_sort(F.transform(F.filter(candidates(text), added), lambda c: F.struct(c["start"], c["kind"], c["end"], c["base"])))


def written_out(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda c: F.concat_ws(":", F.element_at(kinds, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id), then pii: array<struct<start, kind, end, base>> by start and kind."""
    weights = train(docs) if weights is None else weights
    columns = columns or ["doc_id"]
    kept = [col(c).alias(n) for c, n in zip(columns, passed_names(columns, ["pii"]))]
    return docs.select(*kept, chosen(F.coalesce(F.col("text").cast("string"), F.lit("")), weights).alias("pii"))


def pieces(text: Column) -> tuple:
    """A function (first, last) -> text between two positions that looks at the stretches of STRETCH characters there alone."""
    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def between(all_, first: Column, last: Column) -> Column:
        at = F.floor(first / STRETCH).cast("int")
        some = F.slice(all_, at + 1, F.floor((last - 1) / STRETCH).cast("int") - at + 1)
        return F.when(last > first, F.substring(F.array_join(some, ""), first - at * STRETCH + 1, last - first)).otherwise("")

    return stretches, between


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; of overlapping spans the first names them.

    How far the spans before each reach comes from maxima of blocks and within its block; what stands between spans is cut
    from stretches of the text and joined once.  So the cost is in proportion to the text and its spans."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    stretches, between = pieces(text)
    reach = lambda x: F.coalesce(F.array_max(F.transform(x, lambda c: c["end"])), F.lit(0))

    def placed(block, before):
        ends = F.transform(block, lambda c: c["end"])
        return F.transform(block, lambda c, j: F.struct(F.greatest(before, F.coalesce(F.array_max(F.slice(ends, 1, j)), F.lit(0))).alias("pos"), c["start"].alias("start"), c["kind"].alias("kind")))

    def joined(x):
        every = F.flatten(F.transform(x["blocks"], lambda block, b: placed(block, F.coalesce(F.array_max(F.slice(x["tops"], 1, b)), F.lit(0)))))
        marks = F.transform(F.filter(every, lambda c: c["start"] >= c["pos"]), lambda c: F.concat(between(x["all"], c["pos"], c["start"]), F.element_at(kinds, c["kind"] + 1)))
        return F.concat(F.array_join(marks, ""), between(x["all"], F.array_max(x["tops"]), x["n"]))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / SPAN_BLOCK).cast("int")), lambda b: F.slice(spans, b * SPAN_BLOCK + 1, SPAN_BLOCK))
    # blocks, their reach and the stretches are bound by transforms over a single element, so that they are evaluated once
    bound = F.transform(F.array(blocks), lambda x: F.struct(x.alias("blocks"), F.transform(x, reach).alias("tops"), stretches.alias("all"), F.length(text).alias("n")))
    return F.when(F.size(spans) > 0, F.transform(bound, joined)[0]).otherwise(text)


def op1_pii(spark, sf_dir) -> DataFrame:
    from .common import read

    found = find_pii(read(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda c: c["base"])
    count = lambda k: F.size(F.filter("pii", lambda c: c["base"] & (c["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("pii")).alias("spans"))
