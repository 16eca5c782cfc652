"""Plain re-computations that the tests hold the operators against."""

import hashlib
import random
import re

SPACE = r"[^\x20\x09-\x0D]+"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def docs(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, chunk string, part string, kind int")


def prose(seed: int, n_docs: int = 40, vocabulary: int = 60, longest: int = 120):
    """Texts with shared passages, copies, runs, odd white space, nulls and empties."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(vocabulary)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(15, 45))] for _ in range(4)]
    out = []
    for i in range(n_docs):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, longest))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        if rnd.random() < 0.3:
            at = rnd.randint(0, len(w))
            w[at:at] = [rnd.choice(words)] * rnd.randint(2, 50)
        out.append("".join(x + rnd.choice([" ", " ", "  ", "\n", "\t "]) for x in w))
    out[3], out[4], out[5], out[6] = None, "", " \n", "Ü"
    out[7], out[8] = out[9], out[9]
    return list(enumerate(out))


def substring(rows, width=20):
    rows = sorted(rows, key=lambda r: r[0])
    words = {i: re.findall(SPACE, t or "") for i, t in rows}
    seen, gone = set(), {i: set() for i, _ in rows}
    for i, _ in rows:
        for s in range(len(words[i]) - width + 1):
            w = tuple(words[i][s : s + width])
            if w in seen:
                gone[i] |= set(range(s, s + width))
            seen.add(w)
    return {(i, len(words[i]), len(gone[i]), sha(" ".join(x for k, x in enumerate(words[i]) if k not in gone[i]).encode())) for i, _ in rows}


def suffix(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in raw:
        for s in range(len(b) - width + 1):
            count[b[s : s + width]] = count.get(b[s : s + width], 0) + 1
    out = set()
    for i, b in raw:
        gone = set()
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone |= set(range(s, s + width))
        spans = sum(k - 1 not in gone for k in gone)
        out.add((i, len(b), len(gone), spans, sha(bytes(x for k, x in enumerate(b) if k not in gone))))
    return out


def simhash(rows, shingle=3, distance=3):
    import xxhash

    prints = []
    for i, t in rows:
        w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    return prints, reach([i for i, _ in prints], [(a[0], b[0]) for k, a in enumerate(prints) for b in prints[:k] if bin(a[1] ^ b[1]).count("1") <= distance])


def similar(rows, shingle=5):
    """Pairs of ids whose sets of word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for i, t in rows:
        w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
        sets.append((i, grams))
    return [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 5 * len(a & b) >= 4 * len(a | b)]


def reach(nodes, edges):
    """The smallest node that each reaches."""
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def contamination(rows, items, width=13):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = set()
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= got
        out.add((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    return sorted((m.start(), list(PII).index(k), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if ok(k, m[0]))
