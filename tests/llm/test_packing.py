import json
import random
import zlib
from collections import defaultdict
from itertools import product

import brute
import numpy as np

from millrace.llm.packing import SIZE, Encoder, Known, hilbert, packing, tokenizer_path


def check(rows, got, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        pieces[r.doc_id].append((r.start, tuple(ids.tolist()), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    if len({i for i, _ in rows}) == len(rows):
        whole = []
        for x in pieces.values():
            ids, at = (), 0
            for start, part, n in sorted(x):
                assert start == at
                ids, at = ids + part, at + len(part)
            assert at == n
            whole.append(ids)
        assert sorted(whole) == want
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= size
    total = sum(map(len, want))
    assert len(sequences) == -(-total // size) and sum(r.length for r in got) == total


def test_every_id_once(spark):
    rows = brute.prose(1, n_docs=80, longest=400) + [(500, "İSTANBUL Σας x́ ẞ"), (501, "a" * 3000), (502, "it's we'll 12345 ... 　\x1c\x85 é"), (503, "\r\n\v\f")]
    check(rows, packing(brute.docs(spark, rows), size=256, with_ids=True).collect(), 256)
    check(rows, packing(brute.docs(spark, rows), with_ids=True).collect(), SIZE)


def test_pieces_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer, known, rnd = Tokenizer.from_file(tokenizer_path()), Known(tokenizer_path(), 50_000), random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkjqxzETAÉéüñßçœŁ"
    pieces = ["".join(rnd.choices(letters, k=rnd.randint(1, 18))) for _ in range(3000)]
    pieces += ["".join(rnd.choices(letters + "0123'.,-!?<|>@€–Ωж中²ªİΣς\u0301\u200d\xad\x7f\x85\xa0\x1c" + "'s't", k=rnd.randint(1, 12))) for _ in range(5000)]
    pieces += ["'s", "it's", "WE'LL", "<|endoftext|>", "a<|endoftext|>b", "a.b@c-d.e", "+1", "***", "x***", "''", "x'", "\U0001f600"]
    pieces = [p for p in pieces if not set(p) & set(" \n\t")]
    assert [known[p] for p in pieces] == [np.array(e.ids, np.uint16).tobytes() for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]


def test_each_token_merges_to_itself():
    """What Known's merging by the vocabulary's order rests on."""
    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    merges = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
    vocabulary, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    assert all(vocabulary["".join(m)] == 512 + i for m, i in merges.items())
    for token in list(vocabulary)[512:]:
        if token.startswith("<|"):
            continue
        x = list(token[: -len(end)] if token.endswith(end) else token)
        if token.endswith(end):
            x[-1] += end
        while len(x) > 1:
            i = min(range(len(x) - 1), key=lambda k: merges.get((x[k], x[k + 1]), 1 << 30))
            assert (x[i], x[i + 1]) in merges, token
            x[i : i + 2] = [x[i] + x[i + 1]]
        assert x == [token]


def test_encoder_forgets_but_agrees():
    texts = [t or "" for _, t in brute.prose(3)]
    small, large = Encoder(tokenizer_path(), kept=20), Encoder(tokenizer_path())
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)


def test_hilbert_is_a_path():
    cells = np.array(list(product(range(8), repeat=3)))
    place = hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_copies_share_sequences_and_empty_table(spark):
    assert packing(brute.docs(spark, [])).collect() == []
    rows = [(None, None), (7, None), (7, "a b"), (7, "a b")]
    check(rows, packing(brute.docs(spark, rows), with_ids=True).collect(), SIZE)
