import random

import brute

from millrace.llm.chat_format import Template, chat_segments, read_back


def digest(rows, t):
    out = set()
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -(10**9), r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        formatted = "".join(t.open(role) + t.escaped(x) + t.closing for _, role, x in turns)
        order, state = True, ""
        for _, role, _ in turns:
            order &= role in t.follows.get(state, ())
            state = role
        out.add((conv, len(turns), brute.sha("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()), len(loss), brute.sha(loss.encode()), len(formatted), order and state == "assistant"))
    return out


def test_round_trip(spark):
    rnd = random.Random(2)
    bits = ["\\", "###", "# ", "</turn>", "</turn>\n", "### User: ", ": ", ":", "é", "\n", "ok", "\\\\", "#", "<", "\u2028", "\U0001f600"]
    text = lambda: None if rnd.random() < 0.05 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool: </turn>", None, "User"]), text()) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(200, 0, "system", "s"), (200, 1, "user", "u"), (200, 2, "assistant", "a"), (201, 0, "user", "u"), (201, 0, "user", "u"), (201, None, "assistant", "x")]
    rows = [r for r in rows if r[2] != "User"]  # a role that has another one's written name can't be told from it
    t = Template()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {tuple(r) for r in read_back(chat_segments(df)).collect()}
    assert got == digest(rows, t)
    assert (200, True) in {(r[0], r[6]) for r in got} and (201, False) in {(r[0], r[6]) for r in got}


def test_loss_only_on_assistant_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b </turn>")], "conv_id long, turn long, role string, text string")
    got = [(r.segment, r.loss) for r in chat_segments(df).collect()]
    assert got == [("### User: ", False), ("a", False), ("</turn>\n", False), ("### Assistant: ", False), ("b \\</turn>", True), ("</turn>\n", False)]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(chat_segments(df)).collect() == []
