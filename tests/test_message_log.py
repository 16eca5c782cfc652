import random
import re

from millrace.operators.message_log import Template, message_log


def words(s):
    return re.findall(r"\S+\s*|\s+", s)


def log(turns, longest, longest_response):
    """The same, turn after turn, in plain Python."""
    t = Template()
    ids, loss, flagged, prompt = [], [], [], None
    kept = [x for x in turns if not (x[1] == "tool" and not x[2])]
    for n, role, said in kept:
        open_, body = f"<{role}>\n", (said or "") + t.end
        base, full = words(t.history + (t.prompt if role == "assistant" else "")), words(t.history + open_ + body)
        k = 0
        while k < min(len(base), len(full)) and base[k] == full[k]:
            k += 1
        if k < len(base):
            flagged.append(n)
        ask = words(t.prompt) if role == "assistant" else []
        if role == "assistant" and prompt is None:
            prompt = len(ids) + len(ask)
        ids += ask + full[k:]
        loss += [0] * len(ask) + [int(role == "assistant")] * (len(full) - k)
    prompt = len(ids) if prompt is None else prompt
    whole = words("".join(f"<{r}>\n{s or ''}{t.end}" for _, r, s in kept))
    ids, loss, same = ids[:longest], loss[:longest], ids == whole
    return ids, loss, prompt, ids[prompt:][:longest_response], loss[prompt:][:longest_response], flagged, same


def test_equals_a_plain_log(spark):
    rnd = random.Random(3)
    said = lambda: rnd.choice(["", " lead", "a b", "two\n\nlines ", "x", None, "w " * 40])
    convs = {i: [(n, rnd.choice(["user", "assistant", "tool", "system"]), said()) for n in range(rnd.randint(1, 7))] for i in range(120)}
    rows = [(i, *x) for i, turns in convs.items() for x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    for limits in ((1000, 1000), (20, 5)):
        got = {r.conv_id: r for r in message_log(df, longest=limits[0], longest_response=limits[1]).collect()}
        for i, turns in convs.items():
            if all(r == "tool" and not s for _, r, s in turns):
                assert i not in got
                continue
            ids, loss, prompt, response, response_loss, flagged, same = log(turns, *limits)
            r = got[i]
            assert (r.ids, r.loss_mask, r.prompt_length, r.response_ids, r.response_loss_mask, r.flagged_turns, r.same_as_whole) == (ids, loss, prompt, response, response_loss, flagged, same)
            assert r.attention_mask == [1] * len(ids) and r.position_ids == [*range(len(ids))]
            assert (r.log_chunk is None) == same
    kinds = [log(t, 1000, 1000) for t in convs.values()]
    assert any(k[5] for k in kinds) and any(k[6] for k in kinds) and not all(k[6] for k in kinds)


def test_difference_is_shown(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", " yes")], "conv_id long, turn int, role string, text string")
    r = message_log(df, around=2).first()
    assert r.flagged_turns == [1] and not r.same_as_whole
    assert r.log_chunk == ["<user>\n", "hi</turn>\n", "<assistant>\n", "<assistant>\n "] and r.whole_chunk == ["<user>\n", "hi</turn>\n", "<assistant>\n ", "yes</turn>\n"]
    assert message_log(df.where("false")).count() == 0
