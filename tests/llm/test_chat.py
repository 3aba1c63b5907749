"""Folding, rendering and reading back against a plain replay in Python."""

import hashlib
import random

import pytest

from faintline.llm import chat

SCHEMA = "conv_id long, seq long, sub long, message_id string, kind string, role string, text string"


def test_turns(spark):
    rnd = random.Random(1)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "[", "|>", "é😀", "\n", " ", "<\\/s>", "<<s>", "<|turn", "ok", "%0A"]
    make = lambda: rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))])
    rows = [(rnd.randint(0, 40), rnd.randint(0, 9), rnd.choice(["user", "assistant", "system", None, "a%\n<|end|>"]), make(), "x") for _ in range(600)]
    rows += [(50, 1, "assistant", "same", "x")] * 2 + [(None, None, "user", "null", "x"), (51, None, "user", "n", "x"), (51, 0, "assistant", "y" * 200000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    rendered = chat.render(chat.fold(chat.turns_as_events(df)))
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    chars = {}
    for r in rendered.collect():
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.formatted)
        assert sum(r.formatted.count(c) for c in chat.CONTROL) == 2
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for c in convs:
        mine = sorted(((-1 if t is None else t), (role or ""), (x or "").encode()) for i, t, role, x, _ in rows if i == c)
        loss = b"".join(x for _, role, x in mine if role == "assistant")
        want = (len(mine), hashlib.sha256(b"".join(role.encode() + b"\n" + x + b"\n" for _, role, x in mine)).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), chars[c])
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) == want


def test_events(spark):
    log = [
        (1, 0, 0, "a", "start", "user", None), (1, 1, 0, "a", "delta", None, "Hel"), (1, 2, 0, "a", "delta", None, "lo"),
        (1, 3, 0, "b", "start", "assistant", None), (1, 4, 0, "b", "delta", None, "bad"), (1, 5, 0, "b", "regenerate", None, None), (1, 6, 0, "b", "delta", None, "go"), (1, 7, 0, "b", "delta", None, "od"),
        (1, 8, 0, "a", "edit", None, "Hi"), (1, 9, 0, "c", "start", "user", None), (1, 10, 0, "c", "delete", None, None), (1, 11, 0, "a", "delta", None, "!"), (2, 0, 0, "a", "start", "user", None),
    ]
    random.Random(2).shuffle(log)
    got = sorted(chat.fold(spark.createDataFrame(log, SCHEMA)).collect())
    assert [tuple(r) for r in got] == [(1, 0, "user", "Hi!"), (1, 3, "assistant", "good"), (2, 0, "user", "")]
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 0, 0, "a", "what", "", "")], SCHEMA)).collect()
    assert chat.read_back(chat.render(chat.fold(spark.createDataFrame([], SCHEMA)))).collect() == []
