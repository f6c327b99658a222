import hashlib

import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from lexitide.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, window long, mask string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        loss = "".join(t for _, role, t in own if role == "assistant")
        out[conv] = (len(own), digest("".join(f"{role}\n{t}\n" for _, role, t in own)), len(loss), digest(loss))
    return out


TEXT = st.text(st.sampled_from(list("\\#</turn>: \nabé😀")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_escaping(role, text):
    line, start, end = chat.format_turn(role, text)
    assert chat.unescape(line[start:end]) == text and "###" not in line[4:] and line.count("</turn>") == 1
    assert chat.parse(line * 2) == [(role, text)] * 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), TEXT), min_size=1, max_size=25), st.integers(20, 200), st.integers(0, 100))
def test_windows(turns, budget, history):
    own = chat.Windows(chat.ChatConfig(budget, history), len)
    made = [w for t in turns for w in own.add(*t)] + list(own.end())
    new = [t for text, lead, _, _, _ in made for t in chat.parse(text)[lead:]]
    assert new == turns
    at = 0
    for text, lead, n, tokens, mask in made:
        got = chat.parse(text)
        assert len(got) == lead + n and n >= 1 and tokens == len(text)
        system = turns[0][0] == "system"
        assert tokens <= budget or n == 1 and lead <= (system and at > 0)
        if system and at:
            assert got[0] == turns[0]
        repeated = got[int(system and at > 0) : lead]
        assert repeated == turns[at - len(repeated) : at] and sum(len(chat.format_turn(*t)[0]) for t in repeated) <= history
        assert [chat.unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2])] == [t for r, t in got[lead:] if r == "assistant"]
        at += n


def test_query(spark):
    sf_dir = f"{DATA}/sf0.01"
    said = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = queries.op10_chat(spark, sf_dir).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}
    assert got == expected(rows) and got[-7][2:] == (26, digest(said)) and len(found) == len(got)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = {}
    for r in chat.windows(df).collect():
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + len(r.text)
    assert {r.conv_id: r.formatted_chars for r in found} == sizes
    once = {c: sum(len(chat.format_turn(r[2] or "", r[3] or "")[0]) for r in rows if r[0] == c) for c in sizes}
    assert all(sizes[c] >= once[c] for c in sizes) and sizes[-7] == once[-7]


@pytest.mark.parametrize("partitions, budget, history", [(1, 300, 80), (7, 300, 80), (7, 2048, 512), (7, 60, 200)])
def test_one_conversation_over_many_tasks(spark, partitions, budget, history):
    """A hot conversation's windows are made side by side, whatever range its turns lie in."""
    rows = [(1, 0, "system", "be brief")] + [(1, k, ["user", "assistant"][k % 2], f"turn {k} " * (k * 7 % 40)) for k in range(1, 400)]
    rows += [(c, k, "assistant", f"{c} {k}") for c in range(2, 30) for k in range(3)] + [(None, 0, "system", "x"), (None, 1, "assistant", "long " * 900)]
    config = chat.ChatConfig(budget, history)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat.windows(spark.createDataFrame([(*r, 5, "m") for r in rows], SCHEMA), config)
        found = sorted(made.collect(), key=lambda r: (r.conv_id or 0, r.window))
        assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()} == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    turns, at = [(r[2], r[3]) for r in rows if r[0] == 1], 0
    for r in [r for r in found if r.conv_id == 1]:
        got = chat.parse(r.text)
        assert len(got) == r.repeated + r.turns and r.turns >= 1
        assert r.tokens <= budget or r.turns == 1 and r.repeated <= 1
        if at:
            assert got[0] == turns[0]
        repeated = got[int(at > 0) : r.repeated]
        assert repeated == turns[at - len(repeated) : at] and 0 not in range(at - len(repeated), at if repeated else 0)
        # as much history as fits: one turn more would be too much
        more = at - len(repeated) - 1
        count = chat._counter(None)
        size = lambda t: count(chat.format_turn(*t)[0])
        if at and more >= 1:
            need = size(turns[0]) + size(got[r.repeated])
            assert sum(map(size, repeated)) + size(turns[more]) > min(history, budget - need)
        at += r.turns
    assert at == len(turns)


def test_awkward_rows(spark):
    long = "word " * 20_000
    rows = [(1, 0, "system", "be brief"), *[(1, k, ["user", "assistant"][k % 2], f"turn {k} " * 90) for k in range(1, 40)], (2, None, None, None), (2, 1, "assistant", long), (2, 2, "assistant", "after"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "tie"), (None, 0, "a:b\n", "no id"), (None, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, 5, "m") for r in rows], SCHEMA)
    made = chat.windows(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == expected(rows)
    by = sorted((r for r in made.collect() if r.conv_id == 1), key=lambda r: r.window)
    assert len(by) > 3 and all(r.tokens <= 2048 and chat.parse(r.text)[0] == ("system", "be brief") for r in by)
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0
