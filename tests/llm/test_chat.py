"""Chat formatting: what is read back equals what went in."""

import hashlib
import random

from tiltkit.llm import chat as C

from .conftest import SF001

TEXTS = ["", None, "plain", "\\### Assistant: </turn> ok", "####", "###", "## #", "</turn>\n", "</part>", "<</turn>>", "\\b\\h\\l\\n\\0",
         "\\", "a\nb:\n### user:\n", "### assistant:\n</part>", "日本 ###\\", "</tu</turn>rn>", "\\\\l/turn>"]
ROLES = ["user", "assistant", "system", None, "a:\nb", "\\0", "### x", "</turn>\n", ""]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    """rows of one conversation, in order."""
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), sha(turns), len(loss), sha(loss)


def check(spark, convs):
    rows = [(i, n, r, t, "x") for i, c in convs.items() for n, (r, t) in enumerate(c)]
    random.Random(0).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = C.format_chats(turns)
    got = {r.conv_id: r for r in C.digests(chats).collect()}
    assert set(got) == set(convs)
    for i, c in convs.items():
        r = got[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(c), c
    return {r.conv_id: r for r in chats.collect()}


def test_random_conversations(spark):
    r = random.Random(9)
    check(spark, {i: [(r.choice(ROLES), r.choice(TEXTS)) for _ in range(r.randrange(1, 12))] for i in range(300)})


def test_output_format_and_merging(spark):
    got = check(spark, {1: [("user", "a"), ("user", "b"), ("assistant", "c#"), ("assistant", "d"), (None, "e")], None: [("assistant", "x")]})
    assert got[1].formatted == "### user:\na</part>b</turn>\n### assistant:\nc#</part>d</turn>\n### \\0:\ne</turn>\n"
    spans = [got[1].formatted[s.start:s.start + s.length] for s in got[1].loss_spans]
    assert spans == ["c#", "d"]


def test_long_conversation_ties_and_empty(spark):
    check(spark, {5: [("user" if i % 2 else "assistant", f"t{i} " * 20) for i in range(3000)]})
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "user", "a"), (1, 0, "assistant", "z")],
                                 "conv_id long, turn long, role string, text string")
    assert C.format_chats(tied).first().formatted == "### user:\na</turn>\n### assistant:\nz</turn>\n### user:\nb</part>b</turn>\n"
    assert C.digests(C.format_chats(tied.limit(0))).count() == 0


def test_marks_conversation_and_whole_table(spark):
    turns = spark.read.parquet(f"{SF001}/conversations.parquet")
    got = {r.conv_id: r for r in C.digests(C.format_chats(C.with_marks_conversation(turns, spark))).collect()}
    said = "\\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].turns_sha256, got[-7].loss_chars, got[-7].loss_sha256) == want([("user", said), ("assistant", said)])
    convs = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    for i, c in convs.items():
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want(c)


def test_no_python_in_the_plan(spark):
    turns = spark.read.parquet(f"{SF001}/conversations.parquet")
    plan = C.digests(C.format_chats(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
