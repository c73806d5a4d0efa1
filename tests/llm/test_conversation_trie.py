"""Conversation trie against a plain node table, and the z-fast trie alone."""

import hashlib
import random
import zlib

import pytest

from tiltkit.llm import conversation_trie as C
from tiltkit.llm import queries
from tiltkit.llm.zfast import ZFastTrie, two_fattest

from .conftest import SF001

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, parent string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda t: (t[0], t[1] or 0))] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])
        out[c] = base[:h] + turns[h:]
    return out


def brute(convs):
    """Sorted result rows from the sequences by id."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        bytes_saved = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += bytes_saved
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                   for p, m in nodes.items()), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_deepest_node(seed):
    r = random.Random(seed)
    seqs = sorted({tuple(r.choice("ab" if r.random() < 0.5 else "abc") for _ in range(r.randrange(30))) for _ in range(150)})
    path = lambda s: [s[:d] for d in range(len(s) + 1)]
    trie = ZFastTrie(())
    for at in range(0, len(seqs), 40):
        trie.insert([(path(s), [0] + [1] * len(s), 1, seqs.index(s), None) for s in seqs[at:at + 40]])
    ends, todo = set(), [trie.root]
    while todo:
        n = todo.pop()
        ends.add(n.path[n.end])
        todo += n.below.values()
        assert n is trie.root or trie.handles[n.path[two_fattest(n.start, n.end)]] is n
    assert len(trie.handles) == len(ends) - 1 and set(seqs) <= ends
    for _ in range(300):
        s = tuple(r.choice("abc") for _ in range(r.randrange(33)))
        node, edge = trie.deepest(path(s), trie.root)
        assert node.path[node.end] == max((s[:d] for d in range(len(s) + 1) if s[:d] in ends), key=len)
        assert edge is None or edge.path[node.end + 1] == s[:node.end + 1]
    seen = {p[d]: (children, t.n, t.leaves) for p, d, children, _, t, _ in trie.expanded()}
    assert set(seen) == {s[:d] for s in seqs for d in range(len(s) + 1)}


def sample_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 10**12, 10**12 + 3]:
        if r.random() < 0.2:
            continue
        n = r.choice([1, 2, 3, 4, 9, 14])
        for t in range(n):
            text = "hot" if t < 2 and r.random() < 0.8 else f"{r.choice('abcdé')}{t}"
            rows.append((c, None if t == 0 and c % 7 == 0 else t, r.choice(["user", None]) if t % 2 else "assistant", text if r.random() < 0.9 else None, "x", "y"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,most,batch,chunk", [(1, 10**6, 1000, 1000), (2, 1, 1, 1), (3, 20, 3, 2)])
def test_nodes_equal_brute_force(spark, seed, most, batch, chunk):
    """Also with a trie per sequence, and with ids split to many strings."""
    rows = sample_rows(seed) + [(None, 1, "user", "nobody", "x", "y")]
    got = told(C.trie_nodes(C.with_shared_starts(spark.createDataFrame(rows, SCHEMA)), most, batch, chunk))
    assert got == brute(rebuilt(rows))


def test_conversations_without_turns_and_a_hot_conversation(spark):
    rows = [(c, t, "user", f"same{t}") for c in range(0, 4000, 5) for t in range(3)] + [(1, 0, "user", "own"), (57, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = brute(rebuilt(rows))
    assert told(C.trie_nodes(C.with_shared_starts(df), chunk=100)) == want
    turnless = spark.createDataFrame([(5, []), (3, [])], "conv_id bigint, turns array<struct<d:binary,w:bigint>>")
    assert told(C.trie_nodes(turnless)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_very_long_conversation_and_text(spark):
    rows = [(5, t, "user", "é" * (200_000 if t == 3 else 1)) for t in range(3000)] + [(6, t, "user", "é") for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = told(C.trie_nodes(C.with_shared_starts(df)))
    convs = rebuilt(rows)
    assert len(got) == len({tuple(t[:d]) for t in convs.values() for d in range(len(t) + 1)})
    root = next(g for g in got if g[1] == 0)
    shared = 0
    while shared < min(len(convs[5]), len(convs[6])) and convs[5][shared] == convs[6][shared]:
        shared += 1
    assert root[3] == 2 and root[6] == sum(len(x.encode()) for _, x in convs[5][:shared])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.trie_nodes(C.with_shared_starts(df)).count() == 0


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(5, 0, "user", "a"), (5, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    got = told(C.trie_nodes(C.with_shared_starts(df)))
    assert sorted((g[1], g[3]) for g in got) == [(0, 1), (1, 1), (2, 1)]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op12_conversation_trie(spark, SF001)) == brute(rebuilt(rows))
