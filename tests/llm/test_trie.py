import hashlib
import random
import re
import zlib

from terrier.llm import trie
from terrier.llm.queries import op13_trie

DIR = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def turn_id(role, text):
    return SHA(f"{len(role)}:{role}{text}")[:32]


def plain_rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0, turn_id(role, text)), (role, text)))
    convs = {c: [x for _, x in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + ts[h:]
    return out


def plain_nodes(convs):
    """Every node by its definition."""
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        childless = [m for m in under if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in under if m)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(m) == len(node) + 1 for m in under), len(childless), saved, SHA(ends)))
    return sorted(out, key=str)


def told(frame):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()), key=str)


def test_query_against_the_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = told(op13_trie(spark, DIR))
    assert got == plain_nodes(plain_rebuilt(rows))
    assert any(r[4] > 1 and r[1] for r in got)


def test_layouts_grow_and_find():
    node = trie.Node(b"")
    order = random.Random(1).sample(range(256), 256)
    rooms = []
    for i, b in enumerate(order):
        node.add(b, trie.Node(bytes([b])))
        rooms.append(node.room)
        for k in range(256):
            found = node.branch(k)
            assert (found is not None and found.prefix == bytes([k])) == (k in order[: i + 1])
    assert [rooms[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [4, 16, 16, 48, 48, 256, 256]
    assert len(list(node.children())) == 256


def test_paths_are_compressed_and_only_whole_turns_are_nodes():
    a, b = b"\1" * 16 + b"\2" * 16, b"\1" * 16 + b"\2" * 7 + b"\3" * 9
    root = trie.tree([a, b, b"\1" * 16])
    assert root.prefix == b"\1" * 16 and root.value == 2
    (below,) = root.children()
    assert below.prefix == b"\2" * 6 and below.value is None and len(list(below.children())) == 2  # a branch within a turn
    rows = trie.nodes([a, b, b"\1" * 16], [1, 1, 1], [1, 2, 3], [[5, 7], [5, 9], [5]])
    assert sorted(r[3] for r in rows) == [0, 1, 2, 2]


def test_random_conversations_over_ranges(spark):
    rng = random.Random(7)
    turns = [("user", f"{i} " * rng.randint(0, 4)) for i in range(3)]
    convs = {rng.randrange(-50, 10_000): [rng.choice(turns) for _ in range(rng.randint(0, 6))] for _ in range(250)}
    convs |= {20_000 + i: [turns[0], turns[1]] for i in range(300)}  # one conversation very often
    convs |= {30_000 + i: [turns[0], ("x", str(i))] for i in range(300)}  # one first turn very often
    convs[40_000] = [turns[0]] * 300
    rows = [(c, [{"id": turn_id(*t), "words": len(t[1].split())} for t in ts], "n") for c, ts in convs.items()]
    frame = spark.createDataFrame(rows, "conv_id long, turns array<struct<id:string,words:long>>, node string")
    want = plain_nodes(convs)
    for parts in (1, 3, 37):
        assert told(trie.prefix_trie(frame.repartition(5), parts)) == want


def test_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, "user", "first"), (0, 1, None, "b c"), (0, 1, None, "b c"), (0, 1, "user", None), (7, 3, "user", "first"), (7, 2, "user", ""), (25, 1, "a", "of an absent base"), (26, 1, "a", "x y"), (26, 2, "b", "z" * 200_000), (40, 0, "u", "w " * 100_000), (41, 0, "u", "w " * 100_000), (-3, 1, "user", "first"), (60, 5, "ü", "é")]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, turns int, node string")
    got = told(trie.prefix_trie(trie.rebuilt(frame)))
    assert got == plain_nodes(plain_rebuilt(rows))
    assert any(len(v) == 0 for v in plain_rebuilt(rows).values())
    assert trie.prefix_trie(trie.rebuilt(frame.limit(0))).count() == 0
    assert trie.prefix_trie(trie.rebuilt(frame.filter("conv_id is null"))).count() == 0
