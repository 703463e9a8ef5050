"""Prefix trie: the definition in plain Python, running values over partitions, list ranking in rounds."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    """The nodes of the rebuilt conversations, by the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members, ends, parent = defaultdict(list), defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -999, len(m), children.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -999 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def run(spark, rows, **kw):
    from reqscope.llm.prefix_trie import borrow_heads, ordered_turns, trie

    convs = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "k1": F.lit(None).cast("int"), "total": F.lit(0.5)}).repartition(3)
    conv = F.col("conv_id")
    return trie(*borrow_heads(ordered_turns(convs), conv - conv % 5, F.crc32(conv.cast("string")) % 9, most=8), **kw)


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        first = rng.choice(["hello", "héllo\nworld", "", None])
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, None]) if c % 9 == 0 else t, rng.choice(["user", None]) if c % 11 == 0 else ["user", "assistant"][t % 2], first if t < 2 else rng.choice("ab")))
    return rows + rows[5:9] + [(None, 1, "user", "lost"), (1000, None, None, None)]


def test_trie_matches_the_definition(spark):
    rows = conversations(3)
    assert found(run(spark, rows)) == brute_force(rows)


def test_one_conversation_and_one_start_hold_most_rows(spark, monkeypatch):
    from reqscope.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(400)]  # a long one
    rows += [(c, 0, "system", "same start") for c in range(21, 140)]  # all alike: one node ends most
    rows += [(c, t, "user", "x" * 20_000 if t == 1 else str(c)) for c in range(200, 280) for t in range(3)]  # many children of the root
    assert found(run(spark, rows, small=50)) == brute_force(rows)


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_lists_of_ids_in_pieces(most):
    import pyarrow as pa

    from reqscope.llm.prefix_trie import _hash_lists, _join_ids

    rows = [(k, k // 3, i) for k, n in enumerate([1, 9, 4, 30, 2]) for i in range(-3, n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[x:x + 5])], ["k1", "k2", "conv_id"]) for x in range(0, len(rows), 5)]
    pieces = list(_join_ids(iter(batches), most))
    assert max(len(x.split(",")) for b in pieces for x in b.column("ids").to_pylist()) <= most
    got = {(r["k1"], r["k2"]): r["ends_sha256"] for b in _hash_lists(iter(pieces)) for r in b.to_pylist()}
    want = defaultdict(list)
    for a, b, i in rows:
        want[a, b].append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_empty_and_turnless(spark):
    assert run(spark, []).count() == 0
    rows = [(3, 0, "user", "only")]  # its head is borrowed from a conversation that is not there
    assert found(run(spark, rows)) == brute_force(rows)
    assert found(run(spark, [(None, 0, "user", "x")])) == []


@pytest.mark.parametrize("small", [30, 10_000])
def test_list_ranking(spark, small):
    from reqscope.llm.list_rank import distances

    rng = random.Random(small)
    ids = rng.sample(range(-10**12, 10**12), 260)
    lists = [ids[:150], ids[150:259], ids[259:]]
    links = [(x, nxt) for part in lists for x, nxt in zip(part, [*part[1:], None])]
    rng.shuffle(links)
    got = dict(map(tuple, distances(spark.createDataFrame(links, "item long, next long"), small=small).collect()))
    assert got == {x: len(part) - k for part in lists for k, x in enumerate(part)}


def test_running_values_cross_partitions(spark):
    from reqscope.llm.scan import running

    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 2, 2, 3]), rng.randint(0, 50), rng.randint(-9, 9), rng.getrandbits(62)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, a long, x long").repartition(5)
    got = running(df.withColumn("one", F.lit(1).cast("long")), [F.col("k"), F.col("o"), F.col("x")], keys=["k"], add=["a", "one"], xor=["x"], index="at").orderBy("at").collect()
    key, total, bits, n = None, 0, 0, 0
    for at, r in enumerate(got):
        if r.k != key:
            key, total, bits, n = r.k, 0, 0, 0
        total, bits, n = total + r.a, bits ^ r.x, n + 1
        assert (r.at, r.run_a, r.run_x, r.run_one) == (at, total, bits, n)
    assert [(r.k, r.o, r.x) for r in got] == sorted((k, o, x) for k, o, _, x in rows)
