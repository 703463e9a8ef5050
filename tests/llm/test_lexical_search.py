"""Ranked lexical search: every document scored in plain Python, odd rows, pruning that is lossless."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k):
    """(item, rank, doc, score) by the definition; rows with equal scores and ids are alike."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"W{k}" if k % 3 else f"é{k}" for k in range(200)]
    pick = lambda m: " ".join(words[min(199, int(rng.expovariate(0.03)))] for _ in range(m))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [docs[5], (None, docs[5][1]), (None, docs[6][1]), (-8, None), (-9, ""), (-10, " .,\n!"), (-11, pick(30_000)), (-12, "x" * 200_000)]
    items = [(i, pick(rng.randint(1, 40))) for i in range(12)] + [(3, docs[7][1]), (None, docs[6][1].upper()), (50, None), (51, "?!"), (52, "nowhere"), (53, " ".join(words)), (54, "x" * 200_000)]
    return docs, items


def test_search_matches_the_definition(spark, monkeypatch):
    from reqscope.llm import lexical_search as S

    docs, items = corpus(1)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "_id": F.lit(1), "term": F.lit(0)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit("x"), "iid": F.lit(1), "block": F.lit(0)}).repartition(2)
    index, n, _ = S.build_index(rows, shard_docs=32)
    assert index.count() > 6
    want = brute_force(docs, items, 10)
    assert found(S.search(index, n, asked)) == want
    monkeypatch.setattr(S, "BLOCK_BYTES", 2000)  # several passes
    assert found(S.search(index, n, asked)) == want


def test_empty_tables(spark):
    from reqscope.llm import lexical_search as S

    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert S.search(S.build_index(none)[0], 0, items).count() == 0
    index, n, _ = S.build_index(some)
    assert n == 1 and S.search(index, n, items.limit(0)).count() == 0
    assert found(S.search(index, n, items)) == brute_force([(1, "a b"), (2, None)], [(1, "a b"), (2, None)], 10)


def shard_of(docs):
    from reqscope.llm import lexical_search as S

    texts = [t or "" for _, t in docs]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array(texts)], ["_id", "_text"])
    n, total = (x[0] for x in list(S._count(iter([batch])))[0].to_pydict().values())
    return S.Shard(list(S._index(n, total, 1 << 13)(iter([batch])))[0].to_pylist()[0]), n


def test_treap_opens_few_ranges_and_walks_down_again_when_wide():
    from reqscope.llm import lexical_search as S

    rng = random.Random(4)
    topics = [[f"t{k}w{j}" for j in range(60)] for k in range(40)]
    docs = [(i, " ".join(rng.choice(topics[i % 40]) for _ in range(40))) for i in range(2000)]
    shard, n = shard_of(docs)
    empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    opened = 0
    for item in range(20):
        own = sorted({t.encode() for t in rng.sample(topics[item], 8)})
        rows = shard.find(pa.array(own, pa.large_binary()))
        counts = Counter(t for _, x in docs for t in set(x.split()))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts[t.decode()] + 1))) for t in own])
        best, ranges = shard.search(rows, weight, empty, 10)
        opened += ranges
        want = brute_force(docs, [(0, " ".join(t.decode() for t in own))], 10)
        assert sorted(zip(best[2].tolist(), best[0].tolist())) == sorted((d, s) for _, _, d, s in want)
        again, _ = shard.search(rows, weight, empty, 10, kept=64)  # paths are walked from the top
        assert all((a == b).all() for a, b in zip(best, again))
    assert opened < 0.25 * 20 * 2 * 2000  # of all ranges
    assert S.SHARD_DOCS << 1 <= 1 << 16  # columns fit the interleaving of bits
