"""Corpus operators on groups and numbers that small tables do not reach, by lowered bounds."""

import numpy as np


def test_groups_are_divided_by_exact_numbers_of_tokens(spark, monkeypatch):
    """With more tokens than the table of cells tells apart, no token is rare by it; sets that share one
    frequent token of their many are parted all the same, and linked sets stay together."""
    from reqscope.llm import jaccard_join as J

    monkeypatch.setattr(J, "CELL_BITS", 4)
    monkeypatch.setattr(J, "PARTS", 1)
    monkeypatch.setattr(J, "COUNTED", 0, raising=False)
    monkeypatch.setattr(J, "HELD", 100)
    rng = np.random.default_rng(21)
    frequent, rows, linked = rng.integers(0, 2**63, 5).astype(np.uint64), [], []
    for k in range(50):
        own = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = [own] + ([np.append(own[3:], rng.integers(0, 2**63, 2).astype(np.uint64))] if k % 5 == 0 else [])
        linked += [(len(rows), len(rows) + 1)] if len(sets) > 1 else []
        rows += [(len(rows) + j - 20, 7, 9, bytearray(np.unique(np.concatenate([x, frequent])).tobytes()), 0) for j, x in enumerate(sets)]
    sets = spark.createDataFrame(rows, "cid long, grp long, blocks int, tokens binary, block int")
    group = {r.cid: r.grp for r in J.regrouped(sets, 80, 4).collect()}
    assert {c + 20 for c in group} == {c for pair in linked for c in pair}
    assert all(group[a - 20] == group[b - 20] for a, b in linked) and len(set(group.values())) == len(linked)


def test_linked_sets_share_one_of_their_rarest_tokens_by_exact_number():
    from reqscope.llm.jaccard_join import rarest

    rng = np.random.default_rng(22)
    for percent in (60, 80, 85, 100):
        for _ in range(40):
            pool = rng.integers(0, 2**63, 60).astype(np.uint64)
            sets = [np.unique(rng.choice(pool, int(rng.integers(1, 50)))) for _ in range(4)]
            sets += [np.unique(np.append(x[rng.random(len(x)) > 0.1], rng.integers(0, 2**63, 1).astype(np.uint64))) for x in sets]
            value, count = np.unique(np.concatenate(sets), return_counts=True)
            often = [count[np.searchsorted(value, x)] for x in sets]
            node = np.repeat(np.arange(len(sets)), [int((f > 1).sum()) for f in often])
            e = rarest(np.concatenate([x[f > 1] for x, f in zip(sets, often)]), node, np.concatenate([f[f > 1] for f in often]),
                       np.arange(len(sets)), np.array([len(x) for x in sets]), percent)
            heads = [set(e["sig"][e["node"] == k].tolist()) for k in range(len(sets))]
            for i in range(len(sets)):
                for j in range(i):
                    a, b = set(sets[i].tolist()), set(sets[j].tolist())
                    if 100 * len(a & b) >= percent * len(a | b):
                        assert heads[i] & heads[j]


def test_meetings_of_blocks_are_not_broadcast(spark, monkeypatch):
    """The lists of meetings, which grow with the square of a group, are in no table that is joined."""
    from reqscope.llm import jaccard_join as J

    rng = np.random.default_rng(23)
    words = [f"w{k}" for k in range(4000)]
    base = rng.choice(words, 60).tolist()
    texts = []
    for k in range(40):  # a chain: each differs from the one before in a few words
        base = [*base[2:], *rng.choice(words, 2).tolist()]
        texts.append((k, " ".join(base)))
    held, scratch = {}, J.scratch
    monkeypatch.setattr(J, "BLOCK", 2)
    monkeypatch.setattr(J, "scratch", lambda df, name, **kw: held.setdefault(name, scratch(df, name, **kw)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.component_id for r in J.jaccard_components(docs, 4, 60).collect()}
    assert found == {0}
    assert "meetings" in held and not any(f.dataType.typeName() == "array" for name in ("meetings", "round2-sets") for f in held[name].schema.fields)
