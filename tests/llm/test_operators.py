"""Small cases for the corpus operators: nulls, empty and repeated rows, clashing names, brute force."""

import ast
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_dropped long, _row int, score double"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    """Documents with copies, near copies, shared lines and passages, nulls and blanks; columns
    named like the operators' own ones."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage, line = prose(rng, 60), "Shared LINE here "
    base = prose(rng, 150).split()
    for k in range(12):
        near = list(base)
        near[k * 7] = f"edit{k}"
        texts += [" ".join(near), f"{prose(rng, 5)}\n{line.upper() if k % 2 else line}\n{prose(rng, 4)}", f"{prose(rng, 20)} {passage} {prose(rng, 10)}"]
    texts += [texts[0]] * 3 + [None, "", " \t\n", "é" * 300, "x"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 5, 6, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[1], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup_matches_the_definition(spark, docs, nothing):
    from reqscope.llm.line_dedup import brute_force, dedup_lines

    rows = corpus()
    want = sorted((str(r[0]), *b) for r, b in zip(rows, brute_force([r[1] for r in rows], 10)))
    got = dedup_lines(docs, 10)
    assert got.columns == [c for c in docs.columns if c != "n_dropped"] + ["n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == want
    assert any(w[2] for w in want)
    assert dedup_lines(nothing, 10).count() == 0


def test_line_index_is_reversible(spark, docs):
    from reqscope.llm.line_dedup import CuckooFilter, LineIndex

    def state(ix):
        refs = sorted(map(tuple, ix.refs.collect()))
        full = {r.shard: CuckooFilter.load(bytes(r.filter)) for r in ix.filters.collect()}
        hot = [(hi, lo, bool(full[s].contains(np.array([hi]), np.array([lo]))[0])) for s, hi, lo, n in refs if n >= 3]
        return refs, hot, {s: int((f.table > 0).sum()) for s, f in full.items()}

    one, two = docs.where("doc_id < 30"), docs.where("doc_id >= 30")
    ix = LineIndex(spark, 3, shards=3).insert(one)
    before = state(ix)
    ix.insert(two)
    assert state(ix)[0] != before[0]
    after = state(ix.delete(two))
    assert after[0] == before[0] and after[1] == before[1]
    assert {s: n for s, n in after[2].items() if n} == {s: n for s, n in before[2].items() if n}


def test_cuckoo_filter():
    from reqscope.llm.line_dedup import CuckooFilter

    rng = np.random.default_rng(3)
    hi, lo = rng.integers(-2**62, 2**62, 3000), rng.integers(-2**62, 2**62, 3000)
    f = CuckooFilter.sized_for(3000)
    assert f.insert(hi, lo) and f.contains(hi, lo).all()
    f = CuckooFilter.load(f.dump())
    f.delete(hi[:1500], lo[:1500])
    assert f.contains(hi[1500:], lo[1500:]).all() and f.contains(hi[:1500], lo[:1500]).mean() < 0.05


def shingle_set(text, width):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute_components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("block,width,percent", [(512, 4, 85), (3, 5, 80), (2, 3, 60)])
def test_jaccard_components(spark, docs, nothing, monkeypatch, block, width, percent):
    from reqscope.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK", block)  # small blocks: both rounds of large groups
    rows = [(r[0], r[1]) for r in corpus()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs, width, percent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows, width, percent)))
    if block == 512:
        assert J.jaccard_components(nothing, width, percent).count() == 0


def test_keep_one(spark, docs):
    from reqscope.llm.jaccard_join import keep_one

    kept = keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    rows = [(r[0], r[1]) for r in corpus()]
    want = {d for d, n, c in brute_components(rows, 5, 80) if d == c}
    assert {r.doc_id for r in kept.collect()} == want


def test_slices_meet_for_all_pairs_above_the_threshold():
    """Every pair of sets above the threshold shares a slice content."""
    from reqscope.llm.jaccard_join import Bands, slice_entries

    rng = np.random.default_rng(5)
    for percent in (60, 80, 85):
        for _ in range(150):
            n = int(rng.integers(1, 60))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a[rng.random(n) > (100 - percent) / 150]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
            a = np.unique(a)
            if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            value, row, size = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)])
            e = slice_entries(value, row, size, np.array([1, 2]), Bands(percent, int(size.max())))
            assert set(e["sig"][e["node"] == 1]) & set(e["sig"][e["node"] == 2])


def test_large_groups_are_divided_by_rare_tokens(spark, monkeypatch):
    """Sets that share frequent tokens only part; linked sets stay together, whatever is frequent."""
    from reqscope.llm import jaccard_join as J

    rng = np.random.default_rng(8)
    frequent, rows, linked = rng.integers(0, 2**63, 12).astype(np.uint64), [], []
    for k in range(60):
        own = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = [own] + ([np.append(own[3:], rng.integers(0, 2**63, 2).astype(np.uint64))] if k % 4 == 0 else [])
        linked += [(len(rows), len(rows) + 1)] if len(sets) > 1 else []
        rows += [(len(rows) + j, 7, 9, bytearray(np.unique(np.concatenate([x, frequent])).tobytes()), 0) for j, x in enumerate(sets)]
    rows += [(1000 + j, 8, 1, bytearray(np.arange(j, 20 + j, dtype=np.uint64).tobytes()), 0) for j in range(2)]  # a small group
    sets = spark.createDataFrame(rows, "cid long, grp long, blocks int, tokens binary, block int")
    monkeypatch.setattr(J, "HELD", 100)
    got = J.regrouped(sets, 80, 4)
    assert got.columns == sets.columns
    group = {r.cid: r.grp for r in got.collect()}
    assert all(group[a] == group[b] for a, b in [*linked, (1000, 1001)])
    assert len(group) == 2 * len(linked) + 2 and len(set(group.values())) == len(linked) + 1


def test_linked_sets_share_a_rare_token():
    from reqscope.llm.jaccard_join import CELL_BITS, rare_entries

    rng = np.random.default_rng(6)
    counts = rng.integers(2, 9, 1 << CELL_BITS).astype(np.uint16)
    for percent in (60, 80, 85, 100):
        for _ in range(150):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 60))).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > (100 - percent) / 150], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                assert np.intersect1d(*(rare_entries(x, counts, percent, 3, 1)["sig"] for x in (a, b))).size


def test_packed_entries_round_trip():
    from reqscope.llm.jaccard_join import ENTRY, pack_entries, unpack_entries

    e = np.zeros(70_000, ENTRY)
    e["sig"], e["node"] = np.arange(70_000), np.arange(70_000) * 7 - 5
    out = unpack_entries(pack_entries(e))
    assert (out["sig"] == e["sig"]).all() and (out["node"] == e["node"]).all()


def test_components_of_paths_and_stars(spark):
    from reqscope.llm.components import components

    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (None, 3), (7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1
    assert len({got[0], got[1000], got[5000], got[7000]}) == 4


def test_containment(spark, docs, nothing):
    from reqscope.llm.decontaminate import drop_contained, find_contained

    rows = corpus()
    items = [(1, rows[42][1]), (2, " ".join((rows[50][1] or "").split()[3:40])), (3, None), (4, ""), (5, "w1"), (6, "nothing like this in any text"), (None, rows[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(r[0]), str(i), len(s & shingle_set(r[1], 5))) for r in rows for i, t in items
                  for s in [shingle_set(t, 5)] if s and 100 * len(s & shingle_set(r[1], 5)) >= 80 * len(s))
    got = find_contained(docs, bench)
    assert sorted((str(r.doc_id), str(r.item_id), r.n_found) for r in got.collect()) == want and want
    leaked = {w[0] for w in want}
    kept = drop_contained(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if str(r[0]) not in leaked)
    assert find_contained(nothing, bench).count() == 0 and drop_contained(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("hot,piece", [(256, 1 << 20), (1, 900)])
def test_substring_dedup_in_process(monkeypatch, hot, piece):
    """The steps on Arrow tables, with small pieces and anchors that count as hot."""
    import pyarrow.compute as pc

    from reqscope.llm import substring_dedup as S

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "SORT_BYTES", 4000)
    rows = [(r[0], r[1]) for r in corpus()] + [(500, "ab" * 200), (501, "ba" * 100), (500, "ab" * 300)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array([r[0] for r in rows], pa.int64()), "_text": pa.array([r[1] for r in rows], pa.string())})
    pieces = pa.Table.from_batches(list(S._pieces(iter([batch]))))
    n = 3
    part = lambda t, c, v: t.filter(pc.equal(t.column(c), v))
    sent = pa.Table.from_batches(list(S._anchors(50, n)(iter(pieces.to_batches()))))
    told = pa.concat_tables([S._shared(part(sent, "shard", s)) for s in range(n) if part(sent, "shard", s).num_rows])
    make = S._contexts(50, n, n)
    ids = pieces.column("piece").unique()
    contexts = pa.concat_tables([make(part(pieces, "piece", i), part(told, "piece", i)) for i in ids])
    sort = S._sort_contexts(50)
    least = pa.concat_tables([sort(part(contexts, "shard", s)) for s in range(n) if part(contexts, "shard", s).num_rows])
    every = pa.concat_tables([least, told.append_column("least", pa.nulls(told.num_rows, pa.binary())).select(least.column_names)])
    cut = S._cut(50, n)
    got = [tuple(r.values()) for i in ids for r in cut(part(pieces, "piece", i), part(every, "piece", i)).to_pylist()]
    want = S.brute_force(rows, 50)
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want)


def test_substring_dedup(spark, docs, nothing):
    from reqscope.llm.substring_dedup import brute_force, dedup_substrings

    rows = [(r[0], r[1]) for r in corpus()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_substrings(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_force(rows, 50), key=repr)
    assert dedup_substrings(nothing).count() == 0


def test_suffix_array():
    from reqscope.llm.substring_dedup import suffix_array

    rng = random.Random(2)
    for _ in range(200):
        s = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 50))])
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_language_id_held_out(spark, nothing):
    from reqscope.llm.language_id import held_out, identify, train

    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "éèêüßñoa"}
    rows = [(i, " ".join("".join(rng.choice(letters[l]) for _ in range(rng.randint(2, 7))) for _ in range(25)), l) for i in range(90) for l in [("aa", "bb", "cc")[i % 3]]]
    rows += [(200, None, "aa"), (201, "123 !?", "bb"), (202, "", None), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = train(docs, docs["lang"], ~held_out(docs["doc_id"]))
    got = identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    out = {r.doc_id: r for r in got.collect()}
    assert all(out[i].lang_pred == rows[i][2] for i in range(90)) and out[None].lang_pred == "aa"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (200, 201, 202)) and out[200].text is None
    assert all(0 <= r.score <= 1 for r in out.values())
    blank = train(nothing, nothing["lang"], F.lit(True))
    assert {r.lang_pred for r in identify(docs, blank).collect()} == {"und"} and identify(nothing, model).count() == 0


def test_chat_format_round_trip(spark):
    from reqscope.llm.chat_format import ChatMarkup, format_conversations, locate, read_back

    tricky = "a<|im_end|>\n<\\|im_start|> <\\\\|x|> é<"
    rows = [(1, 2, "assistant", tricky), (1, 1, "user", None), (1, 1, "system", "s\\n"), (None, 0, "us\ner\\", ""), (2, None, None, "x"), (1, 3, "assistant", ""), (1, 3, "assistant", "")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in read_back(format_conversations(convs, block=2)).collect()}
    for c in (1, 2, None):
        mine = sorted(((t is not None, t or 0, r is not None, r or "", x is not None, x or "") for i, t, r, x in rows if i == c))
        turns = [(r, x) for _, _, _, r, _, x in mine]
        loss = "".join(x for r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (
            len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(ChatMarkup()(turns)))
    assert format_conversations(convs.limit(0)).count() == 0
    for t in (tricky, "<|", "<\\|", "<\\\\|", "|<|<||"):
        assert ChatMarkup.unescape(ChatMarkup.escape(t)) == t and "<|" not in ChatMarkup.escape(t)

    def forgets(turns):  # drops the thoughts of earlier turns
        return "".join(f"[{r}]{x if k == len(turns) - 1 else x.split('#')[0]};" for k, (r, x) in enumerate(turns))

    spans = locate(forgets, [("user", "q"), ("assistant", "a#thought"), ("user", "r")])
    assert [s["changed_from"] for s in spans] == [None, None, len("[user]q;[assistant]a")]


def test_pii_base_spans_and_added_ones(spark, nothing):
    from reqscope.llm.pii import KINDS, base_spans, find_pii, luhn, redact

    rng = random.Random(6)
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
                ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
                ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
                ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15))
    for _ in range(3000):
        t = "".join(rng.choice(["@", ".", "a", "B-", "9", "4", "25", " ", "+", "(", "-", "@x.y", "0", "é", "300.", "4111 1111 1111 1111"]) for _ in range(rng.randint(0, 18)))
        want = sorted((m.start(), KINDS.index(k), m.end()) for k, p, ok in patterns for m in re.finditer(p, t) if ok(m[0]))
        assert [(a, KINDS.index(k), b) for k, a, b in base_spans(t)] == want, t
    rows = [(i, f"call +1 415 555 {1000 + i} or a{i}@b.org on 10.0.0.{i} not 999.1.1.{i} or +12 x token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"") for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, None), (91, ""), rows[0]], "doc_id long, text string").withColumn("base", F.lit(0))
    got = find_pii(docs).collect()
    assert len(got) == 83 and all([tuple(s) for s in r.base] == base_spans(r.text or "") for r in got)
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in got)
    assert sum(any(s.kind == "secret" for s in r.spans) for r in got) == 81
    assert "[phone]" in redact(docs).where("doc_id = 3").first().text
    assert find_pii(nothing).count() == 0


def test_top_k(spark):
    from reqscope.llm.topk_search import best_of_blocks, top_k, whole_vectors

    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(0, [1.0] * 6), (500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (60, [0.5, 0.5]), (504, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = top_k(whole_vectors(t, F.col("embedding"), F.col("vec_id")), F.col("vec_id") % 20 == 0, k=5)
    ok = [(i, np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))).astype(int)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, v) in enumerate(ok):
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(ok) if m != n)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    blocks = [(np.arange(k, k + 10), np.arange(k, k + 10), rng.integers(-5, 5, (10, 4)) + 40 * (k == 20)) for k in range(0, 60, 10)]
    _, opened = best_of_blocks(np.array([-1]), np.array([[1, 1, 1, 1]]), blocks, 3)
    assert opened < len(blocks)  # bounds prune


def test_mixing(spark, docs, nothing):
    from reqscope.llm.mixing import min_cost_flow, mix, mix_by_source, water_fill

    out = mix_by_source(docs).collect()
    rows = corpus()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.size == words and 0 <= r.taken <= 3 * words
        t = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.size
        t[1] += r.taken
    target = {k: v[2] for k, v in by.items()}
    assert all(v[0] == v[3] and abs(v[1] - v[2]) < 1 for v in by.values())
    assert abs(sum(target.values()) - sum(v[0] for v in by.values())) < 1e-6
    assert sorted(map(str, mix_by_source(docs).select("doc_id", "taken").collect())) == sorted(str(r) for r in mix_by_source(docs.repartition(5)).select("doc_id", "taken").collect())
    assert mix_by_source(nothing).count() == 0
    fill = water_fill({"a": 10, "b": 100}, {"a": 1, "b": 1}, 3)
    assert fill == {"a": 30, "b": 80}
    flow = min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10}, 3)
    assert flow == {("a",): 10, ("a", "b"): 10, ("b",): 10}  # no repetition is needed
    members = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 0, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>"))
    got, table = mix(docs, members)
    assert {r.source for r in table.collect()} == {"x", "y"} and got.where("doc_id % 2 = 1 and doc_id % 3 > 0 and taken > 0").count() == 0


def test_near_passages(spark, nothing):
    from reqscope.llm.passage_dedup import compact_windows, near_passages

    rng = random.Random(9)
    one, two = prose(rng, 70).split(), prose(rng, 90).split()
    edited = [w if k != 45 else "changed" for k, w in enumerate(two)]
    text = lambda *parts: " ".join(" ".join(p) if isinstance(p, list) else p for p in parts)
    rows = [(1, text(prose(rng, 80), one, prose(rng, 30))), (2, text(prose(rng, 10), one)), (3, text(one, prose(rng, 100))), (4, text(two, prose(rng, 20))),
            (5, text(prose(rng, 33), edited, prose(rng, 12))), (6, prose(rng, 200)), (7, None), (8, ""), (9, "short"), (None, text(one)), (1, text(one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("similarity", F.lit(0))
    got = near_passages(docs).collect()
    found = {(r.doc_id, r.src_doc_id) for r in got}
    assert {(2, 1), (3, 1), (None, 1), (5, 4)} <= found and not any(a in (4, 6, 1) for a, _ in found)
    assert any(r.start_word <= 10 and r.end_word >= 80 and r.similarity == 1 for r in got if (r.doc_id, r.src_doc_id) == (2, 1))
    assert any(r.start_word <= 33 and r.end_word >= 123 and r.similarity >= 0.8 for r in got if (r.doc_id, r.src_doc_id) == (5, 4))
    assert near_passages(nothing).count() == 0
    h = np.array([5, 3, 9, 1, 7, 2], np.uint64) << np.uint64(32)
    assert sorted(zip(*[x.tolist() for x in compact_windows(h, np.array([0]), 2)])) == [(0, 1, 2), (0, 3, 5), (4, 5, 5)]


def similar_windows_exist(x, y, percent, length):
    """Brute force over all pairs of windows of at least ``length`` places (no shingle repeats in a side)."""
    common = np.zeros((len(x) + 1, len(y) + 1), int)
    common[1:, 1:] = np.cumsum(np.cumsum(x[:, None] == y[None, :], 0), 1)
    size = np.arange(len(y) + 1)[None, :] - np.arange(len(y) + 1)[:, None]
    for a in range(len(x) - length + 1):
        for e in range(a + length, len(x) + 1):
            row = common[e] - common[a]
            k = row[None, :] - row[:, None]
            if ((size >= length) & (100 * k >= percent * (e - a + size - k))).any():
                return True
    return False


def edited_passages(rng, sizes, step=1):
    """(passage, the same with one word changed, left out or put in), an edit at every ``step``-th place."""
    for m in sizes:
        for at in range(0, m, step):
            p = prose(rng, m).split()
            yield p, p[:at] + [["changed"], [], [p[at], "more"]][(at // step) % 3] + p[at + 1:]


def test_similar_segments_against_all_windows():
    from reqscope.llm.passage_dedup import dense_segments, similar_segments

    match = np.array([True] * 31 + [False] * 5 + [True] * 30)
    assert dense_segments(match, 88, 46) == [(0, 66)]  # neither run is long enough by itself
    rng = random.Random(12)
    numbers = {}
    places = lambda words: np.array([numbers.setdefault(tuple(words[i:i + 5]), len(numbers)) for i in range(len(words) - 4)], np.uint32)
    around = lambda p: prose(rng, rng.randint(5, 15)).split() + p + prose(rng, rng.randint(5, 15)).split()
    pairs = [*edited_passages(rng, (49, 50, 52, 60, 71)), *edited_passages(rng, (85, 120), 9)]
    pairs += [(p, q[:k] + ["two"] + q[k + 1:]) for p, q in edited_passages(rng, (70, 90), 6) for k in (20, 45)]
    n = 0
    for p, q in pairs:
        x, y = places(around(p)), places(around(q))
        found = similar_segments(x, y, 80, 46)
        assert bool(found) == similar_windows_exist(x, y, 80, 46)
        for a, e, c, d, similarity in found:
            k = len(set(x[a:e]) & set(y[c:d]))
            assert e - a >= 46 and d - c >= 46 and similarity == k / (e - a + d - c - k) >= 0.8
        n += bool(found)
    assert n > 250


def test_window_payloads_are_smaller_byte_by_byte():
    import numpy as np
    import zstandard

    from reqscope.llm.passage_dedup import ENTRY, PAIR, _columns, _rows

    rng = np.random.default_rng(8)
    for kind in (ENTRY, PAIR):
        a = np.zeros(300, kind)
        for c in kind.names:
            a[c] = rng.integers(0, 1 << 60, 300) if c == "value" else np.repeat(rng.integers(0, 1 << 60, 10), 30) if c.endswith(("id", "key")) else rng.integers(0, 400, 300)
        packed = _columns(a)
        assert np.array_equal(_rows(packed, kind), a)
        assert len(packed) < 0.8 * len(zstandard.ZstdCompressor(level=1).compress(a.tobytes()))


def test_near_passages_with_one_edit_anywhere(spark):
    from reqscope.llm.passage_dedup import near_passages

    rng = random.Random(13)
    pairs = [*edited_passages(rng, (50, 55, 60, 70, 80)), *edited_passages(rng, (100, 120), 4)]
    rows = [(2 * k + s, f"{prose(rng, 12)} {' '.join(p)} {prose(rng, 9)}") for k, pair in enumerate(pairs) for s, p in enumerate(pair)]
    found = {(r.doc_id, r.src_doc_id) for r in near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(len(pairs))}
    assert len(found) >= 0.95 * len(pairs), (len(found), len(pairs))  # MinHash: by chance, not always


def test_near_passages_meet_every_unlike_text(spark):
    from reqscope.llm.passage_dedup import near_passages

    rng = random.Random(21)
    base = prose(rng, 120).split()

    # every text has another word changed, so no two are equal; only the two smallest ids were sources before
    texts = [" ".join(f"new{k}" if k == 10 + 18 * i else w for k, w in enumerate(base)) for i in range(6)]
    rows = [*enumerate(texts), (10, texts[0]), (11, texts[3]), (None, texts[5])]
    got = near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.src_doc_id) for r in got}
    assert {(i, j) for i in range(6) for j in range(i)} <= found
    assert {(10, 0), (11, 3), (None, 5)} <= found  # copies are told by their representative
    assert not any(b is None or a == b or (a is not None and a < b) for a, b in found)


def test_chat_format_sees_whole_prefixes_over_block_edges(spark):
    from reqscope.llm.chat_format import format_conversations, locate

    def forgets(turns):  # a user's turn drops the thoughts of all earlier answers
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"[{r}]{x if k > last else x.split('#')[0]};" for k, (r, x) in enumerate(turns))

    def numbered(turns):
        return "".join(f"{k}/{r}: {x}\n" for k, (r, x) in enumerate(turns))

    def keeps_three(turns):
        return "".join(f"[{r}]{x};" for r, x in turns[-3:])

    turns = [("user", "q")] + [("assistant", f"a{k}#thought{k}") for k in range(9)] + [("user", "r"), ("assistant", "b#c")]
    convs = spark.createDataFrame([(c, k, r, x) for c in (1, 2) for k, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    columns = ["piece", "start", "text_start", "text_end", "changed_from"]
    for render in (forgets, numbered, keeps_three):
        want = [tuple(x[c] for c in columns) for x in locate(render, turns)]
        for block in (3, 256):
            got = format_conversations(convs, render, block=block).collect()
            for c in (1, 2):
                assert [tuple(r[k] for k in columns) for r in sorted(got, key=lambda r: r.seq) if r.conv_id == c] == want, (render, block)
            assert all(r.in_loss == (turns[r.seq][0] == "assistant" and r.changed_from is None) for r in got)
    assert locate(forgets, turns)[10]["changed_from"] == len("[user]q;[assistant]a0")  # nine turns back


def test_pii_thresholds_cover_all_labelled_candidates(spark, monkeypatch):
    """A kind that is rare in the sample, not in the table, has a threshold of its own."""
    from reqscope.llm import pii as P

    monkeypatch.setattr(P, "SAMPLE", 200)
    texts = [f"mail a{i}@b.org id abcdefghijklmnopqrst{i % 10}" for i in range(1500)]
    texts += [f"at 10.{i}.0.5 then" if i % 2 else f"at 10.{i}.0.555 then" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, models, select, fit, thresholds = [], [], P._select, P.fit, P.thresholds
    monkeypatch.setattr(P, "thresholds", lambda counts: seen.append([tuple(c) for c in counts]) or thresholds(counts))
    monkeypatch.setattr(P, "fit", lambda rows: models.append(rows) or fit(rows))
    monkeypatch.setattr(P, "_select", lambda model: models.append(model.value) or select(model))
    assert P.find_pii(docs).count() == len(texts)
    sample, (trees, chosen) = models
    every = [(k, y, [float(np.float32(v)) for v in P.features(t, k, a, b)]) for t in texts for k, a, b, y in P.candidates(t, P.base_spans(t)) if y is not None]
    fitted = sorted(map(str, ((P.KINDS[int(r["f"][0])], r["label"], list(r["f"])) for r in sample)))
    assert len(fitted) == 200 and sum(f.startswith("('ip'") for f in fitted) < P.ENOUGH
    rest = sorted(map(str, every))
    for f in fitted:
        rest.remove(f)
    assert sum(c[3] for c in seen[0]) == len(rest)
    rest = [ast.literal_eval(r) for r in rest]
    score = trees.predict(np.array([f for _, _, f in rest]))

    def lowest(kinds):  # the definition, over sorted scores
        mine = sorted({np.floor(s * P.BINS) / P.BINS for s, (k, _, _) in zip(score, rest) if k in kinds}, reverse=True)
        labels = lambda s: [y for x, (k, y, _) in zip(score, rest) if k in kinds and x >= s]
        ok = [s for s in mine if np.mean(labels(s)) >= P.PRECISION]
        return max(0.5, ok[-1]) if ok else 2.0

    count = {k: sum(r[0] == k for r in rest) for k in P.KINDS}
    assert count["ip"] > 100 and count["card"] == 0
    assert chosen == {k: lowest([k] if count[k] >= P.ENOUGH else P.KINDS) for k in P.KINDS}
    assert chosen["ip"] != chosen["card"] == lowest(P.KINDS)


def test_keep_one_leaves_one_row_of_every_group(spark):
    from reqscope.llm.jaccard_join import keep_one

    rng = random.Random(14)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a, "y"), (1, a, "x"), (1, a + " more", "x"), (2, a, "x"),  # an id repeats in its group
            (None, b, "x"), (None, b, "x"), (None, b + " more", "x"),  # copies without ids
            (None, c, "x"), (7, c, "x"), (1, d, "x"), (8, d + " more", "x"),  # an id of another group
            (None, None, "x"), (None, "", "x"), (9, " ", "x"), (9, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = sorted(((r.doc_id, r.text, r.source) for r in keep_one(docs).collect()), key=repr)
    words = [r for r in kept if (r[1] or "").strip()]
    assert len(kept) - len(words) == 4
    assert [r[0] for r in words].count(None) == 1 and len(words) == 4
    assert sum(r[0] == 1 and r[1] in (a, a + " more") for r in words) == 1
    assert (7, c, "x") in words and (1, d, "x") in words
    assert not any(r == (1, a, "y") for r in words)  # of equal ids and texts the first


def test_long_digit_runs_take_linear_time():
    import time

    from reqscope.llm.pii import base_spans, candidates

    began = time.process_time()
    for text in ("7" * 1_000_000, "1.2.3.4567.8.9.1 " + "1." * 300_000, "4111 1111 1111 1111 " * 20_000):
        candidates(text, base_spans(text))
    assert time.process_time() - began < 20
    assert [x for x in base_spans("1.2.3.4567.8.9.10") if x[0] == "ip"] == []  # greedy match fails its check, no retry inside
    assert ("ip", 2, 9) in base_spans("a 1.2.3.4.5.6.7.8")


def test_redact_keeps_columns_named_like_its_own(spark):
    from reqscope.llm.pii import redact

    docs = spark.createDataFrame([(1, "write to a.b@example.org now"), (2, None)], "doc_id long, text string").withColumns({"spans": F.lit("mine"), "base": F.lit(7)})
    got = redact(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.spans, r.base) for r in got.collect()) == [(1, "write to [email] now", "mine", 7), (2, "", "mine", 7)]


def test_not_null_columns_pass(spark):
    from reqscope.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame([(k, f"same\nown {k}") for k in range(12)], "doc_id long, text string").withColumns({"tag": F.lit("x"), "list": F.array(F.lit(1))})
    assert sorted((r.doc_id, r.text, r.tag, r.list) for r in dedup_lines(docs, 10).collect()) == [(k, f"own {k}", "x", [1]) for k in range(12)]
