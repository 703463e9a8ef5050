"""Operator 6: personal data by candidate gradient boosting.

1.  Base patterns give the spans that are certain (e-mail, ip, card, phone).
2.  High-recall generators propose more spans, which may overlap: spelled-out e-mails, IPv6,
    dotted or failing card and ip numbers, phones without a plus, and secrets (long runs of
    mixed letters and digits).
3.  Candidates whose form decides them (checksum, octets, an assignment to a keyword) are
    labelled; boosted trees are fitted on at most SAMPLE labelled candidates of one half (by a
    hash), taken in the order of the hash, from features of form and context.
4.  All labelled candidates that the trees did not see are scored in map tasks and counted by
    kind, score bin and label.  From these counts each kind gets the lowest threshold that keeps
    the precision at PRECISION (a kind with fewer than ENOUGH in the whole table that of all
    kinds together); candidates above it are added to the base spans, the most probable first
    where two of a kind overlap.

Texts are read once, in map tasks; what goes on is spans and features, never shuffled but for the
counts.  Spans are in code points, end exclusive.

Defined results: null text is empty and has no spans.  Without labelled candidates of both
classes nothing is added to the base spans.  Repeated rows are documents of their own; all
other columns pass through.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, pack, restored, scratch, text_of, unpack, without

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE = 20_000
PRECISION = 0.95
ENOUGH = 20
#: Score bins of the thresholds; a power of two, so that their edges are exact.
BINS = 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: From the start of a run of digits only: where that fails, its other digits fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+", re.I)
_IPV6 = re.compile(r"(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}")
_PLAIN_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DOTTED = re.compile(r"[0-9]{4}(?:[.\x20-][0-9]{4}){2,3}(?:[.\x20-][0-9]{1,3})?(?![0-9])")
_DIGITS = re.compile(r"[0-9]+")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_KEYWORD = re.compile(r"(e-?mail|mail|contact|phone|tel|call|fax|mobile|ip|addr|host|card|visa|credit|token|key|secret|passw|auth|bearer)", re.I)
_ASSIGNED = re.compile(r"(?:token|key|secret|passw(?:or)?d|auth|bearer)\w*\s*[:=]\s*[\"']?$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, from each @ outwards, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The certain spans by start, then kind; a match that fails its check is dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return [(KINDS[k], a, b) for k, a, b in sorted(out, key=lambda x: (x[1], x[0]))]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int | None]]:
    """(kind, start, end, label): label 1 or 0 where the form decides, else None."""
    out = [(k, a, b, 1) for k, a, b in base]
    sure = {(k, a, b) for k, a, b in base}
    if "dot" in text or "DOT" in text:
        out += [("email", m.start(), m.end(), None) for m in _SPELLED.finditer(text)]
    runs = [(m.start(), m.end()) for m in _DIGITS.finditer(text)]
    if not runs:
        return out
    out += [("ip", m.start(), m.end(), 0) for m in _IP.finditer(text) if ("ip", m.start(), m.end()) not in sure]
    for m in _CARD.finditer(text):
        if ("card", m.start(), m.end()) not in sure and m.end() - m.start() >= 7:
            out.append(("card", m.start(), m.end(), 0))
    out += [("phone", m.start(), m.end(), 0) for m in _PHONE.finditer(text) if ("phone", m.start(), m.end()) not in sure]
    out += [("phone", m.start(), m.end(), None) for m in _PLAIN_PHONE.finditer(text)]
    out += [("card", m.start(), m.end(), None) for m in _DOTTED.finditer(text) if "." in m[0]]
    if text.count(":") >= 3:
        out += [("ip", m.start(), m.end(), None) for m in _IPV6.finditer(text)]
    done = 0
    for a, b in runs:
        if a < done:
            continue
        lo, hi = a, b
        while lo > done and text[lo - 1] in _RUN:
            lo -= 1
        while hi < len(text) and text[hi] in _RUN:
            hi += 1
        done = hi
        if hi - lo >= 16:
            form = text[lo:hi]
            mixed = any(c.isalpha() for c in form)
            assigned = _ASSIGNED.search(text, max(0, lo - 40), lo) is not None
            label = 1 if assigned and hi - lo >= 20 else 0 if not mixed or sum(c.isdigit() for c in form) < 3 else None
            out.append(("secret", lo, hi, label))
    return out


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Form and context of a span."""
    form = text[a:b]
    digits = [c for c in form if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in form)
    parts = re.split(r"[^0-9]+", form)
    octets = [int(p[-6:]) for p in parts if p]
    counts = [form.count(c) for c in set(form)]
    entropy = -sum(n / len(form) * math.log2(n / len(form)) for n in counts)
    before, after = text[max(0, a - 30):a], text[b:b + 1]
    prev = before[-1:]
    return [float(x) for x in (
        KINDS.index(kind), len(form), len(digits), letters, len(form) - len(digits) - letters, 12 <= len(digits) <= 19 and luhn("".join(digits)),
        max(octets, default=0) <= 255, len([p for p in parts if p]), entropy, "+" in form, "@" in form or "dot" in form.lower(), ":" in form, form.count("."),
        all(c in "0123456789abcdefABCDEF" for c in form), prev in ("\"", "'"), prev.isalnum(), after.isalnum(), after in ("\"", "'"),
        _KEYWORD.search(before) is not None, prev in ("=", ":") or before[-2:-1] in ("=", ":"), len(set(digits)), len(digits) / len(form))]


class BoostedTrees:
    """Gradient boosting of depth-limited trees on the logistic loss; a few thousand rows."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> None:
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.bias = math.log(p / (1 - p))
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            gradient, weight = y - q, np.maximum(q * (1 - q), 1e-6)
            at, tree = np.zeros(len(y), int), []  # nodes in heap order
            for node in range(2 ** self.depth - 1):
                tree.append(self._split(bins, gradient, weight, at == node))
                mine = at == node
                feature, cut, _ = tree[-1]
                if feature >= 0:
                    at[mine] = 2 * node + 1 + (bins[mine, feature] > cut)
                else:
                    at[mine] = 2 * node + 1
            leaf = np.zeros(2 ** (self.depth + 1))
            for k in np.unique(at):
                leaf[k] = self.rate * gradient[at == k].sum() / (weight[at == k].sum() + 1.0)
            f += leaf[at]
            self.trees.append(([(g, float(self.cuts[g][c]) if g >= 0 else 0.0) for g, c, _ in tree], leaf))
        return self

    @staticmethod
    def _split(bins, gradient, weight, mine) -> tuple[int, int, float]:
        best = (-1, 0, 1e-6)
        g, w, b = gradient[mine], weight[mine], bins[mine]
        if len(g) < 2:
            return best
        whole = g.sum() ** 2 / (w.sum() + 1.0)
        for k in range(b.shape[1]):
            gs, ws = np.cumsum(np.bincount(b[:, k], g)), np.cumsum(np.bincount(b[:, k], w))
            if len(gs) < 2:
                continue
            gain = gs[:-1] ** 2 / (ws[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (ws[-1] - ws[:-1] + 1.0) - whole
            c = int(gain.argmax())
            if gain[c] > best[2]:
                best = (k, c, float(gain[c]))
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for tree, leaf in self.trees:
            at = np.zeros(len(x), int)
            feature, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
            for _ in range(self.depth):
                k = feature[at]
                at = 2 * at + 1 + ((k >= 0) & (x[rows, k] > cut[at]))
            f += leaf[at]
        return 1 / (1 + np.exp(-f))


def fit(rows: list) -> BoostedTrees | None:
    """Trees from the sample; none without both classes."""
    y = np.array([r["label"] for r in rows], np.float64)
    if len(rows) < 2 or not 0 < y.mean() < 1:
        return None
    return BoostedTrees().fit(np.array([r["f"] for r in rows], np.float64), y)


def thresholds(counts: list) -> dict[str, float]:
    """Thresholds by kind from (kind number, score bin, label, n) of all candidates that the trees did not see."""
    n = np.zeros((len(KINDS), BINS + 1, 2), np.int64)
    for kind, b, label, k in counts:
        n[kind, b, label] += k

    def threshold(m: np.ndarray) -> float:
        true, every = np.cumsum(m[::-1, 1]), np.cumsum(m.sum(1)[::-1])
        precise = np.flatnonzero((m.sum(1)[::-1] > 0) & (true >= PRECISION * every))
        return max(0.5, (BINS - int(precise[-1])) / BINS) if len(precise) else 2.0

    return {k: threshold(n[i] if n[i].sum() >= ENOUGH else n.sum(0)) for i, k in enumerate(KINDS)}


def _counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("f").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                found = np.stack([x[:, 0].astype(np.int64), (model.value.predict(x) * BINS).astype(np.int64), b.column("label").to_numpy().astype(np.int64)], 1)
                rows, n = np.unique(found, axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": rows[:, 0], "bin": rows[:, 1], "label": rows[:, 2], "n": n})
    return run


def learn(found: DataFrame, id_col: str | None) -> tuple[BoostedTrees | None, dict[str, float]]:
    """Trees from a bounded sample of one half of the labelled candidates, thresholds from all that are not in it."""
    spark = found.sparkSession
    id_ = [F.col("_row").getField(id_col)] if id_col else []
    every = (found.select("_row", F.explode("proposed").alias("c")).where("c.label is not null")
             .select(F.xxhash64(*id_, "c.kind", "c.start", "c.end", "c.label", "c.f").alias("k"), "c.label", "c.f"))
    sample = every.where("k & 1 = 0").orderBy("k", "label").limit(SAMPLE).collect()
    trees = fit(sample)
    if trees is None:
        return None, {}
    unseen = F.expr("k & 1 = 1") if len(sample) < SAMPLE else F.expr("k & 1 = 1") | (F.col("k") > sample[-1]["k"])
    model = spark.sparkContext.broadcast(trees)
    counts = (every.where(unseen).select("label", "f").mapInArrow(_counts(model), "kind long, bin long, label long, n long")
              .groupBy("kind", "bin", "label").agg(F.sum("n")).collect())
    return trees, thresholds(counts)


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_CANDIDATES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("f", pa.list_(pa.float32()))]))
_SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_CANDIDATE_TYPE = "array<struct<kind:string,start:int,end:int,label:int,f:array<float>>>"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, proposed = [], []
        for text in b.column("_text"):
            t = text.as_py()
            base = base_spans(t)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            proposed.append([{"kind": k, "start": s, "end": e, "label": y, "f": features(t, k, s, e)} for k, s, e, y in candidates(t, base)])
        yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(spans, _BASE), pa.array(proposed, _CANDIDATES)], ["_row", "base", "proposed"])


def _select(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = model.value
        for b in batches:
            out = []
            for base, proposed in zip(b.column("base").to_pylist(), b.column("proposed").to_pylist()):
                kept, taken = list(base), {k: [] for k in KINDS}
                for c in base:
                    taken[c["kind"]].append((c["start"], c["end"]))
                if trees is not None and len(proposed) > len(base):
                    score = trees.predict(np.array([c["f"] for c in proposed]))
                    more = [(s, c) for s, c in zip(score, proposed) if s >= thresholds[c["kind"]]]
                    for _, c in sorted(more, key=lambda x: (-x[0], x[1]["start"], x[1]["end"])):
                        spans = taken[c["kind"]]  # of one kind, apart, in order
                        at = bisect.bisect_left(spans, (c["end"],))
                        if not at or spans[at - 1][1] <= c["start"]:
                            spans.insert(at, (c["start"], c["end"]))
                            kept.append({x: c[x] for x in ("kind", "start", "end")})
                out.append(sorted(kept, key=lambda k: (k["start"], KINDS.index(k["kind"]))))
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("base"), pa.array(out, _BASE)], ["_row", "base", "spans"])
    return run


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry_text: bool = True) -> DataFrame:
    """``docs`` with base and spans: arrays of (kind, start, end), ordered by start and kind."""
    spark = docs.sparkSession
    columns = docs.columns if carry_text else without(docs, text_col)
    packed = pack(docs, columns, _text=text_of(docs, text_col))
    row = packed.schema["_row"].dataType.simpleString()
    found = scratch(packed.mapInArrow(_propose, f"_row {row}, base {_SPAN_TYPE}, proposed {_CANDIDATE_TYPE}"), "spans")
    model = spark.sparkContext.broadcast(learn(found, id_col if id_col in columns else None))
    chosen = found.mapInArrow(_select(model), f"_row {row}, base {_SPAN_TYPE}, spans {_SPAN_TYPE}")
    return unpack(chosen, columns, add={"base": F.col("base"), "spans": F.col("spans")})


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each selected span replaced by its kind in brackets (of spans that overlap,
    the first; what the others cover beyond it goes too)."""
    found = find_pii(aside(docs, text_col, id_col), text_col, id_col)

    @F.pandas_udf("string")
    def replaced(text, spans):
        import pandas as pd

        def one(t, marks):
            out, done = [], 0
            for m in marks if marks is not None else ():
                if m["start"] >= done:
                    out += [t[done:m["start"]], f"[{m['kind']}]"]
                done = max(done, m["end"])
            return "".join(out) + t[done:]

        return pd.Series([one(t or "", m) for t, m in zip(text, spans)])

    return restored(found, docs.columns, **{text_col: replaced(F.col(f"`{text_col}`"), F.col("spans"))})
