import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.llm import context_tree as T
from tests.llm.docs import COLLIDING, PROSE, TEXTS, TWINS, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def coded(t):
    raw = [255] * T.DEPTH + list((t or "").translate(LOWER).encode()) + [255]
    return [(tuple(raw[i - T.DEPTH : i]), raw[i]) for i in range(T.DEPTH, len(raw))]


class Brute:
    """Context-tree weighting straight from its recursion (block probabilities before and after a bit)."""

    def __init__(self, texts, least):
        self.n = Counter()
        for t in texts:
            for ctx, byte in coded(t):
                for d in range(T.DEPTH + 1):
                    s = ctx[T.DEPTH - d :]
                    for k in range(8):
                        self.n[s, byte >> (8 - k) | 1 << k, byte >> (7 - k) & 1] += 1
        whole = Counter()
        for (s, u, _), c in self.n.items():
            if u == 1:
                whole[s] += c
        total = whole[()]
        self.kept = {s for s, c in whole.items() if c >= least * total} | {()}
        self.kids = defaultdict(list)
        for s in self.kept:
            if s:
                self.kids[s[1:]].append(s)
        self.memo = {}

    def kt(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def counts(self, s, u):
        return np.array([self.n[s, u, 0], self.n[s, u, 1]])

    def weighted(self, s, u, path=(), bit=None):
        """log P_w of node u in s; with ``bit``, one more of it on the path of contexts."""
        on = bit is not None and path[len(path) - len(s) :] == s
        key = (s, u)
        if not on and key in self.memo:
            return self.memo[key]
        own = self.counts(s, u)
        extra = np.array([bit == 0, bit == 1]) if on else np.zeros(2)
        out = self.kt(*(own + extra))
        if self.kids[s]:
            rest = own - sum(self.counts(k, u) for k in self.kids[s])
            deeper = path[len(path) - len(s) - 1 :] in self.kids[s] if on and len(s) < T.DEPTH else False
            product = self.kt(*(rest + (0 if deeper else extra))) + sum(self.weighted(k, u, path, bit) if on else self.weighted(k, u) for k in self.kids[s])
            out = np.logaddexp(out, product) - math.log(2)
        if not on:
            self.memo[key] = out
        return out

    def log10(self, t):
        out = 0.0
        for ctx, byte in coded(t):
            for k in range(8):
                u = byte >> (8 - k) | 1 << k
                out += self.weighted((), u, ctx, byte >> (7 - k) & 1) - self.weighted((), u)
        return out / math.log(10)


@pytest.mark.parametrize("least", [0.0, 0.02])
def test_tree_equals_recursion(spark, monkeypatch, least):
    monkeypatch.setattr(T, "LEAST_SHARE", least)
    texts = ["abab abba", "abra cadabra", "ab ab éé", None, "Bar"]
    got = {r.row.doc_id: r.score for r in T.score(frame(spark, texts), F.col("doc_id") < 4, keep=["doc_id"]).collect()}
    brute = Brute(texts[:4], least)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute.log10(t), rel=1e-4)


@pytest.mark.parametrize("least, hot", [(0.0, 10), (0.02, 0)])
def test_joined_grams_and_small_blocks(spark, monkeypatch, least, hot):
    """Grams outside the broadcast table come by the join; every suffix is a block of its own."""
    monkeypatch.setattr(T, "LEAST_SHARE", least)
    monkeypatch.setattr(T, "BLOCK", 1)
    texts = ["abab abba", "abra cadabra", "ab ab éé", None, "Bar"]
    got = {r.row.doc_id: r.score for r in T.score(frame(spark, texts), F.col("doc_id") < 4, keep=["doc_id"], hot=hot).collect()}
    brute = Brute(texts[:4], least)
    assert got == {i: pytest.approx(brute.log10(t), rel=1e-6) for i, t in enumerate(texts)}


@pytest.mark.parametrize("hot", [T.HOT, 5, 0])
def test_base_score(spark, hot):
    learn = [t for i, t in enumerate(TEXTS) if i % 3]
    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = T.score(frame(spark), F.col("doc_id") % 3 != 0, keep=["doc_id"], hot=hot).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        w = tokens(TEXTS[r.row.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0


def test_learns_and_survives_nothing(spark):
    df = frame(spark, [PROSE, PROSE[::-1], PROSE])
    r = {x.row.doc_id: x for x in T.score(df, F.col("doc_id") == 0).collect()}
    assert r[2].bits_per_byte < r[1].bits_per_byte and r[2].row.kept == 1.5
    bare = {x.row.doc_id: x for x in T.score(df, F.lit(None).cast("boolean")).collect()}
    assert bare[0].train_tokens == 0 and bare[0].bits_per_byte == pytest.approx(8)
    assert T.score(df.limit(0), F.lit(True)).count() == 0


def test_probabilities_sum_to_one(spark):
    tree = T.fit(T.count_grams(frame(spark), "text"))
    for t in tree.tables:
        assert np.allclose((10.0 ** t.values.astype(float)).sum(1), 1, atol=1e-4)


def test_slices_change_nothing(monkeypatch):
    import pyarrow as pa

    whole = [np.concatenate(x) for x in zip(*T.positions(pa.array(TEXTS)))]
    monkeypatch.setattr(T, "SLICE", 7)
    parts = [np.concatenate(x) for x in zip(*T.positions(pa.array(TEXTS)))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and len(whole[0]) == sum(len((t or "").encode()) + 1 for t in TEXTS)


def test_known_words_are_compared_whole(spark):
    """A word of the same polynomial hash is not known; the rare and the frequent path agree."""
    for hot in (T.HOT, 0):
        got = {r.row.doc_id: r.n_known for r in T.score(frame(spark, TWINS), F.col("doc_id") == 0, keep=["doc_id"], hot=hot).collect()}
        assert got == {0: 2, 1: 1}


@pytest.mark.parametrize("hot", [T.HOT, 0])
def test_words_of_one_hash_differ(spark, hot):
    a, b = COLLIDING
    got = {r.row.doc_id: r.n_known for r in T.score(frame(spark, [a, f"{a} {b}", b]), F.col("doc_id") == 0, keep=["doc_id"], hot=hot).collect()}
    assert got == {0: 2, 1: 2, 2: 1}
