import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from priceloom.llm import language_id as L
from tests.llm.docs import TEXTS, frame

EN, DE = "the cat sat on the mat and then the dog ran over there with that other thing", "der hund lief schnell und die katze schlief dort auf einem weichen kissen nicht"


def corpus(spark):
    texts = [(EN if i % 2 else DE).split() for i in range(60)]
    rows = [(i, " ".join(t[i % 7 :] + t[: i % 5]), "en" if i % 2 else "de") for i, t in enumerate(texts)] + [(100, None, "en"), (101, "xx", None), (102, "123 !", "de")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def brute(rows):
    """Kneser-Ney from its formulas, nothing pruned."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        s = "   " + re.sub(r"[^a-z]+", " ", text.lower())
        s = s if s.endswith(" ") else s + " "
        counts[lang].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    model = {}
    for lang, c in counts.items():
        levels = {4: c}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        for k, t in levels.items():
            n1, n2 = (sum(1 for n in t.values() if n == x) for x in (1, 2))
            d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            total, kinds = Counter(), Counter()
            for g, n in t.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += min(n, d)
            model[lang, k] = (t, d, total, kinds)

    def p(lang, g):
        if not g:
            return 2.0**-17
        t, d, total, kinds = model[lang, len(g)]
        c = total[g[:-1]]
        return p(lang, g[1:]) if not c else max(t[g] - d, 0) / c + kinds[g[:-1]] / c * p(lang, g[1:])

    def entropy(lang, text):
        s = "   " + re.sub(r"[^a-z]+", " ", text.lower())
        s = s if s.endswith(" ") else s + " "
        return -sum(math.log2(p(lang, s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)

    return entropy


def test_equals_formulas(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_SHARE", 0.0)
    df = corpus(spark)
    model = L.train(df, "text", "lang")
    entropy = brute([(r.text, r.lang) for r in df.collect() if r.text and r.lang])
    texts = ["the other dog", "schnell und weich", "a", "zzz qqq the"]
    bits, letters = model.entropies(pa.array(texts))
    want = np.array([[entropy(x, t) for x in model.langs] for t in texts])
    assert model.langs == ["de", "en"] and letters.all() and np.allclose(bits, want, rtol=2e-3)


def test_predictions(spark):
    got = {r.doc_id: r for r in L.identify(corpus(spark), F.col("doc_id") % 3 != 0, keep=["doc_id", "lang"]).select("row.*", "lang_pred", "score", "rejected").collect()}
    assert all(r.lang_pred == r.lang for i, r in got.items() if i < 60)
    assert got[100].lang_pred == got[102].lang_pred == "und" and got[100].score == 0 and got[102].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_awkward_texts_and_empty_tables(spark):
    df = frame(spark, [*TEXTS, "𐐷𐐷 𐐷", "漢字 テスト"])
    rows = L.identify(df, F.lit(True)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.row.text or ""))
    assert L.identify(df.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in L.identify(df, F.lit(False)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from priceloom.llm.queries import op9_language_id

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    got = op9_language_id(spark, "/root/testdata/sf0.001").where("held_out AND lang_pred <> 'und'").join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count() > 0


def test_rejection_covers_every_taught_row(spark):
    """2,500 copies of one text never hide another language's rows from the limits."""
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(5000)]
    odd = [(9000, "the dog sat over the cat xqzx", None), (9001, "der hund schlief und die katze lief xqzx", None)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    got = {r.row.doc_id: r for r in L.identify(df, F.lit(True), keep=["doc_id"]).collect()}
    assert (got[9000].lang_pred, got[9001].lang_pred) == ("en", "de") and got[9000].rejected and got[9001].rejected
    assert len(got) == 5002 and sum(r.rejected for i, r in got.items() if i < 5000) <= 5  # 0.1%: sums of one text may differ in the last bit


def brute_pruned(rows, share):
    """As ``brute``, with n-grams under ``share`` of their order's total left to the lower order."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        s = "   " + re.sub(r"[^a-z]+", " ", text.lower())
        s = s if s.endswith(" ") else s + " "
        counts[lang].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    direct, taken = {}, Counter()
    for lang, c in counts.items():
        levels = {4: c}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        for k, t in levels.items():
            n1, n2 = (sum(1 for n in t.values() if n == x) for x in (1, 2))
            d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            total = Counter()
            for g, n in t.items():
                total[g[:-1]] += n
            for g, n in t.items():
                if n >= share * sum(t.values()):
                    direct[lang, g] = max(n - d, 0) / total[g[:-1]]
                    taken[lang, k, g[:-1]] += direct[lang, g]

    def p(lang, g):
        return 2.0**-17 if not g else direct.get((lang, g), 0) + max(1 - taken[lang, len(g), g[:-1]], 1e-9) * p(lang, g[1:])

    def entropy(lang, text):
        s = "   " + re.sub(r"[^a-z]+", " ", text.lower())
        s = s if s.endswith(" ") else s + " "
        return -sum(math.log2(p(lang, s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)

    return entropy


def test_shipped_and_coarse_shares_equal_brute_force(spark):
    """Languages, scores, cross-entropies and rejection, for every row."""
    df = corpus(spark).where("text IS NOT NULL AND doc_id <> 102").union(spark.createDataFrame([(200, "the qzx wvy dog", None), (201, "hund und xqj katze", None), (202, "over the mat", None)], "doc_id bigint, text string, lang string"))
    rows = df.collect()
    for share in (L.LEAST_SHARE, 0.01):
        entropy = brute_pruned([(r.text, r.lang) for r in rows if r.lang], share)
        bits = {r.doc_id: [entropy(x, r.text) for x in ("de", "en")] for r in rows}
        best = {i: min(b) for i, b in bits.items()}
        pred = {i: ("de", "en")[b.index(min(b))] for i, b in bits.items()}
        most = {x: max(best[r.doc_id] for r in rows if r.lang == x == pred[r.doc_id]) for x in ("de", "en")}  # the 0.999 quantile of few rows
        got = {r.row.doc_id: r for r in L.identify(df, F.lit(True), keep=["doc_id"], least_share=share).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            assert r.lang_pred == pred[i] and abs(r.cross_entropy - best[i]) < 2e-3 * best[i]
            assert abs(r.score - 1 / sum(2 ** (-L.TEMPERATURE * (b - best[i])) for b in bits[i])) < 0.02
            if abs(best[i] - most[pred[i]]) > 0.02:
                assert r.rejected == (best[i] > most[pred[i]])
        assert got[200].rejected and got[201].rejected
