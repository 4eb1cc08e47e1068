"""The pipeline against the brute-force versions of its stages, one after the other."""

import random

import pytest

import corpus_pipeline
from priceloom.llm import decontaminate as D
from tests.llm import test_decontaminate as TD
from tests.llm import test_line_dedup as TL
from tests.llm import test_quality_rules as TQ
from tests.llm import test_simhash as TS
from tests.llm.docs import TEXTS, WORDS, frame

P = pytest.importorskip("public_tokenizers")
RND = random.Random(11)


def documents():
    prose = lambda n: " ".join(RND.choice(WORDS) + str(RND.randrange(50)) for _ in range(n))
    out = [t for t in TEXTS if len(t or "") < 5000]  # the brute-force alignment of a long text takes minutes
    for k in range(25):
        t = prose(60)
        out += [t, t.replace(" ", "  "), t + "\nThe very same footer stands below each page"][: 1 + k % 3]
    return out + [prose(30) + " " + TD.ITEMS[k] + " " + prose(30) for k in range(6)]


def brute(texts):
    docs = [(i, t) for i, t in enumerate(texts) if TQ.brute_verdict(t)]
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(line.strip(TL.SPACE).translate(TL.LOWER), set()).add(i)
    gone = lambda i, k: len(k) >= 20 and len(held[k]) >= 3 and max(held[k]) != i
    docs = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x.strip(TL.SPACE).translate(TL.LOWER)))) for i, t in docs]
    fp = {i: TS.brute_fp(t) for i, t in docs}
    ids = sorted(fp)
    group = TS.groups([(a, b) for b in ids for a in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    docs = [(i, t) for i, t in docs if group[i] == i]

    def leaks(t):
        for item in TD.ITEMS:
            m = len(TD.norm(item))
            if m and TD.best(TD.norm(item), TD.norm(t)) <= max(0, min(int(D.RATE * m), (m - D.Q) // D.Q)):
                return True

    return {i: t for i, t in docs if not leaks(t)}


def test_equals_brute_force(spark, tmp_path):
    import tiktoken

    from priceloom.llm.bpe import read_ranks

    texts = documents()
    frame(spark, texts, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*enumerate(TD.ITEMS)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(texts)
    assert {r.doc_id: r.text for r in rows} == want and 10 < len(want) < len(texts) - 20
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r.round_trip and r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in rows)


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = frame(spark, extra=False)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_only_the_copy_itself_goes(spark):
    a, b, c, d, e = (" ".join(f"{w}{RND.randrange(10**6)}" for w in WORDS * 2) for _ in range(5))
    rows = [(3, a), (None, a), (None, b), (None, c), (None, c), (5, d), (5, e), (2, e), (7, b + " "), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.text.strip()) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (7, b), (None, c), (5, d), (2, e)], key=str)


def test_stages_survive_odd_columns_and_ids(spark, tmp_path):
    """Null and repeated ids, and columns named like the stages' own, in every stage."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(0, TD.ITEMS[0])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    prose = lambda k: " ".join(f"{w}{(k * 7919 + i * i) % 1009}" for i, w in enumerate(WORDS * 3))
    texts = [prose(k) for k in range(12)] + [prose(3), prose(3), None, ""]
    docs = frame(spark, texts, extra=False).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5))
    odd = ["ids", "n_tokens", "round_trip", "decoded", "words", "numbers", "gaps", "folded", "row", "key", "rank", "component", "fp", "kept", "leaks", "drop", "n_lines"]
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in odd])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns), name
        rows = out.collect()
        assert {r.key for r in rows} == {"own key"} and {r.text for r in rows} >= {prose(k) for k in range(12)}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
