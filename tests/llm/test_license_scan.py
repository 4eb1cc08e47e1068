import math
import random
import re

from priceloom.llm import license_scan as S
from tests.llm.docs import COLLIDING, LONG, PROSE, TEXTS, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RND = random.Random(4)


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(t, templates, window):
    w, step = split(t), window // 2
    places = [(i, label) for p, label in S.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    blocks = set()
    for b in range(max(0, -(-len(w) // step) - 2) + 1):
        inside = set(w[b * step : b * step + window])
        for label, text in templates.items():
            want = set(split(text))
            n = len(want & inside)
            if n >= max(1, math.ceil(S.THRESHOLD * len(want) - 1e-9)):
                blocks.add((label, b * step, n / len(want)))
    base = {x for _, x in places}
    score = 1.0 if base else max((x[2] for x in blocks), default=0.0)
    return (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in blocks})), score, blocks)


def documents():
    out = []
    for text in S.TEMPLATES.values():
        w = text.split()
        for p in (0.0, 0.1, 0.2, 0.3):
            out.append(PROSE + "\n" + " ".join(x for x in w if RND.random() >= p) + "\n" + PROSE)
            out.append(LONG[: RND.randrange(1500, 4000)] + " " + " ".join(x for x in w if RND.random() >= p).upper())
    return out + ["the MIT-License; mit license general public license", "Mit\nLICENSE apache", "license mit"]


def test_equals_brute_force(spark):
    texts = TEXTS + documents()
    for window in (S.WINDOW, 40):
        got = S.scan(frame(spark, texts), keep=["doc_id"], window=window).collect()
        assert len(got) == len(texts)
        for r in got:
            mine = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, {(b.label, b.first_word, b.shared) for b in r.blocks})
            assert mine == brute(texts[r.row.doc_id], S.TEMPLATES, window), r.row.doc_id


def test_templates_fit_and_empty_tables(spark):
    assert all(len(split(t)) <= S.WINDOW // 2 for t in S.TEMPLATES.values())
    assert S.scan(frame(spark).limit(0)).count() == 0
    assert S.scan(frame(spark), templates={}).where("labels <> base_labels").count() == 0
    assert S.scan(frame(spark)).select("row.*").columns == frame(spark).columns


def test_short_notices(spark):
    texts = ["Licensed under CC BY-NC 4.0.", PROSE + "\nReleased under a CC-BY-SA license\n" + PROSE, "photo (CC BY 3.0)", "licensed by the cc under 4 0 nc", "cc by mail", "CC BY-NC-SA 4.0"]
    got = {r.row.doc_id: (r.labels, r.score, r.n_base) for r in S.scan(frame(spark, texts), keep=["doc_id"]).collect()}
    assert [got[i] for i in range(6)] == [("cc-by-nc", 1.0, 0), ("cc-by-sa", 1.0, 0), ("cc-by", 1.0, 0), ("", 0.0, 0), ("", 0.0, 0), ("cc-by-nc-sa", 1.0, 0)]


def test_long_templates(spark):
    """A template of 250 words that stands whole at word 70, and one of 900 with a tenth left out; short ones beside them."""
    long = {"own": " ".join(f"clause{i}" for i in range(250)), "huge": " ".join(f"term{i % 800}" for i in range(900))}
    most = " ".join(f"term{i % 800}" for i in range(900) if i % 10)
    texts = [" ".join(f"w{i}" for i in range(70)) + " " + long["own"], LONG + " " + most + " " + LONG, S.TEMPLATES["isc"], most[:3000]]
    got = {r.row.doc_id: (r.labels, r.score) for r in S.scan(frame(spark, texts), keep=["doc_id"], templates=S.TEMPLATES | long).collect()}
    assert got[0] == ("own", 1.0) and got[1][0] == "huge" and 0.8 <= got[1][1] < 1 and got[2] == ("isc", 1.0) and got[3] == ("", 0.0)
    assert brute(texts[0], long, 512)[5:7] == got[0]


def test_words_of_one_hash_differ(spark):
    a, b = COLLIDING
    got = {r.row.doc_id: (r.labels, r.score) for r in S.scan(frame(spark, [a, b, f"{a} {b}"]), keep=["doc_id"], templates={"own": a, "both": f"{b} {a}"}, threshold=1.0).collect()}
    assert got == {0: ("own", 1.0), 1: ("", 0.0), 2: ("both,own", 1.0)}
