import random

from priceloom.llm import decontaminate as D
from tests.llm.docs import TEXTS, frame

RND = random.Random(3)
VOWELS = ["tion", "er", "an", "the ", "in", "es", "on", "ed ", "ly ", "re", "st", "ha", " of", "nd "]
ITEMS = ["".join(RND.choice(VOWELS) for _ in range(RND.randrange(25, 90))).strip() for _ in range(25)] + ["tiny one", ""]


def norm(t):
    return " ".join(t.lower().split()).encode()


def best(item, text):
    """Least edits of item in any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(t, n):
    for _ in range(n):
        k, c = RND.randrange(len(t)), RND.choice("abxyz")
        t = RND.choice([t[:k] + c + t[k:], t[:k] + t[k + 1 :], t[:k] + c + t[k + 1 :]])
    return t


def documents():
    fill = lambda: "".join(RND.choice(VOWELS) for _ in range(60))
    out = [fill() for _ in range(10)]
    for k in range(40):
        item = ITEMS[k % 25]
        out.append(fill() + "\n" + edited(item, RND.randrange(0, 1 + int(0.12 * len(item)))).replace(" ", "  ").title() + ". " + fill())
    return out + ["now a Tiny  ONE here", ITEMS[0], ITEMS[1][:-2]]


def brute(docs):
    found = {}
    for d, t in enumerate(docs):
        for i, item in enumerate(ITEMS):
            m = len(norm(item))
            e = max(0, min(int(D.RATE * m), (m - D.Q) // D.Q))
            if m and (n := best(norm(item), norm(t or ""))) <= e:
                found[d, i] = n
    return found


def test_equals_brute_force_in_one_and_many_blocks(spark):
    docs = documents()
    bench = spark.createDataFrame([*enumerate(ITEMS), (0, ITEMS[0]), (99, None)], "item_id bigint, text string")
    want = brute(docs)
    assert len(want) > 25
    for size in (D.BLOCK_BYTES, 900):
        rows = D.leaks(frame(spark, docs), bench, keep=["doc_id"], block_bytes=size).collect()
        assert len(rows) == len(docs)
        assert {(r.row.doc_id, x.item_id): x.edits for r in rows for x in r.leaks} == want


def test_spans_point_at_the_passage(spark):
    bench = spark.createDataFrame([(7, ITEMS[3])], "item_id bigint, text string")
    r = D.leaks(frame(spark, ["éé ß  " + ITEMS[3].upper() + " ende"]), bench).first()
    t = r.row.text
    assert norm(t[r.leaks[0].start : r.leaks[0].end]) == norm(ITEMS[3]) and r.row.row == "clash"


def test_awkward_texts_and_empty_tables(spark):
    bench = spark.createDataFrame([(0, ITEMS[0])], "item_id bigint, text string")
    assert all(not r.leaks for r in D.leaks(frame(spark, TEXTS), bench).collect())
    assert D.leaks(frame(spark).limit(0), bench).count() == 0
    assert all(not r.leaks for r in D.leaks(frame(spark), bench.limit(0)).collect())
