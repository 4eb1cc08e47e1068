import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from priceloom.llm import spelling as S
from tests.llm.docs import TEXTS, frame

RND = random.Random(13)
BASE = ["".join(RND.choice("aenrst") for _ in range(RND.randrange(4, 9))) for _ in range(60)] + ["Übergröße", "naïveté", "élève", "÷×÷×÷", "stone", "stones", "store", "tones", "notes"]


def edit(word):
    at, kind = RND.randrange(len(word)), RND.randrange(4)
    letter = RND.choice("aenrsté")
    return [word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:], word][kind]


def corpus(n=120):
    out = []
    for _ in range(n):
        words = [RND.choice(BASE) if RND.random() < 0.6 else edit(RND.choice(BASE)) for _ in range(RND.randrange(1, 120))]
        out.append(RND.choice([" ", ", ", "-", "1"]).join(w.upper() if RND.random() < 0.1 else w for w in words))
    return out


#: Counts that double along a chain of words one letter apart, dealt over documents.
CHAIN = ["chain" + "a" * (4 - k) + "b" * k + " " for k in range(5) for _ in range(5 * 2**k + k)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    form, count = {}, {}
    for w in n:
        found = [x for x in n if near(w, x)]
        count[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], count[w], form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.mark.parametrize("crowd", [S.CROWD, 0, 3])
def test_against_brute_force(spark, crowd):
    texts = corpus() + TEXTS + CHAIN
    want = brute(list(enumerate(texts)))
    assert sum(r[3] is not None for r in want) > 20 and any(r[5] not in (r[0], r[3]) for r in want)
    assert got(S.variants(frame(spark, texts), crowd=crowd)) == want


@pytest.mark.parametrize("words, size", [(2000, 1 << 26), (20_000, 60_000), (1, 1)])
def test_tasks_that_merge_often(spark, monkeypatch, words, size):
    """Counts are kept and merged again, or handed on, many times in a task."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(S, "MERGE", words)
    monkeypatch.setattr(S, "MERGE_BYTES", size, raising=False)
    texts = corpus(400) + TEXTS + CHAIN
    assert got(S.variants(frame(spark, texts, parts=1))) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    rows = [(None, "stone stones " * 40), (7, "stone store " * 30), (7, "stone store " * 30), (None, None)] + [(k, "stones notes") for k in range(300)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    assert got(S.variants(df)) == brute(rows)


def test_empty_table(spark):
    df = frame(spark)
    assert S.variants(df.where("doc_id < 0")).collect() == []
    assert S.variants(frame(spark, ["one two", None])).collect() == []


def test_ties_go_to_the_smallest(spark):
    rows = [(0, "tones " * 3 + "tonea " * 6 + "toneb " * 6)]
    found = {r.word: r for r in S.variants(frame(spark, [rows[0][1]]), every=0).collect()}
    assert found["tones"].form == "tonea" and found["tonea"].form is None and found["tonea"].root == "tonea"


def test_anagrams_are_not_near(spark):
    """A crowd of anagrams, of which few are a letter apart."""
    words = sorted({"".join(RND.sample("abcdefg", 7)) for _ in range(400)} | {"abcdef", "abcdefh"})
    found = got(S.variants(frame(spark, [" ".join(words * 3)]), every=0, crowd=16))
    assert found == [(w, 3, sum(near(w, x) for x in words), None, None, w) for w in words]


def test_long_texts_and_words(spark):
    long, text = "ab" * 30_000, " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(300_000))
    found = {r.word: r for r in S.variants(frame(spark, [text, long, long, long[1:] + "c", long + " " + long]), every=0).collect()}
    assert (found[long].n, found[long].n_near, found["wordak"].n, found["wordak"].n_near) == (4, 0, 10_000, 6)


def test_checksums():
    words = [b"", b"a", b"stone", "é".encode() * 20, b"x" * 48, b"x" * 49, b"y" * 1000]
    prefixes = [b":", b"12345:", b"-9:"]
    owner, word = np.repeat(np.arange(3), 7), np.tile(np.arange(7), 3)
    assert S.checksums(prefixes, owner, word, words).tolist() == [zlib.crc32(prefixes[o] + words[w]) for o, w in zip(owner, word)]
