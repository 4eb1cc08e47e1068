from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from priceloom.llm import token_alignment as A
from tests.llm.docs import LONG, TEXTS, frame

P = pytest.importorskip("public_tokenizers")
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MORE = [
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b c", "▁", " ▁ x", "  two  spaces   three ", " ", "   ", "it's we'll   'S", "x y\u0085 z　w", "tab\t word \x00 nul", "ends with space ",
    "日本語 の テキスト", "naïve  café — “quoted” text", "é é é", "🙂 🙂🙂 🙂", "x" * 700, "a" + " b" * 50, "ᚠ ᚡ   q", "word   word", " leading", "\nnew\n\nlines \n here", "א ב ﷽",
]


def spelled():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = A.byte_letters()
    assert sorted(letters.values()) == list(range(256))

    def run(text):
        if not text:
            return None
        ta = a.encode(" " + text, add_special_tokens=False)
        tb = b.encode(text)
        ba = [bytes(letters[c] for c in t) for t in ta.tokens]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(tb, b.encode(text, out_type=str))]
        full = (" " + text).encode()
        return (list(zip(ta.ids, ba)), list(zip(tb, bb))) if b"".join(ba) == b"".join(bb) == full else None

    return run


def brute(texts):
    run, held = spelled(), []
    for text in texts:
        got = run(text)
        if got is None:
            held.append(([], [], [], []))
            continue
        spans = []
        for side in got:
            at, out = 0, []
            for i, piece in side:
                out.append((i, at, at + len(piece)))
                at += len(piece)
            spans.append(out)
        a, b = spans
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([x for x, _, e in a if low < e <= high], [y for y, _, e in b if low < e <= high]) for low, high in zip([0, *shared], shared)]
        held.append(([x for x, *_ in a], [y for y, *_ in b], links, groups))
    count = Counter(link for *_, links, _ in held for link in set(links))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    text_of = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(len(a), len(b), len(g), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links), text_of(g)) for a, b, links, g in held]


def got(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.row.doc_id)]


ALL = [t if t is None or len(t) < 5000 else t[:3000] for t in TEXTS] + MORE + ["some words words some", "words some more words"]


@pytest.fixture(scope="module")
def expected():
    return brute(ALL)


@pytest.mark.parametrize("hot", [A.HOT, 40, 0])
def test_against_brute_force(spark, expected, hot):
    assert got(A.align(frame(spark, ALL), *PATHS, hot=hot)) == expected


def test_what_is_expected(expected):
    at = ALL.index("a▁b c")
    assert expected[at] == (0, 0, 0, 0, 0, 0, "") and expected[0][0] == 0 and expected[ALL.index(MORE[0])][0] > 0
    assert all(len(A.products(r[6])) >= r[3] for r in expected)


def test_products():
    assert A.products("1,2|5;3|6,7") == [(1, 5), (2, 5), (3, 6), (3, 7)] and A.products("") == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "one two three", 1)] * 3 + [(2, "one two", 2)], "doc_id bigint, text string, n_a int").repartition(2)
    out = [(r.row.doc_id, r.row.n_a, *tuple(r)[1:]) for r in A.align(df, *PATHS).collect()]
    want = brute(["one two three"] * 3 + ["one two"])
    assert sorted(out, key=repr) == sorted([(None, 1, *want[0])] * 3 + [(2, 2, *want[3])], key=repr)


def test_empty_table(spark):
    assert A.align(frame(spark).where("doc_id < 0"), *PATHS).collect() == []
    assert [r[:6] for r in got(A.align(frame(spark, [None, ""]), *PATHS))] == [(0,) * 6] * 2


def test_long_text(spark):
    """As a whole by the libraries themselves, though it is cut into pieces here."""
    text = (LONG + "\n") * 12 + "the very last words"
    (row,) = A.align(frame(spark, [text]), *PATHS).collect()
    a, b = spelled()(text)
    assert len(text) > 1_500_000 and (row.n_a, row.n_b) == (len(a), len(b)) and row.groups.endswith(f"{a[-1][0]}|{b[-1][0]}")
    assert row.n_links == row.count_sum == len(np.union1d(np.cumsum([len(p) for _, p in a]), np.cumsum([len(p) for _, p in b])))


def test_cuts(spark):
    from priceloom.llm import common as C

    pair = A.pair_of(*PATHS)
    pieces, owner = pair.pieces(C.Flat(pa.array(["ab cd  e", None, "é ü", "x   y", "a — b", "日 本"])))
    assert [p.decode() for p in pieces.to_pylist()] == [" ab", " cd  e", " ", " é", " ü", " x   y", " a — b", " 日", " 本"]
    assert owner.tolist() == [0, 0, 1, 2, 2, 3, 4, 5, 5]


def test_scores_follow_a_store_that_forgets():
    """Sums over links by row stay right while rows are forgotten and made again."""
    from priceloom.llm.word_store import WordStore

    pair = A.pair_of(*PATHS)
    store = WordStore(pair.make, [np.int64, np.uint8, np.int64], words=6)
    texts = [t for t in ALL if t] * 2
    whole = pair.store()
    links = np.unique(whole.columns[0].take(A.rows_of(pair, whole, pa.array(texts))[0])[0])[::2]  # every other link is known
    known = (links, np.arange(len(links)) + 1, np.arange(len(links)) % 2)
    scores = A.Scores("a", store, known)
    for k in range(0, len(texts), 3):
        rows, owner = A.rows_of(pair, store, pa.array(texts[k : k + 3]))
        held, size = store.columns[0].take(rows)
        found, best, count = A.scored(known, held)
        assert 0 < found.sum() < len(found) or len(found) < 5
        got = scores.take(rows)
        assert got.sum(0).tolist() == [best.sum(), count.sum()]
        assert np.array_equal(got, A.totals(np.stack([best, count], 1), np.concatenate([[0], np.cumsum(size)])))
        data, width = store.columns[1].take_bytes(rows)
        plain, width2 = store.columns[1].take(rows)
        assert np.array_equal(data, plain) and np.array_equal(width, width2)
    assert store.epoch > 5
