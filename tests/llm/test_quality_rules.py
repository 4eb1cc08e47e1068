import re
from collections import Counter

from priceloom.llm import quality_rules as Q
from priceloom.llm.quality_rules import quality_rules
from tests.llm.docs import PROSE, TEXTS, frame


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def brute_verdict(text):
    """Every rule from its definition, character by character."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if brute(text)[5]:
        return False
    chars, ok = sum(map(len, words)), brute(text)[2] <= Q.SYMBOLS_PER_WORD * len(words)
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(full) if x in full[:i]]
    ok &= sum(map(len, again)) <= Q.LINE_COVERAGE * sum(map(len, full))
    for n, most in Q.COVERAGE.items():
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {i + k for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for k in range(n)}
        ok &= sum(len(words[i]) for i in inside) <= most * chars
    for n, most in Q.TOP_WINDOW.items():
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        ok &= max((c * sum(map(len, g)) for g, c in grams.items() if c > 1), default=0) <= most * chars
    return ok


MIXED = [PROSE + "\n" + "a line that comes again and again\n" * k for k in range(6)] + [PROSE + " " + " ".join(PROSE.split()[: 6 * k]) for k in range(6)] + [PROSE + " so so" * k for k in range(0, 30, 4)]


def test_verdict_equals_brute_force(spark):
    texts = TEXTS + MIXED
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, texts)).select("row.doc_id", "kept").collect()}
    assert got == {i: brute_verdict(t) for i, t in enumerate(texts)} and 5 < sum(got.values()) < len(texts) - 5


def test_equals_brute_force(spark):
    got = quality_rules(frame(spark)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert tuple(r)[1:7] == brute(TEXTS[r.doc_id]), r
        assert not (r.base_failed and r.kept)


def test_verdict_and_empty_table(spark):
    kept = {r.doc_id: r.kept for r in quality_rules(frame(spark)).select("row.doc_id", "kept").collect()}
    assert kept[6] and kept[7] and not kept[10] and not kept[11] and not kept[12]
    assert quality_rules(frame(spark).limit(0)).count() == 0


def test_all_columns_pass(spark):
    df = frame(spark)
    back = quality_rules(df).select("row.*")
    assert back.columns == df.columns and back.count() == df.count()
