"""Awkward documents that every operator must survive."""

LONG = " ".join(f"word{i % 997} other{i % 101}" for i in range(9000))
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix potions under a pale moon near quiet rivers".split()
PROSE = " ".join(WORDS[(i * i + 3 * i) % len(WORDS)] + str(i % 7) for i in range(60))

#: Two texts of one polynomial hash modulo 2**64, whatever its base: letters by the parity of their place's bits, and the other way round.
TWINS = ["".join("ab"[i.bit_count() & 1 ^ k] for i in range(1024)) for k in (0, 1)]

#: Two words of one XXH64.
COLLIDING = ["jokkjdes" + "q" * 24 + "zzazaaza" + "z" * 24, "heloqvah" + "q" * 24 + "axvjxmuc" + "z" * 24]

TEXTS = [
    None, "", "\n", " \n \t", "a", "one line", PROSE, PROSE, PROSE.upper(), PROSE + "\nextra line at the end of the text here",
    "same line repeated here\n" * 6, "And " * 80, "x#y$ z%%% &&& |a| <b>", LONG, "é ü ß 日本語 " * 20, "tab\tsep\x0bvt\x0cff\rcr end",
    "Licensed under the MIT License.\nThis is a line that many documents share today\nbody", "This is a line that many documents share today\nother",
    "  this IS a line that many documents share TODAY \ntail", "   odd spaces \x1c here", "🙂🙂 emoji text 🙂",
    "\n".join(TWINS), TWINS[0], "\n".join(TWINS[::-1]), TWINS[1] + "\n" + TWINS[0].upper(),
]


def frame(spark, texts=TEXTS, parts=3, extra=True):
    from pyspark.sql import types as T

    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", 1.5) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "kept"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.StringType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return df if extra else df.select(names[:5])
