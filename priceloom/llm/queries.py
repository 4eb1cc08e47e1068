"""The registered query of each operator: thin wrappers that apply it to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages within a source."""
    from .quality_classifier import classify

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, F.col("source"), F.col("lang"), keep=["doc_id"]).select("row.doc_id", "evidence", "host_rate", "path_rate", "quality", F.col("good").alias("kept"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and each benchmark item that it leaks; start and end count code points."""
    from .decontaminate import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_tree import score

    out = score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2, keep=["doc_id"])
    return out.select("row.doc_id", (remainder("row.doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import read_ranks, round_trip

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("row.doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text (null: empty) modulo ``divisor``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    out = identify(table(spark, sf_dir, "documents"), remainder("doc_id", 4) != 2, keep=["doc_id"])
    return out.select("row.doc_id", (remainder("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import URN, round_trip

    page = lambda c: F.regexp_extract(c, f"^{URN}(-?[0-9]+)$", 1).try_cast("bigint")
    back = round_trip(table(spark, sf_dir, "pages"))
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .id_files import round_trip

    back = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import align

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return out.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def base3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op3: counts and the unigram score."""
    return op3_context_tree(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op5: words and the places of base phrases."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op9: which rows are held out, and which have no language."""
    return op9_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undecided"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_decontaminate, op3_context_tree, op4_line_dedup, op5_license_scan, op6_simhash, op7_quality_rules, op8_bpe, op9_language_id, op10_warc, op11_id_files, op12_token_alignment, op13_spelling, base3_context_tree, base5_license_scan, base9_language_id)}

#: White space of the contracts, for DuckDB's trim().
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
#: crc32 of the id as text, bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"


def _quality_sql() -> str:
    """Operator 7's counts and verdict; windows of n words are joined by n - 1 calls of lead()."""
    from .quality_rules import COVERAGE, LINE_COVERAGE, SYMBOLS_PER_WORD, TOP_WINDOW

    lengths = sorted({*COVERAGE, *TOP_WINDOW})
    leads = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, max(lengths)))
    grams = ", ".join(f"CASE WHEN pos + {k} <= n THEN concat_ws(' ', word, {', '.join(f'w{i}' for i in range(1, k))}) END AS g{k}, sum(chars) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS c{k}" for k in lengths)
    counts = ", ".join(f"CASE WHEN g{k} IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id, g{k}) ELSE 0 END AS t{k}" for k in lengths)
    inside = ", ".join(f"max(t{k}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) > 1 AS in{k}" for k in lengths)
    sums = ", ".join([*(f"coalesce(sum(chars) FILTER (in{k}), 0) AS cover{k}" for k in COVERAGE), *(f"coalesce(max(t{k} * c{k}) FILTER (t{k} > 1), 0) AS top{k}" for k in TOP_WINDOW)])
    over = " OR ".join([*(f"cover{k} / word_chars::DOUBLE > {most}::DOUBLE" for k, most in COVERAGE.items()), *(f"top{k} / word_chars::DOUBLE > {most}::DOUBLE" for k, most in TOP_WINDOW.items())])
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        w AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
        l AS (SELECT *, length(word) AS chars, {leads} FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        g AS (SELECT doc_id, pos, chars, {grams} FROM l), c AS (SELECT *, {counts} FROM g), i AS (SELECT *, {inside} FROM c),
        q AS (SELECT doc_id, sum(chars) AS word_chars, count(*) FILTER (in8) AS n_repeat_words, {sums} FROM i GROUP BY doc_id),
        line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
        again AS (SELECT doc_id, length(line) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS later FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        a AS (SELECT doc_id, count(*) FILTER (later) AS n_dup_lines, coalesce(sum(chars) FILTER (later), 0) / sum(chars)::DOUBLE AS line_coverage FROM again GROUP BY doc_id),
        f AS (SELECT d.doc_id, len(words) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
          coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(words) AS base_failed, coalesce(line_coverage, 0) > {LINE_COVERAGE}::DOUBLE OR coalesce({over}, FALSE) AS bad
          FROM d LEFT JOIN q USING (doc_id) LEFT JOIN a USING (doc_id))
        SELECT * EXCLUDE (bad), NOT (base_failed OR bad OR n_symbols > {SYMBOLS_PER_WORD}::DOUBLE * n_words) AS kept FROM f"""


def _unigram_sql() -> str:
    held = f"{_CRC} % 7 = 2"
    return f"""
        WITH d AS (SELECT doc_id, {held} AS held_out, list_append(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), chr(10)) AS words FROM documents),
        w AS (SELECT doc_id, held_out, unnest(words) AS word FROM d), c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word), t AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)), 4) AS base_score
        FROM w LEFT JOIN c USING (word), t GROUP BY doc_id, held_out"""


def _phrases_sql() -> str:
    from .license_scan import PHRASES

    cases = " ".join(f"WHEN concat_ws(' ', {', '.join(['word', 'w1', 'w2'][: len(p.split())])}) = '{p}' THEN '{label}'" for p, label in PHRASES.items())
    return f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d), l AS (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        p AS (SELECT doc_id, pos, CASE {cases} END AS label FROM l),
        f AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM p WHERE label IS NOT NULL GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN f USING (doc_id)"""


_DIGITS = "list_transform(range(40), lambda i: instr('0123456789abcdef', hex[i + 1]) - 1)"
_GROUP = "(digit[5 * (i // 4) + 1] * 65536 + digit[5 * (i // 4) + 2] * 4096 + digit[5 * (i // 4) + 3] * 256 + digit[5 * (i // 4) + 4] * 16 + digit[5 * (i // 4) + 5])"
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[({_GROUP} >> (15 - 5 * (i % 4))) % 32 + 1]), '')"

ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": _quality_sql(),
    "base3_context_tree": _unigram_sql(),
    "base5_license_scan": _phrases_sql(),
    "base9_language_id": f"SELECT doc_id, {_CRC} % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS undecided FROM documents",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), h AS (SELECT *, sha1(payload) AS hex FROM p), x AS (SELECT *, {_DIGITS} AS digit FROM h)
        SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM x""",
    "op4_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS k FROM line),
        held AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN held USING (k) GROUP BY doc_id""",
}
