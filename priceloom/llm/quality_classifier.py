"""Operator 1: a quality classifier that combines document evidence with site posteriors.

1. One Arrow pass turns each text into a few numbers (``FEATURES``).
2. A logistic regression is fitted on ``TRAIN_ROWS`` labelled rows at most (least hashes of the id; a
   documented bound), and gives every document the log-likelihood ratio of being good: its logit less
   the logit of the training prior.
3. Hierarchical empirical Bayes: the expected number of good documents (labels where known,
   otherwise the classifier's probability) is summed by path and by host with grouped aggregation.  A
   host's rate is shrunk towards the global rate with a strength estimated from the spread of the host
   rates by the method of moments; a path's rate is shrunk towards its host's in the
   same way.  Sparse sites stay near their parent.
4. A document's posterior is its log-likelihood ratio plus the logit of its path's shrunk rate.  The
   document's own vote is left out of that rate, of its host's and of the global one, so a label
   never moves its own document by way of its site.

Hot hosts: sums are aggregated before the shuffle, and the join back is between two written tables, so
adaptive execution may split it.  Null hosts and paths are a site of their own; null or empty text has
zero features; a very long text is measured whole (see quality_rules).  Labels of unknown ids are ignored and
repeated labels averaged; without labels of both classes the classifier's evidence is zero.  Ties: a
quality of exactly ``THRESHOLD`` is good.  Rows get a key of their own: repeated rows vote and are judged each.  An
empty table gives an empty table.  The given columns stay in ``row``, so no name can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import measure

FEATURES = ["log_words", "mean_word", "symbols_per_word", "line_coverage", "coverage_5", "coverage_8", "top_2", "top_3", "upper_share", "digit_share", "mark_share", "distinct_share", "words_per_line"]
TRAIN_ROWS, PENALTY, ROUNDS, THRESHOLD = 20_000, 1.0, 30, 0.5
#: Shrinkage strengths, in documents, that stand for none at all and for an unlimited one (no spread beyond chance): they
#: keep the division defined and change no estimate between them.
STRENGTH = (1e-6, 1e12)

UPPER, DIGIT = C._table(bytes(range(65, 91))), C._table(bytes(range(48, 58)))
MARK = C._table(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    m, flat = measure(texts), C.Flat(texts)
    n = flat.n
    at = flat.off
    share = lambda mask, whole: np.divide(C.sums_by(flat.text_of(np.flatnonzero(mask)), n), whole, out=np.zeros(n), where=whole > 0)
    size = np.diff(at)
    starts, ends, owner = flat.runs(~C.IS_SPACE[flat.data])
    number, _ = C.numbered(C.packed(C.ASCII_LOWER[flat.data], starts, ends))
    first = np.unique(owner * (len(owner) + 1) + number, return_index=True)[1]
    words = np.maximum(m["n_words"], 1)
    lines = np.bincount(flat.lines()[2], minlength=n)
    cols = {
        "log_words": np.log1p(m["n_words"]), "mean_word": m["word_chars"] / words, "symbols_per_word": m["n_symbols"] / words,
        "upper_share": share(UPPER[flat.data], size), "digit_share": share(DIGIT[flat.data], size), "mark_share": share(MARK[flat.data], size),
        "distinct_share": C.sums_by(owner[first], n) / words, "words_per_line": np.log1p(m["n_words"] / lines),
    } | {k: m[k] for k in ("line_coverage", "coverage_5", "coverage_8", "top_2", "top_3")}
    return np.stack([cols[k] for k in FEATURES], 1).astype(float)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a ridge logistic regression of log-likelihood ratios, by Newton steps on scaled features."""
    d = x.shape[1]
    if len(y) == 0 or not 0 < y.sum() < len(y):
        return np.zeros(d), 0.0
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, ridge = np.zeros(d + 1), np.r_[np.full(d, PENALTY), 1e-6]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    prior = y.mean()
    return w[:d] / spread, float(w[d] - (w[:d] / spread) @ mean - math.log(prior / (1 - prior)))


def strength(sites: DataFrame, parent: Column) -> float:
    """The number of documents that the parent's rate weighs: from the spread of the rates beyond chance."""
    rate = F.col("good") / F.col("n")
    s = sites.where("n >= 2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (rate - parent) ** 2).alias("spread"), F.sum(parent * (1 - parent)).alias("chance"), F.sum(F.col("n") * parent * (1 - parent)).alias("whole")).first()
    if not s.n or not s.whole:
        return STRENGTH[1]
    between = (s.spread - s.chance) / s.n  # the variance of the true rates
    within = s.whole / s.n
    return float(min(max(within / between - 1 if between > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


def classify(df: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, label: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """``row`` (struct of ``keep``) with evidence, host_rate, path_rate, quality and good."""
    def run(_, texts, hosts, paths, ids):
        x = features(texts)
        return {"x": pa.array(list(x), pa.list_(pa.float64())), "host": hosts, "path": paths, "id": ids}

    kind = dict(df.dtypes)[doc_id]
    docs = C.materialize(C.map_texts(df, text, keep or df.columns, run, [("x", "array<double>"), ("host", "string"), ("path", "string"), ("id", kind)], [host.cast("string"), path.cast("string"), F.col(f"`{doc_id}`")]).withColumn("key", F.monotonically_increasing_id()), "quality-features")
    known = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.avg("y").alias("y"))

    train = C.sample(docs.select("id", "x").join(known, "id"), TRAIN_ROWS, "id").select("x", (F.col("y") >= 0.5).cast("double").alias("y")).toArrow()
    x = np.array(train.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    weights, intercept = fit(x, train.column("y").to_numpy())

    ratio = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(intercept)), lambda a, b: a + b)
    rate = known.agg(F.avg("y")).first()[0]
    rate = min(max(0.5 if rate is None else rate, 1e-3), 1 - 1e-3)
    logit = lambda p: F.log(p / (1 - p))
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    scored = docs.select("key", "row", "host", "path", "id", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), ratio)).alias("evidence")).join(known, "id", "left")
    scored = C.materialize(scored.select("key", "row", "host", "path", "evidence", F.coalesce("y", sigmoid(F.col("evidence") + float(math.log(rate / (1 - rate))))).alias("vote")), "quality-evidence")

    paths = C.materialize(scored.groupBy("host", "path").agg(F.sum("vote").alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = C.materialize(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "quality-hosts")
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = min(max(whole.good / whole.n if whole.n else 0.5, 1e-3), 1 - 1e-3)
    k_host = strength(hosts, F.lit(overall))
    shrunk = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), ((F.col("good") + k_host * overall) / (F.col("n") + k_host)).alias("host_rate"))
    sites = C.materialize(paths.alias("p").join(shrunk.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "good", "n", "host_good", "host_n", "host_rate"), "quality-sites")
    k_path = strength(sites, F.col("host_rate"))

    def others(good: Column, n: Column, k: float, parent: Column) -> Column:
        """The shrunk rate of a site without the document's own vote."""
        return (F.greatest(good - F.col("d.vote"), F.lit(0.0)) + k * parent) / (n - 1 + k)

    top = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), others(F.lit(float(whole.good or 0)), F.lit(whole.n or 1), 1e-9, F.lit(0.5))))
    of_host = others(F.col("s.host_good"), F.col("s.host_n"), k_host, top)
    both = scored.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")), "left")
    prior = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), others(F.col("s.good"), F.col("s.n"), k_path, of_host)))
    out = both.select("d.row", "d.evidence", of_host.alias("host_rate"), prior.alias("path_rate"), sigmoid(F.col("d.evidence") + logit(prior)).alias("quality"))
    return out.withColumn("good", F.col("quality") >= THRESHOLD)
