"""A learned match judge, cross-validated, calibrated and kept as a file (OP-48).

Gradient-boosted trees over the similarity and the agreement of numbers; their depth is chosen by cross-validation on
labelled pairs.  A logistic curve, fitted on pairs that the trees have not seen, turns their score into ``match_probability``.  The
whole is one ``PipelineModel`` for ``search.pick``: ``prediction`` is 1 for a match.

Labelled pairs may be many, and many alike: equal ones are counted and weigh as often as they occur; at most ``ROWS`` different
ones, with the least hashes, are learned from.  Trees cut at up to ``BINS`` places of a feature, so a cut lies within 1 / ``BINS`` of the pairs.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceloom.session import keep

ROWS, FOLDS, DEPTHS, TREES, BINS, SEED = 20_000, 3, (2, 3), 10, 256, 42
FEATURES, LABEL, WEIGHT = ["similitud_texto", "misma_dimension"], "es_match", "times"


def fit(labelled: DataFrame, rows: int = ROWS, folds: int = FOLDS, depths: tuple[int, ...] = DEPTHS, trees: int = TREES, seed: int = SEED) -> PipelineModel:
    """A judge of ``labelled`` (columns FEATURES and LABEL, 0 or 1; rows with a null are left out)."""
    h = F.xxhash64(*FEATURES, LABEL, F.lit(seed))
    known = keep(labelled.select(*FEATURES, F.col(LABEL).cast("int").alias(LABEL)).dropna().groupBy(*FEATURES, LABEL).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)).withColumn("h", h).orderBy("h", *FEATURES, LABEL).limit(rows), "judged")
    held = F.pmod("h", F.lit(5)) == 0  # a fifth for the curve
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    boosted = GBTClassifier(labelCol=LABEL, weightCol=WEIGHT, maxBins=BINS, featuresCol="features", predictionCol="tree_prediction", maxIter=trees, seed=seed).setRawPredictionCol("tree_score").setProbabilityCol("tree_probability")
    chosen = CrossValidator(
        estimator=Pipeline(stages=[assemble, boosted]), estimatorParamMaps=ParamGridBuilder().addGrid(boosted.maxDepth, list(depths)).build(),
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL, weightCol=WEIGHT, rawPredictionCol="tree_score", metricName="areaUnderPR"), numFolds=folds, seed=seed,
    ).fit(known.where(~held)).bestModel
    curve = LogisticRegression(labelCol=LABEL, weightCol=WEIGHT, featuresCol="tree_score", rawPredictionCol="match_score", probabilityCol="match_probability", predictionCol="prediction")
    return PipelineModel([*chosen.stages, curve.fit(chosen.transform(known.where(held)))])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def judge(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """``pairs`` with ``is_match`` and ``match_probability`` (of a match)."""
    from pyspark.ml.functions import vector_to_array

    told = model.transform(pairs)
    return told.select(*pairs.columns, (F.col("prediction") == 1).alias("is_match"), vector_to_array("match_probability")[1].alias("match_probability"))
