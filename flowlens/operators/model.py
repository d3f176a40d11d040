"""Random-forest training, scoring and evaluation with Spark ML (ML-1..12).

The forest is Spark ML's ``RandomForestClassifier`` (histogram splits, so
parity with other libraries is at metric level, not tree level). Training is
made layout-stable: the training frame is hash-partitioned by its row key
and sorted inside the partitions, whose number follows from the row count, so
the same seed gives the same forest whatever the input layout was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.distributions import with_class_weight
from flowlens.session import ensure_checkpoint_dir

# Defaults of the original study's forest.
FOREST_PARAMS = {"numTrees": 50, "maxDepth": 15, "seed": 42}
MIN_FIT_PARTITIONS = 16
ROWS_PER_FIT_PARTITION = 1_000_000


@dataclass(frozen=True)
class ForestConfig:
    features: tuple[str, ...]
    label: str = "Label"
    key: str = "row_id"
    num_trees: int = 50
    max_depth: int = 15
    seed: int = 42
    balanced: bool = True
    max_bins: int = 128
    fit_partitions: int | None = None  # None: by the row count
    laid_out: bool = False  # the training frame comes from ``laid_out``


def stable_layout(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Same rows → same partitions in the same order, for a reproducible fit."""
    return df.repartition(partitions, key).sortWithinPartitions(key)


def fit_partitions(train: DataFrame) -> int:
    return max(MIN_FIT_PARTITIONS, -(-train.count() // ROWS_PER_FIT_PARTITION))


def laid_out(train: DataFrame, key: str = "row_id", partitions: int | None = None) -> DataFrame:
    """``train`` moved to its stable layout once and checkpointed: every fit of
    it (``ForestConfig.laid_out``) reads the partitions as they lie, where it
    would else move and sort all rows for itself, pass by pass."""
    ensure_checkpoint_dir(train.sparkSession)
    return stable_layout(train, key, partitions or fit_partitions(train)).checkpoint()


def fit_forest(train: DataFrame, cfg: ForestConfig) -> PipelineModel:
    """Assemble the scalar feature columns and fit the forest (ML-2/3/4).

    ``train`` should be a stored table: it is read more than once. Several fits
    of one table should share a ``laid_out`` one."""
    data = train.select(cfg.key, *cfg.features, F.col(cfg.label).cast("double").alias("_label"), cfg.label)
    stages = [VectorAssembler(inputCols=list(cfg.features), outputCol="features", handleInvalid="error")]
    rf = RandomForestClassifier(
        featuresCol="features",
        labelCol="_label",
        numTrees=cfg.num_trees,
        maxDepth=cfg.max_depth,
        seed=cfg.seed,
        maxBins=cfg.max_bins,
        featureSubsetStrategy="sqrt",
        impurity="gini",
    )
    if cfg.balanced:
        data = with_class_weight(data, cfg.label, "_weight")
        rf = rf.setWeightCol("_weight")
    stages.append(rf)
    if not cfg.laid_out:
        data = stable_layout(data, cfg.key, cfg.fit_partitions or fit_partitions(train))
    model = Pipeline(stages=stages).fit(data)
    # The training summary holds the session and would travel with every scoring
    # task; a session that has observed a write cannot be serialized.
    forest_of(model)._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return model


def score(model: PipelineModel | Column, df: DataFrame, label: str = "Label") -> DataFrame:
    """ML-10: predicted class and class-1 probability on every row (the model
    is broadcast by Spark ML; rows stay where they are). ``model`` may also be
    a probability expression (``attribution.probability_of``)."""
    if isinstance(model, Column):
        scored = df.withColumn("attack_probability", model)
        return scored.withColumn("y_pred", (F.col("attack_probability") > 0.5).cast("int")).withColumn(
            "y_true", F.col(label).cast("int")
        )
    out = model.transform(df)
    return out.withColumn("y_pred", F.col("prediction").cast("int")).withColumn(
        "attack_probability", vector_to_array(F.col("probability"))[1]
    ).withColumn("y_true", F.col(label).cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def forest_of(model: PipelineModel):
    return model.stages[-1]


def gini_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """ML-12: impurity importance per feature, descending (ties by name).

    The vector has one entry per feature, so the table is bounded by the
    feature count."""
    imp = forest_of(model).featureImportances.toArray().tolist()
    if len(imp) != len(features):
        raise ValueError("importance vector does not match the feature list")
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, gini_importance double")
    return df.orderBy(F.desc("gini_importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    """SRC-16: Spark ML persistence (the forest nodes become Parquet)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
