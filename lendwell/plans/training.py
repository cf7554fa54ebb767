"""Default-prediction models: preparation, training, scoring and explanation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendwell.functions.columns import ratio
from lendwell.operators.evaluation import MODEL, report
from lendwell.operators.skew import by_rows
from lendwell.operators.split import stratified_split
from lendwell.schemas import CATEGORICAL_FEATURES, FEATURE_IMPORTANCE, NUMERIC_FEATURES
from lendwell.session import passing, release, remove, scratch_path

ENCODED = [f"{c}_encoded" for c in CATEGORICAL_FEATURES]
FEATURES = NUMERIC_FEATURES + ENCODED
# Training settings.
SEED = 42
TEST_SHARE = 0.2
TREES = 100
FOREST_DEPTH = 10
BOOST_DEPTH = 5
BOOST_STEP = 0.1
MAX_ITERATIONS = 1000
TREE_MEMORY = 1024
# Rows that one task scores, and rows that it holds while a model is fitted.
SCORED_PER_TASK = 50_000
FITTED_PER_TASK = 150_000
# Rows times trees of a forest that are fitted at once.
FOREST_DRAWS = 500_000_000
# Seeds of a forest's groups of trees lie further apart than a fit has tasks, which count on from their seed.
SEED_STEP = 1_000_003
FILE_COST = "spark.sql.files.openCostInBytes"
FILE_BYTES = "spark.sql.files.maxPartitionBytes"
MODELS = ("logistic", "random_forest", "gradient_boosting")
ALERT_DROP = 0.05
AUC_FLOOR = 0.75


def model_inputs(df: DataFrame, *keep: str) -> DataFrame:
    """Model columns with gaps filled: 0 for numbers, "Unknown" for categories."""
    absent = [c for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES if c not in df.columns]
    if absent:
        raise ValueError(f"Missing required feature: {', '.join(absent)}")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMERIC_FEATURES]
    texts = [F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in CATEGORICAL_FEATURES]
    return df.select(*keep, *numbers, *texts)


def training_rows(features: DataFrame, folder: str | None = None) -> DataFrame:
    """Inputs, 0/1 label and split of every loan with a known outcome; the split's draws are written to ``folder``."""
    labelled = features.filter(F.col("default_flag").isNotNull()).withColumn(
        "label", F.col("default_flag").cast("int")
    )
    rows = model_inputs(labelled, "loan_id", "customer_id", "label")
    return stratified_split(rows, "label", "loan_id", TEST_SHARE, SEED, folder)


def assembly(scaled: bool = False) -> list:
    stages = [
        StringIndexer(
            inputCols=CATEGORICAL_FEATURES, outputCols=ENCODED,
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ),
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features" if scaled else "features"),
    ]
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return stages


def classifier(name: str, rows: int):
    """One of the three models; the logistic penalty 1/rows weighs the loss like C = 1.

    Trees get room to split many nodes per pass over the data. A forest keeps every row's node ids: they are most
    of what a row takes (1.6 KB instead of 0.6), but without them fits took 1.8 times as long. They are not
    checkpointed: a forest passes over its rows once a level, which needs no shorter lineage.
    """
    if name == "logistic":
        return LogisticRegression(
            maxIter=MAX_ITERATIONS, regParam=1.0 / max(rows, 1), standardization=False, tol=1e-4
        )
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=TREES, maxDepth=FOREST_DEPTH, seed=SEED, maxMemoryInMB=TREE_MEMORY, cacheNodeIds=True,
            checkpointInterval=-1,
        )
    return GBTClassifier(
        maxIter=TREES, stepSize=BOOST_STEP, maxDepth=BOOST_DEPTH, seed=SEED, maxMemoryInMB=TREE_MEMORY
    )


def with_class_weights(train: DataFrame) -> DataFrame:
    """Add ``weight``, inversely proportional to the share of the row's class."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(row["n"] for row in counts)
    weight = F
    for row in counts:
        weight = weight.when(F.col("label") == row["label"], total / (len(counts) * row["n"]))
    return train.withColumn("weight", weight)


@dataclass(frozen=True)
class Rows:
    """Assembled train rows, their number and preparation, and the raw test rows."""

    train: DataFrame
    train_size: int
    test: DataFrame
    preparation: PipelineModel


def prepare(features: DataFrame, balanced: bool = False, scaled: bool = False) -> Rows:
    """Split, encode and assemble the rows that models are fitted on.

    Both steps are written to the shared folder: training passes over the rows many
    times, and a lost executor then re-reads instead of joining again. Of the split only the
    test rows stay there.
    """
    spark = features.sparkSession
    split = scratch_path(spark, "split-rows")
    with passing(spark, "split") as steps:
        training_rows(features, steps).write.partitionBy("split").parquet(split)
    rows = spark.read.parquet(split)
    train = rows.filter(F.col("split") == "train").drop("split")
    if balanced:
        train = with_class_weights(train)
    preparation = Pipeline(stages=assembly(scaled)).fit(train)
    assembled = scratch_path(spark, "train-rows")
    kept = ["label", "features", *(["weight"] if balanced else [])]
    ready = preparation.transform(train).select(kept)
    # Fitting is bound by processors, and by the rows a task holds, not by the bytes of files.
    size = train.count()
    cores = spark.sparkContext.defaultParallelism
    if size > FITTED_PER_TASK or ready.rdd.getNumPartitions() < cores:
        ready = ready.repartition(max(cores, -(-size // FITTED_PER_TASK)))
    ready.write.parquet(assembled)
    ready = spark.read.parquet(assembled)
    remove(spark, f"{split}/split=train")
    release(spark)
    return Rows(ready, size, rows.filter(F.col("split") == "test").drop("split"), preparation)


@contextmanager
def file_per_task(spark: SparkSession) -> Iterator[None]:
    """Scans put no two files into one task, so that it has the rows that were dealt to it."""
    before = spark.conf.get(FILE_COST)
    spark.conf.set(FILE_COST, spark.conf.get(FILE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(FILE_COST, before)


def tree_groups(rows: int) -> list[int]:
    """Numbers of trees that a forest fits at once: what a fit keeps of a row grows with its trees."""
    groups = min(TREES, max(1, -(-rows * TREES // FOREST_DRAWS)))
    return [TREES * (at + 1) // groups - TREES * at // groups for at in range(groups)]


def fit_forest(chosen: RandomForestClassifier, train: DataFrame, groups: list[int]) -> RandomForestClassificationModel:
    """One forest, its trees fitted in groups on the same rows; every group draws rows and features anew."""
    if len(groups) == 1:
        return chosen.fit(train)
    trees, last = [], None
    for number, size in enumerate(groups):
        last = chosen.copy({chosen.numTrees: size, chosen.seed: SEED + SEED_STEP * number}).fit(train)._java_obj
        trees += list(last.trees())
    # Spark has no way to put forests together but the model's own constructor.
    context = train.sparkSession.sparkContext
    classes = context._jvm.org.apache.spark.ml.classification
    array = context._gateway.new_array(classes.DecisionTreeClassificationModel, len(trees))
    for at, tree in enumerate(trees):
        array[at] = tree
    whole = classes.RandomForestClassificationModel(last.uid(), array, last.numFeatures(), last.numClasses())
    model = chosen._copyValues(RandomForestClassificationModel(whole))
    model._transfer_params_to_java()
    return model


def fit(rows: Rows, name: str) -> PipelineModel:
    """Fit one model; the result holds the encoding and the feature order with it."""
    chosen = classifier(name, rows.train_size)
    if "weight" in rows.train.columns:
        chosen = chosen.setWeightCol("weight")
    # A task may have all rows as long as they are few.
    dealt = rows.train_size > FITTED_PER_TASK
    with file_per_task(rows.train.sparkSession) if dealt else nullcontext():
        if name == "random_forest":
            model = fit_forest(chosen, rows.train, tree_groups(rows.train_size))
        else:
            model = chosen.fit(rows.train)
    return PipelineModel(stages=[*rows.preparation.stages, model])


def default_probability() -> Column:
    return vector_to_array("probability")[1]


def with_probability(model: PipelineModel, rows: DataFrame, name: str = "default_probability") -> DataFrame:
    """Probability of default for every row; the model's working columns are dropped."""
    scored = model.transform(rows).withColumn("_p", default_probability())
    working = ["raw_features", "features", "rawPrediction", "probability", "prediction", *ENCODED]
    return scored.drop(*working).withColumnRenamed("_p", name)


def test_scores(rows: Rows, models: dict[str, PipelineModel]) -> DataFrame:
    """Label and probability of every test row under every model."""
    parts = [
        with_probability(model, rows.test, "probability").select(
            F.lit(name).alias(MODEL), "label", "probability"
        )
        for name, model in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def model_comparison(scores: DataFrame) -> DataFrame:
    return report(scores).select(MODEL, "accuracy", "precision", "recall", "f1_score", "auc_roc")


def feature_importance(model: PipelineModel) -> DataFrame | None:
    """Importance per feature, largest first; None for a model without importances."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    pairs = list(zip(FEATURES, (float(v) for v in last.featureImportances.toArray())))
    ranked = SparkSession.active().createDataFrame(pairs, FEATURE_IMPORTANCE)
    return ranked.orderBy(F.col("importance").desc(), "feature")


def batch_scores(model: PipelineModel, features: DataFrame, rows: int | None = None) -> DataFrame:
    """Loan, customer and default probability for every feature row.

    Rows are dealt out before the model by their number, ``rows`` or else counted: a feature table has
    few bytes, and its partitions would leave most cores without work.
    """
    inputs = model_inputs(features, "loan_id", "customer_id")
    number = features.count() if rows is None else rows
    inputs = by_rows(inputs, ["loan_id", "customer_id"], number, SCORED_PER_TASK)
    return with_probability(model, inputs).select("loan_id", "customer_id", "default_probability")


def explain(model: PipelineModel, features: DataFrame, top: int | None = 5) -> DataFrame:
    """Every row's values of the model's most important features.

    Importances belong to the model, so the same few features are unrolled for all
    rows and no per-row ranking is needed.
    """
    inputs = model_inputs(features, "loan_id")
    encoded = Pipeline(stages=list(model.stages[:1])).fit(inputs).transform(inputs)
    ranked = feature_importance(model).limit(top or len(FEATURES)).collect()
    entries = [
        F.struct(
            F.lit(place).alias("place"),
            F.lit(row["feature"]).alias("feature"),
            F.col(row["feature"]).cast("double").alias("value"),
            F.lit(row["importance"]).alias("importance"),
        )
        for place, row in enumerate(ranked, 1)
    ]
    return encoded.select("loan_id", F.inline(F.array(*entries)))


def select_model(comparison: DataFrame, metric: str = "auc_roc", floor: float = AUC_FLOOR) -> DataFrame:
    """The best model by ``metric``, if it reaches the floor."""
    return (
        comparison.filter(F.col(metric) >= floor)
        .orderBy(F.col(metric).desc(), MODEL)
        .limit(1)
        .select(MODEL, metric)
    )


def performance_drops(metadata: DataFrame, metric: str = "auc_roc", drop: float = ALERT_DROP) -> DataFrame:
    """Models whose metric fell by more than ``drop`` of the one trained before.

    Metadata holds one row per deployed model of a name.
    """
    order = Window.partitionBy("model_name").orderBy("training_date", "model_id")
    before = metadata.withColumn("previous", F.lag(metric).over(order))
    lost = ratio(F.col("previous") - F.col(metric), F.col("previous"))
    return before.filter(lost > drop).select(
        "model_name", "model_version", "training_date", F.col(metric).alias("current"), "previous",
        lost.alias("lost_share"),
    )


def cross_validate(
    train: DataFrame, classifier, grid: dict[str, list], folds: int = 5, scaled: bool = False
):
    """Grid search by area under ROC; ``grid`` maps the classifier's parameters to values."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), values)
    validator = CrossValidator(
        estimator=Pipeline(stages=[*assembly(scaled), classifier]),
        estimatorParamMaps=builder.build(),
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
        numFolds=folds,
        seed=SEED,
    )
    return validator.fit(train)
