"""Training, scoring, explanation, saving and the choice of a model."""

import datetime as dt
import os

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lendwell import session
from lendwell.functions import credit as fx
from lendwell.operators import evaluation
from lendwell.plans import training
from lendwell.plans.features import risk_features
from lendwell.sources import models


@pytest.fixture(scope="module")
def features(small):
    """Loans whose outcome follows the rule scorecard, so that it can be learned."""
    chance = fx.rule_scorecard(
        F.col("credit_score"), F.col("debt_to_income_ratio"), F.col("employment_status"),
        F.col("num_delinquent_accounts"))
    return risk_features(*small.staging).withColumn("default_flag", chance > 0.4)


@pytest.fixture(scope="module")
def rows(features):
    return training.prepare(features)


@pytest.fixture(scope="module")
def forest(rows):
    return training.fit(rows, "random_forest")


@pytest.fixture(scope="module")
def logistic(rows):
    return training.fit(rows, "logistic")


def test_models_learn(rows, forest, logistic):
    scores = training.test_scores(rows, {"logistic": logistic, "random_forest": forest})
    found = {r["model_name"]: r["auc_roc"] for r in training.model_comparison(scores).collect()}
    assert found["logistic"] > 0.7 and found["random_forest"] > 0.9
    chosen = training.select_model(training.model_comparison(scores)).collect()
    assert [r["model_name"] for r in chosen] == ["random_forest"]
    assert training.select_model(training.model_comparison(scores), floor=1.1).count() == 0


def test_boosting_learns(rows):
    from pyspark.ml import PipelineModel
    few = training.classifier("gradient_boosting", rows.train_size).setMaxIter(5).fit(rows.train)
    model = PipelineModel(stages=[*rows.preparation.stages, few])
    scores = training.test_scores(rows, {"gradient_boosting": model})
    assert evaluation.report(scores).first()["auc_roc"] > 0.8
    assert training.feature_importance(model).count() == 20


def test_same_seed_same_scores(rows, forest, features):
    again = training.fit(rows, "random_forest")
    first, second = (training.batch_scores(m, features).orderBy("loan_id").collect() for m in (forest, again))
    assert first == second


def test_saved_model_scores_alike(forest, features, tmp_path):
    path = str(tmp_path / "model")
    models.save_model(forest, path)
    loaded = models.load_model(path)
    pairs = training.batch_scores(forest, features).withColumnRenamed("default_probability", "a").join(
        training.batch_scores(loaded, features), ["loan_id", "customer_id"])
    assert pairs.filter(F.col("a") != F.col("default_probability")).count() == 0
    assert models.validate_model(path, features.limit(5))
    with pytest.raises(ValueError):
        models.validate_model(path, features.limit(0))


def test_scores_are_probabilities(forest, features):
    scores = training.batch_scores(forest, features)
    assert scores.count() == 1500
    assert scores.filter(~F.col("default_probability").between(0, 1)).count() == 0


def test_unknown_category_is_scored(forest, features):
    odd = features.limit(3).withColumn("loan_purpose", F.lit("Boat"))
    assert training.batch_scores(forest, odd).count() == 3


def test_missing_feature_is_named(features):
    with pytest.raises(ValueError, match="credit_score"):
        training.model_inputs(features.drop("credit_score"))


def test_importance_is_ranked_and_complete(forest, logistic):
    rows = training.feature_importance(forest).collect()
    assert len(rows) == 20
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    assert training.feature_importance(logistic) is None


def test_explanation_shows_values_of_the_top_features(forest, features):
    top = [r["feature"] for r in training.feature_importance(forest).limit(5).collect()]
    rows = training.explain(forest, features).filter("loan_id = 7").orderBy("place").collect()
    assert [r["feature"] for r in rows] == top
    loan = features.filter("loan_id = 7").first()
    for row in rows:
        if row["feature"] in training.NUMERIC_FEATURES:
            assert row["value"] == float(loan[row["feature"]] or 0)
    assert training.explain(forest, features, top=None).filter("loan_id = 7").count() == 20


def test_balanced_weights(rows):
    weighted = training.with_class_weights(rows.train)
    sums = [r["s"] for r in weighted.groupBy("label").agg(F.sum("weight").alias("s")).collect()]
    assert sums[0] == pytest.approx(sums[1])


def test_scaled_and_balanced_preparation(features):
    prepared = training.prepare(features, balanced=True, scaled=True)
    model = training.fit(prepared, "logistic")
    scores = training.test_scores(prepared, {"logistic": model})
    assert evaluation.report(scores).first()["auc_roc"] > 0.7


def test_grid_search(features):
    train = training.training_rows(features).filter("split = 'train'")
    found = training.cross_validate(train, LogisticRegression(maxIter=5), {"regParam": [0.01, 10.0]}, folds=2, scaled=True)
    assert len(found.avgMetrics) == 2 and found.avgMetrics[0] >= found.avgMetrics[1]


def wide_rows(spark, count):
    """Made-up feature rows with a label that follows one of them."""
    numbers = [F.pmod(F.hash("id", F.lit(name)), F.lit(50)).cast("double").alias(name) for name in training.NUMERIC_FEATURES]
    texts = [F.concat(F.lit("k"), F.col("id") % 3).alias(name) for name in training.CATEGORICAL_FEATURES]
    rows = spark.range(count).select(F.col("id").alias("loan_id"), F.col("id").alias("customer_id"), *numbers, *texts)
    return rows.withColumn("default_flag", F.col("credit_score") > 20)


def test_tasks_hold_bounded_rows_while_a_model_is_fitted(spark, monkeypatch):
    monkeypatch.setattr(training, "FITTED_PER_TASK", 20)
    cost = spark.conf.get(training.FILE_COST)
    rows = training.prepare(wide_rows(spark, 1000).coalesce(1))
    assert rows.train_size == rows.train.count() == 800
    held = []

    class Noting:
        def fit(self, train):
            held.extend(train.select("label").rdd.glom().map(len).collect())
            return LogisticRegression(maxIter=1).fit(train)

    monkeypatch.setattr(training, "classifier", lambda name, size: Noting())
    training.fit(rows, "logistic")
    assert sum(held) == 800 and max(held) <= 30
    assert spark.conf.get(training.FILE_COST) == cost


@pytest.fixture
def own_folder(spark, tmp_path, monkeypatch):
    """A shared folder that nothing else writes to."""
    before = session.shared_folder(spark)
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    yield str(tmp_path)
    spark.sparkContext.setCheckpointDir(before)


def test_of_the_split_only_test_rows_stay_on_disk(spark, own_folder):
    rows = training.prepare(wide_rows(spark, 1000))
    left = {os.path.relpath(at, own_folder) for at, _, names in os.walk(own_folder) if any(n.endswith(".parquet") for n in names)}
    assert {x.split("-")[0] for x in left} == {"train", "split"}
    assert {os.path.basename(x) for x in left if x.startswith("split")} == {"split=test"}
    assert (rows.train.count(), rows.test.count()) == (800, 200)


def test_forest_in_groups_of_trees(spark, rows, features, tmp_path, monkeypatch):
    """What a fit keeps of the rows is bounded: trees are fitted in groups, and none of it is checkpointed."""
    monkeypatch.setattr(training, "FOREST_DRAWS", rows.train_size * 40)
    assert training.classifier("random_forest", 1).getCheckpointInterval() == -1
    held = []
    fit = training.RandomForestClassifier._fit

    def noting(self, train):
        held.append((self.getNumTrees(), self.getSeed()))
        return fit(self, train)

    monkeypatch.setattr(training.RandomForestClassifier, "_fit", noting)
    model = training.fit(rows, "random_forest")
    assert [n for n, _ in held] == [33, 33, 34] and len({s for _, s in held}) == 3
    last = model.stages[-1]
    assert last.getNumTrees == len(last.trees) == 100 and len({t.toDebugString for t in last.trees}) > 90
    assert sum(r["importance"] for r in training.feature_importance(model).collect()) == pytest.approx(1)
    scores = training.test_scores(rows, {"random_forest": model})
    assert training.model_comparison(scores).first()["auc_roc"] > 0.9
    models.save_model(model, str(tmp_path / "model"))
    loaded = models.load_model(str(tmp_path / "model"))
    first, second = (training.batch_scores(m, features).orderBy("loan_id").collect() for m in (model, loaded))
    assert first == second


@pytest.mark.parametrize("at_once", [10, 2])
def test_checked_explanations_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(entry, "CHECKED_AT_ONCE", at_once)
    day = dt.datetime(2001, 7, 1)
    tables = {
        "customer": ([(i, 100.0) for i in range(1, 4)], "c_custkey long, c_acctbal double"),
        "orders": ([(i, 1 + i % 3, "F", 1000.0, day, "1-URGENT") for i in range(1, 7)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                   "o_orderdate timestamp_ntz, o_orderpriority string"),
        "events": ([(1, day, 1, "view", 5.0)],
                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    places = [(loan, place, "loan_amount" if place == 1 else f"f{place}", 7.0 if loan == 3 else 1000.0)
              for loan in (1, 2, 2, 3, None) for place in (1, 2)]
    shown = spark.createDataFrame(places, "loan_id long, place int, feature string, value double")
    monkeypatch.setattr(entry, "ml_explain", lambda *_: shown)
    found = entry.ml_explain_invariants(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2, 0), (2, 2, 2, 0), (3, 2, 2, 1)}
    if at_once == 2:  # written part by part
        return
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    assert any("loan_id" in line and "strategy=merge" in line for line in joins)
