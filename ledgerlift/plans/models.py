"""Trained models on ``pyspark.ml``: look-alike and purchase models, calibration, forests, metrics, explanations.

Differences to expect against single-machine libraries are in the optimiser and in the standard
deviation used for scaling (sample instead of population); ranks do not depend on the latter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.numbers import clip
from ledgerlift.operators.ranking import exact_quantiles, global_row_number, grouped_row_number
from ledgerlift.plans import forest as fo
from ledgerlift.plans.features import sanitize
from ledgerlift.plans.forest import Forest, spread
from ledgerlift.session import stage

NUMERIC = ("revenue_k_eur", "headcount", "growth_pct", "revenue_per_employee", "segment_lift")
CATEGORICAL = ("industry", "revenue_bucket", "headcount_bucket", "company_segment", "growth_bucket", "municipality", "region")


class TrainingError(ValueError):
    """Data that no model can be trained on."""


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, missing: str = "unknown") -> DataFrame:
    """Typed feature columns; a missing category becomes ``missing`` (or the most frequent one, if asked with "mode")."""
    typed = sanitize(df, numeric, categorical)
    if missing != "mode":
        return typed.withColumns({c: F.coalesce(c, F.lit(missing)) for c in categorical})
    out = typed
    for c in categorical:
        counts = typed.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        most = counts.agg(F.max_by(c, F.struct("n", c)).alias("m")).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), most))
    return out


def medians(df: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact median of each column, nulls and NaN left out; 0 for a column without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("e")).select("e.c", "e.v")
    rows = exact_quantiles(long.filter(~F.isnan("v")), ["c"], "v", [0.5]).collect()  # a row a column
    return {c: 0.0 for c in numeric} | {r["c"]: float(r["value"]) for r in rows}


def imputed(df: DataFrame, middle: dict[str, float]) -> DataFrame:
    """Columns ``_<name>_imp`` in which missing numbers are the median."""
    return df.withColumns({f"_{c}_imp": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) for c, m in middle.items()})


def preprocessing(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Standardise numbers (see :func:`imputed`); index and one-hot categories (unseen ones are all zeros)."""
    return [
        VectorAssembler(inputCols=[f"_{c}_imp" for c in numeric], outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=list(categorical), outputCols=[f"_{c}_idx" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"_{c}_idx" for c in categorical], outputCols=[f"_{c}_vec" for c in categorical], dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=["_scaled", *[f"_{c}_vec" for c in categorical]], outputCol="features"),
    ]


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (2 n_class) from one aggregated row."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    n, positives = row["n"], row["p"] or 0.0
    if not n or positives <= 0 or positives >= n:
        raise TrainingError("the training set needs both classes")
    return df.withColumn("_weight", F.when(F.col(label) == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives))))


def split_stratified(df: DataFrame, label: str, key: str, *, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``part`` (train or test): exactly the test share of each class, picked by hash order."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    ranked = grouped_row_number(hashed, [label], [("_h", "asc"), (key, "asc")], "_place")
    sizes = ranked.groupBy(label).agg(F.count("*").alias("_size"))  # one row per class
    joined = ranked.join(F.broadcast(sizes), label)
    return joined.withColumn("part", F.when(F.col("_place") <= F.rint(F.col("_size") * test_share), "test").otherwise("train")).drop("_h", "_place", "_size")


def folds(df: DataFrame, key: str, k: int, *, seed: int = 42, label: str | None = None) -> DataFrame:
    """Fold number 0..k-1 by hash; with a label, classes are dealt out evenly."""
    if label is None:
        return df.withColumn("_fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(k)).cast("int"))
    hashed = df.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    return grouped_row_number(hashed, [label], [("_h", "asc"), (key, "asc")], "_place").withColumn(
        "_fold", F.pmod(F.col("_place"), F.lit(k)).cast("int")
    ).drop("_h", "_place")


def estimator(kind: str, rows: int, *, label: str = "label", seed: int = 42, c: float = 1.0, rounds: int = 100):
    """Balanced logistic regression with an L2 term like C on the summed loss, or boosted trees."""
    if kind == "logistic_regression":
        return LogisticRegression(
            featuresCol="features", labelCol=label, weightCol="_weight", regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=1000,
        )
    if kind == "gradient_boosting":
        return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=5, seed=seed)
    raise TrainingError(f"unknown model type {kind!r}")


@dataclass
class Trained:
    """Fitted preprocessing and model, with what is needed to score and to explain."""

    preprocessor: PipelineModel
    model: object
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    middle: dict[str, float]
    calibrators: list = field(default_factory=list)

    def features(self, df: DataFrame) -> DataFrame:
        return self.preprocessor.transform(imputed(prepare(df, self.numeric, self.categorical), self.middle))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Probability of the positive class (mean of the calibrated models, if there are any)."""
        ready = self.features(df)
        columns = [c for c in df.columns if c != out]
        if not self.calibrators:
            scored = self.model.transform(ready).withColumn(out, vector_to_array("probability")[1])
            return scored.select(*columns, out)
        total = F.lit(0.0)
        for i, (model, slope, intercept) in enumerate(self.calibrators):
            ready = model.transform(ready).withColumn(f"_raw{i}", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")
            total = total + 1.0 / (1.0 + F.exp(-(F.col(f"_raw{i}") * slope + intercept)))
        return ready.withColumn(out, total / len(self.calibrators)).select(*columns, out)


def train(df: DataFrame, *, label: str = "label", numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, kind: str = "logistic_regression", seed: int = 42) -> Trained:
    ready = with_class_weights(prepare(df, numeric, categorical), label)
    middle = medians(ready, numeric)
    ready = imputed(ready, middle)
    pre = Pipeline(stages=preprocessing(numeric, categorical)).fit(ready)
    data = pre.transform(ready).select("features", F.col(label).cast("double").alias(label), "_weight")
    data = stage(data, "training")  # read once per iteration
    fitted = estimator(kind, data.count(), label=label, seed=seed).fit(data)
    return Trained(pre, fitted, tuple(numeric), tuple(categorical), middle)


def train_and_evaluate(df: DataFrame, key: str, *, label: str = "label", numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, seed: int = 42) -> tuple[Trained, DataFrame]:
    """Model trained on four fifths of each class, and its metrics on the rest."""
    used = df.select(*[c for c in dict.fromkeys([key, label, *numeric, *categorical]) if c in df.columns])  # the split sorts and writes its rows
    parts = stage(split_stratified(used, label, key, seed=seed), "split")
    model = train(parts.filter("part = 'train'"), label=label, numeric=numeric, categorical=categorical, seed=seed)
    held_out = model.score(parts.filter("part = 'test'"))
    return model, classification_metrics(held_out, label, "score")


def calibrate_sigmoid(df: DataFrame, key: str, *, label: str = "label", numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, k: int = 3, kind: str = "logistic_regression", seed: int = 42) -> Trained:
    """Model plus up to ``k`` fold models, each with a sigmoid fitted on the fold it has not seen."""
    base = train(df, label=label, numeric=numeric, categorical=categorical, kind=kind, seed=seed)
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    ready = with_class_weights(prepare(df, numeric, categorical), label)
    data = folds(base.preprocessor.transform(imputed(ready, base.middle)).select(key, "features", F.col(label).cast("double").alias(label), "_weight"), key, min(k, max(smallest, 1)), label=label, seed=seed)
    data = stage(data, "folds")

    def sigmoid(model, rows: DataFrame) -> tuple[float, float]:
        raw = model.transform(rows).select(F.array(vector_to_array("rawPrediction")[1]).alias("_r"), label)
        raw = stage(raw.select(array_to_vector("_r").alias("_x"), label), "sigmoid")
        line = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0, standardization=False, maxIter=100).fit(raw)
        return float(line.coefficients[0]), float(line.intercept)

    if smallest < 2:
        base.calibrators = [(base.model, *sigmoid(base.model, data))]
        return base
    for i in range(min(k, smallest)):
        seen, unseen = data.filter(F.col("_fold") != i), data.filter(F.col("_fold") == i)
        fitted = estimator(kind, seen.count(), label=label, seed=seed).fit(seen)
        base.calibrators.append((fitted, *sigmoid(fitted, unseen)))
    return base


def calibrate_isotonic(df: DataFrame, raw: str, label: str, out: str = "calibrated_probability", *, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Monotone calibration of a probability, kept in .01-.99; too few distinct values give the mean."""
    safe = stage(df.withColumn("_raw", clip(F.coalesce(F.col(raw), F.lit(0.0)), 0.0, 1.0)), "isotonic")  # read three times
    row = safe.agg(F.count_distinct("_raw").alias("v"), F.count_distinct(label).alias("c"), F.avg(F.col(label).cast("double")).alias("m")).first()
    if row["v"] <= 2 or row["c"] < 2:
        return safe.withColumn(out, F.lit(float(row["m"] or 0.0))).drop("_raw")
    # equal scores are pooled first: the fit then sees one weighted point per score
    points = safe.groupBy("_raw").agg(F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    fitted = IsotonicRegression(featuresCol="_raw", labelCol="_y", weightCol="_w", isotonic=True).fit(points)
    return fitted.transform(safe).withColumn(out, clip(F.col("prediction"), low, high)).drop("_raw", "prediction")


#: As deep as Spark's forests can be; the smallest leaf is what ends a branch.
DEEPEST = 30

#: How Spark's forests are grown, not how large: each row remembers its node, so that it isn't sent down all trees for every group
#: of nodes, and a group holds four times as many nodes as by default, so that there are fewer passes.
GROWING = {"cacheNodeIds": True, "maxMemoryInMB": 1024}


def out_of_fold(df: DataFrame, key: str, features: Sequence[str], *, label: str, target: str, k: int = 5, trees: int = 250, seed: int = 42, depth: int = DEEPEST) -> DataFrame:
    """Forest predictions for rows the forest has not seen: class probability and value.

    The classes are dealt out evenly over at most ``k`` folds, as many as the smaller class has rows; with fewer than
    two of a class the probability is the rate of the label for everyone.  The values have folds of their own, by
    key alone: ``k`` of them, fewer below 100 rows a fold, two at least.
    """
    ready = sanitize(df, features, fill=0.0)
    data = ready.withColumns({"_y": F.col(label).cast("double"), "_t": F.greatest(F.col(target), F.lit(0.0))})
    row = data.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("p")).first()
    smaller = int(min(row["p"], row["n"] - row["p"]))
    class_folds, value_folds = (max(2, min(k, smaller)) if smaller >= 2 else 0), min(k, max(2, row["n"] // 100))
    if class_folds:
        data = folds(data, key, class_folds, seed=seed, label="_y").withColumnRenamed("_fold", "_class_fold")
    data = folds(data, key, value_folds, seed=seed + 1)
    rate = row["p"] / row["n"] if row["n"] else 0.0
    if row["n"] > fo.MOST_ROWS:
        return _spark_out_of_fold(df.columns, data, key, features, rate, class_folds, value_folds, trees, depth, seed)
    weights = (row["n"] / (2.0 * (row["n"] - row["p"])), row["n"] / (2.0 * row["p"])) if class_folds else None
    forests = [Forest(0, "_t", trees, 10, math.ceil(len(features) / 3), depth, seed, fold="_fold", number=i) for i in range(value_folds)]
    forests += [Forest(1, "_y", trees, 15, math.ceil(math.sqrt(len(features))), depth, seed, classes=weights, fold="_class_fold", number=i) for i in range(class_folds)]
    facts = {"_y": "u1", "_t": "f8", "_fold": "u1"} | ({"_class_fold": "u1"} if class_folds else {})
    out = fo.grown(data, [key], features, {}, facts, forests, together=25)
    return out.select(
        *df.columns, F.greatest("_out0", F.lit(0.0)).alias("improved_expected_sales_eur"),
        clip(F.col("_out1") if class_folds else F.lit(float(rate)), 0.01, 0.99).alias("improved_probability_of_growth"),
    )


def _spark_out_of_fold(columns: Sequence[str], data: DataFrame, key: str, features: Sequence[str], rate: float, class_folds: int, value_folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """As :func:`out_of_fold`, with Spark's forests, which no task has to hold the rows for."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    if class_folds:
        data = with_class_weights(data, "_y")
    data = stage(spread(data, [key]), "forest")
    chance = None
    for i in range(class_folds):
        seen, unseen = data.filter(F.col("_class_fold") != i), data.filter(F.col("_class_fold") == i)
        fitted = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="_weight", numTrees=trees, minInstancesPerNode=15, maxDepth=depth, seed=seed, **GROWING).fit(seen)
        part = fitted.transform(unseen).select(key, clip(vector_to_array("probability")[1], 0.01, 0.99).alias("improved_probability_of_growth"))
        chance = part if chance is None else chance.unionByName(part)
    value = None
    for i in range(value_folds):
        seen, unseen = data.filter(F.col("_fold") != i), data.filter(F.col("_fold") == i)
        fitted = RandomForestRegressor(featuresCol="features", labelCol="_t", numTrees=trees, minInstancesPerNode=10, maxDepth=depth, seed=seed, **GROWING).fit(seen)
        part = fitted.transform(unseen).select(*columns, F.greatest("prediction", F.lit(0.0)).alias("improved_expected_sales_eur"))
        value = part if value is None else value.unionByName(part)
    if chance is None:
        return value.withColumn("improved_probability_of_growth", clip(F.lit(float(rate)), 0.01, 0.99))
    return value.join(chance, key)


def two_stage(df: DataFrame, *, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, trees: int = 300, depth: int = DEEPEST, seed: int = 42) -> DataFrame:
    """Chance to buy times predicted yearly value of a buyer (forest on log sales)."""
    purchase = train(df, label="has_sales_history", numeric=numeric, categorical=categorical, seed=seed)
    scored = purchase.model.transform(purchase.features(df)).withColumn("purchase_probability", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    if df.count() > fo.MOST_ROWS:
        buyers = purchase.features(df.filter("has_sales_history = 1")).withColumn("_log", F.log1p("actual_avg_annual_sales_3y_eur"))
        buyers = stage(spread(buyers.select("features", "_log", *df.columns), df.columns).select("features", "_log"), "buyers")
        value = RandomForestRegressor(featuresCol="features", labelCol="_log", numTrees=trees, minInstancesPerNode=5, maxDepth=depth, seed=seed, **GROWING).fit(buyers)
        scored = value.transform(scored)
    else:
        indexer = next(s for s in purchase.preprocessor.stages if hasattr(s, "labelsArray"))
        # with the place of what wasn't seen; each level is a feature, as in the one-hot columns
        levels = {f"_{c}_idx": len(labels) + 1 for c, labels in zip(categorical, indexer.labelsArray)}
        numbers = [f"_{c}_imp" for c in numeric]
        rows = scored.select(*df.columns, "purchase_probability", *numbers, *levels, F.when(F.col("has_sales_history") == 1, F.log1p("actual_avg_annual_sales_3y_eur")).otherwise(0.0).alias("_log"))
        tried = math.ceil((len(numbers) + sum(levels.values())) / 3)
        forest = Forest(0, "_log", trees, 5, tried, depth, seed, seen="has_sales_history")
        scored = fo.grown(rows, df.columns, numbers, levels, {"_log": "f8", "has_sales_history": "u1"}, [forest]).withColumnRenamed("_out0", "prediction")
    scored = scored.withColumn("predicted_buyer_potential_eur", F.greatest(F.expm1("prediction"), F.lit(0.0)))
    return scored.withColumn("expected_12m_sales_eur", F.col("purchase_probability") * F.col("predicted_buyer_potential_eur")).select(
        *df.columns, "purchase_probability", "predicted_buyer_potential_eur", "expected_12m_sales_eur"
    )


def classification_metrics(scored: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC, average precision, Brier score, log loss, positive rate and rows, long form.

    AUC is the rank sum with mean ranks for ties; average precision steps through the distinct
    scores.  Both come from global row numbers, so no task sorts the whole table.
    """
    rows = scored.select(F.col(score).alias("s"), F.col(label).cast("double").alias("y"), F.monotonically_increasing_id().alias("_id"))
    ranked = stage(global_row_number(rows, [("s", "desc"), ("_id", "asc")], "place"), "metric-rows")
    positives = global_row_number(ranked.filter("y = 1").select("s", "_id"), [("s", "desc"), ("_id", "asc")], "hit")
    top = positives.groupBy("s").agg(F.max("hit").alias("tp"))
    groups = ranked.groupBy("s").agg(F.sum("y").alias("p"), F.avg("place").alias("mean_place"), F.max("place").alias("seen")).join(top, "s", "left")
    totals = ranked.agg(F.count("*").alias("n"), F.sum("y").alias("p")).select(F.struct("n", "p").alias("t")).scalar()
    groups = groups.withColumn("_t", totals)
    n, p = F.max("_t.n"), F.max("_t.p")
    ascending = F.col("p") * (F.col("_t.n") + 1 - F.col("mean_place"))
    auc = F.try_divide(F.sum(ascending) - p * (p + 1) / 2, p * (n - p))
    ap = F.sum(F.when(F.col("p") > 0, F.col("p") / F.col("_t.p") * F.col("tp") / F.col("seen")).otherwise(0.0))
    ranks = groups.agg(auc.alias("roc_auc"), ap.alias("average_precision"))
    safe = F.least(F.greatest(F.col("s"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = ranked.agg(
        F.count("*").cast("double").alias("rows"), F.avg("y").alias("positive_rate"), F.avg((F.col("s") - F.col("y")) ** 2).alias("brier_score"),
        F.avg(-(F.col("y") * F.log(safe) + (1 - F.col("y")) * F.log(1 - safe))).alias("log_loss"),
    )
    names = ["roc_auc", "average_precision"]
    return ranks.unpivot([], names, "metric", "value").unionByName(loss.unpivot([], ["rows", "positive_rate", "brier_score", "log_loss"], "metric", "value"))


def permutation_importance(model, data: DataFrame, key: str, features: Sequence[str], *, label: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Loss of accuracy when one feature is taken from another row: mean and spread over the repeats.

    Rows are put in hash order once per repeat and each feature is borrowed from the row a fixed
    distance further on, so one join serves all features.  ``data`` has an array column ``values``.
    """
    base = stage(data.select(key, "values", F.col(label).cast("double").alias("_y")), "importance")
    n = base.count()
    right = F.avg((F.col("prediction") == F.col("_y")).cast("double"))
    whole = model.transform(base.withColumn("features", array_to_vector("values"))).agg(right.alias("a")).first()["a"]
    runs = None
    for r in range(repeats):
        order = base.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed + r)))
        placed = stage(global_row_number(order, [("_h", "asc"), (key, "asc")], "_place").drop("_h"), "importance-order")
        steps = F.array(*[F.lit(1 + (7919 * (i + 1) * (r + 1)) % max(n - 1, 1)) for i in range(len(features))])
        asked = placed.select("values", "_y", "_place", F.posexplode(steps).alias("_f", "_step")).withColumn("_from", F.pmod(F.col("_place") - 1 + F.col("_step"), F.lit(n)) + 1)
        donors = placed.select(F.col("_place").alias("_from"), F.col("values").alias("_donor"))
        mixed = spread(asked, ["_place", "_f"]).join(donors, "_from").withColumn(
            "values", F.transform("values", lambda x, i: F.when(i == F.col("_f"), F.element_at("_donor", F.col("_f") + 1)).otherwise(x))
        )
        run = model.transform(mixed.withColumn("features", array_to_vector("values"))).groupBy("_f").agg((F.lit(whole) - right).alias("drop"))
        runs = run if runs is None else runs.unionByName(run)
    names = F.array(*[F.lit(f) for f in features])
    return runs.groupBy("_f").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).select(
        F.element_at(names, F.col("_f") + 1).alias("feature"), "importance_mean", "importance_std"
    )


def forest_importance(df: DataFrame, key: str, features: Sequence[str], *, label: str, trees: int = 250, depth: int = DEEPEST, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Permutation importance of a class forest on the rows it has seen."""
    rows = stage(df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features]), "importance-frame")
    if rows.count() <= fo.MOST_ROWS:
        forest = Forest(0, label, trees, 15, math.ceil(math.sqrt(len(features))), depth, seed, classes=(1.0, 1.0))
        return fo.importance(rows, [key], features, label, forest, repeats=repeats, seed=seed)
    frame = stage(spread(rows, [key]), "importance-frame")
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(frame.withColumn("_y", F.col(label).cast("double")))
    fitted = RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=trees, minInstancesPerNode=15, maxDepth=depth, seed=seed, **GROWING).fit(data)
    return permutation_importance(fitted, frame.select(key, label, F.array(*features).alias("values")), key, features, label=label, repeats=repeats, seed=seed)


def contributions(trained: Trained, df: DataFrame, *, n: int = 3) -> DataFrame:
    """Largest contributions (coefficient times value, per source feature) of each row, as structs and as text.

    A category contributes the coefficient of its own indicator, so nothing is exploded or shuffled.
    """
    weights = [float(w) for w in trained.model.coefficients.toArray()]
    indexer = next(s for s in trained.preprocessor.stages if hasattr(s, "labelsArray"))
    ready = trained.features(df)
    parts, at = [], len(trained.numeric)
    scaled = vector_to_array("_scaled")
    for i, c in enumerate(trained.numeric):
        parts.append(_part(c, scaled[i] * F.lit(weights[i]), F.col(c)))
    for c, labels in zip(trained.categorical, indexer.labelsArray):
        own = weights[at:at + len(labels)]
        at += len(labels)
        place = F.col(f"_{c}_idx").cast("int")
        table = F.array(*[F.lit(w) for w in own])
        parts.append(_part(c, F.when(place < len(own), F.element_at(table, place + 1)).otherwise(F.lit(0.0)), F.col(c)))
    by_size = F.array_sort(F.array(*parts), lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(0))
    out = ready.withColumn("top_contributions", F.slice(by_size, 1, n))
    text = F.transform("top_contributions", lambda x: F.format_string("%s=%s (%s%.3f)", x["feature"], x["value"], F.when(x["contribution"] >= 0, "+").otherwise("-"), F.abs(x["contribution"])))
    return out.select(*df.columns, "top_contributions", F.array_join(text, ", ").alias("explanation"))


def _part(name: str, contribution: Column, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("feature"), F.round(contribution, 6).alias("contribution"),
        F.when(contribution >= 0, "positive").otherwise("negative").alias("direction"), F.coalesce(value.cast("string"), F.lit("")).alias("value"),
    )
