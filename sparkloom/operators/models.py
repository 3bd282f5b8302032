"""Models on MLlib: one registry, one feature step, one result shape for all problem types."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, KMeans, LDA
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.feature import (PCA, CountVectorizer, OneHotEncoder, StandardScaler, StringIndexer,
                                UnivariateFeatureSelector, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import (AFTSurvivalRegression, DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression,
                                   IsotonicRegression, LinearRegression, RandomForestRegressor)
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.exprs import hash_bucket, rnd
from sparkloom.operators.leaves import largest_products
from sparkloom.operators.ordered import row_numbers
from sparkloom.operators.splits import class_weights, undersample
from sparkloom.session import cut_lineage, new_scratch_path

SEED = 42

# name -> (problem kinds, factory); factories get parameters by keyword
MODELS: dict[str, tuple[set[str], Callable]] = {}


def register_model(name: str, problems: set[str], factory: Callable) -> None:
    """factory(**params) -> an unfitted MLlib estimator on features / label."""
    MODELS[name] = (set(problems), factory)


CLASSES, NUMBERS = {"binary", "multiclass"}, {"regression"}
register_model("logistic", CLASSES, lambda n_rows=1, C=1.0, max_iter=100, **k: LogisticRegression(weightCol="weight", regParam=1.0 / (C * max(n_rows, 1)), maxIter=max_iter))
register_model("forest", CLASSES, lambda n_estimators=20, max_depth=8, **k: RandomForestClassifier(weightCol="weight", numTrees=n_estimators, maxDepth=max_depth, seed=SEED))
register_model("boosted", CLASSES, lambda n_estimators=20, max_depth=5, learning_rate=0.1, subsample=0.8, multiclass=False, **k: _boosted(n_estimators, max_depth, learning_rate, subsample, multiclass))
register_model("svm", {"binary"}, lambda max_iter=50, **k: LinearSVC(maxIter=max_iter, regParam=0.01))
register_model("tree", CLASSES, lambda max_depth=5, **k: DecisionTreeClassifier(maxDepth=max_depth, seed=SEED))
register_model("forest_regressor", NUMBERS, lambda n_estimators=20, max_depth=8, **k: RandomForestRegressor(numTrees=n_estimators, maxDepth=max_depth, seed=SEED))
register_model("boosted_regressor", NUMBERS, lambda n_estimators=20, max_depth=5, learning_rate=0.1, subsample=0.8, **k: GBTRegressor(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample, seed=SEED))
register_model("linear", NUMBERS, lambda **k: LinearRegression())
register_model("ridge", NUMBERS, lambda n_rows=1, alpha=1.0, **k: LinearRegression(elasticNetParam=0.0, regParam=alpha / max(n_rows, 1), standardization=False))
register_model("lasso", NUMBERS, lambda alpha=0.01, **k: LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False))
register_model("tree_regressor", NUMBERS, lambda max_depth=5, **k: DecisionTreeRegressor(maxDepth=max_depth, seed=SEED))
register_model("poisson", NUMBERS, lambda **k: GeneralizedLinearRegression(family="poisson", link="log"))
register_model("tweedie", NUMBERS, lambda power=1.5, **k: GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0))


def _boosted(n, depth, rate, part, multiclass):
    one = GBTClassifier(maxIter=n, maxDepth=depth, stepSize=rate, subsamplingRate=part, seed=SEED)
    return OneVsRest(classifier=one) if multiclass else one


def prepare(df: DataFrame, key: str, features: list[str], target: str, null_fill: float | None = 0.0) -> DataFrame:
    """key, label, weight, features: nulls filled (0 by default), balanced weights for classes."""
    d = df.where(F.col(target).isNotNull()).select(F.col(key).alias("key"), F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    if null_fill is not None:
        d = d.fillna(null_fill, features)
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(d)


def with_weights(df: DataFrame) -> DataFrame:
    return class_weights(df, "label")


def split(df: DataFrame, share: int = 20) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by a salted hash of the key, so that nothing else derived from a hash of the key goes with it."""
    test = hash_bucket(F.concat(F.col("key").cast("string"), F.lit("|split")), 100) < share
    return df.where(~test), df.where(test)


def fold_of(folds: int) -> Column:
    return hash_bucket(F.concat(F.col("key").cast("string"), F.lit("|fold")), folds)


EVALUATORS = {
    "binary": ("roc_auc", lambda: BinaryClassificationEvaluator(metricName="areaUnderROC")),
    "multiclass": ("f1", lambda: MulticlassClassificationEvaluator(metricName="f1")),
    "regression": ("r2", lambda: RegressionEvaluator(metricName="r2")),
}


def train(data: DataFrame, name: str, problem: str, **params):
    """Fit a registered model on prepared rows."""
    kinds, factory = MODELS[name]
    if problem not in kinds:
        raise ValueError(f"{name} does not solve {problem}")
    rows = with_weights(data) if problem in CLASSES else data
    n = rows.count() if name in ("logistic", "ridge") else 1
    return factory(n_rows=n, multiclass=problem == "multiclass", **params).fit(rows)


def train_many(data: DataFrame, names: list[str], problem: str, threads: int = 4, **params) -> DataFrame:
    """Several models over one cached training set; a failing model becomes a row, not an error."""
    tr, te = split(data)
    tr, te = tr.persist(), te.persist()
    metric, make = EVALUATORS[problem]

    def one(name):
        try:
            m = train(tr, name, problem, **params)
            ev = make()
            return (name, "ok", metric, round(float(ev.evaluate(m.transform(te))), 4), round(float(ev.evaluate(m.transform(tr))), 4), None)
        except Exception as ex:
            return (name, "failed", metric, None, None, type(ex).__name__)

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, names))
    tr.unpersist(), te.unpersist()
    return data.sparkSession.createDataFrame(rows, "model string, status string, metric string, test_score double, train_score double, error string")


def cross_validate(data: DataFrame, name: str, problem: str, folds: int = 5, **params) -> DataFrame:
    """Mean and population deviation of the score over hash folds."""
    metric, make = EVALUATORS[problem]
    d = data.withColumn("_fold", fold_of(folds)).persist()
    scores = []
    for k in range(folds):
        m = train(d.where(F.col("_fold") != k), name, problem, **params)
        scores.append(make().evaluate(m.transform(d.where(F.col("_fold") == k))))
    d.unpersist()
    mean = sum(scores) / folds
    sd = (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5
    return data.sparkSession.createDataFrame([(name, metric, round(mean, 4), round(sd, 4), folds)], "model string, metric string, mean double, std double, folds int")


# Search ranges; whole-number ends are integers, "log" draws on a log scale.
RANGES = {
    "boosted": {"maxIter": (10, 40), "stepSize": (0.01, 0.3, "log"), "maxDepth": (3, 8), "subsamplingRate": (0.5, 1.0)},
    "forest": {"numTrees": (10, 50), "maxDepth": (5, 12), "minInstancesPerNode": (1, 10)},
    "logistic": {"regParam": (1e-5, 1e-1, "log"), "maxIter": (50, 200)},
    "ridge": {"regParam": (0.001, 100.0, "log")},
    "lasso": {"regParam": (0.001, 100.0, "log")},
}


def draw_params(name: str, n_trials: int, seed: int = SEED) -> list[dict]:
    import math

    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        trial = {}
        for p, r in RANGES[name].items():
            if isinstance(r[0], int):
                trial[p] = rng.randint(r[0], r[1])
            elif len(r) == 3:
                trial[p] = math.exp(rng.uniform(math.log(r[0]), math.log(r[1])))
            else:
                trial[p] = rng.uniform(r[0], r[1])
        out.append(trial)
    return out


def search(data: DataFrame, name: str, problem: str, trials: list[dict], folds: int = 3, parallelism: int = 4) -> DataFrame:
    """Cross-validated score of every parameter set, best first.

    Rows are held once with their fold, which is a column like any other; the fits of a fold run side by side. No model is kept, so none is fitted on all rows.
    """
    est = MODELS[name][1](multiclass=problem == "multiclass")
    metric, make = EVALUATORS[problem]
    held = data.withColumn("_fold", fold_of(folds).cast("int")).persist()
    try:
        rows = with_weights(held) if problem in CLASSES else held
        sizes = {r["_fold"]: r["count"] for r in rows.groupBy("_fold").count().collect()}
        for f in range(folds):
            if not sum(n for k, n in sizes.items() if k != f):
                raise ValueError(f"The training data at fold {f} is empty.")
            if not sizes.get(f):
                raise ValueError(f"The validation data at fold {f} is empty.")

        def one(trial: dict, f: int) -> float:
            model = est.fit(rows.where(F.col("_fold") != f), {est.getParam(k): v for k, v in trial.items()})
            return make().evaluate(model.transform(rows.where(F.col("_fold") == f)))

        with ThreadPoolExecutor(parallelism) as pool:
            scores_ = [list(pool.map(lambda t: one(t, f), trials)) for f in range(folds)]  # noqa: B023
    finally:
        held.unpersist()
    means = [sum(s) / folds for s in zip(*scores_)]
    table = [(i, str(sorted((k, round(v, 5)) for k, v in t.items())), metric, round(float(s), 4)) for i, (t, s) in enumerate(zip(trials, means))]
    return data.sparkSession.createDataFrame(table, "trial int, params string, metric string, score double").orderBy(F.desc("score"), "trial")


def grid_trials(**values) -> list[dict]:
    import itertools

    return [dict(zip(values, combo)) for combo in itertools.product(*values.values())]


def halving(data: DataFrame, name: str, problem: str, trials: list[dict], factor: int = 3, folds: int = 2) -> DataFrame:
    """Successive halving: all settings on a small hashed share, the best third on a share three times as large."""

    rungs, alive, log = 1, list(enumerate(trials)), []
    while factor ** rungs < len(trials):
        rungs += 1
    for r in range(rungs + 1):
        share = max(50, int(1000 / factor ** (rungs - r)))
        part = data.where(hash_bucket(F.concat(F.col("key").cast("string"), F.lit("h")), 1000) < share)
        scores = search(part, name, problem, [t for _, t in alive], folds).collect()
        by = {alive[s["trial"]][0]: s["score"] for s in scores}
        log += [(r, share, i, by[i]) for i, _ in alive]
        keep = sorted(by, key=lambda i: (-by[i], i))[:max(1, len(alive) // factor)]
        alive = [(i, t) for i, t in alive if i in keep]
    return data.sparkSession.createDataFrame(log, "rung int, per_mille int, trial int, score double")


def tree_pipeline(categories: list[str], numbers: list[str]) -> Pipeline:
    """Ordinal codes and untouched numbers; nulls pass through as NaN."""
    index = StringIndexer(inputCols=categories, outputCols=[f"{c}_code" for c in categories], stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, VectorAssembler(inputCols=[f"{c}_code" for c in categories] + numbers, outputCol="features", handleInvalid="keep")])


def linear_pipeline(categories: list[str], numbers: list[str]) -> Pipeline:
    from pyspark.ml.feature import Imputer

    index = StringIndexer(inputCols=categories, outputCols=[f"{c}_code" for c in categories], stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_code" for c in categories], outputCols=[f"{c}_hot" for c in categories])
    fill = Imputer(inputCols=numbers, outputCols=[f"{c}_filled" for c in numbers], strategy="median")
    nums = VectorAssembler(inputCols=[f"{c}_filled" for c in numbers], outputCol="_nums")
    scale = StandardScaler(inputCol="_nums", outputCol="_scaled", withMean=True)
    return Pipeline(stages=[index, hot, fill, nums, scale, VectorAssembler(inputCols=[f"{c}_hot" for c in categories] + ["_scaled"], outputCol="features")])


def stored(model: PipelineModel) -> PipelineModel:
    """Write a fitted pipeline and load it again, as a later scoring job would."""
    from pyspark.sql import SparkSession

    path = new_scratch_path(SparkSession.getActiveSession(), "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def batch_score(model: PipelineModel, df: DataFrame, day: Column, path: str, keep: list[str]) -> DataFrame:
    """Score a table into one folder per day."""
    out = model.transform(df).select(*keep, "prediction", day.alias("day"))
    out.write.mode("overwrite").partitionBy("day").parquet(path)
    return df.sparkSession.read.parquet(path)


def balanced_bags(data: DataFrame, bags: int = 100, judged: DataFrame | None = None, threads: int = 4) -> DataFrame:
    """(key, label, score): trees on balanced bags of `data`, their votes on `judged` (other rows; data itself where not given) averaged in one pass."""
    rows = data.persist()
    try:
        one = lambda b: DecisionTreeClassifier(maxDepth=5, seed=SEED, predictionCol=f"_p{b}", probabilityCol=f"_v{b}", rawPredictionCol=f"_r{b}").fit(undersample(rows, "key", "label", 1.0, b))
        with ThreadPoolExecutor(threads) as pool:
            trees = list(pool.map(one, range(bags)))
    finally:
        rows.unpersist()
    votes = data if judged is None else judged
    total = F.lit(0.0)
    for b, tree in enumerate(trees):
        votes = tree.transform(votes).drop(f"_p{b}", f"_r{b}")
        total = total + vector_to_array(f"_v{b}")[1]
    return votes.select("key", "label", (total / bags).alias("score"))


def _scaled(df: DataFrame, features: list[str], centre: bool = True) -> DataFrame:
    d = df.fillna(0, features)
    v = VectorAssembler(inputCols=features, outputCol="_raw").transform(d)
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=centre).fit(v).transform(v).drop("_raw")


def cluster_kmeans(df: DataFrame, features: list[str], k: int) -> DataFrame:
    d = _scaled(df, features)
    return KMeans(k=k, seed=SEED, maxIter=20).fit(d).transform(d).withColumnRenamed("prediction", "cluster")


def choose_k(df: DataFrame, features: list[str], low: int = 2, high: int = 8):
    """k with the largest (cost of first - cost of k) / (position + 1), and the costs."""
    d = _scaled(df, features).persist()
    costs = [KMeans(k=k, seed=SEED, maxIter=20).fit(d).summary.trainingCost for k in range(low, high + 1)]
    d.unpersist()
    gains = [(costs[0] - c) / (i + 1) for i, c in enumerate(costs)]
    best = low + max(range(len(gains)), key=lambda i: gains[i])
    return best, df.sparkSession.createDataFrame([(low + i, round(c, 3), low + i == best) for i, c in enumerate(costs)], "k int, cost double, chosen boolean")


def silhouette(clustered: DataFrame) -> DataFrame:
    ev = ClusteringEvaluator(predictionCol="cluster", featuresCol="features")
    score = round(float(ev.evaluate(clustered)), 4)
    return clustered.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(score))


def bisecting(df: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    d = _scaled(df, features, centre=False)  # the first split perturbs the centre by its norm, so it must not be 0
    return BisectingKMeans(k=k, seed=SEED).fit(d).transform(d).withColumnRenamed("prediction", "cluster")


def dbscan(df: DataFrame, key: str, coords: list[str], eps: float, min_samples: int) -> DataFrame:
    """Density clusters in up to three dimensions; noise has cluster null.

    Points are grouped by the exact coordinate first. Points of one small cell (side eps / sqrt(d))
    are all neighbours, so cells with enough points are dense without looking at any pair, and only
    one link per pair of neighbouring dense cells is needed. Distances are compared point by point
    only around sparse cells.
    """
    from sparkloom.operators.graph import components

    dims = len(coords)
    side = eps / dims ** 0.5
    reach = 2 if dims > 1 else 1
    cell = F.concat_ws(",", *[F.floor(F.col(c) / F.lit(side)).cast("string") for c in coords])
    pts = df.groupBy(*coords).agg(F.count("*").alias("n")).withColumn("pid", F.xxhash64(*coords)).withColumns(
        {f"_g{i}": F.floor(F.col(c) / F.lit(side)).cast("bigint") for i, c in enumerate(coords)}).withColumn("cell", cell)
    pts = cut_lineage(pts)
    sizes = pts.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    pts = pts.join(sizes, "cell").withColumn("dense", F.col("cell_n") >= min_samples)
    offsets = F.array(*[F.struct(*[F.lit(o[i]).alias(f"o{i}") for i in range(dims)]) for o in _offsets(dims, reach)])
    asks = pts.select("pid", "cell", "dense", *[F.col(c).alias(f"_q{i}") for i, c in enumerate(coords)], *[f"_g{i}" for i in range(dims)], F.explode(offsets).alias("_o"))
    asks = asks.select("pid", F.col("cell").alias("_qc"), F.col("dense").alias("_qd"), *[f"_q{i}" for i in range(dims)], *[(F.col(f"_g{i}") + F.col(f"_o.o{i}")).alias(f"_g{i}") for i in range(dims)])
    cells = [f"_g{i}" for i in range(dims)]
    dist2 = sum(((F.col(c) - F.col(f"_q{i}")) ** 2 for i, c in enumerate(coords)), F.lit(0.0))
    other = pts.select(F.col("pid").alias("oid"), "n", "cell", F.col("dense").alias("_od"), *coords, *cells)
    close = asks.join(other, cells).where(dist2 <= F.lit(eps * eps))
    sparse_n = close.where(~F.col("_qd")).groupBy("pid").agg(F.sum("n").alias("near"))
    core = pts.join(sparse_n, "pid", "left").withColumn("core", F.col("dense") | (F.coalesce("near", F.lit(0)) >= min_samples)).select("pid", "cell", "core", "dense")
    core = cut_lineage(core)
    is_core = core.where("core").select("pid", "cell", "dense")
    links = close.join(is_core.select("pid"), "pid", "left_semi").join(is_core.select(F.col("pid").alias("oid")), "oid", "left_semi")
    node = lambda d, c, p: F.when(F.col(d), F.xxhash64(F.col(c), F.lit("cell"))).otherwise(F.col(p))
    ends = links.select(node("_qd", "_qc", "pid").alias("x"), node("_od", "cell", "oid").alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    nodes = is_core.select(node("dense", "cell", "pid").alias("node")).distinct()
    linked = components(ends) if not ends.isEmpty() else None
    labels = nodes.withColumn("label", F.col("node")) if linked is None else nodes.join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    core_label = is_core.withColumn("node", node("dense", "cell", "pid")).join(labels, "node").select("pid", "label")
    edge = close.join(core.where(~F.col("core")).select("pid"), "pid", "left_semi").join(core_label.select(F.col("pid").alias("oid"), "label"), "oid").groupBy("pid").agg(F.min("label").alias("label"))
    all_labels = core_label.unionByName(edge)
    return df.withColumn("pid", F.xxhash64(*coords)).join(all_labels, "pid", "left").select(key, F.col("label").alias("cluster"))


def _offsets(dims: int, reach: int):
    out = [()]
    for _ in range(dims):
        out = [o + (s,) for o in out for s in range(-reach, reach + 1)]
    return out


def interaction_gain(df: DataFrame, key: str, features: list[str], product: Column, target: str, floor: float = 0.02) -> DataFrame:
    """Score with and without an interaction, and whether it is worth keeping."""
    _, make = EVALUATORS["binary"]
    scores = []
    d = df.withColumn("_inter", product)
    for cols in (features, features + ["_inter"]):
        tr, te = split(prepare(d, key, cols, target))
        scores.append(make().evaluate(train(tr, "logistic", "binary").transform(te)))
    gain = scores[1] - scores[0]
    return df.sparkSession.createDataFrame([(round(scores[0], 4), round(scores[1], 4), round(gain, 4), gain > floor)], "base double, with_interaction double, gain double, keep boolean")


def drop_correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """Of every pair above the limit the later column goes."""
    from sparkloom.operators.explore import correlations

    gone = correlations(df, columns).where(F.abs("r") > limit).select(F.col("b").alias("column")).distinct()
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(gone.withColumn("_g", F.lit(True)), "column", "left").select("column", F.col("_g").isNull().alias("kept"))


def eliminate_features(df: DataFrame, features: list[str], target: str, keep: int) -> DataFrame:
    """Recursive elimination by forest importance, next to a univariate choice."""
    left, order = list(features), []
    d = df.withColumn("key", F.monotonically_increasing_id())
    while len(left) > keep:
        m = train(prepare(d, "key", left, target), "forest", "binary", n_estimators=10, max_depth=5)
        worst = min(range(len(left)), key=lambda i: m.featureImportances[i])
        order.append(left.pop(worst))
    sel = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="_s", selectionMode="numTopFeatures")
    sel = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(keep)
    picked = {features[i] for i in sel.fit(prepare(d, "key", features, target)).selectedFeatures}
    rows = [(c, c in left, c in picked, order.index(c) + 1 if c in order else None) for c in features]
    return df.sparkSession.createDataFrame(rows, "column string, by_elimination boolean, univariate boolean, dropped_at int")


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    import math

    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _isolation_tree(rows, rng, cap: int) -> tuple[list[int], list[float], list[int], list[int]]:
    """(feature or -1, cut or path length, left, right) per node."""
    import numpy as np

    feature, value, left, right = [], [], [], []

    def grow(part, depth):
        at = len(feature)
        for column in (feature, value, left, right):
            column.append(-1)
        spread = np.fmax.reduce(part) > np.fmin.reduce(part) if len(part) > 1 else np.zeros(part.shape[1], dtype=bool)
        if depth >= cap or not spread.any():
            value[at] = depth + _average_path(len(part))
            return at
        f = rng.choice([int(i) for i in np.flatnonzero(spread)])
        cut = rng.uniform(float(np.fmin.reduce(part[:, f])), float(np.fmax.reduce(part[:, f])))
        low = part[:, f] < cut
        feature[at], value[at] = f, cut
        left[at] = grow(part[low], depth + 1)
        right[at] = grow(part[~low], depth + 1)
        return at

    grow(rows, 0)
    return feature, value, left, right


def isolation_scores(df: DataFrame, key: str, features: list[str], trees: int = 25, sample: int = 256, seed: int = SEED) -> DataFrame:
    """Anomaly score of all rows from random split trees over a hashed sample of `sample` rows for each tree.

    What reaches the driver is about twice trees x sample rows, whatever the table's size. A null goes the way of large values.
    """
    import math

    import numpy as np

    rng = random.Random(seed)
    n = df.count()
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, 2 * sample / max(n, 1)) * (1 << 30))))
    drawn = df.select(F.explode(picked).alias("_t"), key, *[F.col(f).cast("double").alias(f) for f in features]).select("_t", F.xxhash64(F.col(key), "_t").alias("_h"), *features).collect()
    forest = []
    for t in range(trees):
        rows = sorted((r["_h"], *(float("nan") if r[f] is None else r[f] for f in features)) for r in drawn if r["_t"] == t)[:sample]
        if rows:
            forest.append([np.array(x) for x in _isolation_tree(np.array(rows)[:, 1:], rng, math.ceil(math.log2(max(sample, 2))))])
    scale = _average_path(min(sample, n)) or 1.0

    def score(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(dtype=float, na_value=float("nan"))
        total = np.zeros(len(x))
        for feature, value, left, right in forest:
            node = np.zeros(len(x), dtype=int)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] < value[at], left[at], right[at])
            total += value[node]
        return pd.Series(2.0 ** (-total / max(len(forest), 1) / scale))

    return df.select(key, F.pandas_udf(score, "double")(F.struct(*[F.col(f).cast("double").alias(f) for f in features])).alias("score"))


def calibrate(scored: DataFrame, method: str = "sigmoid", judged: DataFrame | None = None) -> DataFrame:
    """scored: key, label, score. Adds a calibrated score to `judged`, rows of the same form that the fit has not seen (scored itself where not given)."""
    assembler = VectorAssembler(inputCols=["score"], outputCol="_s")
    v, other = assembler.transform(scored), assembler.transform(scored if judged is None else judged)
    if method == "sigmoid":
        m = LogisticRegression(featuresCol="_s", labelCol="label", predictionCol="_p", probabilityCol="_pr", rawPredictionCol="_r").fit(v)
        return m.transform(other).select("key", "label", "score", vector_to_array("_pr")[1].alias("calibrated"))
    m = IsotonicRegression(featuresCol="_s", labelCol="label", predictionCol="calibrated").fit(v)
    return m.transform(other).select("key", "label", "score", "calibrated")


#: Ratings, about, that a block of the factorisation holds; a task builds a block in memory.
RATINGS = 5_000_000


def recommend(df: DataFrame, user: str, item: str, weight: str, k: int = 5, rank: int = 8) -> DataFrame:
    """The k best items of each user, of equal ratings those of smaller codes. The learner wants 32-bit ids, so users and items get dense codes by a join.

    A block of the fit holds at most about RATINGS ratings, so blocks grow in number with the table and not in size; MLlib's 10 are kept as long as they do.

    MLlib's own search rates every user with every item. Here items lie in leaves, and a user meets those whose bound reaches its k-th rating (`leaves.largest_products`).
    """
    given = df.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(weight).cast("float").alias("w")).persist()  # codes and ratings read it
    try:
        users, items = (cut_lineage(row_numbers(given.select(n).where(F.col(n).isNotNull()).distinct(), [], [n], f"_{n}")) for n in ("user", "item"))
        for n, table in (("user", users), ("item", items)):
            if table.count() >= 1 << 31:
                raise ValueError(f"more {n}s than 32-bit codes")
        d = given.join(users, "user").join(items, "item").select(F.col("_user").cast("int").alias("_user"), F.col("_item").cast("int").alias("_item"), "w")
        blocks = max(10, -(-given.count() // RATINGS))
        m = ALS(userCol="_user", itemCol="_item", ratingCol="w", implicitPrefs=True, rank=rank, maxIter=5, seed=SEED, numUserBlocks=blocks, numItemBlocks=blocks).fit(d)
    finally:
        given.unpersist()
    coded = lambda factors, name: factors.select(F.col("id").alias(name), "features")
    best = largest_products(coded(m.userFactors, "_user"), coded(m.itemFactors, "_item"), "_user", "_item", "features", rank, k)
    return best.join(users, "_user").join(items, "_item").select("user", "item", F.col("product").alias("rating"))


def topics(df: DataFrame, key: str, words: str, k: int = 5, terms: int = 5, buckets: int = 1 << 18) -> DataFrame:
    """(topic, terms): the leading terms of each topic, joined by commas.

    Words are hashed into a fixed number of buckets, so every word counts however many there are; a bucket is named after its
    most frequent word.
    """
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("string")
    hashed = df.select(key, F.transform(words, bucket).alias("_b"))
    v = CountVectorizer(inputCol="_b", outputCol="features", vocabSize=buckets).fit(hashed)
    m = LDA(k=k, maxIter=10, seed=SEED, optimizer="online").fit(v.transform(hashed))
    top = m.describeTopics(terms).select("topic", F.posexplode("termIndices").alias("place", "i"))
    index = df.sparkSession.createDataFrame(list(enumerate(v.vocabulary)), "i int, _b string")  # at most `buckets` rows
    counts = df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    names = counts.groupBy(bucket(F.col("w")).alias("_b")).agg(F.max_by("w", F.struct("n", "w")).alias("w"))
    named = top.join(index, "i").join(names, "_b")
    return named.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("x")).select("topic", F.array_join("x.w", ",").alias("terms"))


def principal_components(df: DataFrame, features: list[str], k: int) -> DataFrame:
    m = PCA(k=k, inputCol="features", outputCol="pcs").fit(_scaled(df, features))
    return df.sparkSession.createDataFrame([(i + 1, round(float(v), 5)) for i, v in enumerate(m.explainedVariance)], "component int, explained double")


def survival_model(df: DataFrame, time: str, event: str, features: list[str]) -> DataFrame:
    v = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("label", F.col(time).cast("double") + 0.5).withColumn("censor", F.col(event).cast("double")))
    m = AFTSurvivalRegression(maxIter=50).fit(v)
    return df.sparkSession.createDataFrame([(f, round(float(c), 4)) for f, c in zip(features, m.coefficients)] + [("(intercept)", round(float(m.intercept), 4)), ("(scale)", round(float(m.scale), 4))], "term string, value double")


def uplift(df: DataFrame, key: str, arm: str, outcome: str, features: list[str], folds: int = 2) -> DataFrame:
    """(key, t_uplift, x_uplift, propensity): two outcome models by arm (T-learner), and effects imputed and weighted by propensity (X-learner).

    Cross-fitted: rows are scored by models, outcome and propensity, of the other folds (a salted hash of the key).
    """
    fold = hash_bucket(F.concat(F.col(key).cast("string"), F.lit("|uplift")), folds)
    d = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("label", F.col(outcome).cast("double")).withColumn("_arm", F.col(arm).cast("double")).withColumn("_fold", fold)).persist()
    fit = lambda rows, out, label="label": GBTRegressor(maxIter=8, maxDepth=3, labelCol=label, predictionCol=out, seed=SEED).fit(rows)
    done = None
    for f in range(folds):
        rows = d.where(F.col("_fold") != f)
        arm1, arm0 = rows.where("_arm = 1"), rows.where("_arm = 0")
        m1, m0 = fit(arm1, "p1"), fit(arm0, "p0")
        t1 = fit(m0.transform(arm1).withColumn("tau", F.col("label") - F.col("p0")), "x1", "tau")
        t0 = fit(m1.transform(arm0).withColumn("tau", F.col("p1") - F.col("label")), "x0", "tau")
        chance = LogisticRegression(labelCol="_arm", predictionCol="_ap", probabilityCol="_av", rawPredictionCol="_ar").fit(rows)
        scored = d.where(F.col("_fold") == f)
        for model in (m1, m0, t1, t0, chance):
            scored = model.transform(scored)
        g = vector_to_array("_av")[1]
        part = scored.select(key, (F.col("p1") - F.col("p0")).alias("t_uplift"), (g * F.col("x0") + (1 - g) * F.col("x1")).alias("x_uplift"), g.alias("propensity"))
        done = part if done is None else done.unionByName(part)
    d.unpersist()  # the fits are done; scoring reads the rows once more
    return done


def ensemble(predictions: list[DataFrame], how: str = "average") -> DataFrame:
    """predictions: key, label, score each. Mean score or majority vote."""
    out = predictions[0].withColumnRenamed("score", "s0")
    for i, p in enumerate(predictions[1:], 1):
        out = out.join(p.select("key", F.col("score").alias(f"s{i}")), "key")
    names = [F.col(f"s{i}") for i in range(len(predictions))]
    merged = sum(names, F.lit(0.0)) / len(names) if how == "average" else (sum((F.when(s > 0.5, 1).otherwise(0) for s in names), F.lit(0)) * 2 > len(names)).cast("double")
    return out.select("key", "label", merged.alias("score"))


def scores(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("key", "label", vector_to_array("probability")[1].alias("score"))


def intermittent_forecast(series: DataFrame, key: str, at: str, value: str, alpha: float = 0.1) -> DataFrame:
    """Croston, SBA and TSB forecasts by one fold over each ordered series (bounded by its calendar)."""
    init = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), F.lit(1.0).alias("q"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("t"))

    def step(s, x):
        hit = x > 0
        first = s["z"].isNull()
        return F.struct(
            F.when(hit & first, x).when(hit, s["z"] + alpha * (x - s["z"])).otherwise(s["z"]).alias("z"),
            F.when(hit & first, s["q"]).when(hit, s["p"] + alpha * (s["q"] - s["p"])).otherwise(s["p"]).alias("p"),
            F.when(hit, 1.0).otherwise(s["q"] + 1.0).alias("q"),
            (s["b"] + alpha * (F.when(hit, 1.0).otherwise(0.0) - s["b"])).alias("b"),
            F.when(hit & s["t"].isNull(), x).when(hit, s["t"] + alpha * (x - s["t"])).otherwise(s["t"]).alias("t"))

    values = F.transform(F.sort_array(F.collect_list(F.struct(at, F.col(value).cast("double").alias("v")))), lambda r: r["v"])
    g = series.groupBy(key).agg(values.alias("v")).select(key, F.aggregate("v", init, step).alias("s"))
    rate = F.try_divide(F.col("s.z"), F.col("s.p"))
    return g.select(key, rnd(rate, 5).alias("croston"), rnd(rate * (1 - alpha / 2), 5).alias("sba"), rnd(F.col("s.b") * F.col("s.t"), 5).alias("tsb"))


def lag_forecast(series: DataFrame, key: str, at: str, value: str, horizons: list[int]) -> DataFrame:
    """Direct forecasts: one boosted model per horizon on lagged values."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(at)
    rows = []
    lags_ = (0, 1, 6)
    for h in horizons:
        d = series.select(key, *[F.lag(value, h + k).over(w).alias(f"l{k}") for k in lags_], F.col(value).cast("double").alias("label"), F.weekday(at).alias("dow"), F.year(at).alias("_y")).dropna()
        v = VectorAssembler(inputCols=[f"l{k}" for k in lags_] + ["dow"], outputCol="features").transform(d)
        last = v.agg(F.max("_y")).first()[0]
        m = GBTRegressor(maxIter=8, maxDepth=4, seed=SEED).fit(v.where(F.col("_y") < last))
        e = m.transform(v.where(F.col("_y") == last)).agg(F.avg(F.abs(F.col("label") - F.col("prediction"))), F.avg(F.abs(F.col("label") - F.col("l0")))).first()
        rows.append((h, round(e[0], 4), round(e[1], 4)))
    return series.sparkSession.createDataFrame(rows, "horizon int, mae double, naive_mae double")


def model_advice(profile: DataFrame) -> DataFrame:
    """profile: rows, n_features, categorical_share, time_indexed. First choice by size and type."""
    r, f = F.col("rows"), F.col("n_features")
    pick = F.when(r < 100, "linear_only").when(f > 500, "l1_linear").when(F.col("time_indexed"), "boosted_with_lags").when(r > 1_000_000, "boosted_only").when(
        F.col("categorical_share") > 0.3, "boosted_categorical").when(r > 100_000, "boosted_no_svm").otherwise("all_models")
    return profile.withColumn("advice", pick)


