"""I: estimators, model comparison, grid/random search, production training.

Everything trains with Spark MLlib (distributed tree histograms, L-BFGS);
the driver only loops over a handful of estimators or parameter maps.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.features import REFERENCE_DATE
from shelfspark.operators.boosting import NO_DEPTH_LIMIT, LeafBoosted, as_matrix
from shelfspark.operators.engineer import engineer_post_launch, engineer_pre_launch
from shelfspark.operators.evaluate import classification_metrics, compare_models, metrics_from_counts
from shelfspark.operators.logistic import Problem, optima
from shelfspark.operators.prep import assemble_scaled, first_rows, ordinal_encoder, with_class_weights
from shelfspark.operators.search import maps_of, staged_search
from shelfspark.plans.reuse import written
from shelfspark.session import spread
from shelfspark.schemas import CATEGORICAL, POST_CATEGORICAL, POST_NUMERIC, PRE_NUMERIC

SEED = 42
MAX_TREE_DEPTH = 30  # Spark's limit stands in for "no depth limit"

# Production booster settings of the two models.
PRE_LAUNCH_PARAMS = {"rounds": 300, "depth": 6, "rate": 0.1, "leaves": 31}
POST_LAUNCH_PARAMS = {"rounds": 100, "depth": 8, "rate": 0.05, "leaves": 50}

# The reference's search spaces, in Spark parameter names.
# Boosted trees: 81 maps.
BOOSTED_GRID = {"rounds": [100, 200, 300], "depth": [4, 6, 8], "rate": [0.01, 0.05, 0.1], "leaves": [20, 31, 50]}
# Logistic regression: inverse regularisation strengths x solvers (8 maps). The solvers differ in
# their objective: the second one also penalises the intercept.
LOGISTIC_C = [0.01, 0.1, 1, 10]
LOGISTIC_SOLVERS = ["lbfgs", "liblinear"]
# Random forest: trees x depth (None -> Spark's maximum) x minimum split size (-> leaf size).
FOREST_GRID = {"numTrees": [100, 200], "maxDepth": [6, 10, MAX_TREE_DEPTH], "minInstancesPerNode": [1, 2]}
SEARCH_FOLDS = 5
# Iteration cap and convergence tolerance of the reference's logistic regression.
LOGISTIC_MAX_ITER = 100
LOGISTIC_SEARCH_MAX_ITER = 1000  # in its parameter search
LOGISTIC_TOL = 1e-4
RANDOM_SEARCH_MAPS = 20

VALUES = "values"  # column of ``with_values``


def linear_regression(label: str = "rating", **params) -> LinearRegression:
    """Ordinary least squares on the scaled features."""
    return LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, **params)


def logistic(C: float = 1.0, n_weight: float = 1.0, weight_col: str | None = "weight",
             max_iter: int = LOGISTIC_MAX_ITER) -> LogisticRegression:
    """L2 logistic regression; ``regParam = 1 / (C * sum of weights)`` makes the
    objective the same as C-parameterised logistic regression (features are
    already standardised, so Spark's own standardisation is off)."""
    kw = {"weightCol": weight_col} if weight_col else {}
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (C * n_weight),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                              tol=LOGISTIC_TOL, **kw)


def fixed_logistic(spark: SparkSession, weights: Sequence[float], intercept: float = 0.0) -> LogisticRegressionModel:
    """A logistic model of given weights over ``features``, for rules set by hand."""
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"fixed_{uuid.uuid4().hex}", _py2java(spark.sparkContext, Vectors.dense([float(w) for w in weights])), float(intercept))
    return LogisticRegressionModel(java)


def with_constant(df: DataFrame, out: str = "features1") -> DataFrame:
    """``features`` and a constant 1 as one more feature, whose weight is the intercept."""
    return df.withColumn(out, array_to_vector(F.concat(vector_to_array("features"), F.array(F.lit(1.0)))))


def mirrored(df: DataFrame) -> DataFrame:
    """``with_constant`` rows to learn from: every other row as its mirror image in ``features1``, ``label1``.

    Without a free intercept the loss of (x, y) is that of (-x, 1 - y), so the optimum is the same.
    Spark gives a column without variance no weight; mirrored, the constant varies.
    """
    turn = (F.monotonically_increasing_id() + F.spark_partition_id()) % 2 == 1
    x = vector_to_array("features1")
    return (df.withColumn("__turn", turn).withColumn("features1", array_to_vector(F.when(F.col("__turn"), F.transform(x, lambda v: -v)).otherwise(x)))
            .withColumn("label1", F.when(F.col("__turn"), 1 - F.col("label")).otherwise(F.col("label"))).drop("__turn"))


def logistic_penalised(C: float = 1.0, n_weight: float = 1.0, weight_col: str | None = "weight",
                       max_iter: int = LOGISTIC_MAX_ITER) -> LogisticRegression:
    """I2, second solver's objective: the intercept is penalised like every weight. Fit on
    ``mirrored(with_constant(rows))``; the model scores ``with_constant`` rows."""
    est = logistic(C, n_weight, weight_col, max_iter)
    return est.setFitIntercept(False).setFeaturesCol("features1").setLabelCol("label1")


def forest(trees: int = 100, depth: int | None = None, min_split: int = 2,
           weight_col: str | None = "weight") -> RandomForestClassifier:
    """Random forest; no depth limit maps to Spark's maximum; a minimum split
    size maps to a minimum leaf size of half of it (close, not equal).

    Each row's node is kept with the row and written every 10 levels, so no level ships the
    grown trees to the tasks.
    """
    kw = {"weightCol": weight_col} if weight_col else {}
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees,
                                  maxDepth=depth if depth is not None else MAX_TREE_DEPTH,
                                  minInstancesPerNode=max(1, min_split // 2), seed=SEED,
                                  cacheNodeIds=True, checkpointInterval=10, **kw)


def boosted(rounds: int = 100, depth: int | None = None, rate: float = 0.1, leaves: int = 31,
            weight_col: str | None = "weight", bounded: bool = False) -> LeafBoosted:
    """I4: gradient-boosted best-first trees with a leaf cap (no depth limit by default).

    ``bounded``: the caller has bounded the rows, so one task learns from them, however many.
    """
    return LeafBoosted(rounds=rounds, depth=depth if depth is not None else NO_DEPTH_LIMIT, rate=rate, leaves=leaves,
                       weightCol=weight_col or "", inTask=bounded)


def feature_names(cats: Sequence[str], nums: Sequence[str], suffix: str = "_code") -> list[str]:
    return [f"{c}{suffix}" for c in cats] + list(nums)


def fit_pipeline(df: DataFrame, cats: Sequence[str], nums: Sequence[str], estimator: Estimator | None,
                 population_std: bool = True, learn: Callable[[DataFrame], DataFrame] | None = None,
                 persist: bool = True) -> PipelineModel:
    """Encoder (alphabetical, unseen -> -1) -> assembler -> scaler -> estimator, as one model.

    The training rows are persisted for the duration of the fit: the encoder,
    the scaler and the estimator each read them, and the input is usually a join. Without
    ``persist`` each reads them anew: for rows that are written already.
    ``population_std`` (default) rescales by sqrt(n / (n - 1)) so features are divided by
    the population standard deviation; without it by the sample one, Spark's own.
    ``learn`` picks the rows that the estimator learns from; encoder and scaler fit on all.
    """
    owned = persist and not df.is_cached
    data = spread(df).persist(StorageLevel.MEMORY_AND_DISK) if owned else df
    try:
        enc = ordinal_encoder(data, cats) if cats else PipelineModel(stages=[])
        names = feature_names(cats, nums)
        stages = assemble_scaled(names, out="_scaled" if population_std else "features")
        if population_std:
            n = data.count()
            factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
            stages.append(ElementwiseProduct(inputCol="_scaled", outputCol="features",
                                             scalingVec=Vectors.dense([factor] * len(names))))
        rest = Pipeline(stages=stages).fit(enc.transform(data))
        prep = PipelineModel(stages=list(enc.stages) + list(rest.stages))
        if estimator is None:
            return prep
        fitted = estimator.fit(prep.transform(learn(data) if learn else data))
    finally:
        if owned:
            data.unpersist()
    return PipelineModel(stages=[*prep.stages, fitted])


def with_values(df: DataFrame, prep: PipelineModel, out: str = VALUES) -> DataFrame:
    """The features that ``prep`` (``fit_pipeline`` without an estimator) gives, as an array of doubles.

    The arithmetic is that of its stages, in plain columns: no row becomes a vector, and back, once a stage.
    """
    x: list[Column] = []
    for stage in prep.stages:
        if isinstance(stage, VectorAssembler):
            x = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in stage.getInputCols()]
        elif isinstance(stage, StandardScalerModel):  # centred and divided: see ``assemble_scaled``
            x = [(v - F.lit(float(m))) * F.lit(1.0 / float(s) if s != 0 else 0.0) for v, m, s in zip(x, stage.mean, stage.std, strict=True)]
        elif isinstance(stage, ElementwiseProduct):
            x = [v * F.lit(float(w)) for v, w in zip(x, stage.getScalingVec(), strict=True)]
        else:
            df = stage.transform(df)
    return df.withColumn(out, F.array(*x))


def compare_estimators(train: DataFrame, test: DataFrame, named: Mapping[str, Estimator],
                       cats: Sequence[str], nums: Sequence[str], keep: Sequence[str] = (),
                       learn: Callable[[DataFrame], DataFrame] | None = None, persist: bool = True) -> DataFrame:
    """Fit each estimator on ``train``; union of their test predictions with a model column.

    Encoder and scaler are fitted once; every learner reads the same vectors (of the rows
    that ``learn`` picks, if given). ``persist`` as in ``fit_pipeline``.
    """
    prep = fit_pipeline(train, cats, nums, None, persist=persist)
    wanted = ["features", F.col("label").cast("double").alias("label"), *(["weight"] if "weight" in train.columns else [])]
    vectors = prep.transform(learn(train) if learn else train).select(*wanted).persist(StorageLevel.MEMORY_AND_DISK)
    held = prep.transform(test)
    out = None
    try:
        for name, est in named.items():
            p = est.fit(vectors).transform(held).select(F.lit(name).alias("model"), *keep,
                                                        F.col("label").cast("double"), F.col("prediction"))
            out = p if out is None else out.unionByName(p)
    finally:
        vectors.unpersist()
    return out


class MacroF1Evaluator(Evaluator):
    """Macro-F1 over (label, prediction), computed as one Spark aggregate."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        m = classification_metrics(dataset, self.labelCol, self.predictionCol)
        return float(m.select("macro_f1").first()[0])

    def isLargerBetter(self) -> bool:
        return True


def param_grid(estimator: Estimator, grid: Mapping[str, Sequence]) -> list:
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def grid_search(features: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence],
                fold_col: str = "fold", parallelism: int = 2, maps: list | None = None, folds: int = 3):
    """Cross-validation over ``folds`` folds (from ``assign_folds``) scored by macro-F1."""
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps or param_grid(estimator, grid),
                        evaluator=MacroF1Evaluator(), numFolds=folds, foldCol=fold_col, parallelism=parallelism, seed=SEED)
    return cv.fit(features)


def random_search(features: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], n: int,
                  seed: int = SEED, fold_col: str = "fold", parallelism: int = 2, folds: int = 3):
    """Cross-validate ``n`` parameter maps drawn (seeded) from the full grid."""
    maps = param_grid(estimator, grid)
    picked = random.Random(seed).sample(maps, min(n, len(maps)))
    return grid_search(features, estimator, grid, fold_col, parallelism, maps=picked, folds=folds)


@dataclass(frozen=True)
class Searched:
    """What ``best_params`` reads of a search: the mean metric of every parameter map."""

    avgMetrics: list[float]
    maps: list

    def getEstimatorParamMaps(self) -> list:
        return self.maps


def bounded_search(features: DataFrame, estimator: Estimator, maps: list, train_rows: int, key: str,
                   fold_col: str = "fold", parallelism: int = 4, folds: int = SEARCH_FOLDS,
                   prepare: Callable[[DataFrame], DataFrame] | None = None, reread: bool = False,
                   encode: Callable[[DataFrame], DataFrame] | None = None) -> Searched:
    """I6 on tables of any size: in each fold the maps learn from about ``train_rows`` rows of the
    other folds, and every row of the fold is scored.

    One sample serves all folds, the first rows in hash order: folds are even in that order, so
    a fold's share of it is left out of the fold's learning rows. ``reread`` as in ``first_rows``. ``encode`` adds the
    features where ``features`` are rows without, so the sample is picked before its rows are encoded.

    Metrics are one distributed macro-F1 aggregate over all rows of all folds and maps.
    """
    spark = features.sparkSession
    learn, parts = [], []
    sample = first_rows(features, -(-train_rows * folds // max(folds - 1, 1)), key, reread=reread).repartition(4)
    if encode:
        sample, features = encode(sample), encode(features)
    sample = written(prepare(sample) if prepare else sample)
    for f in range(folds):
        learn.append(sample.where(F.col(fold_col) != f).persist(StorageLevel.MEMORY_AND_DISK))
    try:
        jobs = [(f, i) for f in range(folds) for i in range(len(maps))]
        fit = inheritable_thread_target(spark)(lambda job: estimator.fit(learn[job[0]], maps[job[1]]))
        with ThreadPool(min(parallelism, len(jobs))) as pool:
            models = dict(zip(jobs, pool.map(fit, jobs, chunksize=1), strict=True))
    finally:
        for rows in learn:
            rows.unpersist()
    if all(isinstance(m, LogisticRegressionModel) and m.numClasses == 2 for m in models.values()):
        metric = {f"{r['fold']}:{r['map']}": r["macro_f1"] for r in metrics_from_counts(
            linear_counts(features, [[models[f, i] for i in range(len(maps))] for f in range(folds)], fold_col), ["fold", "map"]).collect()}
        return _searched(metric, maps, folds)
    for f in range(folds):
        held = features.where(F.col(fold_col) == f).select(*[c for c in ("features", "features1") if c in features.columns], "label")
        for i in range(len(maps)):
            model = models[f, i].copy({p: "" for p in (models[f, i].rawPredictionCol, models[f, i].probabilityCol)})
            held = model.setPredictionCol(f"_p{i}").transform(held)
        tried = F.array(*[F.struct(F.lit(f"{f}:{i}").alias("model"), F.col(f"_p{i}").alias("prediction")) for i in range(len(maps))])
        parts.append(held.select("label", F.inline(tried)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    metric = {r["model"]: r["macro_f1"] for r in compare_models(scored).collect()}
    return _searched(metric, maps, folds)


def _searched(metric: Mapping[str, float], maps: list, folds: int) -> Searched:
    # a fold without rows has no metric
    of_map = [[m for f in range(folds) if (m := metric.get(f"{f}:{i}")) is not None] for i in range(len(maps))]
    return Searched([sum(ms) / len(ms) for ms in of_map], maps)


def linear_counts(features: DataFrame, models: Sequence[Sequence[LogisticRegressionModel]], fold_col: str = "fold") -> DataFrame:
    """(fold, map, tp, fp, fn, tn) of every fold's models on the fold's labelled rows, in one pass.

    ``models[fold][map]`` score ``features``, or ``features1`` (``with_constant``), whose last weight is
    the intercept. A column of ``with_values`` is read in place of the same vectors.
    """
    slopes, shifts = [], []
    for of_fold in models:
        w = [m.coefficients.toArray() for m in of_fold]
        last = [m.getFeaturesCol() == "features1" for m in of_fold]
        slopes.append(np.array([x[:-1] if one else x for x, one in zip(w, last)]).T)
        shifts.append(np.array([m.intercept + (x[-1] if one else 0.0) for m, x, one in zip(of_fold, w, last)]))
    x = F.col(VALUES) if VALUES in features.columns else vector_to_array("features")
    rows = features.select(x.alias("x"), (F.col("label") == 1).alias("y"), F.col(fold_col).cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(slopes), 4, slopes[0].shape[1]), np.int64)
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column("x"), len(slopes[0]))
                y, fold = b.column("y").to_numpy(zero_copy_only=False).astype(bool), b.column("fold").to_numpy()
                for f, (slope, shift) in enumerate(zip(slopes, shifts)):
                    mine = fold == f
                    p = 1 / (1 + np.exp(-np.clip(x[mine] @ slope + shift, -700, 700))) > 0.5
                    of = y[mine][:, None]
                    cells[f] += [(of & p).sum(0), (~of & p).sum(0), (of & ~p).sum(0), (~of & ~p).sum(0)]
        f, i = np.nonzero(cells.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (f, i, *cells[f, :, i].T)], ["fold", "map", "tp", "fp", "fn", "tn"])

    kept = rows.where(F.col("y").isNotNull() & F.col("fold").between(0, len(models) - 1))
    counts = kept.mapInArrow(count, "fold bigint, map bigint, tp bigint, fp bigint, fn bigint, tn bigint")
    return counts.groupBy("fold", "map").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def best_params(cv_model, grid: Mapping[str, Sequence]) -> DataFrame:
    """I8: (param, tried, best, mean cross-validated macro-F1 of the best map)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    metrics = list(cv_model.avgMetrics)
    maps = cv_model.getEstimatorParamMaps()
    best = maps[max(range(len(metrics)), key=lambda i: metrics[i])]
    rows = []
    for name, values in grid.items():
        chosen = [v for p, v in best.items() if p.name == name]
        rows.append((name, ", ".join(str(v) for v in values), str(chosen[0]) if chosen else None,
                     float(max(metrics))))
    return spark.createDataFrame(rows, "param string, tried string, best string, cv_macro_f1 double")


def _train(features: DataFrame, cats, nums, params, learn, persist) -> PipelineModel:
    weighted = with_class_weights(features, "label")
    return fit_pipeline(weighted, cats, nums, boosted(**params, bounded=learn is not None), learn=learn, persist=persist and learn is None)


def train_pre_launch(catalog: DataFrame, ref_date=REFERENCE_DATE, params=PRE_LAUNCH_PARAMS, learn=None, persist: bool = True) -> PipelineModel:
    """Pre-launch features -> encode -> scale -> balanced boosted trees, learned from all rows. ``learn`` may
    pick a bounded number of rows for the trees (``fit_pipeline``); one task then grows them. ``persist`` as there."""
    return _train(engineer_pre_launch(catalog, ref_date), CATEGORICAL, PRE_NUMERIC, params, learn, persist)


def train_post_launch(catalog: DataFrame, ref_date=REFERENCE_DATE, params=POST_LAUNCH_PARAMS, learn=None, persist: bool = True) -> PipelineModel:
    """Post-launch features -> encode -> scale -> balanced boosted trees; ``learn`` and ``persist`` as there."""
    return _train(engineer_post_launch(catalog, ref_date), POST_CATEGORICAL, POST_NUMERIC, params, learn, persist)


def production_training(catalog: DataFrame, model_dir: str, runs_path: str, experiment: str = "catalogue_models",
                        ref_date=REFERENCE_DATE, pre_params=PRE_LAUNCH_PARAMS, post_params=POST_LAUNCH_PARAMS,
                        learn=None, persist: bool = True) -> dict[str, str]:
    """I9 end to end: train both models, save them, append one run record each. ``persist=False``: the catalogue
    is written already.

    Returns the run id per model. ``latest_run`` / ``require_latest_model`` load them back.
    """
    from shelfspark.sources.store import log_run, new_run_id, save_model
    spark = catalog.sparkSession
    runs = {}
    for name, train, params in (("pre_launch_model", train_pre_launch, pre_params),
                                ("post_launch_model", train_post_launch, post_params)):
        model = train(catalog, ref_date, params, learn, persist)
        run_id = new_run_id()  # each run keeps its own model files
        path = save_model(model, f"{model_dir.rstrip('/')}/{name}/{run_id}")
        runs[name] = log_run(spark, runs_path, experiment, name, params, {}, path, run_id)
    return runs


def logistic_grid(n_weight: float, cs=LOGISTIC_C) -> dict:
    """The C grid as Spark ``regParam`` values (regParam = 1 / (C * sum of weights))."""
    return {"regParam": [1.0 / (c * n_weight) for c in cs]}


def logistic_maps(est: LogisticRegression, n_weight: float, cs=LOGISTIC_C, solvers=LOGISTIC_SOLVERS) -> list[tuple[dict, dict]]:
    """(C and solver, parameter map) of the whole grid. Learning rows are ``mirrored``."""
    return [({"C": c, "solver": s}, {est.regParam: 1.0 / (c * n_weight), est.fitIntercept: s == "lbfgs",
                                     est.featuresCol: "features" if s == "lbfgs" else "features1",
                                     est.labelCol: "label" if s == "lbfgs" else "label1"}) for c in cs for s in solvers]


def logistic_search(features: DataFrame, train_rows: int | None = None, key: str = "product_id", fold_col: str = "fold", parallelism: int = 4,
                    folds: int = SEARCH_FOLDS, reread: bool = False, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The 8 maps over all folds: (C, solver, cv_macro_f1, rank). Each fit learns from all rows of the other
    folds (``operators.logistic``); with ``train_rows`` each is bounded as in ``bounded_search``."""
    n = float(features.agg(F.sum("weight")).first()[0])
    est = logistic(1.0, 1.0, max_iter=LOGISTIC_SEARCH_MAX_ITER)
    named = logistic_maps(est, n)
    maps = [m for _, m in named]
    if train_rows:
        found = bounded_search(features, est, maps, train_rows, key, fold_col, parallelism, folds, mirrored, reread,
                               lambda rows: with_constant(encode(rows) if encode else rows))
    else:
        found = _whole_logistic_search(encode(features) if encode else features, named, n, fold_col, folds)
    order = sorted(range(len(named)), key=lambda i: (-found.avgMetrics[i], i))
    rows = [(float(named[i][0]["C"]), named[i][0]["solver"], found.avgMetrics[i], r) for r, i in enumerate(order, 1)]
    return features.sparkSession.createDataFrame(rows, "C double, solver string, cv_macro_f1 double, rank int")


def _whole_logistic_search(rows: DataFrame, named: Sequence[tuple[dict, dict]], n: float, fold_col: str, folds: int) -> Searched:
    spark, k = rows.sparkSession, len(named)
    rows = rows.withColumn(VALUES, F.col(VALUES) if VALUES in rows.columns else vector_to_array("features")).withColumn("fold", F.col(fold_col))
    width = len(rows.select(VALUES).first()[0])
    problems = [Problem(f, 1.0 / (m["C"] * n), m["solver"] != "lbfgs") for f in range(folds) for m, _ in named]
    models = [fixed_logistic(spark, w[:-1], w[-1]) for w in optima(rows, problems, width, LOGISTIC_SEARCH_MAX_ITER)]
    counts = linear_counts(rows, [models[f * k:(f + 1) * k] for f in range(folds)])
    metric = {f"{r['fold']}:{r['map']}": r["macro_f1"] for r in metrics_from_counts(counts, ["fold", "map"]).collect()}
    return _searched(metric, [m for _, m in named], folds)


def tune(features: DataFrame, kind: str, fold_col: str = "fold", parallelism: int = 4,
         random_maps: int | None = None, seed: int = SEED, folds: int = SEARCH_FOLDS,
         train_rows: int | None = None, key: str = "product_id"):
    """I6/I7 with the reference's search spaces: ``kind`` is 'boosted', 'forest' or
    'logistic'; ``random_maps`` draws that many maps (randomised search) instead of
    the full grid. ``features`` has features, label, weight and fold columns. With
    ``train_rows`` (and a ``key`` column) each fit is bounded as in ``bounded_search``.
    Boosted searches give the ranked maps as a table
    (``operators.search.staged_search``; ``best_of`` names the best)."""
    if kind == "boosted":
        maps = maps_of(BOOSTED_GRID)
        if random_maps:
            maps = random.Random(seed).sample(maps, min(random_maps, len(maps)))
        rows = features if fold_col == "fold" else features.withColumn("fold", F.col(fold_col))
        return staged_search(rows, maps, train_rows, folds, key), BOOSTED_GRID
    if kind == "forest":
        est, grid = forest(), FOREST_GRID
    elif kind == "logistic":
        n = float(features.agg(F.sum("weight")).first()[0])
        est, grid = logistic(1.0, 1.0, max_iter=LOGISTIC_SEARCH_MAX_ITER), logistic_grid(n)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    if train_rows:
        maps = param_grid(est, grid)
        if random_maps:
            maps = random.Random(seed).sample(maps, min(random_maps, len(maps)))
        return bounded_search(features, est, maps, train_rows, key, fold_col, parallelism, folds), grid
    if random_maps:
        return random_search(features, est, grid, random_maps, seed, fold_col, parallelism, folds), grid
    return grid_search(features, est, grid, fold_col, parallelism, folds=folds), grid
