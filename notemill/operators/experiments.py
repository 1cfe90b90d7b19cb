"""Grids of runs, cross-validation, hold-out tests, learning curves and the choice of a best run."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions.text import anchored
from notemill.operators import evaluate, models, sampling, term_tables, text_models
from notemill.operators.term_tables import TermTable
from notemill.operators.vectors import TermOptions
from notemill.scale import cut, hashed_rank

METRICS = ("f1", "precision", "recall", "acc", "auc", "spc", "npv")
# The driver holds so many vectors as long as the vocabulary for a fit, and so many numbers for all fits side by side.
FIT_VECTORS = 32
DRIVER_NUMBERS = 1 << 25


@dataclass(frozen=True)
class RunOptions:
    """One row of a grid."""

    classifier: str = "LinearSVC"
    folds: int = 5
    mode: str = "tfidf"
    terms: TermOptions = TermOptions()
    seed: int = 0
    params: Mapping[str, object] = field(default_factory=dict)

    def key(self) -> str:
        told = json.dumps([self.classifier, self.folds, self.feature_key(), self.seed, dict(self.params)], sort_keys=True)
        return hashlib.md5(told.encode()).hexdigest()

    def feature_key(self) -> str:
        return hashlib.md5(repr((self.mode, self.terms)).encode()).hexdigest()


@dataclass
class Features:
    """Documents with vectors, the fitted vocabulary, the term names and their number."""

    docs: DataFrame
    table: TermTable
    names: DataFrame
    size: int


@dataclass
class RunResult:
    predictions: DataFrame
    weights: DataFrame

    def metrics(self) -> DataFrame:
        return evaluate.fold_metrics(self.predictions)

    def summary(self) -> DataFrame:
        return evaluate.fold_summary(self.metrics())


def features_of(docs: DataFrame, mode: str, terms: TermOptions) -> Features:
    """Vectors of the documents; they are kept, and whoever asks lets go of them."""
    if mode in ("text", "bits"):
        raise models.UnsupportedOption(f"mode {mode!r} has no vectors")
    # Texts become terms once: the vocabulary and the vectors come from the same bags, which go when the vectors are there.
    bags = term_tables.held_bags(docs, terms).persist()
    try:
        table = term_tables.fit_bags(bags, mode, terms)
        size = table.size()
        vectors = table.of_bags(bags, size).persist()
        vectors.count()
    finally:
        bags.unpersist()
    names = table.terms.select(F.col("index").cast("int").alias("index"), "term")
    return Features(vectors, table, names, size)


class FeatureStore:
    """Keeps the vectors of each feature setting, so runs that share one compute it once."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self._kept: dict[str, Features] = {}
        self._folded: dict[tuple[str, int, int], DataFrame] = {}

    def get(self, options: RunOptions) -> Features:
        key = options.feature_key()
        if key not in self._kept:
            self._kept[key] = features_of(self.docs, options.mode, options.terms)
        return self._kept[key]

    def folded(self, options: RunOptions) -> DataFrame:
        """The vectors dealt into the folds of a run, once for all runs that share them; they are kept instead of the others."""
        key = options.feature_key(), options.folds, options.seed
        if key not in self._folded:
            docs = self.get(options).docs
            self._folded[key] = sampling.kfold(docs, options.folds, options.seed).persist()
            self._folded[key].count()
            docs.unpersist()
        return self._folded[key]

    def close(self) -> None:
        for kept in (*(made.docs for made in self._kept.values()), *self._folded.values()):
            kept.unpersist()
        self._kept.clear()
        self._folded.clear()


def fit(train: DataFrame, name: str, params: Mapping[str, object]):
    """Fit a classifier; what has seen one class only predicts that class."""
    # One row per class.
    seen = train.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()
    if len(seen) == 1:
        return models.OneClass(seen[0]["label"])
    if params.get("class_weight") == "balanced":
        train = models.with_weights(train)
        seen = [r for r in seen if r["label"] is not None]  # no weight fits a missing label
    # Balanced weights add up to the number of rows.
    rows = sum(r["n"] for r in seen) if params.get("C") not in (None, models.UNSET) else None
    estimator = models.make_classifier(name, params, rows)
    if name in models.BY_GRADIENT:
        # Every partition sends a gradient as long as the vocabulary in every step: one per core is enough.
        train = train.coalesce(train.sparkSession.sparkContext.defaultParallelism)
    return estimator.fit(train)


def at_once(size: int, most: int) -> int:
    """How many fits run side by side: as many as the driver holds vectors of ``size`` for, one at least."""
    return max(1, min(most, DRIVER_NUMBERS // (FIT_VECTORS * max(1, size))))


def cross_validate(features: Features, options: RunOptions, parallelism: int = 4, folded: DataFrame | None = None) -> RunResult:
    """Fit once per fold, folds side by side; predictions of all folds in one table.

    ``folded`` are the vectors dealt into these folds before; else they are dealt here and let go of.
    """
    held = sampling.kfold(features.docs, options.folds, options.seed).persist() if folded is None else folded

    def run(k: int) -> tuple[DataFrame, DataFrame]:
        model = fit(held.where(F.col("fold") != k), options.classifier, options.params)
        # Written, so that the folds can be let go of.
        predicted = cut(models.predictions(model, held.where(F.col("fold") == k), "fold"))
        return predicted, models.term_weights(model, features.names, k)

    try:
        with ThreadPoolExecutor(at_once(features.size, parallelism)) as pool:
            parts = list(pool.map(run, range(options.folds)))
    finally:
        if folded is None:
            held.unpersist()
    return RunResult(_union([p for p, _ in parts]), _union([w for _, w in parts]))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f)
    return merged


def grid(values: Mapping[str, Sequence[object]]) -> list[dict[str, object]]:
    """All combinations in order, duplicates removed. A grid is a short parameter list."""
    rows, seen = [], set()
    for combination in itertools.product(*values.values()):
        row = dict(zip(values, combination))
        key = json.dumps(row, sort_keys=True, default=str)
        if key not in seen:
            seen.add(key)
            rows.append(row)
    return rows


def grid_rows(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Combinations of array columns of each row, by exploding one after the other."""
    for name, array in values.items():
        df = df.withColumn(name, F.explode(F.array_distinct(array)))
    return df


RESULT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("run_key", T.StringType()),
        T.StructField("classifier", T.StringType()),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())),
        *[T.StructField(m, T.DoubleType()) for m in ("precision", "recall", "f1", "std", "acc", "auc", "spc", "npv")],
        T.StructField("error", T.StringType()),
    ]
)


def run_grid(
    docs: DataFrame,
    runs: Iterable[RunOptions],
    finished: DataFrame | None = None,
    parallelism: int = 2,
    record: str | None = None,
) -> DataFrame:
    """One result row per run, failures included; runs whose key is in ``finished`` are left out.

    With ``record``, a shared folder, the parts of every run are kept there: see ``write_record``.
    """
    spark = docs.sparkSession
    wanted = [(i, r) for i, r in enumerate(runs)]
    if finished is not None:
        left = remaining(spark.createDataFrame([(r.key(),) for _, r in wanted], "run_key string"), finished)
        open_keys = {row["run_key"] for row in left.collect()}
        wanted = [(i, r) for i, r in wanted if r.key() in open_keys]
    store = FeatureStore(docs)
    size = 1
    for _, r in wanted:
        if r.classifier in text_models.TEXT_CLASSIFIERS:
            continue
        try:
            size = max(size, store.get(r).size)
        except models.UnsupportedOption:
            continue
        store.folded(r)
    fits = at_once(size, 4 * parallelism)
    parallelism = min(parallelism, fits)

    def one(item: tuple[int, RunOptions]) -> dict:
        seq, r = item
        row = {
            "seq": seq,
            "run_key": r.key(),
            "classifier": r.classifier,
            "options": {k: str(v) for k, v in {**vars(r.terms), **r.params, "mode": r.mode}.items()},
        }
        predictions = weights = None
        try:
            if r.classifier in text_models.TEXT_CLASSIFIERS:
                predictions = text_models.cross_validate(docs, r.classifier, r.params, r.folds, r.seed).persist()
            else:
                result = cross_validate(store.get(r), r, fits // parallelism, store.folded(r))
                predictions, weights = result.predictions.persist(), result.weights
            if record is not None:
                write_record(record, seq, predictions, r.folds, weights)
            summary = evaluate.fold_summary(evaluate.fold_metrics(predictions)).first()
            area = evaluate.auc(predictions).agg(F.avg("auc")).first()[0]
            row.update({m: summary[m] for m in ("precision", "recall", "f1", "std", "acc", "spc", "npv")}, auc=area)
        except Exception as problem:  # a failed combination is a row, the grid goes on
            row["error"] = f"{type(problem).__name__}: {problem}"
        finally:
            if predictions is not None:
                predictions.unpersist()
        return row

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(one, wanted))
    finally:
        store.close()
    return spark.createDataFrame(rows, RESULT_SCHEMA)


RECORD_PARTS = ("counts", "curves", "misses", "predictions", "weights")


def write_record(path: str, seq: int, predictions: DataFrame, folds: int, weights: DataFrame | None = None) -> None:
    """Keep the parts of a run as tables under ``path``, one folder per part and run.

    Outcome counts and curves per fold, ids of the misses, predictions with one column per fold, and
    term weights where the model has any. A run that is repeated replaces its own parts.
    """
    parts = {
        "counts": evaluate.fold_metrics(predictions),
        "curves": evaluate.roc_points(predictions),
        "misses": predictions.where(F.col("pred") != F.col("label")).select("doc_id").distinct(),
        "predictions": evaluate.prediction_pivot(predictions, folds),
    }
    if weights is not None:
        parts["weights"] = evaluate.weight_pivot(weights, folds)
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}/seq={seq}")


def recorded(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of all recorded runs, with the run's ``seq``."""
    if part not in RECORD_PARTS:
        raise ValueError(f"unknown part {part!r}; known: {RECORD_PARTS}")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/{part}")


def export_best(spark: SparkSession, runs: DataFrame, path: str, metric: str = "f1") -> dict[str, DataFrame]:
    """Every recorded part of the best run; a part its classifier does not have is left out."""
    best = best_run(runs, metric).first()
    if best is None:
        return {}
    found = {}
    for part in RECORD_PARTS:
        if part == "weights" and best["classifier"] in text_models.TEXT_CLASSIFIERS:
            continue
        found[part] = recorded(spark, path, part).where(F.col("seq") == best["seq"])
    return found


def remaining(wanted: DataFrame, finished: DataFrame, key: str = "run_key") -> DataFrame:
    return wanted.join(finished.select(key), key, "left_anti")


def matching_runs(runs: DataFrame, criteria: Mapping[str, str | None]) -> DataFrame:
    """Runs that meet every criterion.

    A metric criterion compares when it starts with ``<=``, ``>=`` or ``==``. An option criterion is
    a pattern for the start of the option's value. Keys found in neither are ignored, and so are
    keys without a value and runs without an F1.
    """
    keep = F.col("f1").isNotNull()
    for key, wanted in criteria.items():
        if wanted is None:
            continue
        if key in METRICS and key in runs.columns and wanted[:2] in ("<=", ">=", "=="):
            try:
                limit = float(wanted[2:])
            except ValueError:
                continue
            metric = F.col(key)
            test = {"<=": metric <= limit, ">=": metric >= limit, "==": metric == limit}[wanted[:2]]
            keep = keep & F.coalesce(test, F.lit(True))
        option = F.get(F.filter(F.map_entries("options"), lambda e: e["key"] == key), F.lit(0))["value"]
        known = F.map_contains_key("options", key)
        keep = keep & (~known | F.coalesce(option.rlike(anchored(wanted)), F.lit(False)))
    return runs.where(keep)


def best_run(runs: DataFrame, metric: str = "f1") -> DataFrame:
    """The run with the highest positive metric, the first of equals."""
    if metric not in METRICS:
        metric = "f1"
    return runs.where(F.col(metric) > 0).orderBy(F.desc(metric), "seq").limit(1)


def run_at(runs: DataFrame, index: int) -> DataFrame:
    if index < 0 or index >= runs.count():
        raise IndexError(f"no run {index}")
    return runs.where(F.col("seq") == index)


def grid_search(docs: DataFrame, classifier: str, values: Mapping[str, Sequence], score: str, folds: int = 10,
                parallelism: int = 4, seed: int = 0):
    """Built-in cross-validated search over estimator parameters by precision or recall per class."""
    estimator = models.FAMILIES[classifier].make()
    builder = ParamGridBuilder()
    for name, choices in values.items():
        builder.addGrid(estimator.getParam(name), list(choices))
    evaluator = MacroEvaluator(score)
    folded = sampling.kfold(docs, folds, seed)
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return search.fit(folded)


class MacroEvaluator(MulticlassClassificationEvaluator):
    """Precision or recall averaged over both classes."""

    def __init__(self, score: str = "precision_macro"):
        super().__init__()
        if score not in ("precision_macro", "recall_macro"):
            raise models.UnsupportedOption(f"unknown score {score!r}")
        self._by_label = "precisionByLabel" if score == "precision_macro" else "recallByLabel"

    def _evaluate(self, dataset: DataFrame) -> float:
        values = []
        for label in (0.0, 1.0):
            one = MulticlassClassificationEvaluator(metricName=self._by_label, metricLabel=label)
            values.append(one.evaluate(dataset))
        return sum(values) / len(values)

    def isLargerBetter(self) -> bool:
        return True


def holdout_eval(features: Features, options: RunOptions, share: float = 0.2) -> DataFrame:
    """Predictions for one held-out share."""
    split = sampling.holdout(features.docs, share, options.seed).persist()
    try:
        model = fit(split.where("is_test = 0"), options.classifier, options.params)
        return cut(models.predictions(model, split.where("is_test = 1")))
    finally:
        split.unpersist()


def sweep(features: Features, options: Sequence[RunOptions], share: float = 0.2) -> DataFrame:
    """Scores of several classifiers on one hold-out split; -1 and the message for failures."""
    rows = []
    for o in options:
        try:
            r = evaluate.fold_metrics(holdout_eval(features, o, share), []).first()
            rows.append((o.classifier, r["precision"], r["recall"], r["f1"], None))
        except Exception as problem:
            rows.append((o.classifier, -1.0, -1.0, -1.0, f"{type(problem).__name__}: {problem}"))
    schema = "classifier string, precision double, recall double, f1 double, error string"
    return features.docs.sparkSession.createDataFrame(rows, schema)


def evaluate_on(train: DataFrame, test: DataFrame, options: RunOptions) -> tuple[DataFrame, DataFrame]:
    """Refit a run on all training documents and predict a separate test set with the same stages."""
    features = features_of(train, options.mode, options.terms)
    try:
        model = fit(features.docs, options.classifier, options.params)
    finally:
        features.docs.unpersist()
    vectors = features.table.vectors(test, features.size)
    return models.predictions(model, vectors), models.term_weights(model, features.names, 0)


def learning_curve(
    train: DataFrame, test: DataFrame, options: RunOptions, least: int, most: int, step: int, parallelism: int = 4
) -> DataFrame:
    """(fraction, f1) on the test set for growing stratified shares of the training set, side by side."""
    features = features_of(train, options.mode, options.terms)
    # The shares grow along one order, which is drawn once.
    ranked = hashed_rank(features.docs, "doc_id", options.seed, ["label"], "_rank", "_n").persist()
    tested = features.table.vectors(test, features.size).persist()
    try:

        def point(share: float) -> tuple[float, float]:
            part = ranked.where(F.col("_rank") <= F.floor(F.col("_n") * share))
            model = fit(part, options.classifier, options.params)
            scored = evaluate.fold_metrics(models.predictions(model, tested), []).first()
            return share, scored["f1"]

        with ThreadPoolExecutor(at_once(features.size, parallelism)) as pool:
            points = list(pool.map(point, sampling.learning_sizes(least, most, step)))
    finally:
        features.docs.unpersist()
        ranked.unpersist()
        tested.unpersist()
    return train.sparkSession.createDataFrame(points, "fraction double, f1 double")


def options_from(text_options: str) -> dict[str, str | None]:
    """Criteria ``a=1&b=2`` as a mapping."""
    pairs = [item.split("=") for item in text_options.split("&")]
    return {p[0]: p[1] if len(p) == 2 else None for p in pairs}


def stored_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
