"""Training of learned routers: text features, a grid by grouped folds, calibration, a threshold on validation rows, the choice between candidates.

A router is the mean of as many members as there are folds: each was learnt without one fold and calibrated on it. The grid
and the calibration use the same folds, so the members are those that the grid has fitted for the best parameters.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..operators.contracts import pair_accepted
from ..operators.metrics import brier, confusion, ece, postgen_auc, pr_auc, roc_auc
from ..operators.running import settled, spread
from ..operators.splits import SEED, grouped_by_prompt, make_splits
from ..operators.sweep import ALL_STRONG, POLICIES, sweep
from ..sources.views import view
from . import boosting
from .bags import KINDS, SOME_ROWS, Bag, counted, vocabularies
from .boosting import Boosted
from .routers import ENGINEERED, FEATURES, FOLDS, FORMAT, grouped_folds, platt

#: Most words and word pairs, and most character runs, that features count; least documents of either.
WORDS, CHARS, LEAST_DOCS = 20_000, 30_000, 2
#: Values of the grid: strength of the ridge as its inverse, most depth of the trees.
STRENGTHS, DEPTHS = (0.25, 1.0, 4.0), (3, None)
COMPONENTS, ROUNDS = 64, boosting.ROUNDS
#: Directions beside those kept, and rounds, of the search for the main directions.
SPARE, POWER_ROUNDS = 10, 4
#: Least training and validation rows, and least rows for a calibration in steps.
LEAST_TRAIN, LEAST_VALIDATION, LEAST_STEPS = 40, 10, 500
CANDIDATES = ("logreg_tfidf", "gbdt_svd")
#: Character runs that a task counts before it hands them on.
MOST_SEEN = 500_000
#: Rows of a task, on the mean at least, of the many short jobs of a fit, whose sums are as wide as the vocabularies.
FIT_ROWS = 2500
#: Rows of a task, on the mean at least, of a round of the main directions; cells of their sums that are added up together.
ROUND_ROWS, SUM_CELLS = 1000, 1 << 19
#: Fits of the grid that run beside each other.
AT_ONCE = 4


def char_runs(text: Column) -> Column:
    """Runs of 3 to 5 characters inside words, each word between blanks; a shorter word is one run."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        runs = lambda n: F.when(F.length(padded) > n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))
        # The first length that isn't below the word's gives the word once; longer ones nothing.
        empty = F.array().cast("array<string>")
        whole = F.array(padded)
        return F.concat(F.coalesce(runs(3), whole), F.coalesce(runs(4), F.when(F.length(padded) > 3, whole), empty), F.coalesce(runs(5), F.when(F.length(padded) > 4, whole), empty))

    return T.let(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda words: F.flatten(F.transform(words, of)))


def prepared(rows: DataFrame) -> DataFrame:
    """The rows with what a router may see of the prompt: words, the words between white space for character runs, engineered features."""
    prompt = F.col("prompt")
    words = F.regexp_extract_all(F.lower(prompt), F.lit(r"(?U)(\w\w+)"), F.lit(1))
    return spread(rows).withColumns({"label": F.col("local_ok").cast("double"), "words": words, "chars": T.words(F.lower(prompt))} | {f"f_{n}": c for n, c in T.features(prompt).items()})


@dataclass
class Features:
    """Fitted features: two vocabularies with their frequencies, and the deviations of the engineered columns."""

    words: list[str]
    chars: list[str]
    idf: tuple[np.ndarray, np.ndarray]
    scale: np.ndarray

    @staticmethod
    def fit(rows: DataFrame, folds: list[int | None]) -> list[Features]:
        """Features learnt without each of some folds (None: from all rows); the terms of all are counted in one pass."""
        use = lambda f: F.lit(True) if f is None else F.col("fold") != f
        found = vocabularies(rows, FOLDS, folds, {"words": WORDS, "chars": CHARS}, LEAST_DOCS)
        best = _together([lambda v=v, kind=kind: v(kind) for v in found for kind in KINDS])
        told = rows.agg(*[F.count_if(use(f)) for f in folds], *[F.stddev_pop(F.when(use(f), F.col(c))) for f in folds for c in ENGINEERED]).first()
        out = []
        for i in range(len(folds)):
            own, begin = best[2 * i : 2 * i + 2], len(folds) + i * len(ENGINEERED)
            idf = tuple(np.log((1 + told[i]) / (1 + np.array([r.d for r in terms], float))) + 1 for terms in own)
            out.append(Features(*[[r.term for r in terms] for terms in own], idf, np.array([x or 1.0 for x in told[begin : begin + len(ENGINEERED)]], float)))
        return out

    @property
    def width(self) -> int:
        return sum(map(len, self.idf)) + len(self.scale)


def _own() -> Column:
    return F.array(*[F.col(c).cast("double") for c in ENGINEERED]).alias("own")


@dataclass
class Weights:
    """What a task needs to make one member's feature vectors of counts: places of the terms, frequencies, deviations."""

    places: np.ndarray
    idf: tuple[np.ndarray, np.ndarray]
    scale: np.ndarray

    def of(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray], own: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, index and value of the vectors by row and index: counts as 1 + log times their inverse frequency to unit length, and scaled engineered features."""
        n, (row, at, many) = len(own), counts
        index = self.places[at]
        row, index, many = row[index >= 0], index[index >= 0], many[index >= 0]
        value = (1 + np.log(many)) * np.concatenate(self.idf)[index]
        part = 2 * row + (index >= len(self.idf[0]))
        value /= np.sqrt(np.bincount(part, value * value, 2 * n))[part]
        size, width = len(self.scale), sum(map(len, self.idf)) + len(self.scale)
        row = np.concatenate([row, np.repeat(np.arange(n), size)])
        index = np.concatenate([index, np.tile(np.arange(width - size, width), n)])
        value = np.concatenate([value, (boosting.matrix(own) / self.scale).ravel()])
        order = np.argsort(row * width + index)
        return row[order], index[order], value[order]


def weights(bag: Bag, features: list[Features]) -> list[Weights]:
    return [Weights(bag.maps[i], f.idf, f.scale) for i, f in enumerate(features)]


def bag_of(features: list[Features]) -> Bag:
    return Bag([(f.words, f.chars) for f in features])


def listed(at: pa.ListArray, n: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of counted rows."""
    return pc.list_parent_indices(at).to_numpy(), pc.list_flatten(at).to_numpy(), pc.list_flatten(n).to_numpy()


def vectors_of(counts: DataFrame, own: Weights, *columns: str) -> DataFrame:
    """``columns`` of counted rows and their feature vectors."""
    sent = counts.sparkSession.sparkContext.broadcast(own)
    size = sum(map(len, own.idf)) + len(own.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, index, value = sent.value.of(listed(batch.column(0), batch.column(1)), batch.column(2))
            offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            told = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(offsets, index.astype(np.int32)), pa.ListArray.from_arrays(offsets, value)],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], told], names=[*columns, "features"])

    told = counts.select("at", "n", "own", *columns)
    return told.mapInArrow(run, told.drop("at", "n", "own").schema.add("features", VectorUDT()))


@dataclass
class Member:
    """A model learnt without one fold, with its features, perhaps their main directions, and its calibrations on that fold."""

    features: Features
    model: object
    axes: np.ndarray | None = None
    sigmoid: tuple[float, float] = (1.0, 0.0)
    steps: IsotonicRegressionModel | None = None

    def sent(self) -> tuple:
        """What a task needs to score vectors: coefficients, or directions and trees."""
        return self.axes, self.model if self.axes is not None else (self.model.coefficients.toArray(), self.model.intercept)


def probability(member: tuple, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """A member's own probability of n rows by their vectors."""
    axes, model = member
    if axes is not None:
        score = model.score(times(vectors, axes, n))
    else:
        row, index, value = vectors
        score = np.bincount(row, value * model[0][index], n) + model[1]
    return 1 / (1 + np.exp(-score))


@dataclass
class Router:
    """A fitted candidate: its members, how they are calibrated, and the threshold chosen for it."""

    name: str
    members: list[Member]
    method: str = "sigmoid"
    threshold: float = ALL_STRONG
    params: dict = field(default_factory=dict)

    def raw(self, rows: DataFrame) -> DataFrame:
        """Prepared rows with each member's own probability, p0 and on; one pass scores all members."""
        columns = [c for c in rows.columns if c not in (*KINDS, *ENGINEERED)]
        features = [m.features for m in self.members]
        bag = bag_of(features)
        sent = rows.sparkSession.sparkContext.broadcast((bag, weights(bag, features), [m.sent() for m in self.members]))  # vocabularies and directions have fixed bounds
        told = [f"p{i}" for i in range(len(self.members))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bag, weights, members = sent.value
            for batch in batches:
                for begin in range(0, batch.num_rows, 8 * SOME_ROWS):
                    some = batch.slice(begin, 8 * SOME_ROWS)
                    counts = bag.counts(some.column(1), some.column(2))
                    p = [probability(m, w.of(counts, some.column(0)), some.num_rows) for w, m in zip(weights, members, strict=True)]
                    yield pa.RecordBatch.from_arrays([*some.columns[3:], *map(pa.array, p)], names=[*columns, *told])

        own = rows.select(_own(), *KINDS, *columns)
        schema = own.select(*columns).schema
        for name in told:
            schema = schema.add(name, "double")
        return own.mapInArrow(run, schema)

    def score(self, rows: DataFrame) -> DataFrame:
        """Prepared rows with the calibrated probability p that the cheap answer is good."""
        return calibrated(self.raw(rows), self, self.method)


def projected(counts: DataFrame, own: list[Weights], axes: list[np.ndarray], *columns: str) -> DataFrame:
    """``columns`` of counted rows and their feature vectors along a few directions, as arrays x0 and on."""
    sent = counts.sparkSession.sparkContext.broadcast((own, axes))
    names = [f"x{i}" for i in range(len(axes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, listed_, told = batch.num_rows, listed(batch.column(0), batch.column(1)), []
            for w, a in zip(*sent.value, strict=True):
                low = times(w.of(listed_, batch.column(2)), a, n)
                told.append(pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * a.shape[1], low.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *told], names=[*columns, *names])

    told = counts.select("at", "n", "own", *columns)
    schema = told.drop("at", "n", "own").schema
    for name in names:
        schema = schema.add(name, ArrayType(DoubleType()))
    return told.mapInArrow(run, schema)


def _dense(vectors: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows at a time: which, the features that they hold, and their values as a dense matrix."""
    row, index, value = vectors
    ends = np.searchsorted(row, np.arange(n + 1))
    for begin in range(0, n, 64):
        end = min(n, begin + 64)
        own = slice(ends[begin], ends[end])
        some, at = np.unique(index[own], return_inverse=True)
        out = np.zeros((end - begin, len(some)))
        out[row[own] - begin, at] = value[own]
        yield slice(begin, end), some, out


def times(vectors: tuple[np.ndarray, np.ndarray, np.ndarray], axes: np.ndarray, n: int) -> np.ndarray:
    """n sparse rows times a dense matrix."""
    out = np.zeros((n, axes.shape[1]))
    for own, some, dense in _dense(vectors, n):
        out[own] = dense @ axes[some]
    return out


def _back(batches: Iterator[pa.RecordBatch], own: Weights, axes: np.ndarray) -> np.ndarray:
    """X'X axes over a task's rows."""
    out = np.zeros_like(axes)
    for batch in batches:
        vectors = own.of(listed(batch.column(0), batch.column(1)), batch.column(2))
        for _, some, dense in _dense(vectors, batch.num_rows):
            out[some] += dense.T @ (dense @ axes[some])
    return out


def _sums(counts: DataFrame, own: Weights, axes: np.ndarray) -> np.ndarray:
    """X'X axes over all rows. Tasks cut their sums into ranges of features, which other tasks add up: the driver meets one matrix, however many tasks there are."""
    sent = counts.sparkSession.sparkContext.broadcast((own, axes))
    step = max(1, SUM_CELLS // axes.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _back(batches, *sent.value)
        for begin in range(0, len(found), step):
            yield pa.RecordBatch.from_arrays([pa.array([begin]), pa.array([found[begin : begin + step].tobytes()], pa.binary())], names=["begin", "part"])

    told = counts.select("at", "n", "own").mapInArrow(run, "begin long, part binary").rdd
    added = told.map(lambda r: (r.begin, np.frombuffer(r.part))).reduceByKey(lambda a, b: a + b, told.getNumPartitions())
    out = np.zeros_like(axes)
    for begin, part in added.collect():
        out[begin : begin + step] = part.reshape(-1, axes.shape[1])
    sent.destroy()
    return out


def axes_of(counts: DataFrame, own: Weights, width: int, components: int = COMPONENTS, rounds: int = POWER_ROUNDS) -> np.ndarray:
    """The main directions of the feature vectors, by powers of their products with random ones (a randomised SVD).

    A round reads the rows once. Tasks send a matrix of features by directions, added up in tasks; the rows themselves never leave theirs.
    """
    few = max(1, min(components, width))
    axes = np.random.default_rng(SEED).standard_normal((width, min(width, few + SPARE)))
    for _ in range(rounds + 1):
        axes, _ = np.linalg.qr(axes)
        found = _sums(counts, own, axes)
        small = axes.T @ found
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best, axes = axes @ turn[:, ::-1][:, :few], found
    return best


def calibrated(rows: DataFrame, router: Router, method: str) -> DataFrame:
    """Rows with members' probabilities p0 and on replaced by p, the mean of the calibrated ones."""
    names = [f"p{i}" for i in range(len(router.members))]
    for name, member in zip(names, router.members, strict=True):
        if method == "isotonic":
            found = member.steps.transform(rows.withColumn("features", array_to_vector(F.array(name))))
            rows = found.withColumn(name, F.col("prediction")).drop("features", "prediction")
        else:
            a, b = member.sigmoid
            rows = rows.withColumn(name, 1 / (1 + F.exp(-(logit(F.col(name)) * a + b))))
    return rows.withColumn("p", sum(map(F.col, names)) / len(names)).drop(*names)


def logit(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))


def grid(name: str) -> list[dict]:
    """Parameters that a candidate is tried with."""
    if name == "logreg_tfidf":
        return [{"C": c} for c in STRENGTHS]
    if name == "gbdt_svd":
        return [{"depth": d, "rate": boosting.RATE} for d in DEPTHS]
    raise ValueError(f"unknown candidate {name!r}; one of {CANDIDATES}")


@dataclass
class Folded:
    """What candidates share: rows as counts with their folds, the folds that are left out in turn, rows without each, and the features learnt from those."""

    counts: DataFrame
    folds: list[int | None]
    sizes: list[int]
    features: list[Features]
    weights: list[Weights]

    @staticmethod
    def of(rows: DataFrame) -> Folded:
        """Prepared rows. Folds whose complement has one class are passed over; if all are, one member learns from all rows and is calibrated on them."""
        rows = settled(grouped_folds(rows).select("task_id", "label", "fold", *KINDS, *ENGINEERED))
        classes = {r.fold: (r.n, r.ok) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ok")).collect()}
        n, ok = (sum(c[i] for c in classes.values()) for i in range(2))
        folds = [f for f, (k, good) in sorted(classes.items()) if 0 < ok - good < n - k] or [None]
        features = Features.fit(rows, folds)
        bag = bag_of(features)
        counts = settled(counted(rows.withColumn("own", _own()), bag, "task_id", "label", "fold", "own"))
        return Folded(counts, folds, [n - classes[f][0] if f is not None else n for f in folds], features, weights(bag, features))


def fit_candidate(name: str, folded: Folded, rounds: int = ROUNDS) -> tuple[Router, DataFrame]:
    """The candidate with the parameters of the best mean ROC area over grouped folds; and its members' scores (member, label, p) out of fold."""
    choices = grid(name)
    counts, folds, features, own = folded.counts, folded.folds, folded.features, folded.weights
    use = lambda f: F.lit(True) if f is None else F.col("fold") != f
    vectors = []
    if name == "logreg_tfidf":
        tasks = max(1, math.ceil(counts.count() / FIT_ROWS))
        vectors = [vectors_of(counts, w, "task_id", "label", "fold").coalesce(tasks).cache() for w in own]
        models = _together([
            lambda i=i, c=c: LogisticRegression(regParam=1 / (c["C"] * folded.sizes[i]), standardization=False, maxIter=100).fit(vectors[i].where(use(folds[i])))
            for i in range(len(folds)) for c in choices
        ])
        fitted = [[models[i * len(choices) + k] for k in range(len(choices))] for i in range(len(folds))]
        axes: list = [None] * len(folds)
        outer = [[m.transform(vectors[i]).select("task_id", "label", "fold", vector_to_array("probability")[1].alias("p")) for m in fitted[i]] for i in range(len(folds))]
    else:
        dealt = max(1, math.ceil(counts.count() / ROUND_ROWS))
        axes = [axes_of(counts.where(use(f)).coalesce(dealt), own[i], features[i].width) for i, f in enumerate(folds)]  # not beside each other: the driver holds one fold's products
        wide = settled(projected(counts, own, axes, "task_id", "label", "fold").withColumns({f"u{i}": use(f) for i, f in enumerate(folds)}))
        models = boosting.fit(wide, "label", [(f"x{i}", f"u{i}") for i in range(len(folds))], [(i, c["depth"]) for i in range(len(folds)) for c in choices], rounds)
        fitted = [[models[i * len(choices) + k] for k in range(len(choices))] for i in range(len(folds))]
        outer = [[m.probability(wide.select("task_id", "label", "fold", F.col(f"x{i}").alias("features"))) for m in fitted[i]] for i in range(len(folds))]
    told = None
    for i, f in enumerate(folds):
        for k in range(len(choices)):
            own = outer[i][k].where(F.lit(True) if f is None else F.col("fold") == f).select(F.lit(i).alias("member"), F.lit(k).alias("k"), F.col("label").alias("y"), "p")
            told = own if told is None else told.unionByName(own)
    told = settled(told)
    for v in vectors:
        v.unpersist()
    areas = told.transform(lambda t: roc_auc(t, "member", "k")).groupBy("k").agg(F.avg("roc_auc").alias("area")).collect()
    area = {r.k: r.area for r in areas if r.area is not None}
    best = max(range(len(choices)), key=lambda k: (area.get(k, -1.0), -k))
    router = Router(name, [Member(features[i], fitted[i][best], axes[i]) for i in range(len(folds))], params=choices[best] | {"cv_roc_auc": area.get(best)})
    return router, told.where(F.col("k") == best).select("member", F.col("y").alias("label"), "p")


def _together(tasks: list) -> list:
    """Results of tasks of which some run beside each other: each is a row of small Spark jobs."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda t: t(), tasks))


def calibrate(router: Router, outer: DataFrame, validation: DataFrame, method: str = "auto") -> Router:
    """Sets the calibrations learnt from scores out of fold, and the method of the least Brier score on validation rows."""
    outer = settled(outer)
    methods = [method] if method != "auto" else ["sigmoid", *(["isotonic"] if outer.count() >= LEAST_STEPS else [])]
    shapes = platt(outer, "member")
    for i, member in enumerate(router.members):
        member.sigmoid = shapes.get(i, (1.0, 0.0))
    if "isotonic" in methods:
        own = outer.withColumn("features", array_to_vector(F.array("p")))
        fits = _together([lambda i=i: IsotonicRegression(featuresCol="features", labelCol="label").fit(own.where(F.col("member") == i)) for i in range(len(router.members))])
        for member, steps in zip(router.members, fits, strict=True):
            member.steps = steps
    scored, best = settled(router.raw(validation).select("label", *[f"p{i}" for i in range(len(router.members))])), None
    for m in methods:
        own = brier(calibrated(scored, router, m).select(F.col("label").alias("y"), "p")).first().brier
        if best is None or own < best[0]:
            best = own, m
    router.method = best[1]
    return router


def choose_threshold(rows: DataFrame, policy: str) -> dict:
    """The policy's operating point on scored rows (p_local), or all strong with a note where none is feasible."""
    points = sweep(rows)
    found = POLICIES[policy](points).first()
    if found is None:
        return points.where(F.col("threshold") >= ALL_STRONG).first().asDict() | {"note": f"no threshold meets {policy}: all strong"}
    return found.asDict() | {"note": ""}


def candidate_select(points: DataFrame, policy: str) -> DataFrame:
    """The best candidate's row by what the policy wants; one that fell back (a note) comes after all others; ties by name."""
    order = {
        "quality_floor": [F.col("cost_total"), F.desc("quality_mean")],
        "max_unsafe": [F.desc("local_utilisation"), F.col("cost_total")],
        "utility": [F.desc(F.round(F.col("quality_mean") - F.col("cost_mean"), 6))],
        "remote_rate": [F.round(F.abs(F.col("remote_call_rate") - 0.5), 6), F.desc("quality_mean")],
    }[policy]
    return points.orderBy(F.when(F.coalesce("note", F.lit("")) != "", 1).otherwise(0), *order, "candidate").limit(1)


def train(outcomes: DataFrame, policy: str = "quality_floor", candidates: tuple[str, ...] = CANDIDATES, rounds: int = ROUNDS) -> tuple[Router, dict, DataFrame, dict[str, Router]]:
    """The selected router, the report, the splits (task_id, group_id, split), and all candidates.

    ValueError for too few training or validation rows, or for one class of labels.
    """
    splits = settled(make_splits(outcomes).select("task_id", F.col("group_id").alias("merged"), "split"))
    joined = outcomes.join(splits, "task_id")
    merged = joined.where("group_id <> merged").select("group_id").distinct().count()
    rows = settled(prepared(joined.drop("group_id").withColumnRenamed("merged", "group_id")))
    parts = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    sizes = {s: p.count() for s, p in parts.items()}
    for part, least in (("train", LEAST_TRAIN), ("val", LEAST_VALIDATION)):
        if sizes[part] < least:
            raise ValueError(f"only {sizes[part]} rows of the {part} split; {least} are needed")
    if parts["train"].select("label").distinct().count() < 2:
        raise ValueError("the training split has a single class of labels")
    report: dict = {"versions": {"features": FEATURES, "format": FORMAT}, "seed": SEED, "policy": policy, "sizes": sizes, "merged_groups": merged, "candidates": {}}
    routers: dict[str, Router] = {}
    folded = Folded.of(parts["train"])
    for name in candidates:
        router, outer = fit_candidate(name, folded, rounds)
        calibrate(router, outer, parts["val"])
        report["candidates"][name] = _judged(settled(router.score(parts["val"]).withColumn("p_local", F.col("p"))), policy) | {"params": router.params, "calibration": router.method}
        router.threshold = report["candidates"][name]["point"]["threshold"]
        routers[name] = router
    plain = parts["val"].withColumn("p_local", T.heuristic_score(F.col("prompt"))).withColumn("p", F.col("p_local"))
    report["candidates"]["heuristic_reference"] = _judged(settled(plain), policy) | {"params": {}, "calibration": "none"}
    points = rows.sparkSession.createDataFrame([{"candidate": n, "note": report["candidates"][n]["point"]["note"]} | {k: float(v) for k, v in report["candidates"][n]["point"].items() if k not in ("note", "n")} for n in candidates])
    report["selected"] = candidate_select(points, policy).first().candidate
    report["postgen"] = {r.stat: r.roc_auc for r in postgen_auc(parts["train"].unionByName(parts["val"])).collect()}
    return routers[report["selected"]], report, splits.withColumnRenamed("merged", "group_id"), routers


def _judged(scored: DataFrame, policy: str) -> dict:
    """Validation statistics of scored rows, and the operating point that the policy picks."""
    pairs = scored.select(F.col("label").cast("int").alias("y"), "p")
    point = choose_threshold(scored, policy)
    return {"roc_auc": roc_auc(pairs).first()[0], "brier": brier(pairs).first()[0], "ece": ece(pairs).first()[0], "confusion": confusion(pairs, point["threshold"]).first().asDict(), "point": point}


def save_router(router: Router, path: str, meta: dict | None = None) -> None:
    """All parts of a router in one folder, with a manifest that a loader checks."""
    spark = SparkSession.getActiveSession()
    numbers, terms, sigmoids = [], [], []
    for i, m in enumerate(router.members):
        terms += [(i, kind, k, t) for kind in KINDS for k, t in enumerate(getattr(m.features, kind))]
        for name, part in (("steps", m.steps), ("model", m.model if m.axes is None else None)):
            if part is not None:
                part.write().overwrite().save(f"{path}/member{i}/{name}")
        for name, values in (("words", m.features.idf[0]), ("chars", m.features.idf[1]), ("scale", m.features.scale)):
            numbers += [(i, name, k, [float(x)]) for k, x in enumerate(values)]
        if m.axes is not None:
            numbers += [(i, "axes", k, [float(x) for x in row]) for k, row in enumerate(m.axes)]
            numbers += [(i, "edges", k, [float(x) for x in row]) for k, row in enumerate(m.model.edges)]
            numbers += [(i, "base", 0, [float(m.model.base)])]
            for k, t in enumerate(m.model.trees):
                for part in ("feature", "bin", "left", "right", "value"):
                    numbers.append((i, f"tree_{part}", k, [float(x) for x in getattr(t, part)]))
        sigmoids.append(list(m.sigmoid))
    spark.createDataFrame(numbers, "member int, part string, i int, x array<double>").write.mode("overwrite").parquet(f"{path}/numbers")
    spark.createDataFrame(terms, "member int, kind string, i int, term string").write.mode("overwrite").parquet(f"{path}/terms")
    manifest = {"format": FORMAT, "features": FEATURES, "name": router.name, "threshold": router.threshold, "method": router.method, "sigmoids": sigmoids, "params": router.params, "meta": meta or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_router(path: str, configured: tuple[str, str, str] | None = None) -> Router:
    """A saved router; ValueError where format, features, threshold or the pair of models (tier, cheap, strong) don't fit."""
    spark = SparkSession.getActiveSession()
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["format"] != FORMAT or manifest["features"] != FEATURES:
        raise ValueError(f"router of another version: {manifest['format']}, {manifest['features']}")
    if not 0 <= manifest["threshold"] <= ALL_STRONG:
        raise ValueError("threshold out of range")
    meta = manifest["meta"]
    if configured:
        trained = [F.lit(meta.get(k)).cast("string") for k in ("tier_mode", "local_model", "remote_model")]
        if not spark.range(1).select(pair_accepted(*trained, configured).alias("ok")).first().ok:
            raise ValueError(f"router trained for {meta}, configured for {configured}")
    numbers: dict[tuple, list] = {}
    for r in spark.read.parquet(f"{path}/numbers").orderBy("member", "part", "i").collect():
        numbers.setdefault((r.member, r.part), []).append(r.x)
    terms: dict[tuple, list] = {}
    for r in spark.read.parquet(f"{path}/terms").orderBy("member", "kind", "i").collect():
        terms.setdefault((r.member, r.kind), []).append(r.term)
    members = []
    for i, sigmoid in enumerate(manifest["sigmoids"]):
        own = lambda part, i=i: numbers.get((i, part), [])
        flat = {part: np.array([x[0] for x in own(part)]) for part in ("words", "chars", "scale")}
        features = Features(terms.get((i, "words"), []), terms.get((i, "chars"), []), (flat["words"], flat["chars"]), flat["scale"])
        axes, model = np.array(own("axes")) if own("axes") else None, None
        if axes is None:
            model = LogisticRegressionModel.load(f"{path}/member{i}/model")
        else:
            whole = lambda part: [[int(v) for v in x] for x in own(part)]
            trees = [boosting.Tree(*t) for t in zip(whole("tree_feature"), whole("tree_bin"), whole("tree_left"), whole("tree_right"), own("tree_value"), strict=True)]
            model = Boosted([np.array(e) for e in own("edges")], own("base")[0][0], trees)
        steps = IsotonicRegressionModel.load(f"{path}/member{i}/steps") if manifest["method"] == "isotonic" else None
        members.append(Member(features, model, axes, tuple(sigmoid), steps))
    return Router(manifest["name"], members, manifest["method"], manifest["threshold"], manifest["params"])


def route_learned(router: Router, rows: DataFrame) -> DataFrame:
    """task_id, confidence to four places, and the route by the router's own threshold, of rows with a prompt and a label or none."""
    own = rows if "local_ok" in rows.columns else rows.withColumn("local_ok", F.lit(None).cast("boolean"))
    return router.score(settled(prepared(own))).select("task_id", F.round("p", 4).alias("confidence"), F.when(F.col("p") >= router.threshold, "local").otherwise("strong").alias("route"))


def report_rows(spark: SparkSession, report: dict) -> DataFrame:
    """A row for each candidate of a report."""
    rows = [(n, n == report["selected"], c["calibration"], json.dumps(c["params"], sort_keys=True), c["roc_auc"], c["brier"], c["ece"], float(c["point"]["threshold"]), float(c["point"]["quality_mean"]), float(c["point"]["cost_total"])) for n, c in report["candidates"].items()]
    return spark.createDataFrame(rows, "candidate string, selected boolean, calibration string, params string, roc_auc double, brier double, ece double, threshold double, quality_mean double, cost_total double")


def _runs_of(word: str) -> tuple[str, ...]:
    """``char_runs`` of one word."""
    padded = f" {word} "
    return tuple({padded[i : i + n] for n in (3, 4, 5) for i in range(max(1, len(padded) - n + 1))})


def char_frequency(texts: DataFrame, text: str) -> DataFrame:
    """run and df: in how many rows' texts a character run is. A row's distinct words leave the JVM, a task's sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 16)(_runs_of)
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["run", "k"])
            seen.clear()
            return out

        for batch in batches:
            for words in batch.column(0).to_pylist():
                seen.update(set().union(*map(known, words or ())))
                if len(seen) > MOST_SEEN:
                    yield told()
        yield told()

    words = texts.select(F.filter(F.array_distinct(F.split(F.lower(text), r"(?U)\s+")), lambda w: w != "").alias("words"))
    return words.mapInArrow(run, "run string, k long").groupBy("run").agg(F.sum("k").alias("df"))


def _char_frequency(s, d) -> DataFrame:
    return char_frequency(view(s, d, "outcomes"), "prompt").where(F.col("df") >= LEAST_DOCS)


#: What was trained on given tables, by session and folder: a router is fitted once however many queries use it.
_TRAINED: dict[tuple[str, str], tuple[Router, dict, DataFrame, dict[str, Router]]] = {}


def trained(spark: SparkSession, sf_dir: str) -> tuple[Router, dict, DataFrame, dict[str, Router]]:
    """``train`` on the outcomes of given tables, grouped by their prompts."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _TRAINED:
        _TRAINED[key] = train(grouped_by_prompt(view(spark, sf_dir, "outcomes")))
    return _TRAINED[key]


def _scores(name: str):
    """A candidate's calibrated scores of all outcomes, with the split of each."""

    def run(s, d) -> DataFrame:
        _, _, splits, routers = trained(s, d)
        rows = settled(prepared(view(s, d, "outcomes")).select("task_id", "label", *KINDS, *ENGINEERED))
        return routers[name].score(rows).select("task_id", "label", "p").join(splits.select("task_id", "split"), "task_id")

    return run


def _selected(s, d) -> DataFrame:
    """The candidate that the policy prefers, by its validation figures."""
    return report_rows(s, trained(s, d)[1]).where("selected")


QUERIES = {
    "tfidf_char": _char_frequency,
    "logreg_tfidf": _scores("logreg_tfidf"),
    "gbdt_svd": _scores("gbdt_svd"),
    "candidate_select": _selected,
    "train": lambda s, d: report_rows(s, trained(s, d)[1]),
    "route_learned": lambda s, d: route_learned(trained(s, d)[0], view(s, d, "outcomes")),
}
_RUNS = "list_concat(CASE WHEN length(w) > 3 THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE [w] END, CASE WHEN length(w) > 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) WHEN length(w) = 4 THEN [w] ELSE [] END, CASE WHEN length(w) > 5 THEN list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)) WHEN length(w) = 5 THEN [w] ELSE [] END)"
ORACLES = {
    "tfidf_char": f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x{{00A0}}]+'), lambda x: x <> ''))) AS x FROM documents),
r AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS run FROM (SELECT doc_id, concat(' ', x, ' ') AS w FROM w))
SELECT run, count(*) AS df FROM r GROUP BY run HAVING count(*) >= 2""",
}
