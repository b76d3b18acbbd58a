"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades: 0 (not toxic), 1 and 2 (toxic, mild and severe). P(grade <= k) is
``sigmoid(threshold[k] - w.x)``: one weight vector shared by all ordered
thresholds, which are kept apart by learning the logs of their gaps. The
output is the expected severity, the sum of P(grade > k).

Labels say only toxic or not, so training derives the grade of a toxic row from
its evidence: the sum of positive log-odds of its features, severe above the
median of toxic rows.

Features are the distinct words of the whole text and their first 4 to 7
letters. Those enter the model whose log-odds between toxic and other labelled
rows is at least ``MIN_Z`` standard errors above zero, the strongest
``max_features`` at most; the counts are aggregated by Spark. The model is
fitted on a sample of at most ``sample_rows`` labelled rows (lowest hash of
doc_id, both classes as they come), its training rows are reduced to selected
features before they reach the driver, and it is a bounded table of weights.

Defined results: null and empty texts have no features and get the severity of
the thresholds alone; repeated labels of a doc_id count as toxic if any is;
labels or documents without a doc_id are not trained on; without labelled rows
of both classes there is no evidence and every severity is 0; documents keep
all their columns in ``row``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

SAMPLE_ROWS = 20_000
MAX_FEATURES = 8192
MIN_Z = 3.5
MIN_ROWS = 4
PREFIXES = (4, 5, 6, 7)
GRADES = 3
#: Documents of at least this expected severity are toxic.
TOXIC_AT = 0.4
#: Words whose features a task remembers before it starts afresh.
MEMO_WORDS = 500_000

_WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A word and its prefixes, which end in an asterisk."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def features(text: str | None) -> set[str]:
    """Distinct features of a whole text."""
    return {f for w in set(_WORDS.findall((text or "").lower())) for f in features_of(w)}


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def severity(self, score: np.ndarray) -> np.ndarray:
        return self.grades(score).sum(axis=1)


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES,
                l2: float = 0.001, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from presence pairs (row, col) and the rows' grades; Adam on the mean log-likelihood."""
    n, k = len(grade), grades - 1
    share = np.clip([(grade <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1:])
        cuts = params[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], n)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))
        padded = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(padded[at, grade + 1] - padded[at, grade], 1e-9)
        up, down = slope[at, grade + 1] / p, slope[at, grade] / p
        to_cut = np.zeros(k)
        for j in range(k):
            to_cut[j] = -(up[grade == j].sum() - down[grade == j + 1].sum()) / n
        to_w = np.bincount(col, ((up - down) / n)[row], n_features) + l2 * w / max(1, n_features) ** 0.5
        to_gap = np.array([to_cut[j + 1:].sum() * gaps[j] for j in range(k - 1)])
        g = np.concatenate([to_w, [to_cut.sum()], to_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params[:n_features], params[n_features] + np.concatenate([[0], np.cumsum(np.exp(params[n_features + 1:]))])


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, toxic, text) of the labelled rows of the sample."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("toxic").cast("int").alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    here = texts.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return texts.join(F.broadcast(chosen), "doc_id")  # sample_rows narrow rows at most


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on the labelled rows among ``docs``."""
    spark = docs.sparkSession
    none = Model((), np.zeros(0), np.full(GRADES - 1, 60.0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        classes = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                y = int(toxic > 0)
                classes[y] += 1
                for f in features(text.as_py()):
                    counts.setdefault(f, [0, 0])[y] += 1
            if len(counts) > 1_000_000:
                yield table(counts)
                counts = {}
        yield table(counts | {"": classes})

    def table(counts: dict[str, list[int]]) -> pa.RecordBatch:
        pairs = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([p[1] for p in pairs], pa.int64()),
                                           pa.array([p[0] for p in pairs], pa.int64())], names=["name", "toxic", "other"])

    rows = _sample(docs, labels, sample_rows)
    counts = rows.select("toxic", "text").mapInArrow(counted, "name string, toxic long, other long")
    counts = counts.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counts.where(F.col("toxic") + F.col("other") >= MIN_ROWS).withColumn("all_toxic", F.lit(0))
    classes = rows.agg(F.sum((F.col("toxic") > 0).cast("int")).alias("toxic"), F.count("*").alias("n")).first()
    if not classes["n"] or not classes["toxic"] or classes["toxic"] == classes["n"]:
        return none
    p, n = float(classes["toxic"]), float(classes["n"] - classes["toxic"])
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = F.log(a / (F.lit(p + 1) - a) / (b / (F.lit(n + 1) - b)))
    z = odds / F.sqrt(1 / a + 1 / (F.lit(p + 1) - a) + 1 / b + 1 / (F.lit(n + 1) - b))
    best = (counts.where("name <> ''").select("name", odds.alias("odds"), z.alias("z")).where(F.col("z") >= MIN_Z)
            .orderBy(F.desc("z"), "name").limit(max_features).collect())
    if not best:
        return none
    names, log_odds = tuple(r["name"] for r in best), np.array([r["odds"] for r in best])
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index.value[f] for f in features(t.as_py()) if f in index.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "cols"])

    data = rows.select("toxic", "text").mapInArrow(reduced, "toxic int, cols array<int>").toArrow()
    toxic, cols = data["toxic"].to_numpy() > 0, data["cols"].combine_chunks()
    lengths = np.diff(cols.offsets.to_numpy())
    row, col = np.repeat(np.arange(len(toxic)), lengths), cols.values.to_numpy()
    evidence = np.bincount(row, np.maximum(log_odds, 0)[col], len(toxic))
    grade = np.where(toxic, np.where(evidence > np.median(evidence[toxic]), 2, 1), 0)
    weights, thresholds = fit_ordinal(row, col, grade, len(names))
    return Model(names, weights, thresholds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of a document), severity (0 to 2), grade (most probable), toxic."""
    schema = StructType([StructField("row", StructType(docs.schema.fields)), StructField("severity", DoubleType()), StructField("grade", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        index = {f: i for i, f in enumerate(m.names)}
        for batch in batches:
            rows, scores = batch.column("row"), np.zeros(batch.num_rows)
            for i, text in enumerate(rows.field("text")):
                active: set[int] = set()
                for word in set(_WORDS.findall((text.as_py() or "").lower())):
                    own = memo.get(word)
                    if own is None:
                        if len(memo) > MEMO_WORDS:
                            memo.clear()
                        own = memo[word] = tuple(index[f] for f in features_of(word) if f in index)
                    if own:
                        active.update(own)
                scores[i] = m.weights[sorted(active)].sum() if active else 0.0
            above = m.grades(scores)
            each = -np.diff(np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([rows, pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32))],
                                             names=["row", "severity", "grade"])

    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).mapInArrow(score, schema)
    return out.withColumn("toxic", F.col("severity") >= TOXIC_AT)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic by a model trained on the labelled ones among them."""
    return scored(docs, train(docs, labels)).where("NOT toxic").select("row.*")
