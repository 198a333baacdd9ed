"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive class; the other training texts are
unlabelled, a mixture in which some are toxic too. The risk of a classifier g is
estimated as pi * R_p(g, +1) + max(0, R_u(g, -1) - pi * R_p(g, -1)) with the class
prior pi, which corrects for the toxic texts among the unlabelled ones and cannot
go negative (Kiryo et al., 2017). Linear classifiers in numpy minimise it, one in
each of a few Spark tasks on its own resample; their mean is the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.chunks import in_steps
from lodestone.llm.common import fresh, stored

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = range(3, 10)
#: A word's share of a text is counted in units of one in so many words.
UNIT = 50.0


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature, and a bias. At most ``max_features`` of ``train`` entries."""

    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    """Features of a lower-case word: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


class WordBatch:
    """Distinct white-space tokens of a batch of texts, and where each stands."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        self.words = [WORD.findall(t.lower()) for t in flat.dictionary.to_pylist()]
        self.codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.docs = np.repeat(np.arange(len(texts)), np.diff(offsets))
        each = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.n_words = np.bincount(self.docs, each[self.codes], minlength=len(texts)) if len(self.codes) else np.zeros(len(texts))

    def rates(self, place: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """Text, feature and value of every non-zero feature; ``place`` numbers those wanted, None for all."""
        grow = place is None
        place = {} if grow else place
        owned: list[int] = []
        counts = np.zeros(len(self.words), np.int64)
        for i, words in enumerate(self.words):
            for word in words:
                for f in features(word):
                    at = place.setdefault(f, len(place)) if grow else place.get(f)
                    if at is not None:
                        owned.append(at)
                        counts[i] += 1
        starts = np.cumsum(counts) - counts
        hit = np.flatnonzero(counts[self.codes] > 0)
        codes = self.codes[hit]
        n = counts[codes]
        ends = np.cumsum(n)
        index = np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        width = max(1, len(place))
        keys, found = np.unique(np.repeat(self.docs[hit], n) * width + np.asarray(owned, np.int64)[index], return_counts=True)
        docs = keys // width
        return docs, keys % width, np.log1p(UNIT * found / np.maximum(self.n_words[docs], 1)), place


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, positive: np.ndarray, n_features: int, prior: float, seed: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier; texts are rows, ``positive`` marks the confirmed ones.

    Full-batch Adam on the logistic loss. While the corrected negative risk is
    below zero, its gradient alone is followed upwards, as the non-negative
    estimator prescribes.
    """
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(0, 1e-3, n_features), -2.0
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        logits = bias + np.bincount(rows, values * weights[columns], minlength=len(positive))
        # logistic losses: toward 1 -> log(1 + e^-x), toward 0 -> log(1 + e^x)
        negative_risk = np.logaddexp(0, logits[u]).sum() / n_u - prior * np.logaddexp(0, logits[p]).sum() / n_p
        slope = np.zeros(len(positive))
        down = _logistic(logits)
        if negative_risk >= 0:
            slope[u] = down[u] / n_u
            slope[p] = prior * ((down[p] - 1) - down[p]) / n_p
        else:
            slope[u] = -down[u] / n_u
            slope[p] = prior * down[p] / n_p
        gradient = np.append(np.bincount(columns, values * slope[rows], minlength=n_features) + decay * weights, slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 2_000, max_unlabelled: int = 6_000, max_features: int = 4_096, members: int = 4, seed: int = 7) -> ToxicityModel:
    """Fit the model on labelled rows of ``docs`` that ``use``, a condition on the id, admits.

    The fit sees a bounded sample of labelled rows, those of lowest hash: at most
    ``max_positive`` toxic ones, and at most ``max_unlabelled`` of any kind, whose
    labels are not looked at. The class prior is the toxic share of all admitted
    labels. Features that set toxic texts apart at more than three standard errors
    are kept, the ``max_features`` strongest. Rows with a null label or id don't
    count. Without a toxic row, or features, the model scores every text alike, below
    one half.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(use) if use is not None else known
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(n_toxic / n, 1e-4), 0.9) if n else 0.5
    # nothing tells texts apart then, and none is called toxic
    constant = ToxicityModel({}, min(float(np.log(prior / (1 - prior))), -0.01) if n_toxic else -5.0)
    if not n_toxic:
        return constant
    draw = F.xxhash64("id", F.lit(seed))
    sample = known.filter("toxic = 1").orderBy(draw, "id").limit(max_positive).select("id", F.lit(True).alias("positive")).unionByName(known.orderBy(draw, "id").limit(max_unlabelled).select("id", F.lit(False).alias("positive")))
    # two rows of a few bytes for each sampled id: at most max_positive + max_unlabelled of them
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 200):
            rows, columns, values, place = WordBatch(batch.column(1)).rates(None)
            names = np.array(list(place), object)
            ids, positive = batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(2).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(positive[rows]), pa.array(names[columns], pa.string()), pa.array(values, pa.float64())], names=["id", "positive", "feature", "value"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("positive", T.BooleanType()), T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())])
    rates = stored(texts.select("id", "text", "positive").mapInArrow(extract, schema), "toxicity-features")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    in_p, in_u = F.sum(F.col("positive").cast("double")), F.sum((~F.col("positive")).cast("double"))
    counts = rates.groupBy("feature").agg(in_p.alias("p"), in_u.alias("u")).filter("p >= 3")
    share = lambda c, size: (F.col(c) + 0.5) / F.lit(float(sizes.get(size, 0) + 1))
    lift = F.log(share("p", True) / share("u", False)) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    chosen = counts.withColumn("lift", lift).filter("lift > 3").orderBy(F.desc("lift"), "feature").limit(max_features)
    names = [r["feature"] for r in chosen.select("feature").collect()]
    if not names:
        return constant
    numbered = spark.createDataFrame(pd.DataFrame({"feature": names, "column": np.arange(len(names))}))
    values = rates.join(F.broadcast(numbered), "feature").select("id", "positive", F.col("column").cast("int"), "value")
    # texts without any chosen feature count too, as rows with no entries
    entries = sample.join(values, ["id", "positive"], "left").select("id", "positive", F.coalesce("column", F.lit(-1)).alias("column"), F.coalesce("value", F.lit(0.0)).alias("value"))
    drawn = entries.withColumn("member", F.explode(F.array(*map(F.lit, range(members))))).filter(F.pmod(F.xxhash64("id", "member"), F.lit(10)) < 8)

    def fit_member(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        texts, rows = np.unique(own["id"].astype(str) + own["positive"].astype(str), return_inverse=True)
        positive = np.zeros(len(texts), bool)
        positive[rows] = own["positive"].to_numpy()
        real = own["column"].to_numpy() >= 0
        weights, bias = fit(rows[real], own["column"].to_numpy()[real], own["value"].to_numpy()[real], positive, len(names), prior, seed + int(key[0]))
        return pd.DataFrame({"column": np.arange(len(names) + 1) - 1, "weight": np.append(bias, weights)})

    fitted = drawn.groupBy("member").applyInPandas(fit_member, "column int, weight double").groupBy("column").agg(F.avg("weight").alias("weight")).collect()
    by_column = {r["column"]: r["weight"] for r in fitted}
    return ToxicityModel({name: by_column[i] for i, name in enumerate(names)}, by_column[-1])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add a score (0 to 1) and a prediction (1 from 0.5 on), under ``names``, to each row's other columns.

    Whole texts are scored, by themselves alone. A null or empty text has no
    features and gets the score of the bias.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    text_at = docs.columns.index(text_col)
    place = {f: i for i, f in enumerate(model.weights)}
    weights, bias = np.array(list(model.weights.values()), float), model.bias

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            rows, columns, values, _ = WordBatch(batch.column(text_at)).rates(place)
            logits = bias + np.bincount(rows, values * weights[columns], minlength=batch.num_rows) if len(rows) else np.full(batch.num_rows, bias)
            scores = _logistic(logits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(judge, schema)


def held_out(id_col: Column) -> Column:
    """Whether an id belongs to the fold that is kept for evaluation; a null id doesn't."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels outside the held-out fold and score every text.

    Returns a row for each row of ``docs``: the id, ``held_out``, ``score`` and
    ``predicted``. Repeated rows get the same score; whole texts are scored, however
    long; other columns are ignored; an empty table gives none.
    """
    model = train(docs, labels, ~held_out(F.col("id")), id_col, text_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that the classifier doesn't call toxic."""
    model = train(docs, labels, ~held_out(F.col("id")), id_col, text_col)
    names = fresh(docs, "own_score"), fresh(docs, "own_prediction")
    return score(docs, model, text_col, names).filter(F.col(names[1]) == 0).select(docs.columns)
