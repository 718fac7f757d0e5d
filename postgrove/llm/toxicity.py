"""Toxicity by classifier chains.

The toxicity categories are predicted one after the other by linear models: each is a logistic model of all of a
document's hashed features and of the probabilities of all categories before it. In training those come from
out-of-fold predictions, so that a later model learns from values like those it will meet.

The labels name one flag only, so the categories before it are learnt: the toxic documents of the sample are parted into KINDS
kinds by the features that tell them from clean ones (k-means of directions), and the chain is kind_1 ... and, last, ``toxic``
itself, the label. Features are a document's distinct words and the first four and five letters of its longer words, A-Z and
other letters in lower case, hashed into 2**18 columns. A feature's value is how surely it is over-represented in the category (zero if chance
explains it), and the values of a document fall with the 0.3rd power of its number of features, so that chance does not add up in long
texts; the models' weights of these values are ridge-penalised.

The models are fitted on at most ``sample`` labelled documents (a parameter; the ones with the smallest hash of
the id); the whole fit and the fits without one fold each are tasks of their own. Scoring covers every document. Defined results: a null or
empty text has the probability of no evidence; without any toxic or any clean labelled document nothing is judged toxic; repeated rows get
equal results; a document labelled twice counts twice; an empty table gives an empty one; a text of any length is read whole, one at a time;
other columns go along unchanged, but for those named as the results, which give way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from postgrove.llm.common import Scratch, numbered, read_table

WORD = re.compile(r"[^\W\d_]+")
WIDTH = 1 << 18
KINDS = 3
CHAIN = (*[f"kind_{k + 1}" for k in range(KINDS)], "toxic")
FOLDS = 4
SAMPLE = 12_000
LEAST = 3  # positives that must hold a feature
LENGTH_POWER = 0.3
RIDGE = 0.1


def tokens_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:5] + "-" for w in words if len(w) > 5} | {w[:4] + "-" for w in words if len(w) > 4}


def features(text: str) -> np.ndarray:
    """Sorted distinct columns."""
    return np.unique(np.fromiter((zlib.crc32(t.encode()) & WIDTH - 1 for t in tokens_of(text)), dtype=np.int64))


def scale_of(size: np.ndarray) -> np.ndarray:
    """What the values of a document with so many features are multiplied by."""
    return (np.maximum(size, 1) / 100) ** -LENGTH_POWER


def chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Entries:
    """A sparse table of documents and features: the column and row of each entry, and how many features each document has (also such as have no entry)."""

    column: np.ndarray
    row: np.ndarray
    size: np.ndarray

    def only(self, chosen: np.ndarray) -> Entries:
        inside = chosen[self.row]
        return Entries(self.column[inside], (np.cumsum(chosen) - 1)[self.row[inside]], self.size[chosen])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=len(self.size)) * scale_of(self.size)


@dataclass
class Linear:
    """Weights of the features, slopes of the earlier categories' probabilities, and a bias."""

    weights: np.ndarray
    slopes: np.ndarray
    bias: float

    def predict(self, evidence: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return chance(evidence + earlier @ self.slopes + self.bias)


def sure_ratio(table: Entries, y: np.ndarray) -> np.ndarray:
    """Log ratio of the classes' shares of documents with a feature, less two standard errors; 0 if negative or if fewer than LEAST positives hold it."""
    hot = np.bincount(table.column, weights=y[table.row], minlength=WIDTH)
    cold = np.bincount(table.column, minlength=WIDTH) - hot
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    ratio = np.log((hot + 0.1) / (n1 + 0.2)) - np.log((cold + 0.1) / (n0 + 0.2)) - 2 * np.sqrt(1 / (hot + 0.5) + 1 / (cold + 0.5))
    return np.where(hot >= LEAST, np.maximum(ratio, 0.0), 0.0)


def fit_one(table: Entries, y: np.ndarray, earlier: np.ndarray) -> Linear:
    """The ridge-penalised logistic model, by Newton steps, each solved by conjugate gradients."""
    ratio = sure_ratio(table, y)
    told = ratio[table.column] > 0
    row, value = table.row[told], ratio[table.column[told]] * scale_of(table.size)[table.row[told]]
    columns, at = np.unique(table.column[told], return_inverse=True)
    wide, dense, n = len(columns), np.column_stack([earlier, np.ones(len(y))]), len(y)
    penalty = np.concatenate([np.full(wide, RIDGE), np.full(dense.shape[1] - 1, RIDGE), [1e-3]])

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=value * w[at], minlength=n) + dense @ w[wide:]

    def back(g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, weights=value * g[row], minlength=wide), dense.T @ g])

    w = np.zeros(len(penalty))
    for _ in range(30):
        p = chance(forward(w))
        curve, left, step = p * (1 - p) + 1e-9, -(back(p - y) + penalty * w), np.zeros(len(w))
        way, size = left.copy(), left @ left
        goal = size * 1e-3
        for _ in range(50):
            if size <= goal:
                break
            bent = back(curve * forward(way)) + penalty * way
            by = size / (way @ bent)
            step, left = step + by * way, left - by * bent
            size, before = left @ left, size
            way = left + size / before * way
        w += step
        if np.abs(step).max() < 1e-3:
            break
    weights = np.zeros(WIDTH)
    weights[columns] = w[:wide] * ratio[columns]
    return Linear(weights, w[wide:-1], float(w[-1]))


def kinds_of(table: Entries, toxic: np.ndarray) -> np.ndarray:
    """The kind of each document of the sample, 0 to KINDS-1 for toxic ones and -1 for clean ones. Kinds start from the features
    that most toxic documents not yet reached hold, and are then means of directions."""
    ratio, mine = sure_ratio(table, toxic), table.only(toxic > 0)
    told = ratio[mine.column] > 0
    row, value, n = mine.row[told], ratio[mine.column[told]], len(mine.size)
    columns, at = np.unique(mine.column[told], return_inverse=True)
    out = np.full(len(toxic), -1)
    if not len(columns):
        out[toxic > 0] = 0
        return out
    value = value / np.sqrt(np.bincount(row, weights=value**2, minlength=n))[row]
    reached, kind = np.zeros(n, dtype=bool), np.full(n, -1)
    for k in range(KINDS):
        gain = np.bincount(at, weights=value * ~reached[row], minlength=len(columns))
        new = np.unique(row[at == gain.argmax()])
        kind[new[~reached[new]]] = k
        reached[new] = True
    for _ in range(10):
        near = np.zeros((n, KINDS))
        for k in range(KINDS):
            centre = np.bincount(at, weights=value * (kind[row] == k), minlength=len(columns))
            near[:, k] = np.bincount(row, weights=value * centre[at], minlength=n) / max(1e-12, np.sqrt(centre @ centre))
        kind = near.argmax(axis=1)
    out[toxic > 0] = kind
    return out


def fit_chain(spark: SparkSession, table: Entries, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """labels: a column per category. Each model's inputs from earlier categories are predicted by models that did not see the row's fold.
    A category's fits are tasks: one of all rows, one without each fold. What they share is the sample, sent once."""
    sent = spark.sparkContext.broadcast((table, labels, folds))

    def fits_of(k: int, earlier: np.ndarray):
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, labels, folds = sent.value
            for batch in batches:
                for f in batch.column(0).to_pylist():
                    seen = folds != f  # no row is of fold FOLDS
                    m, unseen = fit_one(table.only(seen), labels[seen, k], earlier[seen]), b""
                    if f < FOLDS:
                        unseen = m.predict(table.only(~seen).times(m.weights), earlier[~seen]).tobytes()
                    at = np.flatnonzero(m.weights)
                    row = (f, at.tobytes(), m.weights[at].tobytes(), m.slopes.tobytes(), m.bias, unseen)
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["fold", "at", "weights", "slopes", "bias", "unseen"])

        return fit

    earlier, chain = np.zeros((len(folds), 0)), []
    for k in range(labels.shape[1]):
        fits = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fits_of(k, earlier), "fold long, at binary, weights binary, slopes binary, bias double, unseen binary").collect()
        unseen = np.zeros(len(folds))
        for m in fits:
            if m["fold"] < FOLDS:
                unseen[folds == m["fold"]] = np.frombuffer(m["unseen"])
            else:
                weights = np.zeros(WIDTH)
                weights[np.frombuffer(m["at"], dtype=np.int64)] = np.frombuffer(m["weights"])
                chain.append(Linear(weights, np.frombuffer(m["slopes"]), m["bias"]))
        earlier = np.column_stack([earlier, unseen])
    sent.unpersist()
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear] | None:
    """The chain from at most ``sample`` labelled documents; None without both classes."""
    flagged = labels.where("toxic IN (0, 1)").select("doc_id", "toxic")
    drawn = flagged.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "toxic").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x or "").astype("<i4").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "toxic", "features"])

    found = docs.join(drawn, "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(extract, "doc_id long, toxic int, features binary")
    with Scratch(docs.sparkSession) as scratch:  # all tasks at once, then read part by part
        got = sorted((r["doc_id"], r["toxic"], bytes(r["features"])) for r in scratch.stored(found, "sample").toLocalIterator())
    if len({r[1] for r in got}) < 2:
        return None
    rows = [np.frombuffer(r[2], dtype="<i4") for r in got]
    toxic = np.array([r[1] for r in got], dtype=float)
    # A category's documents are toxic ones, so a feature of fewer than LEAST toxic documents has no value in any model.
    held = np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if t]), minlength=WIDTH) >= LEAST
    size = np.array([len(r) for r in rows])
    rows = [r[held[r]] for r in rows]
    table = Entries(np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), size)
    kind = kinds_of(table, toxic)
    folds = np.array([zlib.crc32(str(r[0]).encode()) % FOLDS for r in got])
    return fit_chain(docs.sparkSession, table, np.column_stack([*[(kind == k).astype(float) for k in range(KINDS)], toxic]), folds)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with p_kind_1 and so on, p_toxic and ``toxic``; columns of these names in the input give way."""
    chain = train(docs.select("doc_id", "text"), labels, sample)
    names = [f"p_{c}" for c in CHAIN]
    docs = docs.drop(*names, "toxic")
    if chain is None:
        return docs.select("*", *[F.lit(0.0).alias(n) for n in names], F.lit(False).alias("toxic"))
    given = StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names), StructField("toxic", BooleanType())])
    at_text = docs.columns.index("text")
    # A model has WIDTH weights at most, whatever the corpus.
    used = np.flatnonzero(np.any([m.weights for m in chain], axis=0))
    send = docs.sparkSession.sparkContext.broadcast((used, np.column_stack([m.weights[used] for m in chain]), [(m.slopes, m.bias) for m in chain]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, told, rest = send.value
        weights = np.zeros((WIDTH, len(rest)))
        weights[used] = told
        known: dict[str, int] = {}
        for batch in batches:
            evidence = np.zeros((batch.num_rows, len(rest)))
            for i, value in enumerate(batch.column(at_text)):
                columns = set()
                for t in tokens_of(value.as_py() or ""):
                    c = known.get(t)
                    if c is None:
                        if len(known) > 500_000:
                            known.clear()
                        c = known[t] = zlib.crc32(t.encode()) & WIDTH - 1
                    columns.add(c)
                at = np.sort(np.fromiter(columns, dtype=np.int64, count=len(columns)))
                evidence[i] = weights[at].sum(axis=0) * scale_of(len(at))
            earlier = np.zeros((batch.num_rows, 0))
            for k, (slopes, bias) in enumerate(rest):
                earlier = np.column_stack([earlier, Linear(weights[:, k], slopes, bias).predict(evidence[:, k], earlier)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(earlier[:, k]) for k in range(len(CHAIN))], pa.array(earlier[:, -1] >= threshold)], [f.name for f in given])

    return numbered(docs).mapInArrow(score, given)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Category probabilities of all ``documents``, fitted on ``labels``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read_table(spark, sf_dir, "labels")).drop("text")
