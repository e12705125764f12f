"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded by a score quantile.

A labelled document of quality 1 is preferred to one of quality 0. The probability that i is preferred to
j is sigmoid(w . (x_i - x_j)), so w comes from a logistic regression without intercept on feature
differences, over all pairs of a training document of quality 1 and one of quality 0. The decision threshold is
the quantile of training scores at the share of label 0.

Nothing is sampled: every labelled training document is in every pair that it can be in, and in the quantile. Pairs
are not written out. A pair's terms depend on the difference of two scores alone, and are smooth in each, so a pass of
Spark over the documents leaves sums at a few nodes of each cell of the score line (`_cells`), and pairs of
nodes stand for all pairs of documents, to about 1e-11 of a term. Newton steps take a pass each.

Null and empty texts have zeros for features and a score like others. Repeated rows and ids keep a row each, a null
doc_id too; for the fit a repeated id counts once, by its least features and lower label. Equal texts have equal
scores; equal training scores share the quantile. Without labelled documents of both classes every score is 0.5. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import arrow_schema, batch_of, checkpoint, held_out, join_bytes, mix, running, span_hashes, text_chunks

FEATURES = ("log_words", "word_bytes", "upper", "symbols", "exclaims", "bars", "repeats_previous", "repeated_words", "repeated_pairs", "digits", "stops", "commas", "lines", "beyond_ascii", "capitalised")
THRESHOLD = 0.3
PENALTY = 1e-3  # ridge on the weights of differences scaled to unit variance
WIDTH = 0.5  # of a cell of the score line; a sigmoid's nearest pole is pi away
_NODES = np.cos((np.arange(8) + 0.5) * np.pi / 8)  # Chebyshev nodes of a cell, -1 to 1
_TO_NODES = np.linalg.inv(chebvander(_NODES, len(_NODES) - 1))
_UPPER_HALF = np.triu_indices(len(FEATURES) + 1)


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[np.frombuffer(chars.encode(), np.uint8)] = True
    return m


_SPACE = _mask(" \t\n\v\f\r")
_UPPER, _LOWER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz")
_HIGH = np.arange(256) >= 128
_COUNTED = {"upper": _UPPER, "letters": _UPPER | _LOWER | _HIGH, "symbols": _mask("*&%$#@^~`{}[]<>\\|=+_"), "exclaims": _mask("!?"), "bars": _mask("|"), "digits": _mask("0123456789"), "stops": _mask(".:;"), "commas": _mask(","), "lines": _mask("\n"), "beyond_ascii": _HIGH}


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts give zeros. A row depends on its own text alone."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in text_chunks(texts):
        data, bounds = join_bytes(texts[a:b])
        n = b - a
        first = bounds[:-1]
        size = np.maximum(np.diff(bounds) - 1, 1)
        c = {k: np.add.reduceat(m[data], first, dtype=np.int64) for k, m in _COUNTED.items()}
        inside = ~_SPACE[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = span_hashes(data, starts, ends)
        doc = np.searchsorted(bounds, starts, "right") - 1
        n_words = np.bincount(doc, minlength=n)
        some = np.maximum(n_words, 1)
        same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
        salt = mix(doc.astype(np.uint64) + np.uint64(1))
        first_of = lambda keys, of: np.bincount(of[np.unique(keys, return_index=True)[1]], minlength=n)
        distinct = first_of(words ^ salt, doc)
        pairs = (words[:-1] * np.uint64(3) + mix(words[1:]))[same]
        n_pairs = np.bincount(doc[1:][same], minlength=n)
        distinct_pairs = first_of(pairs ^ salt[1:][same], doc[1:][same])
        again = np.bincount(doc[1:][same & (words[1:] == words[:-1])], minlength=n)
        letters = np.maximum(c["letters"], 1)
        out[a:b] = np.stack([
            np.log1p(n_words), (size - (c["lines"] - 1)) / some * (n_words > 0), c["upper"] / letters, c["symbols"] / size, c["exclaims"] / size, c["bars"] / some,
            again / some, 1 - distinct / some, 1 - distinct_pairs / np.maximum(n_pairs, 1), c["digits"] / size, c["stops"] / some, c["commas"] / some,
            (c["lines"] - 1) / some, c["beyond_ascii"] / size, np.bincount(doc[_UPPER[data[starts]]], minlength=n) / some,
        ], axis=1)
        out[a:b][n_words == 0] = 0
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of each document."""
    ddl = "doc_id long, x array<double>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield batch_of(schema, [b.column(0), list(features(b.column(1).to_pylist()))])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def _training(x: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality 0 or 1, x) of every labelled training document.

    Null ids or qualities are left out; a document labelled more than once takes the lower label.
    """
    train = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    train = train.select("doc_id", (F.col("quality") > 0).cast("int").alias("quality"))
    return checkpoint(x.where("doc_id is not null").join(train, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("quality", "x"))


def _cells(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> list:
    """(quality, cell, sums) of each cell that holds scores w . z, z = (x - centre) / scale, of that quality.

    With u = (1, z): `sums` holds, for each node of the cell, the sum of u weighted by the polynomial that is 1 there and 0
    at the cell's other nodes; then the upper half of the sum of u u^T.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    ddl = "quality int, cell long, sums array<double>"
    schema = arrow_schema(ddl)

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                z = (b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) - centre) / scale
                u = np.column_stack([np.ones(len(z)), z])
                at = z @ w / WIDTH
                cell = np.floor(at)
                node = chebvander(2 * (at - cell) - 1, len(_NODES) - 1) @ _TO_NODES
                keys, place = np.unique(np.stack([b.column(0).to_numpy(), cell.astype(np.int64)]), axis=1, return_inverse=True)
                for k, key in enumerate(keys.T.tolist()):
                    i = np.flatnonzero(place.ravel() == k)
                    total[tuple(key)] = total.get(tuple(key), 0) + np.concatenate([(node[i].T @ u[i]).ravel(), (u[i].T @ u[i])[_UPPER_HALF]])
        if total:
            yield batch_of(schema, [[q for q, _ in total], [c for _, c in total], list(total.values())])

    sums = rows.select("quality", "x").mapInArrow(run, ddl).groupBy("quality", "cell").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return sums.collect()  # a row of 264 numbers for each cell that holds scores


def _side(cells: list, quality: int) -> tuple[np.ndarray, ...]:
    """Of one class: node scores and sums of u there; middles of cells and sums of u u^T there."""
    mine = sorted((r["cell"], r["sums"].toArray()) for r in cells if r["quality"] == quality)
    middle = (np.array([c for c, _ in mine]) + 0.5) * WIDTH
    k = len(FEATURES) + 1
    square = np.zeros((len(mine), k, k))
    square[:, *_UPPER_HALF] = [v[len(_NODES) * k :] for _, v in mine]
    square += np.triu(square, 1).transpose(0, 2, 1)
    nodes = (middle[:, None] + _NODES * WIDTH / 2).ravel()
    return nodes, np.array([v[: len(_NODES) * k] for _, v in mine]).reshape(-1, k), middle, square


def _objective(cells: list, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs with the penalty, its gradient, and its curvature as if scores stood in the middle of cells."""
    at1, u1, middle1, square1 = _side(cells, 1)
    at0, u0, middle0, square0 = _side(cells, 0)
    pairs = square1[:, 0, 0].sum() * square0[:, 0, 0].sum()
    loss, gradient, curvature = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    step = 32  # cells of class 1 that meet all of class 0 at once
    for i in range(0, len(middle1), step):
        n = slice(i * len(_NODES), (i + step) * len(_NODES))
        away = at0 - at1[n, None]
        p = np.exp(-np.logaddexp(0, -away))
        loss += u1[n, 0] @ np.logaddexp(0, away) @ u0[:, 0]
        gradient += (u1[n, 0] @ p) @ u0[:, 1:] - (p @ u0[:, 0]) @ u1[n, 1:]
        away, s = middle0 - middle1[i : i + step, None], square1[i : i + step]
        v = np.exp(-np.logaddexp(0, -away) - np.logaddexp(0, away))
        crossed = s[:, 0, 1:].T @ v @ square0[:, 0, 1:]
        curvature += np.tensordot(v @ square0[:, 0, 0], s[:, 1:, 1:], 1) + np.tensordot(s[:, 0, 0] @ v, square0[:, 1:, 1:], 1) - crossed - crossed.T
    return loss / pairs + PENALTY * w @ w / 2, gradient / pairs + PENALTY * w, curvature / pairs + PENALTY * np.eye(len(w))


def _weights(rows: DataFrame, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Newton steps, halved while the loss rises, until they are below 1e-8 of the weights."""
    w, step, last = np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), np.inf
    for _ in range(100):
        loss, gradient, curvature = _objective(_cells(rows, centre, scale, w), w)
        if loss > last + 1e-10:
            step = step / 2
            w = w - step
            continue
        step = -np.linalg.solve(curvature, gradient)
        last, w = loss, w + step
        if np.abs(step).max() <= 1e-8 * (1 + np.abs(w).max()):
            return w
    raise RuntimeError("weights did not settle")


def _linear(w: np.ndarray):
    """w . x as a column: added in one order, so that equal features have equal scores."""
    return sum((F.col("x")[k] * float(v) for k, v in enumerate(w)), F.lit(0.0))


def learn(x: DataFrame, labels: DataFrame) -> dict:
    """{"w", "tau"}: Bradley-Terry weights of the features (doc_id, x), and the score at the quantile. Without two classes, w is 0."""
    rows = _training(x, labels)
    entries = [F.col("x")[k] for k in range(len(FEATURES))]
    found = rows.groupBy("quality").agg(F.count("*").alias("n"), F.array([F.avg(e) for e in entries]).alias("mean"), F.array([F.var_pop(e) for e in entries]).alias("spread")).collect()
    if len(found) < 2:
        return {"w": np.zeros(len(FEATURES)), "tau": 0.0, "flat": True}
    n, (mean0, mean1) = {r["quality"]: r["n"] for r in found}, (np.array(r["mean"]) for r in sorted(found, key=lambda r: r["quality"]))
    scale = np.sqrt(sum(np.array(r["spread"]) for r in found) + (mean1 - mean0) ** 2)  # of the differences over all pairs
    w = _weights(rows, (mean0 + mean1) / 2, np.where(scale > 0, scale, 1)) / np.where(scale > 0, scale, 1)
    ranked = running(rows.groupBy(_linear(w).alias("s")).agg(F.count("*").alias("n")), [], [F.col("s")], before="n")
    # the scores of rank n[0] and n[0] + 1
    low, high = ranked.agg(F.max(F.when(F.col("before") < n[0], F.col("s"))), F.max(F.when(F.col("before") <= n[0], F.col("s")))).first()
    return {"w": w, "tau": (low + high) / 2, "flat": False}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """The model of `learn`, from texts."""
    return learn(with_features(docs), labels)


def scored(x: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted) of (doc_id, x): sigmoid of the distance to the quantile, moved so that the quantile scores 0.3."""
    tau = float(model["tau"])
    away = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("s") - tau))
    p = 1 / (1 + F.exp(-(away + float(np.log(THRESHOLD / (1 - THRESHOLD))))))
    p = F.when(F.col("s") >= tau, F.greatest(p, F.lit(THRESHOLD))).otherwise(p)  # whatever rounding does to the quantile itself
    x = x.select("doc_id", _linear(model["w"]).alias("s")).select("doc_id", (F.lit(0.5) if model["flat"] else p).alias("score"))
    return x.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted) of each document."""
    return scored(with_features(docs), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = checkpoint(with_features(spark.read.parquet(f"{sf_dir}/documents.parquet")))  # each text is read once
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(x, learn(x, labels)).select("doc_id", held_out().alias("held_out"), "score", F.col("predicted").cast(T.IntegerType()))
