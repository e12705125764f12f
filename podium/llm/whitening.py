"""Embedding whitening from the covariance of the distinct vectors, each weighted by one or by its multiplicity.

Entries c become whole numbers x = floor(64 c) + 1000000. Equal x vectors are grouped, which gives the fit list: each
distinct vector once, with its count. Its weighted sums are exact. The covariance is a product of centred blocks
(weights times values, transposed, times values): each task adds up its own blocks and hands over one matrix, a row
for each dimension, and these are added by row. The driver gets the d x d matrix alone and takes its eigenvectors;
their largest entry is made positive. Every distinct vector is whitened once, and rows get theirs by a join.

Defined results: rows whose vector is null, or holds a null, a NaN or an infinity, go; null and repeated ids are rows
like others; vectors of different lengths are tables of their own, each with its fit list; a vector without entries
has no components; entries beyond 2^62 / 64 count as that; `deviation` is null where it does not fit a long. A
component without variance (its eigenvalue is not above 10^-13 of the trace) has explained 0 and whitened null, and is
left out of identity_error, which is null if all are. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of, checkpoint

STEP, OFFSET, COMPONENTS, NONE = 64, 1_000_000, 16, 1e-13
#: The driver takes the eigenvectors of a matrix of so many rows at most (8 bytes times its square).
MAX_DIMENSIONS = 8192


def whole(table: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x array of longs) of the rows whose vectors can be used."""
    usable = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.greatest(F.least(c.cast("double") * STEP, F.lit(2.0**62)), F.lit(-(2.0**62)))
    return table.where(F.col(column).isNotNull() & usable).select(F.col(vec_id).alias("vec_id"), F.transform(column, lambda c: F.floor(scaled(c)) + OFFSET).alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The fit list: (x, n) with each x's multiplicity. Copies meet as counts, so a vector of many copies is a row a task. Written once."""
    return checkpoint(rows.groupBy("x").agg(F.count("*").alias("n")))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def exact_sums(fit: DataFrame, dimensions: int, weight: str = "one") -> tuple[int, list[int]]:
    """The sum of the weights, and of each dimension times them, as whole numbers of any size."""
    ddl = "i int, s string"
    schema = arrow_schema(ddl)

    def run(batches):
        total, sums = 0, np.zeros(dimensions, object)
        for b in batches:
            if not b.num_rows:
                continue
            x, w = _matrix(b.column(0), dimensions), b.column(1).to_numpy(zero_copy_only=False)
            total += int(w.sum())
            if np.abs(x).astype(float).max() * float(w.sum()) < 2.0**62:
                sums = sums + (x * w[:, None]).sum(axis=0).astype(object)
            else:
                sums = sums + (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
        if total:
            yield batch_of(schema, [list(range(-1, dimensions)), [str(total), *map(str, sums)]])

    w = F.lit(1).cast("long") if weight == "one" else F.col("n")
    got = fit.select("x", w.alias("w")).mapInArrow(run, ddl).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    of = {r["i"]: int(r["s"]) for r in got}
    return of[-1], [of[i] for i in range(dimensions)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S as whole numbers: 64 bits wide where they fit, else Python's."""
    base = sums[0] // n if sums else 0  # both sides less the same number, so that products stay small
    rest = [s - n * base for s in sums]
    if x.size and max(float(np.abs(x - base).max()) * n, max(map(abs, rest))) < 2.0**62:
        return (x - base) * n - np.array(rest, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def covariance(rows: DataFrame, column: str, dimensions: int, total: int, centre: Callable[[np.ndarray], np.ndarray], weight: str = "one") -> np.ndarray:
    """sum(w c c') / total over rows, c = centre(values), by centred blocks; only the matrix reaches the driver."""
    ddl = "i int, task int, row array<double>"
    schema = arrow_schema(ddl)

    def run(batches):
        from pyspark import TaskContext

        sum_, some = np.zeros((dimensions, dimensions)), False
        for b in batches:
            if b.num_rows:
                c, w = centre(_matrix(b.column(0), dimensions)), b.column(1).to_numpy(zero_copy_only=False)
                sum_ += (c * w[:, None]).T @ c
                some = True
        if some:
            yield batch_of(schema, [list(range(dimensions)), [TaskContext.get().partitionId()] * dimensions, list(sum_)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each task
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf.sort_values("task")["row"].to_list()), axis=0)]})

    w = F.lit(1).cast("long") if weight == "one" else F.col("n")
    got = rows.select(column, w.alias("weight")).mapInArrow(run, ddl).groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    out = np.zeros((dimensions, dimensions))
    for r in got:
        out[r["i"]] = r["row"]
    return out / total


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and, in columns, unit eigenvectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * np.where(signs == 0, 1.0, signs)


def whitened_vectors(fit: DataFrame, dimensions: int, most: int = COMPONENTS, weight: str = "one") -> tuple[DataFrame, dict]:
    """(x, n, deviation, whitened array) of each distinct vector, and the fit: n, explained shares, identity_error. fit: distinct_vectors of one length."""
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions; the driver takes at most {MAX_DIMENSIONS}")
    n, sums = exact_sums(fit, dimensions, weight)
    v = covariance(fit, "x", dimensions, n, lambda x: (centred(x, n, sums) / n).astype(float), weight)
    values, vectors = components(v, most)
    trace = float(np.trace(v))
    there = values > NONE * trace
    scale = vectors[:, there] / np.sqrt(values[there])
    ddl = "x array<bigint>, n bigint, deviation bigint, whitened array<double>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = centred(_matrix(b.column(0), dimensions), n, sums)
            w = np.full((b.num_rows, len(values)), np.nan)
            w[:, there] = (d / n).astype(float) @ scale
            about = np.sqrt((d.astype(float) ** 2).sum(axis=1)).max()
            if about < 2.0**31:
                exact = (d * d).sum(axis=1).tolist()
            else:
                exact = [e if e < 2**63 else None for e in (d.astype(object) ** 2).sum(axis=1)]
            yield batch_of(schema, [b.column(0), b.column(1), exact, list(w)])

    out = checkpoint(fit.select("x", "n").mapInArrow(run, ddl))
    error = None
    if there.any():
        kept = [int(k) for k in np.flatnonzero(there)]
        part = out.select(F.array(*[F.get("whitened", F.lit(k)) for k in kept]).alias("w"), "n")
        by = F.lit(1) if weight == "one" else F.col("n")
        means = np.array(part.agg(*[(F.sum(F.get("w", F.lit(k)) * by) / F.sum(by)) for k in range(len(kept))]).first(), float)
        error = float(np.abs(covariance(part, "w", len(kept), n, lambda w: w - means, weight) - np.eye(len(kept))).max())
    return out, {"n": n, "explained": [float(e) / trace if t else 0.0 for e, t in zip(values, there, strict=True)], "identity_error": error}


def whiten(table: DataFrame, most: int = COMPONENTS, weight: str = "one", vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable row and component. weight: one, or count for the multiplicity."""
    rows = whole(table, vec_id, column)
    fit = distinct_vectors(rows)
    lengths = sorted(r[0] for r in fit.select(F.size("x").alias("d")).distinct().collect() if r[0])
    kind = table.schema[vec_id].dataType.simpleString()
    if not lengths:
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    parts = []
    for d in lengths:
        own = lambda df: df if len(lengths) == 1 else df.where(F.size("x") == d)  # noqa: B023, E731
        vectors, about = whitened_vectors(own(fit), d, most, weight)
        each = own(rows).join(vectors.withColumnRenamed("n", "copies"), "x").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "w"))
        parts.append(each.select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(about["n"]).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
            F.get(F.array(*map(F.lit, about["explained"])), F.col("at")).alias("explained"), F.lit(about["identity_error"]).cast("double").alias("identity_error"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
