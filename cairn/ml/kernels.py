"""Kernel maps and factor analysis on feature arrays; models are small matrices, rows go through numpy in batches."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _map(df: DataFrame, function) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf = pdf.assign(feats=list(function(np.nan_to_num(np.stack(pdf["feats"].to_numpy()).astype(float)))))
            yield pdf

    return df.mapInPandas(run, df.schema)


def random_fourier(df: DataFrame, dims: int, gamma: float = 0.2, components: int = 100, seed: int = 1) -> DataFrame:
    """feats -> sqrt(2 / D) cos(W x + b), which approximates the kernel exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (dims, components)), rng.uniform(0, 2 * np.pi, components)
    return _map(df, lambda x: np.cos(x @ w + b) * np.sqrt(2 / components))


def nystroem(df: DataFrame, gamma: float = 5.0, components: int = 100, seed: int = 1) -> DataFrame:
    """feats -> kernel values at landmarks (rows with the smallest hashes) whitened by their own kernel matrix."""
    rows = df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(components).select("feats").collect()
    marks = np.nan_to_num(np.array([r["feats"] for r in rows], float))
    kernel = lambda x: np.exp(-gamma * np.maximum(0, (x**2).sum(1)[:, None] + (marks**2).sum(1)[None, :] - 2 * x @ marks.T))
    u, s, v = np.linalg.svd(kernel(marks))
    white = (u / np.sqrt(np.maximum(s, 1e-12))) @ v
    return _map(df, lambda x: kernel(x) @ white.T)


def covariance_matrix(df: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of feats, NaN and null as 0.

    One pass in Arrow batches sums rows and outer products about the values of some row, so that large means cancel.
    Each partition gives one row for each sum; these are added before the driver gets 1 + dims + dims * dims of them.
    """
    cells = (F.coalesce(F.nanvl(F.get("feats", F.lit(i)).cast("double"), F.lit(0.0)), F.lit(0.0)) for i in range(dims))
    rows = df.select(F.array(*cells).alias("feats"))
    first = rows.first()
    if first is None:
        return np.zeros(dims), np.zeros((dims, dims))
    about = np.array(first["feats"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dims) - about
            n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        if n:
            values = np.concatenate([[float(n)], one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    total = np.zeros(1 + dims + dims * dims)
    for r in rows.mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    mean = total[1 : 1 + dims] / total[0]
    return about + mean, total[1 + dims :].reshape(dims, dims) / total[0] - np.outer(mean, mean)


def factor_model(cov: np.ndarray, components: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (components x dims) and noise variances by expectation maximisation on the covariance matrix."""
    dims = len(cov)
    noise = np.maximum(np.diag(cov).copy(), 1e-9)
    values, vectors = np.linalg.eigh(cov)
    load = (vectors[:, ::-1][:, :components] * np.sqrt(np.maximum(values[::-1][:components], 1e-9))).T
    for _ in range(steps):
        beta = np.linalg.solve(np.eye(components) + (load / noise) @ load.T, load / noise)
        second = np.eye(components) - beta @ load.T + beta @ cov @ beta.T
        load = np.linalg.solve(second, beta @ cov)
        noise = np.maximum(np.diag(cov - load.T @ beta @ cov), 1e-9)
    return load.reshape(components, dims), noise


def factor_analysis(df: DataFrame, dims: int, components: int) -> DataFrame:
    """feats -> expected factors of each row."""
    mean, cov = covariance_matrix(df, dims)
    load, noise = factor_model(cov, components)
    beta = np.linalg.solve(np.eye(components) + (load / noise) @ load.T, load / noise)
    return _map(df, lambda x: (x - mean) @ beta.T)
