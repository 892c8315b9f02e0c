"""PCA to explained-variance thresholds: one distributed fit, prefix scores per threshold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PCA_THRESHOLDS
from . import matrix
from .blocks import Shaped, map_blocks
from .splits import ChunkSplit


def pca_name(base: str, threshold: float) -> str:
    return f"{base}_pca{round(100 * threshold)}"


def components_for(explained: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """First number of components whose running explained share reaches each threshold.

    ``explained`` is (comp, share), one record per matrix column. A threshold never reached
    gets all components.
    """
    running = explained.withColumn(
        "cumulative",
        F.sum("share").over(Window.orderBy("comp").rowsBetween(Window.unboundedPreceding, 0)),
    )
    wanted = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.min(F.when(F.col("cumulative") >= F.col("threshold"), F.col("comp")))
    return (
        running.withColumn("threshold", F.explode(wanted))
        .groupBy("threshold")
        .agg(F.coalesce(reached, F.max("comp")).cast("int").alias("n_components"))
    )


@dataclass
class PcaModel:
    base: str
    mean: np.ndarray
    components: np.ndarray            # (k, width), largest variance first
    explained: np.ndarray             # share of all the variance, per component of the input
    sizes: dict[float, int]
    score_mean: np.ndarray | None = None
    score_std: np.ndarray | None = None
    keep_failed_missing: bool = False

    def project(self, block: np.ndarray) -> np.ndarray:
        clean = np.nan_to_num(block, nan=0.0, posinf=0.0, neginf=0.0)
        return (clean - self.mean) @ self.components.T

    def scores(self, block: np.ndarray) -> np.ndarray:
        out = (self.project(block) - self.score_mean) / self.score_std
        if self.keep_failed_missing:
            out[~np.isfinite(block).any(axis=1)] = np.nan
        return out

    def transform(self, df: DataFrame, threshold: float) -> DataFrame:
        """z-scored scores of the components that reach ``threshold``."""
        k = self.sizes[threshold]
        return map_blocks(df, lambda b: self.scores(b)[:, :k], self.mean.size)

    def summary(self, spark) -> DataFrame:
        total = np.cumsum(self.explained)
        rows = [
            (pca_name(self.base, t), self.base, t, k, float(total[k - 1]))
            for t, k in sorted(self.sizes.items())
        ]
        return spark.createDataFrame(
            rows, "name string, base string, threshold double, n_components int, "
            "cumulative_explained_variance double",
        )


def fit_pca_targets(
    df: DataFrame,
    split: ChunkSplit,
    base: str,
    thresholds: Sequence[float] = PCA_THRESHOLDS,
    keep_failed_missing: bool = False,
) -> PcaModel:
    """Fit on all train rows (missing as zero), z-score the scores on train rows.

    The covariance is summed where the rows are; only the width x width result is decomposed
    on the driver. A component's largest loading is made positive, as its sign is free.
    """
    width = matrix.matrix_width(df)
    train = split.train(df.select("row_id", "features"))
    filled = Shaped(train, width, width, lambda x: np.where(np.isfinite(x), x, 0.0))
    n, mean, _ = matrix.block_moments(filled, width)
    covariance = matrix.gram_matrix(matrix.gram_tiles(filled, width, mean, np.ones(width), n), width) / max(n - 1, 1)
    variance, vectors = np.linalg.eigh(covariance)
    variance, vectors = np.clip(variance[::-1], 0, None), vectors[:, ::-1].T
    rank = min(n, width)
    explained = variance[:rank] / variance.sum()
    total = np.cumsum(explained)
    sizes = {
        float(t): min(int(np.searchsorted(total, t)) + 1, rank) for t in thresholds
    }
    components = vectors[: max(sizes.values())]
    peak = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(len(components)), peak])[:, None]
    model = PcaModel(base, mean, components, explained, sizes, keep_failed_missing=keep_failed_missing)
    projected = Shaped(train, width, len(components), model.project)
    _, model.score_mean, model.score_std = matrix.block_moments(projected, len(components))
    return model


def explained_table(spark, model: PcaModel) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, float(s)) for i, s in enumerate(model.explained)], "comp int, share double"
    )
