"""The data model: a sparse matrix as a coordinate DataFrame and two dimension tables.

Zeros are implicit: ``coo`` (cell_id, feature_id, value) holds stored entries
only, so every per-cell or per-feature statistic starts from ``cells``
(cell_id, name) or ``features`` (feature_id, name).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountMatrix:
    coo: DataFrame
    cells: DataFrame
    features: DataFrame

    def with_coo(self, coo: DataFrame) -> "CountMatrix":
        return replace(self, coo=coo)

    def n_cells(self) -> DataFrame:
        """One row: n_cells (for a broadcast join into per-feature statistics)."""
        return self.cells.agg(F.count("*").alias("n_cells"))

    def shape(self) -> tuple[int, int]:
        return self.cells.count(), self.features.count()

    def select_features(self, keep: DataFrame) -> "CountMatrix":
        """The columns named in ``keep`` (feature_id), in any order."""
        keep = keep.select("feature_id").distinct()
        return replace(self, coo=self.coo.join(keep, "feature_id", "left_semi"), features=self.features.join(keep, "feature_id", "left_semi"))

    def select_cells(self, keep: DataFrame) -> "CountMatrix":
        keep = keep.select("cell_id").distinct()
        return replace(self, coo=self.coo.join(keep, "cell_id", "left_semi"), cells=self.cells.join(keep, "cell_id", "left_semi"))


@dataclass(frozen=True)
class CenteredMatrix:
    """``A - 1 mu'`` without densifying: scaled entries and (feature_id, mu)."""

    matrix: CountMatrix
    mu: DataFrame

    def densify(self) -> DataFrame:
        """Every (cell_id, feature_id, value) of the centred matrix."""
        m = self.matrix
        grid = m.cells.select("cell_id").crossJoin(F.broadcast(m.features.select("feature_id").join(self.mu, "feature_id")))
        full = grid.join(m.coo, ["cell_id", "feature_id"], "left")
        return full.select("cell_id", "feature_id", (F.coalesce(F.col("value"), F.lit(0.0)) - F.col("mu")).alias("value"))
