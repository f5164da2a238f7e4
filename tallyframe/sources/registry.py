"""A registry of named data sets: rows of (collection, name, file, url), resolved to local copies.

Collections are added by the user from any table with those columns; nothing
is downloaded here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import CountMatrix
from .errors import LayoutError
from .files import read_data
from .text_formats import exists

SCHEMA = "collection string, name string, file string, url string"


@dataclass(frozen=True)
class Registry:
    entries: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "Registry":
        return cls(spark.createDataFrame([], SCHEMA))

    def add(self, rows: DataFrame) -> "Registry":
        """The registry with more entries; a repeated (collection, name) is an error when it is resolved."""
        return Registry(self.entries.unionByName(rows.select("collection", "name", "file", "url")))

    def collections(self) -> DataFrame:
        """(collection, n_datasets)."""
        return self.entries.groupBy("collection").agg(F.count("*").alias("n_datasets"))

    def datasets(self, collection: str) -> DataFrame:
        return self.entries.filter(F.col("collection") == collection).select("name", "file", "url")

    def dataset(self, collection: str, name: str, cache: str, **kw) -> CountMatrix:
        """The data set's local copy under ``cache``; a missing copy is an error that names its address."""
        found = self.entries.filter((F.col("collection") == collection) & (F.col("name") == name)).limit(2).collect()
        if len(found) != 1:
            raise LayoutError(f"{len(found) or 'no'} data set {name} in {collection}")
        path = f"{cache}/{collection}/{found[0].file}"
        if not exists(self.entries.sparkSession, path):
            raise LayoutError(f"{path} is missing; fetch {found[0].url}")
        return read_data(self.entries.sparkSession, path, **kw)
