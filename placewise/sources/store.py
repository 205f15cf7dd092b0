"""A write-once store of layer cells whose contents change by one atomic rename.

``<path>/data`` holds parquet partitioned by axis, scenario, year and commit. ``<path>/commits/<number>.json`` lists the
partitions that are stored, with the commit each one comes from; the greatest number counts. A write first adds its files
under a commit name of its own, then renames its list into place. Whatever ends it before that leaves files that no list
names: readers never see them, the next write does the same partitions anew, and ``sweep`` takes them away. Of two writers
that end at the same time one finds its number taken; it looks again at what is stored and tries once more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.sources.sinks import LAYER_KEYS, TILE_PX, skip_present

COMMIT = "commit"


class LayerStore:
    """Layer cells at ``path``; a store that does not exist yet is an empty one.

    Lists hold one entry per (axis, scenario, year): a few thousand at most, which the driver reads and writes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self._hadoop.Path(f"{self.path}/{below}" if below else self.path)

    def _names(self, below: str) -> list[str]:
        at = self._at(below)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _listed(self) -> tuple[int, dict]:
        """The number and content of the latest list."""
        numbers = [int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {"schema": None, "partitions": []}
        stream = self._fs.open(self._at(f"commits/{max(numbers):08d}.json"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> bool:
        """Put a list in place under ``number``; False where another writer has taken it."""
        hidden, final = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{number:08d}.json")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        files = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            files.rename(hidden, final, options)
        except Exception as error:
            self._fs.delete(hidden, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def stored(self) -> DataFrame:
        """(axis, scenario, year, commit) of the partitions that are stored."""
        return self._keys(self._listed()[1])

    def _keys(self, content: dict) -> DataFrame:
        return self.spark.createDataFrame([tuple(p) for p in content["partitions"]], "axis string, scenario string, year int, commit string")

    def read(self) -> DataFrame:
        """The stored cells; files of commits that were never listed are pruned with their partitions."""
        content = self._listed()[1]
        if content["schema"] is None:
            raise FileNotFoundError(f"nothing is stored at {self.path}")
        schema = T.StructType.fromJson(content["schema"])
        cells = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])).parquet(f"{self.path}/data")
        listed = sorted({p[-1] for p in content["partitions"]})
        return cells.where(F.col(COMMIT).isin(listed)).drop(COMMIT)

    def _stage(self, layer: DataFrame, commit: str) -> None:
        """Write cells under ``commit``, clustered by blocks so that a bounding box prunes row groups."""
        block = [F.floor(F.col(c) / TILE_PX).alias(f"_{c}") for c in ("row", "col")]
        clustered = layer.select("*", *block).repartition(*LAYER_KEYS, "_row").sortWithinPartitions(*LAYER_KEYS, "_row", "_col", "row", "col")
        by_commit = clustered.drop("_row", "_col").withColumn(COMMIT, F.lit(commit))
        by_commit.write.mode("append").partitionBy(*LAYER_KEYS, COMMIT).parquet(f"{self.path}/data")

    def write(self, layer: DataFrame, tries: int = 5) -> int:
        """Add the partitions that are not stored yet, all or none; returns how many were added.

        Later writes must have the columns of the first one.
        """
        for _ in range(tries):
            number, content = self._listed()
            fresh = skip_present(layer, self._keys(content))
            schema = content["schema"] or json.loads(layer.schema.json())
            names = T.StructType.fromJson(schema).names
            if sorted(names) != sorted(layer.columns):
                raise ValueError(f"the store has the columns {names}")
            commit = uuid.uuid4().hex
            self._stage(fresh.select(*names), commit)
            data = self._at("data")
            added = self.spark.read.schema("axis string, scenario string, year int, commit string").parquet(data.toString()).where(F.col(COMMIT) == commit) if self._fs.exists(data) else None
            keys = [] if added is None else [tuple(r) for r in added.distinct().collect()]
            if not keys or self._publish(number + 1, {"schema": schema, "partitions": [*content["partitions"], *keys]}):
                return len(keys)
        raise RuntimeError(f"other writers took {tries} commits in a row at {self.path}")

    def sweep(self) -> int:
        """Delete the files of commits that are not listed; returns how many partitions went. Only for when no one writes."""
        listed = {p[-1] for p in self._listed()[1]["partitions"]}
        found = self._fs.globStatus(self._at("data/*/*/*/commit=*")) or []
        gone = [s.getPath() for s in found if s.getPath().getName().partition("=")[2] not in listed]
        for at in gone:
            self._fs.delete(at, True)
        return len(gone)
