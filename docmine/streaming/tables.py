"""Tables that a stream extends batch by batch and reads as of any batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchTable:
    """Rows by key, one folder per batch under ``deltas`` and, every ``every`` batches, all of
    them folded into one under ``bases``. Folders are cut into ``parts`` by the hash of the
    key, so a batch reads the parts that its own keys lie in.

    A batch that is run again overwrites its own folder and reads what it read before: the
    deltas of smaller batches and a base of none but smaller batches. ``fold`` turns rows of
    several batches (with column ``batch``) into the rows that stand for them.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, key: list[str], fold: Callable[[DataFrame], DataFrame],
        parts: int = 64, every: int = 16,
    ):
        self.spark, self.path, self.key, self.fold, self.parts, self.every = spark, path, key, fold, parts, every
        self.columns = T.StructType.fromDDL(schema)
        self.stored = T.StructType.fromDDL(f"{schema}, delta boolean, batch bigint, part int")

    def part(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _bases(self) -> list[int]:
        """Numbers of the finished bases; a folder counts once it has its marker."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/bases")
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        found = [s.getPath() for s in system.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in found if system.exists(hadoop.Path(p, "_SUCCESS")))

    def _read(self, kind: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.stored).parquet(f"{self.path}/{kind}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.stored)

    def as_of(self, batch: int, keys: DataFrame | None = None) -> DataFrame:
        """The table's columns as of the start of a batch; with ``keys``, of parts where one
        of those lies (at most ``parts`` numbers come to the driver)."""
        bases = [b for b in self._bases() if b <= batch]
        base = bases[-1] if bases else 0
        rows = self._read("deltas").filter((F.col("batch") >= base) & (F.col("batch") < batch))
        if bases:
            rows = rows.unionByName(self._read("bases").filter(F.col("batch") == base))
        if keys is not None:
            rows = rows.filter(F.col("part").isin([r[0] for r in keys.select(self.part()).distinct().collect()]))
        # A base stands before the deltas from its number on.
        return self.fold(rows.withColumn("batch", 2 * F.col("batch") + F.col("delta").cast("int")))

    def add(self, batch: int, rows: DataFrame) -> None:
        """Store a batch's rows, then fold what came before if it is time to."""
        self._write(rows, f"deltas/batch={batch}", True)
        bases = self._bases()
        if batch - (bases[-1] if bases else 0) >= self.every:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """Fold everything before ``batch`` into one folder."""
        self._write(self.as_of(batch), f"bases/batch={batch}", False)

    def _write(self, rows: DataFrame, folder: str, delta: bool) -> None:
        named = rows.select(*self.columns.names).withColumns({"delta": F.lit(delta), "part": self.part()})
        named.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{folder}")
