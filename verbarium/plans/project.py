"""A project: numbered generations of named tables, each with a manifest that is renamed into place last.

A generation counts only if its manifest is there and every table it names has the rows it says; recovery opens the
newest one that does. Any file system that Spark writes to will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbarium.sources.text import canonical_json


class Project:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Numbers of all committed generations."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit())

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes a new generation: tables first, then the manifest, then one rename that makes it visible."""
        number = (self.generations() or [0])[-1] + 1
        draft, place = f"{self.root}/draft-{number}", f"{self.root}/gen-{number}"
        self._fs.delete(self._path(draft), True)
        rows = {}
        for name, df in sorted(tables.items()):
            df.write.parquet(f"{draft}/{name}")
            rows[name] = self.spark.read.parquet(f"{draft}/{name}").count()
        self.spark.createDataFrame([(canonical_json(rows),)], "value string").coalesce(1).write.text(f"{draft}/manifest")
        if not self._fs.rename(self._path(draft), self._path(place)):
            raise OSError(f"generation {number} was committed by another writer")
        return number

    def manifest(self, number: int) -> dict[str, int]:
        import json

        return json.loads(self.spark.read.text(f"{self.root}/gen-{number}/manifest").first().value)

    def valid(self, number: int) -> bool:
        try:
            return all(self.read(number, name).count() == rows for name, rows in self.manifest(number).items())
        except Exception:  # a damaged generation may fail in any way; it is skipped, not repaired
            return False

    def recover(self) -> int | None:
        """The newest generation that is whole."""
        return next((g for g in reversed(self.generations()) if self.valid(g)), None)

    def read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/gen-{number}/{name}")
