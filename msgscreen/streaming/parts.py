"""Tables that micro-batches write: numbered parts and a commit record.

A batch writes its parts (``<name>/batch=<n>``, each overwritten if the batch is
repeated) and then, last, its commit record. Readers see committed batches
only, so several tables change together, and a batch that died in between
leaves nothing behind that counts. All paths are in a folder the cluster shares.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Parts:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._jvm.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def part(self, name: str, n: int) -> str:
        return f"{self.path}/{name}/batch={n}"

    def write(self, df: DataFrame, name: str, n: int) -> DataFrame:
        """Write a part and return it as read back."""
        df.write.mode("overwrite").parquet(self.part(name, n))
        return self.spark.read.schema(df.schema).parquet(self.part(name, n))

    def commits(self) -> list[int]:
        """The committed batches in order."""
        return [n for n in sorted(int(x.removeprefix("batch=")) for x in self._names("commits") if x.startswith("batch=")) if self.committed(n)]

    def last(self, before: int | None = None) -> int | None:
        """The latest committed batch (of those before ``before``)."""
        return max((n for n in self.commits() if before is None or n < before), default=None)

    def committed(self, n: int) -> bool:
        """Whether batch ``n`` has its record: then a repetition has nothing to do."""
        return self._fs.exists(self._jvm.Path(f"{self.part('commits', n)}/_SUCCESS"))

    def record(self, n: int) -> dict:
        return json.loads(self.spark.read.text(self.part("commits", n)).first()[0])

    def commit(self, n: int, **record) -> None:
        text = self.spark.createDataFrame([(json.dumps(record),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(self.part("commits", n))

    def read(self, name: str, schema: str, batches: list[int] | None = None) -> DataFrame:
        """The committed parts of a table (or those of ``batches``), with a column ``batch``."""
        known = self.commits() if batches is None else batches
        held = set(self._names(name))
        paths = [self.part(name, n) for n in known if f"batch={n}" in held]
        whole = f"{schema}, batch int"
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(whole).parquet(*paths) if paths else self.spark.createDataFrame([], whole)

    def drop(self, name: str, upto: int) -> None:
        """Remove the parts of batches up to ``upto``."""
        for x in self._names(name):
            if x.startswith("batch=") and int(x.removeprefix("batch=")) <= upto:
                self._fs.delete(self._jvm.Path(f"{self.path}/{name}/{x}"), True)


def ddl(df: DataFrame) -> str:
    """The schema as a string that :meth:`Parts.read` takes."""
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def start(stream: DataFrame, step, checkpoint: str, mode: str = "append", available_now: bool = True, every: str = "30 seconds"):
    w = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
