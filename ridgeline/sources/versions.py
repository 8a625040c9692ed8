"""Tables that change by whole partitions, each change at once or not at all.

A change writes new folders beside the old ones and then adds one small commit, a file that names the folder of every
partition. Readers follow the last commit, so they never meet a half-made table, and a writer that fails before its
commit leaves nothing but folders that no commit names (``vacuum`` deletes them). A commit also holds the last batch
of every stream that writes, so a batch that is replayed after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """Rows of ``schema`` in ``path``, one folder per value of the column ``by`` (a date or a plain text)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str, kind: str = "parquet"):
        self.spark, self.path, self.schema, self.by, self.kind = spark, path.rstrip("/"), schema, by, kind
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def _names(self, *names: str) -> list[str]:
        at = self._at(*names)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _last(self) -> str | None:
        return next((n for n in reversed(self._names("commits")) if n.endswith(".json")), None)

    def state(self) -> dict[str, Any]:
        """``version`` (0: nothing yet), ``parts`` (folder of each partition) and ``batches`` (the last of each writer)."""
        last = self._last()
        if last is None:
            return {"version": 0, "parts": {}, "batches": {}}
        with_text = self.spark.read.text(str(self._at("commits", last)), wholetext=True)
        return json.loads(with_text.first().value)

    def read(self, only: list | None = None) -> DataFrame:
        """All rows as of the last commit; with ``only``, those of some partitions, and no other folder is opened."""
        parts = self.state()["parts"]
        wanted = sorted(parts) if only is None else sorted(p for p in {f"_part={v}" for v in only} if p in parts)
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        reader = reader.option("header", True) if self.kind == "csv" else reader
        return reader.format(self.kind).load([str(self._at("data", parts[p], p)) for p in wanted])

    def seen(self, writer: str | None, batch: int | None) -> bool:
        return writer is not None and self.state()["batches"].get(writer, -1) >= batch

    def replace(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Put ``rows`` in the place of the partitions that they are of; others stay. False if ``writer`` has committed
        ``batch`` before. Two writers at once: the later commit fails and changes nothing."""
        if self.seen(writer, batch):
            return False
        before, folder = self.state(), uuid.uuid4().hex
        out = rows.select(*self.schema.fieldNames()).withColumn("_part", F.col(self.by)).hint("rebalance", "_part").write.partitionBy("_part")
        (out.option("header", True) if self.kind == "csv" else out).format(self.kind).save(str(self._at("data", folder)))
        new = {n: folder for n in self._names("data", folder) if n.startswith("_part=")}
        batches = before["batches"] | ({writer: batch} if writer is not None else {})
        self._commit(before["version"] + 1, {"version": before["version"] + 1, "parts": before["parts"] | new, "batches": batches})
        return True

    def _commit(self, version: int, state: dict[str, Any]) -> None:
        self._fs.mkdirs(self._at("commits"))
        draft, final = self._at("commits", f"{uuid.uuid4().hex}.draft"), self._at("commits", f"{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, final, none)  # fails where that version exists

    def vacuum(self) -> int:
        """Delete the folders that the last commit doesn't name, and all commits before it; returns how many folders.
        Not while others write or read older commits."""
        last, used = self._last(), set(self.state()["parts"].values())
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self._fs.delete(self._at("data", n), True)
        for n in self._names("commits"):
            if n != last:
                self._fs.delete(self._at("commits", n), False)
        return len(gone)
