"""A result table that a stream keeps up to date: micro-batches are written under
their ids, newer rows of a key replace older ones, and every so many batches the
newest rows are gathered in a snapshot, so a reader opens few files however long
the stream has run."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPACT_EVERY = 20


class KeyedTable:
    """``path`` holds ``batch=<id>`` folders, the rows that a micro-batch changed, and
    at most one ``snapshot=<id>``, the newest row of every key up to that batch.

    A batch that comes again replaces its own folder; one that a snapshot already
    holds is left out.  Snapshots are written to a hidden folder and renamed, so a
    reader never sees half of one; batches it holds are deleted afterwards."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], compact_every: int = COMPACT_EVERY) -> None:
        self.spark, self.path, self.keys, self.compact_every = spark, path.rstrip("/"), list(keys), compact_every

    def write(self, batch: DataFrame, batch_id: int) -> None:
        snapshot, _ = self._folders()
        if snapshot is not None and batch_id <= snapshot:
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        now = self.read()
        before, batches = self._folders()
        if now is None:
            return
        hidden = f"{self.path}/_snapshot-{uuid.uuid4().hex}"
        now.write.parquet(hidden)
        if not self._fs().rename(self._at(hidden), self._at(f"{self.path}/snapshot={upto}")):
            raise OSError(f"cannot put the snapshot of batch {upto} in {self.path}")
        for name in [f"batch={b}" for b in batches if b <= upto] + ([] if before is None else [f"snapshot={before}"]):
            self._fs().delete(self._at(f"{self.path}/{name}"), True)

    def read(self) -> DataFrame | None:
        """The newest row of every key; None before the first rows."""
        snapshot, batches = self._folders()
        parts = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_batch", F.lit(b))
                 for name, b in [(f"snapshot={snapshot}", snapshot)] * (snapshot is not None) + [(f"batch={b}", b) for b in batches if snapshot is None or b > snapshot]]
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"))  # a key has at most one row per batch
        return rows.withColumn("_v", F.row_number().over(newest)).where("_v = 1").drop("_v", "_batch")

    def _folders(self) -> tuple[int | None, list[int]]:
        """The last snapshot, and the batches, in order."""
        if not self._fs().exists(self._at(self.path)):
            return None, []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._at(self.path))]
        found = {k: sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{k}=(\d+)", n))) for k in ("snapshot", "batch")}
        return (found["snapshot"][-1] if found["snapshot"] else None), found["batch"]

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
