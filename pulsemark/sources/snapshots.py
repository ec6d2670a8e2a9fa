"""Tables whose state is one manifest: replace by key in a single atomic step.

A table is a folder of immutable data folders, one per write and key bucket, and of numbered manifests. A manifest names
the data folder of every bucket and the schema. A write merges the buckets that the batch touches into new data folders
and then commits by renaming its manifest to the next number; the rename fails where that number exists, and the write
starts again from the newer state. Readers take the manifest with the highest number, so they see a state from before a
write or after it, never a mix. A write that dies leaves data folders that no manifest names; ``collect_garbage`` removes
those, and the states older than the last few.

Manifests are as long as the number of buckets, so nothing that grows with the data passes through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemark.session import settle
from pulsemark.sources.store import bucket_of, upsert

ATTEMPTS = 20  # times a write starts again after losing to another


class Snapshots:
    """A table below ``path``, replaced by ``keys``; ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        root = self._path(self.path)
        self._fs = root.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._plain_rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._plain_rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    # ---- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the last; None for a table without one."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        stream = self._fs.open(self._path(self._manifest_path(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:020d}"

    def commit(self, manifest: dict) -> bool:
        """Make ``manifest`` the state that follows its version less one; False when another write was faster."""
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        try:
            self._files.rename(draft, self._path(self._manifest_path(manifest["version"])), self._plain_rename)
        except Exception as error:  # noqa: BLE001
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False
        return True

    # ---- rows

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the last."""
        state = self.manifest(version)
        if state is None:
            raise ValueError(f"no table at {self.path}")
        schema = T.StructType.fromJson(state["schema"])
        folders = sorted(set(state["folders"].values()))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def replace(self, batch: DataFrame) -> int:
        """Replace the rows of all keys in ``batch`` by its rows; returns the version that holds them."""
        stamped = settle(batch.withColumn("_bucket", bucket_of(self.keys, self.buckets)))
        touched = [str(r[0]) for r in stamped.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        for attempt in range(ATTEMPTS):
            state = self.manifest() or {"version": 0, "folders": {}, "schema": batch.schema.jsonValue(), "buckets": self.buckets}
            schema = T.StructType.fromJson(state["schema"])
            if schema.names != batch.columns or state["buckets"] != self.buckets:
                raise ValueError(f"columns {batch.columns} in {self.buckets} buckets do not fit {schema.names} in {state['buckets']}")
            held = [f"{self.path}/{state['folders'][b]}" for b in touched if b in state["folders"]]
            rows = stamped.drop("_bucket")
            if held:
                rows = upsert(self.spark.read.schema(schema).parquet(*held), rows, self.keys)
            folder = f"data/{uuid.uuid4().hex}"
            rows.withColumn("bucket", bucket_of(self.keys, self.buckets)).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            folders = {**state["folders"], **{b: f"{folder}/bucket={b}" for b in touched}}
            if self.commit({**state, "version": state["version"] + 1, "folders": folders}):
                return state["version"] + 1
            time.sleep(0.05 * attempt)
        raise RuntimeError(f"{ATTEMPTS} writes to {self.path} were overtaken")

    def collect_garbage(self, keep: int = 2) -> list[str]:
        """Remove manifests but the last ``keep``, and data folders that none of those names; returns the data folders.

        Call it when no write is under way and no reader still uses an older state.
        """
        found = self.versions()
        kept = {f.split("/")[1] for v in found[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._path(self._manifest_path(v)), False)
        gone = []
        folder = self._path(f"{self.path}/data")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = status.getPath().getName()
            if name not in kept:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        self._fs.delete(self._path(f"{self.path}/drafts"), True)
        return sorted(gone)


def incremental_run(table: Snapshots, planned: DataFrame, run, done: str = "status", good: Sequence[str] = ("OK", "SKIP_CAPACITY"), batches: int = 1) -> int:
    """Run what is planned and not yet done, batch by batch, each replaced into ``table`` in one step; returns the batches run.

    ``planned`` has the table's keys; ``run`` makes result rows (with the column ``done``) from planned keys. A run that
    stops starts again with the keys that have no finished row, and finished rows are never recomputed.
    """
    state = table.manifest()
    todo = planned
    if state is not None:
        finished = table.read().where(F.col(done).isin(*good)).select(*table.keys).distinct()
        todo = planned.join(finished, table.keys, "left_anti")
    todo = settle(todo.withColumn("_batch", F.pmod(F.xxhash64(*table.keys, F.lit("batch")), F.lit(batches))))
    ran = 0
    for b in range(batches):
        part = todo.where(F.col("_batch") == b).drop("_batch")
        if not part.isEmpty():
            table.replace(run(part))
            ran += 1
    return ran
