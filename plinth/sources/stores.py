"""Stores as tables: a key-value store and an artifact cache.

Both append: a write adds rows under a new version, a read takes each key's last.
Appending needs no locks and no rewriting, and :meth:`compact` folds versions when
they have grown.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a listing or a printed report shows at most; tables hold all.
LISTED = 10_000
SCHEMA = "store_key string, version long, tie string, created_at long, deleted boolean, payload string"


class KvStore:
    """Values as JSON under a path; a value that is no JSON is returned as it was written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self) -> DataFrame:
        """``store_key, payload, created_at, updated_at`` of the keys that are there; creation is that of the first write since a delete."""
        last = self._rows().groupBy("store_key").agg(F.max(F.struct("version", "tie", "created_at", "deleted", "payload")).alias("m"))
        return last.where("not m.deleted").select("store_key", F.col("m.payload").alias("payload"), F.col("m.created_at").alias("created_at"), F.col("m.version").alias("updated_at"))

    def keys(self, most: int = LISTED) -> list[str]:
        """The ``most`` keys written last, the last first; :meth:`latest` has all of them as a table."""
        return [r["store_key"] for r in self.latest().select("store_key", "updated_at").orderBy(F.col("updated_at").desc(), "store_key").limit(most).collect()]

    def read(self, key: str):
        found = self.latest().where(F.col("store_key") == key).first()
        if found is None:
            return None
        try:
            return json.loads(found["payload"])
        except ValueError:
            return found["payload"]

    def write(self, key: str, value) -> None:
        self._append(key, json.dumps(value, sort_keys=True), False)

    def delete(self, key: str) -> None:
        self._append(key, None, True)

    def _append(self, key: str, payload: str | None, deleted: bool) -> None:
        now = time.time_ns() // 1000
        before = self.latest().where(F.col("store_key") == key).first()
        row = (key, now, uuid.uuid4().hex, before["created_at"] if before else now, deleted, payload)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def compact(self, path: str) -> KvStore:
        """The last version of each key as a new store."""
        kept = self.latest().select("store_key", F.col("updated_at").alias("version"), F.lit("").alias("tie"), "created_at", F.lit(False).alias("deleted"), "payload")
        kept.write.parquet(path)
        return KvStore(self.spark, path)

    def clear(self) -> bool:
        """Remove the store; false if there was none."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True))


class ArtifactStore:
    """Result tables by a digest of what they were made from: equal inputs are computed once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, kind: str, digest: str) -> str:
        return f"{self.path}/{kind}/{digest}"

    def get(self, kind: str, digest: str) -> DataFrame | None:
        done = f"{self._at(kind, digest)}/_SUCCESS"
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(done)
        return self.spark.read.parquet(self._at(kind, digest)) if jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath) else None

    def get_or_make(self, kind: str, digest: str, make) -> DataFrame:
        found = self.get(kind, digest)
        if found is None:
            make().write.mode("overwrite").parquet(self._at(kind, digest))
            found = self.get(kind, digest)
        return found


def exit_code(errors: int, findings: int) -> int:
    """2 for errors, 1 for findings, else 0."""
    return 2 if errors else 1 if findings else 0


def write_report(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines, written by the executors."""
    findings.write.json(path)


def report_json(findings: DataFrame, catalog: DataFrame, detectors: list[str], errors: dict | None = None, most: int = LISTED) -> str:
    """One JSON document of a run with its first ``most`` findings and the number of all."""
    total = findings.agg(F.count(F.lit(1))).first()[0]
    rows = [json.loads(x) for x in findings.orderBy("file", "line", "id").limit(most).toJSON().collect()]
    seen = {r["code"]: r.asDict() for r in catalog.collect()}
    return json.dumps({"meta": {"detectors": detectors, **({"errors": errors} if errors else {})}, "total": total, "findings": rows, "catalog": seen})
