"""A library's tables in one folder of any store that Spark writes to.

Documents are Parquet, a partition for each version of each source. What is current is said by small
JSON entries that are only ever added: an entry is written after the data it names, so a job that dies
leaves the library as it was, and a new version of a source or a new build takes effect at once.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import numbered
from .mapping import DOCUMENT

VERSION = 1


class LibraryError(RuntimeError):
    pass


class Folder:
    """Small files under a path, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name) if name else self.root))

    def empty(self) -> bool:
        return not self.exists() or not len(self._fs.listStatus(self._path(self.root)))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.at(name)))) if self.exists(name) else []

    def put(self, name: str, data: Any, replace: bool = True) -> None:
        out = self._fs.create(self._path(self.at(name)), replace)
        try:
            out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=1, default=str).encode()))
        finally:
            out.close()

    def get(self, name: str) -> Any:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


class Store:
    """Documents by source, the log of sources and that of builds."""

    def __init__(self, spark: SparkSession, folder: Folder):
        self.spark, self.folder = spark, folder

    # --- logs ---

    def _append(self, log: str, entry: dict[str, Any]) -> int:
        n = len(self.folder.names(log)) + 1
        self.folder.put(f"{log}/{n:08d}.json", {"id": n, **entry}, replace=False)
        return n

    def _entries(self, log: str) -> list[dict[str, Any]]:
        return [self.folder.get(f"{log}/{x}") for x in self.folder.names(log) if x.endswith(".json")]

    def sources(self) -> list[dict[str, Any]]:
        """The latest entry of each source, in the order in which they were first added."""
        latest: dict[str, dict[str, Any]] = {}
        for e in self._entries("sources"):
            latest[e["path"]] = e
        return list(latest.values())

    def sha_of(self, path: str) -> str | None:
        return next((e["sha256"] for e in self.sources() if e["path"] == path), None)

    def builds(self) -> list[dict[str, Any]]:
        return self._entries("builds")

    def record_build(self, entry: dict[str, Any]) -> int:
        return self._append("builds", entry)

    # --- documents ---

    def documents(self, but: str | None = None) -> DataFrame:
        """row (the order of adding) and DOCUMENT columns of all current sources, but one."""
        parts = [e["part"] for e in self.sources() if e["path"] != but and e["part"]]
        if not parts:
            return self.spark.createDataFrame([], f"row long, {DOCUMENT}")
        rows = self.spark.read.schema(f"row long, {DOCUMENT}, part string").parquet(self.folder.at("documents"))
        return rows.where(F.col("part").isin(parts)).drop("part")

    def count(self) -> int:
        return sum(e["n"] for e in self.sources())

    def fingerprint(self) -> list[str]:
        """Names what is current; changes whenever a source does."""
        return sorted(e["part"] for e in self.sources() if e["part"])

    def add(self, docs: DataFrame, path: str | None, kind: str, sha: str | None = None, options: dict[str, Any] | None = None, now: str = "") -> int:
        """Add DOCUMENT rows, in place of those of the same path if there are any.

        Nothing changes if an id is empty, stands twice, or is one of another source.
        """
        part = uuid.uuid4().hex
        path = path or f"added:{part}"
        base = max([0, *(e["last_row"] for e in self._entries("sources"))])
        clean = docs.select("id", "fields", "meta", "factors", "chunks").withColumn("chunks", F.filter("chunks", lambda c: F.trim(c["text"]) != ""))
        placed = numbered(clean, [], "row").withColumn("row", F.col("row") + base)
        placed.select("row", "id", "fields", "meta", "factors", "chunks").write.mode("overwrite").parquet(self.folder.at(f"documents/part={part}"))
        new = self.spark.read.parquet(self.folder.at(f"documents/part={part}"))
        try:
            n, bad, last = new.agg(F.count(F.lit(1)), F.sum((F.coalesce("id", F.lit("")) == "").cast("long")), F.max("row")).first()
            if bad:
                raise LibraryError(f"{bad} documents have no id")
            twice = new.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
            taken = new.select("id").join(self.documents(but=path).select("id"), "id", "left_semi")
            odd = [r["id"] for r in twice.unionByName(taken).limit(3).collect()]
            if odd:
                raise LibraryError(f"document ids are taken or stand twice: {', '.join(odd)}")
        except Exception:
            self.folder.delete(f"documents/part={part}")
            raise
        self._append("sources", {"path": path, "part": part if n else None, "kind": kind, "sha256": sha, "options": options or {}, "n": n, "last_row": last or base, "added_at": now})
        return n
