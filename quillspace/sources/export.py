"""A built library as files that a reader without Spark can rank: small JSON, and vectors as bytes.

    manifest.json               spaces, text mode, stop words, counts
    spaces/NN/                  row, label, q (8 bits) and scale, or vec (32 bits), as Parquet
    documents/                  row, title, year, factors as rows of their spaces, as JSON lines
    records/shard=N/            whole documents, SHARD rows each, as JSON lines
    chunks/, passages/shard=N/  the document and pages of each chunk; its text
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.shared import numbered
from ..library import RESERVED, Library
from . import mapping as D
from .store import Folder, LibraryError

PRECISIONS = ("int8", "float32")
SHARD = 500


def export(lib: Library, out: str, precision: str = "int8", min_count: int = 1) -> dict:
    """Write lib to out, a new or empty folder or one with an earlier export; the manifest comes last and is returned.

    min_count: words that occur less often are left out of the word space; the rest is as it is.
    """
    if precision not in PRECISIONS:
        raise ValueError(f"precision is one of {PRECISIONS}")
    info = lib.info
    if lib.is_stale:
        raise LibraryError("documents changed since the build")
    folder = Folder(lib.spark, out)
    if not folder.empty():
        if not folder.exists("manifest.json"):
            raise LibraryError(f"{out} is neither empty nor an earlier export")
        for name in folder.names(""):
            folder.delete(name)
    spaces, factors = [], []
    for n, name in enumerate(info["spaces"]):
        space = lib.space(name)
        if name == "word" and min_count > 1:
            vocab = lib._table("vocab").where(F.col("n") >= min_count).select("row")
            space = numbered(space.join(vocab, "row", "left_semi"), [F.asc("row")], "_row").withColumn("row", F.col("_row")).drop("_row")
        stored = space.select("row", "label", "vec") if precision == "float32" else space.select("row", "label", V.quantize(F.col("vec")).alias("z")).select("row", "label", "z.q", F.col("z.scale").cast("float").alias("scale"))
        stored.write.parquet(folder.at(f"spaces/{n:02d}"))
        if name not in RESERVED:
            factors.append(name)
        written = lib.spark.read.parquet(folder.at(f"spaces/{n:02d}"))
        spaces.append({"name": name, "kind": name if name in RESERVED else "factor", "n": written.count(), "dim": info["embedder"]["dim"], "dtype": precision, "path": f"spaces/{n:02d}"})
    docs = lib.store.documents()
    coded = docs.select("row", F.regexp_replace(F.trim(D.title()), r"\s+", " ").alias("title"), D.year().alias("year"))
    for name in factors:
        bare = name.removeprefix("factor-") if name.removeprefix("factor-") in RESERVED else name
        levels = docs.select("row", F.posexplode(F.element_at("factors", bare)).alias("_p", "label")).join(lib.space(name).select("label", F.col("row").alias("_level")), "label")
        codes = levels.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("_p", "_level")))["_level"].alias(f"factor:{name}"))
        coded = coded.join(codes, "row", "left")
    coded.write.json(folder.at("documents"))
    shard = F.floor((F.col("row") - 1) / SHARD).alias("shard")
    docs.select("row", "id", "fields", "meta", "factors", F.size("chunks").alias("n_chunks"), shard).repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").json(folder.at("records"))
    n_chunks = 0
    if "chunk" in info["spaces"]:
        chunks = docs.select(F.col("row").alias("doc"), "id", F.posexplode("chunks").alias("_p", "_c")).withColumn("label", F.concat("id", F.lit("#"), (F.col("_p") + 1).cast("string")))
        placed = chunks.join(lib.space("chunk").select("row", "label"), "label")
        placed.select("row", "doc", "_c.page", "_c.page_end").write.json(folder.at("chunks"))
        placed.select("row", "_c.text", shard).repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").json(folder.at("passages"))
        n_chunks = info["spaces"]["chunk"]
    manifest = {"format": 1, "name": lib.config.name, "exported_at": datetime.now(UTC).isoformat(timespec="seconds"), "build": info["id"], "built_at": info["created_at"], "embedder": info["embedder"], "text_mode": info["text_mode"], "stopwords": sorted(lib.model.stop), "compose_without_stopwords": lib.model.compose_without_stopwords, "n_documents": info["n_documents"], "n_chunks": n_chunks, "min_count": min_count, "shard": SHARD, "spaces": spaces}
    folder.put("manifest.json", manifest)
    return manifest
