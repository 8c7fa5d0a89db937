"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

#: Queries of the catalogue, each computed whole and thrown away.
CATALOGUE = ("vocab_counts", "doc_term_counts", "bm25_topk", "bm25_by_benchmark_item", "word_match", "cosine_similar_topk", "query_and", "query_or", "label_space_sum", "associates_knn", "semantic_search_docs", "hybrid_rrf")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quillspace.functions import text as T
    from quillspace.plans.catalogue import QUERY
    from quillspace.plans.registry import QUERIES

    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, f) -> object:
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        return out

    try:
        QUERIES["vocab_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers, compiles
        for name in CATALOGUE:
            timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())  # noqa: B023
        from quillspace.library import Library
        from quillspace.operators import models
        from quillspace.sources.mapping import FieldMapping

        lib = Library.create(spark, f"file://{folder}/library", embedder="beagle-rp", embedder_params={"dim": 64, "nonzeros": 8})
        timed("library_add", lambda: lib.add_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), FieldMapping.from_options(["text"], ["lang", "source"], "doc_id"), "documents"))
        timed("library_build_beagle_rp_64", lib.build)
        for method in ("lexical", "semantic", "hybrid"):
            lib.search(QUERY, method=method).rows()
            timed(f"library_search_{method}_warm", lambda: lib.search(QUERY, method=method).rows())  # noqa: B023

        items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc"), T.sentence_tokens(F.array(F.coalesce("text", F.lit("")))).alias("u")).select("doc", F.explode("u").alias("s")).select("doc", F.posexplode("s").alias("sent", "words")).cache()
        tokens, types = items.select(F.explode("words").alias("token")).count(), items.select(F.explode("words").alias("token")).distinct()
        timed("beagle_1024_ngrams_7_of_benchmark", lambda: models.word_vectors(items, types, models.make("beagle")).write.format("noop").mode("overwrite").save())
        sf = Path(sf_dir).name.removeprefix("sf")
        print(json.dumps({"metric": "total_sec", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "benchmark_tokens": tokens}))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
