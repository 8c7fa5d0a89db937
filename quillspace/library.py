"""A library: documents in a folder, vector spaces and a keyword index built from them, and queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .functions.shared import kept, numbered, shared_path
from .operators import lexical as L
from .operators import models as M
from .operators import project as P
from .operators import search as S
from .operators import simulate as E
from .sources import mapping as D
from .sources import readers as R
from .sources.store import Folder, LibraryError, Store

RESERVED = ("document", "word", "chunk")


@dataclass
class Config:
    """fields: those to embed, all if None; factors: those to build spaces of, all if None; aggregate: sum, mean."""

    name: str = ""
    text_mode: str = "unicode"
    fields: list[str] | None = None
    factors: list[str] | None = None
    factor_aggregate: str = "sum"
    embedder: str = "beagle"
    embedder_params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.text_mode not in T.MODES:
            raise ValueError(f"text mode is one of {T.MODES}")
        if self.factor_aggregate not in ("sum", "mean"):
            raise ValueError("factor_aggregate is sum or mean")


@dataclass
class Result:
    """hits: rank, row, label, score and, of a hybrid search, semantic and lexical; for documents and chunks also id, title."""

    query: str
    mode: str
    space: str
    method: str
    terms: list[str]
    unknown: list[str]
    hits: DataFrame | None = None

    def rows(self) -> list[dict[str, Any]]:
        """The hits on the driver; meant for a search with a k."""
        return [] if self.hits is None else [r.asDict(recursive=True) for r in self.hits.orderBy("rank").collect()]

    def to_dict(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("query", "mode", "space", "method", "terms", "unknown")} | {"hits": self.rows()}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        if not self.folder.exists("config.json"):
            raise LibraryError(f"{root} is no library")
        self.config = Config(**self.folder.get("config.json"))
        self.store = Store(spark, self.folder)
        self._counted: tuple[Any, str] | None = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str | None = None, **settings: Any) -> Library:
        folder = Folder(spark, root)
        if folder.exists("config.json"):
            raise LibraryError(f"{root} is a library already")
        folder.put("config.json", asdict(Config(name=name or root.rstrip("/").rpartition("/")[2], **settings)))
        return cls(spark, root)

    def save_config(self) -> None:
        self.folder.put("config.json", asdict(self.config))

    # --- adding ---

    def add_documents(self, docs: DataFrame, source: str | None = None, kind: str = "table", options: dict[str, Any] | None = None, sha: str | None = None) -> int:
        """Documents as sources.mapping.documents() makes them; the same source again replaces its documents."""
        return self.store.add(docs, source, kind, sha, options, _now())

    def add_records(self, records: DataFrame, mapping: D.FieldMapping | None = None, source: str | None = None) -> int:
        return self.add_documents(D.documents(records, mapping), source, "records")

    def add_path(self, path: str, fmt: str | None = None, mapping: D.FieldMapping | None = None, split: str = "document", force: bool = False, chunk_words: int = 250) -> int | None:
        """A file, or a folder of files of one format; None if nothing in it changed since it was added."""
        fmt = fmt or R.detect_format(path)
        sha = self._sha(path)
        if not force and self.store.sha_of(path) == sha:
            return None
        docs = R.read_documents(self.spark, path, fmt, mapping, split, chunk_words)
        options = {"split": split, "chunk_words": chunk_words} | ({"text": mapping.text, "factors": mapping.factors, "id": mapping.id} if mapping else {})
        return self.add_documents(docs, path, fmt, options, sha)

    def _sha(self, path: str) -> str:
        """Of all lines of all files with their places, whatever a file's size; no file is held whole.

        A place is a line's number within its task, so another setting of Spark's split sizes reads as a change.
        """
        lines = self.spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        one = lines.select(F.sha2(F.concat_ws("#", F.input_file_name(), F.col("_metadata.file_block_start"), F.col("_metadata.file_size"), place, F.sha2(F.col("value").cast("binary"), 256)), 256).alias("s"))
        # a sum of hashes has no order to keep
        return str(one.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("s", 1, 15), 16, 10).cast("decimal(38,0)")).alias("h")).first())

    # --- building ---

    def sentences(self, docs: DataFrame | None = None) -> DataFrame:
        """doc (row), unit, sent, words: the sentences of all documents; none crosses a field or a chunk."""
        units = D.embedded(self.store.documents() if docs is None else docs, self.config.fields)
        return T.sentence_rows(units.withColumnRenamed("row", "doc"), "doc", F.col("units"), self.config.text_mode)

    def _indexed(self, units: DataFrame, model: M.Model) -> DataFrame:
        """What models.indexed() takes from the texts; builds of parts by this object read the texts once for all of them."""
        made = M.indexed(units, "doc", F.col("units"), F.size("chunks") > 0, model, self.config.text_mode)
        key = self.store.fingerprint(), model, self.config.text_mode, self.config.fields
        if self._counted is None or self._counted[0] != key or not Folder(self.spark, self._counted[1]).exists("_SUCCESS"):
            path = shared_path(self.spark, "indexed")
            made.write.parquet(path)
            self._counted = key, path
        return self.spark.read.schema(made.schema).parquet(self._counted[1])

    def build(self, embedder: str | None = None, parts: Sequence[str] | None = None, **params: Any) -> dict[str, Any]:
        """Learn word vectors and write all spaces and the keyword index as a new build, which is then current.

        parts: only the tables (terms, lengths, vocab) and spaces named, and what they are made of. What the current build has is
        taken over then, if it is of the same documents and settings.
        """
        began = datetime.now(UTC)
        if embedder:
            self.config.embedder = embedder
        self.config.embedder_params |= params
        model = M.make(self.config.embedder, **self.config.embedder_params)
        self.save_config()
        docs = self.store.documents()
        n_docs = self.store.count()
        if not n_docs:
            raise LibraryError("there are no documents")
        cores = self.spark.sparkContext.defaultParallelism
        # a small corpus in few files would be few tasks' work
        spread = docs.repartition(cores, "row") if docs.rdd.getNumPartitions() < cores else docs
        earlier = self.info if parts is not None and self._is_of(model) else {}
        tables, sizes = dict(earlier.get("tables", {})), dict(earlier.get("spaces", {}))
        base = f"builds_data/{len(self.store.builds()) + 1:08d}-{began:%Y%m%d%H%M%S%f}"

        def save(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(self.folder.at(f"{base}/{name}"))
            tables[name] = base
            return self.spark.read.schema(df.schema).parquet(self.folder.at(f"{base}/{name}"))

        def stored(name: str) -> DataFrame:
            return self.spark.read.parquet(self.folder.at(f"{tables[name]}/{name}"))

        units = D.embedded(spread, self.config.fields).withColumnRenamed("row", "doc")
        levels = docs.select(F.col("row"), F.explode("factors").alias("factor", "_l")).select("row", "factor", F.posexplode("_l").alias("_p", "level"))
        found = [r[0] for r in levels.select("factor").distinct().orderBy("factor").collect()]  # names of factors, as few as columns
        factors = {f"factor-{f}" if f in RESERVED else f: f for f in self.config.factors or found if f in found}
        every = {"terms", "lengths", "vocab"} | {f"space={name}" for name in (*RESERVED, *factors)}
        named = {name.removeprefix("space=") for name in every}
        if odd := set(parts or ()) - named:
            raise LibraryError(f"no part {', '.join(sorted(odd))}: {', '.join(sorted(named))}")
        wanted = {name for name in every if parts is None or name.removeprefix("space=") in parts} - set(tables)
        if "space=document" not in tables and any(f"space={name}" in wanted for name in factors):
            wanted.add("space=document")
        vectored = wanted & {f"space={name}" for name in RESERVED}
        if "vocab" not in tables and ("space=word" in wanted or (model.learns and vectored)):
            wanted.add("vocab")
        counted = self._indexed(units, model)
        whole = counted.where("token is null and unit is null")
        posted = counted.where("token is not null")

        def exploded(rows: DataFrame, key: str) -> DataFrame:
            return rows.select(key, F.explode(F.arrays_zip("tokens", "tfs")).alias("_t")).select(key, F.col("_t.tokens").alias("token"), F.col("_t.tfs").cast("long").alias("tf"))

        by_word = posted.select("token", F.coalesce("docs", F.array("first")).alias("_docs"), F.coalesce("counts", F.array(F.col("n").cast("int"))).alias("_tfs")).repartition("token").sortWithinPartitions("token")
        terms = by_word.select("token", F.posexplode("_docs").alias("_at", "doc"), "_tfs").select("doc", "token", F.get("_tfs", "_at").cast("long").alias("tf"))
        if "terms" in wanted:
            save(terms, "terms")
        lengths = stored("lengths") if "lengths" in tables else save(whole.select("doc", "len"), "lengths")
        mean = lengths.agg(F.avg("len")).first()[0] or 0.0
        # the document of a word's first occurrence, and the place there; two numbers, as those are added up without a sort
        first = posted.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("_doc"), F.min_by("place", "first").alias("_place"))
        if "vocab" in wanted:
            save(numbered(first, [F.asc("_doc"), F.asc("_place")], "row").select("token", "row", "n"), "vocab")
        vocab = stored("vocab") if "vocab" in tables else None
        if not vectored:
            vectors = placed = None
        elif model.learns:
            sentences = save(self.sentences(spread), "sentences")
            ordered = sentences.select("doc", (F.col("unit").cast("long") * (1 << 32) + F.col("sent")).alias("sent"), "words")
            vectors = kept(M.word_vectors(ordered, vocab, model), "word-vectors")
            placed = vectors.join(vocab, "token")
        else:
            placed = M.environments(vocab.select("row", "token"), model) if "space=word" in wanted else None

        def space(df: DataFrame, name: str) -> DataFrame:
            return save(df.select("row", "label", "vec", V.norm(F.col("vec")).alias("norm")), f"space={name}")

        def composed(items: DataFrame, rows: DataFrame, key: str) -> DataFrame:
            return M.composed(items, exploded(rows, key), vectors, model, key)

        if "space=word" in wanted:
            space(placed.select("row", F.col("token").alias("label"), F.col("vec").cast("array<float>").alias("vec")), "word")
            sizes["word"] = vocab.count()
        if "space=document" in wanted:
            items = composed(whole.select("doc", "id"), whole, "doc") if model.learns else whole
            space(items.select(F.col("doc").alias("row"), F.col("id").alias("label"), "vec"), "document")
            sizes["document"] = n_docs
        chunks = docs.select(F.col("row").alias("doc"), "id", F.posexplode("chunks").alias("unit", "_c")).select("doc", "id", "unit")
        if "space=chunk" in wanted and chunks.limit(1).count():
            listed = numbered(chunks, [F.asc("doc"), F.asc("unit")], "row").select("doc", "unit", "row", F.concat("id", F.lit("#"), (F.col("unit") + 1).cast("string")).alias("label"))
            own = counted.where("unit is not null").join(listed, ["doc", "unit"])
            sizes["chunk"] = space(composed(listed.select("row", "label"), own, "row") if model.learns else own, "chunk").count()
        for name, factor in factors.items():
            if f"space={name}" not in wanted:
                continue
            own = levels.where(F.col("factor") == factor)
            once = own.groupBy("level").agg(F.min(F.struct("row", "_p")).alias("_f"))
            places = numbered(once, [F.asc("_f")], "row").select("level", "row")
            sums = V.summed(own.select("row", "level").distinct().join(stored("space=document").select("row", "vec"), "row").drop("row"), ["level"], "vec", self.config.factor_aggregate)
            sizes[name] = space(sums.join(places, "level").select("row", F.col("level").alias("label"), F.col("vec").cast("array<float>").alias("vec")), name).count()
        info = {"created_at": began.isoformat(timespec="seconds"), "embedder": model.config(), "text_mode": self.config.text_mode, "fields": self.config.fields, "path": base, "spaces": sizes, "n_documents": n_docs, "mean_length": mean, "vocab_size": sizes.get("word"), "tables": tables, "factor_aggregate": self.config.factor_aggregate, "documents": self.store.fingerprint(), "seconds": (datetime.now(UTC) - began).total_seconds()}
        return info | {"id": self.store.record_build(info)}

    # --- what is built ---

    @property
    def is_built(self) -> bool:
        return bool(self.folder.names("builds"))

    @property
    def info(self) -> dict[str, Any]:
        if not self.is_built:
            raise LibraryError("the library is not built")
        return self.folder.get(f"builds/{self.folder.names('builds')[-1]}")

    @property
    def is_stale(self) -> bool:
        """Whether any source changed since the build."""
        return self.is_built and self.info["documents"] != self.store.fingerprint()

    def _is_of(self, model: M.Model) -> bool:
        """Whether the current build is of the current documents and settings and this model."""
        if not self.is_built or self.is_stale:
            return False
        same = all(self.info.get(k) == getattr(self.config, k) for k in ("text_mode", "fields", "factor_aggregate"))
        return same and self.model == model

    @property
    def model(self) -> M.Model:
        kept_as = dict(self.info["embedder"])
        if isinstance(kept_as.get("stopwords"), list):
            kept_as["stopwords"] = tuple(kept_as["stopwords"])
        return M.Model(**kept_as)

    def _table(self, name: str) -> DataFrame:
        info = self.info
        return self.spark.read.parquet(self.folder.at(f"{info.get('tables', {}).get(name, info['path'])}/{name}"))

    def space(self, name: str) -> DataFrame:
        """row, label, vec, norm."""
        spaces = self.info["spaces"]
        if name not in spaces:
            raise LibraryError(f"no space {name!r}: {', '.join(spaces)}")
        return self._table(f"space={name}")

    def document(self, key: str) -> dict[str, Any]:
        found = self.store.documents().where(F.col("id") == key).first()
        if found is None:
            raise KeyError(f"no document {key!r}")
        return found.asDict(recursive=True)

    def chunk(self, label: str) -> tuple[dict[str, Any], dict[str, Any]]:
        key, _, n = label.rpartition("#")
        doc = self.document(key) if key else {"chunks": []}
        if not n.isdigit() or not 1 <= int(n) <= len(doc["chunks"]):
            raise KeyError(f"no chunk {label!r}")
        return doc, doc["chunks"][int(n) - 1]

    # --- queries ---

    def _masked(self, name: str, scored: DataFrame, where: Column | None, include_stopwords: bool) -> DataFrame:
        """Scored rows that a query may show; masks come after all scores."""
        if where is not None:
            if name not in ("document", "chunk"):
                raise LibraryError("filters apply to the document and chunk spaces")
            allowed = self.store.documents().where(where)
            if name == "document":
                return scored.join(allowed.select("row"), "row", "left_semi")
            owner = scored.withColumn("_id", F.regexp_replace("label", r"#\d+$", ""))
            return owner.join(allowed.select(F.col("id").alias("_id")), "_id", "left_semi").drop("_id")
        if name == "word" and not include_stopwords and self.model.stop:
            return scored.where(~F.col("label").isin(sorted(self.model.stop)))
        return scored

    def _hits(self, name: str, scored: DataFrame, k: int | None) -> DataFrame:
        """Ranked hits; those of documents and chunks get their document's id, title and meta."""
        columns = [c for c in ("rank", "row", "label", "score", "semantic", "lexical") if c in (*scored.columns, "rank")]
        ranked = S.top(scored, k).select(*columns)
        if name not in ("document", "chunk"):
            return ranked
        docs = self.store.documents().select(F.col("id"), D.title().alias("title"), "meta", "factors", "chunks")
        keyed = ranked.withColumn("id", F.col("label") if name == "document" else F.regexp_replace("label", r"#\d+$", ""))
        if k is not None and k <= 10_000:
            keyed = F.broadcast(keyed)
        shown = docs.join(keyed, "id")
        passage = F.get("chunks", F.regexp_extract("label", r"#(\d+)$", 1).cast("int") - 1).alias("chunk")
        return shown.select(*columns, "id", "title", "meta", "factors", *([passage] if name == "chunk" else []))

    def search(self, query: str, mode: str = "compound", space: str = "document", k: int | None = 10, where: Column | None = None, method: str = "semantic", lexical_weight: float = 0.5, include_stopwords: bool = False) -> Result:
        """Rank a space against a text. where: a condition on documents (id, fields, meta, factors)."""
        S.check(mode, method, space, lexical_weight)
        target, model = self.space(space), self.model
        tokens = T.tokens_of(query, self.info["text_mode"])
        words = list(dict.fromkeys(tokens))
        # as few rows as the query has words
        found = {r["label"]: np.array(r["vec"], np.float64) for r in self.space("word").where(F.col("label").isin(words)).select("label", "vec").collect()} if words else {}
        known = [t for t in words if t in found]
        terms = known if method == "lexical" else M.query_terms(tokens, found.__contains__, model)
        result = Result(query, mode, space, method, terms, [t for t in words if t not in found])
        if not terms:
            return result
        semantic = lexical = None
        if method != "lexical":
            if mode == "compound":
                semantic = S.scores(target, np.sum([found[t] for t in terms], axis=0).tolist())
            else:
                rows = self.spark.createDataFrame([(t, found[t].tolist()) for t in terms], "term string, vec array<double>")
                semantic = target.select("row", "label").join(S.combined(S.term_scores(target, rows), mode), "row")
            semantic = semantic.select("row", "label", "score")
        if method != "semantic":
            asked = self.spark.createDataFrame([(0, t) for t in known], "query_id int, token string")
            lexical = L.bm25(None, self._table("terms"), asked, "doc", stored=(self._table("lengths"), self.info["n_documents"], self.info["mean_length"])).select(F.col("doc").alias("row"), "score")
        if method == "semantic":
            scored = semantic
        elif method == "lexical":
            scored = target.select("row", "label").join(lexical.where("score > 0"), "row")
        else:
            scored = target.select("row", "label").join(S.fused(semantic, lexical, lexical_weight), "row")
        result.hits = self._hits(space, self._masked(space, scored, where, include_stopwords), k)
        return result

    def similar(self, label: str, space: str = "document", target: str | None = None, k: int | None = 10, where: Column | None = None, include_stopwords: bool = False) -> DataFrame:
        """The items of a space nearest to an item of the same or another one."""
        own = self.space(space).where(F.col("label") == label).select("vec").first()
        if own is None:
            raise KeyError(f"no {space} {label!r}")
        name = target or space
        scored = S.scores(self.space(name), own["vec"]).select("row", "label", "score")
        return self._hits(name, self._masked(name, scored, where, include_stopwords), k)

    def project(self, labels: Sequence[str], space: str = "document", clusters: int = 3, seed: int = 0) -> DataFrame:
        """A map of a few items: label, x, y, cluster."""
        items = self.space(space).where(F.col("label").isin(list(labels)))
        return P.project(items.select("row", "label", "vec"), clusters, seed)

    def evaluate(self, plan: E.Plan | None = None) -> E.Results:
        """The simulations over all documents; the built model's word vectors are used if the plan asks for that model."""
        plan = plan or E.Plan()
        ready = {}
        if self.is_built and not self.is_stale:
            name = self.info["embedder"]["name"]
            if M.make(name, **plan.params.get(name, {})) == self.model:
                ready[name] = self.space("word").select(F.col("label").alias("token"), "vec")
        ordered = self.sentences().select("doc", (F.col("unit").cast("long") * (1 << 32) + F.col("sent")).alias("sent"), "words")
        return E.simulate(ordered, self.store.documents().select(F.col("row").alias("doc")), plan, ready)

    def sources(self) -> list[dict[str, Any]]:
        return self.store.sources()
