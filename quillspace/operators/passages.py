"""Pages of blocks to paragraphs, and paragraphs to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def in_margin() -> Column:
    """Blocks in the top or bottom tenth; bottom and top are fractions of the page."""
    return (F.col("bottom") <= 0.1) | (F.col("top") >= 0.9)


def without_margins(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """blocks(doc, page, block, text, top, bottom) without page numbers and running heads.

    A head is margin text that, digits aside, stands on at least 30 in 100 of the pages and on two.
    """
    keyed = blocks.withColumn("_key", T.margin_key(F.col("text"))).withColumn("_margin", in_margin())
    pages = keyed.groupBy(doc).agg(F.countDistinct("page").alias("_pages"))
    seen = keyed.where("_margin").groupBy(doc, "_key").agg(F.countDistinct("page").alias("_seen"))
    voted = seen.join(pages, doc).where(F.col("_seen") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * 0.3))).select(doc, "_key", F.lit(True).alias("_head"))
    kept = keyed.join(voted, [doc, "_key"], "left")
    drop = F.col("_margin") & (F.coalesce("_head", F.lit(False)) | T.is_page_number(F.col("_key")))
    return kept.where(~drop).drop("_key", "_margin", "_head")


def paragraphs(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, para (from 1), text, page, page_end. A block that starts small goes on with the one before it
    if that ends in a hyphen, which then goes, or without a sentence's end.
    """
    at = Window.partitionBy(doc).orderBy("page", "block")
    clean = blocks.withColumn("text", T.dehyphenate(F.col("text"))).where("text <> ''")
    last = F.lag("text").over(at)
    small = F.col("text").rlike(r"^\p{Ll}")
    hyphen = small & last.rlike(r"\p{L}-$")
    goes_on = small & ~last.rlike("[.!?:;][\"'”’)\\]]*$")
    flagged = clean.withColumn("_hyphen", F.coalesce(hyphen, F.lit(False))).withColumn("_on", F.coalesce(hyphen | goes_on, F.lit(False)))
    numbered = flagged.withColumn("para", F.sum((~F.col("_on")).cast("int")).over(at))
    gathered = numbered.groupBy(doc, "para").agg(F.sort_array(F.collect_list(F.struct("page", "block", "text", "_hyphen"))).alias("_b"), F.min("page").alias("page"), F.max("page").alias("page_end"))
    join = F.aggregate("_b", F.lit(""), lambda s, b: F.when(s == "", b["text"]).when(b["_hyphen"], F.concat(F.substring(s, F.lit(1), F.length(s) - 1), b["text"])).otherwise(F.concat(s, F.lit(" "), b["text"])))
    return gathered.select(doc, "para", join.alias("text"), "page", "page_end")


def packed(units: list[tuple[str, int, int]], target: int) -> list[tuple[str, int, int]]:
    """(text, page, page_end) of one document, packed in passages of about target words.

    A passage closes at the target and never grows over one and a half times it; longer paragraphs are
    cut at sentences, then anywhere. A last rest under a quarter of the target joins the one before.
    """
    if target < 1:
        raise ValueError("target must be at least 1")
    most = max(target, target * 3 // 2)
    small: list[tuple[int, str, int, int]] = []
    for text, page, end in units:
        n = len(text.split())
        if n <= most:
            small += [(n, text, page, end)] if n else []
            continue
        for sentence in T.split_sentences(text):
            words = sentence.split()
            small += [(len(words[k : k + most]), " ".join(words[k : k + most]), page, end) for k in range(0, len(words), most)]
    groups: list[list[tuple[int, str, int, int]]] = [[]]
    for unit in small:
        size = sum(u[0] for u in groups[-1])
        if size >= target or groups[-1] and size + unit[0] > most:
            groups.append([])
        groups[-1].append(unit)
    groups = [g for g in groups if g]
    if len(groups) > 1 and sum(u[0] for u in groups[-1]) < target // 4:
        rest = groups.pop()
        groups[-1] += rest
    return [("\n\n".join(u[1] for u in g), g[0][2], g[-1][3]) for g in groups]


def passages(paras: DataFrame, target: int = 250, doc: str = "doc_id") -> DataFrame:
    """doc, chunk (from 1), label (doc#chunk), text, page, page_end from paragraphs(doc, para, text, page, page_end)."""
    kind = paras.schema[doc].dataType.simpleString()
    gathered = paras.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("para", "text", "page", "page_end"))).alias("_p"))

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for key, units in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(key, n, *x) for n, x in enumerate(packed([(u["text"], u["page"], u["page_end"]) for u in units], target), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [doc, "chunk", "text", "page", "page_end"])

    found = gathered.mapInArrow(scan, f"{doc} {kind}, chunk int, text string, page int, page_end int")
    return found.select(doc, "chunk", F.concat_ws("#", F.col(doc).cast("string"), F.col("chunk").cast("string")).alias("label"), "text", "page", "page_end")
