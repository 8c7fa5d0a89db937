"""Quality rules as a bitmask ledger.

ledger() evaluates every rule once and stores measurements and one failure bit per rule. A policy is
a named, versioned set of bits; applying one or comparing several is arithmetic on the stored masks and
never reads a text again. All of it is column expressions: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    failed: Column


def rules() -> list[Rule]:
    """Every rule, over the measurements. Bits are never given to another rule, so old ledgers stay readable."""
    m = F.col
    return [
        Rule("few_words", 0, m("n_words") < 50),
        Rule("repeated_words", 1, 100 * m("n_repeat_words") > 50 * m("n_words")),
        Rule("symbols", 2, 100 * m("n_symbols") > 10 * m("n_words")),
        Rule("duplicate_lines", 3, 2 * m("n_dup_lines") > m("n_lines")),
        Rule("short_words", 4, 2 * m("n_words") > m("word_chars")),
        Rule("long_words", 5, 15 * m("n_words") < m("word_chars")),
    ]


#: Policies by name and version: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols"),
    "web-2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
}
PRODUCTION = "web-2"


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[x] for x in POLICIES[policy])


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words are runs of other characters than space and \\x09-\\x0D. n_lines: \\n-split lines with a word;
    n_dup_lines: those equal to an earlier one. n_repeat_words: words within any window of three words
    that occurs twice or more in the text, its first occurrence included. A null text measures as an
    empty one: all zero. Rows with one doc_id are measured each.
    """
    text = docs.select("doc_id", text_or_empty().alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    three = F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))))
    windows = words.withColumn("windows", three)
    # sorted, equal windows are neighbours; the text is only sorted if a window occurs twice
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windows.withColumn("ordered", F.when(twice, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    at = F.transform("ordered", lambda x, k: F.when(same(x, F.get("ordered", k - 1)) | same(x, F.get("ordered", k + 1)), x["i"]))
    starts = ordered.withColumn("starts", F.array_compact(at))
    covered = F.size(F.array_distinct(F.concat("starts", F.transform("starts", lambda i: i + 1), F.transform("starts", lambda i: i + 2))))
    return starts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """measured() and failed (long): bit k is set if the rule with bit k fails."""
    failed = F.lit(0).cast("long")
    for r in rules():
        failed = failed.bitwiseOR(F.when(r.failed, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", failed)


def judged(entries: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Ledger entries with policy and kept."""
    return entries.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablations(entries: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """For each policy and each of its rules: rows it fails, rows only it fails, rows kept without it, rows in all.

    One pass: entries are first counted by mask, of which there are at most 2 to the number of rules.
    An empty ledger gives no rows.
    """
    masks = entries.groupBy("failed").count()
    bits = {r.name: 1 << r.bit for r in rules()}
    rows = [(p, x, policy_mask(p), bits[x]) for p in policies or POLICIES for x in POLICIES[p]]
    asked = masks.sparkSession.createDataFrame(rows, "policy string, rule string, mask long, bit long")
    both = masks.join(F.broadcast(asked), F.lit(True))  # the rules of the stated policies against the masks
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    counted = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    rest = hit.bitwiseAND(F.bitwise_not("bit"))
    return both.groupBy("policy", "rule").agg(counted(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"), counted(hit == F.col("bit")).alias("only_this"), counted(rest == 0).alias("kept_without"), F.sum("count").alias("rows"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = judged(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base-1")).cast("long")) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed", "policy")


OP1_SQL = r"""
with t as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
p as (select k, unnest(words) as a, generate_subscripts(words, 1) as i from w),
v as (select k, i, a, lead(a) over o as b, lead(a, 2) over o as c from p window o as (partition by k order by i)),
r as (select k, i, count(*) over (partition by k, a, b, c) as n from v where c is not null),
u as (select distinct k, i + d.j as i from r, (values (0), (1), (2)) d(j) where n > 1),
m as (select k, count(*) as n_repeat_words from u group by k),
x as (select doc_id, cast(len(words) as bigint) as n_words,
  cast(length(array_to_string(words, '')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(lines) as bigint) as n_lines
  from w left join m using (k)),
f as (select *, n_words < 50 as f0, 100 * n_repeat_words > 50 * n_words as f1, 100 * n_symbols > 10 * n_words as f2,
  2 * n_dup_lines > n_lines as f3, 2 * n_words > word_chars as f4, 15 * n_words < word_chars as f5 from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 or f1 as base_failed,
  not (f0 or f1 or f2 or f3 or f4 or f5) as kept, n_lines,
  cast(f0 as bigint) + 2 * cast(f1 as bigint) + 4 * cast(f2 as bigint) + 8 * cast(f3 as bigint) + 16 * cast(f4 as bigint) + 32 * cast(f5 as bigint) as failed,
  'web-2' as policy
from f
"""
