r"""Chat formatting: heterogeneous layouts to canonical turns, and turns to one templated string.

A layout is known by its fingerprint, a hash of its nested field paths without types or values. Each
registered fingerprint selects a declarative mapping to turns, array<struct<role, text>>. JSON records
carry their fingerprint row by row, tables by their schema. All of it is column expressions.

The template writes `<turn role="ROLE">\nTEXT\n</turn>\n` for each turn. In texts and roles a backslash
is doubled, and one is put after the `<` of `<turn` and `</turn`; in roles a quote gets one too, as \'
stands for it. So neither marker nor an unescaped control string is ever in a text, and dropping the
first backslash of each pair restores it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

TURNS = "array<struct<role: string, text: string>>"
#: Roles by their usual names; others stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


# --- fingerprints ---


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, sorted; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def json_paths(record: Column) -> Column:
    """Nested field paths of a JSON text, in the one spelling that variants give them: OBJECT<a, b: ARRAY<...>>.

    Field names are sorted by Spark; types of leaves are dropped, so a null and a number are the same
    layout. Null if the text is not JSON.
    """
    kind = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(kind, r": (?!OBJECT<|ARRAY<)(?:DECIMAL\(\d+,\d+\)|[A-Z_]+)", "")


def fingerprint(paths: Column) -> Column:
    return F.substring(F.sha2(paths, 256), 1, 16)


# --- mappings ---


@dataclass(frozen=True)
class Mapping:
    """name; paths: the spellings of json_paths() that it takes; turns: the turns of a JSON text."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Column], Column]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _listed(record: Column, field: str | None, role: str, text: str) -> Column:
    item = f"array<struct<{role}: string, {text}: string>>"
    got = F.from_json(record, item) if field is None else F.from_json(record, f"struct<{field}: {item}>")[field]
    return F.transform(got, lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))


def _pair(record: Column, prompt: str, answer: str, system: str | None = None, extra: str | None = None) -> Column:
    got = F.from_json(record, "struct<" + ", ".join(f"{x}: string" for x in (prompt, answer, system, extra) if x) + ">")
    asked = F.coalesce(got[prompt], F.lit(""))
    if extra:
        asked = F.when(F.coalesce(got[extra], F.lit("")) == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), got[extra]))
    turns = F.array(_turn("user", asked), _turn("assistant", got[answer]))
    if system:
        turns = F.when(F.coalesce(got[system], F.lit("")) == "", turns).otherwise(F.concat(F.array(_turn("system", got[system])), turns))
    return turns


def _object(*fields: str) -> str:
    return f"OBJECT<{', '.join(sorted(fields))}>"


MAPPINGS = [
    Mapping("messages", (f"OBJECT<messages: ARRAY<{_object('content', 'role')}>>",), lambda r: _listed(r, "messages", "role", "content")),
    Mapping("conversations", (f"OBJECT<conversations: ARRAY<{_object('from', 'value')}>>",), lambda r: _listed(r, "conversations", "from", "value")),
    Mapping("bare_messages", (f"ARRAY<{_object('content', 'role')}>",), lambda r: _listed(r, None, "role", "content")),
    Mapping("prompt_response", (_object("prompt", "response"),), lambda r: _pair(r, "prompt", "response")),
    Mapping("prompt_completion", (_object("prompt", "completion"),), lambda r: _pair(r, "prompt", "completion")),
    Mapping("question_answer", (_object("question", "answer"),), lambda r: _pair(r, "question", "answer")),
    Mapping("instruction_output", (_object("instruction", "output"),), lambda r: _pair(r, "instruction", "output")),
    Mapping("instruction_input", (_object("instruction", "input", "output"),), lambda r: _pair(r, "instruction", "output", extra="input")),
    Mapping("system_instruction", (_object("system", "instruction", "output"),), lambda r: _pair(r, "instruction", "output", system="system")),
]


def canonical_json(records: DataFrame, record: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """Add fingerprint, layout and turns to records by the layout of their JSON text.

    A text that is no JSON (or null) has a null fingerprint; it and unknown layouts have a null layout
    and no turns (an empty array), so they can be listed and mapped later; no row is dropped. Null
    texts of turns become empty ones, a null role becomes an empty one.
    """
    known = MAPPINGS if mappings is None else mappings
    marked = records.withColumn("fingerprint", fingerprint(json_paths(F.col(record))))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in reversed(known):
        own = F.col("fingerprint").isin([_hash(p) for p in m.paths])
        layout, turns = F.when(own, m.name).otherwise(layout), F.when(own, m.turns(F.col(record)).cast(TURNS)).otherwise(turns)
    return marked.withColumn("layout", layout).withColumn("turns", F.transform(F.coalesce(turns, F.array().cast(TURNS)), canonical_turn))


def _hash(paths: str) -> str:
    import hashlib

    return hashlib.sha256(paths.encode()).hexdigest()[:16]


def canonical_turn(turn: Column) -> Column:
    role = F.coalesce(turn["role"], F.lit(""))
    for name, usual in ROLES.items():
        role = F.when(role == name, usual).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(turn["text"], F.lit("")).alias("text"))


def turn_rows(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Rows of one turn each -> key, turns. Rows with equal order follow by role and text; null order comes first."""
    one = F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = df.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return gathered.select(key, F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


@dataclass(frozen=True)
class TableMapping:
    """paths: the field paths of a table's schema, sorted; turns: the table to conv_id, turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[DataFrame], DataFrame]


TABLES = [
    TableMapping("turn_rows", ("conv_id", "role", "text", "turn"), lambda df: turn_rows(df, "conv_id", "turn", "role", "text")),
    TableMapping("messages", ("conv_id", "messages[].content", "messages[].role"), lambda df: df.select("conv_id", F.transform("messages", lambda x: canonical_turn(F.struct(x["role"].alias("role"), x["content"].alias("text")))).alias("turns"))),
    TableMapping("prompt_response", ("conv_id", "prompt", "response"), lambda df: df.select("conv_id", F.array(_turn("user", F.coalesce("prompt", F.lit(""))), _turn("assistant", F.coalesce("response", F.lit("")))).alias("turns"))),
    TableMapping("instruction_input", ("conv_id", "input", "instruction", "output"), lambda df: df.select("conv_id", F.array(_turn("user", F.concat_ws("\n\n", F.coalesce("instruction", F.lit("")), F.nullif("input", F.lit("")))), _turn("assistant", F.coalesce("output", F.lit("")))).alias("turns"))),
]


def table_fingerprint(paths: Iterable[str]) -> str:
    """Of a table's field paths; the same hash as that of records."""
    return _hash(", ".join(sorted(paths)))


def table_mapping(kind: T.StructType) -> TableMapping:
    """The mapping that the fingerprint of a table's field paths selects.

    A table with more columns has one fingerprint for each mapping, of those of its paths that the mapping
    names; of mappings with their own fingerprint the one with the most paths is taken. None is an error.
    """
    have, known = schema_paths(kind), {table_fingerprint(m.paths): m for m in TABLES}
    if found := known.get(table_fingerprint(have)):
        return found
    fits = [m for own, m in known.items() if table_fingerprint(p for p in have if p in m.paths) == own]
    if not fits:
        raise ValueError(f"no mapping for the field paths {have}")
    return max(fits, key=lambda m: len(m.paths))


def canonical_table(df: DataFrame) -> DataFrame:
    """conv_id, turns by the fingerprint of df's field paths; see table_mapping(). Other columns are passed over."""
    return table_mapping(df.schema).turns(df)


# --- template ---


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<(?=/?turn)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    """A quote becomes \\' and a plain ' stays, so the two differ."""
    return F.replace(F.replace(escape(role), F.lit("'"), F.lit("\\-")), F.lit('"'), F.lit("\\'"))


def _unescape_role(role: Column) -> Column:
    marks = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\\b")), F.lit("\\'"), F.lit('"'))
    return F.replace(F.replace(F.replace(marks, F.lit("\\-"), F.lit("'")), F.lit("<\\"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Add formatted (string) and loss (array<struct<start, length>>, in characters from 0) to rows with turns.

    loss covers the escaped text of each turn of the trained role, nothing else. No turns: an empty string.
    """
    pieces = turns.withColumn(
        "_pieces",
        F.transform(
            "turns",
            lambda x: F.struct(
                F.concat(F.lit('<turn role="'), _escape_role(x["role"]), F.lit('">\n')).alias("head"),
                escape(x["text"]).alias("body"),
                (x["role"] == trained).alias("loss"),
            ),
        ),
    )
    tail = "\n</turn>\n"
    lengths = F.transform("_pieces", lambda p: F.struct(F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["loss"].alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length")))
        spans = F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + x["head"] + x["body"] + len(tail)).alias("at"), spans.alias("spans"))

    whole = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return pieces.withColumn("formatted", whole).withColumn("loss", F.aggregate(lengths, start, step)["spans"]).drop("_pieces")


def parsed(text: Column) -> Column:
    """Turns of a formatted string."""
    found = F.regexp_extract_all(text, F.lit(r'(?s)<turn role="[^"]*">\n.*?\n</turn>\n'), F.lit(0))
    head = lambda x: F.regexp_extract(x, r'^<turn role="([^"]*)">\n', 1)
    return F.transform(
        found,
        lambda x: F.struct(
            _unescape_role(head(x)).alias("role"),
            unescape(F.substring(x, F.length(head(x)) + 16, F.length(x) - F.length(head(x)) - 24)).alias("text"),
        ),
    )


def loss_text(text: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss -> the digest columns, all read back from formatted."""
    read = rows.withColumn("_turns", parsed(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = r"\### Assistant: </turn> ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(formatted(canonical_table(rows.unionByName(probe))))


OP5_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '<\\\1', 'g') as body,
    replace(replace(regexp_replace(replace(role, '\', '\\'), '<(/?turn)', '<\\\1', 'g'), '''', '\-'), '"', '\''') as head from r
), g as (
  select conv_id, cast(count(*) as bigint) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    string_agg('<turn role="' || head || '">' || chr(10) || body || chr(10) || '</turn>' || chr(10), '' order by turn nulls first, role, text) as whole
  from e group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
  sha256(loss) as loss_sha256, cast(length(whole) as bigint) as formatted_chars from g
"""
