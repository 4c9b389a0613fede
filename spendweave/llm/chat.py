"""Chat formatting: layouts are recognised by a fingerprint of their field paths. DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template: ``### role: text</turn>`` and a line end, for every turn.
HEAD, COLON, STOP = "### ", ": ", "</turn>\n"
#: Control strings inside texts and roles, and what stands for them. The backslash comes first when escaping and last when
#: reading back; after it none of the others can arise by chance.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


@dataclass(frozen=True)
class Layout:
    """A declarative mapping of one layout to turns.

    ``turns`` is the path of a list of messages with the fields ``role`` and ``text``; without it, ``fields`` lists
    ``(role, path, optional)`` of single texts in order. ``paths`` are the field paths by which the layout is known, ``roles``
    renames roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str, bool], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user", "model": "assistant"}
LAYOUTS = (
    Layout("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), turns="$.messages", role="role", text="content"),
    Layout("conversations", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), turns="$.conversations", role="from", text="value", roles=NAMES),
    Layout("dialogue", ("data", "data.turns", "data.turns[]", "data.turns[].speaker", "data.turns[].utterance"), turns="$.data.turns", role="speaker", text="utterance", roles=NAMES),
    Layout("prompt", ("prompt", "response"), fields=(("user", "$.prompt", False), ("assistant", "$.response", False))),
    Layout("system_prompt", ("prompt", "response", "system"), fields=(("system", "$.system", False), ("user", "$.prompt", False), ("assistant", "$.response", False))),
    Layout("question", ("answer", "question"), fields=(("user", "$.question", False), ("assistant", "$.answer", False))),
    Layout("instruction", ("input", "instruction", "output"), fields=(("system", "$.instruction", False), ("user", "$.input", True), ("assistant", "$.output", False))),
    Layout("bare_instruction", ("instruction", "output"), fields=(("user", "$.instruction", False), ("assistant", "$.output", False))),
)


def field_paths(schema: Column) -> Column:
    """Sorted distinct field paths in the schema text of a variant, as ``a``, ``a.b`` and ``a[]``; types of leaves don't count.

    The text is read token by token with a stack of the paths that are open: a name opens a path below the top, ``ARRAY<``
    one for the items, and a leaf or ``>`` closes the path whose value it ends.
    """
    tokens = F.regexp_extract_all(schema, F.lit("(?:`(?:[^`]|``)*`|[^\\s<>:,`]+): |ARRAY<|OBJECT<|>|[A-Z_]+(?:\\([0-9, ]*\\))?"), F.lit(0))
    top = lambda s: F.element_at(s["stack"], -1)
    state = lambda stack, paths: F.struct(stack.alias("stack"), paths.alias("paths"))

    def step(s: Column, token: Column) -> Column:
        name = F.regexp_replace(token, "^`?(.*?)`?: $", "$1")
        path = F.when(top(s) == "", name).otherwise(F.concat(top(s), F.lit("."), name))
        items = F.concat(top(s), F.lit("[]"))
        return (
            F.when(token.endswith(": "), state(F.concat(s["stack"], F.array(path)), F.concat(s["paths"], F.array(path))))
            .when(token == "ARRAY<", state(F.concat(s["stack"], F.array(items)), F.concat(s["paths"], F.array(items))))
            .when(token == "OBJECT<", s)
            .otherwise(state(F.slice(s["stack"], 1, F.size(s["stack"]) - 1), s["paths"]))
        )

    start = F.struct(F.array(F.lit("")).alias("stack"), F.array().cast("array<string>").alias("paths"))
    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"])))


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, shown in pairs:
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def _unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, shown in reversed(pairs):
        text = F.replace(text, F.lit(shown), F.lit(raw))
    return text


def _turns(layout: Layout) -> Column:
    """The turns of a record in this layout, as an array of (role, text)."""
    if layout.turns:
        renamed = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in layout.roles.items() for x in p]), r), r) if layout.roles else r
        items = F.variant_get("record", layout.turns, f"array<struct<{layout.role}:string,{layout.text}:string>>")
        return F.transform(items, lambda m: F.struct(renamed(F.coalesce(m[layout.role], F.lit(""))).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))
    one = lambda role, path: F.struct(F.lit(role).alias("role"), F.coalesce(F.variant_get("record", path, "string"), F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    parts = [F.when(one(role, path)["text"] != "", F.array(one(role, path))).otherwise(empty) if optional else F.array(one(role, path)) for role, path, optional in layout.fields]
    return F.concat(*parts)


def fingerprints(spark: SparkSession, layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, int]:
    """The hash of each layout's field paths."""
    row = spark.range(1).select(*[path_hash(F.array_sort(F.array(*[F.lit(p) for p in x.paths]))).alias(x.name) for x in layouts]).first()
    return row.asDict()


def canonical(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``id, fingerprint, layout, turns`` of JSON records in any of ``layouts``.

    ``layout`` is null, and so are the turns, where the text is no JSON or has field paths that no layout has; such rows stay.
    Null roles and texts are empty.
    """
    record = F.try_parse_json(F.col(record_col).cast("string"))
    parsed = records.select(F.col(id_col).alias("id"), record.alias("record"))
    known = parsed.withColumn("fingerprint", path_hash(field_paths(F.schema_of_variant("record"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    hashes = fingerprints(records.sparkSession, layouts)
    for x in layouts:
        here = F.col("fingerprint") == hashes[x.name]
        layout, turns = F.when(here, x.name).otherwise(layout), F.when(here, _turns(x)).otherwise(turns)
    return known.select("id", "fingerprint", layout.alias("layout"), turns.alias("turns"))


def render(turned: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_runs``: per turn the characters before and under the loss mask, and those after it."""
    size = lambda text: F.length(text)

    def shown(t: Column) -> Column:
        role, text = _escape(t["role"], ROLE_ESCAPES), _escape(t["text"], ESCAPES)
        head = F.concat(F.lit(HEAD), role, F.lit(COLON))
        under = t["role"] == loss_role
        return F.struct(
            F.concat(head, text, F.lit(STOP)).alias("shown"),
            F.struct(
                F.when(under, size(head)).otherwise(size(head) + size(text) + len(STOP)).alias("skip"), F.when(under, size(text)).otherwise(0).alias("take"),
                F.when(under, len(STOP)).otherwise(0).alias("rest"),
            ).alias("run"),
        )

    made = turned.withColumn("made", F.transform("turns", shown))
    return made.withColumn("formatted", F.array_join("made.shown", "")).withColumn("loss_runs", F.col("made.run")).drop("made")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, "</turn>\\n", -1), lambda p: p != "")
    head = lambda p: F.instr(p, COLON)
    cut = lambda p: F.struct(
        _unescape(F.substring(p, F.lit(len(HEAD) + 1), head(p) - 1 - len(HEAD)), ROLE_ESCAPES).alias("role"),
        _unescape(F.substring(p, head(p) + len(COLON), F.length(p)), ESCAPES).alias("text"),
    )
    return F.transform(parts, cut)


def read_loss(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, unescaped, in order. A run ends where its turn does."""
    parts = F.filter(F.split(formatted, "</turn>\\n", -1), lambda p: p != "")
    return F.filter(
        F.zip_with(parts, runs, lambda p, r: F.when(r["rest"] > 0, _unescape(F.substring(p, r["skip"] + 1, r["take"]), ESCAPES))), lambda t: t.isNotNull()
    )


def format_chat(records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``id, fingerprint, layout, turns, formatted, loss_runs`` of heterogeneous JSON records.

    Each record is parsed once, its field paths are hashed, and the hash selects the declarative mapping to turns. ``formatted``
    is reversible whatever the texts hold. The loss mask covers assistant texts. Records of no known layout have nulls. An
    empty table gives no rows; rows that repeat an id are formatted each.
    """
    return render(canonical(records, id_col, record_col, layouts))
