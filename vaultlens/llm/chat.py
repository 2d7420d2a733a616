"""Chat formatting: layouts told apart by their field paths.

A record is JSON text. The layout whose field paths it has, and of several the one
with the most paths, selects the mapping that turns the record into turns of
(role, text); other fields do not matter. Turns are written with control strings
around them, and control strings inside texts are escaped so that reading restores
them. Records without turns are told with a reason by :func:`unmatched`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.text import let, whole

#: Layouts: name, field paths, and the turns as (role, text) SQL over ``record``.
#: A list of messages is (array path, role field, text field).
LAYOUTS: list[tuple[str, tuple[str, ...], dict]] = [
    ("rows", ("role", "text"), {"turn": ("$.role", "$.text")}),
    ("prompt", ("prompt", "response"), {"pair": [("user", "$.prompt"), ("assistant", "$.response")]}),
    ("completion", ("completion", "prompt"), {"pair": [("user", "$.prompt"), ("assistant", "$.completion")]}),
    ("question", ("answer", "question"), {"pair": [("user", "$.question"), ("assistant", "$.answer")]}),
    (
        "instruction",
        ("instruction", "output"),
        {"pair": [("user", "$.instruction"), ("assistant", "$.output")]},
    ),
    (
        "instruction-input",
        ("input", "instruction", "output"),
        {"pair": [("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")]},
    ),
    (
        "messages",
        ("messages", "messages[].content", "messages[].role"),
        {"list": ("$.messages", "role", "content")},
    ),
    (
        "conversations",
        ("conversations", "conversations[].from", "conversations[].value"),
        {"list": ("$.conversations", "from", "value")},
    ),
]

#: Names that stand for a role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: What could be read as control in a text, after its first character and any
#: backslashes: ours, and those of common templates.
CONTROL = r"([<\[])(\\*)(?=\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """One more backslash inside every control string; :func:`unescape` takes it out."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _vocabulary() -> list[str]:
    return sorted({path for _, paths, _ in LAYOUTS for path in paths})


def field_paths(record: Column) -> Column:
    """Sorted field paths of JSON text that some layout names, lists as ``name[].field``.

    Other fields do not count, so records may carry more of them. Text that is
    not a JSON object has none.
    """

    def nested(entry: Column) -> Column:
        items = F.from_json(entry["value"], "array<string>")
        fields = F.array_distinct(
            F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        )
        inner = F.transform(fields, lambda name: F.concat(entry["key"], F.lit("[]."), name))
        return F.concat(
            F.array(entry["key"]),
            F.when(entry["value"].startswith("["), F.coalesce(inner, F.array().cast("array<string>"))).otherwise(
                F.array().cast("array<string>")
            ),
        )

    entries = F.map_entries(F.from_json(record, "map<string,string>"))
    known = F.array(*(F.lit(path) for path in _vocabulary()))
    paths = F.flatten(F.transform(entries, nested))
    return F.sort_array(F.array_intersect(F.coalesce(paths, F.array().cast("array<string>")), known))


def layout_of(paths: Column) -> Column:
    """The layout whose paths are all there.

    Of several, that of the most paths, then one of whole conversations, then the first.
    """
    ranked = sorted(LAYOUTS, key=lambda layout: (-len(layout[1]), "turn" in layout[2]))
    missing = lambda own: F.size(F.array_except(F.array(*(F.lit(path) for path in own)), paths))
    return F.coalesce(*(F.when(missing(own) == 0, F.lit(name)) for name, own, _ in ranked))


def _role(name: Column) -> Column:
    return F.coalesce(
        *(F.when(name == own, F.lit(role)) for own, role in ROLES.items()), name, F.lit("")
    )


def _turns(record: Column, layout: Column) -> Column:
    """Turns of a record by its layout's mapping, null for an unknown layout."""
    text = lambda path: F.coalesce(F.get_json_object(record, path), F.lit(""))
    turn = lambda role, value: F.struct(role.alias("role"), value.alias("text"))

    def message(role: str, value: str):
        return lambda x: turn(_role(x[role]), F.coalesce(x[value], F.lit("")))

    chosen = []
    for name, _, mapping in LAYOUTS:
        if "turn" in mapping:
            role, value = mapping["turn"]
            made = F.array(turn(text(role), text(value)))
        elif "pair" in mapping:
            made = F.array(*(turn(F.lit(role), text(path)) for role, path in mapping["pair"]))
        else:
            path, role, value = mapping["list"]
            schema = f"array<struct<`{role}`:string,`{value}`:string>>"
            made = F.transform(F.from_json(F.get_json_object(record, path), schema), message(role, value))
        chosen.append(F.when(layout == name, made))
    return F.coalesce(*chosen)


def _reason(record: Column, layout: Column) -> Column:
    """Why a record has no turns."""
    lists = [mapping["list"][0] for _, _, mapping in LAYOUTS if "list" in mapping]
    empty = [F.coalesce(F.get_json_object(record, path) == "[]", F.lit(False)) for path in lists]
    return (
        F.when(F.json_object_keys(record).isNull(), "no JSON object")
        .when(layout.isNotNull(), "turns cannot be read")
        .when(reduce(lambda x, y: x | y, empty), "no messages")
        .otherwise("no declared layout")
    )


def canonical(records: DataFrame) -> DataFrame:
    """(conv_id, turn, layout, turns, reason, record) of records (conv_id, turn, record).

    Records without turns have null ``turns``; ``reason`` says why and ``record`` is
    theirs. Both are null for the others.
    """
    known = records.select(
        "conv_id", "turn", "record", let(field_paths(F.col("record")), layout_of).alias("layout")
    ).select("*", _turns(F.col("record"), F.col("layout")).alias("turns"))
    return known.select(
        "conv_id",
        "turn",
        "layout",
        "turns",
        F.when(F.col("turns").isNull(), _reason(F.col("record"), F.col("layout"))).alias("reason"),
        F.when(F.col("turns").isNull(), F.col("record")).alias("record"),
    )


def unmatched(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, record, reason) of the canonical records that :func:`formatted` cannot write."""
    return turns.filter(F.col("turns").isNull()).select("conv_id", "turn", "record", "reason")


def _role_text(role: Column) -> Column:
    """A role without line breaks, reversibly."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_back(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) of canonical records: one training text a conversation.

    A conversation becomes one string, so its records meet in one task; they are
    ordered by turn, then by their content. Repeated rows are repeated turns.
    Records without turns are not here but in :func:`unmatched`.
    """
    pieces = F.transform(
        "turns",
        lambda x: F.concat(
            F.lit(OPEN), escape(_role_text(x["role"])), F.lit("\n" + MIDDLE), escape(x["text"]), F.lit(CLOSE + "\n")
        ),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "piece")))
    return (
        turns.filter(F.col("turns").isNotNull())
        .select("conv_id", "turn", F.array_join(pieces, "").alias("piece"))
        .groupBy("conv_id")
        .agg(ordered.alias("pieces"))
        .select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("formatted"))
    )


def read_back(texts: DataFrame) -> DataFrame:
    """Formatted texts with their turns, roles and texts unescaped."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda part: part != "")
    divide = lambda part: F.split(part, r"\n<\|text\|>", 2)
    turns = F.transform(
        parts,
        lambda part: F.struct(
            _role_back(unescape(F.substring(F.element_at(divide(part), 1), len(OPEN) + 1, 1 << 30))).alias("role"),
            unescape(F.element_at(divide(part), 2)).alias("text"),
        ),
    )
    return texts.select("conv_id", "formatted", turns.alias("turns"))


def digests(texts: DataFrame) -> DataFrame:
    """Digest columns of the formatted texts, from what is read back.

    The loss mask covers the texts of assistant turns.
    """
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    told = F.array_join(
        F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""
    )
    return read_back(texts).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        let(loss, lambda x: F.length(x).cast("long")).alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def rows_as_records(rows: DataFrame) -> DataFrame:
    """Conversations given as one row a turn, as records; null roles and texts are empty."""
    record = F.to_json(F.struct(whole("role").alias("role"), whole("text").alias("text")))
    return rows.select("conv_id", "turn", record.alias("record"))
