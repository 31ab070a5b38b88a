"""Chat formatting by schema fingerprints.

Every record is a JSON document. Its nested field paths (taken from ``schema_of_variant``, types left out) are hashed,
and the hash selects a declarative mapping that turns the record into canonical turns ``(role, text)``. A record whose
layout no mapping knows gets a null ``turns`` and its fingerprint, so that it can be counted and mapped later.

Only Spark expressions are used: no Python runs on the executors.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts ``<`` followed by any number of
backslashes and ``|`` gets one backslash more, so no control string can occur there and removing one backslash undoes
it exactly. In roles backslashes and line feeds are escaped as well, as the first line feed ends a role.

Null texts and roles count as empty; a null record, or JSON that does not parse, has null turns. Turns of a conversation
are ordered by turn (null first), then role, then text, so ties and repeated rows have one order. The digest of a
conversation is that of its whole text, which therefore has to be one value: a conversation is the unit of work and is
gathered with one shuffle of its rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """How records with exactly these field paths become turns.

    ``turns`` lists (role, JSON path) for records that hold one text per field; a role that starts with ``$`` is a JSON
    path too. ``messages`` names an array, with the fields of role and text inside its elements. ``joined`` lists paths
    that form one user turn, separated by a blank line, before the turns.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    joined: tuple[str, ...] = ()


MAPPINGS = (
    Mapping("turn", ("role", "text"), (("$.role", "$.text"),)),
    Mapping("prompt_completion", ("completion", "prompt"), (("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", ("prompt", "response"), (("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question_answer", ("answer", "question"), (("user", "$.question"), ("assistant", "$.answer"))),
    Mapping("instruction", ("instruction", "output"), (("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping(
        "instruction_input", ("input", "instruction", "output"), (("assistant", "$.output"),),
        joined=("$.instruction", "$.input"),
    ),
    Mapping(
        "system_prompt", ("prompt", "response", "system"),
        (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")),
    ),
    Mapping("messages", ("messages[].content", "messages[].role"), messages=("$.messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), messages=("$.conversations", "from", "value")),
    Mapping("bare_messages", ("[].content", "[].role"), messages=("$", "role", "content")),
)

#: Other names of the canonical roles in public layouts (fixed values).
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def canonical_paths(schema: Column) -> Column:
    """Sorted nested field paths, without types, of the text that ``schema_of_variant`` gives.

    ``OBJECT<a: STRING, m: ARRAY<OBJECT<b: VOID>>>`` becomes ``{a, m: [{b>>>``; fields already stand in sorted order.
    """
    kind = r"[A-Z_]+(?:\([0-9, ]+\))?"
    text = F.regexp_replace(schema, f": {kind}(?=[,>])", "")
    text = F.replace(F.replace(text, F.lit("OBJECT<"), F.lit("{")), F.lit("ARRAY<"), F.lit("["))
    return F.regexp_replace(text, rf"\[{kind}>", "[>")


def _layout(paths: Iterable[str]) -> str:
    """The same text for a mapping's paths."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.replace("[]", ".[]").strip(".").split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        if "[]" in node:
            return "[" + show(node["[]"]) + ">"
        return "{" + ", ".join(name + (": " + show(node[name]) if node[name] else "") for name in sorted(node)) + ">"

    return show(tree)


def fingerprint(payload: Column) -> Column:
    """Hash of the nested field paths of a JSON text; null where it does not parse."""
    return F.xxhash64(canonical_paths(F.schema_of_variant(F.try_parse_json(payload))))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.replace(F.replace(unescape(role), F.lit("\\\\"), F.lit("\\/")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\/"), F.lit("\\"))


def _role(name: Column) -> Column:
    named = F.coalesce(name, F.lit(""))
    chosen = named
    for other, role in ROLE_NAMES.items():
        chosen = F.when(named == other, F.lit(role)).otherwise(chosen)
    return chosen


def _turns(variant: Column, mapping: Mapping) -> Column:
    get = lambda path: F.coalesce(F.try_variant_get(variant, path, "string"), F.lit(""))
    if mapping.messages:
        array, role, text = mapping.messages
        kind = f"array<struct<`{role}`:string,`{text}`:string>>"
        return F.transform(
            F.try_variant_get(variant, array, kind),
            lambda m: F.struct(_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")),
        )
    made = []
    if mapping.joined:
        parts = F.filter(F.array(*(get(path) for path in mapping.joined)), lambda x: x != "")
        made.append(F.struct(F.lit("user").alias("role"), F.array_join(parts, "\n\n").alias("text")))
    for role, path in mapping.turns:
        named = get(role) if role.startswith("$") else F.lit(role)
        made.append(F.struct(named.alias("role"), get(path).alias("text")))
    return F.array(*made)


def canonical_turns(
    records: DataFrame, payload: str = "payload", mappings: tuple[Mapping, ...] = MAPPINGS
) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` (name of the mapping) and ``turns``."""
    variant = F.try_parse_json(F.col(payload))
    paths = canonical_paths(F.schema_of_variant(variant))
    found = records.withColumns({"fingerprint": F.xxhash64(paths)})
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for mapping in reversed(mappings):
        known = F.col("fingerprint") == F.xxhash64(F.lit(_layout(mapping.paths)))
        turns = F.when(known, _turns(variant, mapping)).otherwise(turns)
        layout = F.when(known, F.lit(mapping.name)).otherwise(layout)
    return found.withColumns({"layout": layout, "turns": turns})


def format_turns(turns: Column) -> Column:
    """The whole conversation in the template."""
    shown = F.transform(
        turns,
        lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)),
    )
    return F.array_join(shown, "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Run lengths of the loss mask, one run per turn in code points: ``lead`` off, ``body`` on where ``loss``, ``tail`` off.

    Runs instead of absolute positions keep a conversation of any length linear to write and to read.
    """
    return F.transform(
        turns,
        lambda t: F.struct(
            (F.length(escape_role(t["role"])) + len(START) + 1).alias("lead"),
            F.length(escape(t["text"])).alias("body"),
            F.lit(len(END)).alias("tail"),
            (t["role"] == role).alias("loss"),
        ),
    )


def _segments(formatted: Column) -> Column:
    """The formatted text cut behind every turn, without the end marks."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted conversation."""
    def turn(part: Column) -> Column:
        body = F.substring(part, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substr(body, F.length(role) + 2)).alias("text"),
        )

    return F.transform(_segments(formatted), turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    marked = F.filter(F.arrays_zip(_segments(formatted).alias("part"), mask.alias("run")), lambda x: x["run"]["loss"])
    return F.transform(marked, lambda x: unescape(F.substr(x["part"], x["run"]["lead"] + 1, x["run"]["body"])))


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record per turn row of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``)."""
    body = F.to_json(
        F.struct(F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    )
    return rows.select("conv_id", "turn", body.alias("payload"))


def format_conversations(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id``, ``turns``, ``formatted`` and ``loss`` mask of every conversation.

    Records (``conv_id``, ``turn``, ``payload``) of any layout; a record with several turns keeps their order.
    """
    known = canonical_turns(records, mappings=mappings)
    gathered = known.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "turns"))).alias("parts"))
    turns = F.flatten(F.transform("parts", lambda p: F.coalesce(p["turns"], F.array().cast(TURNS))))
    shaped = gathered.select("conv_id", turns.alias("turns"))
    turns = F.col("turns")
    return shaped.select("conv_id", "turns", format_turns(turns).alias("formatted"), loss_mask(turns).alias("loss"))
