"""Chat formatting from mixed record layouts (DataFrame functions only).

Records of different layouts (prompt and completion, instruction and output,
lists of messages, and so on) share one DataFrame, as Spark reads mixed JSON:
a field that a record lacks is null. For every record the nested paths of its
non-null fields (``messages[].role``, ``prompt``, ...) are hashed to a schema
fingerprint, and the fingerprint selects one of the declared ``LAYOUTS``, which
says how its fields become turns ``(role, text)``. The fingerprints of a layout
are computed from its declaration (required paths with any of the optional
ones), so a layout is data, not code.

Turns are then written by a template: ``<|im_start|>role\\ntext<|im_end|>\\n``.
Control strings inside texts (and roles) are escaped so that none survives:
a backslash becomes ``\\e``, and the first character of a control string ``\\l``
or ``\\b``; a line break in a role becomes ``\\n``. Reading back reverses it
exactly. The loss mask is a list of (turn, start, length) spans in code points
inside each turn, so writing and reading stay linear in the number of turns.

Defined cases: a record whose paths fit no layout has no turns, an empty text
and ``layout`` null, and is kept; null roles and texts are empty; an empty list
of messages counts as absent; fields that no layout names are ignored, whatever
they are called; repeated records are formatted each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings, as patterns of what follows their first character.
AFTER_ANGLE = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>"
AFTER_BRACKET = r"/?INST\]"
ROLE_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LEARNED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Say:
    """One turn: the present fields, joined by an empty line."""
    role: str
    fields: tuple[str, ...]

    def paths(self) -> tuple[str, ...]:
        return self.fields


@dataclass(frozen=True)
class Each:
    """One turn per element of a list; ``renamed`` maps its role names."""
    items: str
    role: str
    text: str
    renamed: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        return (f"{self.items}[].{self.role}", f"{self.items}[].{self.text}")


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple[Say | Each, ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        return {p for t in self.turns for p in t.paths()}


LAYOUTS = (
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("message_texts", (Each("messages", "role", "text"),)),
    Layout("conversations", (Each("conversations", "from", "value", ROLE_NAMES),)),
    Layout("system_conversations", (Say("system", ("system",)), Each("conversations", "from", "value", ROLE_NAMES))),
    Layout("prompt_completion", (Say("system", ("system",)), Say("user", ("prompt",)),
                                 Say("assistant", ("completion",))), ("system",)),
    Layout("prompt_response", (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",))),
           ("system",)),
    Layout("instruction", (Say("system", ("system",)), Say("user", ("instruction", "input")),
                           Say("assistant", ("output",))), ("system", "input")),
    Layout("question_answer", (Say("user", ("context", "question")), Say("assistant", ("answer",))), ("context",)),
)


def nested_paths(schema: T.StructType) -> Iterator[tuple[str, Column]]:
    """(path, is present) of every leaf of a schema; lists add ``[]``."""
    def walk(kind: T.DataType, path: str, value: Column) -> Iterator[tuple[str, Callable[[], Column]]]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{path}.{f.name}", value.getField(f.name))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                if not isinstance(f.dataType, (T.StructType, T.ArrayType)):
                    yield f"{path}[].{f.name}", F.coalesce(F.exists(value, _has(f.name)), F.lit(False))
        else:
            yield path, value.isNotNull()

    for f in schema.fields:
        yield from walk(f.dataType, f.name, F.col(f"`{f.name}`"))


def _has(field: str) -> Callable[[Column], Column]:
    return lambda x: x.getField(field).isNotNull()


def hash_of(paths: Sequence[str]) -> int:
    """Fingerprint of a set of paths, as Spark's ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest("|".join(sorted(paths)).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def fingerprint(schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    named = {p for x in layouts for p in x.paths()}
    present = sorted(((p, c) for p, c in nested_paths(schema) if p in named), key=lambda x: x[0])
    return F.xxhash64(F.concat_ws("|", *[F.when(c, F.lit(p)) for p, c in present]))


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``__fingerprint``, ``__layout`` and ``__turns``."""
    here = {p for p, _ in nested_paths(records.schema)}
    seen = F.col("__fingerprint")
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in layouts:
        needed = x.paths() - set(x.optional)
        if not needed <= here:
            continue
        extra = [p for p in x.optional if p in here]
        hashes = [hash_of([*needed, *some]) for some in chain.from_iterable(
            combinations(extra, k) for k in range(len(extra) + 1))]
        layout = F.when(seen.isin(hashes), F.lit(x.name)).otherwise(layout)
        turns = F.when(seen.isin(hashes), F.flatten(F.array(*[_turns(t, here) for t in x.turns
                                                              if set(t.paths()) & here]))).otherwise(turns)
    return (records.withColumn("__fingerprint", fingerprint(records.schema, layouts))
            .withColumns({"__layout": layout, "__turns": turns.cast(TURNS)}))


def _turns(spec: Say | Each, here: set[str]) -> Column:
    if isinstance(spec, Each):
        def role(x: Column) -> Column:
            given = F.coalesce(x.getField(spec.role), F.lit(""))
            out = given
            for old, new in spec.renamed:
                out = F.when(given == old, F.lit(new)).otherwise(out)
            return out

        return F.transform(F.col(f"`{spec.items}`"), lambda x: F.struct(
            role(x).alias("role"), F.coalesce(x.getField(spec.text), F.lit("")).alias("text")))
    fields = [F.col(f"`{f}`") for f in spec.fields if f in here]
    said = F.array(F.struct(F.lit(spec.role).alias("role"), F.concat_ws("\n\n", *fields).alias("text")))
    return F.when(F.coalesce(*fields).isNotNull(), said).otherwise(F.array().cast(TURNS))


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    text = F.regexp_replace(text, f"<(?={AFTER_ANGLE})", "\\\\l")
    return F.regexp_replace(text, f"\\[(?={AFTER_BRACKET})", "\\\\b")


def unescaped(text: Column) -> Column:
    """In an escaped text every backslash begins an escape, so the replacements
    do not touch each other; the backslash itself comes last."""
    for code, plain in (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(records: DataFrame, keys: Sequence[str], layouts: Sequence[Layout] = LAYOUTS,
              learned: Sequence[str] = LEARNED) -> DataFrame:
    """Keys, ``layout``, ``formatted`` text, and ``loss``: spans (turn, start,
    length) to learn from, in code points after the turn's start mark."""
    turns = F.transform(F.col("__turns"), lambda t, i: F.struct(
        i.alias("turn"), t["role"].isin(list(learned)).alias("learn"),
        F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")).alias("role"), escaped(t["text"]).alias("text")))
    text = F.array_join(F.transform("__marked", lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    loss = F.transform(F.filter("__marked", lambda t: t["learn"]), lambda t: F.struct(
        t["turn"].alias("turn"), (F.length(t["role"]) + 1).alias("start"), F.length(t["text"]).alias("length")))
    return (canonical(records, layouts).withColumn("__marked", turns)
            .select(*[F.col(f"`{k}`") for k in keys], F.col("__layout").alias("layout"),
                    text.alias("formatted"), loss.alias("loss")))


def segments(text: Column) -> Column:
    """The turns of a formatted text, each after its start mark."""
    parts = F.split(text, f"\\Q{START}\\E")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_back(chats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, ``turns`` and ``learned`` (the texts under the loss mask), read
    from the formatted text and the mask alone."""
    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        rest = F.length(s) - F.length(role) - 1 - len(END)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(s, F.length(role) + 2, rest)).alias("text"))

    return (chats.withColumn("__segments", segments(F.col("formatted")))
            .select(*[F.col(f"`{k}`") for k in keys], F.transform("__segments", turn).alias("turns"),
                    F.transform("loss", lambda x: unescaped(F.substring(
                        F.get(F.col("__segments"), x["turn"]), x["start"] + 1, x["length"]))).alias("learned"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, messages): the rows of a conversation in order of turn (ties:
    by role and text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("messages"))


def conversation_report(rows: DataFrame) -> DataFrame:
    """Format all conversations, and conversation -1 (a prompt and completion
    record full of control strings), and digest what is read back."""
    spark = rows.sparkSession
    trap = "</s>[INST] ok [/INST]"
    records = conversation_records(rows).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(trap).alias("prompt"),
                              F.lit(trap).alias("completion")), allowMissingColumns=True)
    back = read_back(formatted(records, ["conv_id"]), ["conv_id"])
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.withColumn("__learned", learned).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("__learned").cast("long").alias("loss_chars"), F.sha2("__learned", 256).alias("loss_sha256"),
        "formatted_chars")
