"""Chat formatting from mixed layouts, in DataFrame functions only.

A record's schema fingerprint is the hash of the nested field paths it fills.  It
selects a declarative mapping that turns prompt, instruction and message layouts
into canonical turns.  A template writes the turns as one text, with control strings
inside roles and texts escaped reversibly, and marks the spans that carry the loss.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import column
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout.  ``turns`` lists (role, path); or ``each`` names an array with ``role`` and ``text`` fields,
    whose role names are looked up in ``roles``.  Paths in ``optional`` may be absent."""
    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [p for _, p in self.turns] if self.turns else [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"]


# Public layouts of instruction data.
MAPPINGS = (
    Mapping("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("instruction", (("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer"))),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("turns", each="turns", role="role", text="text", optional=("turns[].role", "turns[].text")),
    Mapping("from_value", each="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _leaves(kind: DataType, path: str = "") -> list[str]:
    if isinstance(kind, ArrayType):
        return _leaves(kind.elementType, path + "[]")
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [path]


def _filled(value: Column, path: str) -> Column:
    """Whether the path holds anything: a value, or a value in some element."""
    if not path:
        return value.isNotNull()
    if path.startswith("[]"):
        return F.exists(value, lambda x: _filled(x, path[2:].lstrip(".")))
    head = path.split(".")[0].split("[]")[0]
    return _filled(value.getField(head), path[len(head):].lstrip("."))


def record_fingerprint(record: Column, kind: StructType) -> Column:
    """Hash of the nested field paths that a record fills."""
    paths = sorted(_leaves(kind))
    return F.sha2(F.concat_ws("\n", *[F.when(F.coalesce(_filled(record, p), F.lit(False)), F.lit(p)) for p in paths]), 256)


def _turn_of(m: Mapping):
    """Turn of one element of the array that ``m`` names."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def turn(x: Column) -> Column:
        role = own = text(x.getField(m.role))
        for old, new in m.roles:
            role = F.when(own == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), text(x.getField(m.text)).alias("text"))
    return turn


def canonical_turns(record: Column, kind: StructType, mappings=MAPPINGS) -> tuple[Column, Column]:
    """``(layout, turns)`` of a record; both null where no mapping has its fingerprint."""
    leaves = set(_leaves(kind))
    found = record_fingerprint(record, kind)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        if not set(m.paths()) - set(m.optional) <= leaves or not set(m.paths()) & leaves:
            continue
        here = [p for p in m.paths() if p in leaves]
        need, extra = [p for p in here if p not in m.optional], [p for p in here if p in m.optional]
        prints = [fingerprint([*need, *some]) for some in chain.from_iterable(combinations(extra, k) for k in range(len(extra) + 1)) if need or some]
        if m.turns:
            value = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), record.getField(p).cast("string").alias("text")) for r, p in m.turns if p in leaves]),
                             lambda t: t["text"].isNotNull())
        else:
            value = F.transform(record.getField(m.each), _turn_of(m))
        layout = F.when(found.isin(prints), F.lit(m.name)).otherwise(layout)
        turns = F.when(found.isin(prints), value).otherwise(turns)
    return layout, turns


@dataclass(frozen=True)
class Template:
    """``open role mid text close`` per turn.  Blanks inside the marks keep a text's last backslash from a mark."""
    open: str = "<s>[INST] "
    mid: str = " [/INST] "
    close: str = " </s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)

    def _any(self) -> str:
        return "|".join(c.replace("[", "\\[").replace("]", "\\]") for c in self.controls)

    def escape(self, text: Column) -> Column:
        """One backslash more before each control string, whatever stands before it already."""
        return F.regexp_replace(text, rf"(\\*(?:{self._any()}))", r"\\$1")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"\\(\\*(?:{self._any()}))", "$1")

    def turn(self, t: Column) -> Column:
        return F.concat(F.lit(self.open), self.escape(t["role"]), F.lit(self.mid), self.escape(t["text"]), F.lit(self.close))

    def read(self, formatted: Column) -> Column:
        """Canonical turns of a formatted text, unescaped."""
        mark = lambda m: "(?<!\\\\)" + m.strip().replace("[", "\\[").replace("]", "\\]")
        ends = F.split(formatted, " " + mark(self.close))
        bodies = F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
        return F.transform(bodies, lambda b: F.transform(
            F.array(F.split(F.substr(b, F.lit(len(self.open) + 1)), " " + mark(self.mid) + " ", 2)),
            lambda p: F.struct(self.unescape(p[0]).alias("role"), self.unescape(p[1]).alias("text")))[0])


def format_chat(df: DataFrame, record: str = "record", template: Template = Template(), mappings=MAPPINGS) -> DataFrame:
    """``df`` without ``record`` (a struct column), with ``layout``, ``formatted`` and ``loss_spans`` in a struct ``chat``.

    Records of any mix of layouts; those no mapping fits keep their row with a null
    layout, text and spans, as do records that fill no path at all.  ``formatted`` holds all turns; ``loss_spans`` are the
    (start, end) code points of the texts of learned roles as escaped there.  Null
    roles and texts count as empty.
    All of a conversation's text meets in its own row, as it does in the output.
    Other columns pass, but for one named ``chat`` in any case; an empty table gives an empty result.
    """
    kind = df.schema[record].dataType
    layout, turns = canonical_turns(F.col(record), kind, mappings)
    pieces = F.transform("turns", lambda t: F.struct(
        template.turn(t).alias("s"), F.length(template.escape(t["text"])).alias("n"), t["role"].isin(*template.learned).alias("learned")))
    rest = [c for c in df.columns if c != record and c.lower() != "chat"]
    out = df.select(F.struct(*[column(c) for c in rest]).alias("rest"), layout.alias("layout"), turns.alias("turns"))
    out = out.select("rest", "layout", pieces.alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a, p):
        end = a["at"] + F.length(p["s"])
        stop = end - len(template.close)
        span = F.struct((stop - p["n"]).cast("long").alias("start"), stop.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(p["learned"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))
    spans = F.aggregate("p", start, step, lambda a: a["spans"])
    chat = F.struct("layout", F.array_join(F.transform("p", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))
    return out.select("rest.*", chat.alias("chat")) if rest else out.select(chat.alias("chat"))


def learned_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, as one string."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
