"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a text. It is called with successive
prefixes of a conversation, and consecutive outputs are compared: what the new one
has behind the old one is the turn's span. Where the new output doesn't start with
the old one, the template has rewritten history, and the turn says so. Where in its
span a turn's text lies is found by rendering it with two probes in place of the
text: they differ nowhere else.

A conversation streams through its task turn by turn, in order. Its output is a row
a turn, so neither a conversation's turns nor its text are ever held whole, unless
the template says that a turn may depend on all before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import stored

Turn = tuple[str, str]
#: Turns of every conversation whose prefixes are rendered whole, whatever the template says of its memory.
WHOLE = 16
#: Turns, and characters, that a task gathers before it hands them on.
ROWS, CHARS = 1_000, 1 << 22


@dataclass(frozen=True)
class Template:
    """A chat template: how turns are rendered, how texts were escaped, and how a rendered turn is read.

    ``memory`` is the number of turns before a turn on which its rendering may depend;
    None: all of them. ``learned`` names the roles whose texts are under the loss mask.
    """

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str]
    parse: Callable[[str], list[Turn]]
    memory: int | None = None
    learned: frozenset[str] = frozenset({"assistant"})


#: The strings that mark turns.
CONTROL = re.compile(r"\[(?=/?(?:INST|SYS|ROLE|TURN)\])|<(?=/?s>)")
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("", "</s>")}
OPEN = "<s>"


def escape(text: str) -> str:
    """A text without control strings: a backslash behind the first character of each, and backslashes doubled."""
    return CONTROL.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return re.sub(r"\\(\\?)", r"\1", text)


def render_marked(turns: list[Turn]) -> str:
    """``<s>``, then each turn between its marks; a role without marks of its own is named."""
    out = [OPEN]
    for role, text in turns:
        before, behind = MARKS.get(role) or (f"[ROLE]{escape(role)}[TURN]", "[/TURN]")
        out.append(before + escape(text) + behind)
    return "".join(out)


def parse_marked(text: str) -> list[Turn]:
    """The turns of a rendered text."""
    at, found = len(OPEN) if text.startswith(OPEN) else 0, []
    while at < len(text):
        role = next((r for r, (before, _) in MARKS.items() if before and text.startswith(before, at)), None)
        if role:
            before, behind = MARKS[role]
            at += len(before)
        elif text.startswith("[ROLE]", at):
            end = text.index("[TURN]", at)
            role, at, behind = unescape(text[at + 6 : end]), end + 6, "[/TURN]"
        else:
            role, behind = "assistant", MARKS["assistant"][1]
        end = text.index(behind, at)
        found.append((role, unescape(text[at:end])))
        at = end + len(behind)
    return found


MARKED = Template(render_marked, unescape, parse_marked, memory=1)


def shared(a: str, b: str) -> int:
    """Characters that two texts have in common at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


@dataclass
class Rendering:
    """A conversation as it is rendered turn by turn."""

    template: Template
    turns: list[Turn] = field(default_factory=list)
    text: str = ""
    gone: int = 0  # turns that are no longer held
    total: int = 0  # characters of all that was rendered

    def push(self, role: str, text: str) -> dict:
        """Span of one more turn: the output is what it was before, up to ``start``, and then ``piece``."""
        render, memory = self.template.render, self.template.memory
        base, turn = self.text, (role, text)
        out = render([*self.turns, turn])
        kept = len(base) if out.startswith(base) else shared(base, out)
        before = self.total - len(base)
        found = {"role": role, "piece": out[kept:], "start": before + kept, "end": before + len(out), "rewrites": kept < len(base), "loss_start": None, "loss_end": None, "altered": False}
        if role in self.template.learned:
            one, two = (render([*self.turns, (role, probe)]) for probe in "ab")
            head = shared(one, two)
            foot = shared(one[head:][::-1], two[head:][::-1])
            if head < len(one):
                found |= {"loss_start": before + head, "loss_end": before + len(out) - foot}
            own = out[head : len(out) - foot] if head < len(one) else ""
            found["altered"] = self.template.unescape(own) != text
        if memory is not None and memory < len(self.turns) and self.gone + len(self.turns) <= WHOLE:
            near = self.turns[-memory:] if memory else []
            if not self.gone and render([*near, turn]) != render(near) + out[kept:]:
                raise ValueError("the template depends on more turns than its memory says")
        self.turns.append(turn)
        self.text, self.total = out, before + len(out)
        if memory is not None and self.gone + len(self.turns) >= WHOLE:
            drop = len(self.turns) - memory
            self.gone, self.turns = self.gone + drop, self.turns[drop:]
            self.text = render(self.turns)
        return found


SPANS = {"place": T.LongType(), "role": T.StringType(), "piece": T.StringType(), "start": T.LongType(), "end": T.LongType(), "rewrites": T.BooleanType(), "loss_start": T.LongType(), "loss_end": T.LongType(), "altered": T.BooleanType()}


def _batch(rows: list[dict], schema: T.StructType, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds.field(name).type) for name in schema.names], names=schema.names)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def format_chats(conversations: DataFrame, template: Template = MARKED, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn of every conversation as the template renders it.

    Returns a row a turn: the id, ``place`` (from 0), ``role``, ``piece`` with ``start``
    and ``end`` (after the turn the output is what it was before, up to ``start``, and
    then ``piece``; offsets in code points), ``rewrites`` (the turn changed what was
    there before), ``loss_start`` and ``loss_end`` of the text of a learned role, null
    for others, and ``altered`` (what lies there, unescaped, is not the text). The
    first 16 prefixes of a conversation are rendered whole; of later ones the turns
    within the template's memory, and a memory that the first prefixes refute raises.

    Turns are ordered by turn number, ties by role and text, nulls first; repeated rows
    are turns each. A null text or role is an empty one. Rows without an id form a
    conversation of their own. Texts may be of any length. Other columns are ignored;
    an empty table gives no rows. A conversation is rendered in one task, as each turn
    stands behind the one before, but streams through it.
    """
    schema = T.StructType([T.StructField(id_col, conversations.schema[id_col].dataType)] + [T.StructField(n, k) for n, k in SPANS.items()])
    kinds = _arrow(schema)
    rows = conversations.select(F.col(id_col), F.col(turn_col), F.coalesce(F.col(role_col), F.lit("")).alias(role_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    dealt = rows.repartition(id_col).sortWithinPartitions(id_col, turn_col, role_col, text_col)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, place, held, chars = object(), None, 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                if own is None or key != current:
                    current, own, place = key, Rendering(template), 0
                found = own.push(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                held.append({id_col: key, "place": place} | found)
                place, chars = place + 1, chars + len(found["piece"])
                if len(held) >= ROWS or chars >= CHARS:
                    yield _batch(held, schema, kinds)
                    held, chars = [], 0
        if held:
            yield _batch(held, schema, kinds)

    return dealt.mapInArrow(render, schema)


def read_chats(formatted: DataFrame, template: Template = MARKED, id_col: str = "conv_id") -> DataFrame:
    """What formatted conversations hold, read from their text alone.

    Returns for each conversation: its id, ``n_turns``, ``turns_sha256`` (of role,
    newline, text, newline of every turn), ``loss_chars`` and ``loss_sha256`` (of the
    unescaped text under the loss mask), ``formatted_chars`` and ``rewritten``. Where
    history was rewritten, earlier spans no longer hold: all but ``formatted_chars``
    is null there. A null id is an id like others; without rows there are none.
    """
    columns = {id_col: formatted.schema[id_col].dataType, "n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType(), "rewritten": T.BooleanType()}
    schema = T.StructType([T.StructField(n, k) for n, k in columns.items()])
    kinds = _arrow(schema)
    dealt = formatted.select(id_col, "place", "piece", "start", "end", "rewrites", "loss_start", "loss_end").repartition(id_col).sortWithinPartitions(id_col, "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, done = None, None, []

        def closed() -> dict:
            read = {"n_turns": own["turns"], "turns_sha256": own["all"].hexdigest(), "loss_chars": own["chars"], "loss_sha256": own["loss"].hexdigest()}
            return {id_col: current, "formatted_chars": own["end"], "rewritten": own["rewritten"]} | (dict.fromkeys(read) if own["rewritten"] else read)

        for batch in batches:
            for i in range(batch.num_rows):
                key, _, piece, start, end, rewrites, loss_start, loss_end = (c[i].as_py() for c in batch.columns)
                if own is None or key != current:
                    if own is not None:
                        done.append(closed())
                    if len(done) >= ROWS:
                        yield _batch(done, schema, kinds)
                        done = []
                    current, own = key, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "end": 0, "rewritten": False}
                own["end"], own["rewritten"] = end, own["rewritten"] or rewrites
                if own["rewritten"]:
                    continue
                for role, text in template.parse(piece):
                    own["turns"] += 1
                    own["all"].update(f"{role}\n{text}\n".encode())
                if loss_start is not None:
                    learned = template.unescape(piece[loss_start - start : loss_end - start])
                    own["loss"].update(learned.encode())
                    own["chars"] += len(learned)
        if own is not None:
            done.append(closed())
        if done:
            yield _batch(done, schema, kinds)

    return dealt.mapInArrow(read, schema)


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def format_and_read(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of the probe, read back from the files that hold their formatted turns."""
    columns = ["conv_id", "turn", "role", "text"]
    formatted = stored(format_chats(conversations.select(columns).unionByName(probe_conversation(conversations.sparkSession))), "formatted-chats")
    return read_chats(formatted)
