"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, turn after turn, and encoded once.  The
lengths of its tokens in bytes give token spans; both these and the spans of the
turns are sorted, so two binary searches a turn find the tokens that meet it.
The loss span of an assistant turn is that run of tokens, clipped to the bytes
of the turn's text where a token reaches over its edge.

A template marks turns by control strings, which are tokens of their own.
Control strings inside roles and texts (those of the template and of other
common ones) are broken up by ``\\_``, and ``\\`` is doubled; both are undone
when a text is read back.  No control string may begin with an end of another,
so that none arises where two parts meet.

Turns are read in the order of ``turn_order.in_ranges``.  A task renders whole
conversations; only the first and the last of a range, and what is longer than
``SEGMENT_CHARS``, are written in segments cut between turns.  No token reaches
over a control string, so segments have the ids that the whole text would have.

Defined cases: a null text or role is empty; a null id is a conversation of its
own; null turns come first; rows of one turn stand by role and text; repeated
rows are turns of their own.  An empty text has an empty loss span, which is
left out.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import staged
from convolake.llm.turn_order import by_conversation, in_ranges, part_id, ranges_for, rows_of

SEGMENT_CHARS = 4_000_000

# Control strings of common chat templates and tokenizers.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>",
           "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")


@dataclass(frozen=True)
class Template:
    """``open`` role ``sep`` text ``close``; ``special`` are its control strings."""
    open: str
    sep: str
    close: str
    special: tuple[str, ...]

    def __post_init__(self):
        if any(a.startswith(b[-k:]) for a in self.special for b in CONTROL + self.special for k in range(1, len(b)) if b != a or k < len(a)):
            raise ValueError("a control string begins with the end of another")


CHATML = Template("<|im_start|>", "\n", "<|im_end|>\n", ("<|im_start|>", "<|im_end|>"))
HEADERS = Template("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", ("<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"))


def _broken(template: Template) -> re.Pattern:
    return re.compile(r"\\|" + "|".join(map(re.escape, sorted({*CONTROL, *template.special}, key=len, reverse=True))))


_UNDO = {"\\\\": "\\", "\\_": "", "\\n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\[\\_n]", lambda m: _UNDO[m[0]], text)


class Formatter:
    """Renders, encodes, masks and reads back by one template and vocabulary."""

    def __init__(self, template: Template, path: str, pattern: str, loss_role: str = "assistant"):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 1
        special = {s: first + i for i, s in enumerate(template.special)}
        self.template, self.loss_role = template, loss_role
        self.library = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.broken = _broken(template)
        self.token_bytes = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        self.size = np.zeros(first + len(special), dtype=np.int64)
        self.size[list(self.token_bytes)] = [len(b) for b in self.token_bytes.values()]
        t = template
        self.turn = re.compile(re.escape(t.open) + "(.*?)" + re.escape(t.sep) + "(.*?)" + re.escape(t.close), re.DOTALL)

    def escape(self, text: str) -> str:
        return self.broken.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\_" + m[0][1:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The text, and the byte spans of the texts under loss, in order."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head = self.template.open + self.escape(role).replace("\n", "\\n") + self.template.sep
            body = self.escape(text)
            begin = at + len(head.encode())
            end = begin + len(body.encode())
            at = end + len(self.template.close.encode())
            out += [head, body, self.template.close]
            if role == self.loss_role and end > begin:
                spans.append((begin, end))
        return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)

    def encode(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, list[dict]]:
        """Text, ids, and loss spans: tokens ``token_from..token_to`` (exclusive)
        and the bytes of the text that they cover inside the turn."""
        text, spans = self.render(turns)
        ids = np.array(self.library.encode(text, allowed_special=self.allowed, disallowed_special=()), dtype=np.int64)
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        low = np.searchsorted(ends, spans[:, 0], "right")
        high = np.searchsorted(starts, spans[:, 1], "left")
        loss = [{"token_from": int(a), "token_to": int(b), "byte_from": max(int(starts[a]), int(s)), "byte_to": min(int(ends[b - 1]), int(e))}
                for a, b, (s, e) in zip(low, high, spans)]
        return text, ids, loss

    def read(self, text: str, ids: bytes, loss: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
        """Turns and texts under loss, from the ids; ``text`` must agree."""
        tokens = [self.token_bytes[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]
        if b"".join(tokens) != text.encode():
            raise ValueError("the ids do not spell the formatted text")
        ends = np.cumsum([len(t) for t in tokens])
        turns, at = [], 0
        for m in self.turn.finditer(text):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            turns.append((unescape(m[1]), unescape(m[2])))
        if at != len(text):
            raise ValueError("text after the last turn")
        under = []
        for s in loss:
            first = int(ends[s["token_from"]]) - len(tokens[s["token_from"]])
            run = b"".join(tokens[s["token_from"]:s["token_to"]])
            under.append(unescape(run[s["byte_from"] - first:s["byte_to"] - first].decode()))
        return turns, under


_FORMATTERS: dict[tuple, Formatter] = {}


def formatter(*key) -> Formatter:
    """One per worker process and parameters."""
    if key not in _FORMATTERS:
        _FORMATTERS[key] = Formatter(*key)
    return _FORMATTERS[key]


_LOSS = "array<struct<token_from:int,token_to:int,byte_from:bigint,byte_to:bigint>>"
_SEGMENT = f"part bigint, seq bigint, whole boolean, formatted string, ids binary, loss {_LOSS}"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _segments(rows, limit: int):
    """``(id, whole, turns)`` of a range: the first conversation may have begun
    before it, the last may go on, and so may what follows a cut."""
    held, chars, conv, whole, begun = [], 0, None, False, False
    for key, _, role, text in rows:
        if begun and key != conv:
            yield conv, whole, held
            held, chars, whole = [], 0, True
        elif chars >= limit:
            yield conv, False, held
            held, chars, whole = [], 0, False
        conv, begun = key, True
        held.append((role, text))
        chars += len(text)
    if begun:
        yield conv, False, held


def format_conversations(rows: DataFrame, path: str, pattern: str, template: Template = CHATML, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, part, seq, whole, formatted, ids, loss``: ids as little-endian
    unsigned 32-bit integers (control strings follow the file's ids in the order
    of ``template.special``).  A row that is ``whole`` is a conversation; others
    are its segments in the order of ``part, seq``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, {_SEGMENT}"
    schema = _schema(ddl)

    def run(batches):
        own, part = formatter(template, path, pattern, loss_role), part_id()
        held, size = [], 0
        for seq, (conv, whole, turns) in enumerate(_segments(rows_of(batches), SEGMENT_CHARS)):
            text, ids, loss = own.encode(turns)
            held.append((conv, part, seq, whole, text, ids.astype("<u4").tobytes(), loss))
            size += len(text)
            if size > SEGMENT_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    src = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    return in_ranges(src, ranges_for(rows)).mapInArrow(run, ddl)


_DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, own: Formatter, text: str, ids: bytes, loss: list[dict]):
        turns, under = own.read(text, ids, loss)
        for role, said in turns:
            self.turns.update(f"{role}\n{said}\n".encode())
        for said in under:
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.n_turns += len(turns)
        self.chars += len(text)
        return self

    def values(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_digests(formatted: DataFrame, path: str, pattern: str, template: Template = CHATML, loss_role: str = "assistant") -> DataFrame:
    """Reads the output of ``format_conversations`` back: per conversation its
    turns, the text under the loss mask and the length, as digests.  Whole rows
    are digested where they stand; segments are put in order, one after the
    other, as a digest must."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    one = f"conv_id {kind}, {_SEGMENT}, {_DIGEST}"
    one_schema = _schema(one)
    ddl = f"conv_id {kind}, {_DIGEST}"
    schema = _schema(ddl)

    def each(batches):
        own = formatter(template, path, pattern, loss_role)
        for batch in batches:
            out = []
            for row in rows_of([batch], 20):
                if row[3]:
                    out.append((*row[:4], None, None, None, *_Digest().add(own, *row[4:]).values()))
                else:
                    out.append((*row, *[None] * 5))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), one_schema)], schema=one_schema)

    def joined(batches):
        own = formatter(template, path, pattern, loss_role)
        for conv, rows in groupby(rows_of(batches, 2), key=lambda r: r[0]):
            total = _Digest()
            for row in rows:
                total.add(own, *row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, *total.values()), schema)], schema=schema)

    found = staged(formatted.select("conv_id", "part", "seq", "whole", "formatted", "ids", "loss").mapInArrow(each, one), "chat-digests")
    torn = by_conversation(found.where("not whole").select("conv_id", "part", "seq", "formatted", "ids", "loss"))
    return found.where("whole").select(*schema.names).unionByName(torn.mapInArrow(joined, ddl))


def with_example(rows: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    two = [F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))]
    one = rows.sparkSession.range(1).select(F.explode(F.array(*two)).alias("r"))
    cast = {c: rows.schema[c].dataType for c in ("conv_id", "turn")}
    return rows.select("conv_id", "turn", "role", "text").union(one.select(
        F.lit(-7).cast(cast["conv_id"]), F.col("r.turn").cast(cast["turn"]), "r.role", F.lit(said)))
