"""Chat logs folded from events, rendered with a reversible template, and read back.

An event is (conv_id, seq, sub, message_id, kind, role, text). Kinds: ``start`` opens a message with a role,
``delta`` appends text, ``edit`` puts text in place of all so far, ``regenerate`` discards the text so far,
``delete`` removes the message. ``fold`` partitions the log by conversation and message, sorts by sequence and
folds; a conversation of any size is spread over tasks by its messages. ``render`` is per message;
``read_back`` walks through each conversation's messages in order, holding one at a time.

The template is <|turn|>role newline text<|end|> newline. Inside texts a backslash is doubled, and one is put
after the first character of each control string, which ``unescape`` undoes; roles are percent-encoded.

Defined results: null text and role are empty; a message's place is the sequence of its first event, null first;
ties are ordered by role, then text; rows repeated in a table of turns are turns of their own; a null conversation
id is a conversation; events other than the known kinds are an error; an empty log gives nothing; other columns
are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a text must not contain unescaped, this template's own marks and those of common others.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = "(" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL) + ")"
_OPEN, _CLOSE = "<|turn|>", "<|end|>\n"
KINDS = ("start", "delta", "edit", "regenerate", "delete")
_EVENT = ("conv_id", "seq", "sub", "message_id", "kind", "role", "text")


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _ESCAPE, r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_back(role: str) -> str:
    for a, b in (("%5B", "["), ("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = role.replace(a, b)
    return role


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A log in which each row's text comes about by streaming, as an exported table of turns would have.

    By a hash of the row, its message is streamed in two deltas after a draft that is regenerated, or is first sent in
    a wrong version that an edit puts right, or stands beside a message that is deleted; so a wrong fold shows.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("seq"), F.monotonically_increasing_id().cast("string").alias("message_id"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    text = F.col("text")

    def event(sub: int, kind: str, part: Column, message: Column | None = None) -> Column:
        return F.struct(F.lit(sub).cast("bigint").alias("sub"), (F.col("message_id") if message is None else message).alias("message_id"), F.lit(kind).alias("kind"), part.alias("text"))

    start, first, rest, none = event(0, "start", F.lit("")), event(3, "delta", F.left(text, half)), event(4, "delta", F.substr(text, half + 1)), F.lit("")
    draft = F.concat(F.lit("draft "), F.left(F.reverse(text), F.lit(20)))
    gone = F.concat("message_id", F.lit(" gone"))
    regenerated = F.array(start, event(1, "delta", draft), event(2, "regenerate", none), first, rest)
    edited = F.array(start, event(1, "delta", draft), event(2, "edit", F.left(text, half)), rest)
    beside = F.array(start, event(0, "start", none, gone), event(1, "delta", draft, gone), first, event(3, "delete", none, gone), rest)
    kind = F.pmod(F.xxhash64("conv_id", "seq", "role", "text"), F.lit(3))
    parts = F.when(kind == 0, regenerated).when(kind == 1, edited).otherwise(beside)
    return rows.withColumn("e", F.explode(parts)).select("conv_id", "seq", "e.sub", "e.message_id", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        state: dict = {}
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in _EVENT), strict=True):
                conv, seq, _, message, kind, role, text = row
                if key != (conv, message):
                    out += _final(key, state)
                    key, state = (conv, message), {"seq": seq, "role": "", "parts": [], "gone": False}
                if kind == "start":
                    state["role"] = role or ""
                elif kind == "delta":
                    state["parts"].append(text or "")
                elif kind == "edit":
                    state["parts"] = [text or ""]
                elif kind == "regenerate":
                    state["parts"] = []
                elif kind == "delete":
                    state["gone"] = True
                else:
                    raise ValueError(f"an event of unknown kind: {kind}")
            yield pa.RecordBatch.from_pylist(out, _FOLDED)
        yield pa.RecordBatch.from_pylist(_final(key, state), _FOLDED)

    keyed = events.select(*[F.col(c).cast(t).alias(c) for c, t in zip(_EVENT, ("bigint", "bigint", "bigint", "string", "string", "string", "string"), strict=True)])
    return keyed.repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", "seq", "sub").mapInArrow(run, "conv_id bigint, seq bigint, role string, text string")


_FOLDED = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _final(key: tuple | None, state: dict) -> list[dict]:
    return [] if key is None or state["gone"] else [{"conv_id": key[0], "seq": state["seq"], "role": state["role"], "text": "".join(state["parts"])}]


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages with ``formatted`` and the loss mask: code points loss_start to loss_end of it (equal: none)."""
    role, body = _role(F.coalesce("role", F.lit(""))), escape(F.col("text"))
    formatted = F.concat(F.lit(_OPEN), role, F.lit("\n"), F.col("__body"), F.lit(_CLOSE))
    start = F.length(role) + len(_OPEN) + 1
    end = start + F.when(F.col("role").isin(*learn), F.length("__body")).otherwise(0)
    return messages.withColumn("__body", body).select("conv_id", "seq", "role", "text", formatted.alias("formatted"), start.alias("loss_start"), end.alias("loss_end"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its mask alone: counts and digests of turns and of what is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        for batch in batches:
            out = []
            for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if not begun or conv != now["conv_id"]:
                    out += [_closed(now)] if begun else []
                    now, begun = {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}, True
                role, text = parse(formatted)
                learned = unescape(formatted[a:b])
                now["n_turns"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now["loss_chars"] += len(learned)
                now["loss"].update(learned.encode("utf-8", "surrogatepass"))
                now["formatted_chars"] += len(formatted)
            yield pa.RecordBatch.from_pylist(out, _READ)
        if begun:
            yield pa.RecordBatch.from_pylist([_closed(now)], _READ)

    # a digest of a conversation needs its turns in order: they stream through one task, which keeps none of them
    order = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return order.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _closed(x: dict) -> dict:
    return {"conv_id": x["conv_id"], "n_turns": x["n_turns"], "turns_sha256": x["turns"].hexdigest(), "loss_chars": x["loss_chars"], "loss_sha256": x["loss"].hexdigest(), "formatted_chars": x["formatted_chars"]}


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one rendered message."""
    if not (formatted.startswith(_OPEN) and formatted.endswith(_CLOSE)):
        raise ValueError("no rendered message")
    role, _, body = formatted[len(_OPEN) : -len(_CLOSE)].partition("\n")
    if any(c in body for c in CONTROL):
        raise ValueError("a control string inside a text is not escaped")
    return _role_back(role), unescape(body)
