"""Chat formatting: conversations through a compiled template, with the parts a model would generate marked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.template import Chunk, compiled, unescape
from siftpool.llm.textops import parts_for

#: Each turn names its role between instruction marks; what an assistant says is generated.
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' + '[INST] ' }}{{ m.role | escape }} [/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>\n{% endfor %}"
)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>\n", re.DOTALL)


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, role, text); each conversation's in one partition, one after another by turn, then role and text."""
    own = rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.repartition(parts_for(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation and its messages, read as they are asked for."""
    rows = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(b.column("conv").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()))
    now = next(rows, None)

    def messages(conv):
        nonlocal now
        while now is not None and now[0] == conv:
            message, now = now[1], next(rows, None)
            yield message

    while now is not None:
        conv = now[0]
        own = messages(conv)
        yield conv, own
        for _ in own:  # what the template left
            pass


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, formatted, generated): each conversation as one text, and the spans of code points under the loss mask.

    Turns are ordered by their number, nulls first, ties by role and text;
    repeated rows are turns of their own. Null roles and texts are empty; rows
    of a null conversation make one. Other columns are not read; an empty table
    gives no rows.
    """
    render = compiled(template)

    def run(batches):
        for c, messages in _conversations(batches):
            out, at, spans = [], 0, []
            for chunk, generated in render(messages=messages):
                if generated and spans and spans[-1]["end"] == at:
                    spans[-1]["end"] += len(chunk)
                elif generated:
                    spans.append({"start": at, "end": at + len(chunk)})
                out.append(chunk)
                at += len(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array(["".join(out)], pa.string()), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv", "formatted", "generated"])

    return _ordered(rows, conv, turn, role, text).mapInArrow(run, "conv bigint, formatted string, generated array<struct<start:bigint,end:bigint>>").withColumnRenamed("conv", conv)


def read_back(chunks: Iterator[Chunk]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of a formatted conversation of TEMPLATE.

    Turns are found by their marks in the text alone; only the turn at hand is held.
    """
    held, loss = "", ""
    for chunk, generated in chunks:
        held += chunk
        if generated:
            loss += chunk
        while m := _TURN.match(held) if held.endswith("</s>\n") or "</s>\n" in chunk else None:
            yield unescape(m[1]), unescape(m[2]), unescape(loss)
            held, loss = held[m.end() :], ""
    if held:
        raise ValueError("a formatted conversation ends within a turn")


def conversation_digest(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from each formatted conversation.

    Conversations are formatted and read back turn by turn, so one of any length
    takes the memory of a turn. Cases are as in format_conversations().
    """
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    render = compiled(TEMPLATE)

    def run(batches):
        out = []
        for c, messages in _conversations(batches):
            n, turns, loss, loss_chars, size = 0, hashlib.sha256(), hashlib.sha256(), 0, 0

            def counted(chunks):
                nonlocal size
                for chunk in chunks:
                    size += len(chunk[0])
                    yield chunk

            for own_role, own_text, own_loss in read_back(counted(render(messages=messages))):
                n += 1
                turns.update(f"{own_role}\n{own_text}\n".encode())
                loss.update(own_loss.encode())
                loss_chars += len(own_loss)
            out.append((c, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return _ordered(rows, conv, turn, role, text).mapInArrow(run, "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("conv", conv)
