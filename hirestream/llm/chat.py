"""Chat formatting with compiled templates.

Turns are dealt by conversation and sorted inside the partition; a task then streams
them through the compiled template. Output is in segments cut between turns, so a
conversation of any length needs the memory of one segment, and the sort spills on disk.

Defined results: null text or role counts as empty; turns that repeat a number are
ordered by role and text; a null turn number comes first; a null conversation id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .template import Escaper, compile_template

#: Control strings of the format below (fixed values of a public instruction format).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = ("{% for m in messages %}"
            "<s>[INST]{{ m.role | escape }}[/INST]"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
            "{% else %}{{ m.text | escape }}{% endif %}"
            "</s>{% endfor %}")
SEGMENT_CHARS = 1 << 20

_SPANS = "array<struct<start:long,stop:long>>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()),
                        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: Sequence[str] = CONTROLS,
                         segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``conv_id, segment, formatted, loss_spans``: the rendered conversations in segments,
    with the code-point spans of each segment that the loss is taken on. ``messages`` has
    ``role``, ``text`` and ``turn``. Segments of a conversation are consecutive rows of one
    partition, in order."""
    small_batches(turns.sparkSession)
    compile_template(template, controls)  # report mistakes on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_template(template, controls)
        out, held = [], 0
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"turn": t, "role": role, "text": text} for _, t, role, text in rows)
            for n, (text, spans) in enumerate(program.segments({"messages": messages}, segment_chars)):
                out.append((conv, n, text, [{"start": a, "stop": b} for a, b in spans]))
                held += len(text)
                if held >= segment_chars:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _FORMATTED)], schema=_FORMATTED)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _FORMATTED)], schema=_FORMATTED)

    empty = F.lit("")
    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                            F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                            F.coalesce(F.col("text").cast("string"), empty).alias("text"))
                    .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.mapInArrow(run, f"conv_id long, segment long, formatted string, loss_spans {_SPANS}")


def read_turns(formatted: str, escaper: Escaper) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a segment in the format above."""
    start, role, at = 0, None, None
    for m in escaper.token.finditer(formatted):
        token = m[0]
        if token[0] == "\\":
            continue
        if token == "[INST]":
            start = m.end()
        elif token == "[/INST]":
            role, at = escaper.unescape(formatted[start:m.start()]), m.end()
        elif token == "</s>":
            yield role, escaper.unescape(formatted[at:m.start()])


def read_back(formatted: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """Digests of each conversation, read from the output of ``format_conversations`` in
    the same partitions and order: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, out = Escaper(controls), []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, _, text, spans in rows:
                chars += len(text)
                for role, said in read_turns(text, escaper):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    said = escaper.unescape(text[s["start"]:s["stop"]])
                    loss_chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
