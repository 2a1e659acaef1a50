"""Chat formatting with a loss mask aligned by character offsets.

A conversation is rendered as one text: every turn is ``[INST]role[/INST]text</s>``.
Those three strings never occur inside a rendered role or text, because a
backslash is put after their first character there (and backslashes are
doubled), so the text can be read back exactly.  The whole text is encoded
once, with the control strings as tokens of their own; the sorted character
spans of the texts to learn from are intersected with the sorted token spans by
binary search, which gives the loss mask.

A conversation is one output row, so all its turns meet in one task; the rows
of different conversations never do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rankloom.llm.common import python_workers
# fixed values: the control strings of the template
OPEN, TEXT, CLOSE = "[INST]", "[/INST]", "</s>"

CONTROL = re.compile("|".join(map(re.escape, (OPEN, TEXT, CLOSE))))
TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(CLOSE), re.S)

FORMATTED = (
    "formatted string, n_turns long, input_ids array<int>, token_start array<int>, token_end array<int>, "
    "loss_mask array<boolean>, loss_start array<int>, loss_end array<int>"
)
#: characters encoded at a time; a longer conversation is encoded by itself
BATCH_CHARS = 400_000


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: Iterable[tuple[str, str]], learn: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the texts whose role is in ``learn``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + TEXT, escape(text)
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def masked_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span; both lists are sorted, so each span is two binary searches.

    Tokens of one character that takes several tokens all count.
    """
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def masked_text(formatted: str, starts: Iterable[int], ends: Iterable[int], mask: Iterable[bool]) -> str:
    """All text under the mask, unescaped."""
    pieces, run, last = [], None, 0
    for a, b, learn in zip(starts, ends, mask):
        if learn and run is None:
            run = a
        elif not learn and run is not None:
            pieces.append(formatted[run:last])
            run = None
        last = b
    if run is not None:
        pieces.append(formatted[run:last])
    return "".join(map(unescape, pieces))


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (OPEN, TEXT, CLOSE)])
    return tokenizer


def format_conversations(
    rows: DataFrame,
    tokenizer: str,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: Iterable[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, the formatted text, tokens with offsets, the mask and the learnt spans.

    ``tokenizer`` is the path of a byte-level vocabulary file, readable on
    every executor.  Turns are ordered by number, then role, then text; those
    without a number come last.  A null role or text counts as empty, rows
    without a conversation id form one conversation, repeated rows are kept.
    Other columns of ``rows`` are ignored; an empty table gives no rows.
    """
    python_workers(rows.sparkSession)
    wanted = frozenset(learn)
    order = F.struct(
        F.col(f"`{turn}`").isNull().alias("late"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    whole = rows.groupBy(F.col(f"`{conversation}`").alias("conv_id")).agg(F.sort_array(F.collect_list(order)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    kind = dict(whole.dtypes)["conv_id"]
    out_schema = to_arrow_schema(_parse_datatype_string(f"conv_id {kind}, {FORMATTED}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load_tokenizer(tokenizer)

        def finish(ids: list, done: list) -> pa.RecordBatch:
            out = []
            for conv, (formatted, spans, n), code in zip(ids, done, tool.encode_batch([d[0] for d in done], add_special_tokens=False)):
                offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
                starts, ends = offsets[:, 0], offsets[:, 1]
                mask = masked_tokens(starts, ends, spans)
                out.append((conv, formatted, n, code.ids, starts, ends, mask, [a for a, _ in spans], [b for _, b in spans]))
            arrays = [pa.array(values, field.type) for values, field in zip(zip(*out), out_schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        for batch in batches:
            ids, done, size = [], [], 0
            for conv, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                formatted, spans = render(zip(roles, texts), wanted)
                ids.append(conv)
                done.append((formatted, spans, len(roles)))
                size += len(formatted)
                if size >= BATCH_CHARS:
                    yield finish(ids, done)
                    ids, done, size = [], [], 0
            if ids:
                yield finish(ids, done)

    return whole.mapInArrow(encode, f"conv_id {kind}, {FORMATTED}")
