"""Chat formatting with offset-aligned loss masks.

Template, by turn: <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> and a line feed.
The three marks are tokens of their own, so no token crosses a text's ends.  In
roles and texts every "<", any backslashes, "|" gets one more backslash; no mark
can then appear inside them, and taking one off restores them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import common

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """
    >>> escape("a<|im_end|>")
    'a<\\\\|im_end|>'
    """
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(the conversation, the span of each turn's text in it)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        at += len(head)
        spans.append((at, at + len(body)))
        at += len(body) + len(END) + 1
        parts += [head, body, END, "\n"]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, by their ascending offsets, lie in one of the ascending spans."""
    edges = np.asarray(spans, np.int64).reshape(-1, 2)
    at = np.searchsorted(edges[:, 0], starts, "right") - 1
    return (at >= 0) & (ends <= np.where(at >= 0, edges[at, 1], -1) if len(edges) else np.zeros(len(starts), bool)) & (ends > starts)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped: one for each run of masked tokens."""
    where = np.flatnonzero(chosen)
    if not len(where):
        return []
    breaks = np.flatnonzero(np.diff(where) > 1)
    first, last = np.concatenate([where[:1], where[breaks + 1]]), np.concatenate([where[breaks], where[-1:]])
    return [unescape(formatted[a:b]) for a, b in zip(starts[first].tolist(), ends[last].tolist())]


_tokenizers: dict[str, Any] = {}


def chat_tokenizer(path: str) -> Any:
    """The file's tokenizer with the template's marks as tokens, and offsets that keep white space."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer, processors

        tok = Tokenizer.from_file(path)
        tok.add_special_tokens([START, SEP, END])
        tok.post_processor = processors.ByteLevel(trim_offsets=False)
        tok.no_padding()
        tok.no_truncation()
        _tokenizers[path] = tok
    return _tokenizers[path]


def format_chats(
    df: DataFrame, tokenizer: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """A row a conversation: conv, n_turns, formatted, input_ids, starts, ends (offsets in code points) and loss_mask.

    Turns are ordered by turn, then role and text; equal rows are turns of their
    own.  Null roles and texts are empty; null turns come first; null
    conversations form one.  tokenizer: a byte-level file, whose offsets cover
    all of the text.  An empty table gives no rows; other columns are ignored.
    A conversation is one row of the result, so one task holds it; several
    thousand turns are a few MB.
    """
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    out = common.schema_of(common.field(df, conv_col), ("n_turns", T.LongType()), ("formatted", T.StringType()), ("input_ids", ints), ("starts", longs), ("ends", longs), ("loss_mask", T.ArrayType(T.BooleanType())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, kind = chat_tokenizer(tokenizer), None
        state: list = []  # the open conversation: id, turns
        done: list[tuple] = []
        size = 0

        def finish() -> None:
            conv, turns = state
            formatted, spans = render(turns)
            enc = tok.encode(formatted, add_special_tokens=False)
            offsets = np.asarray(enc.offsets, np.int64).reshape(-1, 2)
            chosen = mask(offsets[:, 0], offsets[:, 1], [s for s, (role, _) in zip(spans, turns) if role in loss_roles and s[0] < s[1]])
            done.append((conv, len(turns), formatted, np.asarray(enc.ids, np.int32), offsets[:, 0], offsets[:, 1], chosen))

        def batch() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=out.names)
            done.clear()
            return made

        for whole in batches:
            kind = whole.schema.field(0).type
            for conv, role, text in zip(*(whole.column(i).to_pylist() for i in (0, 2, 3))):
                if not state or state[0] != conv:
                    if state:
                        finish()
                    state[:] = [conv, []]
                    if size > common.SLICE_BYTES:
                        size = 0
                        yield batch()
                state[1].append((role or "", text or ""))
                size += len(text or "")
        if state:
            finish()
        if done:
            yield batch()

    common.small_batches(df.sparkSession)
    rows = df.select(conv_col, turn_col, role_col, text_col)
    return rows.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, role_col, text_col).mapInArrow(common.releasing(work), out)
