"""Chat formatting at the level of tokens.

A conversation is written as `<s>`, then for each turn `[INST]`role`[/INST]`text`</s>`.
The four control strings are reserved ids beyond the vocabulary, spliced in between
segments that are encoded each for itself, so no content can make one. In content the
control strings are escaped, by a backslash after the first character (and one more where
there are some), which unescaping takes away, so the rendered text can be read back too.
The loss mask marks the texts of assistants: +1 where one begins, -1 where it ends, summed up.

Turns are encoded where they lie; their ids then go by conversation, in order, and are
assembled as a stream into pieces of bounded length.

Defined cases: null role or text is empty; turns of one number are ordered by role, then
text, nulls first; rows that repeat are turns of their own; null is a conversation id like
others; very long texts are encoded in parts, whose ids need not be the whole text's but
say the same; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_chunks, trimmed

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, ROLE, TEXT, END)
TRAINED = "assistant"
#: Ids of a piece of a conversation, about: it ends with the turn that passes this.
PIECE = 1 << 16
#: Characters that are encoded at once.
ENCODED_CHARS = 1 << 14

_PLAIN = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@functools.cache
def encoding(path: str, pattern: str):
    """Byte-level BPE from a file of ranks, and every id's bytes with the control strings after them."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    size = max(ranks.values()) + 1
    pieces = [b""] * (size + len(CONTROLS))
    for piece, i in ranks.items():
        pieces[i] = piece
    for i, c in enumerate(CONTROLS):
        pieces[size + i] = c.encode()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pieces, size


def encoded_text(enc, text: str) -> np.ndarray:
    """Ids of an escaped text; long ones are cut, where there is one before a space, as patterns recurse over long runs."""
    ids, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > ENCODED_CHARS:
            space = text.rfind(" ", at + 1, at + ENCODED_CHARS)
            end = space if space > at else at + ENCODED_CHARS
        ids.append(np.array(enc.encode_ordinary(text[at:end]), "<u4"))
        at = end
    return np.concatenate(ids) if ids else np.zeros(0, "<u4")


def encoded(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Turns with the ids of role and text, each encoded for itself after escaping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)[0]
        ids = lambda s: encoded_text(enc, escape(s or "")).tobytes()
        for batch in text_chunks(batches):
            made = [pa.array(map(ids, batch.column(c).to_pylist()), pa.binary()) for c in ("role", "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "role_ids", "text_ids"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(lambda batches: trimmed(run(batches)), "conv_id long, turn long, role string, text string, role_ids binary, text_ids binary")


def assembled(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, piece, ids, mask): ids as uint32, the mask a byte for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, role, text, end = range(encoding(path, pattern)[2], encoding(path, pattern)[2] + 4)

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(segments)
            starts = np.cumsum([0, *map(len, segments)])
            delta = np.zeros(len(ids) + 1, np.int8)
            for i in trained:
                delta[starts[i]] += 1
                delta[starts[i + 1]] -= 1
            mask = np.cumsum(delta[:-1], dtype=np.int8)
            return pa.RecordBatch.from_pydict({"conv_id": [now], "piece": [piece], "ids": [ids.astype("<u4").tobytes()], "mask": [mask.tobytes()]}, schema=schema)

        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])
        mark = lambda i: np.array([i], np.uint32)
        now, piece, segments, trained, size, any_yet = None, 0, [], [], 0, False
        for batch in batches:
            for conv, who, r, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "role_ids", "text_ids")), strict=True):
                if not any_yet or conv != now:
                    if segments:
                        yield flush()
                    now, piece, segments, trained, size, any_yet = conv, 0, [mark(begin)], [], 0, True
                elif size > PIECE:
                    yield flush()
                    piece, segments, trained, size = piece + 1, [], [], 0
                t = np.frombuffer(t, "<u4")
                segments += [mark(role), np.frombuffer(r, "<u4"), mark(text), t, mark(end)]
                if who == TRAINED and len(t):
                    trained.append(len(segments) - 2)
                size += len(r) // 4 + len(t)
        if segments:
            yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "role_ids", "text_ids").mapInArrow(lambda batches: trimmed(run(batches)), "conv_id long, piece long, ids binary, mask binary")


def read_back(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ids and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, size = encoding(path, pattern)
        text_of = lambda ids: b"".join([table[i] for i in ids.tolist()]).decode()
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        row = lambda: pa.RecordBatch.from_pydict({"conv_id": [now], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [loss_n], "loss_sha256": [loss.hexdigest()], "formatted_chars": [chars]}, schema=schema)
        any_yet, now, n, loss_n, chars, turns, loss = False, None, 0, 0, 0, None, None
        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if not any_yet or conv != now:
                    if any_yet:
                        yield row()
                    any_yet, now, n, loss_n, chars, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.int8) > 0
                chars += len(text_of(ids))
                at = lambda k: np.flatnonzero(ids == size + k)  # noqa: B023, E731
                for a, b, c in zip(at(1), at(2), at(3), strict=True):
                    turns.update(f"{unescape(text_of(ids[a + 1 : b]))}\n{unescape(text_of(ids[b + 1 : c]))}\n".encode())
                    n += 1
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    said = unescape(text_of(ids[a:b]))
                    loss.update(said.encode())
                    loss_n += len(said)
        if any_yet:
            yield row()

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(lambda batches: trimmed(run(batches)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Formats all turns (conv_id, turn, role, text), writes them, and returns (conv_id, piece, ids, mask)."""
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return materialise(assembled(encoded(own, path, pattern), path, pattern), "chats")
