"""Conversations as token ids with a loss mask aligned by offsets.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``; the three control strings are tokens of
their own, so no other token reaches over the edge of a text.  A control string inside a role or
text is escaped: one backslash goes between ``<`` and ``|`` (and any backslashes there), and one
is taken away in reading back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
LEARNT_ROLE = "assistant"
#: A conversation longer than this many characters is put out in several parts, cut between turns.
PART_CHARS = 1 << 20
FORMATTED = "conv_id long, part int, formatted string, ids array<int>, loss array<tinyint>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LEARNT_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def chat_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (START, SEP, END)])
    return tokenizer


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that meets a span; tokens and spans are in order, so two binary searches a span do."""
    ends = np.array(offsets, np.int64).reshape(-1, 2)
    wanted = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(ends[:, 1], wanted[:, 0], side="right")
    last = np.searchsorted(ends[:, 0], wanted[:, 1], side="left")
    change = np.zeros(len(ends) + 1, np.int64)
    full = wanted[:, 1] > wanted[:, 0]
    np.add.at(change, first[full], 1)
    np.add.at(change, last[full], -1)
    return (np.cumsum(change[:-1]) > 0).astype(np.int8)


def formatted(conversations: DataFrame, tokenizer_path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted text, ids and loss mask of every conversation (columns of ``FORMATTED``).

    Rows of a conversation go by turn, ties by role and text; a null turn comes first, a null
    role or text is empty, rows with a null conversation are one conversation.  Equal rows are
    turns each.  Other columns are not read.  A task streams over sorted rows and holds one part
    at a time, so a conversation of any length fits.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_path)
        names = [c.split()[0] for c in FORMATTED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8())]

        def out(parts):
            texts = [rendered(turns) for _, _, turns in parts]
            encoded = tokenizer.encode_batch([t for t, _ in texts], add_special_tokens=False)
            columns = [
                [conv for conv, _, _ in parts], [k for _, k, _ in parts], [t for t, _ in texts],
                [e.ids for e in encoded], [loss_mask(e.offsets, spans) for e, (_, spans) in zip(encoded, texts)],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        ready, size, turns, chars, last, part = [], 0, [], 0, None, 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and (conv != last or chars >= part_chars):
                    ready.append((last, part, turns))
                    size += chars
                    part = part + 1 if conv == last else 0
                    turns, chars = [], 0
                    if size >= part_chars:
                        yield out(ready)
                        ready, size = [], 0
                turns.append((role, text))
                chars += len(text) + 1
                last = conv
        if turns:
            ready.append((last, part, turns))
        if ready:
            yield out(ready)

    return rows.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def id_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id, from the printable stand-ins of the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.encode() if token.startswith("<|") and token.endswith("|>") else bytes(byte[c] for c in token)
    return out


def read_back(output: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of what ``formatted`` put out, decoded from ids and mask (columns of ``DIGESTS``).

    Parts of a conversation follow one another within a partition, as ``formatted`` leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = id_bytes(chat_tokenizer(tokenizer_path))
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        rows, state = [], None

        def done():
            conv, n_turns, turns, loss_chars, loss, chars = state
            return conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def table():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for conv, part, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "ids", "loss"))):
                if part == 0:
                    if state:
                        rows.append(done())
                    state = [conv, 0, sha256(), 0, sha256(), 0]
                text = b"".join([known[i] for i in ids]).decode("utf-8", "surrogatepass")
                state[5] += len(text)
                for role, body in TURN.findall(text):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                edges = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
                for a, b in edges.reshape(-1, 2):
                    learnt = unescape(b"".join([known[i] for i in ids[a:b]]).decode("utf-8", "surrogatepass"))
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "surrogatepass"))
            if rows:
                yield table()
                rows = []
        if state:
            rows.append(done())
            yield table()

    return output.select("conv_id", "part", "ids", "loss").mapInArrow(run, DIGESTS)
