"""Token counts of fields and sections by offset mapping.

A document is encoded once, as a whole.  Token byte lengths give every token's
character span; an interval join of the spans with the sections (each field, a
text field cut into its lines) attributes tokens.  A token that crosses a
border goes to the section that holds most of its characters, and to the
earlier one of equals.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_encodings: dict[str, tuple] = {}


def encoding(path: str, pattern: str) -> tuple:
    """A byte-level BPE encoding and its token lengths in bytes; kept by each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encodings[path] = (tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _encodings[path]


def char_spans(raw: np.ndarray, byte_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that end at *byte_ends*; a character cut by a border is in both tokens' spans."""
    starts = np.concatenate([[0], byte_ends[:-1]]).astype(np.int64)
    leads = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    return leads[starts] - 1, leads[byte_ends - 1]


def attribute(first: np.ndarray, stop: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, and whether the token crosses a border; *borders* are the sections' starts."""
    own = np.searchsorted(borders, first, side="right") - 1
    last = np.searchsorted(borders, stop - 1, side="right") - 1
    crossing = last > own
    ends = np.append(borders[1:], np.iinfo(np.int64).max)
    for t in np.flatnonzero(crossing):
        k = np.arange(own[t], last[t] + 1)
        share = np.minimum(ends[k], stop[t]) - np.maximum(borders[k], first[t])
        own[t] = k[int(share.argmax())]
    return own, crossing


def sections_of(values: list[str], by_line: list[bool], joint: str) -> tuple[str, list[int], list[int], np.ndarray]:
    """The whole document, and of each section its field, its number in the field, and its start.

    A joint belongs to the field before it, a line feed to the line that it ends; an empty section has no character.
    """
    whole, field, number, starts, at = [], [], [], [], 0
    for f, value in enumerate(values):
        if f:
            whole.append(joint)
            at += len(joint)
        whole.append(value)
        begin = at
        lines = value.split("\n") if by_line[f] else [value]
        for k, line in enumerate(lines):
            field.append(f)
            number.append(k)
            starts.append(begin)
            begin += len(line) + 1
        at += len(value)
    return "".join(whole), field, number, np.array(starts, np.int64)


def count(docs: DataFrame, fields: list[str], path: str, pattern: str, by_line: tuple[str, ...] = ("text",), joint: str = "\n", carry: list[str] | None = None) -> DataFrame:
    """Tokens of every document, and of each field and section of it.

    The *fields* of a row, joined by *joint*, are its document; the fields in *by_line* are cut into
    lines.  Adds ``n_tokens``, ``n_crossing`` and ``sections array<struct<field,section,start,tokens>>``
    to the *carry* columns (default: all); columns of these names are replaced.  Null fields are empty.
    Sections' tokens sum to ``n_tokens``.  Repeated rows give repeated rows.  A token whose characters tie
    between two sections goes to the earlier.  An empty table gives an empty table.  One map, no shuffle.
    """
    names = ["n_tokens", "n_crossing", "sections"]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in names]
    source = docs.select(*[f"`{c}`" for c in carry], *[docs[f].cast("string").alias(f"__field{k}") for k, f in enumerate(fields)])
    cut = [f in by_line for f in fields]
    kind = pa.list_(pa.struct([("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("tokens", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, lengths = encoding(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                values = [part.column(len(carry) + k).to_pylist() for k in range(len(fields))]
                total, crossed, offsets = [], [], [0]
                field_, number_, start_, tokens_ = [], [], [], []
                for row in zip(*values):
                    text, field, number, starts = sections_of([x or "" for x in row], cut, joint)
                    ids = np.array(codec.encode_ordinary(text), np.int64)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    # Of sections that start at one place only the last can hold characters.
                    live = np.append(np.diff(starts) > 0, True) if len(starts) else np.zeros(0, bool)
                    at = np.flatnonzero(live)
                    tokens = np.zeros(len(starts), np.int64)
                    cross = np.zeros(0, bool)
                    if len(ids):
                        first, stop = char_spans(raw, np.cumsum(lengths[ids]))
                        own, cross = attribute(first, stop, starts[at])
                        tokens[at] = np.bincount(own, minlength=len(at))
                    total.append(len(ids))
                    crossed.append(int(cross.sum()))
                    field_ += field
                    number_ += number
                    start_.append(starts)
                    tokens_.append(tokens)
                    offsets.append(offsets[-1] + len(starts))
                entries = pa.StructArray.from_arrays([pa.array(np.array(fields, object)[field_] if field_ else [], pa.string()), pa.array(number_, pa.int32()), pa.array(np.concatenate(start_), pa.int64()), pa.array(np.concatenate(tokens_), pa.int32())], names=["field", "section", "start", "tokens"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries).cast(kind)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(total, pa.int64()), pa.array(crossed, pa.int64()), lists], [*carry, *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(carry)])
    return source.mapInArrow(work, f"{kept}n_tokens bigint, n_crossing bigint, sections array<struct<field:string,section:int,start:bigint,tokens:int>>")
