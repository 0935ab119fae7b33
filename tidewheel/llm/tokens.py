"""Token counts by section: whole documents are encoded once, token spans are joined to section spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def line_sections(data: bytes) -> np.ndarray:
    """Begins of the lines of a text in UTF-8; each line owns its newline, a text without bytes has one empty section."""
    b = np.frombuffer(data, np.uint8)
    begin = np.flatnonzero(b[:-1] == 10) + 1
    return np.concatenate([[0], begin])


def allocate(begin: np.ndarray, end: np.ndarray, sections: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. Both span lists are in order, so the interval join is two searches.

    A token over a boundary goes, by rule: `first`: to the section of its first byte; `last`: of its last byte;
    `most`: to the section with most of its bytes, the earlier at a tie."""
    n = len(sections)
    first = np.searchsorted(sections, begin, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    crossing = first != last
    owner = {"first": first, "last": last}.get(rule)
    if owner is None:
        owner = first.copy()
        edge = np.append(sections, length)
        for k in np.flatnonzero(crossing):
            held = [min(end[k], edge[j + 1]) - max(begin[k], edge[j]) for j in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(held))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, rule: str = "first", sections=line_sections) -> DataFrame:
    """doc_id, section (from 0), begin, end (bytes), n_tokens, n_crossing for each section of every row of docs.

    The counts of a document's sections sum to the tokens of its whole text. Null and empty texts have one empty section
    with 0 tokens. Repeated rows are counted one by one; other columns are ignored. The ranks are broadcast: their size
    is that of one vocabulary."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"unknown rule {rule}")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]):
        ranks, pattern = shared.value
        coder = tiktoken.Encoding("shared", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns), strict=True):
                    data = (text or "").encode()
                    end = np.cumsum(size[coder.encode_ordinary(text or "")])
                    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
                    cut = sections(data)
                    n, over = allocate(begin, end, cut, len(data), rule)
                    for column, x in zip(out, (np.full(len(cut), -1 if doc_id is None else doc_id), np.arange(len(cut)), cut, np.append(cut[1:], len(data)), n, over), strict=True):
                        column.append(x)
                    if doc_id is None:
                        out[0][-1] = np.ma.masked_all(len(cut), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ma.concatenate(out[0]).astype(np.int64) if any(np.ma.isMaskedArray(x) for x in out[0]) else np.concatenate(out[0]).astype(np.int64)), pa.array(np.concatenate(out[1]).astype(np.int32)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in out[2:])],
                    ["doc_id", "section", "begin", "end", "n_tokens", "n_crossing"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, section int, begin long, end long, n_tokens long, n_crossing long")
