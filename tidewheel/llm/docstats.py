"""Statistics of whole texts, from bytes: what a quality model may look at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import fold, to_bytes, word_hashes

NAMES = [
    "log_bytes", "log_words", "letters", "upper", "digits", "spaces", "high", "marks", "top_mark", "second_mark", "newlines",
    "word_len", "word_len_dev", "long_words", "one_letter", "marked_words", "symbol_words", "end_marks", "distinct_words", "top_word", "longest_run",
    "repeated_pairs", "pair_top", "repeated_fives", "log_lines", "line_len", "line_len_dev", "short_lines", "repeated_lines", "entropy", "bracketed",
]

_LETTER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?")] = True
_ODD = _MARK & ~_ENDS
_ODD[list(b"'\"()-")] = False


def _repeats(h: np.ndarray) -> tuple[float, float]:
    """Share of members that repeat an earlier one, and of the most frequent member."""
    if not len(h):
        return 0.0, 0.0
    s = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return 1 - len(first) / len(s), np.diff(first, append=len(s)).max() / len(s)


def statistics(text: str | None) -> np.ndarray:
    """One float for each of NAMES; a null text is an empty one."""
    data = to_bytes(text)
    out = np.zeros(len(NAMES), np.float32)
    if not data:
        return out
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    count = np.bincount(b, minlength=256)
    share = count / n
    marks = np.sort(np.where(_MARK, share, 0))
    space = np.ones(n + 2, bool)
    space[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    line_end = np.append(np.flatnonzero(b == 10), n)
    lines = np.diff(line_end, prepend=-1) - 1
    used = share[share > 0]
    out[:11] = np.log1p(n), np.log1p(len(start)), share[_LETTER].sum(), share[_UPPER].sum(), share[_DIGIT].sum(), share[32], share[128:].sum(), marks.sum(), marks[-1], marks[-2], share[10]
    if len(start):
        size = end - start
        h = word_hashes(data)
        odd = np.concatenate([[0], np.cumsum(_ODD[b])])
        inner = odd[end] - odd[start]
        distinct, top = _repeats(h)
        change = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        pair = h[1:] * np.uint64(3) + h[:-1] if len(h) > 1 else h[:0]
        five = pair[3:] * np.uint64(5) + pair[:-3] * np.uint64(7) + h[2:-2] if len(h) > 4 else h[:0]
        twice, often = _repeats(pair)
        out[11:24] = (
            size.mean(), size.std(), (size > 25).mean(), (size == 1).mean(), (_MARK[b[start]] | _ODD[b[end - 1]]).mean(), ((inner == size) & (inner > 0)).mean(), _ENDS[b[end - 1]].mean(),
            1 - distinct, top, np.diff(change).max() / len(h), twice, often, _repeats(five)[0],
        )
    sums = np.concatenate([[0], np.cumsum(b, dtype=np.int64)])
    begin = np.concatenate([[0], line_end[:-1] + 1])
    key = (sums[line_end] - sums[begin]) * 1_000_003 + lines * 7919 + np.where(lines > 0, b[np.minimum(begin, n - 1)], 0)
    full = lines > 0
    out[24:30] = np.log1p(len(lines)), np.log1p(lines.mean()), lines.std() / (1 + lines.mean()), (lines < 30).mean(), _repeats(key[full])[0], -(used * np.log2(used)).sum()
    out[30] = share[[60, 62, 91, 93, 123, 124, 125]].sum()
    return out


def with_statistics(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        texts = b.column(b.schema.get_field_index(column))
        yield b, np.stack([statistics(t.as_py()) for t in texts]) if b.num_rows else np.zeros((0, len(NAMES)), np.float32)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, y, text of at most `most` labelled rows outside the held-out fold, in order of a hash of the id.

    The bound is what may be broadcast. Rows without id or label don't count; repeated labels count once."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
        .where(fold(F.col("doc_id"), folds) != held).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
