"""SentencePiece encoding with byte spans of the original text, and decoding.

Normalisation follows the model's compiled character map: at each place the longest matching prefix is replaced, else
one character passes unchanged. Every byte that comes out records the original byte where its source began, so each
piece of the segmentation projects to a span of the original.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁".encode()


@dataclass
class Encoded:
    """ids of one text and, for each, the byte span [begin, end) of the original that it stands for; no spans where the
    pieces do not add up to the normalised text."""

    ids: list[int]
    begin: np.ndarray | None
    end: np.ndarray | None


class CharacterMap:
    """A compiled map: a little-endian trie size, a double-array trie of 32-bit units, and zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units = np.empty(0, np.uint32)
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.text = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place and its replacement."""
        u, found = self.units, None
        unit = int(u[0])
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(u):
                break
            unit = int(u[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                begin = int(u[node]) & 0x7FFFFFFF
                found = k + 1 - at, self.text[begin : self.text.index(0, begin)]
        return found


class Codec:
    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.spec, self.lib = proto.normalizer_spec, sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map, self.suffix = CharacterMap(self.spec.precompiled_charsmap), proto.trainer_spec.treat_whitespace_as_suffix
        kind = proto.SentencePiece
        self.size = np.array([1 if p.type == kind.BYTE else -1 if p.type == kind.UNKNOWN else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.decimal = [str(k) for k in range(len(proto.pieces))]

    def normalised(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each the original byte where its source begins; one more for the end."""
        spec, b = self.spec, np.frombuffer(data, np.uint8)
        if not self.map and not spec.remove_extra_whitespaces:
            source = np.arange(len(b))
        else:
            out, source, at = [], [], 0
            while at < len(data):
                hit = self.map.longest(data, at) if self.map else None
                step = hit[0] if hit else 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = hit[1] if hit else data[at : at + step]
                out.append(new)
                source.extend([at] * len(new))
                at += step
            b, source = np.frombuffer(b"".join(out), np.uint8), np.array(source, np.int64)
            if spec.remove_extra_whitespaces:
                gap = np.concatenate([[True], b == 32])
                keep = ~((b == 32) & gap[:-1])
                full = np.flatnonzero(b != 32)
                keep[full[-1] + 1 if len(full) else 0 :] = False
                b, source = b[keep], source[keep]
        if spec.escape_whitespaces:
            wide = np.where(b == 32, len(SPACE), 1)
            text, source = b.tobytes().replace(b" ", SPACE), np.repeat(source, wide)
        else:
            text = b.tobytes()
        if spec.add_dummy_prefix and text:
            mark = SPACE if spec.escape_whitespaces else b" "
            edge = np.full(len(mark), 0 if not self.suffix else len(data))
            text, source = (text + mark, np.concatenate([source, edge])) if self.suffix else (mark + text, np.concatenate([edge, source]))
        return text, np.append(source, len(data))

    def encode(self, texts: list[str]) -> list[Encoded]:
        return [self._spans(t, i) for t, i in zip(texts, self.lib.encode(texts, num_threads=1), strict=True)]

    def _spans(self, text: str, ids: list[int]) -> Encoded:
        data = text.encode("utf-8", "surrogatepass")
        norm, source = self.normalised(data)
        size = self.size[ids] if ids else np.empty(0, np.int64)
        if len(size) and size.min() < 0:  # unknown pieces: their own text tells the length
            for k, piece in enumerate(self.lib.encode(text, out_type=str)):
                if size[k] < 0:
                    size[k] = len(piece.encode())
        edge = np.concatenate([[0], np.cumsum(size)])
        if edge[-1] != len(norm):
            return Encoded(ids, None, None)
        at = source[edge]
        return Encoded(ids, at[:-1], at[1:])

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.lib.decode(rows) if rows else []


def _all(codec: Codec, coded: list[Encoded], texts: list[str]) -> pa.RecordBatch:
    lists = lambda f: pa.array([f(e) for e in coded], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([lists(lambda e: e.ids), lists(lambda e: e.begin), lists(lambda e: e.end), pa.array(texts, pa.string())], ["ids", "begins", "ends", "decoded"])


def encode_decode(docs: DataFrame, model_path: str, keep: list[str], finish: Callable = _all, schema: str = "ids array<int>, begins array<int>, ends array<int>, decoded string") -> DataFrame:
    """Columns `keep` of docs(text, ...), then ids, begins, ends and the decoded text of every whole text.

    Spans count bytes of the original text in UTF-8. A null or empty text has no pieces and decodes to ''. `finish`
    may make other columns of the same results, on the executors. The model travels by broadcast (its size is that of
    one vocabulary file). Repeated rows are coded alike, an empty table gives no rows. A kept column with the name of a
    result gets a trailing underscore; spans are null for a text whose pieces do not add up."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = [t.as_py() or "" for t in b.column(b.schema.get_field_index("text"))]
                coded = codec.encode(texts)
                made = finish(codec, coded, codec.decode([e.ids for e in coded]))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *made.columns], [*names, *made.schema.names])

    results = {c.strip().split(" ")[0].lower() for c in schema.split(", ")}
    names: list[str] = []
    for c in keep:
        while c.lower() in results or c in names:
            c += "_"
        names.append(c)
    columns = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return source.mapInArrow(run, f"{columns}, {schema}")
