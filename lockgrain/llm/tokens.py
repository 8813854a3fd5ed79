"""Encoding a corpus with a public byte-level tokenizer.

Texts up to ``LONG`` characters are encoded as they are, in Arrow batches. A longer text is cut into segments that are
encoded in parallel by different tasks and put together by tree concatenation: neighbours are joined pairwise, and at
each join a window around it is encoded again and grows until both sides agree exactly.

Two facts make a join exact. The split pattern has no memory: where two scans share a boundary, all that follows is the
same, so only pieces near the join need a new scan, up to the first boundary both sides have. Inside one unsplit piece
a sequence of tokens is the encoding of its bytes if each pair of neighbours is the encoding of its own bytes, so a
window whose outermost tokens are those of both sides fits in without a change elsewhere.

Defined results: null and empty texts have no ids; strings that look like special tokens are ordinary text; each row
gives one row, repeated rows too.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockgrain.session import bound_batches

LONG = 1 << 16  # characters of a segment
PIECE = 1 << 12  # bytes of an unsplit piece that is encoded at once
EDGE = 4  # characters behind a piece that its end can depend on


@dataclass(frozen=True)
class Vocabulary:
    """Rank file and split pattern of a byte-level tokenizer; the driver reads it once and the tasks get its bytes."""

    ranks: bytes
    pattern: str

    @staticmethod
    def load(path: str | None = None, pattern: str | None = None) -> Vocabulary:
        """``path`` of a .tiktoken file; without one, byte_bpe_50k of the installed public tokenizers."""
        if path is None or pattern is None:
            import public_tokenizers

            path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            return Vocabulary(f.read(), pattern)


@dataclass
class Segment:
    """An encoded stretch of text: ids, and of each piece its end in characters and in ids."""

    text: str
    ids: np.ndarray
    ends: np.ndarray
    marks: np.ndarray


class Encoder:
    def __init__(self, vocabulary: Vocabulary, piece: int = PIECE):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(vocabulary.pattern)
        self.piece = piece

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text of ordinary length."""
        if not text:
            return np.empty(0, np.uint32)
        return np.asarray(self.encoding.encode_ordinary(text), np.uint32)

    def _bytes(self, ids) -> bytes:
        return b"".join(map(self.encoding.decode_single_token_bytes, ids))

    def join_piece(self, a: list[int], b: list[int]) -> list[int]:
        """Ids of one unsplit piece from the ids of its two parts."""
        w = 4
        while True:
            left, right = a[-w:], b[:w]
            ids = self.encoding._core_bpe.encode_single_piece(self._bytes(left + right))
            if (w >= len(a) or ids[0] == left[0]) and (w >= len(b) or ids[-1] == right[-1]):
                return a[: max(0, len(a) - w)] + ids + b[w:]
            w *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one unsplit piece; long ones by halves."""
        if len(piece) <= self.piece:
            return self.encoding._core_bpe.encode_single_piece(piece)
        half = len(piece) // 2
        return self.join_piece(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def segment(self, text: str) -> Segment:
        ids: list[int] = []
        ends, marks = [], []
        for m in self.pattern.finditer(text):
            ids += self.encode_piece(m.group().encode("utf-8", "surrogatepass"))
            ends.append(m.end())
            marks.append(len(ids))
        return Segment(text, np.asarray(ids, np.uint32), np.asarray(ends, np.int64), np.asarray(marks, np.int64))

    def join(self, a: Segment, b: Segment) -> Segment:
        """The segment of both texts one after the other, exactly as if encoded at once."""
        if not len(a.ids):
            return b
        if not len(b.ids):
            return a
        text, cut = a.text + b.text, len(a.text)
        safe = int(np.searchsorted(a.ends, cut - EDGE, side="right"))  # pieces of a that the join can't change
        at = int(a.ends[safe - 1]) if safe else 0
        kept = int(a.marks[safe - 1]) if safe else 0
        ids: list[int] = []
        ends, marks = [], []
        tail = None
        starts_a, starts_b = set(), {0}
        starts_a.update([at, *map(int, a.ends[safe:])])
        ends_b = {int(e): i for i, e in enumerate(b.ends)}
        for m in self.pattern.finditer(text, at):
            s, e = m.span()
            raw = m.group().encode("utf-8", "surrogatepass")
            first_b = ends_b.get(e - cut)
            if len(raw) > self.piece and s in starts_a and s < cut < e and first_b == 0 and not any(s < x < cut for x in starts_a):
                j = int(np.searchsorted(a.ends, s, side="right"))
                begin = int(a.marks[j - 1]) if j else 0
                ids += self.join_piece(a.ids[begin:].tolist(), b.ids[: int(b.marks[0])].tolist())
            else:
                ids += self.encode_piece(raw)
            ends.append(e)
            marks.append(len(ids))
            if e >= cut and (e - cut in starts_b or first_b is not None) and (e + EDGE <= len(text) or e == len(text)):
                tail = 0 if e == cut else first_b + 1
                break
        i = len(b.ends) if tail is None else tail
        skip = int(b.marks[i - 1]) if i else 0
        return Segment(
            text,
            np.concatenate([a.ids[:kept], np.asarray(ids, np.uint32), b.ids[skip:]]),
            np.concatenate([a.ends[:safe], np.asarray(ends, np.int64), b.ends[i:] + cut]),
            np.concatenate([a.marks[:safe], np.asarray(marks, np.int64) + kept, b.marks[i:] - skip + kept + len(ids)]),
        )

    def join_all(self, segments: list[Segment]) -> Segment:
        """Pairs of neighbours, then pairs of pairs, until one is left."""
        while len(segments) > 1:
            segments = [self.join(*segments[i : i + 2]) if i + 1 < len(segments) else segments[i] for i in range(0, len(segments), 2)]
        return segments[0]

    def encode_long(self, text: str, size: int) -> np.ndarray:
        return self.join_all([self.segment(text[i : i + size]) for i in range(0, max(1, len(text)), size)]).ids


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash((vocabulary.ranks, vocabulary.pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _lists(arrays: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    kind = kind or pa.int32()
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _short(get: Callable[[], Vocabulary], counts_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(get())
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column("__text").to_pylist()]
            last = pa.array([len(a) for a in ids], pa.int64()) if counts_only else _lists(ids)
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "__text"), last], names=[*(n for n in batch.schema.names if n != "__text"), "__out"])

    return run


def _cut(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for k, i in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()), "text": [text[i : i + size]]})

    return run


SEGMENT = "key binary, k int, text string, ids array<int>, ends array<long>, marks array<long>"


def _packed(keys: pa.Array, ks: pa.Array, found: list[Segment]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [keys.cast(pa.binary()), ks.cast(pa.int32()), pa.array([s.text for s in found], pa.string()), _lists([s.ids for s in found]), _lists([s.ends for s in found], pa.int64()), _lists([s.marks for s in found], pa.int64())],
        names=["key", "k", "text", "ids", "ends", "marks"],
    )


def _segments(get: Callable[[], Vocabulary]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(get())
        for batch in batches:
            yield _packed(batch.column("key"), batch.column("k"), [enc.segment(t) for t in batch.column("text").to_pylist()])

    return run


def _joined(get: Callable[[], Vocabulary]) -> Callable:
    """One or two neighbours to one segment; what a task holds is one pair, read from the lists' buffers."""

    def run(group: pa.Table) -> pa.Table:
        ks = group.column("k").to_pylist()
        columns = {c: group.column(c).combine_chunks() for c in ("text", "ids", "ends", "marks")}
        read = lambda c, i, kind: columns[c][i].values.to_numpy(zero_copy_only=False).astype(kind)
        order = sorted(range(len(ks)), key=ks.__getitem__)
        parts = [Segment(columns["text"][i].as_py(), read("ids", i, np.uint32), read("ends", i, np.int64), read("marks", i, np.int64)) for i in order]
        whole = encoder(get()).join_all(parts)
        return pa.Table.from_batches([_packed(group.column("key").combine_chunks()[:1], pa.array([ks[0] // 2], pa.int32()), [whole])])

    return run


def encode_corpus(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", counts_only: bool = False, vocabulary: Vocabulary | None = None, long: int = LONG) -> DataFrame:
    """The kept columns and ``out``: the ids of each row's text, or with ``counts_only`` how many there are."""
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary or Vocabulary.load())
    get = lambda: shared.value
    kind = "long" if counts_only else "array<int>"
    slim = df.select(*keep, F.col(text).cast("string").alias("__text"))
    is_long = F.coalesce(F.length("__text") > long, F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("__text").schema.fields)
    longest = slim.agg(F.max(F.length("__text"))).first()[0] or 0
    if longest <= long:
        return slim.mapInArrow(_short(get, counts_only), f"{fields}, __out {kind}").withColumnRenamed("__out", out)
    short = slim.where(~is_long).mapInArrow(_short(get, counts_only), f"{fields}, __out {kind}")

    # Long texts: each distinct one is cut, its segments are encoded by different tasks and joined level by level, pairs
    # of neighbours by different tasks again; then it is given back to all rows that hold it.
    rows = slim.where(is_long).withColumn("key", F.unhex(F.sha2("__text", 256)))
    texts = rows.groupBy("key").agg(F.first("__text").alias("text"))
    parts = texts.mapInArrow(_cut(long), "key binary, k int, text string").repartition("key", "k").mapInArrow(_segments(get), SEGMENT)
    for _ in range((-(-longest // long) - 1).bit_length()):
        parts = parts.groupBy("key", F.shiftright("k", 1).alias("__pair")).applyInArrow(_joined(get), SEGMENT)
    whole = rows.drop("__text").join(parts.select("key", "ids"), "key").select(*keep, (F.size("ids").cast("long") if counts_only else F.col("ids")).alias("__out"))
    return short.unionByName(whole).withColumnRenamed("__out", out)
