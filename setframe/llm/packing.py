"""Token ids packed into rows of fixed length, best fit decreasing.

A document's ids, closed by an end token, are cut into segments of at most the row length; nothing is
lost. Segments are taken by falling length, each into the fullest row that still holds it. A segment tree
over the capacities answers which one that is: its leaves count the open rows with so much room, and the
smallest sufficient capacity is found by one way up and one way down.

Each task packs what it reads, a buffer of bounded size at a time, so no token is shuffled, memory does not
depend on the data, and a task that is run again gives the same rows. Only the last row of each buffer
may be poorly filled.

A packed row holds the padded ids, the cumulative segment lengths, and for every segment its document and
the place in it; positions start again with every segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.llm.bpe import parse_ranks
from setframe.session import ship_package

ROW_TOKENS = 2048
BUFFER_TOKENS = 1 << 21
END_ID, PAD_ID = 50256, 0


class CapacityTree:
    """Rows by their free capacity, with a search for the smallest that suffices."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.size + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the fullest row with room for ``need``."""
        node = self.size + need
        if not self.count[node]:
            # Up to the first right-hand neighbour that is not empty, then down on the left.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        row = self.rows[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Segments of each row, in the order in which they were placed; ties go by position."""
    tree, rows = CapacityTree(row_tokens), []
    for segment in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[segment]
        found = tree.take(length)
        if found is None:
            capacity, row = row_tokens, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(segment)
        if capacity > length:
            tree.add(capacity - length, row)
    return rows


PACKED = ("shard int, buffer int, row int, n_tokens int, ids binary, cu_seqlens array<int>, "
          "documents array<string>, offsets array<bigint>")
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("buffer", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()),
    ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("documents", pa.list_(pa.string())),
    ("offsets", pa.list_(pa.int64()))])


def _packed(segments: list[tuple[str | None, int, np.ndarray]], shard: int, buffer: int,
            row_tokens: int) -> pa.RecordBatch:
    rows = best_fit_decreasing([len(s[2]) for s in segments], row_tokens)
    columns: dict[str, list] = {name: [] for name in _SCHEMA.names}
    for number, members in enumerate(rows):
        line = np.full(row_tokens, PAD_ID, "<u4")
        ends = [0]
        for member in members:
            ids = segments[member][2]
            line[ends[-1]:ends[-1] + len(ids)] = ids
            ends.append(ends[-1] + len(ids))
        values = (shard, buffer, number, ends[-1], line.tobytes(), ends,
                  [segments[m][0] for m in members], [segments[m][1] for m in members])
        for name, value in zip(_SCHEMA.names, values, strict=True):
            columns[name].append(value)
    return pa.RecordBatch.from_pydict(columns, schema=_SCHEMA)


@lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=parse_ranks(data),
                             special_tokens={})


class LibraryTokenizer:
    """Texts to ids by the library of a vocabulary file, which is sent to the workers once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self._data = spark.sparkContext.broadcast(file.read())
        self._pattern = pattern

    def __getstate__(self):
        return {"_data": self._data, "_pattern": self._pattern}

    def __call__(self, text: str) -> np.ndarray:
        ids = _encoding(self._data.value, self._pattern).encode_ordinary(text)
        return np.array(ids, "<u4")


def pack(docs: DataFrame, tokenize, row_tokens: int = ROW_TOKENS, end_id: int = END_ID,
         buffer_tokens: int = BUFFER_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows (schema ``PACKED``) of all texts; ``tokenize`` gives a text's ids.

    Every input row is packed, repeated rows and NULL keys included; a NULL or empty text is its end
    token alone. ``documents`` holds keys as text and ``offsets`` the place of a segment in its
    document; other columns are not read. ``ids`` is one line of the id matrix, little-endian unsigned
    32-bit, padded with ``PAD_ID`` after ``n_tokens``. ``shard`` and ``buffer`` say which task and
    buffer packed the row.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        segments, held, buffer = [], 0, 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokenize(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), row_tokens):
                    segments.append((k, start, ids[start:start + row_tokens]))
                    held += len(segments[-1][2])
                    if held >= buffer_tokens:
                        yield _packed(segments, shard, buffer, row_tokens)
                        segments, held, buffer = [], 0, buffer + 1
        if segments:
            yield _packed(segments, shard, buffer, row_tokens)

    return docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, PACKED)


def positions(cu_seqlens: list[int], row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Position of every token of a row within its segment; padding has position 0."""
    out = np.zeros(row_tokens, np.int32)
    for start, stop in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[start:stop] = np.arange(stop - start)
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows for training: id matrix, cumulative lengths and position resets by shard."""
    resets = F.expr("slice(cu_seqlens, 1, size(cu_seqlens) - 1)")
    packed.withColumn("position_resets", resets).write.partitionBy("shard").parquet(path)


def described(packed: DataFrame) -> DataFrame:
    """Packed rows with a digest in place of their ids: one row for each, with its segment lengths,
    position resets, documents and places in them."""
    @F.arrow_udf("string")
    def digest(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values.to_pylist()], pa.string())
    return packed.select(
        "shard", "buffer", "row", "n_tokens", digest("ids").alias("ids_sha256"), "cu_seqlens",
        F.expr("slice(cu_seqlens, 1, size(cu_seqlens) - 1)").alias("position_resets"),
        "documents", "offsets")
