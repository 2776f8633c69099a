"""Vector codes by product quantisation, fitted with an active-entry Lloyd iteration on integers.

Components become integers, vectors are cut into consecutive parts, and every part position has its own
codebook. After an update only some entries have moved. A part whose assigned entry stayed fixed keeps
its stored exact distance and is compared with the moved entries alone: every other entry lost against
the same distance before, and still does. A part whose entry moved rescans the whole codebook. Ties go
to the lower index either way, so the result is that of complete scans.

Vectors travel as blocks of bounded size with their codes, distances and the block's sums; a round is
one narrow pass over the blocks, and only the sums (``ENTRIES`` times the dimension, whatever the
table's size) are added across tasks. A round's table is removed once the next one is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setframe.llm.columns import inner
from setframe.llm.scratch import Stored
from setframe.session import materialise, ship_package

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Integer components are held within this, so that distances and sums fit 64 bits.
LARGEST = 1 << 25
#: Numbers in one block.
BLOCK_VALUES = 1 << 16

_STATE = "parts binary, codes binary, distances binary, sums array<bigint>"


def integers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, held within ``LARGEST``."""
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)


def part_slices(dimension: int) -> list[slice]:
    edges = np.linspace(0, dimension, PARTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _squares(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((vectors[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def _scan(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its distance; the first of equals."""
    found = _squares(vectors, entries)
    index = found.argmin(axis=1)
    return index, found[np.arange(len(vectors)), index]


def reassigned(vectors: np.ndarray, codes: np.ndarray, distances: np.ndarray, before: np.ndarray,
               now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances of one part position after its entries went from ``before`` to ``now``."""
    moved = (before != now).any(axis=1)
    codes, distances = codes.copy(), distances.copy()
    rescan = np.flatnonzero(moved[codes])
    fixed = np.flatnonzero(~moved[codes])
    if len(fixed) and moved.any():
        active = np.flatnonzero(moved)
        nearest, distance = _scan(vectors[fixed], now[active])
        index, own, kept = active[nearest], codes[fixed], distances[fixed]
        better = (distance < kept) | ((distance == kept) & (index < own))
        codes[fixed] = np.where(better, index, own)
        distances[fixed] = np.where(better, distance, kept)
    if len(rescan):
        codes[rescan], distances[rescan] = _scan(vectors[rescan], now)
    return codes, distances


def _assign(vectors: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None,
            before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.empty((len(vectors), PARTS), np.int64)
    distances = np.empty((len(vectors), PARTS), np.int64)
    for i, part in enumerate(part_slices(vectors.shape[1])):
        if state is None or before is None:
            codes[:, i], distances[:, i] = _scan(vectors[:, part], now[:, part])
        else:
            codes[:, i], distances[:, i] = reassigned(
                vectors[:, part], state[0][:, i], state[1][:, i], before[:, part], now[:, part])
    return codes, distances


def _sums(vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Component sums by entry (``ENTRIES`` rows, one column for each dimension), then counts."""
    sums = np.zeros((ENTRIES, vectors.shape[1] + PARTS), np.int64)
    for i, part in enumerate(part_slices(vectors.shape[1])):
        for entry in np.unique(codes[:, i]):
            mine = codes[:, i] == entry
            sums[entry, part] = vectors[mine, part].sum(axis=0)
            sums[entry, vectors.shape[1] + i] = mine.sum()
    return sums


def updated(codebook: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries replaced by the floor of their parts' mean; unused entries stay."""
    out, d = codebook.copy(), codebook.shape[1]
    for i, part in enumerate(part_slices(d)):
        count = sums[:len(out), d + i]
        used = count > 0
        out[used, part] = sums[:len(out), part][used] // count[used, None]
    return out


def _state_columns(vectors: np.ndarray, codes: np.ndarray, distances: np.ndarray) -> list[pa.Array]:
    return [pa.array([vectors.astype("<i4").tobytes()], pa.binary()),
            pa.array([codes.astype(np.uint8).tobytes()], pa.binary()),
            pa.array([distances.astype("<i8").tobytes()], pa.binary()),
            pa.array([_sums(vectors, codes).ravel().tolist()], pa.list_(pa.int64()))]


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _first_pass(codebook: np.ndarray):
    d = codebook.shape[1]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, BLOCK_VALUES // d)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                flat = part["v"].flatten().to_numpy(zero_copy_only=False).astype(float)
                vectors = integers(flat.reshape(part.num_rows, d))
                state = _state_columns(vectors, *_assign(vectors, None, None, codebook))
                yield pa.RecordBatch.from_arrays(
                    [_one_list(part["id"]), _one_list(part["label"]), *state],
                    ["ids", "labels", "parts", "codes", "distances", "sums"])
    return blocks


def _read_state(batch: pa.RecordBatch, i: int, d: int):
    vectors = np.frombuffer(batch["parts"][i].as_buffer(), "<i4").reshape(-1, d).astype(np.int64)
    codes = np.frombuffer(batch["codes"][i].as_buffer(), np.uint8).reshape(-1, PARTS)
    distances = np.frombuffer(batch["distances"][i].as_buffer(), "<i8").reshape(-1, PARTS)
    return vectors, (codes.astype(np.int64), distances)


def _next_pass(before: np.ndarray, now: np.ndarray):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors, state = _read_state(batch, i, now.shape[1])
                done = _state_columns(vectors, *_assign(vectors, state, before, now))
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([own["ids"], own["labels"], *done], own.schema.names)
    return blocks


def _last_pass(before: np.ndarray, now: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors, state = _read_state(batch, i, now.shape[1])
                codes, distances = _assign(vectors, state, before, now)
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"].slice(i, 1).flatten(), batch["labels"].slice(i, 1).flatten(),
                     pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()),
                     pa.array(distances.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])
    return rows


def _total(state: DataFrame, width: int) -> np.ndarray:
    """The sums of all blocks: one row of partial sums for each task and position, then one number
    for each position. Only the column of sums is read."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENTRIES * width, np.int64)
        for batch in batches:
            values = batch["sums"].flatten().to_numpy(zero_copy_only=False)
            total += values.reshape(-1, ENTRIES * width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "value": total})

    rows = state.select("sums").mapInArrow(partial, "at int, value bigint").groupBy("at").agg(
        F.sum("value").alias("value")).collect()
    out = np.zeros(ENTRIES * width, np.int64)
    for row in rows:
        out[row["at"]] = row["value"]
    return out.reshape(ENTRIES, width)


def _usable(vector: Column) -> Column:
    """No NULL vector or component, no NaN or infinity, not empty."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def codebook_digest(codebook: np.ndarray) -> str:
    """Over all components by part, entry and position, as decimal text."""
    numbers = [str(int(n)) for part in part_slices(codebook.shape[1])
               for entry in codebook[:, part] for n in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(table: DataFrame, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``(key, code, error, label_error, codebooks_sha256)`` of every usable vector.

    Rows go whose vector is NULL, empty, or holds a NULL or non-finite component, and those of another
    length than the vector with the smallest key. Repeated rows each have a row. The ``ENTRIES``
    smallest keys seed the codebooks (a NULL key is the largest, equal keys go by their vectors);
    fewer rows than entries make a smaller codebook. A length that ``PARTS`` does not divide is cut
    as evenly as possible. Integer components beyond ``LARGEST`` are held at it. Labels that are NULL
    share one ``label_error``. Other columns are not read; an empty table gives an empty one.
    """
    spark = table.sparkSession
    ship_package(spark)
    rows = table.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast(
        "array<double>").alias("v")).where(_usable(F.col("v")))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).select("v").first()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = T.StructType([T.StructField(key, rows.schema["id"].dataType)])
    for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"),
                       ("codebooks_sha256", "string")):
        schema = schema.add(name, kind)
    if first is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == len(first.v))
    seeds = rows.orderBy(*order).limit(ENTRIES).collect()
    codebook = integers(np.array([r.v for r in seeds], float))

    state_schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {_STATE}"
    state = Stored(rows.mapInArrow(_first_pass(codebook), state_schema), "vector-codes")
    for at in range(rounds):
        now = updated(codebook, _total(state.rows, codebook.shape[1] + PARTS))
        if at < rounds - 1:
            following = Stored(state.rows.mapInArrow(_next_pass(codebook, now), state_schema),
                               "vector-codes")
            state.remove()
            state = following
            codebook = now
    coded = materialise(state.rows.mapInArrow(
        _last_pass(codebook, now),
        f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"), "coded")
    state.remove()
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.withColumnRenamed("label", inner("label"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col(inner("label")))).select(
        F.col("id").alias(key), "code", "error", "label_error",
        F.lit(codebook_digest(now)).alias("codebooks_sha256"))
