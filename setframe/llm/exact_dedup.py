"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a text is its length and two residues of the polynomial whose coefficients are its
bytes. Chunks are hashed on their own, as rows of one matrix product, and the parts compose: the
fingerprint of ``AB`` is that of ``A`` shifted by the length of ``B``, plus that of ``B``. So chunks of
a huge document may be hashed in any order and on any machine (:func:`fingerprint_of_parts`).

Equal fingerprints are only candidates. Every such text is compared with the one that would stay,
chunk by chunk; texts that differ after all form a group of their own, until nothing differs.

Case is folded for A-Z only.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.llm.columns import struct_array, texts
from setframe.session import broadcast_if_small, materialise, ship_package

#: Prime moduli and bases of the two residues.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes hashed by one row of the matrix product: sums stay below 2**53, exact in doubles.
CHUNK_BYTES = 4096
#: Characters that are compared at a time.
CHUNK_CHARS = 1 << 20
#: Members of a group that are compared with one copy of the text that stays.
MEMBERS_PER_COPY = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Fingerprint(NamedTuple):
    length: int
    residues: tuple[int, ...]

    def then(self, other: Fingerprint) -> Fingerprint:
        """The fingerprint of the concatenation."""
        shifted = tuple((a * pow(base, other.length, p) + b) % p for a, b, base, p
                        in zip(self.residues, other.residues, BASES, MODULI, strict=True))
        return Fingerprint(self.length + other.length, shifted)


EMPTY = Fingerprint(0, (0,) * len(MODULI))


def _powers() -> np.ndarray:
    columns = []
    for base, p in zip(BASES, MODULI, strict=True):
        column = [1]
        for _ in range(CHUNK_BYTES - 1):
            column.append(column[-1] * base % p)
        columns.append(column[::-1])
    return np.array(columns, float).T


_POWERS = _powers()


def fingerprint(data: bytes) -> Fingerprint:
    """Hash all chunks at once, then compose them pairwise."""
    values = np.frombuffer(data, np.uint8).astype(float)
    whole = len(values) // CHUNK_BYTES * CHUNK_BYTES
    rows = values[:whole].reshape(-1, CHUNK_BYTES) @ _POWERS
    parts = [Fingerprint(CHUNK_BYTES, tuple(int(v) % p for v, p in zip(row, MODULI, strict=True)))
             for row in rows]
    if whole < len(values):
        last = values[whole:] @ _POWERS[whole - len(values):]
        parts.append(Fingerprint(len(values) - whole,
                                 tuple(int(v) % p for v, p in zip(last, MODULI, strict=True))))
    while len(parts) > 1:
        pairs = [parts[i].then(parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[2 * len(pairs):]
    return parts[0] if parts else EMPTY


def fingerprint_of_parts(parts: list[bytes]) -> Fingerprint:
    """The fingerprint of the concatenation of parts that are hashed separately."""
    return reduce(Fingerprint.then, map(fingerprint, parts), EMPTY)


def _prints(text: str) -> Column:
    @F.arrow_udf("length bigint, f1 bigint, f2 bigint, sha string")
    def prints(values: pa.Array) -> pa.Array:
        lower = [t.encode().lower() for t in texts(values)]
        found = [fingerprint(t) for t in lower]
        return struct_array(
            length=pa.array([f.length for f in found], pa.int64()),
            f1=pa.array([f.residues[0] for f in found], pa.int64()),
            f2=pa.array([f.residues[1] for f in found], pa.int64()),
            sha=pa.array([hashlib.sha256(t).hexdigest() for t in lower], pa.string()))
    return prints(text)


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _chunks(rows: DataFrame) -> DataFrame:
    """One row for every chunk of ``t``; an empty text has one empty chunk."""
    last = F.floor(F.greatest(F.length("t") - 1, F.lit(0)) / CHUNK_CHARS)
    numbered = rows.withColumn("no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = (F.col("no") * CHUNK_CHARS + 1).cast("int")
    return numbered.withColumn("t", F.col("t").substr(start, F.lit(CHUNK_CHARS)))


_GROUP = ["length", "f1", "f2", "part"]


def _grouped(prints: DataFrame) -> DataFrame:
    """Prints with their group's size and the row that stays: the largest key, of equal keys the
    largest text digest."""
    groups = prints.groupBy(*_GROUP).agg(
        F.sum("n").alias("size"), F.max(F.struct("k", "x")).alias("keeper"))
    return prints.join(groups, _GROUP)


def _different(source: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows ``(k, x)`` whose text is not that of their group's keeper, found chunk by chunk.

    A group's text is copied once for every ``MEMBERS_PER_COPY`` of its members, so that a group of
    any size is compared by as many tasks as it needs.
    """
    copies = F.ceil(F.col("members") / MEMBERS_PER_COPY).cast("int")
    keeps = F.col("k").eqNullSafe(F.col("keeper.k")) & (F.col("x") == F.col("keeper.x"))
    several = grouped.withColumn("keeps", keeps).where("size > n")
    counted = several.select("k", "x", "keeper", "keeps", F.col("size").alias("members"), "part")
    counted = counted.withColumnRenamed("k", "own_k").withColumnRenamed("x", "own_x")
    with_text = source.join(broadcast_if_small(counted),
                            source.k.eqNullSafe(F.col("own_k")) & (source.x == F.col("own_x")))
    # Rows alike in key and text are compared once each; all agree.
    salt = F.pmod(F.xxhash64("k", "x"), copies)
    members = _chunks(with_text.where(~F.col("keeps")).withColumn("salt", salt))
    keepers = _chunks(with_text.where("keeps").dropDuplicates(["own_k", "own_x", "part"])
                      .withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))))
    keepers = keepers.select(
        F.struct("k", "x").alias("keeper"), "part", "no", F.col("salt").cast("bigint").alias("salt"),
        F.col("t").alias("kept_text"))
    same_place = [members[c].eqNullSafe(keepers[c]) for c in ("keeper", "part", "no", "salt")]
    pairs = members.join(keepers, reduce(Column.__and__, same_place))
    equal = F.when(F.col("t") == F.col("kept_text"), F.lit(True)).otherwise(
        _folded(F.col("t")) == _folded(F.col("kept_text")))
    return pairs.where(~equal).select("k", "x").distinct()


def _settled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for every distinct (key, text): prints, group, and how often the row occurs."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    source = source.withColumn("x", F.xxhash64("t"))
    prints = (source.select("k", "x", _prints("t").alias("p")).select("k", "x", "p.*")
              .groupBy("k", "x", "length", "f1", "f2", "sha").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("part", F.lit(0)))
    prints = materialise(prints, "fingerprints")
    while True:
        grouped = materialise(_grouped(prints), "groups")
        different = materialise(_different(source, grouped), "different")
        if different.isEmpty():
            return grouped
        # A collision: what differs from its group's keeper is a group of its own.
        marked = different.withColumnsRenamed({"k": "dk", "x": "dx"})
        moved = prints.join(marked, prints.k.eqNullSafe(marked.dk) & (prints.x == marked.dx), "left")
        prints = materialise(moved.withColumn(
            "part", F.col("part") + F.col("dx").isNotNull().cast("int")).drop("dk", "dx"),
            "fingerprints")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Duplicates of every row: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    One row for every input row, dropped ones too; other columns are not read. NULL reads as an empty
    text; empty texts are equal to each other. Of equal texts the row with the largest key stays, a
    NULL key being the smallest; of rows that agree in key and folded text one stays. An empty table
    gives an empty one.
    """
    occurrence = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    stays = (F.col("k").eqNullSafe(F.col("keeper.k")) & (F.col("x") == F.col("keeper.x"))
             & (F.col("occurrence") == 1))
    return (_settled(docs, key, text).withColumn("occurrence", occurrence)
            .select(F.col("k").alias(key), F.col("keeper.k").alias("keep_id"),
                    F.col("size").alias("group_size"), stays.alias("kept"),
                    F.col("sha").alias("text_sha256")))


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Rows alike in key and text are reduced to one of them; all other rules are those of
    :func:`exact_duplicates`.
    """
    digest = "__sf_text_digest"
    settled = _settled(docs, key, text)
    stays = F.col("k").eqNullSafe(F.col("keeper.k")) & (F.col("x") == F.col("keeper.x"))
    gone = settled.where(~stays).select(F.col("k").alias("__sf_key"), F.col("x").alias("__sf_x"))
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    left = marked.join(broadcast_if_small(gone), F.col(key).eqNullSafe(F.col("__sf_key"))
                       & (F.col(digest) == F.col("__sf_x")), "left_anti")
    if not settled.where(stays & (F.col("n") > 1)).isEmpty():
        left = left.dropDuplicates([key, digest])
    return left.drop(digest)
