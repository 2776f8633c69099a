"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors whose cosine is at least ``c`` are at most ``2 - 2c`` apart, squared. The vectors are
rotated and cut into blocks of a few dimensions; if two stay within that budget, then in some block they
stay within the block's proportional part of it. So every block is range-joined under its own budget, and
what is found in any block is verified with all dimensions, in double precision.

The vectors of a label are dealt into chunks of bounded size, and every pair of chunks is a tile: a vector
travels once for each chunk of its label, whatever the number of blocks, and a large label is many tasks.
Within a tile a block's range join is a tree over all of the block's coordinates: one side is halved down to
leaves, and a vector of the other side goes down only where its range reaches. A pair found in several
blocks counts in the first of them only. A tile gives link counts and links that span what it has
connected, never all pairs.

Vectors that are equal are one representative with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.llm.components import components
from setframe.session import broadcast_if_small, materialise, ship_package

BLOCKS = 8
#: A chunk has about so many vectors at most, and so many numbers.
TILE, TILE_VALUES = 32_768, 32_768 * 64
#: Vectors of a leaf; pairs that are looked up together; the share of a leaf's pairs from which they are multiplied out.
LEAF, PAIRS, DENSE = 32, 16_384, 0.05
#: Added to budgets against rounding; verification decides.
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dimensions: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    gauss = np.random.default_rng(dimensions).normal(size=(dimensions, dimensions))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def blocks(dimensions: int) -> list[slice]:
    edges = np.linspace(0, dimensions, min(BLOCKS, dimensions) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def budgets(dimensions: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may have, in proportion to its dimensions."""
    sizes = np.array([b.stop - b.start for b in blocks(dimensions)])
    return (2.0 - 2.0 * cosine) * sizes / dimensions + SLACK


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1)


def _usable(vector: str) -> Column:
    """Whether a vector can be compared: no NULL, NaN or infinity, and not all zero."""
    @F.arrow_udf("boolean")
    def usable(values: pa.Array) -> pa.Array:
        lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), bool)
        for d in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == d)
            numbers = _matrix(values.take(pa.array(at)))  # a NULL reads as NaN
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.linalg.norm(numbers, axis=1)
            out[at] = np.isfinite(numbers).all(axis=1) & np.isfinite(norms) & (norms > 0)
        return pa.array(out, pa.bool_())
    return usable(vector)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (-2 * x) @ y.T
    out += (x ** 2).sum(1)[:, None]
    out += (y ** 2).sum(1)[None, :]
    return out


def _leaves(x: np.ndarray, y: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of ``x`` of at most ``LEAF`` rows, each with the rows of ``y`` whose squared distance to the part's
    box is within the budget; together they have every pair within it."""
    box = np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf)
    left = [(np.arange(len(x)), np.arange(len(y)), np.zeros(len(y)), *box)]
    while left:
        own, near, gap, low, high = left.pop()
        if not len(near) or len(own) <= LEAF:
            if len(near):
                yield own, near
            continue
        values = x[own]
        axis = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
        column, there = values[:, axis], y[near, axis]
        # The squared distance to the box, but for the axis that is cut.
        gap = gap - np.maximum(0.0, np.maximum(low[axis] - there, there - high[axis])) ** 2
        order = np.argpartition(column, len(own) // 2)
        for part in (order[:len(own) // 2], order[len(own) // 2:]):
            a, b = low.copy(), high.copy()
            a[axis], b[axis] = column[part].min(), column[part].max()
            now = gap + np.maximum(0.0, np.maximum(a[axis] - there, there - b[axis])) ** 2
            kept = now <= budget
            left.append((own[part], near[kept], now[kept], a, b))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of everyone's set, once the sets of ``a`` and ``b`` are joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


class _Tile:
    """The vectors of one or two chunks, what is linked with how many, and who is connected."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, cosine: float) -> None:
        d = vectors.shape[1]
        self.vectors, self.copies, self.cosine = vectors, copies, cosine
        self.norms = np.linalg.norm(vectors, axis=1)
        self.turned = _unit(vectors) @ rotation(d)
        self.parts, self.limits = blocks(d), budgets(d, cosine)
        self.count = np.zeros(len(vectors), np.int64)
        self.root = np.arange(len(vectors))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.copies[b])
        np.add.at(self.count, b, self.copies[a])
        self.root = _joined(self.root, a, b)

    def looked_up(self, number: int, a: np.ndarray, b: np.ndarray) -> None:
        """Link the pairs that are near enough and have ``number`` as their first block."""
        starts = [part.start for part in self.parts]
        for at in range(0, len(a), PAIRS):
            x, y = a[at:at + PAIRS], b[at:at + PAIRS]
            by_block = np.add.reduceat((self.turned[x] - self.turned[y]) ** 2, starts, axis=1)
            near = ((by_block <= self.limits).argmax(axis=1) == number) & (by_block[:, number] <= self.limits[number])
            near &= by_block.sum(axis=1) <= self.limits.sum()
            x, y = x[near], y[near]
            cos = np.einsum("ij,ij->i", self.vectors[x], self.vectors[y]) / (self.norms[x] * self.norms[y])
            self.link(x[cos >= self.cosine], y[cos >= self.cosine])

    def multiplied_out(self, number: int, a: np.ndarray, b: np.ndarray, found: np.ndarray) -> None:
        """The same where most of the pairs of two sets of vectors may be linked."""
        x, y = self.turned[a], self.turned[b]
        for n in range(number + 1):
            within = _squared(x[:, self.parts[n]], y[:, self.parts[n]]) <= self.limits[n]
            found &= within if n == number else ~within
            if np.count_nonzero(found) <= DENSE * found.size:
                i, j = np.nonzero(found)
                return self.looked_up(number, a[i], b[j])
        found &= self.vectors[a] @ self.vectors[b].T / (self.norms[a][:, None] * self.norms[b][None, :]) >= self.cosine
        i, j = np.nonzero(found)
        self.link(a[i], b[j])

    def join(self, own: np.ndarray, other: np.ndarray, alone: bool) -> None:
        """Link vectors of ``own`` with those of ``other``; ``alone``: both are the same, a pair counts once."""
        for number, part in enumerate(self.parts):
            # Wider by as much again, so that no rounding loses a pair whose first block this is.
            limit = self.limits[number] + SLACK
            x, y = self.turned[own][:, part], self.turned[other][:, part]
            waiting, n_waiting = [], 0
            for rows, near in _leaves(x, y, limit):
                found = _squared(x[rows], y[near]) <= limit
                a, b = own[rows], other[near]
                if alone:
                    found &= a[:, None] < b[None, :]
                if np.count_nonzero(found) > max(PAIRS, DENSE * found.size):
                    self.multiplied_out(number, a, b, found)
                    continue
                i, j = np.nonzero(found)
                waiting.append((a[i], b[j]))
                n_waiting += len(i)
                if n_waiting >= PAIRS:
                    self.looked_up(number, *map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, n_waiting = [], 0
            if waiting:
                self.looked_up(number, *map(np.concatenate, zip(*waiting, strict=True)))


def _link_tile(cosine: float):
    """Link counts of a tile's vectors, and links that span what the tile connects."""
    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home = table["home"].to_numpy()
        own, other = np.flatnonzero(home), np.flatnonzero(~home)
        alone = table["first"][0] == table["second"][0]
        tile = _Tile(_matrix(table["e"]), table["n"].to_numpy(), cosine)
        tile.join(own, own if alone else other, alone)
        out = np.flatnonzero((tile.count > 0) | (tile.root != np.arange(len(table))))
        ids = table["id"]
        return pa.table({"id": ids.take(pa.array(out)), "links": pa.array(tile.count[out]),
                         "root": ids.take(pa.array(tile.root[out]))})
    return link


def _tiles(reps: DataFrame) -> DataFrame:
    """Rows of all tiles: every chunk of a label meets itself and every other one."""
    sizes = reps.groupBy("label", "d").agg(F.count(F.lit(1)).alias("vectors")).where("vectors > 1")
    sizes = materialise(sizes, "sizes")
    chunks = F.ceil(F.col("vectors") / F.least(F.lit(TILE), F.ceil(F.lit(TILE_VALUES) / F.col("d"))))
    rows = (reps.join(broadcast_if_small(sizes), ["label", "d"])
            .withColumn("own", F.pmod(F.col("mark"), chunks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1))))
    return rows.select("id", "label", "d", F.least("own", "other").alias("first"),
                       F.greatest("own", "other").alias("second"), (F.col("own") <= F.col("other")).alias("home"),
                       "e", "n")


def _linked(reps: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``(id, links)`` and spanning links ``(a, b)`` of representatives."""
    kind = reps.schema["id"].dataType.simpleString()
    found = _tiles(reps).groupBy("label", "d", "first", "second").applyInArrow(
        _link_tile(cosine), f"id {kind}, links bigint, root {kind}")
    found = materialise(found, "tiles")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    return counts, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def _digest(label: str, vector: str) -> Column:
    return F.xxhash64(label, F.col(vector).cast("array<double>"))


def near_vectors(table: DataFrame, cosine: float = 0.93, key: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """Links of every vector: key, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label and one length are linked when their cosine is at least ``cosine``. One row
    for every input row; other columns are not read. Vectors that are NULL, empty, all zero or hold a
    NULL, NaN or infinity, and those without a label, are linked with nothing. Repeated rows are
    vectors of their own and linked with each other. ``component_id`` is the smallest key reachable,
    a NULL key being larger than all others; the row with that key is kept.
    """
    ship_package(table.sparkSession)
    single = table.schema[vector].dataType.simpleString() == "array<float>"
    rows = table.select(F.col(key).alias("k"), F.col(label).alias("label"),
                        F.col(vector).cast("array<float>" if single else "array<double>").alias("e"))
    rows = rows.withColumns({
        "usable": F.col("label").isNotNull() & _usable("e"), "d": F.coalesce(F.size("e"), F.lit(-1)),
        "x": _digest("label", "e")})
    ident = F.struct(F.col("k").isNull().alias("none"), "k", "x")
    reps = (rows.where("usable").groupBy("label", "d", "e")
            .agg(F.min(ident).alias("id"), F.count(F.lit(1)).alias("n")))
    reps = materialise(reps.withColumn("mark", F.xxhash64("id")), "representatives")
    counts, links = _linked(reps, cosine)
    roots = materialise(components(links), "components").withColumnRenamed("node", "id")
    # The digest stands for the vector, so that vectors need not travel again; the vectors decide where two share one.
    alike = reps.select("label", "d", "id.x").distinct().count() < reps.count()
    same = ["label", "d", "x", *(["e"] if alike else [])]
    settled = (reps.select("id", *same[:2], "id.x", *same[3:], "n").join(counts, "id", "left")
               .join(roots, "id", "left")
               .select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                       F.coalesce("root", "id").alias("root")))
    members = materialise(rows.select("k", "usable", *same), "members")
    linked = (members.where("usable").join(settled, same)
              .select("k", "links", F.col("root.k").alias("component")))
    alone = members.where("not usable").select("k", F.lit(0).cast("bigint").alias("links"),
                                               F.col("k").alias("component"))
    return linked.unionByName(alone).select(
        F.col("k").alias(key), F.col("links").alias("n_links"),
        F.col("component").alias("component_id"), F.col("k").eqNullSafe(F.col("component")).alias("kept"))
