"""Nearest vectors by inner product: a hierarchical k-means tree searched best bin first.

*Tree.* Fitted on a bounded sample and used to index every row. Inner products are not distances, so
vectors get one more component that gives all of them the same norm and queries a zero there; then the
largest inner product is the smallest distance, and k-means cells are compact for it.

*Search.* A query walks the tree through a priority queue of branches, nearest centre first, and lists
leaves in the order in which it reaches them. How many it visits is calibrated: a sample of queries is
answered by brute force over all rows, and visits are widened until the leaves visited hold the wanted
share of their true neighbours.

*Join.* Leaves next to each other in the tree form cells of bounded size; a leaf of more rows is dealt
over several. Queries that visit any leaf of a cell meet its rows there in tiles (``TILE`` rows by
``TILE`` queries), a matrix product each; a tile gives the best of every query that reach what the query
has found before.

Equal vectors are one representative with its smallest ids, which are all that can be among the nearest,
so a vector that a third of the rows share is indexed once and searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setframe.session import materialise, ship_package

NEAREST = 20
#: Rows and numbers at most in the sample that the tree is fitted on.
SAMPLE_ROWS, SAMPLE_VALUES = 1 << 15, 1 << 22
#: Children of a node; rows of a leaf that the tree aims at; leaves at most.
BRANCHES, LEAF_ROWS, MAX_LEAVES = 16, 256, 4096
#: Queries answered by brute force for calibration, and the share of neighbours wanted.
CALIBRATION_QUERIES, RECALL = 256, 0.95
#: Rows and queries of one tile, and queries that are scored at a time.
TILE, STRIP = 2048, 256
#: Leaves of the first wave of visits, and how much further each wave goes.
FIRST_VISITS, WIDER = 4, 4
_ITERATIONS = 8
#: Scores this close to the last one kept are computed again, in one fixed order of summation.
_SLACK = 1e-9


@dataclass
class Tree:
    """Centres of all nodes; ``children`` of inner nodes, leaf numbers of the others (else -1)."""

    norm: float
    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int = field(default=0)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """With the component that gives every vector the norm ``norm``."""
        rest = np.maximum(0.0, self.norm ** 2 - (vectors ** 2).sum(axis=1))
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector, by the nearest child at each node."""
        lifted = self.lift(vectors)
        out = np.empty(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            children = self.children[node]
            nearest = _distances(lifted[rows], self.centres[children]).argmin(axis=1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(children)
                     if (nearest == i).any()]
        return out

    def visits(self, queries: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each query the first ``most`` leaves, best bin first."""
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        far = _distances(lifted, self.centres)
        for distance in far.tolist():
            found: list[int] = []
            queue = [(0.0, 0)]
            while queue and len(found) < most:
                node = heapq.heappop(queue)[1]
                # Down to the nearest leaf; branches passed by wait in the queue.
                while self.children[node]:
                    nearest, *others = sorted((distance[c], c) for c in self.children[node])
                    for other in others:
                        heapq.heappush(queue, other)
                    node = nearest[1]
                found.append(self.leaf[node])
            yield found


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant for each row."""
    return (centres ** 2).sum(axis=1) - 2.0 * rows @ centres.T


def _clusters(rows: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Cluster numbers by Lloyd's iteration from ``k`` distinct rows."""
    centres = rows[random.choice(len(rows), k, replace=False)]
    for _ in range(_ITERATIONS):
        nearest = _distances(rows, centres).argmin(axis=1)
        for i in np.unique(nearest):
            centres[i] = rows[nearest == i].mean(axis=0)
    return _distances(rows, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, norm: float, leaves: int) -> Tree:
    """A tree of about ``leaves`` leaves; nodes are split until their part of the sample is small
    enough. Deterministic for one order of the sample."""
    random = np.random.default_rng(0)
    tree = Tree(norm, np.zeros((0, 0)), [], [])
    lifted = tree.lift(sample)
    least = max(1.0, len(sample) / max(1, leaves))
    centres: list[np.ndarray] = []

    def add(rows: np.ndarray) -> int:
        """Depth first, so that leaves next to each other are numbered one after the other."""
        node = len(centres)
        centres.append(rows.mean(axis=0) if len(rows) else np.zeros(lifted.shape[1]))
        tree.children.append([])
        tree.leaf.append(-1)
        k = min(BRANCHES, round(len(rows) / least))
        parts = _clusters(rows, k, random) if k > 1 else np.zeros(len(rows), int)
        names = np.unique(parts)
        if len(names) > 1:
            tree.children[node] = [add(rows[parts == i]) for i in names]
        else:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
        return node

    add(lifted)
    tree.centres = np.array(centres)
    return tree


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1)


def _usable(vector: Column) -> Column:
    """No NULL vector or component, no NaN or infinity, not empty and not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number)
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """``(rep, v, ids)`` of every distinct vector: its smallest id, and its ``keep`` smallest ids."""
    by = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "v", "ids")


def _shared(spark, value):
    return spark.sparkContext.broadcast(value)


def _placed(reps: DataFrame, tree) -> DataFrame:
    @F.arrow_udf("int")
    def leaf(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.int32())
        return pa.array(tree.value.place(_matrix(values)), pa.int32())
    return reps.withColumn("leaf", leaf("v"))


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Rows of a mask: what may be among the ``keep`` largest of each row, with all near ties."""
    if scores.shape[1] <= keep:
        return np.isfinite(scores)
    last = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
    margin = _SLACK * np.maximum(1.0, np.abs(np.where(np.isfinite(last), last, 0.0)))
    return np.isfinite(scores) & (scores >= (last - margin)[:, None])


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, always summed in the same order."""
    return np.ascontiguousarray(queries * rows).sum(axis=1)


def _kept(q: np.ndarray, r: np.ndarray, score: np.ndarray, rep: np.ndarray, keep: int) -> np.ndarray:
    """Indices of the ``keep`` best pairs of each query, ties to the smaller representative."""
    order = np.lexsort((rep[r], -score, q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < keep]


def _brute_force(reps: DataFrame, queries: np.ndarray, keep: int) -> DataFrame:
    """``(query, leaf, score)``: the nearest representatives of a few queries over all rows."""
    shared = _shared(reps.sparkSession, queries)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch["v"])
            scores = shared.value @ rows.T
            q, r = np.nonzero(_best(scores, keep))
            yield pa.RecordBatch.from_pydict({
                "query": q.astype(np.int32), "leaf": batch["leaf"].take(pa.array(r)),
                "rep": batch["rep"].take(pa.array(r)), "score": _exact(shared.value[q], rows[r])})

    kind = reps.schema["rep"].dataType.simpleString()
    found = reps.select("v", "leaf", "rep").mapInArrow(
        nearest, f"query int, leaf int, rep {kind}, score double")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= keep)


def calibrated_visits(tree: Tree, queries: np.ndarray, true_leaves: list[list[int]],
                      recall: float) -> tuple[int, float]:
    """The fewest leaf visits, widened one at a time, at which the leaves visited hold ``recall`` of the
    true neighbours of these queries; and the share that they hold."""
    total = sum(map(len, true_leaves))
    gains = np.zeros(tree.leaves + 1)
    for order, leaves in zip(tree.visits(queries, tree.leaves), true_leaves, strict=True):
        reached = {leaf: at + 1 for at, leaf in enumerate(order)}
        for leaf in leaves:
            gains[reached[leaf]] += 1
    share = gains.cumsum() / max(1, total)
    visits = int(np.argmax(share >= min(recall, share[-1]))) if total else 1
    return max(1, visits), float(share[max(1, visits)]) if total else 1.0


def _cells(rows_of: dict[int, int], queries_of: dict[int, int], leaves: int
           ) -> list[tuple[int, int, int]]:
    """``(cell, row parts, query parts)`` of every leaf: leaves in order share a cell while their rows
    fit a tile; a larger leaf has its own, dealt over several tiles."""
    cells, cell, filled = [0] * leaves, 0, 0
    for leaf in range(leaves):
        n = rows_of.get(leaf, 0)
        if filled and filled + n > TILE:
            cell, filled = cell + 1, 0
        cells[leaf] = cell
        filled += n
    rows, asked = [0] * (cell + 1), [0] * (cell + 1)
    for leaf in range(leaves):
        rows[cells[leaf]] += rows_of.get(leaf, 0)
        asked[cells[leaf]] += queries_of.get(leaf, 0)
    # A query counts once for every leaf here, so its parts are enough, if not the fewest.
    return [(c, -(-rows[c] // TILE) or 1, -(-asked[c] // TILE) or 1) for c in cells]


def _tile(keep: int):
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, queries = left.combine_chunks(), right.combine_chunks()
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query": queries["rep"].slice(0, 0), "ids": rows["ids"].slice(0, 0),
                             "score": pa.array([], pa.float64())})
        x, q = _matrix(rows["v"].combine_chunks()), _matrix(queries["v"].combine_chunks())
        leaf, bound = rows["leaf"].to_numpy(), queries["bound"].to_numpy()
        lists = queries["leaves"].combine_chunks()
        wanted = np.zeros((len(q), int(leaf.max()) + 1), bool)
        which = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        asked = lists.flatten().to_numpy()
        here = asked < wanted.shape[1]
        wanted[which[here], asked[here]] = True
        pairs = []
        for start in range(0, len(q), STRIP):
            strip = slice(start, start + STRIP)
            scores = np.where(wanted[strip][:, leaf], q[strip] @ x.T, -np.inf)
            scores[scores < (bound[strip] - _SLACK * np.maximum(1.0, np.abs(bound[strip])))[:, None]] = -np.inf
            at = np.nonzero(_best(scores, keep))
            pairs.append((at[0] + start, at[1]))
        at_q, at_x = (np.concatenate(part) for part in zip(*pairs, strict=True))
        exact = _exact(q[at_q], x[at_x])
        reached = exact >= bound[at_q]
        at_q, at_x, exact = at_q[reached], at_x[reached], exact[reached]
        best = _kept(at_q, at_x, exact, rows["rep"].to_numpy(), keep)
        return pa.table({"query": queries["rep"].take(pa.array(at_q[best])),
                         "ids": rows["ids"].take(pa.array(at_x[best])),
                         "score": pa.array(exact[best])})
    return nearest


def _met(index: DataFrame, rows_of: dict[int, int], stops: DataFrame, leaves: int, keep: int) -> DataFrame:
    """``(query, ids, score)`` of the rows in the leaves that queries ``(rep, v, bound, leaves)`` visit:
    for each tile the ``keep`` best that reach the query's bound."""
    spark = index.sparkSession
    # At most MAX_LEAVES rows.
    queries_of = dict(map(tuple, stops.select(F.explode("leaves").alias("leaf")).groupBy("leaf")
                          .count().collect()))
    cell_table = F.broadcast(spark.createDataFrame(
        [(leaf, *cell) for leaf, cell in enumerate(_cells(rows_of, queries_of, leaves))],
        "leaf int, cell int, row_parts int, query_parts int"))

    def part(parts: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    rows = index.join(cell_table, "leaf").withColumn("row_part", part("row_parts")).withColumn(
        "query_part", every("query_parts"))
    # One row for a query and cell, whatever number of its leaves the query visits.
    in_cells = (stops.select("rep", F.explode("leaves").alias("leaf")).join(cell_table, "leaf")
                .groupBy("rep", "cell", "row_parts", "query_parts")
                .agg(F.collect_list("leaf").alias("leaves")))
    queries = (in_cells.join(stops.select("rep", "v", "bound"), "rep")
               .withColumn("query_part", part("query_parts")).withColumn("row_part", every("row_parts")))
    tile = ["cell", "row_part", "query_part"]
    return (rows.select(*tile, "leaf", "rep", "v", "ids").groupBy(*tile)
            .cogroup(queries.select(*[F.col(c).alias(f"q_{c}") for c in tile], "rep", "v", "bound", "leaves")
                     .groupBy(*[f"q_{c}" for c in tile]))
            .applyInArrow(_tile(keep), f"query {index.schema['rep'].dataType.simpleString()}, "
                                       f"ids {index.schema['ids'].dataType.simpleString()}, score double"))


def _searched(index: DataFrame, asked: DataFrame, tree, visits: int, keep: int) -> DataFrame:
    """``(query, near)``: the ``keep`` nearest ids found for every query vector.

    Visits go in waves, each ``WIDER`` times as far as the one before. What a query has found so far
    bounds what later waves need to return, so that this grows with the logarithm of its visits.
    """
    @F.arrow_udf("array<int>")
    def leaves(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.list_(pa.int32()))
        return pa.array(list(tree.value.visits(_matrix(values), visits)), pa.list_(pa.int32()))

    routed = materialise(asked.select("rep", "v", leaves("v").alias("leaves")), "routed")
    rows_of = dict(map(tuple, index.groupBy("leaf").count().collect()))
    lowest = F.lit(float("-inf"))
    best, start, stop = None, 0, FIRST_VISITS
    while start < visits:
        part = routed.select("rep", "v", F.slice("leaves", start + 1, stop - start).alias("leaves"))
        part = part.where(F.size("leaves") > 0)
        if best is None:
            stops = part.withColumn("bound", lowest)
        else:
            bounds = best.groupBy(F.col("query").alias("rep")).agg(
                F.when(F.count(F.lit(1)) >= keep, F.min("score")).alias("bound"))
            stops = part.join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", lowest))
        found = _met(index, rows_of, stops, tree.value.leaves, keep)
        found = found.select("query", "score", F.explode("ids").alias("id"))
        merged = found if best is None else best.unionByName(found)
        by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        best = materialise(merged.withColumn("n", F.row_number().over(by)).where(F.col("n") <= keep)
                           .drop("n"), "nearest")
        start, stop = stop, stop * WIDER
    return best.groupBy("query").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("n"), "id", "score"))).alias("near"))


@dataclass
class Index:
    """The placed representatives, the tree, and what calibration found."""

    rows: DataFrame
    tree: object
    visits: int
    recall: float


def build_index(reps: DataFrame, asked: DataFrame, recall: float = RECALL, keep: int = NEAREST,
                leaf_rows: int = LEAF_ROWS) -> Index:
    """Fit the tree on a sample of ``(rep, v, ids)``, place every row, calibrate on a sample of the
    queries ``(rep, v)``. Samples are by digest of the representative's id."""
    spark = reps.sparkSession
    d, norm, n = reps.agg(F.max(F.size("v")), F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x))), F.count(F.lit(1))).first()
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_VALUES // d) / n)

    def sample(table: DataFrame, part: float, rows: int) -> np.ndarray:
        draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1
        # A little over the share is drawn at most; the limit makes it a bound.
        found = table.where(draw).select("rep", "v").limit(rows).toArrow().sort_by("rep")
        return _matrix(found["v"].combine_chunks()) if found.num_rows else np.zeros((0, d))

    leaves = int(min(MAX_LEAVES, max(1, n // leaf_rows)))
    tree = fit_tree(sample(reps, share, 2 * SAMPLE_ROWS), norm * (1 + 1e-9), leaves)
    shared = _shared(spark, tree)
    rows = materialise(_placed(reps, shared), "placed")
    few = asked.count()
    probes = sample(asked, min(1.0, CALIBRATION_QUERIES / max(1, few)), 2 * CALIBRATION_QUERIES)
    true: list[list[int]] = [[] for _ in probes]
    for row in _brute_force(rows, probes, keep).collect() if len(probes) else ():
        true[row["query"]].append(row["leaf"])
    visits, reached = calibrated_visits(tree, probes, true, recall)
    return Index(rows, shared, visits, reached)


def nearest_vectors(table: DataFrame, every: int = 20, nearest: int = NEAREST, key: str = "vec_id",
                    vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``nearest`` rows found for each row whose key ``every``
    divides, by inner product in double precision, ties to the smaller key; all rows if fewer.

    A query's own row is no candidate. Vectors that are NULL, empty, zero, or hold a NULL or non-finite
    component take no part, nor do rows with a NULL key and vectors of another length than the most
    frequent one (of equally frequent ones the shortest). Of rows that repeat a key, the one with the
    smallest vector counts. Other columns are not read; an empty table gives an empty one.
    """
    spark = table.sparkSession
    ship_package(spark)
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & _usable(F.col("v")))
    schema = T.StructType([T.StructField("query_id", rows.schema["id"].dataType),
                           T.StructField("rank", T.IntegerType()),
                           T.StructField(key, rows.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    length = (rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first())
    if length is None:
        return spark.createDataFrame([], schema)
    rows = materialise(rows.where(F.size("v") == length["d"]).groupBy("id").agg(F.min("v").alias("v")),
                       "vectors")
    # One more than is returned: a query's own row is among its nearest.
    keep = nearest + 1
    reps = materialise(_distinct(rows, keep), "representatives")
    own = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).select(F.col("id").alias("query_id"), "v")
    asked = materialise(own.join(reps.select("v", "rep"), "v").select("query_id", "rep"), "asked")
    wanted = materialise(reps.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v"),
                         "query-vectors")
    index = build_index(reps, wanted, recall, keep)
    found = _searched(index.rows, wanted, index.tree, index.visits, keep)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, nearest)
    return (asked.join(found.withColumnRenamed("query", "rep"), "rep")
            .select("query_id", F.posexplode(others).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"),
                    F.col("x")["id"].alias(key), F.col("x")["score"].alias("score")))
