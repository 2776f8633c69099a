"""Near-duplicates by an LSH forest over MinHash signatures.

A document's set holds its distinct five-word shingles. Texts with the same set are one
representative from there on. Each of ``TREES`` trees has its own order of signature coordinates, and
representatives are sorted by it. Those that share the first ``BASE`` coordinates of a tree form a region,
a run of its sorted order; who shares no such prefix with anybody is in no region.

Candidates are neighbours in the sorted order, that is, by longest common prefix. A region's members are
compared with up to ``WINDOW`` followers, so a region no larger than that is covered. In larger ones a
member meets the neighbours on its two sides, with which it has the longest prefix: the depth at which it
finds them follows the region, deep where many texts are alike. Neighbours are compared where they are
sorted, by their signatures; only pairs that agree enough leave the task, to be confirmed on the full sets.

Components follow. What a large region may still hide is a link between two of its components. Members
outside its largest component are therefore compared, by signature and block by block, with all members
of the region that are of another component; what agrees is compared again by wide signatures (``WIDE``
coordinates of one byte, made for these members only), which tell apart what is near the threshold and
what only shares a passage. The new pairs are confirmed in the same way. So no region gives more than a
fixed number of pairs for each member, but for pairs of different components that agree closely.

Regions are dealt over tasks by ranges of the sorted order; one of more than ``WHOLE`` members may be cut,
which costs the neighbours on either side of a cut this tree and nothing else.

A pair at the threshold shares a base prefix in some tree with probability above 0.99999997 at 0.85 and
above 0.999996 at 0.80, and is then compared. Signatures wrongly decide against it (``ERRORS``) with
probability 5.9e-6 and 3.0e-6 by the binomial tail, so it is confirmed with probability above 0.99999 at
either. The wide signatures refuse it with probability below 3e-6 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.llm.columns import ship, struct_array
from setframe.llm.components import components
from setframe.llm.shingles import mix, shingle_sets, slices
from setframe.session import broadcast_if_small, materialise

TREES = 24
COORDINATES = 96
#: Coordinates that a region shares, and further ones that its order looks at.
BASE, FURTHER = 4, 12
#: Followers in the sorted order that a member is compared with where its region is no larger.
WINDOW = 15
#: Members up to which a region is never cut.
WHOLE = 512
#: Coordinates of the signatures that compare members of large regions once more.
WIDE = 1024
#: Standard errors below the threshold at which signatures decide against a pair.
ERRORS = 5.0
#: Members of a crowded region that are compared with each other at a time.
BLOCK = 2048
#: Pairs of neighbours whose signatures are compared at a time.
STRIP = 1 << 14

_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(7)) | np.uint64(1)
_WIDE_MULTIPLIERS = mix(np.arange(1, WIDE + 1, dtype=np.uint64) << np.uint64(23)) | np.uint64(1)


def _signatures(values: pa.Array):
    """For each text: size of its set, two digests of the set, and its signature's bytes."""
    for part in slices(values):
        members, offsets = shingle_sets(part)
        sizes = np.diff(offsets)
        signature = np.full((len(part), COORDINATES), 0xFFFFFFFF, np.uint32)
        digests = np.zeros((len(part), 2), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            at = offsets[:-1][full]
            for c, factor in enumerate(_MULTIPLIERS):
                hashed = (members * factor >> np.uint64(32)).astype(np.uint32)
                signature[full, c] = np.minimum.reduceat(hashed, at)
            digests[full, 0] = np.add.reduceat(mix(members), at).view(np.int64)
            digests[full, 1] = np.add.reduceat(mix(members ^ _MULTIPLIERS[0]), at).view(np.int64)
        for i in range(len(part)):
            yield int(sizes[i]), int(digests[i, 0]), int(digests[i, 1]), signature[i].tobytes()


def _described(text: str) -> Column:
    @F.arrow_udf("n bigint, d1 bigint, d2 bigint, sig binary")
    def describe(values: pa.Array) -> pa.Array:
        n, d1, d2, sig = zip(*_signatures(values), strict=True) if len(values) else [()] * 4
        return struct_array(n=pa.array(n, pa.int64()), d1=pa.array(d1, pa.int64()),
                            d2=pa.array(d2, pa.int64()), sig=pa.array(sig, pa.binary()))
    return describe(text)


def _wide_signature(text: str) -> Column:
    """The last bytes of ``WIDE`` further minima of a text's set."""
    @F.arrow_udf("binary")
    def wide(values: pa.Array) -> pa.Array:
        out = []
        for part in slices(values):
            members, offsets = shingle_sets(part)
            full = np.flatnonzero(np.diff(offsets))
            table = np.zeros((len(part), WIDE), np.uint8)
            if len(full):
                at = offsets[:-1][full]
                for c, factor in enumerate(_WIDE_MULTIPLIERS):
                    lowest = np.minimum.reduceat(members * factor >> np.uint64(32), at)
                    table[full, c] = lowest.astype(np.uint8)
            out += [row.tobytes() for row in table]
        return pa.array(out, pa.binary())
    return wide(text)


def _set_of(text: str) -> Column:
    @F.arrow_udf("binary")
    def full_set(values: pa.Array) -> pa.Array:
        out = []
        for part in slices(values):
            members, offsets = shingle_sets(part)
            out += [members[offsets[i]:offsets[i + 1]].tobytes() for i in range(len(part))]
        return pa.array(out, pa.binary())
    return full_set(text)


def _base_keys(sig: str) -> Column:
    @F.arrow_udf("array<bigint>")
    def keys(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.list_(pa.int64()))
        table = np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, COORDINATES)
        out = np.zeros((len(table), TREES), np.uint64)
        for tree in range(TREES):
            for depth in range(1, BASE + 1):
                place = (tree * BASE + depth - 1) % COORDINATES
                out[:, tree] = mix(out[:, tree] + table[:, place] + np.uint64(depth))
        return pa.array(list(out.view(np.int64)), pa.list_(pa.int64()))
    return keys(sig)


def _order(sig: str, tree: str) -> Column:
    """The coordinates that follow a tree's base, so that comparing bytes compares them in turn."""
    @F.arrow_udf("binary")
    def order(values: pa.Array, trees: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.binary())
        table = np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, COORDINATES)
        first = (trees.to_numpy() + 1) * BASE
        places = (first[:, None] + np.arange(FURTHER)) % COORDINATES
        picked = np.take_along_axis(table, places, axis=1).astype(">u4")
        return pa.array([row.tobytes() for row in picked], pa.binary())
    return order(sig, tree)


def _common(a: str, b: str) -> Column:
    @F.arrow_udf("bigint")
    def common(left: pa.Array, right: pa.Array) -> pa.Array:
        # Buffers of the batch itself: sets are not copied.
        pairs = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                 for x, y in zip(left, right, strict=True))
        return pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs], pa.int64())
    return common(a, b)


def _candidates(reps: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)``, ``a < b``, of representatives ``(id, sig)`` that are neighbours in a tree and
    agree; and the members of regions larger than the window, with the region's size ``n``."""
    base = reps.select("id", F.posexplode(_base_keys("sig")).alias("tree", "key"))
    shared = base.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    regions = materialise(base.join(shared, ["tree", "key"]), "regions")
    # A representative has at most one region in each tree.
    places = regions.groupBy("id").agg(F.collect_list(F.struct("tree", "key", "n")).alias("places"))
    members = reps.join(places, "id").select("id", "sig", F.inline("places"))
    members = materialise(members.withColumn("order", _order("sig", "tree")), "members")
    cut = F.when(F.col("n") > WHOLE, F.col("order")).otherwise(F.lit(b""))
    dealt = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = members.repartitionByRange(dealt, "tree", "key", cut)
    kind = reps.schema["id"].dataType.simpleString()
    found = (ranges.sortWithinPartitions("tree", "key", "order", "id")
             .select("tree", "key", "n", "id", "sig")
             .mapInArrow(_neighbours(_least_agreement(threshold)), f"a {kind}, b {kind}"))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, regions.where(F.col("n") > WINDOW + 1)


def _signature_table(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _neighbours(least: float):
    """Pairs of a sorted partition that are within the window, in one region, and agree enough."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            old = 0 if last is None else last.num_rows
            if last is not None:
                table = pa.concat_tables([last, table])
            table = table.combine_chunks()
            last = table.slice(max(0, table.num_rows - WINDOW))
            tree, key, n = (table[c].to_numpy() for c in ("tree", "key", "n"))
            signatures = _signature_table(table["sig"])
            left, right = [], []
            for step in range(1, min(WINDOW, len(n) - 1) + 1):
                at = np.arange(max(0, old - step), len(n) - step)
                near = at[(tree[at] == tree[at + step]) & (key[at] == key[at + step])
                          & ((n[at] <= WINDOW + 1) | (step == 1))]
                for start in range(0, len(near), STRIP):
                    part = near[start:start + STRIP]
                    same = (signatures[part] == signatures[part + step]).mean(axis=1)
                    agreed = part[same >= least]
                    left.append(agreed)
                    right.append(agreed + step)
            if left:
                ids = table["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(left))),
                                                  ids.take(pa.array(np.concatenate(right)))], ["a", "b"])
    return compare


def _least_agreement(threshold: int, coordinates: int = COORDINATES) -> float:
    share = threshold / 100.0
    return share - ERRORS * (share * (1 - share) / coordinates) ** 0.5


def _across(least: float, least_wide: float):
    """Pairs of a block that agree enough by both signatures, are of different components, and share no
    earlier tree."""
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        outside = np.flatnonzero(np.array(table["outside"].to_pylist(), bool))
        inside = np.flatnonzero(~np.array(table["outside"].to_pylist(), bool))
        signatures = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32)
        signatures = signatures.reshape(-1, COORDINATES)
        wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint8).reshape(-1, WIDE)
        part = np.array(table["part"].to_pylist(), np.int64)
        left, right = [], []
        if len(outside) and len(inside):
            tree, others = table["tree"][0].as_py(), signatures[inside]
            for i in outside:
                same = others == signatures[i]
                near = (same.mean(axis=1) >= least) & (part[inside] != part[i])
                if near.any():
                    trees = same[near].reshape(-1, TREES, BASE).all(axis=2)
                    found = inside[near][trees.argmax(axis=1) == tree]
                    found = found[(wide[found] == wide[i]).mean(axis=1) >= least_wide]
                    left += [int(i)] * len(found)
                    right += found.tolist()
        ids = table["id"]
        return pa.table({"a": ids.take(pa.array(left, pa.int64())),
                         "b": ids.take(pa.array(right, pa.int64()))})
    return compare


def _hidden(source: DataFrame, reps: DataFrame, crowded: DataFrame, links: DataFrame,
            threshold: int) -> DataFrame:
    """Candidates between members of crowded regions that are not connected so far."""
    roots = materialise(components(links), "components")
    placed = (crowded.join(roots.withColumnRenamed("node", "id"), "id", "left")
              .withColumn("part", F.xxhash64(F.coalesce("root", "id"))))
    largest = (placed.groupBy("tree", "key", "part").agg(F.count(F.lit(1)).alias("size"))
               .groupBy("tree", "key").agg(F.max_by("part", F.struct("size", "part")).alias("main")))
    placed = placed.join(largest, ["tree", "key"]).withColumn("outside", F.col("part") != F.col("main"))
    placed = materialise(placed.drop("main", "root"), "placed")
    strays = placed.where("outside").groupBy("tree", "key").agg(F.count(F.lit(1)).alias("strays"))
    apart = placed.join(strays, ["tree", "key"])
    wanted = broadcast_if_small(materialise(apart.select("id").distinct(), "wanted"))
    wide = source.join(wanted, "id").select("id", _wide_signature("t").alias("wide"))
    # Rows that repeat key and text share an id.
    wide = materialise(wide.groupBy("id").agg(F.min("wide").alias("wide")), "wide")
    rows = apart.join(reps.join(wide, "id"), "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    chunks = F.ceil(F.col("strays") / BLOCK).cast("int")
    own_block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    own_chunk = F.pmod(F.xxhash64("id"), chunks).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["tree", "key", "id", "part", "sig", "wide", "outside", "block", "chunk"]
    tiles = (rows.withColumn("outside", F.lit(False)).withColumn("block", own_block)
             .withColumn("chunk", every(chunks)).select(*columns)
             .unionByName(rows.where("outside").withColumn("chunk", own_chunk)
                          .withColumn("block", every(blocks)).select(*columns)))
    kind = reps.schema["id"].dataType.simpleString()
    found = tiles.groupBy("tree", "key", "block", "chunk").applyInArrow(
        _across(_least_agreement(threshold), _least_agreement(threshold, WIDE)), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, source: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets, made again from their texts, reach ``threshold`` percent."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    sets = (source.join(broadcast_if_small(materialise(wanted, "wanted")), "id")
            .select("id", _set_of("t").alias("members")))
    sets = materialise(sets, "sets")
    size = (F.octet_length("members") / 8).cast("bigint")
    found = (pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma"),
                                    size.alias("na")), "a")
             .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb"),
                               size.alias("nb")), "b")
             .select("a", "b", "na", "nb", _common("ma", "mb").alias("both"))
             .where(F.expr(f"100 * both >= {threshold} * (na + nb - both)")))
    return materialise(found.select("a", "b"), "links")


def _links(source: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Links of representatives that connect all that the forest's candidates connect."""
    pairs, crowded = _candidates(reps, threshold)
    links = _confirmed(materialise(pairs, "pairs"), source, threshold)
    if crowded.isEmpty():
        return links
    hidden = materialise(_hidden(source, reps, crowded, links, threshold), "pairs")
    if hidden.isEmpty():
        return links
    return links.unionByName(_confirmed(hidden, source, threshold))


def near_duplicates(docs: DataFrame, threshold: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Components of near-duplicates: key, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked when 100 times the size of the intersection of their sets is at least
    ``threshold`` times that of the union; texts with the same set are. One row for every input row;
    other columns are not read. NULL, empty and blank texts have no shingles and are linked with
    nothing. ``component_id`` is the smallest key reachable by links, and the row with that key is
    kept; rows that repeat key and text are one document, all kept or none. A NULL key counts as
    larger than all others.
    """
    return _assigned(docs, threshold, key, text).select(
        F.col("id.k").alias(key), F.col("n").alias("n_shingles"), F.col("root.k").alias("component_id"),
        F.col("id.k").eqNullSafe(F.col("root.k")).alias("kept"))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    ident = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"),
                     F.xxhash64(value).alias("x"))
    return docs.select(ident.alias("id"), value.alias("t"))


def _assigned(docs: DataFrame, threshold: int, key: str, text: str) -> DataFrame:
    """``(id, n, root)`` of every row, ``id`` and ``root`` holding a key and a text digest."""
    ship(docs.sparkSession)
    source = _identified(docs, key, text)
    described = source.select("id", _described("t").alias("d")).select("id", "d.*")
    described = materialise(described, "signatures")
    reps = (described.where("n > 0").groupBy("d1", "d2", "n")
            .agg(F.min("id").alias("id"), F.min("sig").alias("sig")))
    reps = materialise(reps, "representatives")
    links = _links(source, reps.select("id", "sig"), threshold)
    roots = materialise(components(links), "components")
    placed = (reps.select("d1", "d2", "n", "id")
              .join(roots.withColumnRenamed("node", "id"), "id", "left")
              .select("d1", "d2", "n", F.coalesce("root", "id").alias("root")))
    return (described.select("id", "d1", "d2", "n").join(placed, ["d1", "d2", "n"], "left")
            .select("id", "n", F.coalesce("root", "id").alias("root")))


def without_near_duplicates(docs: DataFrame, threshold: int = 80, key: str = "doc_id",
                            text: str = "text") -> DataFrame:
    """One document of each component, with all columns of ``docs``: the one with the smallest key."""
    assigned = _assigned(docs, threshold, key, text)
    gone = assigned.where(~F.col("id.k").eqNullSafe(F.col("root.k"))).select(F.col("id").alias("__sf_id"))
    ident = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"),
                     F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    gone = materialise(gone.distinct(), "gone")
    return docs.join(broadcast_if_small(gone), ident == F.col("__sf_id"), "left_anti")
