"""How far the sources of each language differ in their words.

Identical texts of a language are collapsed first: one copy with a count for every source it occurs in.
Each copy is tokenized once, and document frequencies and counts are added with those multiplicities.
Shares are smoothed, so a term that a group lacks has a share too; since that share is one number for
each group, pairs of sources are evaluated sparsely: terms that neither group has are one product, terms
that one group has are summed by distinct share, and only terms that both have meet in a join.

All arithmetic is on integers. Shares are parts of ``SCALE``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.session import materialise, ship_package

SCALE = 1_000_000_000
#: Documents of its language that a term must be in.
MIN_DOCS = 10
TOP_TERMS = 10
#: Bytes of text that a task tallies before it hands its sums on.
TALLY_BYTES = 16 << 20
_ROWS_OUT = 1 << 16

#: Letters A-Z are lower-cased, other ASCII bytes than letters separate terms; bytes of longer UTF-8
#: sequences are kept, so that a term is a run of letters and non-ASCII characters.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
_TALLIES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                      ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def _sums(tallies: dict) -> Iterator[pa.RecordBatch]:
    """Tallies by (lang, multiplicities) as rows by (lang, source, term)."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    for (lang, copies), (counts, docs) in tallies.items():
        for source, times in copies:
            total, total_docs = groups.setdefault((lang, source), (Counter(), Counter()))
            for term, n in counts.items():
                total[term] += n * times
                total_docs[term] += docs[term] * times
    for (lang, source), (counts, docs) in groups.items():
        names = list(counts)
        for at in range(0, len(names), _ROWS_OUT):
            part = names[at:at + _ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                 pa.array(part, pa.binary()).cast(pa.string()),
                 pa.array([counts[t] for t in part], pa.int64()),
                 pa.array([docs[t] for t in part], pa.int64())], schema=_TALLIES)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of distinct texts ``(lang, text, copies)``: every text is tokenized and counted
    once, whatever its multiplicities."""
    tallies: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, text, copies in zip(batch["lang"].to_pylist(), batch["text"], batch["copies"],
                                      strict=True):
            data = text.as_py()
            found = terms(data)
            key = lang, tuple((c["source"], c["n"]) for c in copies.as_py())
            counts, docs = tallies.setdefault(key, (Counter(), Counter()))
            counts.update(found)
            docs.update(set(found))
            size += len(data)
            if size >= TALLY_BYTES:
                yield from _sums(tallies)
                tallies, size = {}, 0
    yield from _sums(tallies)


def collapsed(docs: DataFrame, lang: str = "lang", source: str = "source",
              text: str = "text") -> DataFrame:
    """``(lang, text, copies)``: one row for every distinct text of a language, ``copies`` with the
    number of its rows in each source. Texts are told apart by their SHA-256 digest.

    Both sides are combined before they are shuffled, so a text that a third of all rows repeat is a
    few rows; ``copies`` is no longer than the number of sources.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = docs.select(filled(lang).alias("lang"), filled(source).alias("source"),
                       filled(text).cast("binary").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = (rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("lang", "digest")
              .agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("copies")))
    return (rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
            .join(copies, ["lang", "digest"]).select("lang", "text", "copies"))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, source, n, lang_n, leads)`` of kept terms that a group has: its count, that of
    the language, and a mark on one row of each term."""
    ship_package(docs.sparkSession)
    partial = collapsed(docs, lang, source, text).mapInArrow(
        tally, "lang string, source string, term string, n bigint, docs bigint")
    counts = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term's partition has at most one row for each source.
    term = Window.partitionBy("lang", "term")
    return (counts.withColumn("lang_docs", F.sum("docs").over(term))
            .where(F.col("lang_docs") >= min_docs)
            .select("lang", "term", "source", "n", F.sum("n").over(term).alias("lang_n"),
                    (F.row_number().over(term.orderBy("source")) == 1).alias("leads")))


def _share(count: str, total: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))``, exact at any size."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20, 0)) * ({count} + 2)) div ({total} + 2 * kept)")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _groups(docs: DataFrame, counts: DataFrame, lang: str, source: str) -> DataFrame:
    """One row for every occurring (lang, source): its totals, those of its language, and the share
    ``p0`` of a kept term that it lacks."""
    occurring = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"),
                                               F.count(F.lit(1)).alias("present"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                       F.count_if("leads").alias("kept"))
    table = occurring.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(
        0, ["total", "present", "lang_total", "kept"])
    return table.withColumn("none", F.lit(0).cast("bigint")).withColumn(
        "p0", F.when(F.col("kept") > 0, _share("none", "total"))).drop("none")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """The summed gap of every two sources of a language, both ways round."""
    def side(table: DataFrame, mark: str) -> DataFrame:
        return table.withColumnsRenamed({c: f"{c}_{mark}" for c in table.columns
                                         if c not in ("lang", "term")})

    names = groups.select("lang", "source", "p0", "present", "kept")
    pairs = side(names, "a").join(side(names, "b"), "lang").where("source_a < source_b")
    # Terms of one group against the other's p0: terms of equal share are one row.
    spread = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    others = names.select("lang", F.col("source").alias("other"), F.col("p0").alias("q"))
    lone = (spread.join(others, "lang").where("source <> other")
            .groupBy("lang", F.least("source", "other").alias("source_a"),
                     F.greatest("source", "other").alias("source_b"))
            .agg(F.sum(F.col("m") * _gap("p", "q")).alias("lone")))
    both = shares.select("lang", "term", "source", "p", "p0")
    met = (side(both, "a").join(side(both, "b"), ["lang", "term"]).where("source_a < source_b")
           .groupBy("lang", "source_a", "source_b")
           .agg(F.sum(_gap("p_a", "p_b") - _gap("p_a", "p0_b") - _gap("p0_a", "p_b")).alias("met"),
                F.count(F.lit(1)).alias("common")))
    keys = ["lang", "source_a", "source_b"]
    summed = pairs.join(lone, keys, "left").join(met, keys, "left").fillna(
        0, ["lone", "met", "common"])
    neither = F.col("kept_a") - F.col("present_a") - F.col("present_b") + F.col("common")
    value = F.when(F.col("kept_a") > 0, F.col("lone") + F.col("met")
                   + neither * _gap("p0_a", "p0_b")).otherwise(F.lit(0))
    ways = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                   F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return summed.select("lang", value.cast("bigint").alias("value"), F.explode(ways).alias("way")) \
        .select("lang", "way.*", "value")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each source of a language, the other sources
    by their distance from it (``pair``) and the ``top`` terms that set it off from the language
    (``term``).

    NULL text, language and source read as empty strings. Repeated rows count as often as they occur.
    A group without terms, or of a language without kept terms, has its pairs (all 0 for the latter)
    and no terms; a source alone in its language has no pairs. Ties go to the smaller item, by bytes.
    Other columns are not read. An empty table gives an empty one.
    """
    counts = materialise(term_counts(docs, lang, source, text, min_docs), "term-counts")
    groups = materialise(_groups(docs, counts, lang, source), "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total")).withColumn(
        "q", _share("lang_n", "lang_total"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = (shares.where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     _gap("p", "q").cast("bigint").alias("value"))
             .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
    pairs = _pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item",
                                          "value").withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(words)
