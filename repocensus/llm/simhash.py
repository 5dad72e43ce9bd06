"""SimHash near-duplicates by pivot distance tables (operator 2).

A pivot is a reference fingerprint; the table holds every distinct fingerprint's Hamming distance to
many pivots. Two fingerprints at distance d differ by at most d in each coordinate, so pairs with a
larger coordinate difference are discarded and only the rest is verified on the fingerprints.

Candidates come from the table itself: the distances to the empty pivot and to the masks of BLOCKS
bit blocks give the number of set bits per block, and fingerprints at distance 2 or less have
block counts that differ by 2 or less in total, so both reach a common cell when each is put into its own
cell and the cells one count away. Cells are never crossed with themselves at any size:

* a cell of two is one pair; one of up to SMALL_CELL gives its pairs;
* fingerprints of larger cells (dense groups of near copies) go to the finest table, the 64 pivots
  of single bits, where the cell is the fingerprint itself: all that reach one common fingerprint by
  flipping at most one bit are within distance 2, so a star links them without any pairs.

Both are exact: no link between different fingerprints is lost. Copies share a fingerprint and
are joined as one node.

Null or empty texts and texts without words have fingerprint zero, linked like any other. A row with a
null ``doc_id`` gets the component of the rows with its fingerprint, null if these have no id. Repeated
rows share a component; empty tables give empty results; other columns are ignored, or carried in ``doc``.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.llm.graphs import components
from repocensus.llm.tables import arrow_batches, stored, utf8

LINK_BITS = 2
BLOCKS = 16
SMALL_CELL = 8
SEED = 42
SHINGLE = 3


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


# The empty fingerprint, one mask per block, and random fingerprints to discard pairs with.
BLOCK_PIVOTS = [0] + [((1 << (64 // BLOCKS)) - 1) << (64 // BLOCKS * j) for j in range(BLOCKS)]
RANDOM_PIVOTS = [random.Random(7).getrandbits(64) for _ in range(32)]


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of the 3-word shingles of a lower-cased UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return _signed(hashed(joined, SEED))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bits of a slice at a time
        part = hashes[at : at + 65_536]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    over_half = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(over_half.view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a long) and carried columns."""
    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", _fingerprints(utf8()).alias("fp"), *carried)


def _distances(pivots: list[int], fp: Column) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))) for p in pivots]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Adds ``d0`` ... : the distances to BLOCK_PIVOTS."""
    return nodes.select("*", *[d.alias(f"d{j}") for j, d in enumerate(_distances(BLOCK_PIVOTS, F.col("fp")))])


def _cells(table: DataFrame) -> DataFrame:
    """(``cell``, ``fp``): the cell of a fingerprint's block counts and those one count away."""
    width = 64 // BLOCKS
    # d0 counts all set bits, dj those outside of block j plus the unset ones inside.
    counts = [((F.col("d0") + width - F.col(f"d{j}")) / 2).cast("long") for j in range(1, BLOCKS + 1)]
    own = sum((F.shiftleft(c + 1, 3 * j) for j, c in enumerate(counts)), F.lit(0).cast("long"))
    steps = [0] + [sign << (3 * j) for sign in (1, -1) for j in range(BLOCKS)]
    around = F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step")
    return table.select(own.alias("own"), "fp", around).select((F.col("own") + F.col("step")).alias("cell"), "fp")


def _survivors(pairs: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) by the largest coordinate difference, then by their real distance."""
    apart = [F.abs(x - y) for x, y in zip(_distances(RANDOM_PIVOTS, F.col("a")), _distances(RANDOM_PIVOTS, F.col("b")), strict=True)]
    near = F.greatest(*apart) <= LINK_BITS
    return pairs.where(near).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect exactly the distinct fingerprints ``fp`` of ``nodes`` within 2 bits."""
    # The table of fingerprints is small, what comes of it is not: dealt out before.
    dealt = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = _cells(pivot_table(dealt))
    sizes = stored(
        cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"),
        "cells",
    )
    twos = sizes.where("n = 2").select("a", "b")
    shared = stored(cells.join(sizes.where("n > 2").select("cell", "n"), "cell"), "shared-cells")
    small = shared.where(f"n <= {SMALL_CELL}").groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = small.select(
        F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")
    ).select("p.a", "p.b")
    dense = shared.where(f"n > {SMALL_CELL}").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    reached = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    middle = reached.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
    stars = reached.join(middle, "at").where("fp <> a").select("a", F.col("fp").alias("b"))
    return _survivors(twos.union(pairs).distinct()).union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    prints = stored(fingerprints(docs), "fingerprints")
    return components_of(prints)


def components_of(prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` (``fp``, ``doc_id`` and more) with ``component_id``."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = links(nodes)
    of_a = nodes.select(F.col("fp").alias("a"), F.col("node").alias("u"))
    of_b = nodes.select(F.col("fp").alias("b"), F.col("node").alias("v"))
    # A fingerprint whose ids are all null is its own node below all ids.
    linked = edges.join(of_a, "a").join(of_b, "b").select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    lows = components(linked)
    named = nodes.join(lows, F.col("node") == F.col("u"), "left").select("fp", F.coalesce("low", "node").alias("component_id"))
    return prints.join(named, "fp")


def simhash_stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of repeated rows one."""
    arrow_batches(docs.sparkSession)
    staged = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
            F.monotonically_increasing_id().alias("locator"),
            _fingerprints(utf8()).alias("fp"),
            "doc_id",
        ),
        "simhash-staged",
    )
    grouped = components_of(staged.select("fp", "doc_id", "locator"))
    # Rows without an id belong to no component but their fingerprint's.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    stay = grouped.groupBy(group.alias("g")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("locator").alias("locator"))).alias("first")
    )
    return staged.join(stay.select("first.locator"), "locator", "left_semi").select("doc.*")


def simhash_query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
