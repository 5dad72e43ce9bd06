"""Packing documents into sequences by cutting-stock column generation (operator 6).

A document's ids (with the end id) are cut into pieces of the sequence length and a rest; pieces are
classed by length in units of UNIT ids, and a class is as long as its longest piece. The driver solves the cutting-stock problem over the
histogram of classes, at most 128 numbers whatever the corpus: a linear program whose columns are patterns
(how many pieces of each class fill a sequence), priced by a knapsack over the capacity. Patterns are
rounded down, and what is left, fewer pieces than there are patterns times a pattern's, is filled
first-fit. Then every piece finds its sequence from its rank within its class, so pieces are assigned
where they lie; ranks come from bucket totals, never from one task per class.

Ids are those of ``tokenizers`` for the vocabulary, without added special tokens; they are made by the rank
file of the same vocabulary through a word cache, which is several times faster (tests compare both).
Null texts are empty: such a document is its end id alone. Repeated rows are packed as rows of their
own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.llm.bpe import VOCABULARY, encoder, vocabulary_path
from repocensus.llm.tables import arrow_batches, stored, utf8

SEQUENCE = 2048
UNIT = 16
GAP = 1e-3
END = np.array([1], "<u4").tobytes()
ROWS_PER_BUCKET = 20_000

PIECES = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
)


def _cutter(path: str, sequence: int):
    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        encode, width = encoder(path).encode, 4 * sequence
        starts, lengths, sums, ends = [], [], [], [0]
        for text in texts:
            ids = encode(text.as_py().decode("utf-8", "replace")) + END
            for at in range(0, len(ids), width):
                piece = ids[at : at + width]
                starts.append(at // 4)
                lengths.append(len(piece) // 4)
                sums.append(zlib.crc32(piece))
            ends.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, sums)], ["start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return cut


def piece_class(length: Column) -> Column:
    return F.ceil(length / UNIT).cast("int")


def pieces_of(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """``locator``, ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and ``class`` of each piece, stored."""
    arrow_batches(docs.sparkSession)
    cut = docs.select("doc_id", F.monotonically_increasing_id().alias("locator"), _cutter(path, sequence)(utf8()).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    rows = cut.select("doc_id", "locator", total.alias("doc_tokens"), F.explode("p").alias("x"))
    kind = piece_class(F.col("x.length")).alias("class")
    return stored(rows.select("locator", "doc_id", "x.start", "x.length", "x.ids_crc32", "doc_tokens", kind), "pieces")


def _best_column(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest dual value that fits: an unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, room, "right"))
        best[room] = best[room - 1]
        if fit:
            found = best[room - sizes[:fit]] + values[:fit]
            k = int(found.argmax())
            if found[k] > best[room] + 1e-12:
                best[room], taken[room] = found[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: pieces}, times) that hold exactly the demanded pieces, in few sequences."""
    sizes = np.array(sorted(demand))
    wanted = np.array([demand[s] for s in sizes], float)
    if not len(sizes):
        return []
    basis = np.diag((capacity // sizes).astype(float))
    used = wanted / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(50 * len(sizes) + 200):
        duals = inverse.sum(0)
        value, column = _best_column(duals, sizes, capacity)
        if value <= 1 + GAP:  # the program's optimum is no better than the present value / value
            break
        change = (inverse * column).sum(1)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        used = used - ratio[leaves] * change
        used[leaves] = ratio[leaves]
        basis[:, leaves] = column
        row = inverse[leaves] / change[leaves]
        inverse -= change[:, None] * row
        inverse[leaves] = row
    times = np.floor(np.maximum(used, 0) + 1e-9).astype(np.int64)
    whole = basis.astype(np.int64)
    left = np.array([demand[s] for s in sizes]) - (whole * times).sum(1)
    # Rounding in the program's numbers may take a piece too many: give patterns back until none does.
    while (left < 0).any():
        k = int(np.flatnonzero((whole[int(left.argmin())] > 0) & (times > 0))[0])
        times[k] -= 1
        left = left + whole[:, k]
    patterns = [({int(s): int(n) for s, n in zip(sizes, whole[:, k], strict=True) if n}, int(times[k])) for k in range(len(sizes)) if times[k]]
    bins: list[list[int]] = []
    rooms = np.zeros(0, int)
    for k in range(len(sizes) - 1, -1, -1):  # first fit, long pieces first
        for _ in range(int(left[k])):
            fits = np.flatnonzero(rooms >= sizes[k])
            if len(fits):
                at = int(fits[0])
            else:
                at = len(bins)
                bins.append([])
                rooms = np.append(rooms, capacity)
            bins[at].append(int(sizes[k]))
            rooms[at] -= sizes[k]
    for one in bins:
        patterns.append(({s: one.count(s) for s in sorted(set(one))}, 1))
    return patterns


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    found = pieces.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()
    histogram = {r["class"]: r["n"] for r in found}
    class_of = {r["longest"]: r["class"] for r in found}  # pieces of another class are longer or shorter
    slots: dict[int, list[tuple[int, int, int]]] = {c: [] for c in histogram}
    filled, sequences = dict.fromkeys(histogram, 0), 0
    for pattern, times in cutting_stock({r["longest"]: r["n"] for r in found}, sequence):
        for size, n in pattern.items():
            c = class_of[size]
            slots[c].append((filled[c], n, sequences))
            filled[c] += n * times
        sequences += times
    schema = "class int, slots array<struct<slot: bigint, n: bigint, first: bigint>>"
    plan = F.broadcast(spark.createDataFrame([(c, s) for c, s in slots.items()], schema))  # a row for each class

    bits = max(0, math.ceil(math.log2(max(1, sum(histogram.values()) / ROWS_PER_BUCKET))))
    key = F.xxhash64("locator")
    bucket = F.shiftrightunsigned(key, 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    keyed = pieces.withColumn("bucket", bucket)
    sums = keyed.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("class", "bucket", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("locator", "start"))
    ranks = keyed.withColumn("place", place).join(before, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    slot = F.expr("element_at(filter(slots, s -> s.slot <= rank), -1)")
    assigned = ranks.join(plan, "class").withColumn("s", slot).withColumn("sequence_id", F.expr("s.first + (rank - s.slot) DIV s.n"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "locator", "start").rowsBetween(Window.unboundedPreceding, -1)
    return assigned.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    found = pack(pieces_of(docs, path or vocabulary_path(f"{VOCABULARY}.tiktoken")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
