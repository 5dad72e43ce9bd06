"""Suffix-array dedup by a common-prefix-aware distributed merge sort (operator 12).

Every byte that a LENGTH-byte string covers which also starts elsewhere is removed. The suffix array is sparse: of the
GRAM-byte strings inside a LENGTH-byte one, the one with the least hash is its anchor (the leftmost of equals), so equal
strings have anchors at the same offset and only suffixes that begin at anchors have to be sorted. A first exchange of
anchors' hashes finds the suffixes that share no GRAM bytes with another: these are told apart (a distinguishing prefix) and leave.

Tasks sort their suffixes, with the bytes before the anchor as second part, into runs, cut by equal ranges of the anchor's hash. Runs are front-coded:
each suffix as the number of bytes it shares with the one before, and the rest; equal suffixes are there once. For each
range a loser tree merges the runs by common prefix lengths: a suffix that shares more with the last output than another one is
smaller without a look at its bytes, and equal lengths are compared from there on. The merge yields the common
prefixes of neighbours, hence the groups of suffixes that agree in so many bytes; within them the bytes before the
anchors are grouped likewise. Runs get back which offsets are repeated, and know the documents themselves: the places of a hot
passage stay spread over the runs.

What meets in one task are the different surroundings of one GRAM-byte string, never its copies. Null texts are empty;
texts under LENGTH bytes lose nothing; very long ones are hashed in slices. Repeated rows are documents that repeat each other;
null ids are kept. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repocensus.llm.tables import batch_rows, stored, utf8

LENGTH = 200
GRAM = 64  # a power of two
GRAMS = LENGTH - GRAM + 1  # inside a LENGTH-byte string
PLACE_BITS = 20
RUN_SUFFIXES = 200_000
RANGES_PER_TASK = 2  # merged one after the other
_BYTES = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings; lengths double."""
    hashed, size, power = _BYTES[data], 1, _BASE
    while size < GRAM:
        hashed = hashed[:-size] * np.uint64(power) + hashed[size:]
        size, power = 2 * size, power * power % (1 << 64)
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return hashed ^ (hashed >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` in a row."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def _ends_of(ends: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where the texts of places from ``start`` to ``stop`` end."""
    a, b = np.searchsorted(ends, [start, stop - 1], "right")
    own = ends[a : b + 1]
    return np.repeat(own, np.diff(np.minimum(own, stop), prepend=start))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts that stand in a row in ``data`` and end at ``ends``: place, hash, and the first and last start of
    the LENGTH-byte strings that have it."""
    found: list[tuple[np.ndarray, ...]] = []
    step = (1 << PLACE_BITS) - LENGTH
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(data) - LENGTH + 1, step):
        part = data[at : at + step + LENGTH - 1]
        hashed = gram_hashes(part)
        # The place in the low bits makes the leftmost of equals the least.
        least = _least((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), GRAMS)
        place = (least & low).astype(np.int64)
        starts = np.arange(at, at + len(place))
        inside = _ends_of(ends, at, at + len(place)) - starts >= LENGTH
        place, starts = place[inside], starts[inside]
        if len(place):
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.concatenate([first[1:], [len(place)]]) - 1
            found.append((place[first] + at, hashed[place[first]], starts[first], starts[last]))
    kinds = (np.int64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate(kinds))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts in a row, and where each ends."""
    raw = texts.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = _flat(batch.column(1))
        place, hashed, *_ = anchors(data, ends)
        doc = np.searchsorted(ends, place, "right")
        begins = np.concatenate([[0], ends])[doc]
        locators = batch.column(0).to_numpy(zero_copy_only=False)[doc]
        yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(locators, pa.int64()), pa.array(place - begins)], ["hash", "locator", "place"])


def mismatch(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two strings that share ``known`` bytes at least."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    return n if x == y else n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)


def front_coded(strings: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """Common prefix with the one before, the rests in a row, and their lengths, of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        shared.append(mismatch(before, s, 0))
        rests.append(s[shared[-1] :])
        before = s
    return shared, b"".join(rests), [len(r) for r in rests]


def front_decoded(shared: list[int], rests: bytes, sizes: list[int]) -> list[bytes]:
    out, at, before = [], 0, b""
    for n, size in zip(shared, sizes, strict=True):
        before = before[:n] + rests[at : at + size]
        out.append(before)
        at += size
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted runs (strings, common prefixes) merged: (run, number) in order, and the common prefixes of neighbours.

    A run's current string has a known common prefix with the string that beat it, which is the last output or
    smaller than it by that prefix. Prefixes decide where they differ, bytes are read from them on where they do not.
    """
    k = len(runs)
    at = [0] * k
    known = [0 if r[0] else -1 for r in runs]  # -1: no string left
    order: list[tuple[int, int]] = []
    prefixes: list[int] = []
    if not k:
        return order, prefixes

    def beats(a: int, b: int) -> bool:
        """Whether the current string of ``a`` comes first; the loser's prefix becomes that with the winner."""
        if known[a] != known[b]:
            return known[a] > known[b]
        if known[a] < 0:
            return True
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        n = mismatch(x, y, known[a])
        first = len(x) == n or (len(y) > n and x[n] < y[n])
        known[b if first else a] = n
        return first

    losers = [-1] * k  # inner nodes 1 to k - 1; leaf of run i is node k + i

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        first = beats(a, b)
        losers[node] = b if first else a
        return a if first else b

    winner = play(1) if k > 1 else 0
    while known[winner] >= 0:
        order.append((winner, at[winner]))
        prefixes.append(known[winner])
        strings, shared = runs[winner]
        at[winner] += 1
        known[winner] = shared[at[winner]] if at[winner] < len(strings) else -1
        node = winner + k >> 1
        while node:
            other = losers[node]
            if beats(other, winner):
                losers[node], winner = winner, other
            node >>= 1
    return order, prefixes


def repeated_offsets(right: np.ndarray, left: np.ndarray, place_of_left: np.ndarray, least: np.ndarray, most: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each suffix and offset d (0 to GRAMS - 1) of the anchor: whether the string that begins d bytes before is repeated.

    Suffixes are in order with common prefixes ``right``; ``left`` are those of the reversed bytes before, in their own
    order, in which suffix i has the place ``place_of_left[i]``. Offsets go from ``least`` to ``most``.
    """
    out = np.zeros((len(right), GRAMS), bool)
    for d in range(GRAMS):
        here = np.flatnonzero((least <= d) & (d <= most))
        if len(here):
            after = np.cumsum(right < LENGTH - d)[here]
            before = np.cumsum(left < d)[place_of_left[here]]
            _, group = np.unique(after * (len(right) + 1) + before, return_inverse=True)
            out[here, d] = np.bincount(group, copies[here])[group] > 1
    return out


RUN = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("range", T.LongType()),
        T.StructField("shared", T.BinaryType()),
        T.StructField("rests", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("before", T.BinaryType()),
        T.StructField("before_sizes", T.BinaryType()),
        T.StructField("copies", T.BinaryType()),
        T.StructField("locators", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.LongType())),
    ]
)
_RUN_ARROW = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in RUN.fields])


def _sorted_runs(suffixes: list[tuple], name: str) -> Iterator[pa.RecordBatch]:
    """A row for each range of the suffixes (range, bytes from the anchor on, bytes before, locator, place)."""
    suffixes.sort()
    at = 0
    while at < len(suffixes):
        k, strings, before, copies, until = suffixes[at][0], [], [], [], at
        while until < len(suffixes) and suffixes[until][0] == k:
            _, right, left, _, _ = suffixes[until]
            if strings and strings[-1] == right and before[-1] == left:
                copies[-1] += 1
            else:
                strings.append(right)
                before.append(left)
                copies.append(1)
            until += 1
        shared, rests, sizes = front_coded(strings)
        small = lambda values: np.array(values, np.uint8).tobytes()
        row = [
            name, k, small(shared), rests, small(sizes), b"".join(before), small([len(x) for x in before]),
            np.array(copies, "<i4").tobytes(), [s[3] for s in suffixes[at:until]], [s[4] for s in suffixes[at:until]],
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(_RUN_ARROW.names, row, strict=True))], _RUN_ARROW)
        at = until


def _runs(ranges: int):
    """Sorted front-coded runs of the shared suffixes of documents (locator, text, places of shared anchors)."""

    def run(batches):
        held: list[tuple] = []
        made = 0
        for batch in batches:
            data, ends = _flat(batch.column(1))
            raw = data.tobytes()
            place, hashed, first, last = anchors(data, ends)
            if not len(place):
                continue
            doc = np.searchsorted(ends, place, "right")
            begins = np.concatenate([[0], ends])
            lists = batch.column(2)
            wanted = np.repeat(begins[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
            use = np.flatnonzero(np.isin(place, wanted))
            # Anchors' hashes are least ones, so they are mixed before they are dealt.
            k = ((hashed * np.uint64(_BASE)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            locators = batch.column(0).to_numpy(zero_copy_only=False)
            columns = (k[use], place[use], first[use], last[use], locators[doc[use]], place[use] - begins[doc[use]])
            for r, p, a, b, locator, inside in zip(*(c.tolist() for c in columns), strict=True):
                held.append((r, raw[p : b + LENGTH], raw[a:p][::-1], locator, inside))
            if len(held) > RUN_SUFFIXES:
                yield from _sorted_runs(held, f"{TaskContext.get().partitionId()}-{made}")
                held, made = [], made + 1
        yield from _sorted_runs(held, f"{TaskContext.get().partitionId()}-{made}")

    return run


VERDICT = "run string, range long, entry array<int>, low array<long>, high array<long>"
_VERDICT_ARROW = pa.schema([("run", pa.string()), ("range", pa.int64()), ("entry", pa.list_(pa.int32())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])


def _merged_range(rows: list[dict]) -> pa.RecordBatch:
    """For each run of one range, the repeated offsets (from ``low`` to ``high``) of its suffixes."""
    runs, before, copies = [], [], []
    for row in rows:
        shared, sizes, lefts = (list(row[c]) for c in ("shared", "sizes", "before_sizes"))
        runs.append((front_decoded(shared, row["rests"], sizes), shared))
        cuts = np.cumsum([0, *lefts]).tolist()
        before.append([row["before"][a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        copies.append(np.frombuffer(row["copies"], "<i4"))
        row["rests"] = row["before"] = None
    order, right = merged(runs)
    strings = [runs[r][0][i] for r, i in order]
    lefts = [before[r][i] for r, i in order]
    del runs, before
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    left = [0] + [mismatch(lefts[a], lefts[b], 0) for a, b in zip(by_left, by_left[1:], strict=False)]
    place_of_left = np.empty(len(lefts), np.int64)
    place_of_left[by_left] = np.arange(len(lefts))
    least = LENGTH - np.fromiter(map(len, strings), np.int64, len(strings))
    most = np.fromiter(map(len, lefts), np.int64, len(lefts))
    count = np.array([copies[r][i] for r, i in order], np.int64)
    found = repeated_offsets(np.array(right), np.array(left), place_of_left, least, most, count)
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    suffix, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] - 1
    run_of, number = (np.array(x, np.int64) for x in zip(*order, strict=True))
    out = []
    by_run = np.lexsort((low, number[suffix], run_of[suffix]))
    cuts = np.searchsorted(run_of[suffix][by_run], np.arange(len(rows) + 1))
    for i, row in enumerate(rows):
        own = by_run[cuts[i] : cuts[i + 1]]
        if len(own):
            out.append(dict(zip(_VERDICT_ARROW.names, [row["run"], row["range"], number[suffix[own]], low[own], high[own]], strict=True)))
    return pa.RecordBatch.from_pylist(out, _VERDICT_ARROW)


def _merged_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come by range."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["range"] != row["range"]:
                yield _merged_range(held)
                held = []
            held.append(row)
    if held:
        yield _merged_range(held)


def _row_spans(row: dict) -> tuple[np.ndarray, ...]:
    """Repeated spans (locator, start, stop) from a run's copies, locators and places in one range and the verdicts on its suffixes."""
    entry, low, high = (np.array(row[c], np.int64) for c in ("entry", "low", "high"))
    copies = np.frombuffer(row["copies"], "<i4")
    suffix = np.repeat(np.arange(len(copies)), copies)
    a, b = np.searchsorted(entry, suffix), np.searchsorted(entry, suffix, "right")
    copy = np.repeat(np.arange(len(suffix)), b - a)
    which = np.arange(len(copy)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[copy]
    place = np.array(row["places"], np.int64)[copy]
    return np.array(row["locators"], np.int64)[copy], place - high[which], place - low[which] + LENGTH


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of documents; rows come by run, which has all suffixes of its documents."""

    def whole(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        locators, starts, stops = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((starts, locators))
        columns = _joined(locators[order], starts[order], stops[order])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["locator", "start", "stop"])

    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["run"] != now:
                yield whole(held)
                held = []
            now = row["run"]
            held.append(_row_spans(row))
    if held:
        yield whole(held)


def _joined(owner: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans, sorted by owner and start, with those that overlap or touch made one."""
    if not len(owner):
        return owner, starts, stops
    change = np.concatenate([[True], owner[1:] != owner[:-1]])
    # Lifted apart by owner, so that one running maximum serves all.
    lift = (np.cumsum(change) - 1) * (int(stops.max()) + 1)
    reach = np.maximum.accumulate(stops + lift)
    new = np.concatenate([[True], (starts + lift)[1:] > reach[:-1]]) | change
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    return owner[first], starts[first], reach[last] - lift[last]


KEPT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@F.arrow_udf(KEPT)
def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        removed = removed_spans(own)
        digest, at = hashlib.sha256(), 0
        for start, stop in removed:
            digest.update(text[at:start])
            at = stop
        digest.update(text[at:])
        out.append({"n_removed": sum(b - a for a, b in removed), "n_spans": len(removed), "kept_sha256": digest.hexdigest()})
    return pa.array(out, to_arrow_type(KEPT))


def removed_spans(own: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans, in order."""
    pairs = np.array(sorted((s["start"], s["stop"]) for s in own or ()), np.int64).reshape(-1, 2)
    _, starts, stops = _joined(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    return list(zip(starts.tolist(), stops.tolist(), strict=True))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(``locator``, ``spans`` as ``start`` and ``stop``) of documents (``locator``, ``text`` as bytes) with repeated strings."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES_PER_TASK * tasks
    with batch_rows(spark, 128):
        found = stored(docs.select("locator", "text").mapInArrow(_anchor_rows, "hash long, locator long, place long"), "suffix-anchors")
        # Written, so that the join deals both sides anew: Spark can split a hash that very many anchors have.
        counts = found.groupBy("hash").agg(F.count("*").alias("n"))
        shared = stored(counts.where("n > 1").select("hash"), "suffix-hashes", shuffles_go=True)
        places = stored(found.join(shared, "hash", "left_semi").groupBy("locator").agg(F.collect_list("place").alias("places")), "suffix-shared", shuffles_go=True)
        with_text = docs.join(places, "locator").select("locator", "text", "places")
        runs = stored(with_text.mapInArrow(_runs(ranges), RUN), "suffix-runs", shuffles_go=True)
    with batch_rows(spark, 4):
        dealt = runs.drop("locators", "places").repartition(tasks, "range").sortWithinPartitions("range")
        verdicts = stored(dealt.mapInArrow(_merged_ranges, VERDICT), "suffix-verdicts", shuffles_go=True)
        both = runs.select("run", "range", "copies", "locators", "places").join(verdicts, ["run", "range"]).repartition(tasks, "run").sortWithinPartitions("run")
        spans = both.mapInArrow(_spans, "locator long, start long, stop long")
        return stored(spans.groupBy("locator").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans", shuffles_go=True)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    spark = docs.sparkSession
    staged = stored(docs.select(F.monotonically_increasing_id().alias("locator"), "doc_id", utf8().alias("text")), "suffix-docs")
    spans = repeated_spans(staged)
    whole = staged.join(spans, "locator", "left")
    with batch_rows(spark, 128):
        kept = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _kept("text", "spans").alias("k"))
        return stored(kept.select("doc_id", "n_bytes", "k.*"), "suffix-kept", shuffles_go=True)


SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT rid, unnest(range(0, length(h) // 2 - 199)) AS pos FROM d),
w AS (SELECT p.rid, p.pos, md5(substr(h, 2 * p.pos + 1, 400)) AS m FROM p JOIN d USING (rid)),
m AS (SELECT rid, pos FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
j AS (SELECT *, CASE WHEN pos > 200 + lag(pos) OVER (PARTITION BY rid ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM m),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS island FROM j),
s AS (SELECT rid, min(pos) AS a, max(pos) + 200 AS b FROM k GROUP BY rid, island),
e AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM s),
t AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS fin,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(fin, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (rid)
"""
