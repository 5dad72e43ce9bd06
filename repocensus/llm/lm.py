"""Language-model scores: interpolated modified Kneser-Ney bigrams counted in Spark (operator 10).

* Words are counted first; their 64-bit hashes, sorted, become arrays in the shared folder, and a word's id is its
  place there. Pairs of ids are then counted, and all statistics (counts of counts, followers,
  predecessors) come from all pairs of the training texts.
* Discounts are the modified Kneser-Ney ones at both orders; the lower order uses continuation counts and falls
  back to the uniform distribution, which leaves mass for unknown words. Every pair is stored, those seen once too.
* The arrays are cut into parts by hash; workers map them into memory from the shared folder (or from a local
  copy, where the shared folder is no mounted file system) and look batches up at once.

Order 2 is the bound of disk: a third order would shuffle nearly every token again.

Null texts are empty: one token, the end. A null ``doc_id`` has the text ''. Without any training text every
probability is that of the unknown word. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.llm.tables import arrow_batches, scratch_folder, stored, utf8

END, START = b"", b"\n<start>"  # no word can be either
PART_WORDS = 1 << 20
SLOT_BITS = 21
PART_PAIRS = 1 << 21
SALTS = 4
BUFFER = 4_000_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


def _tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _count_words(batches):
    """(``h``, ``c``) per buffer of words."""
    seen: Counter = Counter()

    def flush():
        hashes = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
        counts = np.fromiter(seen.values(), np.int64, len(seen))
        seen.clear()
        return pa.RecordBatch.from_arrays([_signed(hashes), pa.array(counts)], ["h", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(_tokens(text))
        if len(seen) > 500_000:
            yield flush()
    yield flush()


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that go with them."""

    folder: str
    word_bits: int
    tokens: int = 0
    words: int = 0
    pair_parts: int = 0
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    unknown: float = 1.0
    names: tuple[str, ...] = field(default=())


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Writes under another name first, so that a retried task never leaves half a file."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    draft = f"{root}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with system.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(draft, f"{root}/{name}")


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """An array of the model: memory-mapped where the shared folder is mounted, otherwise read, a bounded number at a time."""
    return (_on_disk if fs.FileSystem.from_uri(folder)[0].type_name == "local" else _in_memory)(folder, name, kind)


@functools.lru_cache(4096)
def _on_disk(folder: str, name: str, kind: str) -> np.ndarray:
    path = f"{fs.FileSystem.from_uri(folder)[1]}/{name}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


@functools.lru_cache(64)
def _in_memory(folder: str, name: str, kind: str) -> np.ndarray:
    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/{name}").type != fs.FileType.File:
        return np.zeros(0, kind)
    with system.open_input_stream(f"{root}/{name}") as given:
        return np.frombuffer(given.read(), kind)


def _ids(model: Model, words: list[bytes]) -> np.ndarray:
    """Ids of words, -1 where unknown."""
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    parts = (hashes >> np.uint64(64 - model.word_bits)).astype(np.int64) if model.word_bits else np.zeros(len(words), np.int64)
    out = np.full(len(words), -1, np.int64)
    for part in np.unique(parts):
        known = _mapped(model.folder, f"words-{part}", "<u8")
        at = np.flatnonzero(parts == part)
        if len(known):
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            out[at] = np.where(known[place] == hashes[at], part << SLOT_BITS | place, -1)
    return out


def _local(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and for all texts in a row the words' numbers in that list and where each text ends."""
    number: dict[bytes, int] = {START: 0}
    flat: list[int] = []
    ends = []
    for text in texts:
        flat.append(0)
        flat += [number.setdefault(w, len(number)) for w in _tokens(text)]
        ends.append(len(flat))
    return list(number), np.array(flat, np.int64), np.array(ends, np.int64)


def _pair_counter(model: Model):
    def count(batches):
        """(``pair``, ``c``) sorted per buffer of tokens."""
        held: list[np.ndarray] = []

        def flush():
            pairs, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], ["pair", "c"])

        size = 0
        for batch in batches:
            words, flat, _ = _local(batch.column(0).to_pylist())
            ids = _ids(model, words)[flat]
            second = flat[1:] != 0
            held.append((ids[:-1] << 32 | ids[1:])[second])
            size += len(flat)
            if size > BUFFER:
                yield flush()
                size = 0
        yield flush()

    return count


def _discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; plain halves where the data are too few."""
    if not ones or not twos or not threes:
        return 0.5, 1.0, 1.5
    y = ones / (ones + 2 * twos)
    found = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
    return tuple(min(max(d, 0.05 * k), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


def _times(table: DataFrame, column: str) -> list[int]:
    """How many rows have 1, 2, 3 and 4 in the column."""
    return [n or 0 for n in table.agg(*[F.sum((F.col(column) == k).cast("long")) for k in (1, 2, 3, 4)]).first()]


def _bits(rows: int, size: int) -> int:
    return max(0, math.ceil(math.log2(max(1, rows / size))))


def train(texts: DataFrame) -> Model:
    """The model of a table with one column of UTF-8 bytes."""
    spark = texts.sparkSession
    folder = scratch_folder(spark, "kn-model")
    words = stored(texts.mapInArrow(_count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "kn-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bits = _bits(distinct + 1, PART_WORDS)
    if bits > 31 - SLOT_BITS:
        raise ValueError("more words than 31-bit ids can name: raise PART_WORDS and SLOT_BITS")
    start = spark.range(1).select(F.lit(int(np.uint64(word_hash(START)).view(np.int64))).alias("h"), F.lit(0).cast("long").alias("c"))
    part = (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("long").alias("part")

    def write_words(table: pa.Table) -> pa.Table:
        hashes = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        number = table.column("part")[0].as_py()
        if len(order) >= 1 << SLOT_BITS:
            raise ValueError("a part has more words than its ids can name")
        _save(folder, f"words-{number}", hashes[order])
        _save(folder, f"counts-{number}", table.column("c").to_numpy()[order])
        return pa.table({"part": [number], "n": [len(order)]})

    sizes = words.union(start).select("h", "c", part).groupBy("part").applyInArrow(write_words, "part bigint, n bigint")
    sizes = stored(sizes, "kn-parts")
    model = Model(folder, bits, total, distinct)
    if not total:
        return Model(folder, bits, 0, 0)

    # Pairs lie by their first word, so that followers add up with little shuffling; the second word salts hot ones.
    emitted = texts.mapInArrow(_pair_counter(model), "pair bigint, c bigint")
    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = F.pmod(F.shiftright("pair", 32), F.lit(64 * slots)).cast("int").alias("near")
    salt = F.pmod("pair", F.lit(SALTS)).cast("int").alias("salt")
    laid = emitted.select("pair", "c", near, salt).repartition(slots, "near", "salt")
    pairs = stored(laid.groupBy("near", "salt", "pair").agg(F.sum("c").alias("c")).select("pair", "c"), "kn-pairs")
    discounts = _discounts(*_times(pairs, "c"))
    some = lambda n: F.sum((F.col("c") == n).cast("long")) if n < 3 else F.sum((F.col("c") >= n).cast("long"))
    followers = pairs.groupBy(F.shiftright("pair", 32).alias("id")).agg(
        F.sum("c").alias("total"), some(1).alias("n1"), some(2).alias("n2"), some(3).alias("n3")
    )
    before = pairs.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("id")).agg(F.count("*").alias("k"))
    stats = stored(followers.join(before, "id", "full"), "kn-stats")
    kinds = stats.agg(F.sum("k")).first()[0]
    lower = _discounts(*_times(stats, "k"))
    kept = [F.sum(F.when(F.col("k") == n, lower[n - 1])) if n < 3 else F.sum(F.when(F.col("k") >= n, lower[2])) for n in (1, 2, 3)]
    spare = sum(x or 0.0 for x in stats.agg(*kept).first()) / kinds
    unknown = spare / (distinct + 1)

    def write_stats(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        slot = table.column("id").to_numpy() & ((1 << SLOT_BITS) - 1)
        size = len(_mapped(folder, f"words-{number}", "<u8"))
        column = lambda name: np.nan_to_num(table.column(name).to_numpy(zero_copy_only=False).astype(float))
        n1, n2, n3, all_, k = (column(c) for c in ("n1", "n2", "n3", "total", "k"))
        weight = np.ones(size)
        weight[slot] = np.where(all_ > 0, (discounts[0] * n1 + discounts[1] * n2 + discounts[2] * n3) / np.maximum(all_, 1), 1.0)
        totals, low = np.ones(size), np.full(size, unknown)
        totals[slot] = np.maximum(all_, 1)
        taken = np.where(k >= 3, lower[2], np.where(k >= 2, lower[1], np.where(k >= 1, lower[0], 0)))
        low[slot] += (k - taken) / kinds
        for name, values in (("weights", weight), ("totals", totals), ("lower", low)):
            _save(folder, f"{name}-{number}", values)
        return pa.table({"part": [number]})

    stats.withColumn("part", F.shiftright("id", SLOT_BITS)).groupBy("part").applyInArrow(write_stats, "part bigint").write.format("noop").mode("overwrite").save()

    parts = 1 << _bits(pairs.count(), PART_PAIRS)

    def write_pairs(table: pa.Table) -> pa.Table:
        number, keys = table.column("part")[0].as_py(), table.column("pair").to_numpy()
        order = np.argsort(keys)
        _save(folder, f"pairs-{number}", keys[order])
        _save(folder, f"times-{number}", table.column("c").to_numpy()[order].astype(np.int64))
        return pa.table({"part": [number]})

    of_pair = F.pmod(F.shiftright("pair", 32) + F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(parts)).alias("part")
    pairs.select("pair", "c", of_pair).groupBy("part").applyInArrow(write_pairs, "part bigint").write.format("noop").mode("overwrite").save()
    return Model(folder, bits, total, distinct, parts, discounts, unknown)


def _by_id(model: Model, name: str, kind: str, ids: np.ndarray, missing: float) -> np.ndarray:
    out = np.full(len(ids), missing, float)
    for part in np.unique(ids[ids >= 0] >> SLOT_BITS):
        at = np.flatnonzero((ids >= 0) & (ids >> SLOT_BITS == part))
        values = _mapped(model.folder, f"{name}-{part}", kind)
        if len(values):
            out[at] = values[ids[at] & ((1 << SLOT_BITS) - 1)]
    return out


def _pair_mass(model: Model, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Discounted counts of pairs, 0 where not stored."""
    out = np.zeros(len(first))
    both = np.flatnonzero((first >= 0) & (second >= 0))
    if not model.pair_parts or not len(both):
        return out
    keys = first[both] << 32 | second[both]
    parts = (first[both] + second[both]) & (model.pair_parts - 1)
    for part in np.unique(parts):
        known = _mapped(model.folder, f"pairs-{part}", "<i8")
        if not len(known):
            continue
        at = np.flatnonzero(parts == part)
        place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
        times = np.asarray(_mapped(model.folder, f"times-{part}", "<i8")[place], float)
        less = np.where(times >= 3, model.discounts[2], np.where(times >= 2, model.discounts[1], model.discounts[0]))
        out[both[at]] = np.where(known[place] == keys[at], times - less, 0.0)
    return out


def score_texts(model: Model, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Token numbers and log10 probabilities of texts."""
    words, flat, ends = _local(texts)
    ids = _ids(model, words) if model.words else np.full(len(words), -1, np.int64)
    counts = _by_id(model, "counts", "<i8", ids, 0)
    lower = _by_id(model, "lower", "<f8", ids, model.unknown)
    weights = _by_id(model, "weights", "<f8", ids, 1.0)
    totals = _by_id(model, "totals", "<f8", ids, 1.0)
    plain = np.log10((counts + 1) / (model.tokens + model.words + 1))
    place = np.flatnonzero(flat != 0)
    now, last = flat[place], flat[place - 1]
    pairs, which = np.unique(last << 32 | now, return_inverse=True)
    u, w = pairs >> 32, pairs & ((1 << 32) - 1)
    chance = np.log10(_pair_mass(model, ids[u], ids[w]) / totals[u] + weights[u] * lower[w])[which]
    per_text = np.diff(np.r_[0, ends]) - 1
    first = np.cumsum(np.r_[0, per_text[:-1]])
    add = lambda values: np.add.reduceat(values, first)  # noqa: E731  every text has its end token
    return {"n_tokens": per_text, "n_known": add((counts[now] > 0).astype(np.int64)), "base_score": add(plain[now]), "score": add(chance)}


SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (``bytes`` and more) with ``s``: SCORES."""

    @F.arrow_udf(SCORES)
    def score(texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        if not raw:
            return pa.StructArray.from_arrays([pa.array([], f.type) for f in pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.float64()), ("d", pa.float64())])], SCORES.names)
        return pa.StructArray.from_arrays([pa.array(v) for v in score_texts(model, raw).values()], SCORES.names)

    return docs.withColumn("s", score("bytes"))


def lm_query(docs: DataFrame) -> DataFrame:
    arrow_batches(docs.sparkSession, 1024)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.crc32(named) % 7 == 2).alias("held_out"), utf8().alias("bytes"))
    model = train(rows.where(~F.col("held_out")).select("bytes"))
    found = scored(rows, model)
    return found.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score",
        F.pow(F.lit(10.0), -F.col("s.score") / F.col("s.n_tokens")).alias("perplexity"),
    )
