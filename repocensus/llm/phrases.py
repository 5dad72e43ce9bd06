"""Phrase collocation mining with weighted acyclic automata (operator 13).

A shard (at most SHARD_WORDS words of one language inside a task) counts its phrases of one to three words, sorts them and builds
count transducers from the sorted list: acyclic automata whose arcs are words and whose arc weight is the count of
the phrase that ends there. A state is frozen when the list leaves its prefix, and equal states are shared through a register.
Phrases belong to prefix ranges, equal ranges of the hash of language and first two words, with a transducer for each shard
and range; so neither a hot word nor a hot pair of words gathers the phrases that contain it. Per range the transducers are
united and weights summed by prefix, level by level. No phrase below MIN_COUNT can be a candidate or part of one, so
those go after the sum. Parts of candidates are looked up by composition: the acyclic automaton of a range's requested parts
is walked together with its count transducer.

Texts are lower-cased (A-Z), null is empty, a null ``lang`` is ``und``; pieces end at ``[.,;:!?`` and line breaks, words
at blanks and tabs. A text of any length is counted in slices that overlap by two words. Repeated rows count again. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repocensus.llm.tables import batch_rows, stored, utf8

MIN_COUNT = 10
INSIDE = 50  # percent of a phrase's occurrences that a longer candidate needs to replace it
TOP = 2000
SHARD_WORDS = 1 << 20
HELD_WORDS, HELD_TOKENS = 1 << 20, 4 << 20  # of all languages in a task, about
WORD_BITS = 21  # SHARD_WORDS and two more fit
UNITED_ARCS = 4_000_000
DEALT = 64

# Piece ends become a byte that no UTF-8 text has, tabs blanks, A-Z a-z.
END = b"\xff"
_GAP = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
SLICE = 1 << 22
_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", END * 10 + b" abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words, with END between pieces and after the last, in lists of bounded size."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_SEPARATORS).replace(END, b" " + END + b" ").split()
        at = end
    yield [END]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of the weights of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = _starts(keys)
    return keys[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def _spread(offsets: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of ``states`` in a row, and for each the number of its state in ``states``."""
    sizes = offsets[states + 1] - offsets[states]
    owner = np.repeat(np.arange(len(states)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - first[owner] + offsets[states][owner], owner


def _squeezed(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def _unsqueezed(raw: bytes) -> bytes:
    return zstandard.decompress(raw)


@dataclass
class Transducer:
    """States of depth one and two with their arcs: label (a word's number), weight, and target if not the last word."""

    words: list[bytes]  # in order
    root: np.ndarray  # label, weight, target
    middle: np.ndarray  # of all depth-one states in a row
    middle_at: np.ndarray  # where each state's arcs begin
    leaf: np.ndarray  # label, weight
    leaf_at: np.ndarray

    def pairs(self) -> tuple[np.ndarray, ...]:
        """First word, second word, weight and target of every two-word phrase, in order."""
        arcs, owner = _spread(self.middle_at, self.root[:, 2])
        return self.root[owner, 0], *self.middle[arcs].T

    def triples(self) -> tuple[np.ndarray, ...]:
        """Number of the pair, third word and weight of every three-word phrase, in order."""
        arcs, owner = _spread(self.leaf_at, self.pairs()[3])
        return owner, *self.leaf[arcs].T

    def phrases(self) -> Iterator[tuple[list[bytes], int]]:
        """Every phrase of two or three words with a weight."""
        first, second, weight, _ = (x.tolist() for x in self.pairs())
        for a, b, n in zip(first, second, weight, strict=True):
            if n:
                yield [self.words[a], self.words[b]], n
        for p, c, n in zip(*(x.tolist() for x in self.triples()), strict=True):
            if n:
                yield [self.words[first[p]], self.words[second[p]], self.words[c]], n

    def packed(self) -> list[bytes]:
        """Compressed by column, which are alike in themselves; four bytes a number if that is enough."""
        narrow = ("<i8" if x.size and x.max() >> 31 else "<i4" for x in self.parts())
        return [_squeezed(b" ".join(self.words)), *(_squeezed(x.T.astype(kind).tobytes()) for x, kind in zip(self.parts(), narrow, strict=True))]

    def parts(self) -> list[np.ndarray]:
        return [self.root, self.middle, self.middle_at, self.leaf, self.leaf_at]

    @staticmethod
    def unpacked(words: bytes, sizes: list[int], raw: list[bytes]) -> Transducer:
        """``sizes`` are the numbers of values of the arrays, which tell their width."""
        words, *plain = map(_unsqueezed, (words, *raw))
        root, middle, middle_at, leaf, leaf_at = (np.frombuffer(r, f"<i{len(r) // n}" if n else "<i4").astype(np.int64) for r, n in zip(plain, sizes, strict=True))
        whole = lambda x, width: np.ascontiguousarray(x.reshape(width, -1).T)
        return Transducer(words.split(b" ") if words else [], whole(root, 3), whole(middle, 3), middle_at, whole(leaf, 2), leaf_at)


def _frozen(arcs: np.ndarray, starts: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goes through sorted ``arcs``, cut into states at ``starts`` (one more than states), and shares equal states.

    Returns each state's number in the register, and the registered states' arcs and where they begin. States of one
    arc, which most are, are found equal by sorting them, others by their bytes as they come.
    """
    sizes = np.diff(starts)
    one = np.flatnonzero(sizes == 1)
    single = arcs[starts[:-1][one]]
    order = np.lexsort(single.T[::-1])
    new = np.ones(len(one), bool)
    new[1:] = (single[order][1:] != single[order][:-1]).any(axis=1)
    numbers = np.empty(states, np.int64)
    numbers[one[order]] = np.cumsum(new) - 1
    alone = single[order][new]
    raw, width = arcs.tobytes(), arcs.shape[1] * 8
    register: dict[bytes, int] = {}
    more = np.flatnonzero(sizes != 1)
    cuts = zip((starts[:-1][more] * width).tolist(), (starts[1:][more] * width).tolist(), strict=True)
    numbers[more] = np.fromiter((register.setdefault(raw[a:b], len(register)) for a, b in cuts), np.int64, len(more)) + len(alone)
    lengths = np.concatenate([np.ones(len(alone), np.int64), np.fromiter((len(x) // width for x in register), np.int64, len(register))])
    rest = np.frombuffer(b"".join(register), np.int64).reshape(-1, arcs.shape[1])
    return numbers, np.concatenate([alone, rest]), np.concatenate([[0], np.cumsum(lengths)])


def built(words: list[bytes], ones: tuple, pairs: tuple, triples: tuple) -> Transducer:
    """From sorted phrases: ones (word, weight), pairs (first, second, weight), triples (pair's number, third, weight)."""
    ends = np.searchsorted(triples[0], np.arange(len(pairs[0]) + 1))
    below, leaf, leaf_at = _frozen(np.stack(triples[1:], axis=1), ends, len(pairs[0]))
    labels = np.union1d(ones[0], pairs[0])
    starts = np.concatenate([np.searchsorted(pairs[0], labels), [len(pairs[0])]])
    targets, middle, middle_at = _frozen(np.stack([pairs[1], pairs[2], below], axis=1), starts, len(labels))
    weights = np.zeros(len(labels), np.int64)
    weights[np.searchsorted(labels, ones[0])] = ones[1]
    return Transducer(words, np.stack([labels, weights, targets], axis=1), middle, middle_at, leaf, leaf_at)


def _only_used(words: list[bytes], *columns: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Words that the columns use, in order, and the columns in their new numbers."""
    used = np.zeros(len(words), bool)
    for c in columns:
        used[c] = True
    renumbered = np.cumsum(used) - 1
    return [words[i] for i in np.flatnonzero(used).tolist()], [renumbered[c] for c in columns]


class Vocabulary(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def shard_transducers(stream: np.ndarray, number: Vocabulary, ranges: int, lang: bytes) -> Iterator[tuple[int, Transducer]]:
    """(range, transducer) of the phrases that begin in the stream of words' numbers, but not among its last two."""
    known, at = np.unique(stream, return_inverse=True)
    every = list(number)
    mine = [every[i] for i in known.tolist()]
    order = sorted((i for i, w in enumerate(mine) if w != END), key=mine.__getitem__)
    words = [mine[i] for i in order]
    rank = np.full(len(mine), -1, np.int64)
    rank[order] = np.arange(len(order))
    at = rank[at]
    first, second, third = at[:-2], at[1:-1], at[2:]
    in_one = first >= 0
    in_pair = in_one & (second >= 0)
    in_triple = in_pair & (third >= 0)
    ones, one_counts = np.unique(first[in_one], return_counts=True)
    pairs, pair_counts = np.unique(first[in_pair] << WORD_BITS | second[in_pair], return_counts=True)
    triples, triple_counts = np.unique(first[in_triple] << 2 * WORD_BITS | second[in_triple] << WORD_BITS | third[in_triple], return_counts=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    one_range = _range(hashes[ones], np.zeros(1, np.uint64), lang, ranges)
    pair_range = _range(hashes[pairs >> WORD_BITS], hashes[pairs & (1 << WORD_BITS) - 1], lang, ranges)
    owner = np.searchsorted(pairs, triples >> WORD_BITS)
    triple_range = pair_range[owner]
    # Stable sorts: within a range phrases stay in order.
    orders = [np.argsort(r, kind="stable") for r in (one_range, pair_range, triple_range)]
    cuts = [np.searchsorted(r[o], np.arange(ranges + 1)) for r, o in zip((one_range, pair_range, triple_range), orders, strict=True)]
    for k in range(ranges):
        o, p, t = (order[cut[k] : cut[k + 1]] for order, cut in zip(orders, cuts, strict=True))
        if len(o) or len(p):
            used, (a, b, c, d) = _only_used(words, ones[o], pairs[p] >> WORD_BITS, pairs[p] & (1 << WORD_BITS) - 1, triples[t] & (1 << WORD_BITS) - 1)
            yield k, built(used, (a, one_counts[o]), (b, c, pair_counts[p]), (np.searchsorted(p, owner[t]), d, triple_counts[t]))


def _range(first: np.ndarray, second: np.ndarray, lang: bytes, ranges: int) -> np.ndarray:
    """The prefix range of phrases by the hashes of their first two words; zero for no second word."""
    with np.errstate(over="ignore"):
        mixed = (first ^ np.uint64(xxhash.xxh64_intdigest(lang, 7))) * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def united(transducers: list[Transducer], least: int = 1) -> Transducer:
    """The union, weights summed; phrases below ``least`` go."""
    words = sorted(set().union(*(t.words for t in transducers)))
    place = {w: i for i, w in enumerate(words)}
    new = [np.fromiter((place[w] for w in t.words), np.int64, len(t.words)) for t in transducers]
    none = [np.zeros(0, np.int64)]
    ones = _summed(np.concatenate(none + [n[t.root[:, 0]] for t, n in zip(transducers, new, strict=True)]), np.concatenate(none + [t.root[:, 1] for t in transducers]))
    of_pairs = [(n[x[0]] << 32 | n[x[1]], x[2]) for x, n in ((t.pairs(), n) for t, n in zip(transducers, new, strict=True))]
    pairs = _summed(np.concatenate(none + [k for k, _ in of_pairs]), np.concatenate(none + [w for _, w in of_pairs]))
    # A pair's number among all stands for its prefix.
    among = [np.searchsorted(pairs[0], k) for k, _ in of_pairs]
    of_triples = [(m[x[0]] << 32 | n[x[1]], x[2]) for x, m, n in zip((t.triples() for t in transducers), among, new, strict=True)]
    triples = _summed(np.concatenate(none + [k for k, _ in of_triples]), np.concatenate(none + [w for _, w in of_triples]))
    ones, pairs_kept, triples = (tuple(x[w >= least] for x in (k, w)) for k, w in (ones, pairs, triples))
    # A phrase's prefix is at least as frequent as it is, so no pair of a triple is missing.
    owner = np.searchsorted(pairs_kept[0], pairs[0][triples[0] >> 32])
    low = (1 << 32) - 1
    used, (a, b, c, d) = _only_used(words, ones[0], pairs_kept[0] >> 32, pairs_kept[0] & low, triples[0] & low)
    return built(used, (a, ones[1]), (b, c, pairs_kept[1]), (owner, d, triples[1]))


def requested(phrases: list[list[bytes]]) -> Transducer:
    """The automaton of some sorted different phrases of one to three words, with weight one each."""
    words = sorted({w for p in phrases for w in p})
    place = {w: i for i, w in enumerate(words)}
    by = [[[place[w] for w in p] for p in phrases if len(p) == n] for n in (1, 2, 3)]
    ones, pairs, triples = (np.array(x, np.int64).reshape(-1, n) for n, x in enumerate(by, 1))
    every = np.unique(np.concatenate([pairs, triples[:, :2]]), axis=0)
    keys = every[:, 0] << 32 | every[:, 1]
    asked = np.isin(keys, pairs[:, 0] << 32 | pairs[:, 1]).astype(np.int64)
    owner = np.searchsorted(keys, triples[:, 0] << 32 | triples[:, 1])
    return built(words, (ones[:, 0], np.ones(len(ones), np.int64)), (every[:, 0], every[:, 1], asked), (owner, triples[:, 2], np.ones(len(triples), np.int64)))


def composed(asked: Transducer, counts: Transducer) -> list[tuple[bytes, int]]:
    """(phrase, count) of the phrases of both, by walking both from their roots at once."""
    place = {w: i for i, w in enumerate(counts.words)}
    new = np.fromiter((place.get(w, -1) for w in asked.words), np.int64, len(asked.words))
    out = []

    def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        return np.flatnonzero(hit), at[hit]

    def owners(offsets: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    mine, theirs = found(counts.root[:, 0], new[asked.root[:, 0]])
    prefixes = [asked.words[i] for i in asked.root[mine, 0].tolist()]
    out += [(p, w) for p, ask, w in zip(prefixes, asked.root[mine, 1].tolist(), counts.root[theirs, 1].tolist(), strict=True) if ask and w]
    for mine_arcs, mine_at, arcs, at in ((asked.middle, asked.middle_at, counts.middle, counts.middle_at), (asked.leaf, asked.leaf_at, counts.leaf, counts.leaf_at)):
        before = (asked.root, counts.root) if mine_arcs is asked.middle else (asked.middle, counts.middle)
        my_states, their_states = before[0][mine, 2], before[1][theirs, 2]
        mine, owner = _spread(mine_at, my_states)
        keys = owners(at) << 32 | arcs[:, 0]
        label = new[mine_arcs[mine, 0]]
        hit, theirs = found(keys, np.where(label >= 0, their_states[owner] << 32 | label, -1))
        mine, owner = mine[hit], owner[hit]
        prefixes = [prefixes[i] + b" " + asked.words[j] for i, j in zip(owner.tolist(), mine_arcs[mine, 0].tolist(), strict=True)]
        out += [(p, w) for p, ask, w in zip(prefixes, mine_arcs[mine, 1].tolist(), arcs[theirs, 1].tolist(), strict=True) if ask and w]
    return out


BLOB = "lang string, range long, total long, words binary, sizes array<long>, root binary, middle binary, middle_at binary, leaf binary, leaf_at binary"
_BLOB_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("total", pa.int64()), ("words", pa.binary()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("root", "middle", "middle_at", "leaf", "leaf_at"))])


def _blobs(rows: Iterable[tuple[str, int, Transducer]], total: int = 0) -> Iterator[pa.RecordBatch]:
    """Transducers as rows, with the number of all words."""
    for lang, k, t in rows:
        words, *raw = t.packed()
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOB_ARROW.names, [lang, k, total, words, [x.size for x in t.parts()], *raw], strict=True))], _BLOB_ARROW)


def _of_blobs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, Transducer]]:
    for row in batch.to_pylist():
        yield row["lang"], row["range"], Transducer.unpacked(row["words"], row["sizes"], [row[c] for c in _BLOB_ARROW.names[5:]])


def shards(docs: DataFrame, ranges: int) -> DataFrame:
    """Each shard's transducers, one for each prefix range."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        numbers: dict[str, Vocabulary] = defaultdict(Vocabulary)
        sizes: Counter = Counter()

        def cut(lang, least):
            """Slices with two tokens more, whose phrases the next slice has."""
            stream, at = np.concatenate(held[lang]), 0
            while len(stream) - at >= least:
                yield from ((lang, *x) for x in shard_transducers(stream[at : at + SHARD_WORDS + 2], numbers[lang], ranges, lang.encode()))
                at += SHARD_WORDS
            held[lang] = [stream[at:]]
            sizes[lang] = len(held[lang][0])

        def rest():
            for lang in list(held):
                held[lang].append(np.full(2, numbers[lang][END]))
                yield from _blobs(cut(lang, 3))
            for x in (held, numbers, sizes):
                x.clear()

        words = total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, before = numbers[lang], len(numbers[lang])
                for some in tokens(text):
                    held[lang].append(np.fromiter(map(number.__getitem__, some), np.int64, len(some)))
                    sizes[lang] += len(some)
                    total += len(some)
                    if sizes[lang] >= SHARD_WORDS + 2:
                        yield from _blobs(cut(lang, SHARD_WORDS + 2))
                words += len(number) - before
                if words > HELD_WORDS or total > HELD_TOKENS:
                    yield from rest()
                    words = total = 0
        yield from rest()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8().alias("text")).mapInArrow(run, BLOB)


def _united_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers come by language and range; those of one are united as they come, a bounded number of arcs at a time.

    Phrases below MIN_COUNT go at the end.
    """
    now, held, arcs, words = None, [], 0, 0
    for lang, k, t in itertools.chain.from_iterable(map(_of_blobs, batches)):
        if now != (lang, k):
            if held:
                yield from _blobs([(*now, united(held, MIN_COUNT))], words)
            now, held, arcs, words = (lang, k), [], 0, 0
        held.append(t)
        words += int(t.root[:, 1].sum())
        arcs += sum(map(len, (t.root, t.middle, t.leaf)))
        if arcs > UNITED_ARCS:
            held = [united(held)]
            arcs = 0
    if held:
        yield from _blobs([(*now, united(held, MIN_COUNT))], words)


CUTS = "lang string, phrase string, a long, k int, side string, part string, range long"


def _cuts(ranges: int):
    """Each candidate's parts, and the range that counts them."""

    def run(batches):
        names = [x.split()[0] for x in CUTS.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for lang, _, t in _of_blobs(batch):
                words = [w.decode() for w in t.words]
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in t.words), np.uint64, len(words))
                first, second, twice, _ = t.pairs()
                owner, third, thrice = t.triples()
                for of, count in (((first, second), twice), ((first[owner], second[owner], third), thrice)):
                    for at in range(0, len(count), 20_000):
                        part = [w[at : at + 20_000] for w in of]
                        spelt = [[words[i] for i in w.tolist()] for w in part]
                        phrases = list(map(" ".join, zip(*spelt, strict=True)))
                        for k in range(1, len(of)):
                            for side, span in (("l", slice(0, k)), ("r", slice(k, None))):
                                two = [hashes[w] for w in part[span][:2]] + [np.zeros(1, np.uint64)]
                                columns = [
                                    [lang] * len(phrases), phrases, count[at : at + 20_000], [k] * len(phrases), [side] * len(phrases),
                                    list(map(" ".join, zip(*spelt[span], strict=True))), _range(two[0], two[1], lang.encode(), ranges),
                                ]
                                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def _answers(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """A range's requested parts with their counts."""
    out: list[tuple[str, str, int]] = []
    parts = sorted(p.encode() for p in asked.column("part").to_pylist())
    if parts:
        request = requested([p.split(b" ") for p in parts])
        for batch in counts.to_batches():
            for lang, _, t in _of_blobs(batch.select(_BLOB_ARROW.names)):
                out += [(lang, p.decode(), n) for p, n in composed(request, t)]
    return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "part", "f"])


def collocations(docs: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of every candidate, and ``longer``: the most occurrences of a candidate that holds it."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batch_rows(spark, 256):
        each = stored(shards(docs, ranges), "phrase-shards")
    with batch_rows(spark, 4):
        dealt = each.repartition(ranges, "lang", "range").sortWithinPartitions("lang", "range")
        counts = stored(dealt.mapInArrow(_united_ranges, BLOB), "phrase-counts", shuffles_go=True)
        cuts = stored(counts.mapInArrow(_cuts(ranges), CUTS), "phrase-cuts")
    asked = cuts.select("lang", "range", "part").distinct()
    with batch_rows(spark, 10_000):
        met = asked.groupBy("lang", "range").cogroup(counts.groupBy("lang", "range"))
        answers = stored(met.applyInArrow(_answers, "lang string, part string, f long"), "phrase-parts", shuffles_go=True)
    sides = cuts.join(answers, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        *[F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"]
    )
    exact = [F.col(c).cast("decimal(19,0)") for c in "alr"]
    whole = sides.select("*", *[x.alias(f"{c}_exact") for c, x in zip("alr", exact, strict=True)])
    scored = whole.withColumn("score", F.expr("(a_exact * a_exact * 1000000BD) div (l_exact * r_exact)"))
    least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = F.split("phrase", " ")
    inside = (
        least.where(F.size(words) == 3)
        .select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    n = counts.groupBy("lang").agg(F.sum("total").alias("n"))
    found = least.join(inside, ["lang", "phrase"], "left").join(n, "lang")
    return found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "longer")


def phrase_query(docs: DataFrame) -> DataFrame:
    """Each language's TOP collocations."""
    stay = collocations(docs).where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First in DEALT parts of a language: no task sees all of its phrases.
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)
    some = stay.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= TOP)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
u AS (SELECT c.*, s.cut, array_to_string(w[1:s.cut], ' ') AS x, array_to_string(w[s.cut + 1:], ' ') AS y FROM c, (VALUES (1), (2)) s(cut) WHERE s.cut < c.k),
s AS (SELECT u.lang, u.k, u.phrase, u.a, u.cut, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * u.a * u.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.x JOIN f r ON r.lang = u.lang AND r.phrase = u.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2
      WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
