"""Token counts by rank-synchronous merging of arrays (operator 8).

Texts are cut at single blanks, where tokens always end, and known words are counted from a bounded cache. The
unknown words of a batch become pre-tokens, held as one ragged byte array: in every round each pre-token's
lowest-ranked pair is merged at all its places at once, for all pre-tokens together, until none has a
mergeable pair. What survives is counted. The vocabulary is a file on the machine or in ``path``; only counts leave
the workers and nothing is shuffled.

The special string counts as one token wherever it stands, as the library has it. Null or empty
texts have no bytes and no tokens; repeated rows are counted each; empty tables give empty results.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.llm.bpe import CACHED_WORDS, SPECIAL, VOCABULARY, vocabulary_path
from repocensus.llm.tables import arrow_batches, utf8

LIMIT = 512
COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merger:
    """Counts tokens of pre-tokens with the merges of a byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.symbol = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.symbol[byte] = ids[letter]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        order = np.argsort(left << 32 | right)
        self.pairs, self.rank = (left << 32 | right)[order], order
        self.product = np.array([ids[a + b] for a, b in merges], np.int64)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = {}

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place; a large number where there is none."""
        out = np.full(len(symbols), 1 << 30, np.int64)
        if len(symbols) > 1:
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            hit = (self.pairs[at] == keys) & (owner[:-1] == owner[1:])
            out[:-1] = np.where(hit, self.rank[at], 1 << 30)
        return out

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of each (non-empty) pre-token."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        symbols = self.symbol[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        counts = sizes.copy()
        while len(symbols):
            ranks = self._ranks(symbols, owner)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, first)
            going = lowest < 1 << 30
            lengths = np.diff(np.r_[first, len(symbols)])
            counts[owner[first[~going]]] = lengths[~going]
            if not going.any():
                break
            # Pre-tokens that are done leave the arrays.
            keep = np.repeat(going, lengths)
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            merge = ranks == np.repeat(lowest[going], lengths[going])
            # Of overlapping places in a run every second one merges, from the left.
            place = np.arange(len(merge))
            begins = merge & ~np.r_[False, merge[:-1]]
            run = np.maximum.accumulate(np.where(begins, place, 0))
            merge &= (place - run) % 2 == 0
            symbols[merge] = self.product[ranks[merge]]
            stays = ~np.r_[False, merge[:-1]]
            symbols, owner = symbols[stays], owner[stays]
        return counts

    def tokens(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, jobs, unknown = self.known, [], set()
        for text in texts:
            segments = text.split(SPECIAL)
            parts: list[str] = []
            for segment in segments:
                words = segment.split(" ")
                pieces = [words[0], *[" " + w for w in words[1:]]] if words[0] else [" " + w for w in words[1:]]
                # Blanks that touch other white space belong together: such a segment goes to the pattern whole.
                fresh = set(pieces).difference(known)
                if any(not (w := p[1:] if p[0] == " " else p) or w[0].isspace() or w[-1].isspace() for p in fresh):
                    pieces = self.split(segment)
                    fresh = set(pieces).difference(known)
                unknown |= fresh
                parts += pieces
            jobs.append((len(segments) - 1, parts))
        self._learn(list(unknown))
        return [special + sum(map(known.__getitem__, parts)) for special, parts in jobs]

    def _learn(self, words: list[str]) -> None:
        cut = [self.split(w) for w in words]
        flat = [t.encode() for tokens in cut for t in tokens]
        if not flat:
            return
        unique, which = {}, []
        for t in flat:
            which.append(unique.setdefault(t, len(unique)))
        counts = self.count(list(unique))[which]
        ends = np.cumsum([0, *map(len, cut)])
        self.known.update(zip(words, np.add.reduceat(counts, ends[:-1]).tolist(), strict=True))


@functools.cache
def merger(path: str) -> Merger:
    """One per worker."""
    return Merger(path)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row."""
    path = path or vocabulary_path(f"{VOCABULARY}.json")

    @F.arrow_udf(COUNTS)
    def counts(texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        tokens = merger(path).tokens([t.decode("utf-8", "replace") for t in raw])
        columns = [pa.array([len(t) for t in raw], pa.int64()), pa.array(tokens, pa.int64())]
        return pa.StructArray.from_arrays(columns, COUNTS.names)

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", counts(utf8()).alias("c")).select("doc_id", "c.*")


def token_query(docs: DataFrame) -> DataFrame:
    return token_counts(docs.select("doc_id", "text")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
