"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from repocensus.llm import phrases

SCHEMA = "doc_id long, text string, lang string, range string, phrase string, n long, total long"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _counted(docs):
    """lang -> phrase (tuple of one to three words) -> count."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def _expected(docs):
    out = []
    for lang, f in _counted(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        found = []
        for p, a in frequent.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in frequent.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= 50 * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:2000], 1)]
    return sorted(out)


def _compare(spark, docs):
    table = spark.createDataFrame([(i, t, lang, "r", "p", 1, None) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(5)
    got = phrases.phrase_query(table)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _expected(docs)


def _hostile():
    draw = random.Random(2)
    words = ["a", "B", "the", "The", "é", "😀", "x" * 40, " ", "<b>", "na", "\x00", "İ", "\x1c"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", ";:"]
    text = lambda n: "".join(draw.choice(words) + draw.choice(ends) for _ in range(n))
    docs = [(text(draw.randrange(80)), draw.choice(["en", "de", None, "und", "", "é x"])) for _ in range(120)]
    return docs + [(None, None), ("", "en"), ("na " * 5000, "en"), (" . ,\n", "xx"), ("one", "xx")] + [("to be or not to be. New York City", "en")] * 30


def test_hostile_texts(spark):
    _compare(spark, _hostile())


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    _compare(spark, [tuple(r) for r in rows])


def _numbered(words):
    number = phrases.Vocabulary()
    return number, np.array([number[w] for w in words])


def test_slices_overlap(monkeypatch):
    """Short slices of texts and of the words of a task lose no phrase."""
    monkeypatch.setattr(phrases, "SLICE", 7)
    text = " ".join(t or "" for t, _ in _hostile())
    whole = [w for part in phrases.tokens(text.encode()) for w in part]
    monkeypatch.setattr(phrases, "SLICE", 1 << 22)
    assert whole == [w for part in phrases.tokens(text.encode()) for w in part]
    want = Counter({p: c for p, c in _counted([(text, "en")])["en"].items() if len(p) > 1})
    got = Counter()
    number, stream = _numbered([*whole, phrases.END, phrases.END])
    for at in range(0, len(stream) - 2, 50):
        for _, t in phrases.shard_transducers(stream[at : at + 52], number, 3, b"en"):
            got.update({tuple(w.decode() for w in p): n for p, n in t.phrases()})
    assert got == want


@pytest.mark.parametrize("least", [1, 3])
def test_union_and_composition(least):
    draw = random.Random(4)
    streams = [[draw.choice([b"a", b"b", b"c", b"dd", phrases.END]) for _ in range(60)] + [phrases.END] * 2 for _ in range(5)]
    want = Counter()
    for s in streams:
        for n in (1, 2, 3):
            want.update(tuple(s[i : i + n]) for i in range(len(s) - n + 1) if phrases.END not in s[i : i + n])
    each = [t for s in streams for number, at in [_numbered(s)] for _, t in phrases.shard_transducers(at, number, 1, b"en")]
    whole = phrases.united([phrases.united(each[:2]), *each[2:]], least)
    frequent = {p: n for p, n in want.items() if n >= least}
    assert dict((tuple(p), n) for p, n in whole.phrases()) == {p: n for p, n in frequent.items() if len(p) > 1}
    sizes = [x.size for x in whole.parts()]
    first, *raw = whole.packed()
    again = phrases.Transducer.unpacked(first, sizes, raw)
    asked = [p for p in (list(p) for p in sorted(want) if draw.random() < 0.5)] + [[b"zz"], [b"a", b"zz"]]
    found = phrases.composed(phrases.requested(asked), again)
    assert sorted(found) == sorted((b" ".join(p), frequent[tuple(p)]) for p in asked if tuple(p) in frequent)


def test_equal_states_are_shared():
    """Phrases with one continuation of the same weight end in one state."""
    stream = b"a x z \xff b x z \xff c x z \xff \xff".split()
    number, at = _numbered(stream)
    ((_, t),) = phrases.shard_transducers(at, number, 1, b"en")
    assert len(t.leaf_at) - 1 == 2 and len(t.middle_at) - 1 == 3


def test_products_pass_64_bits(spark):
    exact = spark.sql("SELECT 9000000000000000BD AS a, 9000000000000001BD AS l").selectExpr("(a * a * 1000000BD) div (l * l) AS score").first().score
    assert exact == 999_999


def test_empty_table(spark):
    assert phrases.phrase_query(spark.createDataFrame([], SCHEMA)).collect() == []
