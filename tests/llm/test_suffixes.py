"""Repeated strings against a table of all strings of that length."""

import hashlib
import random
from collections import Counter

import pytest

from repocensus.llm import suffixes

SCHEMA = "doc_id long, text string, lang string, locator string, spans string, place long"


def _expected(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\x00" + gone, strict=False))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _compare(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    table = spark.createDataFrame([(i, t, "x", "l", "s", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(6)
    got = suffixes.suffix_dedup(table)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter((i, *x) for i, x in zip(ids, _expected(texts), strict=True))


def _hostile():
    draw = random.Random(8)
    noise = lambda n: "".join(draw.choices("ab é😀\n.", k=n))
    wide = lambda n: "".join(chr(draw.randrange(32, 127)) for _ in range(n))
    shared = [wide(n) for n in (198, 199, 200, 201, 263, 264, 400, 1500)]
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 5000, "ab" * 700, "same words here " * 300, wide(3000), wide(199), wide(200)]
    for s in shared:
        for cut in (0, 1, 40):
            texts += [wide(draw.randrange(120)) + s[cut:] + wide(draw.randrange(120)), noise(300) + s + s[: len(s) // 2] + noise(10)]
    texts += [shared[4] + shared[5], shared[5] + shared[4], shared[-1] * 3, wide(50) + shared[-1][3:900] + wide(9)]
    texts += [texts[8][:1000] + "x" + texts[8][1000:], texts[8][500:1700], texts[8]]
    return texts


def test_hostile_texts(spark):
    texts = _hostile()
    ids = [*range(len(texts) - 2), None, None]
    _compare(spark, texts + texts[:9], ids + ids[:9])


def test_given_documents(spark):
    _compare(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()])


def test_small_runs_and_slices(spark, monkeypatch):
    """Suffixes of one task in many runs; texts hashed in slices have the same anchors."""
    texts = _hostile()
    raw = [(t or "").encode() for t in texts]
    flat, ends = suffixes._flat(suffixes.pa.array(raw))
    place, *_ = suffixes.anchors(flat, ends)
    monkeypatch.setattr(suffixes, "PLACE_BITS", 10)
    again, _, first, last = suffixes.anchors(flat, ends)
    assert sorted(set(again.tolist())) == place.tolist()
    starts = [i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)]
    begins = [0, *ends.tolist()]
    assert starts == [i for a, b in zip(begins, begins[1:], strict=False) for i in range(a, b - 199)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    draw = random.Random(k)
    runs = [sorted("".join(draw.choices("ab", k=draw.randrange(9))).encode() for _ in range(draw.randrange(30))) for _ in range(k)]
    coded = [suffixes.front_coded(r) for r in runs]
    assert [suffixes.front_decoded(*c) for c in coded] == runs
    order, prefixes = suffixes.merged([(r, c[0]) for r, c in zip(runs, coded, strict=True)])
    out = [runs[r][i] for r, i in order]
    assert out == sorted(x for r in runs for x in r) and len(set(order)) == len(order)
    assert prefixes[1:] == [suffixes.mismatch(a, b, 0) for a, b in zip(out, out[1:], strict=False)]


def test_merge_reads_known_prefixes_once(monkeypatch):
    """Strings that share all but their ends are compared from the ends on."""
    runs = [[b"x" * 150 + bytes([65 + i, 65 + r]) for i in range(20)] for r in range(4)]
    read, plain = [], suffixes.mismatch
    coded = [(r, suffixes.front_coded(r)[0]) for r in runs]
    monkeypatch.setattr(suffixes, "mismatch", lambda a, b, known: read.append(plain(a, b, known) - known) or plain(a, b, known))
    suffixes.merged(coded)
    assert sum(n > 2 for n in read) == 3  # the first round's


def test_spans_touch_and_overlap():
    own = [{"start": a, "stop": b} for a, b in [(0, 200), (200, 400), (500, 700), (650, 900), (510, 720)]]
    assert suffixes.removed_spans(own) == [(0, 400), (500, 900)]
    assert suffixes.removed_spans(None) == []


def test_empty_table(spark):
    assert suffixes.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
