"""Hostile single rows take time in proportion, and short documents are packed densely."""

import random
import time

import pytest
from pyspark.sql import functions as F

from repocensus.llm import mixing, packing, pii, urls


def _took(frame):
    began = time.time()
    rows = frame.collect()
    return rows, time.time() - began


def test_many_matches_in_one_text(spark):
    """Positions and context of tens of thousands of matches."""
    draw = random.Random(1)
    parts, want, at = [], [], 0
    for i in range(30_000):
        gap = draw.choice([" ", "é ", ", 😀 ", " social security "])
        value = draw.choice([f"user{i}@mail.example.org", f"10.0.{i % 256}.7", "123-45-6789"])
        want += [] if "-45-" in value else [("email" if "@" in value else "ip", at + len(gap), at + len(gap) + len(value))]
        parts += [gap, value]
        at += len(gap) + len(value)
    text = "".join(parts)
    docs = spark.createDataFrame([(1, text), (2, None), (None, "a@b.c"), (4, "")], "doc_id long, text string")
    pii.pii_query(docs.where("doc_id = 2")).collect()
    rows, took = _took(pii.pii_query(docs))
    got = {r.doc_id: r for r in rows}
    spans = [s.split(":") for s in got[1].spans.split(",")]
    assert [(k, int(a), int(b)) for k, a, b in spans if k in ("email", "ip")] == sorted(want)
    plain = [(i, text[max(0, i - 40) : i + 11 + 40].lower()) for i in range(len(text)) if text.startswith("123-45-6789", i)]
    near = [i for i, around in plain if any(f" {w}" in f" {around}" for w in ("social", "security"))]
    assert [int(a) for k, a, _ in spans if k == "ssn"] == near
    assert (got[None].n_email, got[2].spans, got[4].n_ip) == (1, "", 0)
    assert took < 60


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 257, 5000])
def test_sums_before(spark, n):
    numbers = [i * 7 % 11 for i in range(n)]
    table = spark.createDataFrame([(numbers,)], "n array<bigint>")
    assert table.select(pii._sums_before(F.col("n")).alias("s")).first().s == [sum(numbers[:i]) for i in range(n)]


def test_long_paths(spark):
    rows = [(1, "http://h.x/" + "a" * 300_000), (2, "http://h.x/" + "ab1" * 100_000), (3, "http://h.x/" + "f" * 300_000 + "/1a2b3c4d"), (4, None)]
    found, took = _took(urls.url_query(spark.createDataFrame(rows, "page_id long, url string")))
    assert {r.page_id: r.verdict for r in found} == dict.fromkeys((1, 2, 3, 4), "allow")
    assert took < 60


@pytest.mark.parametrize("length", [1, 17, 33, 100, 128])
def test_short_documents_fill_their_sequences(spark, length):
    """Documents of one short length, whatever it is, leave less than a document's room."""
    pieces = spark.range(4000).select(F.col("id").alias("locator"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(length).cast("long").alias("length"))
    kind = pieces.withColumn("class", packing.piece_class(F.col("length")))
    filled = packing.pack(kind).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 2048 for r in filled)
    assert 4000 * length >= 0.95 * 2048 * (len(filled) - 1)


def test_shards_are_drawn_and_shuffled(spark, hard_docs):
    rows = mixing.mix_query(hard_docs).where("taken > 0").collect()
    assert {r.shard for r in rows} <= set(range(mixing.SHARDS)) and len({r.shard for r in rows}) > 1
    stage = [r.doc_id for r in mixing.mix_stage(hard_docs).where("doc_id IS NOT NULL").collect()]
    place = {}
    for r in rows:
        if r.doc_id is not None:
            place.setdefault(r.doc_id, []).append((r.shard, r.position))
    single = [d for d in dict.fromkeys(stage) if stage.count(d) == 1 and len(place.get(d, [])) == 1]
    order = [place[d][0] for d in single]
    assert order == sorted(order) and single != sorted(single)
