"""Operators on documents against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from repocensus.llm import exact, lines, lm, mixing, packing, pii, quality, simhash, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
QUERIES = [
    lines.line_query, simhash.simhash_query, pii.pii_query, exact.exact_query, quality.quality_query, packing.packed,
    tokens.token_query, mixing.mix_query, lm.lm_query,
]


@pytest.mark.parametrize("query", QUERIES)
def test_empty_table(no_docs, query):
    assert query(no_docs).collect() == []


def test_quality(hard_docs):
    for r in quality.host_quality(hard_docs).collect():
        text = r.doc.text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        rows = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(rows) - len(set(rows)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.kept and r.base_failed)
        assert r.kept or r.base_failed or r.broken


def test_exact(hard_docs):
    rows = exact.exact_query(hard_docs).collect()
    groups = defaultdict(list)
    for d in hard_docs.collect():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", d.text or "").encode()).hexdigest()].append(d.doc_id)
    got = defaultdict(list)
    for r in rows:
        got[r.text_sha256].append(r)
    assert got.keys() == groups.keys()
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        assert {(r.keep_id, r.group_size) for r in got[digest]} == {(min(known) if known else None, len(ids))}
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got[digest])
        assert [r.doc_id for r in got[digest] if r.kept] == [min(known) if known else None]


def test_exact_with_colliding_digests(hard_docs):
    from pyspark.sql import functions as F

    weak = exact.staged_documents(hard_docs, lambda text: (F.length(text) % 3).cast("string"))
    strong = exact.staged_documents(hard_docs)
    pick = ["doc_id", "text_sha256", "keep_id", "group_size", "kept"]
    assert Counter(exact.exact_verdicts(weak).select(pick).collect()) == Counter(exact.exact_verdicts(strong).select(pick).collect())
    assert exact.exact_stage(hard_docs).columns == hard_docs.columns


def _fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _components(prints):
    ids = sorted(prints)
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(hard_docs):
    rows = simhash.simhash_query(hard_docs).collect()
    prints = {d.doc_id: _fingerprint(d.text) for d in hard_docs.collect() if d.doc_id is not None}
    want = _components(prints)
    assert len(rows) == hard_docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.simhash_stage(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_dense_groups_of_fingerprints(spark):
    """Chains and clusters denser than SMALL_CELL lose no link."""
    import random

    draw = random.Random(3)
    prints, base = {}, draw.getrandbits(64)
    for i in range(60):  # a dense cluster
        prints[i] = base ^ (1 << draw.randrange(6)) ^ (1 << draw.randrange(6))
    for i in range(60, 120):  # a chain, two bits a step
        base ^= 3 << (2 * draw.randrange(32))
        prints[i] = base
    prints |= {i: draw.getrandbits(64) for i in range(120, 200)}
    table = spark.createDataFrame([(i, simhash._signed(p)) for i, p in prints.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components_of(table).collect()}
    assert got == _components(prints)


def _base_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_personal_data(hard_docs):
    texts = {d.doc_id: d.text or "" for d in hard_docs.collect()}
    for r in pii.pii_query(hard_docs.where("doc_id IS NOT NULL AND doc_id <> 1005")).collect():
        want = _base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == [f"{k}:{a}:{b}" for k, a, b in want]
    extra = {s.split(":")[0] for r in pii.pii_query(hard_docs.where("doc_id = 1009")).collect() for s in r.spans.split(",")}
    assert {"iban", "ssn", "email"} <= extra


def _tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_token_counts(hard_docs):
    library = _tokenizer()
    texts = {d.doc_id: d.text or "" for d in hard_docs.collect()}
    for r in tokens.token_query(hard_docs.where("doc_id IS NOT NULL")).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_token_counts_of_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from repocensus.llm import bpe

    library, counts = _tokenizer(), tokens.merger(bpe.vocabulary_path("byte_bpe_50k.json"))
    ids = bpe.encoder(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    alphabet = st.sampled_from("aabbeEst  \n\t'.,!1²é漢\u0301\u00a0\u2003😀<|>") | st.characters(codec="utf-8", max_codepoint=0x2FFF)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=60))
    def same(text):
        want = library.encode(text, add_special_tokens=False).ids
        assert counts.tokens([text]) == [len(want)]
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == want

    same()


def test_packing(hard_docs):
    library = _tokenizer()
    docs = hard_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = {d.doc_id: np.array(library.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4") for d in docs.collect()}
    sequences, cover = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        cover[r.doc_id].append((r.start, r.length))
    for parts, total in [(v, None) for v in sequences.values()] + [(v, len(ids[k])) for k, v in cover.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 2048 if total is None else at == total
    assert cover.keys() == ids.keys()
    every = sum(map(len, ids.values()))
    assert len(sequences) <= math.ceil(every / 2048) * 1.05 + 2


@pytest.mark.parametrize("most", [1, 7, 900])
def test_cutting_stock_holds_the_demand(most):
    import random

    draw = random.Random(most)
    demand = {k: draw.randint(1, most) for k in draw.sample(range(1, 65), 30)}
    got = Counter()
    for pattern, times in packing.cutting_stock(demand, 64):
        assert sum(size * n for size, n in pattern.items()) <= 64
        for size, n in pattern.items():
            got[size] += n * times
    assert got == demand
    assert packing.cutting_stock({}, 64) == []


def test_mixing(hard_docs):
    rows = mixing.mix_query(hard_docs).collect()
    docs = hard_docs.collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(WORD.findall(d.text or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
    assert len(rows) == len(docs)
    source, taken = {d.doc_id: d.source for d in docs if d.doc_id is not None}, Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert (r.source_size, round(r.target, 6)) == (sizes[s], round(target[s], 6))
            taken[s] += r.taken
    for s in order:
        if s not in (None, "z"):  # rows without an id are left out of the sums above
            assert abs(taken[s] - target[s]) <= 5 + 0.01 * target[s]
    again = mixing.mix_query(hard_docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in rows)
    drawn = mixing.mix_stage(hard_docs)
    assert drawn.columns == hard_docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in drawn.collect())
    assert words == sum(r.taken for r in rows)


def test_splitting_tree(spark):
    """Shards and quotas come out exactly, and one draw has the distribution's mean and spread."""
    from pyspark.sql import functions as F

    quotas = {0: 1, 1: 40, 2: 0, 3: 7, 4: 333}
    table = spark.createDataFrame(list(quotas.items()), "idx long, quota long")
    rows = mixing.split_quotas(table, 8).collect()
    total = sum(quotas.values())
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.idx] += r.n
        by_shard[r.shard] += r.n
    assert by_source == {k: v for k, v in quotas.items() if v}
    assert [by_shard[k] for k in range(8)] == [(k + 1) * total // 8 - k * total // 8 for k in range(8)]
    draws = mixing.with_draw(
        spark.range(4000).select(F.lit(30).cast("long").alias("a"), F.lit(70).cast("long").alias("b"), F.lit(20).cast("long").alias("n"), ((F.col("id") + 0.5) / 4000).alias("u"))
    )
    left = np.array([r.left for r in draws.select("left").collect()])
    assert abs(left.mean() - 6) < 0.01
    assert abs(left.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.05


def test_language_model(hard_docs):
    docs = hard_docs.where("doc_id IS NOT NULL")
    texts = {d.doc_id: d.text or "" for d in docs.collect()}
    words = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split(), b""]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter()
    for d in docs.collect():
        if not held[d.doc_id]:
            counts.update(words(d.text or ""))
    total, kinds = sum(counts.values()), len(counts)
    for r in lm.lm_query(docs).collect():
        own = words(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in counts for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_language_model_is_a_distribution(spark):
    """After any word the probabilities of all known words and one unknown word sum to one."""
    texts = [b"a b a b c", b"a b d e a c", b"b a b", b"c c a b e", b"", b"a b"] * 2
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "bytes binary"))
    words = sorted({w for t in texts for w in t.split()} | {lm.END})
    ids = lm._ids(model, words)
    lower = lm._by_id(model, "lower", "<f8", ids, model.unknown)
    assert lower.sum() + model.unknown == pytest.approx(1)
    for u in lm._ids(model, [w for w in words if w != lm.END] + [lm.START]):
        first = np.full(len(ids), u)
        weight = lm._by_id(model, "weights", "<f8", first, 1.0)
        chance = lm._pair_mass(model, first, ids) / lm._by_id(model, "totals", "<f8", first, 1.0) + weight * lower
        assert chance.sum() + weight[0] * model.unknown == pytest.approx(1)


def test_language_model_keeps_pairs_seen_once(spark):
    """Probabilities are the interpolated ones counted in plain Python, with pairs seen once in them."""
    texts = [b"a b a b c", b"a b d e a c", b"b a b", b"c c a b e", b"d a", b"e b a"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "bytes binary"))
    counts = Counter()
    for t in texts:
        counts.update(zip([lm.START, *t.split()], [*t.split(), lm.END], strict=True))
    once = [pair for pair, n in counts.items() if n == 1]
    assert once
    less = lambda n: model.discounts[min(n, 3) - 1]
    words = sorted({w for pair in counts for w in pair})
    ids = dict(zip(words, lm._ids(model, words).tolist(), strict=True))
    for u in {a for a, _ in counts}:
        first = np.array([ids[u]])
        total = sum(n for (a, _), n in counts.items() if a == u)
        assert lm._by_id(model, "weights", "<f8", first, 1.0)[0] == pytest.approx(sum(less(n) for (a, _), n in counts.items() if a == u) / total)
    for u, w in once:
        assert lm._pair_mass(model, np.array([ids[u]]), np.array([ids[w]]))[0] == pytest.approx(1 - less(1))


def test_lines(hard_docs):
    rows = lines.deduplicated_lines(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    # Templates with fields recur across documents; a repeat within one document alone does not count.
    assert found[1013].dropped == [] and found[1014].dropped == [0]
    assert found[1012].dropped == []
    first = {}
    for d in sorted((d for d in hard_docs.collect() if d.doc_id is not None and d.doc_id < 1000), key=lambda d: d.doc_id):
        for i, line in enumerate((d.text or "").split("\n")):
            if len(line.split()) >= lines.MIN_TOKENS and first.setdefault(line, d.doc_id) != d.doc_id:
                assert i in found[d.doc_id].dropped
        assert found[d.doc_id].text.count("\n") <= (d.text or "").count("\n")


def test_short_lines_recur(spark):
    texts = ["All rights reserved.\nfirst\n\n12", "second\n  All rights   reserved.\n\n13", "All rights reserved\nPage 3", "Page 14\nthird"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in lines.deduplicated_lines(docs).collect()} == {0: [], 1: [1], 2: [], 3: [0]}


@pytest.mark.parametrize("hosts, days", [(2, 2), (3, 2), (6, 7)])
def test_crossing_fields_share_a_template(spark, hosts, days):
    """Values of two word fields that cross stay fields, however many lines have each of them."""
    crossed = [(h, d) for h in range(hosts) for d in range(days)]
    for chosen in (crossed, crossed[:-1]):
        texts = [f"User {i} logged in from host {'abcdefg'[h] * 4} at 10:0{i} on {'tuvwxyz'[d] * 5}." for i, (h, d) in enumerate(chosen)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.dropped for r in lines.deduplicated_lines(docs).collect()} == {i: [0] if i else [] for i in range(len(texts))}
