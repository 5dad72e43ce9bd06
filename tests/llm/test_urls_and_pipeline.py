import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from repocensus.llm import urls
from repocensus.llm.quality import host_quality

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import WORD, _components, _fingerprint, _tokenizer  # noqa: E402

HARD = [
    None, "", "no scheme", "http://net", "https://A.NET/x?y", "http://EXAMPLE.com/de/1", "http://www.example.com/DE/", "http://notnet/", "x://a.org/fr/#f",
    "http://example.net/en/", "http://example.net/en", "://", "http://?q", "http://h.example.com/" + "a/" * 3000, "http://h.example.com/\n/x",
]


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    given = [(r.page_id, r.url, "x") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows = given + [(10**6 + i, u, None) for i, u in enumerate(HARD)] + [(None, "http://a.net/", None), given[0]]
    table = spark.createDataFrame(rows, "page_id long, url string, host string")
    by_id = {}
    for page_id, url, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        by_id[page_id] = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    got = urls.url_query(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path) == by_id[r.page_id]
        text, verdict = _rule(r.host, r.path)
        assert r.rule == text
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.url_query(table.limit(0)).collect() == []


def test_labelled_templates_are_rejected(spark):
    """Numbers and many-valued segments share one template, whose labels decide for unlabelled pages."""
    bad = [(i, f"http://h.example/pills/{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}.html") for i in range(60)]
    good = [(100 + i, f"http://h.example/news/{i}") for i in range(60)]
    pages = spark.createDataFrame(bad + good, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)], "page_id long, blocked int")
    verdicts = {r.page_id: r.verdict for r in urls.judged_urls(pages, rules=(), labels=labels).collect()}
    assert {verdicts[i] for i, _ in bad} == {"block"}
    assert {verdicts[i] for i, _ in good} == {"allow"}


def test_siblings_merge_below_the_first_level(spark):
    """Ten branches with four labelled pages each have forty labels together; merges are followed through."""
    shop = [(100 * b + i, f"http://h.example/shop/{chr(97 + b)}/item/{i}.html") for b in range(10) for i in range(8)]
    news = [(5000 + i, f"http://h.example/news/{i}") for i in range(60)]
    pages = spark.createDataFrame(shop + news, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i, _ in shop if i % 100 < 4] + [(5000 + i, 0) for i in range(0, 60, 2)], "page_id long, blocked int")
    judged = {r.page_id: r for r in urls.judged_urls(pages, rules=(), labels=labels).collect()}
    assert {judged[i].verdict for i, _ in shop} == {"block"}
    assert {judged[i].template for i, _ in shop} == {"/shop/a/item/<n>.html"}
    assert {judged[i].verdict for i, _ in news} == {"allow"}


def _staged(spark, docs, tmp_path):
    """Every stage's rows, each written and read again as the next one's documents."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_pipeline(spark, hard_docs, tmp_path):
    """Stage by stage against plain Python, each on all that its predecessor kept; hostile, repeated and null rows included."""
    given = hard_docs.collect()
    frames = _staged(spark, hard_docs, tmp_path)
    assert [f.columns for f in frames[:-1]] == [hard_docs.columns] * 4
    quality, exact, near, mixed, packed = ([*f.collect()] for f in frames)
    plain = lambda r: (r.doc_id, r.text, r.lang, r.source)

    def few_or_repeated(text):
        words = WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        return len(words) < 50 or 100 * len(inside) > 50 * len(words)

    judged = Counter(plain(r.doc) for r in host_quality(hard_docs).collect() if r.kept)
    assert Counter(map(plain, quality)) == judged and not any(few_or_repeated(r.text) for r in quality)
    assert Counter(map(plain, quality)) <= Counter(map(plain, given)) and len(quality) < len(given)

    texts = defaultdict(list)
    for r in quality:
        texts[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    assert sorted(map(str, (r.doc_id for r in exact))) == sorted(str(min((i for i in ids if i is not None), default=None)) for ids in texts.values())

    prints = {r.doc_id: _fingerprint(r.text) for r in exact if r.doc_id is not None}
    assert {r.doc_id for r in near if r.doc_id is not None} == set(_components(prints).values())

    sizes, taken = Counter(), Counter()
    for r in near:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text or ""))
    assert abs(taken.total() - 1.5 * sizes.total()) <= 0.02 * sizes.total() and all(taken[k] <= 2 * n for k, n in sizes.items())
    whole = {r.text for r in near}
    assert sum(r.text in whole for r in mixed) >= 0.9 * len(mixed)

    library = _tokenizer()
    lengths = Counter(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed)
    assert Counter(r.doc_tokens for r in packed if r.start == 0) == lengths
    assert sum(r.length for r in packed) == sum(n * k for n, k in lengths.items())
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.05 * sum(filled.values()) / 2048 + 2


def test_pipeline_runs_as_registered(spark):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert ids and ids <= {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def test_pipeline_of_no_documents(spark, no_docs, tmp_path):
    assert [f.count() for f in _staged(spark, no_docs, tmp_path)] == [0] * 5
