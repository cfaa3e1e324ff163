"""Operators over pages and embeddings, and the pipeline."""

import struct

import numpy as np
import pytest

from donorlift.llm import topk, urls, warc
from donorlift.llm.common import shared_path

from edge_tables import ROWS, same_as_sql


# -- 3 ------------------------------------------------------------------------
def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules(spark, edge_dir):
    rows = urls.op3_urls(spark, edge_dir).collect()
    want = sorted(repr((p, *brute_rule(u)[:3])) for p, u, *_ in ROWS["pages"]())
    assert sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in rows) == want
    verdict = {r: v for _, u, *_ in ROWS["pages"]() for *_, r, v in [brute_rule(u)]}
    for r in rows:
        assert r.verdict in ("block", "allow")
        assert (r.verdict == verdict[r.rule] and r.score is None) if r.rule else 0 <= r.score <= 1


def test_url_trees_learn_from_decided_urls(spark):
    rows = [(i, f"http://{'ads' + str(i) * 6 if i % 2 else 'news'}.{'bad' if i % 2 else 'good'}/p") for i in range(200)]
    rows += [(1000 + i, f"http://{'ads777777' if i % 2 else 'news'}.other/p") for i in range(20)]
    rules = [("block", "bad", "/"), ("allow", "good", "/")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(20))


def test_one_hot_url_does_not_break_the_bound(spark, monkeypatch):
    """Rows of one url are drawn apart, so the sample stays near its bound."""
    fitted = []
    fit = urls.GBTClassifier.fit
    monkeypatch.setattr(urls.GBTClassifier, "fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    monkeypatch.setattr(urls, "TREES", 2)
    rows = [(i, "http://hot.net/a") for i in range(600)] + [(600 + i, f"http://h{i}.org/fr/{i}") for i in range(200)] + [(900, "http://x.io/")]
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string"), train_urls=200).count() == len(rows)
    assert len(fitted) == 1 and 120 < fitted[0] < 280


def test_urls_without_labels_or_of_one_class(spark, empty_dir):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/"), (3, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "block"}
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
    assert urls.op3_urls(spark, empty_dir).collect() == []


# -- 4 ------------------------------------------------------------------------
def test_warc_equals_sql(spark, edge_dir, duck):
    got = warc.op4_warc(spark, edge_dir).where("page_id IS NOT NULL")
    same_as_sql(duck, got, f"SELECT * FROM ({warc.SQL}) WHERE page_id IS NOT NULL")


def test_warc_round_trip(spark, edge_dir):
    pages = spark.read.parquet(f"{edge_dir}/pages.parquet")
    path = warc.write_archives(pages, shared_path(spark, "warc"), archive_bytes=4_000)
    rows = warc.read_archives(spark, path).collect()
    html = {p: (h or "").encode() for p, _, h, *_ in ROWS["pages"]() if p not in (3, 11, None)}
    by_id = {r.page_id: r for r in rows if r.page_id in html}
    for p, raw in html.items():
        r = by_id[p]
        whole = by_id[r.refers_to] if r.refers_to in by_id else r
        assert r.payload_bytes == len(raw)
        assert (r.payload if r.record_type == "response" else whole.payload or raw) == raw
    null_ids = [r for r in rows if r.page_id is None]
    assert sorted(r.record_type for r in null_ids) == ["response", "revisit"]
    small = warc.write_archives(pages, shared_path(spark, "warc"), least_bytes=2)
    assert all(r.record_type == "response" for r in warc.read_archives(spark, small).where("payload_bytes < 2").collect())


def test_archives_have_dictionaries_and_checks():
    rnd = np.random.default_rng(2)
    records = [warc.record(i, "http://x/", p := b"<html>shared words of all pages " * 20 + rnd.bytes(900), warc.base32_sha1(p), i) for i in range(400)]
    data = warc.archive(records)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert [raw for _, raw in warc.frames(data + warc.EMPTY_FRAME.encode("latin-1"))] == records
    head, block = warc.parse(records[0], 0)
    assert warc.payload_of(head, block, 0).startswith(b"<html>")
    for broken in (records[0][:-1], records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1), records[0].replace(b"WARC-Type", b"WARC-Typo"), records[0].replace(b"<html>", b"<htmk>"), b"HTTP/1.1 200"):
        with pytest.raises(ValueError):
            warc.payload_of(*warc.parse(broken, 0), 0)
    with pytest.raises(ValueError):
        list(warc.frames(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.frames(data + b"garbage!"))


def test_no_pages(spark, empty_dir):
    assert warc.op4_warc(spark, empty_dir).collect() == []


# -- 6 ------------------------------------------------------------------------
def brute_top(rows):
    v = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in v if i != q and len(b) == len(a))
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, edge_dir, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "TILE_BLOCKS", 1)
    got = [tuple(r) for r in topk.op6_topk(spark, edge_dir).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == brute_top(ROWS["embeddings"]())


def test_top_k_with_components_of_any_size(spark, monkeypatch):
    """Large components beside small ones, and scores that 64 bits do not hold."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    rnd = np.random.default_rng(7)
    v = rnd.uniform(-1, 1, (150, 5))
    v[3:60:7] *= 70_000
    v[100] = [1e9, -3e9, 2e9, 0, 1e9]
    v[117] = [4e15, 1e15, -9e15, 1, 0]
    v[118] = v[117] * 0.9
    v[0] *= 1e6
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    q = topk.quantised(df)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(q, q.where("vec_id in (0, 3, 100, 117, 149)")).collect()}
    x = [[int(np.floor(1024 * c)) for c in r] for r in v]
    for a in (0, 3, 100, 117, 149):
        exact = sorted((-sum(c * d for c, d in zip(x[a], x[b], strict=True)), b) for b in range(150) if b != a)
        for k, (s, b) in enumerate(exact[:10]):
            assert got[a, k + 1] == (b, max(-(1 << 63), min((1 << 63) - 1, -s)))
    assert got[117, 1] == (118, (1 << 63) - 1)


def test_top_k_of_no_vectors(spark, empty_dir):
    assert topk.op6_topk(spark, empty_dir).collect() == []


def test_slices_add_up():
    rnd = np.random.default_rng(3)
    q = rnd.integers(-700, 700, (130, 9))
    made, w = topk.SlicedBlock.sliced(np.arange(130), q), rnd.integers(-700, 700, 9)
    block = topk.SlicedBlock.loaded(made.ids, 9, made.stored())
    assert all((a == b).all() for x, y in zip(made.slices, block.slices, strict=True) for a, b in zip(x, y, strict=True))
    slices, offset = block.score_slices(w)
    total = sum(((s[np.arange(130) >> 6] >> (np.arange(130) & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p for p, s in enumerate(slices)) + offset
    assert (total == q @ w).all()


# -- pipeline -------------------------------------------------------------------
def test_pipeline_stages_take_effect(spark, edge_dir):
    import corpus_pipeline as cp
    from donorlift.llm import bpe, decontam, langid, ngram_join, toxicity
    from donorlift.llm.common import materialise

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    # brute force: every stage by its operator's rows, applied to plain lists
    def kept(df, ids):
        return sorted(repr(tuple(r)) for r in df.collect() if r.doc_id in ids)

    one = materialise(cp.language_id(spark, docs, edge_dir), "t")
    ok = {r.doc_id for r in langid.identify(docs, langid.fit_language_models(docs)).where("NOT rejected").collect()}
    assert one.columns == docs.columns
    assert sorted(repr(tuple(r)) for r in one.collect()) == sorted(repr(tuple(r)) for r in docs.collect() if r.doc_id in ok and any(ch.isalpha() for ch in r.text or ""))
    two = materialise(cp.toxicity(spark, one, edge_dir), "t")
    labels = spark.read.parquet(f"{edge_dir}/labels.parquet")
    clean = {r.doc_id for r in toxicity.score_toxicity(one, toxicity.fit_toxicity(one, labels)).where("predicted = 0").collect()}
    assert 0 < two.count() < one.count() and sorted(repr(tuple(r)) for r in two.collect()) == kept(one, clean)
    three = materialise(cp.near_duplicates(spark, two, edge_dir), "t")
    heads = {r.doc_id for r in ngram_join.jaccard_links(two).where("doc_id = component_id").collect()} | {None}
    assert {r.doc_id for r in three.collect()} == heads and three.select("doc_id").distinct().count() == three.count()
    four = materialise(cp.decontamination(spark, three, edge_dir), "t")
    bench = spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in decontam.contamination(three, bench).where("contaminated").collect()}
    changed = {r.doc_id for r in four.exceptAll(three).collect()}
    assert four.count() == three.count() and changed == dirty and dirty
    five = cp.token_ids(spark, four, edge_dir)
    want = sorted(repr(tuple(r)) for r in bpe.bpe_digests(four).collect())
    assert sorted(repr(tuple(r)) for r in five.collect()) == want
    assert sorted(repr(tuple(r)) for r in cp.run(spark, edge_dir).collect()) == want
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "token_ids"]


def test_pipeline_of_nothing(spark, empty_dir):
    import corpus_pipeline as cp

    assert cp.run(spark, empty_dir).collect() == []
