"""Mixing, whitening and conversation repair: SQL, brute force, awkward tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlift.llm import mixing, turns, whitening

from edge_tables import same_as_sql


# -- 11 -----------------------------------------------------------------------
def test_mix_equals_sql(spark, edge_dir, empty_dir, duck):
    same_as_sql(duck, mixing.op11_mixing(spark, edge_dir), mixing.SQL)
    assert mixing.op11_mixing(spark, empty_dir).collect() == []


def test_word_count_is_that_of_the_pattern(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc\x0cd\r\ne ", "ww w", "ü ü \x1f x", "w" * 100_000, "w " * 100_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words_in(F.col("t"))).collect()
    want = [sum(1 for _ in __import__("re").finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [r[0] for r in got] == want


def brute_targets(sizes, total, weights=mixing.WEIGHTS, cap=mixing.CAP):
    """Share by weight, stop at the caps, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: cap * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and t[s] > cap * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot source, one of few words that its weight fills, one of none."""
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), "hot") for i in range(9_000)]
    rows += [(10_000 + i, "one two three", "a") for i in range(30)] + [(20_000 + i, " ", "b") for i in range(5)]
    rows += [(30_000 + i, "x " * rnd.randint(1, 9), None) for i in range(900)] + [(40_000 + i, "y", f"s{i % 40}") for i in range(400)]
    return spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, source string, h int, size int").repartition(7)


@pytest.mark.parametrize("fine, level, broadcast", [(4_096, 12, 100_000), (1, 4, 0), (5, 20, 100_000)])
def test_targets_and_bounds_do_not_change_the_mix(spark, skewed, monkeypatch, fine, level, broadcast):
    monkeypatch.setattr(mixing, "FINE_ROWS", fine)
    monkeypatch.setattr(mixing, "LEVEL", level)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    narrow = mixing.sized(skewed)
    per_source = mixing.thresholds(narrow, (0.2, 0.5, 1.0, 2.5))
    met = mixing.with_source(narrow, per_source).select("doc_id", "source", "size", "source_size", "mix", "h").collect()
    sizes = {s: sum(r["size"] for r in met if r.source == s) for s in {r.source for r in met}}
    total = sum(sizes.values())
    before = None
    for k, share in enumerate((0.2, 0.5, 1.0, 2.5)):
        want = brute_targets(sizes, round(share * total))
        taken = {r.doc_id: r.mix[k].repeats + (r.h <= r.mix[k].limit) for r in met}
        for s, t in want.items():
            rows = [r for r in met if r.source == s]
            assert rows[0].source_size == sizes[s] and abs(rows[0].mix[k].target - t) <= 1e-9 * max(1, t)
            assert abs(sum(r["size"] * taken[r.doc_id] for r in rows) - t) <= max((r["size"] for r in rows), default=0) / 2 + 1e-6
            assert all(taken[r.doc_id] <= 3 or r["size"] == 0 for r in rows)
        assert before is None or all(taken[i] >= n for i, n in before.items())  # nested
        before = taken
    docs = mixing.mixed(skewed)
    assert docs.columns == skewed.columns
    got = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert got == {r.doc_id: n for r in met if (n := r.mix[2].repeats + (r.h <= r.mix[2].limit))}


def test_mix_plan_is_native_and_unsorted(spark, edge_dir):
    plan = mixing.op11_mixing(spark, edge_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Sort [" not in plan


# -- 12 -----------------------------------------------------------------------
def brute_white(vectors, k=32):
    x = np.array([[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(0)
    diff = x * n - total
    c = (diff / n).astype(float)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > whitening.LEAST * max(e[0], 0)).sum()))
    return n, (diff * diff).sum(1), c @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), k


def holds(rows, vectors, k=32):
    """``rows`` of whitening, in any order, are those of ``vectors``: {id: vector}."""
    ids = list(vectors)
    n, dev, white, explained, k = brute_white(vectors.values(), k)
    assert len(rows) == n * k
    got = np.zeros((n, k))
    for r in rows:
        i = ids.index(r.vec_id)
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == (dev[i] if dev[i] < 1 << 63 else None)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-6
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-7


@pytest.mark.parametrize("numbers, matrix", [(1 << 17, 50_000), (1_000, 3)])
def test_whitening_equals_numpy(spark, monkeypatch, numbers, matrix):
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(whitening, "MATRIX_BLOCKS", matrix)
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), "n", 1) for i, r in enumerate(v)], "vec_id long, embedding array<float>, n string, component int").repartition(5)
    holds(whitening.whiten(whitening.integers(df)).collect(), {i: r for i, r in enumerate(v)})


def test_whitening_of_awkward_vectors(spark, edge_dir, empty_dir):
    rows = whitening.op12_whitening(spark, edge_dir).collect()
    src = spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()
    fit = [r for r in src if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    six = [r for r in fit if len(r.embedding) == 6]
    assert len(rows) == 6 * len(six) + len([r for r in fit if len(r.embedding) == 2])  # two points: one component
    assert {r.n for r in rows} == {len(six), 2} and sum(r.vec_id is None for r in rows) == 6 and sum(r.vec_id == 7 for r in rows) == 12
    n, dev, white, *_ = brute_white([r.embedding for r in six])
    got = sorted((abs(r.whitened), r.deviation) for r in rows if r.n == n and r.component == 1)
    assert np.allclose([g[0] for g in got], sorted(np.abs(white[:, 0])), atol=1e-9)
    assert sorted(g[1] for g in got) == sorted(dev)
    assert whitening.op12_whitening(spark, empty_dir).collect() == []


def test_whitening_of_large_and_constant_components(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(50, 4)) * [1, 1e4, 30, 0] + [0, 0, 1e12, 3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(50, [1.0, 1e300, 0.0, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(whitening.integers(df)).collect()
    assert len(rows) % 51 == 0 and len(rows) >= 51 and any(r.deviation is None for r in rows)
    holds(whitening.whiten(whitening.integers(df.where("vec_id < 50"))).collect(), {i: r for i, r in enumerate(v)})
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(whitening.integers(one)).collect() == []


# -- 13 -----------------------------------------------------------------------
def brute_align(code):
    """All edit sequences, kept by grammar state: (cost, audit) of the least."""
    after = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserts(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                for symbol, new in after[q].items():
                    if symbol != "s":
                        best[new] = min(best.get(new, (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = {"0": (0, "")}
    for c in code:
        new = {}
        for q, (cost, audit) in inserts(best).items():
            ways = [(q, 3, "D")]
            if c != "x":
                late = int(c.isupper())
                for symbol, to in after[q].items():
                    if symbol == c.lower():
                        ways.append((to, late, "K"))
                    if symbol != "s":
                        ways.append((to, 2 + late, "R"))
            for to, paid, did in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost + paid, audit + did))
        best = new
    best = inserts(best)
    return min(best[q] for q in "0a" if q in best)


def test_alignment_equals_brute_force():
    for n in range(5):
        for code in map("".join, itertools.product("suaoxUA", repeat=n)):
            assert turns.align(code) == turns.align(code, 2) == brute_align(code), code
    rnd = random.Random(1)
    for _ in range(400):
        code = "".join(rnd.choice("sua" + "oxSUAO" * (rnd.random() < 0.5) + "ua" * 3) for _ in range(rnd.randint(5, 60)))
        assert turns.align(code) == turns.align(code, 7) == turns.align(code, 10**9) == brute_align(code), code
    long = "".join(rnd.choice("uauauauauasoxUA") for _ in range(5_000))
    assert turns.align(long) == brute_align(long)


def test_repair_equals_sql(spark, edge_dir, empty_dir, duck):
    same_as_sql(duck, turns.op13_turns(spark, edge_dir), turns.SQL)
    assert turns.op13_turns(spark, empty_dir).collect() == []


def test_repaired_rows_follow_the_audit(spark, edge_dir):
    rows = spark.read.parquet(f"{edge_dir}/conversations.parquet")
    audit = {r.conv_id: r for r in turns.audits(rows).collect()}
    made = {}
    for r in turns.repaired(rows).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(r)
    assert set(audit) == {r.conv_id for r in rows.select("conv_id").distinct().collect()}
    for c, a in audit.items():
        out = made.get(c, [])
        assert [r.place for r in out] == list(range(len(out))) and "".join(r.edit for r in out) == a.audit.replace("D", "")
        assert __import__("re").fullmatch("(s?(ua)+)?", "".join((r.role or " ")[:1] for r in out))
        joined = "\n".join(f"{r.role}:{r.text}" for r in out)
        assert __import__("hashlib").sha256(joined.encode()).hexdigest() == a.repaired_sha256
        assert all(r.text == "" and r.turn is None for r in out if r.edit == "I")


def test_long_conversation_in_time(spark):
    """One conversation holds nearly all rows."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(9)) == 0, "user").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id"), F.lit(".")).alias("text"))
    got = {r.conv_id: r for r in turns.audits(rows).collect()}
    assert len(got) == 1 + n // 50
    codes = [r.role[0] for r in rows.where("conv_id = -1").orderBy("turn").collect()]
    assert (got[-1].cost, got[-1].audit) == brute_align("".join(codes))
