"""Operators over documents against SQL, libraries and brute force, on rows
that hold nulls, empty and very long texts, ties, repeats and extra columns."""

import hashlib
import re

import math

import numpy as np
import pyarrow as pa
import pytest

from donorlift.llm import bpe, decontam, langid, licences, ngram_join, packing, toxicity
from donorlift.llm.common import table

from edge_tables import ROWS, same_as_sql, upper_free


def doc_frame(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


# -- 1 ------------------------------------------------------------------------
def test_contamination_equals_sql(spark, edge_dir, duck):
    same_as_sql(duck, decontam.op1_decontaminate(spark, edge_dir), decontam.SQL)


def test_contamination_in_groups_of_items(spark, edge_dir, duck):
    docs, bench = doc_frame(spark, edge_dir), spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    assert len(decontam.benchmark_groups(bench, 20)) > 2
    same_as_sql(duck, decontam.contamination(docs, bench, phrase_words=20), decontam.SQL)


def test_hit_spans_are_cut(spark, edge_dir):
    docs, bench = doc_frame(spark, edge_dir), spark.read.parquet(f"{edge_dir}/benchmark.parquet").where("item_id IN (1, 3, 4, 10)")
    got = decontam.decontaminate(docs, bench)
    assert got.columns == docs.columns and got.count() == docs.count()
    before = sorted(map(repr, (tuple(r) for r in docs.collect())))
    after = sorted(map(repr, (tuple(r) for r in got.collect())))
    hit = {r.doc_id for r in decontam.contamination(docs, bench).where("contaminated").collect()}
    assert len(hit) == 7
    assert sorted(map(repr, (tuple(r) for r in docs.collect() if r.doc_id not in hit))) == [r for r in after if r in set(before)]
    assert decontam.contamination(got, bench).where("contaminated").count() == 0
    for r in got.collect():
        assert r.n_chars is None or r.n_chars == len(r.text or "")


def test_fm_index_equals_search():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        text = np.append(rnd.integers(0, 4, rnd.integers(1, 80)), 4)
        index = decontam.FMIndex(text, 3)
        for size in (1, 2, 5):
            patterns = rnd.integers(0, 4, (6, size))
            for p, lo, hi in zip(patterns.tolist(), *index.search(patterns), strict=True):
                want = [i for i in range(len(text)) if text[i : i + size].tolist() == p]
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


# -- 2 ------------------------------------------------------------------------
def brute_links(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", upper_free(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links = [[j for j in range(n) if j != i and rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen), default=None) if rows[i][0] is not None else None, len(links[i])))
    return sorted(map(repr, out))


def test_links_equal_brute_force(spark, edge_dir):
    docs = doc_frame(spark, edge_dir)
    got = ngram_join.op2_ngram_join(spark, edge_dir).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == brute_links([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = []
    for i in range(150):
        w = [f"t{k}" for k in range(60)]
        for k in rnd.integers(0, 60, 3):
            w[k] = f"u{rnd.integers(0, 40)}"
        rows.append((i, " ".join(w[: 60 - i % 9])))
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", (10, 20))
    got = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()))) == brute_links(rows)


def test_oversized_candidate_groups_lose_no_link(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = [(i, " ".join([f"t{k}" for k in range(40)] + [f"u{rnd.integers(0, 500)}" for _ in range(i % 3)])) for i in range(60)]
    monkeypatch.setattr(ngram_join, "SPLIT_MEMBERS", 5)
    got = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()))) == brute_links(rows)


def test_one_of_each_group_stays(spark, edge_dir):
    docs = doc_frame(spark, edge_dir)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    heads = {eval(r)[0] for r in brute_links([(r.doc_id, r.text) for r in docs.collect()]) if eval(r)[0] == eval(r)[2]}
    kept = [r.doc_id for r in got.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(h for h in heads if h is not None)
    assert kept.count(None) == 2


def test_hot_shingles_give_the_same_groups(spark):
    """Recurring shingles are counted in salted parts, with repeated rows."""
    rows = [(t, c) for t in range(6) for c in range(3 + 40 * (t % 2))] + [(7, 1), (7, 1), (8, 5)]
    found = []
    for hot in (True, False):
        prefixes = spark.createDataFrame([(t, c, hot) for t, c in rows + rows[:50]], "token long, c long, hot boolean").repartition(5)
        found.append(sorted((r.k, r.c, r.g) for r in ngram_join.candidate_groups(prefixes).collect()))
    assert found[0] == found[1] and len(found[0]) == 3 + 43  # tokens with the same classes are one group; lone ones are none


def test_large_groups_are_cut_by_size(spark, monkeypatch):
    """A group of unlike sizes is compared in cells of neighbouring sizes, and
    classes whose sizes allow no link are not brought together."""
    monkeypatch.setattr(ngram_join, "SPLIT_MEMBERS", 8)
    sizes = [10] * 3 + [13] * 2 + [1000] * 4 + [30_000] * 12
    classes = spark.createDataFrame([(c, n, bytes(32)) for c, n in enumerate(sizes)], "c long, n long, sketch binary")
    groups = spark.createDataFrame([(1, len(sizes), c) for c in range(len(sizes))], "g long, k long, c long")
    edges = [(r.a, r.b) for r in ngram_join.possible_links(groups, classes).collect() if r.a != r.b]
    comp = list(range(len(sizes)))
    for _ in sizes:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert comp == [0] * 5 + [5] * 4 + [9] * 12


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    rows = [(1, "a b c d e f", f"s{k}", k) for k in range(6)] + [(2, "a b c d e f", None, None)]
    kept = [ngram_join.one_of_each(spark.createDataFrame(some, "doc_id long, text string, source string, extra int").repartition(3)).collect() for some in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


# -- 5 ------------------------------------------------------------------------
def test_licences_equal_sql(spark, edge_dir, duck):
    same_as_sql(duck, licences.op5_licences(spark, edge_dir), licences.SQL)


def test_licence_spellings_and_copyright_lines(spark):
    mit = licences.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace("COPYRIGHT HOLDERS", "Copyright Owners"), mit + " more", None, "", "Licenced under the Apache Licence -- version 2.0", "x\n(c) 1999 me\n * Licensed under CC BY-NC 4.0"]
    rows = {r.doc_id: (r.license_id, r.notices) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0][0] == rows[1][0] == "MIT" and rows[2][0] is None and rows[3] == rows[4] == (None, "")
    assert rows[5] == ("Apache-2.0", "Apache-2.0")
    assert rows[6] == (None, "CC-BY-NC-4.0")
    assert licences.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {}).first().license_id is None


# -- 7 ------------------------------------------------------------------------
def test_toxicity_holds_out_and_finds_insults(spark, edge_dir):
    rows = toxicity.op7_toxicity(spark, edge_dir).collect()
    docs = [r[:2] for r in ROWS["documents"]()]
    assert len(rows) == len(docs)
    text = {i: t for i, t in docs if i is not None}
    from zlib import crc32

    from edge_tables import INSULTS

    for r in rows:
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    hit = [r for r in held if any(i in (text[r.doc_id] or "") for i in INSULTS)]
    assert sum(r.predicted for r in hit) >= 0.7 * len(hit)
    assert sum(r.predicted for r in held) - sum(r.predicted for r in hit) <= 0.1 * len(held)
    empty = {r.score for r in rows if not (text.get(r.doc_id, "x") or "").strip()}
    assert len(empty) == 1


def test_toxicity_accuracy_on_unseen_texts(spark):
    """Several insults with many endings, in texts of 20 to 4,000 words."""
    rnd = np.random.default_rng(6)
    stems, words = ["grobbel", "snarfi", "klotzu"], [f"word{k}" for k in range(400)]
    rows, toxic = [], []
    for i in range(900):
        w = rnd.choice(words, 4_000 if i % 50 == 0 else 20 + i % 150).tolist()
        if i % 6 == 0:
            for _ in range(3):
                w[int(rnd.integers(0, len(w)))] = stems[i // 6 % 3] + "".join(rnd.choice(list("abcdefgh"), 2))
            toxic.append(i)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i in set(toxic))) for i in range(0, 900, 1) if i % 7], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known)).collect() if r.held_out}
    hit = sum(got[i].predicted for i in got if i in set(toxic))
    wrong = sum(got[i].predicted for i in got if i not in set(toxic))
    assert hit >= 0.9 * sum(i in set(toxic) for i in got) and wrong <= 0.02 * len(got)


def test_toxicity_without_examples(spark, edge_dir):
    docs = doc_frame(spark, edge_dir)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.keeps_clean(docs, model).exceptAll(docs).isEmpty()


def test_windows_cover_texts():
    begin, end, ahead = toxicity.windows(np.array([0, 0, 5, 100]), 40)
    assert begin.tolist() == [0, 0, 5, 25, 45, 65] and end.tolist() == [0, 5, 45, 65, 85, 100] and ahead.tolist() == [0, 1, 2, 6]


def test_a_passage_scores_alike_at_every_position():
    """Half a window of words that are weak alone, among words without weight."""
    passage = " ".join(f"weak{chr(97 + k)}{chr(97 + k)}" for k in range(toxicity.WINDOW // 2))
    plain = toxicity.Toxicity(np.zeros(toxicity.DIMENSIONS, np.float32), -6.0, 0.1)
    buf = np.frombuffer(passage.encode(), np.uint8)
    feats, _ = toxicity.word_features(buf, *toxicity.word_bounds(buf, np.array([0, len(buf)]), toxicity.KEEP)[:2])
    plain.weights[np.unique(feats)] = 0.05
    texts = ["zu " * k + passage + " zu" * (90 - k) for k in range(91)]
    scores = plain.scores(pa.array(texts))
    alone = plain.scores(pa.array([passage, "zu " * 50]))
    assert np.allclose(scores, alone[0], atol=1e-6) and alone[0] > 5 * alone[1]


# -- 8 ------------------------------------------------------------------------
def test_bpe_equals_library(spark, edge_dir):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, text, *_ in ROWS["documents"]():
        ids = own.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op8_bpe(spark, edge_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("texts", [
    ["", " ", "aaaa" * 300, "tion" * 9, "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "İΑΣ ΣΑΣ ½ Ⅷ", "don't we'll 'S'RE", "é" * 41, "e\u0301 x\u00a0y\u2003z", "🙂🙂 a🙂", "!" * 90, "a_b-c__d"],
    ["".join(np.random.default_rng(k).choice(list("abehinot'TS é1!ñ \n"), 60)) for k in range(300)],
])
def test_bpe_odd_texts_equal_library(texts):
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordBPE(bpe.default_vocabulary())
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        want = own.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert mine.decode(ids) == own.decode(want, skip_special_tokens=False)


def test_merges_follow_their_parts():
    """A merge ranks behind the merges that make its parts, so that all
    boundaries of one rank may go in a scan."""
    m = bpe.WordBPE(bpe.default_vocabulary())
    born = {int(t): r for r, t in enumerate(m.rank_made)}
    order = np.argsort(m.ranks)
    for rank, key in enumerate(m.keys[order].tolist()):
        assert all(born.get(part, -1) < rank for part in divmod(key, m.width))


# -- 9 ------------------------------------------------------------------------
def test_packing_is_lossless(spark, edge_dir):
    packed = {repr((r.doc_id, r.n_tokens, r.ids_sha256)) for r in packing.op9_packing(spark, edge_dir).collect()}
    assert packed == {repr((r.doc_id, r.n_tokens, r.ids_sha256)) for r in bpe.op8_bpe(spark, edge_dir).collect()}
    assert packing.op9_packing(spark, edge_dir).count() == len(ROWS["documents"]())


def test_best_fit_decreasing_equals_scan():
    rnd = np.random.default_rng(5)
    for _ in range(100):
        most = int(rnd.integers(1, 40))
        lengths = rnd.integers(1, most + 1, rnd.integers(0, 60)).tolist()
        rows, room = packing.best_fit(lengths, most), []
        for n in sorted(lengths, reverse=True):
            fits = [c for c in room if c >= n]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else most) - n)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert sorted(most - sum(lengths[k] for k in r) for r in rows) == sorted(room)


def test_shard_layout():
    tokens = [np.arange(5, dtype="<u2"), np.zeros(0, "<u2"), np.arange(10, 13, dtype="<u2")]
    b = packing.pack([7, 8, 9], tokens, 4, 99, "<u2")
    shard = {c: b.column(k)[0].as_py() for k, c in enumerate(b.schema.names)}
    assert np.frombuffer(shard["ids"], "<u2").tolist() == [0, 1, 2, 3, 10, 11, 12, 4]
    assert np.frombuffer(shard["cu_lengths"], "<i4").tolist() == [0, 4, 0, 3, 4]
    assert np.frombuffer(shard["resets"], "<i8").tolist() == [0, 4, 7]
    assert [(i, t.tolist(), n) for i, t, n in packing.unpack(shard)] == [(7, [0, 1, 2, 3, 4], 2), (8, [], 0), (9, [10, 11, 12], 1)]
    shard["segment_start"] = np.array([0, 0, 3], "<i8").tobytes()
    with pytest.raises(ValueError):
        list(packing.unpack(shard))


# -- 10 -----------------------------------------------------------------------
def test_language_id(spark, edge_dir):
    rows = langid.op10_langid(spark, edge_dir).collect()
    docs = {r[0]: r for r in ROWS["documents"]()}
    assert len(rows) == len(ROWS["documents"]())
    for r in (r for r in rows if r.doc_id is not None):
        text = docs[r.doc_id][1]
        if not any(ch.isalpha() for ch in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de") and 0 < r.score <= 1
    known = [r for r in rows if r.doc_id is not None and 20 < r.doc_id < 85 and docs[r.doc_id][2]]
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in known) >= 0.95 * len(known)


def test_language_probabilities_sum_to_one():
    alphabet = langid.Alphabet(langid.symbol_table(), langid.astral_letters())
    counts = {}
    for lang, text in (("x", "abab abba baab abc"), ("y", "zyzy yzzz abzy")):
        key, _ = langid.keys_of(*alphabet.symbols([text] * 3))
        counts[lang] = tuple(a.astype(t) for a, t in zip(np.unique(key, return_counts=True), (np.uint64, float), strict=True))
    m = langid.fit(counts, alphabet)
    symbols = {int(s) for _, _, t in m.tables for s in t.keys[0]} | {0x7777}  # one that no text has
    for context in (0x0020_0020_0020, 0x0020_0061_0062, 0x007A_0079_007A, 0x0070_0070_0070):
        keys = np.array([(context << 16) | s for s in symbols], np.uint64)
        assert np.allclose(np.exp(m.log_probs(keys) / langid.SCALE).sum(0), 1, atol=1e-4)


def brute_kneser_ney(counts, vocab):
    """log p of a 4-gram, by the textbook's recursion over dictionaries."""
    mask = [(1 << 16 * o) - 1 for o in range(5)]
    orders = {4: dict(counts)}
    for o in (3, 2, 1):
        orders[o] = {}
        for k in orders[o + 1]:
            orders[o][k & mask[o]] = orders[o].get(k & mask[o], 0) + 1
    d = {}
    for o, of in orders.items():
        n1, n2 = (sum(c == x for c in of.values()) for x in (1, 2))
        d[o] = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

    def p(key, o):
        if o == 0:
            return 1 / vocab
        rest = {k: c for k, c in orders[o].items() if k >> 16 == (key & mask[o]) >> 16}
        total = sum(rest.values())
        if not total:
            return p(key, o - 1)
        return max(rest.get(key & mask[o], 0) - d[o], 0) / total + d[o] * len(rest) / total * p(key, o - 1)

    return lambda key: math.log(p(key, 4))


def test_language_models_equal_brute_force(spark):
    """Counts, lower orders, discounts and back-off, of all texts and of the
    texts outside each fold, in one part and in many."""
    rnd = np.random.default_rng(4)
    words = {"x": ["abba", "cab", "bad", "dab", "a"], "y": ["zyx", "abz", "yy", "xyz"], "z": ["éa", "ça"]}
    rows = [(i, " ".join(rnd.choice(words[lang], 3)), lang) for i, lang in enumerate(rnd.choice(["x", "y", "z"], 60, p=[0.5, 0.4, 0.1]).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where(langid.train_fold()).select("text", "lang", langid.text_fold().alias("fold")).collect()
    alphabet = langid.Alphabet(langid.symbol_table(), langid.astral_letters())
    probe, _ = langid.keys_of(*alphabet.symbols([r[1] for r in rows] + ["abzzé 漢字 qa"]))
    probe = np.unique(probe)
    one, many = (langid.fit_language_models(docs, n) for n in (1_000_000, 12))
    assert len(one.parts[langid.FULL]) == 1 and len(many.parts[langid.FULL]) > 4
    assert one.limits.tolist() == many.limits.tolist() and one.sharpness == many.sharpness
    for model in (0, 1, langid.FULL):
        counts = {lang: {} for lang in one.langs}
        for r in train:
            if r.fold != model:
                for k in langid.keys_of(*alphabet.symbols([r.text]))[0].tolist():
                    counts[r.lang][k] = counts[r.lang].get(k, 0) + 1
        vocab = len({k & 0xFFFF for c in counts.values() for k in c}) + 1
        want = np.array([[f(int(k)) for f in (brute_kneser_ney(counts[lang], vocab) for lang in one.langs)] for k in probe])
        whole = one.load(model, 0).log_probs(probe)
        assert np.allclose(whole / langid.SCALE, want, atol=1e-5)
        assert (sum(many.load(model, at).log_probs(probe) for at in range(len(many.parts[model]))) == whole).all()


def test_many_parts_give_the_same_rows(spark, edge_dir):
    docs = doc_frame(spark, edge_dir)
    learned = table(spark, edge_dir, "documents", "doc_id", "text", "lang")
    one, many = (langid.fit_language_models(learned, n) for n in (10_000_000, 300))
    assert len(many.parts[langid.FULL]) > 1 and len(one.parts[langid.FULL]) == 1
    assert sorted(map(repr, langid.identify(docs, many).collect())) == sorted(map(repr, langid.identify(docs, one).collect()))
    kept = langid.keeps_language(docs, many)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, langid.keeps_language(docs, one).collect()))


def test_ngrams_do_not_cross_texts():
    alphabet = langid.Alphabet(langid.symbol_table(), langid.astral_letters())
    key, ends = langid.keys_of(*alphabet.symbols(["Ab 1c", "", "..", "𐐷"]))
    assert np.diff(ends).tolist() == [4, 0, 0, 1]
    assert [int(k) & 0xFFFF for k in key] == [97, 98, 32, 99, 0xFFFF]


# -- empty tables ---------------------------------------------------------------
@pytest.mark.parametrize("query", [decontam.op1_decontaminate, ngram_join.op2_ngram_join, licences.op5_licences, toxicity.op7_toxicity, bpe.op8_bpe, packing.op9_packing, langid.op10_langid])
def test_empty_tables(spark, empty_dir, query):
    assert query(spark, empty_dir).collect() == []
    assert table(spark, empty_dir, "documents", "doc_id").count() == 0


def test_documents_without_benchmark(spark, edge_dir, empty_dir):
    none = spark.read.parquet(f"{empty_dir}/benchmark.parquet")
    got = decontam.contamination(doc_frame(spark, edge_dir), none).collect()
    assert len(got) == len(ROWS["documents"]()) and not any(r.contaminated or r.n_items for r in got)
