"""Sizes and bounds that must not change results."""

import numpy as np

from donorlift.llm import decontam, langid, toxicity


# -- 1 ------------------------------------------------------------------------
def test_cuts_do_not_depend_on_groups_of_items(spark):
    """Items that overlap in a document, and words that a cut would make neighbours."""
    words = [f"w{k}" for k in range(38)]
    items = [(k, " ".join(words[2 * k : 2 * k + 12])) for k in range(14)]
    items += [(100 + k, " ".join([f"l{k}"] * 5 + [f"r{k}"] * 5)) for k in range(8)]
    texts = ["a " + " ".join(words) + " z", " ".join(words[3:20]), "nothing here", None, ""]
    texts += [" ".join(["x"] + [f"l{k}"] * 5 + words[:12] + [f"r{k}"] * 5 + ["y"]) for k in range(8)]
    rows = [(i, t, None if t is None else len(t), i * 2) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.benchmark_groups(bench, 100)) > 2
    one, many = (decontam.decontaminate(docs, bench, phrase_words=n) for n in (1_000_000, 100))
    assert many.columns == docs.columns
    got = sorted(map(repr, many.collect()))
    assert got == sorted(map(repr, one.collect()))
    assert one.where("doc_id = 0").first().text == "a  z"


# -- 10 -----------------------------------------------------------------------
def test_rare_language_keeps_its_model(spark):
    """A language of few texts beside one of more distinct 4-grams than a million."""
    rnd = np.random.default_rng(3)
    hot = [(i, " ".join("".join(w) for w in rnd.choice(list("abcdefghijklmnopqrstuvwxyzäöüßéèàç"), (6_000, 9))), "hot") for i in range(90)]
    rare = [(1_000 + i, f"ζωγράφος δένδρον ποταμός {'αβγδε'[i % 5]}λλο", "rare") for i in range(12)]
    m = langid.fit_language_models(spark.createDataFrame(hot + rare, "doc_id long, text string, lang string").repartition(8))
    assert m.langs == ["hot", "rare"] and m.grams.where("model = 2 AND lang = 'hot'").count() > 1_000_000
    assert predicted(m, ["ο ποταμός"]) == ["rare"]


def predicted(m, texts):
    sums = lens = letters = 0
    for at in range(len(m.parts[langid.FULL])):
        more, lens, letters = m.load(langid.FULL, at).sums(texts)
        sums = sums + more
    return m.predict(sums, lens, letters)[0]


def test_limits_are_quantiles_of_all_held_out_texts(spark):
    """All training texts count, whole, each scored without its half; one odd
    label among thousands does not move a limit."""
    rows = [(i, f"the river {'runs rolls flows'.split()[i % 3]} by the old mill {i * 7919 % 613:03d} {'abcdefgh'[i % 8]}", "en") for i in range(4_500)]
    odd = [(i, " ".join(f"qx{a}{b}zv" for a in "bcdfghjklmnp" for b in "rstvwxz") * 60, "en") for i in (9_000, 9_002)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + odd, schema).repartition(8)
    m = langid.fit_language_models(docs)
    train = docs.where(langid.train_fold()).select("text", langid.text_fold().alias("fold")).collect()
    own = np.zeros(len(train))
    for f in (0, 1):
        at = [i for i, r in enumerate(train) if r.fold == f]
        keys, _ = langid.keys_of(*m.alphabet.symbols([r.text for r in train if r.fold != f]))
        k, c = np.unique(keys, return_counts=True)
        sums, lens, _ = langid.fit({"en": (k, c)}, m.alphabet).sums([train[i].text for i in at])
        own[at] = m.entropies(sums, lens)[:, 0]
    bins = np.sort(np.ceil(own * langid.BINS))
    want = bins[int(np.ceil(langid.LIMIT_QUANTILE * len(bins))) - 1] / langid.BINS + langid.REJECT_MARGIN
    assert len(train) > 2_000 and max(len(r.text) for r in train) > 20_000
    assert np.allclose(m.limits, want) and want < own.max() + langid.REJECT_MARGIN


# -- 7 ------------------------------------------------------------------------
def test_toxicity_learns_from_long_texts(spark):
    """All confirmed toxic texts are long; one id is repeated."""
    rnd = np.random.default_rng(8)
    words = [f"word{k}" for k in range(30)]
    rows = []
    for i in range(300):
        w = rnd.choice(words, 2_500 if i % 5 == 0 else 300).tolist()
        if i % 5 == 0:
            w[int(rnd.integers(0, len(w)))] = "grobbelsnarf"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows + rows[:1] * 40, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert min(len(t) for i, t in rows if i % 5 == 0) > 8_000
    model = toxicity.fit_toxicity(docs, known)
    held = [r for r in toxicity.score_toxicity(docs, model).collect() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    taken = toxicity.sample_texts(docs, docs.select("doc_id"), 1_000, 0)
    assert taken.count() == taken.select("doc_id").distinct().count() == 300


# -- 1, 2 ---------------------------------------------------------------------
def test_words_that_a_polynomial_hash_takes_as_equal(spark):
    """The Thue-Morse word and its complement agree in every sum of byte terms
    times powers modulo 2^64."""
    from donorlift.llm import ngram_join

    def thue(n, first):
        return "".join("ab"[(k.bit_count() + first) & 1] for k in range(n))

    texts = [thue(n, f) for n in (16, 32, 64, 1024, 4096) for f in (0, 1)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    joined = ngram_join.jaccard_links(docs)
    assert {r.doc_id: r.component_id for r in joined.collect()} == {i: i for i in range(len(texts))}
    bench = docs.select((docs.doc_id + 100).alias("item_id"), "text").where("doc_id % 2 = 1")
    found = decontam.contamination(docs, bench).collect()
    assert {r.doc_id: r.n_hit for r in found} == {i: i % 2 for i in range(len(texts))}


# -- 8 ------------------------------------------------------------------------
def test_long_words_equal_the_library_in_time():
    import random
    import time

    from tokenizers import Tokenizer

    from donorlift.llm import bpe

    own, mine = Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordBPE(bpe.default_vocabulary())
    own.no_truncation()
    rnd = random.Random(4)
    words = ["a" * 5_000, "ab" * 3_001 + "b", "the" * 1_000, "\u00e9t\u00e9" * 500, "=" * 3_000, "x" * 41]
    words += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(30, 3_000))) for _ in range(60)]
    words.append("".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(1_000_000)))
    t = time.time()
    got = [e.tolist() for e in mine.encode(words)]
    assert time.time() - t < 30
    assert got == [own.encode(w, add_special_tokens=False).ids for w in words]
