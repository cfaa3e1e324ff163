"""Words of plain texts are cut together, not one text after another."""

import random

from donorlift.llm.bpe import WordBPE, default_vocabulary

PIECES = ["'s", "'S", "'t", "'re", "'r", "'ve", "'ll", "'l", "'m", "'d", "''", "'", "a", "re", "É", "ß", "é", " ", "\t", "\r\n", "9", "42", "!", "..."]
ODD = ["÷", "\x7f", "\x1c", "\x0b", "Σ", "日", "İ", "K", " "]


def test_words_cut_together_equal_words_cut_by_the_pattern():
    bpe, rnd = WordBPE(default_vocabulary()), random.Random(9)
    pieces = PIECES + ODD + list(bpe.specials)
    texts = [None, "", " \n", "'", "'s", "it's 'round 'll"] + ["".join(rnd.choices(pieces[: rnd.choice([11, len(PIECES), len(pieces)])], k=rnd.randint(0, 25))) for _ in range(1500)]
    split = [bpe.words(t) if t else [] for t in texts]
    bpe.learn(w for ws in split for w in ws)
    expected = [b"".join(bpe.cache[w] for w in ws) for ws in split]
    bpe.cache.clear()
    assert [ids for i in range(0, len(texts), 50) for ids in bpe.encode_bytes(texts[i : i + 50])] == expected
    assert bpe.encode_bytes([]) == [] and bpe.encode_bytes([None, ""]) == [b"", b""]


def test_plain_texts_are_not_split_one_by_one(monkeypatch):
    bpe = WordBPE(default_vocabulary())
    expected = bpe.encode_bytes(["it's", "été 12", "日"])

    def fail(text):
        raise AssertionError(f"split alone: {text}")

    monkeypatch.setattr(bpe, "split_latin", fail)
    assert bpe.encode_bytes(["it's", "été 12", "日"]) == expected
