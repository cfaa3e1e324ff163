"""Small tables that hold every awkward case."""

import random
import re

WORDS = {
    "en": "the of and that with from this house river stone market winter letter garden window bridge morning paper silver forest".split(),
    "de": "der die und das mit von haus fluss stein markt winter brief garten fenster brücke morgen papier silber wald straße".split(),
}
INSULTS = ["idiotus"]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score string, token int, c int, digest string, held_out string, n_words string, component_id string",
    "benchmark": "item_id long, text string, doc_id string",
    "labels": "doc_id long, quality int, toxic int, text string",
    "pages": "page_id long, url string, html string, host string, payload string, rule int",
    "conversations": "conv_id long, turn long, role string, text string, step string, kind int, audit string",
    "embeddings": "vec_id long, embedding array<float>, label int, score string, rank string",
}


def upper_free(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "", "s", "en", "ly"]) for _ in range(n))


def documents():
    rnd = random.Random(11)
    texts = [(None, None), (None, "en"), ("", "en"), (" \t\n", None), ("!!! 123 ...", "de"), ("Ünïcode", None), ("one two three", "en"), ("One two  THREE", "en")]
    base = sentence(rnd, "en", 80)
    for k in range(12):  # near copies: a few words changed, and exact ones
        w = base.split()
        w[(7 * k) % 80] = f"w{k}"
        texts += [(" ".join(w), "en")] * (1 + k % 2)
    passage = sentence(random.Random(5), "en", 25)
    for k in range(60):
        lang = "en" if k % 2 else "de"
        t = sentence(rnd, lang, rnd.randint(30, 90))
        if k % 9 == 0:
            t = f"{t}\n{passage.upper()}! {sentence(rnd, lang, 20)}"
        if k % 3 == 0:
            t = t.replace(" ", f" {INSULTS[0]} ", 3)
        texts.append((t, lang if k % 7 else None))
    texts += [("a" * 120_000, "en"), (sentence(rnd, "de", 12_000), "de"), ("x y " * 3_000, "en")]
    texts += [("Released under the MIT License.", "en"), ("first line\n  RELEASED under the M.I.T. licence\nreleased UNDER the MIT licence\nCopyright (c) 2020 A. N. Other", "en")]
    rows = [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [rows[20], rows[20], rows[30], (None, base, "en", None, None), (None, None, None, None, None)]
    return [(*r, "x", 7, 8, "d", None, "many", "none") for r in rows]


def labels():
    docs = documents()
    out = [(r[0], 1, int(any(i in (r[1] or "") for i in INSULTS)), "x") for r in docs if r[0] is not None and r[0] % 4]
    return [*out, *out[:3], (None, None, 1, None), (1, 0, None, None), (99_999, 1, 1, None)]


def benchmark():
    passage = sentence(random.Random(5), "en", 25)
    return [(1, passage, "x"), (2, "three two one", "x"), (3, None, "x"), (4, "", "x"), (10, passage, None), (10, passage, None), (5, "winter", "x"), (None, "one two three", "x")]


def pages():
    rnd = random.Random(3)
    rows = [(0, None, None), (1, "no scheme", ""), (2, "HTTP://A.Net/Index?x=1", "<p>a</p>"), (3, "http://example.net/en/a?b=http://c.org/fr/", "<p>a</p>"), (4, "http://x.example.net/EN/", "ü" * 3000),
            (5, "https://www.example.com/de/#top", "<p>a</p>"), (6, "https://org/fr/1", None), (7, "http://notnet/", "b"), (8, "http://q.net", "c"), (9, "://net/x", "d\r\n\r\n"), (10, "a://b/" + "y" * 50_000, "e")]
    for i in range(11, 120):
        host = rnd.choice(["a.net", "example.net", "shop.example.com", "b.org", "c.info", "c.info"])
        rows.append((i, f"http://{host}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randint(1, 99)}{rnd.choice(['', '?a=1&b=2', '.html'])}", "".join(rnd.choice("abc<>/ ") for _ in range(rnd.randint(0, 3)))))
    rows += [(11, "http://a.net/again", "zz"), (3, "http://b.org/again", "<p>a</p>"), (None, "http://n.org/", "<p>a</p>"), (None, None, "only here")]
    return [(*r, "h", "p", 1) for r in rows]


def embeddings():
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(240)]
    rows[100] = (100, list(rows[7][1]))
    rows += [(7, list(rows[7][1])), (300, list(rows[7][1])), (301, [0.0] * 6), (302, None), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] + [0.0] * 5),
             (400, [1.0, 2.0]), (401, [3.0, 4.0]), (500, []), (None, [1.0] * 6), (600, [0.0] * 6)]
    return [(*r, 1, "s", "r") for r in rows]


def conversations():
    rnd = random.Random(6)
    said = ["Yes.", "No!", "why", " ", "", None, "ok\t\n", "So?\r\n", "Hm ...", "a\u00a0", "x" * 70_000]
    rows = []
    for c in range(150):
        for t in range(rnd.randint(1, 12)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ["user", "assistant"][t % 2]
            rows.append((c, t * rnd.choice([1, 1, 1, 2]), "system" if t == 0 and c % 3 == 0 else rnd.choice(["tool", "", None, "Assistant", "umpire"]) if rnd.random() < 0.05 else role, rnd.choice(said[:2] if rnd.random() < 0.8 else said) if rnd.random() < 0.2 else f"{sentence(rnd, 'en', 4)}{rnd.choice('...!?x')}"))
    rows += [(200, None, "user", "One?"), (200, None, "assistant", "Two."), (200, 5, "user", "Three"), (None, 1, "user", "Four."), (None, None, "assistant", None), (201, None, None, None)]
    rows += [(202, k, ["user", "assistant"][k % 2] if k % 9 else "system", f"Turn {k}{'.' if k % 5 else ''}") for k in range(400)]  # several segments
    rows += [*rows[:7], *rows[40:44]]  # repeated rows
    return [(*r, "s", 1, "KK") for r in rows]


ROWS = {"conversations": conversations, "documents": documents, "benchmark": benchmark, "labels": labels, "pages": pages, "embeddings": embeddings}


def same_as_sql(duck, df, sql):
    """The rows of ``df`` and of the SQL, by column name, as multisets."""
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(repr, duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))
    assert got == want
