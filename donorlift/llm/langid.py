"""Language identification (operator 10): interpolated Kneser-Ney character
models, one per language.

A text is read as lower-cased letters with one blank between runs of letters
and three before the first one, so every letter or blank ends a 4-gram.  A
4-gram of 16-bit symbols is exactly one 64-bit key.  Keys are counted per
language over every training text (partial counts in the tasks, sums by
shuffle) into a table in the shared folder; lower orders count distinct left
neighbours, as Kneser-Ney does.

A model is sorted key arrays per language and order, with log-probabilities,
and back-off weights by context.  Scoring looks up the distinct 4-grams of a
block by binary search, and those not found one order lower.  The language of
least cross-entropy per symbol wins; ties go to the first name.

Every counted 4-gram of every language is in the model.  Up to ``PART_GRAMS`` of
them are one broadcast.  More are cut by (language, last but one symbol), which
a 4-gram shares with all it backs off to; the driver and the tasks hold one part
at a time, the texts are read once a part, and the parts' sums meet by the digest
of the text.  Sums are of whole numbers, so both ways give the same rows.

A text is *rejected* if it is null or has no letter, or if its cross-entropy is
above the limit calibrated for its language: the ``LIMIT_QUANTILE`` of that of all
its training texts, each scored whole by a model that leaves its half of the
texts out, plus a margin (languages of under ``FEW_TEXTS`` texts: the widest limit,
and at least the highest of their own).

Defined results: null text or no letter gives ``und`` with score 0 and is
rejected; without any training text every text gives ``und``; texts of any
length are scored whole; repeated rows give repeated rows; a null doc_id is
not held out and is not learned from; other columns are not read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.llm.common import batch, held_out, keep_rows, materialise, row_blocks, share, table, text_buffer, tidy, train_fold
from donorlift.llm.queries import query

ORDER = 4
#: Log-probabilities are whole multiples of 1 / SCALE nats.
SCALE = 1 << 20
#: The model of all training texts; 0 and 1 leave out that fold.
FULL = 2
#: 4-grams of a model that are on the driver, and in a task, at once.
PART_GRAMS = 2_000_000
#: 4-grams that a counting task holds before it gives them out.
HELD_GRAMS = 4_000_000
#: Share of a language's training texts within its limit, and what is added to
#: it, in nats per symbol.
LIMIT_QUANTILE, REJECT_MARGIN = 0.999, 1.0
#: Cross-entropies are counted in bins of 1 / BINS nats.
BINS = 32
#: Languages of fewer training texts have no quantile of their own.
FEW_TEXTS = 30
#: Sharpness of scores: the one of greatest likelihood is taken.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
UND = "und"
BLANK = 32
OTHER = 0xFFFF


def symbol_table() -> np.ndarray:
    """For each 16-bit code point: its lower-case letter, or a blank."""
    out = np.full(1 << 16, BLANK, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) <= OTHER else c
    return out


def astral_letters() -> np.ndarray:
    return np.array([c for c in range(1 << 16, sys.maxunicode + 1) if chr(c).isalpha()], np.uint32)


@dataclass
class Alphabet:
    """Code points to 16-bit symbols; letters beyond 16 bits share one."""

    low: np.ndarray
    astral: np.ndarray

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and n + 1 offsets.  Each text starts with
        three blanks; runs of blanks behind them are one."""
        cps = np.frombuffer(("\n\n\n" + "\n\n\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
        offs = np.concatenate([[0], np.cumsum(lens)])
        sym = self.low[np.minimum(cps, OTHER)]
        far = np.flatnonzero(cps > OTHER)
        if len(far):
            at = np.minimum(np.searchsorted(self.astral, cps[far]), len(self.astral) - 1)
            sym[far] = np.where(self.astral[at] == cps[far], OTHER, BLANK)
        keep = sym != BLANK
        keep[1:] |= sym[:-1] != BLANK  # the first blank of a run stays
        for k in range(3):
            keep[offs[:-1] + k] = True
        sym[offs[:-1, None] + np.arange(3)] = BLANK
        third = offs[:-1] + 3  # a blank right behind the leading ones goes
        third = third[third < offs[1:]]
        keep[third[sym[third] == BLANK]] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        return sym[keep], before[offs]


def keys_of(sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each symbol behind the leading blanks, and n + 1
    offsets into them."""
    s = sym.astype(np.uint64)
    if len(s) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    key = (s[:-3] << np.uint64(48)) | (s[1:-2] << np.uint64(32)) | (s[2:-1] << np.uint64(16)) | s[3:]
    real = np.ones(len(key), bool)  # a 4-gram must not reach over the start of a text
    cut = offs[1:-1]
    for k in range(1, 4):
        real[cut - k] = False
    ends = np.concatenate([[0], np.cumsum(real)])
    return key[real], ends[np.minimum(offs, len(key))] if len(offs) > 1 else offs


@dataclass
class Table:
    """Sorted key arrays of one language, or of its 4-grams with certain last
    but one symbols; index k of a list is order k + 1.  Log-probabilities are
    whole multiples of 1 / SCALE, so sums do not depend on their order."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: int

    def log_probs(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last symbol of each n-gram; one not found goes one order lower."""
        if order == 0:
            return np.full(len(key), self.unseen, np.int64)
        keys = self.keys[order - 1]
        if not len(keys):
            return self.log_probs(key & _low(order - 1), order - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(keys[at] != key)
        if len(miss):
            lost = key[miss]
            low = self.log_probs(lost & _low(order - 1), order - 1)
            known, ctx = self.contexts[order - 1], lost >> np.uint64(16)
            if len(known):
                c = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
                hit = known[c] == ctx
                low[hit] += self.backoff[order - 1][c[hit]]
            out[miss] = low
        return out


def _low(symbols: int) -> np.uint64:
    """Mask of the last ``symbols`` symbols of a key."""
    return np.uint64((1 << 16 * symbols) - 1)


def _fixed(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(p, 1e-300)) * SCALE).astype(np.int64)


def lower_orders(k: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of orders 1 to 4: lower ones count distinct left neighbours."""
    orders = [(k, c)]
    for o in range(ORDER - 1, 0, -1):
        kk, cc = np.unique(orders[0][0] & _low(o), return_counts=True)
        orders.insert(0, (kk, cc))
    return orders


def discount(n1: float, n2: float) -> float:
    """Kneser-Ney's estimate n1 / (n1 + 2 n2)."""
    return min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def fit_table(k: np.ndarray, c: np.ndarray, unigrams: tuple[np.ndarray, np.ndarray], discounts: list[float], vocab: int) -> Table:
    """Interpolated Kneser-Ney from the 4-grams of one language (or from those
    that share last but one symbols), the language's unigrams and discounts.
    A 4-gram, its suffixes and all contexts they back off to have one last but
    one symbol, so a part holds whatever its 4-grams need."""
    orders = [unigrams, *lower_orders(k, c)[1:]]
    logp, contexts, backoff, lower = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], None
    for o, (keys, n) in enumerate(orders):
        d = discounts[o]
        if o == 0:
            total = max(n.sum(), 1)
            base = d * len(keys) / total / vocab if len(keys) else 1 / vocab
            p = np.maximum(n - d, 0) / total + base
        else:
            known, ctx = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(ctx, n, len(known))
            gamma = d * np.bincount(ctx, minlength=len(known)) / np.maximum(total, 1)
            p = np.maximum(n - d, 0) / total[ctx] + gamma[ctx] * lower[np.searchsorted(orders[o - 1][0], keys & _low(o))]
            contexts.append(known)
            backoff.append(_fixed(gamma))
        logp.append(_fixed(p))
        lower = p
    return Table([k for k, _ in orders], logp, contexts, backoff, int(_fixed(np.array([base]))[0]))


@dataclass
class Part:
    """Tables of some languages, by their number; ``symbols`` holds the last
    but one symbols that a table answers for (None: all)."""

    alphabet: Alphabet
    n_langs: int
    tables: list[tuple[int, np.ndarray | None, Table]]

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the scaled log-probability of every language, the number
        of symbols, and whether it has a letter."""
        n = len(texts)
        sym, offs = self.alphabet.symbols(texts)
        key, ends = keys_of(sym, offs)
        lens = np.diff(ends)
        letters = np.zeros(n, bool)
        total = np.zeros((n, self.n_langs), np.int64)
        full = np.flatnonzero(lens > 0)
        if len(full):
            letters[full] = np.logical_or.reduceat((key & np.uint64(0xFFFF)) != BLANK, ends[full])
            for lo in range(0, len(key), 1 << 18):  # bounded rows of probabilities
                hi = min(lo + (1 << 18), len(key))
                some = np.flatnonzero((ends[1:] > lo) & (ends[:-1] < hi) & (lens > 0))
                total[some] += np.add.reduceat(self.log_probs(key[lo:hi]), np.maximum(ends[some], lo) - lo, 0)
        return total, lens, letters

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        """Scaled log-probabilities, a column per language; 0 outside the part."""
        kinds, place = np.unique(key, return_inverse=True)
        out = np.zeros((len(kinds), self.n_langs), np.int64)
        for j, symbols, t in self.tables:
            if symbols is None:
                out[:, j] = t.log_probs(kinds)
            else:
                mine = np.isin((kinds >> np.uint64(16)) & np.uint64(0xFFFF), symbols)
                out[mine, j] = t.log_probs(kinds[mine])
        return out[place]


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: Alphabet) -> Part:
    """Models of all languages, in the order of their names, from 4-gram
    counts that fit one task; the SQL of ``statistics`` gives the same."""
    orders = {lang: lower_orders(k, c) for lang, (k, c) in counts.items()}
    vocab = len(np.unique(np.concatenate([np.zeros(0, np.uint64), *[o[0][0] for o in orders.values()]]))) + 1
    tables = []
    for j, lang in enumerate(sorted(counts)):
        ds = [discount((c == 1).sum(), (c == 2).sum()) for _, c in orders[lang]]
        tables.append((j, None, fit_table(*counts[lang], orders[lang][0], ds, vocab)))
    return Part(alphabet, len(counts), tables)


def ngram_counts(train: DataFrame, alphabet) -> DataFrame:
    """(model, lang, key, n): 4-gram counts over every training text, for the
    model of all texts (2) and those that leave out fold 0 or 1 of the texts."""

    schema = pa.schema([("fold", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def count(it):
        alpha = alphabet()
        held: dict[tuple, list] = {}

        def fold(group):
            keys = np.concatenate([k for k, _ in held[group]])
            ns = np.concatenate([c for _, c in held[group]])
            u, inv = np.unique(keys, return_inverse=True)
            held[group] = [(u, np.bincount(inv, ns, len(u)).astype(np.int64))]

        def rows():
            for group in sorted(held):
                fold(group)
                u, c = held[group][0]
                for at in range(0, len(u), 50_000):
                    part = u[at : at + 50_000].view(np.int64)
                    yield batch(schema, [group[0]] * len(part), [group[1]] * len(part), part, c[at : at + 50_000])
            held.clear()

        for b in it:
            _, all_offs = text_buffer(b.column(0))
            for lo, hi in row_blocks(all_offs):
                groups = list(zip(b.column(2).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), strict=True))
                texts = b.column(0).slice(lo, hi - lo).to_pylist()
                for group in sorted(set(groups)):
                    key, _ = keys_of(*alpha.symbols([t for t, g in zip(texts, groups, strict=True) if g == group]))
                    held.setdefault(group, []).append(np.unique(key, return_counts=True))
                    if len(held[group]) > 8:
                        fold(group)
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_GRAMS:
                yield from rows()
        yield from rows()

    partial = train.select("text", "lang", text_fold().alias("fold")).mapInArrow(tidy(count), "fold int, lang string, key long, n long")
    models = F.explode(F.array(F.lit(2), 1 - F.col("fold"))).alias("model")
    return partial.select(models, "lang", "key", "n").groupBy("model", "lang", "key").agg(F.sum("n").alias("n"))


def text_fold():
    """0 or 1; equal texts are in one fold."""
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


def statistics(grams: DataFrame) -> list:
    """What reaches the driver of the counts, at most about 65,536 rows of each
    kind per language: 4-grams by last but one symbol (kind 0), unigrams (1),
    and the numbers of n-grams with counts 1 and 2 by order (10 + order)."""
    orders = {ORDER: grams}
    for o in range(ORDER - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << 16 * o) - 1))
        orders[o] = orders[o + 1].groupBy("model", "lang", low.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    symbol = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFF))
    out = grams.groupBy("model", "lang", symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("n")).select("model", "lang", F.lit(0).alias("kind"), "symbol", "n")
    out = out.union(orders[1].select("model", "lang", F.lit(1), "key", "n"))
    for o, df in orders.items():
        out = out.union(df.where("n <= 2").groupBy("model", "lang", "n").agg(F.count(F.lit(1)).alias("m")).select("model", "lang", F.lit(10 + o), "n", "m"))
    return out.collect()


class Models:
    """Counted models: the 4-grams stay in a table in the shared folder, and a
    model is loaded in parts of at most ``part_grams`` 4-grams, or of those of
    one language with one last but one symbol."""

    def __init__(self, grams: DataFrame | None, alphabet: Alphabet, part_grams: int):
        self.grams, self.alphabet = grams, alphabet
        self.limits: np.ndarray | None = None
        self.sharpness = 1.0
        self.kinds: dict[tuple, dict[int, int]] = {}
        for r in statistics(grams) if grams is not None else []:
            self.kinds.setdefault((r.model, r.lang, r.kind), {})[r.symbol] = r.n
        self.langs = sorted({lang for _, lang, _ in self.kinds})
        self.parts = {m: self._parts(m, part_grams) for m in (0, 1, FULL)}

    def _parts(self, model: int, part_grams: int) -> list[list[tuple[str, int]]]:
        """(language, symbol) cells of each part."""
        parts, held = [[]], 0
        for lang in self.langs:
            for symbol, n in sorted(self.kinds.get((model, lang, 0), {}).items()):
                if held and held + n > part_grams:
                    parts.append([])
                    held = 0
                parts[-1].append((lang, symbol))
                held += n
        return parts

    def load(self, model: int, at: int) -> Part:
        """Part number ``at`` of a model."""
        cells, whole = self.parts[model][at], len(self.parts[model]) == 1
        grams = self.grams.where(F.col("model") == model)
        if not whole:
            spark = self.grams.sparkSession
            mine = spark.createDataFrame(cells, "_lang string, _symbol long")
            symbol = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFF))
            # at most 65,536 cells a language
            grams = grams.join(F.broadcast(mine), (F.col("lang") == F.col("_lang")) & (symbol == F.col("_symbol")), "left_semi")
        got = grams.select("lang", "key", "n").toArrow()
        lang = np.array(got.column("lang").to_pylist(), object)
        key, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
        # symbols that any language has, and one that none has
        vocab = len({s for name in self.langs for s in self.kinds.get((model, name, 1), {})}) + 1
        tables = []
        for j, name in enumerate(self.langs):
            symbols = None if whole else np.array([s for x, s in cells if x == name], np.uint64)
            if not whole:
                # cells that no part has score by unigrams, in the first part
                counted = self.kinds.get((model, name, 0), {})
                if at == 0:
                    symbols = np.union1d(symbols, np.setdiff1d(np.arange(1 << 16, dtype=np.uint64), np.array(sorted(counted), np.uint64)))
                if not len(symbols):
                    continue
            k, c = key[lang == name], n[lang == name]
            order = np.argsort(k)
            uni = sorted(self.kinds.get((model, name, 1), {}).items())
            unigrams = np.array([s for s, _ in uni], np.uint64), np.array([c for _, c in uni], np.int64)
            ds = []
            for o in range(1, ORDER + 1):
                of = self.kinds.get((model, name, 10 + o), {})
                ds.append(discount(of.get(1, 0), of.get(2, 0)))
            tables.append((j, symbols, fit_table(k[order], c[order], unigrams, ds, vocab)))
        return Part(self.alphabet, len(self.langs), tables)

    def entropies(self, sums: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Cross-entropy per symbol in nats, a column per language."""
        return -sums / SCALE / np.maximum(lens, 1)[:, None]

    def predict(self, sums: np.ndarray, lens: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of every text."""
        n = len(lens)
        if not self.langs or not n:
            return [UND] * n, np.zeros(n), np.ones(n, bool)
        ent = self.entropies(sums, lens)
        best = ent.argmin(1)
        gap = ent - ent[np.arange(n), best][:, None]
        score = 1 / np.exp(-self.sharpness * gap).sum(1)
        rejected = ~letters
        if self.limits is not None:
            rejected |= ent[np.arange(n), best] > self.limits[best]
        return [self.langs[b] if ok else UND for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0), rejected

    def decider(self) -> Models:
        """A copy without tables, to be sent to tasks."""
        out = object.__new__(Models)
        out.langs, out.limits, out.sharpness = self.langs, self.limits, self.sharpness
        return out


def scored_by(part: Part, arr: pa.Array):
    """(from, to, sums, symbols, letters) of blocks of a text column."""
    _, offs = text_buffer(arr)
    for lo, hi in row_blocks(offs):
        yield lo, hi, *part.sums([t or "" for t in arr.slice(lo, hi - lo).to_pylist()])


def text_sums(texts: DataFrame, models: Models, model: int) -> DataFrame:
    """(digest, sums, lens, letters) of every distinct text, for a model of
    several parts: the texts are read once a part, one part is held at a time,
    and the parts' sums meet by the SHA-256 of the text."""
    schema = pa.schema([("digest", pa.string()), ("sums", pa.list_(pa.int64())), ("lens", pa.int64()), ("letters", pa.bool_())])
    ddl = "digest string, sums array<long>, lens long, letters boolean"
    done = None
    for at in range(len(models.parts[model])):
        shared = share(texts.sparkSession, models.load(model, at))

        def run(it, shared=shared):
            part = shared()
            for b in it:
                for lo, hi, sums, lens, letters in scored_by(part, b.column(1)):
                    yield batch(schema, b.column(0).slice(lo, hi - lo), list(sums), lens, letters)

        rows = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "text").mapInArrow(tidy(run), ddl)
        rows = rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("sums", "lens", "letters")])
        rows = materialise(rows, "language-sums")
        done = rows if done is None else done.union(rows)
    total = F.array(*[F.sum(F.col("sums")[j]) for j in range(len(models.langs))])
    return done.groupBy("digest").agg(total.alias("sums"), F.first("lens").alias("lens"), F.first("letters").alias("letters"))


def _sums_of(b: pa.RecordBatch, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, symbols and letters from columns 0 to 2; null counts as empty."""
    lists = b.column(0).to_pylist()
    sums = np.array([s or [0] * n_langs for s in lists], np.int64).reshape(len(lists), n_langs)
    return sums, b.column(1).fill_null(0).to_numpy(zero_copy_only=False), b.column(2).fill_null(False).to_numpy(zero_copy_only=False)


def calibrate(models: Models, train: DataFrame) -> Models:
    """Rejection limits and the sharpness of scores from all training texts
    (text, lang), each scored by the model that leaves out its fold: exact
    counts by language and cross-entropy, in bins of 1 / BINS nats."""
    if not models.langs:
        return models
    spark = train.sparkSession
    decider = share(spark, models.decider())
    names = [f"loss{k}" for k in range(len(SHARPNESS))]
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in names]])
    ddl = "lang string, bin int, n long, " + ", ".join(f"{c} double" for c in names)

    def tally(held, m, sums, lens, letters, langs):
        place = {lang: j for j, lang in enumerate(m.langs)}
        truth = np.array([place.get(lang, -1) for lang in langs], np.int64)
        known = letters & (truth >= 0)
        if not known.any():
            return
        e, t = m.entropies(sums, lens)[known], truth[known]
        own, least = e[np.arange(len(t)), t], e.min(1)
        losses = [np.log(np.exp(-s * (e - least[:, None])).sum(1)) + s * (own - least) for s in SHARPNESS]
        cell, inv = np.unique(np.stack([t, np.ceil(own * BINS).astype(np.int64)]), axis=1, return_inverse=True)
        sizes = np.bincount(inv.ravel(), minlength=cell.shape[1])
        each = [np.bincount(inv.ravel(), x, cell.shape[1]) for x in losses]
        for k in range(cell.shape[1]):
            row = np.array([sizes[k], *[x[k] for x in each]])
            held[tuple(cell[:, k])] = held.get(tuple(cell[:, k]), 0) + row

    def rows_of(held, m):
        if held:
            at, rows = np.array(list(held)), np.array(list(held.values()))
            yield batch(schema, [m.langs[j] for j in at[:, 0]], at[:, 1].astype(np.int32), rows[:, 0].astype(np.int64), *rows[:, 1:].T)

    if all(len(models.parts[f]) == 1 for f in (0, 1)):
        left_out = [share(spark, models.load(f, 0)) for f in (0, 1)]

        def run(it):
            m, parts, held = decider(), [x() for x in left_out], {}
            for b in it:
                folds = b.column(2)
                for f in (0, 1):
                    mine = b.filter(pc.equal(folds, f))
                    for lo, hi, sums, lens, letters in scored_by(parts[f], mine.column(0)):
                        tally(held, m, sums, lens, letters, mine.column(1).slice(lo, hi - lo).to_pylist())
            yield from rows_of(held, m)

        parts = train.select("text", "lang", text_fold()).mapInArrow(tidy(run), ddl)
    else:

        def run(it):
            m, held = decider(), {}
            for b in it:
                tally(held, m, *_sums_of(b, len(m.langs)), b.column(3).to_pylist())
            yield from rows_of(held, m)

        parts = None
        for f in (0, 1):
            mine = train.where(text_fold() == f)
            joined = mine.select("lang", F.sha2("text", 256).alias("digest")).join(text_sums(mine, models, f), "digest")
            some = joined.select("sums", "lens", "letters", "lang").mapInArrow(tidy(run), ddl)
            parts = some if parts is None else parts.union(some)
    rows = parts.groupBy("lang", "bin").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    if not rows:
        return models

    def quantile(some) -> float:
        """The upper edge of the bin that reaches LIMIT_QUANTILE of the texts."""
        some = sorted((r.bin, r.n) for r in some)
        reach = np.cumsum([n for _, n in some])
        return some[int(np.searchsorted(reach, LIMIT_QUANTILE * reach[-1]))][0] / BINS

    of = {lang: [r for r in rows if r.lang == lang] for lang in models.langs}
    limits = {lang: quantile(some) for lang, some in of.items() if sum(r.n for r in some) >= FEW_TEXTS}
    widest = max(limits.values(), default=0.0)
    for lang in models.langs:  # few texts: at least the widest limit, and their own highest
        limits.setdefault(lang, max([widest, *[r.bin / BINS for r in of[lang]]]))
    models.limits = np.array([limits[lang] for lang in models.langs]) + REJECT_MARGIN
    # the sharpness of greatest likelihood, of a few
    models.sharpness = SHARPNESS[int(np.argmin([sum(r[c] for r in rows) for c in names]))]
    return models


def fit_language_models(docs: DataFrame, part_grams: int | None = None) -> Models:
    """Models from documents (doc_id, text, lang) of the training fold."""
    alphabet = Alphabet(symbol_table(), astral_letters())
    train = docs.where(train_fold() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    grams = materialise(ngram_counts(train, share(docs.sparkSession, alphabet)), "language-grams", compact=True)
    return calibrate(Models(grams, alphabet, part_grams or PART_GRAMS), train)


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Predicted language of every document."""
    spark = docs.sparkSession
    decider = share(spark, models.decider())
    if len(models.parts[FULL]) > 1:

        def join(it):
            m = decider()
            for b in it:
                yield batch(_RESULT, b.column(3), b.column(4), *m.predict(*_sums_of(b, len(m.langs))))

        ids = docs.select("doc_id", held_out().alias("held_out"), F.sha2("text", 256).alias("digest"))
        found = ids.join(text_sums(docs.select("text"), models, FULL), "digest", "left")
        return found.select("sums", "lens", "letters", "doc_id", "held_out").mapInArrow(tidy(join), RESULT)
    shared = share(spark, models.load(FULL, 0) if models.langs else Part(models.alphabet, 0, []))

    def run(it):
        m, part = decider(), shared()
        for b in it:
            for lo, hi, sums, lens, letters in scored_by(part, b.column(1)):
                yield batch(_RESULT, b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), *m.predict(sums, lens, letters))

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(tidy(run), RESULT)


def keeps_language(docs: DataFrame, models: Models) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    spark = docs.sparkSession
    if not models.langs:
        return docs.where(F.lit(False))
    decider = share(spark, models.decider())
    if len(models.parts[FULL]) > 1:

        def keep(it):
            m = decider()
            for b in it:
                yield b.filter(pa.array(~m.predict(*_sums_of(b, len(m.langs)))[2]))

        sums = text_sums(docs.select("text"), models, FULL).select("sums", "lens", "letters", F.col("digest").alias("_kept_digest"))
        kept = sums.mapInArrow(tidy(keep), sums.schema).select("_kept_digest")
        return docs.join(kept, F.sha2(docs["text"], 256) == kept["_kept_digest"], "left_semi")
    whole = share(spark, models.load(FULL, 0))

    def decide(both, arr: pa.Array) -> np.ndarray:
        m, part = both
        rest = [m.predict(sums, lens, letters)[2] for _, _, sums, lens, letters in scored_by(part, arr)]
        return ~np.concatenate([np.zeros(0, bool), *rest])

    return keep_rows(docs, "text", lambda: (decider(), whole()), decide)


@query("op10_langid")
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit_language_models(docs))
