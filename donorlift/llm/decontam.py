"""Benchmark decontamination (operator 1) with an FM-index per training shard.

Words are runs of bytes outside ASCII separators, A-Z lower-cased.  Test
phrases are the windows of ten consecutive words of every benchmark item; an
item of fewer words, but not none, is one window.

A task turns its documents into shards.  Words that no phrase holds end a run;
runs shorter than the shortest phrase cannot hold one and are passed over, and
equal runs of a shard are indexed once.  The runs, as numbers of phrase words
with a zero between two of them, get a suffix array by prefix doubling, a
Burrows-Wheeler transform in a wavelet matrix of bit vectors with block ranks,
and a sample of suffix positions.  All phrases are searched backward together
through the wavelet ranks; every row of their intervals walks to a sampled
position; the hit spans of a run are merged, and documents take the hits of
their runs.

The phrases are broadcast; their size is checked.  Beyond ``PHRASE_WORDS``
words the benchmark is searched in groups of items, all over the original
texts, and their hit spans are merged per document (by a shuffle, or in a
column beside the text), so no limit drops a phrase.

Defined results: null and empty texts have no words; items without words have
no window; without items nothing is hit; repeated documents give repeated rows;
repeated items count once; a null item_id marks hits but cannot be listed; a
text of any length is searched whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from donorlift.llm.common import ASCII_LOWER, batch, byte_class, row_blocks, share, table, text_buffer, tidy, word_bounds, word_hashes
from donorlift.llm.queries import query

WINDOW = 10
#: Symbols in one index; a document's runs are not split over two.
SHARD_SYMBOLS = 1 << 19
#: One suffix position in so many is kept.
SAMPLE_RATE = 8
#: Benchmark words in one broadcast: with their phrases some hundred bytes each.
PHRASE_WORDS = 200_000
KEEP = byte_class(bytes([*range(0, 48), *range(58, 97), *range(123, 128)]))


def hashed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last byte of every word of all texts, and the number of
    words before each text.  ``buf`` is lower-cased."""
    first, last, before = word_bounds(buf, offs, KEEP)
    return word_hashes(buf, first, last), first, last, before


@dataclass
class Phrases:
    """Test phrases: the word vocabulary (sorted hashes; numbers start at 1),
    phrases by length as matrices of word numbers, and their items."""

    vocabulary: np.ndarray
    by_length: list[np.ndarray]
    items_of: list[np.ndarray]  # per phrase, in order of the matrices
    item_ids: list

    @property
    def shortest(self) -> int:
        return min((m.shape[1] for m in self.by_length), default=0)


def phrases_of(items: list[tuple], window: int = WINDOW) -> Phrases:
    """Phrases of (item_id, text) rows."""
    buf, offs = text_buffer(pa.array([t for _, t in items], pa.string()))
    hashes, _, _, before = hashed_words(ASCII_LOWER[buf], offs)
    vocabulary = np.unique(hashes)
    number = np.searchsorted(vocabulary, hashes) + 1
    names = sorted({i for i, _ in items if i is not None}, key=str)
    place = {i: k for k, i in enumerate(names)}
    found: dict[int, dict[bytes, set]] = {}
    for (item, _), lo, hi in zip(items, before[:-1].tolist(), before[1:].tolist(), strict=True):
        words = number[lo:hi].astype(np.int32)
        size = min(window, len(words))
        for at in range(len(words) - size + 1) if size else ():
            found.setdefault(size, {}).setdefault(words[at : at + size].tobytes(), set()).add(place.get(item, -1))
    by_length, items_of = [], []
    for size in sorted(found):
        by_length.append(np.array([np.frombuffer(k, np.int32) for k in found[size]], np.int32).reshape(-1, size))
        items_of += [np.array(sorted(x for x in s if x >= 0), np.int64) for s in found[size].values()]
    return Phrases(vocabulary, by_length, items_of, names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling: ranks of 2^k symbols, until no two
    suffixes share one."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        done = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(done[1:] != done[:-1])])
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit vector per binary digit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            on = (seq >> b) & 1
            self.levels.append((b, BitVector(on)))
            self.zeros.append(int(len(seq) - on.sum()))
            seq = np.concatenate([seq[on == 0], seq[on == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        for (b, v), z in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            rl, rh = v.rank(lo), v.rank(hi)
            lo, hi = np.where(one, z + rl, lo - rl), np.where(one, z + rh, hi - rh)
        return hi - lo

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        lo, hi, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for (b, v), z in zip(self.levels, self.zeros, strict=True):
            one = v.get(hi).astype(bool)
            rl, rh = v.rank(lo), v.rank(hi)
            lo, hi = np.where(one, z + rl, lo - rl), np.where(one, z + rh, hi - rh)
            symbol |= one.astype(symbol.dtype) << b
        return symbol, hi - lo


class FMIndex:
    """Backward search and location over a sequence of numbers from 0; the
    sequence must end with its only use of the greatest number."""

    def __init__(self, text: np.ndarray, rate: int = SAMPLE_RATE):
        sa = suffix_array(text)
        self.bits = max(1, int(text.max()).bit_length())
        self.matrix = WaveletMatrix(text[sa - 1], self.bits)  # symbol before each suffix
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        self.marked = BitVector(sa % rate == 0)
        self.sampled = sa[sa % rate == 0]
        self.size = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval [lo, hi) of every pattern (rows of a matrix)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = patterns[live, k].astype(np.int64)
            known = c < 1 << self.bits
            c = np.where(known, c, 0)
            lo[live] = self.first[c] + self.matrix.rank(c, lo[live])
            hi[live] = np.where(known, self.first[c] + self.matrix.rank(c, hi[live]), lo[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of every row: steps back to a sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            out[todo[hit]] = self.sampled[self.marked.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, before = self.matrix.symbol_and_rank(at)
            at, steps = self.first[symbol] + before, steps + 1
        return out


class Shard:
    """Documents and the distinct runs of phrase words that they hold."""

    def __init__(self):
        self.runs: dict[bytes, int] = {}
        self.lens: list[int] = []
        self.docs: list[list[tuple[int, int]]] = []  # (run, word it starts at)
        self.symbols = 0

    def add(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """One document: its word numbers and the runs to index."""
        held = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            key = numbers[s:e].tobytes()
            run = self.runs.setdefault(key, len(self.lens))
            if run == len(self.lens):
                self.lens.append(e - s)
                self.symbols += e - s + 1
            held.append((run, s))
        self.docs.append(held)

    def hits(self, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[np.ndarray]]:
        """Merged spans (word ranges) and items of every run."""
        n = len(self.lens)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        if not n:
            return spans, items
        top = len(phrases.vocabulary) + 1
        parts: list[np.ndarray] = []
        for key in self.runs:
            parts += [np.frombuffer(key, np.int32).astype(np.int64), np.zeros(1, np.int64)]
        index = FMIndex(np.concatenate([*parts, [top]]))
        begins = np.concatenate([[0], np.cumsum(np.array(self.lens, np.int64) + 1)])
        where, size, phrase, number = [], [], [], 0
        for matrix in phrases.by_length:
            lo, hi = index.search(matrix)
            count = hi - lo
            rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            where.append(index.locate(rows))
            size.append(np.full(len(rows), matrix.shape[1]))
            phrase.append(number + np.repeat(np.arange(len(matrix)), count))
            number += len(matrix)
        at, size, phrase = np.concatenate(where), np.concatenate(size), np.concatenate(phrase)
        order = np.argsort(at, kind="stable")
        at, size, phrase = at[order], size[order], phrase[order]
        run = np.searchsorted(begins, at, "right") - 1
        edges = np.searchsorted(run, np.arange(n + 1))
        for r in np.unique(run).tolist():
            a, b = edges[r], edges[r + 1]
            s = at[a:b] - begins[r]
            reach = np.maximum.accumulate(s + size[a:b])
            new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
            spans[r] = list(zip(s[new].tolist(), reach[np.append(new[1:] - 1, b - a - 1)].tolist(), strict=True))
            items[r] = np.unique(np.concatenate([phrases.items_of[p] for p in np.unique(phrase[a:b]).tolist()]))
        return spans, items


def searched(it: Iterator[pa.RecordBatch], phrases: Phrases, shard_symbols: int = SHARD_SYMBOLS):
    """For every (batch, block of rows): per document the number of words, the
    merged hit spans in words, its items, and the first and last byte of its
    words.  Blocks wait until their shard is full, then leave in order."""
    waiting, shard = [], Shard()
    shortest = phrases.shortest

    def flush():
        nonlocal waiting, shard
        spans, items = shard.hits(phrases)
        k = 0
        for b, lo, hi, words in waiting:
            out = []
            for n in words:
                held = shard.docs[k]
                k += 1
                out.append((n, [(s + a, s + z) for run, s in held for a, z in spans[run]], [items[run] for run, _ in held if len(items[run])]))
            yield b.slice(lo, hi - lo), out
        waiting, shard = [], Shard()

    for b in it:
        buf, offs = text_buffer(b.column(b.schema.get_field_index("text")))
        for lo, hi in row_blocks(offs):
            part = ASCII_LOWER[buf[offs[lo] : offs[hi]]]
            hashes, _, _, before = hashed_words(part, offs[lo : hi + 1] - offs[lo])
            if shortest:
                at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
                numbers = np.where(phrases.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
                inside = numbers > 0
                begin, end = inside.copy(), inside.copy()
                begin[1:] &= ~inside[:-1]
                end[:-1] &= ~inside[1:]
                cut = before[:-1][before[:-1] < len(numbers)]
                begin[cut] = inside[cut]
                end[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
                begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
                long = end - begin >= shortest
                begin, end = begin[long], end[long]
                edge = np.searchsorted(begin, before)
                for d in range(hi - lo):
                    s, e = before[d], before[d + 1]
                    shard.add(numbers[s:e], begin[edge[d] : edge[d + 1]] - s, end[edge[d] : edge[d + 1]] - s)
            else:
                shard.docs += [[] for _ in range(hi - lo)]
            waiting.append((b, lo, hi, np.diff(before).tolist()))
        if shard.symbols >= shard_symbols:
            yield from flush()
    if waiting:
        yield from flush()


def benchmark_groups(bench: DataFrame, phrase_words: int = PHRASE_WORDS) -> list[Phrases]:
    """The benchmark's phrases in groups of bounded size, by hash of the item."""
    words = bench.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    groups = max(1, -(-(words // 2) // phrase_words))  # a word has a letter and a separator at least
    out = []
    for g in range(groups):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).select("item_id", "text").collect()
        out.append(phrases_of([(r.item_id, r.text) for r in rows]))
    return out


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _listed(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode("utf-8")).hexdigest()


def contamination(docs: DataFrame, bench: DataFrame, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """Per document: words, hit words, items found, their digest, and whether
    it is contaminated."""
    groups = benchmark_groups(bench, phrase_words)
    docs = docs.select("doc_id", "text")
    if len(groups) > 1:
        return _merged(docs, groups)
    shared = share(docs.sparkSession, groups[0])

    def run(it):
        phrases = shared()
        names = [str(i) for i in phrases.item_ids]
        for b, found in searched(it, phrases):
            hit = [sum(z - a for a, z in spans) for _, spans, _ in found]
            items = [np.unique(np.concatenate(i)).tolist() if i else [] for _, _, i in found]
            yield batch(_RESULT, b.column(0), [n for n, _, _ in found], hit, [len(i) for i in items], [_listed([names[k] for k in i]) for i in items], [h > 0 for h in hit])

    return docs.mapInArrow(tidy(run), RESULT)


def _merged(docs: DataFrame, groups: list[Phrases]) -> DataFrame:
    """The same over several groups of items: spans of a document from all
    groups are merged.  Rows with equal id and text have equal results, so they
    are merged as one and counted."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    ddl = "doc_id long, digest string, n_words long, spans array<long>, items array<string>"
    parts = []
    for g in groups:
        shared = share(spark, g)

        def run(it, shared=shared):
            phrases = shared()
            names = [str(i) for i in phrases.item_ids]
            for b, found in searched(it, phrases):
                digests = [hashlib.sha256(t.encode("utf-8")).hexdigest() if t is not None else None for t in b.column(1).to_pylist()]
                items = [[names[k] for k in np.unique(np.concatenate(i)).tolist()] if i else [] for _, _, i in found]
                yield batch(schema, b.column(0), digests, [n for n, _, _ in found], [[x for s in spans for x in s] for _, spans, _ in found], items)

        parts.append(docs.mapInArrow(tidy(run), ddl))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    each = rows.groupBy("doc_id", "digest").agg(F.first("n_words").alias("n_words"), F.collect_set("spans").alias("spans"), F.flatten(F.collect_set("items")).alias("items"), F.count(F.lit(1)).alias("n"))

    def merge(it):
        for b in it:
            hit, items = [], []
            for spans, names in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
                pairs = sorted((s[k], s[k + 1]) for s in spans for k in range(0, len(s), 2))
                n, reach = 0, -1
                for a, z in pairs:
                    n, reach = n + max(0, z - max(a, reach)), max(reach, z)
                hit.append(n)
                items.append(sorted(set(names)))
            yield batch(_RESULT, b.column("doc_id"), b.column("n_words"), hit, [len(i) for i in items], [_listed(i) for i in items], [h > 0 for h in hit])

    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / len(groups)).cast("int")))).drop("copy", "n")
    return copies.mapInArrow(tidy(merge), RESULT)


def decontaminate(docs: DataFrame, bench: DataFrame, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """The documents with the bytes of all hit words, and what lies between
    them, cut out of ``text``.  Clean documents pass unchanged, null texts too;
    ``n_chars``, if there, follows the text.  All other columns pass."""
    groups = benchmark_groups(bench, phrase_words)
    schema, column = docs.schema, "spans"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    for g in groups[:-1]:
        docs = _marked(docs, g, column)
    return _cut(docs, groups[-1], column, schema)


def _marked(docs: DataFrame, phrases: Phrases, column: str) -> DataFrame:
    """The documents, whole, with the spans of these phrases added to those in
    the last column, which the first group appends: groups search the same text."""
    shared = share(docs.sparkSession, phrases)
    first = docs.columns[-1] != column
    schema = StructType([*docs.schema, StructField(column, ArrayType(LongType()))]) if first else docs.schema

    def run(it):
        for b, found in searched(it, shared()):
            spans = [[x for s in spans for x in s] for _, spans, _ in found]
            if not first:
                at = b.num_columns - 1
                spans = [old + new for old, new in zip(b.column(at).to_pylist(), spans, strict=True)]
                b = b.remove_column(at)
            yield b.append_column(column, pa.array(spans, pa.list_(pa.int64())))

    return docs.mapInArrow(tidy(run), schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _cut(docs: DataFrame, phrases: Phrases, column: str, schema: StructType) -> DataFrame:
    """The last group's spans and those marked before, cut out together."""
    shared = share(docs.sparkSession, phrases)
    marked = docs.columns[-1] == column

    def run(it):
        for b, found in searched(it, shared()):
            spans = [s for _, s, _ in found]
            if marked:
                at = b.num_columns - 1
                spans = [merged([*new, *zip(old[::2], old[1::2], strict=True)]) for old, new in zip(b.column(at).to_pylist(), spans, strict=True)]
                b = b.remove_column(at)
            at = b.schema.get_field_index("text")
            hit = [k for k, s in enumerate(spans) if s]
            if hit:
                texts = b.column(at).to_pylist()
                for k in hit:
                    texts[k] = without(texts[k], spans[k])
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                n = b.schema.get_field_index("n_chars")
                if n >= 0:
                    chars = b.column(n).to_pylist()
                    for k in hit:
                        chars[k] = len(texts[k])
                    b = b.set_column(n, b.schema.field(n), pa.array(chars, b.schema.field(n).type))
            yield b

    return docs.mapInArrow(tidy(run), schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    _, first, last, _ = hashed_words(ASCII_LOWER[raw], np.array([0, len(raw)]))
    keep, at = [], 0
    for a, z in sorted(spans):
        keep.append(raw[at : first[a]].tobytes())
        at = last[z - 1]
    keep.append(raw[at:].tobytes())
    return b"".join(keep).decode("utf-8")


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS phrase
      FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
g AS (SELECT r, i, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
      FROM (SELECT r, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM w, sizes WHERE len(words) >= size)),
f AS (SELECT r, i, g.size, item_id FROM g JOIN p ON g.phrase = p.phrase AND g.size = p.size),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS pos FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op1_decontaminate", SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
