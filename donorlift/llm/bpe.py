"""BPE encoding and decoding (operator 8).

The vocabulary file describes a word-level BPE: text is NFC-normalised, white
space is dropped, letters are lower-cased, words are split by a fixed pattern,
bytes become printable characters and the last one carries an end-of-word mark.

The words of texts of printable ASCII and Latin letters are cut together, by the
kinds of their bytes, and each distinct word of a block is looked up once; other
texts are split one by one.

Encoding holds every distinct short word of a block as one row of a contiguous
matrix: its part ids (the part boundaries) and the merge rank of each pair of
adjacent parts.  All rows are scanned for their minimum rank together; the
boundary there is deleted and the two neighbouring ranks are looked up again,
until no row has a known pair.  A long word takes the same steps by itself, with
links to its neighbours in place of shifts and a heap in place of scans, so its
time is that of a sort: a word of a megabyte takes seconds, and about 50 bytes
of memory a letter.

Defined results: a null text is an empty text; an empty text has no ids and
decodes to an empty text; texts of any length are encoded whole; repeated rows
give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from donorlift.llm.common import batch, row_blocks, share, table, text_buffer, tidy
from donorlift.llm.queries import query

#: Words up to this many bytes are merged in matrices, longer ones one by one.
SHORT_WORD = 40
#: Words kept with their ids per task; beyond it the cache starts anew.
CACHE_WORDS = 400_000
NO_RANK = np.int32(2**31 - 1)
#: Text encoded at once, in bytes: a word of a block is looked up once.
ENCODE_BYTES = 1 << 22
#: The pattern that has a plain twin for lower-cased texts of printable ASCII and
#: the Latin letters of one byte, where the classes \\p{L} and \\p{N} are short.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = "a-zß-öø-ÿ"


def _byte_kinds() -> np.ndarray:
    """What each byte of a lower-cased text is to KNOWN_PATTERN: 0 white space,
    1 part of a letter, 2 digit, 3 other; 4 if the text holds more than printable
    ASCII and LATIN (whose letters beyond ASCII are 0xC3 and one more byte)."""
    kinds = np.full(256, 4, np.uint8)
    kinds[33:127] = 3
    kinds[48:58] = 2
    kinds[[*range(97, 123), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = 1
    kinds[[9, 10, 13, 32]] = 0
    return kinds


BYTE_KINDS = _byte_kinds()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: bytes that print in
    Latin-1 stand for themselves, the others take 256, 257, ... in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


class WordBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for text, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = text
        self.width = len(self.tokens)
        end = spec["model"]["end_of_word_suffix"]
        chars = byte_characters()
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        self.last_ids = np.array([vocab[c + end] for c in chars], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.rank_made = made
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._ready()

    def _ready(self) -> None:
        self.split_words = regex.compile(self.pattern).findall
        plain = self.pattern == KNOWN_PATTERN
        self.beyond_latin = re.compile(rf"[^ \t\n\r!-~{LATIN}]").search if plain else None
        self.split_latin = re.compile(rf"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{LATIN}0-9]+").findall
        self.split_specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.token_array = np.array(self.tokens, object)
        self.cache: dict[str, bytes] = {}
        self.rank_map: dict[int, int] | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split_words", "beyond_latin", "split_latin", "split_specials", "token_array", "cache", "rank_map")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    # -- words ---------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The normalised words of a text; special tokens stay whole."""
        if self.split_specials is not None and any(s in text for s in self.specials):
            out = []
            for part in self.split_specials.split(text):
                out.extend([part] if part in self.specials else self._plain(part))
            return out
        return self._plain(text)

    @staticmethod
    def _lower(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case character by character: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def _plain(self, text: str) -> list[str]:
        text = self._lower(text)
        if self.beyond_latin and not self.beyond_latin(text):
            return self.split_latin(text)
        return self.split_words(text)

    # -- encoding ------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def _symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        ids = self.byte_ids[raw]
        ids[-1] = self.last_ids[raw[-1]]
        return ids

    def _merge_rows(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of words of at most SHORT_WORD bytes, as bytes."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        width = int(lens.max())
        cols = np.arange(width)
        raw = np.zeros((n, width), np.uint8)
        raw[cols < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(cols < lens[:, None], self.byte_ids[raw], -1).astype(np.int32)
        rows = np.arange(n)
        ids[rows, lens - 1] = self.last_ids[raw[rows, lens - 1]]
        ranks = np.full((n, width), NO_RANK, np.int32)  # the last column stays without a pair
        if width > 1:
            ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        out_ids, left = ids.copy(), lens.copy()
        live = rows
        while len(live):
            at = ranks.argmin(1)
            here = np.arange(len(live))
            best = ranks[here, at]
            on = best != NO_RANK
            if not on.all():
                done = ~on
                out_ids[live[done], : ids.shape[1]] = ids[done]
                live, ids, ranks, at, best = live[on], ids[on], ranks[on], at[on], best[on]
                if not len(live):
                    break
                here = np.arange(len(live))
            left[live] -= 1
            ids[here, at] = self.rank_made[best]
            # delete the boundary: everything behind it moves one place
            c = np.arange(ids.shape[1])
            source = np.minimum(c + (c > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, np.minimum(c + (c >= at[:, None]), ids.shape[1] - 1), 1)
            ids[:, -1], ranks[:, -1] = -1, NO_RANK
            # refresh the ranks on both sides of the new part
            right = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[here, at] = np.where(at + 1 < ids.shape[1], self._rank(ids[here, at], ids[here, right]), NO_RANK)
            has_left = at > 0
            h, a = here[has_left], at[has_left]
            ranks[h, a - 1] = self._rank(ids[h, a - 1], ids[h, a])
            if ids.shape[1] > 2:
                ids, ranks = ids[:, :-1], ranks[:, :-1].copy()
                ranks[:, -1] = NO_RANK
                # a dropped column is empty for every row: each live row lost one part
        flat = out_ids[cols < left[:, None]].astype("<u4").tobytes()
        ends = np.cumsum(left) * 4
        return [flat[e - k * 4 : e] for e, k in zip(ends.tolist(), left.tolist(), strict=True)]

    def _merge_long(self, word: bytes) -> bytes:
        """Ids of one long word: part boundaries and ranks in flat arrays as for
        short words, neighbours by links in place of shifts, and the least rank,
        leftmost first, from a heap in place of a scan.  A merge looks up the
        two ranks beside it and no others; entries whose rank has changed since
        are passed over."""
        first = self._symbols(word)
        n, known, width = len(first), self._rank_map(), self.width
        start = self._rank(first[:-1], first[1:]) if n > 1 else np.zeros(0, np.int32)
        ranks = array("i", np.append(np.where(start == NO_RANK, -1, start), -1).astype(np.int32).tobytes())
        ids, right, left = array("i", first.astype(np.int32).tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        at = np.flatnonzero(start != NO_RANK)
        heap = ((start[at].astype(np.int64) << 32) | at).tolist()
        heapq.heapify(heap)
        made, pop, push = self.rank_made.tolist(), heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if ranks[i] != rank:
                continue
            j = right[i]
            k, h = right[j], left[i]
            ids[i] = part = made[rank]
            right[i], ranks[j], ranks[i] = k, -1, -1  # the boundary before j goes
            if k < n:
                left[k] = i
                new = known.get(part * width + ids[k], -1)
                if new >= 0:
                    ranks[i] = new
                    push(heap, new << 32 | i)
            if h >= 0:
                ranks[h] = new = known.get(ids[h] * width + part, -1)
                if new >= 0:
                    push(heap, new << 32 | h)
        out, i = array("i"), 0
        while i < n:
            out.append(ids[i])
            i = right[i]
        return np.frombuffer(out, np.int32).astype("<u4").tobytes()

    def _rank_map(self) -> dict[int, int]:
        if self.rank_map is None:
            self.rank_map = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self.rank_map

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that the cache lacks."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(set(words).difference(self.cache))
        raw = [w.encode("utf-8") for w in new]
        short = sorted((i for i, w in enumerate(raw) if len(w) <= SHORT_WORD and new[i] not in self.specials), key=lambda i: len(raw[i]))
        for lo in range(0, len(short), 4096):
            some = short[lo : lo + 4096]
            for i, ids in zip(some, self._merge_rows([raw[i] for i in some]), strict=True):
                self.cache[new[i]] = ids
        for i, w in enumerate(raw):
            if new[i] in self.specials:
                self.cache[new[i]] = self.specials[new[i]].to_bytes(4, "little")
            elif len(w) > SHORT_WORD:
                self.cache[new[i]] = self._merge_long(w)

    def encode_bytes(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None if t else b"" for t in texts]
        if self.beyond_latin:
            some = [i for i, t in enumerate(texts) if t and not any(s in t for s in self.specials)]
            for i, ids in zip(some, self._encode_latin([self._lower(texts[i]).encode("utf-8") for i in some]), strict=True):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        split = [self.words(texts[i]) for i in rest]
        self.learn(chain.from_iterable(split))
        get = self.cache.__getitem__
        for i, ws in zip(rest, split, strict=True):
            out[i] = b"".join(map(get, ws))
        return out

    def _encode_latin(self, texts: Sequence[bytes]) -> list[bytes | None]:
        """The ids of lower-cased texts; None for texts of more than printable
        ASCII and LATIN.  The words of all texts are cut together, by the kinds of
        their bytes, and each distinct word is looked up once."""
        if not texts:
            return []
        offs = np.cumsum([0, *(len(t) + 1 for t in texts)])
        buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = BYTE_KINDS[buf]
        beyond = np.zeros(len(texts), bool)
        beyond[np.searchsorted(offs, np.flatnonzero(kind == 4), "right") - 1] = True
        if beyond.any():
            kind[np.repeat(beyond, np.diff(offs))] = 0
        inside = kind != 0
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        # an apostrophe that begins a word takes the letters of a contraction with it
        quote = np.flatnonzero(start[:-1] & (buf[:-1] == 39) & (kind[1:] == 1))
        one, two = buf[quote + 1], buf[quote + 2]
        size = np.where(np.isin(one, list(b"stmd")), 2, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + size] |= kind[quote + size] == 1
        first = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside))
        words = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(first), pa.py_buffer(buf[inside])).dictionary_encode()
        which = words.indices.to_numpy()
        known = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n") if len(which) else []
        held = list(map(self.cache.get, known))
        new = [k for k, ids in enumerate(held) if ids is None]
        self.learn([known[k] for k in new])
        for k in new:
            held[k] = self.cache[known[k]]
        flat, sizes = np.frombuffer(b"".join(held), "<u4"), np.fromiter(map(len, held), np.int64, len(held)) // 4
        begins, n = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - ends + n, n)].tobytes()
        cuts = (4 * np.append(0, ends)[np.searchsorted(np.flatnonzero(start), offs)]).tolist()
        return [None if b else ids[lo:hi] for b, lo, hi in zip(beyond.tolist(), cuts, cuts[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.encode_bytes(texts)]

    # -- decoding ------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their tokens, a space between two of them."""
        return " ".join(self.token_array[ids].tolist())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ENCODED = "doc_id long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _blocks(it, model):
    """(ids of documents, encoded texts) of bounded blocks of rows."""
    for b in it:
        ids, texts = b.column(0), b.column(1)
        _, offs = text_buffer(texts)
        for lo, hi in row_blocks(offs, ENCODE_BYTES):
            yield ids.slice(lo, hi - lo), model.encode_bytes(texts.slice(lo, hi - lo).to_pylist())


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (binary, unsigned 32-bit little-endian) and decoded text of
    every document."""
    model = share(docs.sparkSession, WordBPE(vocabulary or default_vocabulary()))

    def run(it):
        m = model()
        for doc_ids, encoded in _blocks(it, m):
            yield batch(_ENCODED, doc_ids, encoded, [m.decode(np.frombuffer(e, "<u4")) for e in encoded])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), ENCODED)


def bpe_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, taken
    in the task that encodes, so that neither leaves it."""
    model = share(docs.sparkSession, WordBPE(vocabulary or default_vocabulary()))

    def run(it):
        m = model()
        for doc_ids, encoded in _blocks(it, m):
            texts = (m.decode(np.frombuffer(e, "<u4")).encode("utf-8") for e in encoded)
            yield batch(_DIGESTS, doc_ids, [len(e) // 4 for e in encoded], [hashlib.sha256(e).hexdigest() for e in encoded], [hashlib.sha256(t).hexdigest() for t in texts])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), DIGESTS)


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
