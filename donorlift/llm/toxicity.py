"""Toxicity (operator 7): non-negative positive-unlabelled learning in numpy.

Words are lower-cased runs of letters, digits and bytes beyond ASCII.  A word's
weight is the sum of the weights of its hashed features: the word itself, its
beginnings and its inner byte 4-grams.  A text has windows that overlap by half, a
window's logit is the bias plus the weights of its words, and a text's logit
that of its highest window, so that a few words decide in texts of any length.

Training sees confirmed toxic texts (P) and unlabelled texts (U, drawn from all
texts of the training fold) and minimises the non-negative risk

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

by Adam; where the second part falls below zero, its gradient is turned around.
The class prior ``pi`` is the share of toxic rows among the labelled rows of the
training fold, or a parameter.  P and U are bounded samples drawn by hash of the
id (parameters below), of whole texts of any length.  They stay in the tasks:
the driver gets the number of texts by feature, and then, per text, the distinct
windows as their features with evidence, which is all that the risk depends on.
Scoring reads every whole text.

Defined results: null and empty texts have the logit of an empty window; texts
without confirmed toxic examples to learn from all score 0; repeated rows give
repeated rows; a doc_id with several labels is toxic if one of them is; a null
doc_id is not held out and is not learned from; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.llm.common import (
    ASCII_LOWER,
    BYTE_CODES,
    HASH_BASE,
    batch,
    byte_class,
    drawn,
    held_out,
    keep_rows,
    materialise,
    mix,
    row_blocks,
    share,
    table,
    text_buffer,
    tidy,
    train_fold,
    word_bounds,
)
from donorlift.llm.queries import query

#: Bounds of the training samples, in texts of any length.
POSITIVE_DOCS = 2_500
UNLABELLED_DOCS = 4_500
#: Class prior if no row is labelled as not toxic.
DEFAULT_PRIOR = 0.1
THRESHOLD = 0.7
WINDOW = 40
DIMENSIONS = 1 << 20
EPOCHS = 250
RATE, DECAY = 0.05, 1e-3
#: Features kept have a likelihood ratio of at least this for being commoner
#: in P than in U, so that chance words of the samples weigh nothing.
EVIDENCE = 20.0
KEEP = byte_class(bytes([*range(0, 48), *range(58, 97), *range(123, 128)]))
PREFIXES = (3, 4, 5, 6)
GRAM = 4


def word_features(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and where each word's begin
    (n + 1 values): the whole word, its beginnings, its byte 4-grams."""
    n, lens = len(first), last - first
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    before = np.cumsum(lens) - lens
    total = int(lens.sum())
    word_of = np.repeat(np.arange(n), lens)
    within = np.arange(total) - before[word_of]
    powers = np.cumprod(np.full(int(lens.max()), HASH_BASE))
    codes = BYTE_CODES[buf[within + first[word_of]]]
    run = np.cumsum(codes * powers[within])
    start = np.where(before > 0, run[before - 1], np.uint64(0))
    heads = run - start[word_of]  # hash of the word's beginning up to each byte
    # a byte yields: the whole word (its last byte), a beginning, a 4-gram
    length = within + 1
    whole = length == lens[word_of]
    head = np.isin(length, PREFIXES) & ~whole
    gram = length >= GRAM
    ends = np.flatnonzero(gram)
    tail = np.zeros(len(ends), np.uint64)
    for k in range(GRAM):
        tail += codes[ends - k] * powers[GRAM - 1 - k] if len(powers) >= GRAM else 0
    rows = np.concatenate([word_of[whole], word_of[head], word_of[ends]])
    hashes = np.concatenate([mix(heads[whole] + np.uint64(0x1234567)), mix(heads[head] + np.uint64(0x89ABCDEF1)), mix(tail + np.uint64(0x5555AAAA77))])
    order = np.argsort(rows, kind="stable")
    feats = (hashes[order] & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    return feats, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges given by n + 1 bounds; empty ranges are 0."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def windows(words_before: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) word of all windows of all texts, and the
    number of windows before each text.  Windows overlap by half, so any passage
    of up to half a window lies whole in one of them wherever it stands; a text
    has at least one, maybe empty, window."""
    lens, stride = np.diff(words_before), size // 2
    count = np.maximum(1, -(-(lens - size) // stride) + 1)
    ahead = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(ahead[-1]) - np.repeat(ahead[:-1], count)
    begin = np.repeat(words_before[:-1], count) + k * stride
    return begin, np.minimum(begin + size, np.repeat(words_before[1:], count)), ahead


@dataclass
class Toxicity:
    """A fitted classifier: one weight per hashed feature, and a bias."""

    weights: np.ndarray | None
    bias: float
    prior: float

    def score_buffer(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(offs) - 1)
        buf = ASCII_LOWER[buf]
        first, last, before = word_bounds(buf, offs, KEEP)
        feats, bounds = word_features(buf, first, last)
        word = sums(self.weights[feats], bounds)
        begin, end, ahead = windows(before)
        upto = np.concatenate([[0.0], np.cumsum(word, dtype=np.float64)])
        logit = self.bias + np.maximum.reduceat(upto[end] - upto[begin], ahead[:-1])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def scores(self, arr: pa.Array) -> np.ndarray:
        """Scores of a column of whole texts."""
        buf, offs = text_buffer(arr)
        parts = [self.score_buffer(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in row_blocks(offs)]
        return np.concatenate([np.zeros(0), *parts])


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(feature, p, u): texts of P and of U, rows (doc_id, text, positive), that
    hold each feature; at most DIMENSIONS rows."""
    schema = pa.schema([("feature", pa.int32()), ("p", pa.int64()), ("u", pa.int64())])

    def run(it):
        df = np.zeros((2, DIMENSIONS), np.int64)
        for b in it:
            part = 1 - b.column(2).to_numpy(zero_copy_only=False)
            buf, offs = text_buffer(b.column(1))
            for lo, hi in row_blocks(offs):
                first, last, before = word_bounds(block := ASCII_LOWER[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], KEEP)
                feats, bounds = word_features(block, first, last)
                text = np.repeat(np.arange(hi - lo), np.diff(bounds[before]))
                one = np.unique(text * DIMENSIONS + feats)
                np.add.at(df, (part[lo + one // DIMENSIONS], one % DIMENSIONS), 1)
        some = np.flatnonzero(df.any(0))
        for at in range(0, len(some), 50_000):
            f = some[at : at + 50_000]
            yield batch(schema, f.astype(np.int32), df[0, f], df[1, f])

    return texts.mapInArrow(tidy(run), "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def learned_windows(texts: DataFrame, used: np.ndarray) -> DataFrame:
    """(doc_id, positive, sizes, feats): a text's distinct windows in order, as
    the numbers of their features among ``used``, one behind another.  Windows
    with equal features have equal logits, so a text of any length is whole."""
    shared = share(texts.sparkSession, used)
    schema = pa.schema([("doc_id", pa.int64()), ("positive", pa.int32()), ("sizes", pa.list_(pa.int32())), ("feats", pa.list_(pa.int32()))])

    def run(it):
        number = np.full(DIMENSIONS, -1, np.int32)
        number[shared()] = np.arange(len(used), dtype=np.int32)
        for b in it:
            buf, offs = text_buffer(b.column(1))
            for lo, hi in row_blocks(offs):
                first, last, before = word_bounds(block := ASCII_LOWER[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo], KEEP)
                feats, bounds = word_features(block, first, last)
                feats = number[feats]
                on = feats >= 0
                bounds = np.concatenate([[0], np.cumsum(on)])[bounds]
                begin, end, ahead = windows(before)
                feats, begin, end = feats[on], bounds[begin].tolist(), bounds[end].tolist()
                sizes, held = [], []
                for a, z in zip(ahead[:-1].tolist(), ahead[1:].tolist(), strict=True):
                    kinds = dict.fromkeys(np.sort(feats[begin[k] : end[k]]).tobytes() if begin[k] < end[k] else b"" for k in range(a, z))
                    sizes.append([len(k) // 4 for k in kinds])
                    held.append(np.frombuffer(b"".join(kinds), np.int32))
                yield batch(schema, b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), sizes, held)

    return texts.mapInArrow(tidy(run), "doc_id long, positive int, sizes array<int>, feats array<int>")


def fit_pu(texts: DataFrame, prior: float, evidence: float = EVIDENCE) -> Toxicity:
    """A classifier from texts (doc_id, text, positive) of P and U.  The tasks
    read the texts; the driver gets features and their counts."""
    size = {r.positive: r.n for r in texts.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p or not n_u:
        return Toxicity(None, 0.0, prior)
    counts = document_frequencies(texts).where("p > 0").toArrow()
    used = evident(*(counts.column(c).to_numpy() for c in ("feature", "p", "u")), n_p, n_u, evidence)
    got = learned_windows(texts, used).orderBy(F.desc("positive"), "doc_id").toArrow()
    count = pc.list_value_length(got.column("sizes")).to_numpy()
    sizes, feats = (pc.list_flatten(got.column(c)).to_numpy() for c in ("sizes", "feats"))
    bounds, ahead = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (sizes, count))
    return minimised(feats, bounds, ahead, used, n_p, prior)


def minimised(feats: np.ndarray, bounds: np.ndarray, ahead: np.ndarray, used: np.ndarray, n_p: int, prior: float, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Toxicity:
    """Minimise the non-negative PU risk with logistic losses and a squared
    penalty.  ``feats`` are numbers in ``used``, of windows given by ``bounds``,
    of texts given by ``ahead``; the first ``n_p`` texts are P."""
    n_u = len(ahead) - 1 - n_p
    share = np.concatenate([np.full(n_p, 1 / n_p), np.full(n_u, 1 / n_u)])
    theta, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for epoch in range(1, epochs + 1):
        win = sums(theta[feats], bounds).astype(np.float32)
        top = np.maximum.reduceat(win, ahead[:-1])
        # each text's highest window, the first of equals
        at = np.flatnonzero(win == np.repeat(top, np.diff(ahead)))
        text = np.searchsorted(ahead, at, "right") - 1
        at = at[np.concatenate([[True], text[1:] != text[:-1]])]
        logit = np.clip(bias + top, -50, 50)
        p, soft = 1 / (1 + np.exp(-logit)), np.log1p(np.exp(logit))
        negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
        g = np.concatenate([prior * (p[:n_p] - 1) - prior * p[:n_p], p[n_p:]]) if negative >= 0 else np.concatenate([prior * p[:n_p], -p[n_p:]])
        g *= share
        lo, hi = bounds[at], bounds[at + 1]
        size = hi - lo
        where = feats[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        grad = np.bincount(where, np.repeat(g, size), len(theta)) + decay * theta
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * (1 - (epoch - 1) / epochs) * np.sqrt(1 - 0.999**epoch) / (1 - 0.9**epoch)  # down to zero
        scale = np.sqrt(v) + 1e-5
        theta -= step * m / scale
        bias -= step * mb / (np.sqrt(vb) + 1e-5)
    scale, bias = calibrated(top, n_p, prior, bias)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = scale * theta
    return Toxicity(weights, bias, prior)


def evident(feature: np.ndarray, a: np.ndarray, b: np.ndarray, n_p: int, m: int, evidence: float) -> np.ndarray:
    """Features that more texts of P (``a`` of ``n_p``) have than their share in
    U (``b`` of ``m``) explains, by the likelihood ratio of two proportions."""
    pooled = (a + b) / (n_p + m)

    def term(k, p, q):
        return np.where(k > 0, k * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0)

    g = term(a, a / n_p, pooled) + term(n_p - a, 1 - a / n_p, 1 - pooled) + term(b, b / m, pooled) + term(m - b, 1 - b / m, 1 - pooled)
    return np.sort(feature[(2 * g >= evidence) & (a / n_p > b / m)].astype(np.int64))


def calibrated(top: np.ndarray, n_p: int, prior: float, bias: float, epochs: int = 2_000, rate: float = 0.02) -> tuple[float, float]:
    """Scale and bias of logits without penalties, by the same risk: the
    penalties shrink all logits towards the bias."""
    scale, m, v = 1.0, np.zeros(2), np.zeros(2)
    share = np.concatenate([np.full(n_p, 1 / n_p), np.full(len(top) - n_p, 1 / (len(top) - n_p))])
    for epoch in range(1, epochs + 1):
        logit = np.clip(scale * top + bias, -50, 50)
        p, soft = 1 / (1 + np.exp(-logit)), np.log1p(np.exp(logit))
        negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
        g = np.concatenate([prior * (p[:n_p] - 1) - prior * p[:n_p], p[n_p:]]) if negative >= 0 else np.concatenate([prior * p[:n_p], -p[n_p:]])
        g *= share
        grad = np.array([(g * top).sum(), g.sum()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - (epoch - 1) / epochs) * np.sqrt(1 - 0.999**epoch) / (1 - 0.9**epoch) * m / (np.sqrt(v) + 1e-8)
        scale, bias = max(scale - step[0], 1e-3), bias - step[1]
    return scale, bias


def sample_texts(docs: DataFrame, ids: DataFrame, n: int, positive: int) -> DataFrame:
    """(doc_id, text, positive): at most ``n`` of the given documents, drawn by
    hash of the id, whole, with one row each.  Only the drawn ids are broadcast."""
    picked = [(r.doc_id,) for r in drawn(ids.distinct(), n).collect()]
    some = docs.sparkSession.createDataFrame(picked, "doc_id long")
    got = docs.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return got.withColumn("positive", F.lit(positive))


def fit_toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Toxicity:
    """A classifier from documents (doc_id, text) and labels (doc_id, toxic)
    of the training fold."""
    docs = docs.select("doc_id", "text").where(train_fold() & F.col("text").isNotNull())
    known = labels.select("doc_id", "toxic").where(train_fold() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        row = known.agg(F.avg("toxic").alias("share")).first()
        prior = row.share if row.share is not None and 0 < row.share < 1 else DEFAULT_PRIOR
    toxic = docs.select("doc_id").join(known.where(F.col("toxic") == 1), "doc_id", "left_semi")
    texts = sample_texts(docs, toxic, POSITIVE_DOCS, 1).unionAll(sample_texts(docs, docs.select("doc_id"), UNLABELLED_DOCS, 0))
    return fit_pu(materialise(texts, "toxicity-sample", compact=True), float(prior))


RESULT = "doc_id long, held_out boolean, score double, predicted int"
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Score and prediction of every document."""
    shared = share(docs.sparkSession, model)

    def run(it):
        m = shared()
        for b in it:
            score = m.scores(b.column(1))
            yield batch(_RESULT, b.column(0), b.column(2), score, (score >= THRESHOLD).astype(np.int32))

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(tidy(run), RESULT)


def keeps_clean(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The documents predicted as not toxic, with all their columns."""
    return keep_rows(docs, "text", share(docs.sparkSession, model), lambda m, arr: m.scores(arr) < THRESHOLD)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
