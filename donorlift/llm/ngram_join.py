"""N-gram Jaccard join (operator 2): a prefix-tree join of shingle sets.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Two
documents link when 100 * |x and y| >= 75 * |x or y|, so |x and y| >=
3/7 (|x| + |y|), |x without y| + |y without x| <= (|x| + |y|) / 7, and sizes
lie within a factor of 4/3.

1. *Profiles.*  One pass gives every document its set's size and digest and
   counts shingles that recur inside a task.  Equal sets form a class; copies
   are never expanded.
2. *Candidates.*  In one global order (rare shingles first, recurring ones last
   by count; any order is right, this one keeps groups small) linked sets share
   a shingle among their first n - ceil(3n/4) + 1.  Classes that share such a
   shingle are brought together by a shuffle; shingles with the same members
   count as one group.  Inside a group an odd sketch (each shingle flips one of
   about n bits) gives a lower bound of the symmetric difference; classes
   within reach of each other are chained.  A group of over SPLIT_MEMBERS is
   cut into cells of two neighbouring sizes, and a cell that is still larger
   is joined to hubs without a comparison.  Components of all these are the
   candidate groups: all links lie inside one.  No task holds a hot shingle:
   the classes of recurring ones are dealt out in salted parts.
3. *Prefix trees.*  The sets of a group, in ascending order of hashes, form a
   radix tree whose inner edges hold shared beginnings once.  Every set walks
   it level by level; the overlap with an edge counts for all sets below it,
   and a subtree is left when the overlap plus what both sides have left, given
   the lengths below, cannot reach 3/7 (|x| + |y|).  Large groups are cut into
   size buckets and hashed blocks, and a tree and the queries of one pair of
   blocks meet in a task; nothing is dropped.
4. Links are counted with the sizes of their classes, and components of links
   carry the least doc_id.

Defined results: null and empty texts have an empty set and link with nothing;
under five words the whole sequence is the one shingle; repeated rows are
copies; a null doc_id gets no component and links with nothing; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from donorlift.llm.common import ASCII_LOWER, batch, byte_class, materialise, mix, row_blocks, share, table, text_buffer, tidy, word_bounds, word_hashes
from donorlift.llm.components import components
from donorlift.llm.queries import query

WORDS = 5
KEEP = byte_class(b" \t\n\x0b\x0c\r")
#: Shingles looked at together when recurring ones are counted in a task.
COUNT_CHUNK = 1_000_000
#: A shingle is reported with at least this count in a chunk, and is moved to
#: the end of the order with at least HEAVY in all.
REPORT, HEAVY = 3, 32
#: Bound of the broadcast table of recurring shingles.
HEAVY_ROWS = 200_000
#: Bits of a sketch, at least and at most; in between, at least one per shingle,
#: with which unrelated sets differ in about half of n bits and linked ones in
#: 2n/7 at most.
SKETCH_BITS = (256, 1 << 16)
#: Member classes whose ids are broadcast to their texts; more are joined by a
#: shuffle.
BROADCAST_MEMBERS = 100_000
#: Members up to which a group is split by sketches.
SPLIT_MEMBERS = 1_024
#: Members of a block of a large group, at least and at most.
BLOCK_MEMBERS = (64, 4_000)
#: Shingles of a block.
BLOCK_SHINGLES = 1_000_000
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text."""
    buf = ASCII_LOWER[buf]
    first, last, before = word_bounds(buf, offs, KEEP)
    h = word_hashes(buf, first, last)
    full = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        full += h[k : k + len(full)] * _ODD[k]
    full = mix(full)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            yield np.unique(full[lo : hi - WORDS + 1])
        elif hi > lo:
            own = np.array([hi - lo], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for k in range(hi - lo):
                own = own + h[lo + k : lo + k + 1] * _ODD[k]
            yield mix(own)
        else:
            yield np.zeros(0, np.uint64)


def sets_of(arr: pa.Array) -> Iterator[np.ndarray]:
    buf, offs = text_buffer(arr)
    for lo, hi in row_blocks(offs):
        yield from shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def class_key(d: bytes) -> int:
    """64 bits of a digest, used to find candidates only."""
    return int.from_bytes(d[:8], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Odd sketch: the bits that an odd number of shingles hash to."""
    width = SKETCH_BITS[0]
    while width < len(s) and width < SKETCH_BITS[1]:
        width *= 2
    flips = np.bincount((s >> np.uint64(7)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


# -- 1. profiles and classes --------------------------------------------------
_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("c", pa.int64()), ("sketch", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])
PROFILE = "doc_id long, n long, digest binary, c long, sketch binary, token long, count long"


def profiles(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n, digest, c, sketch) per document, and rows (token, count) of
    shingles that recur inside a chunk of a task."""

    def run(it):
        held, size = [], 0

        def report():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            on = counts >= REPORT
            k = int(on.sum())
            return batch(_PROFILE, *(pa.nulls(k, f.type) for f in list(_PROFILE)[:5]), tokens[on].view(np.int64), counts[on])

        for b in it:
            n, digests, bits, known = [], [], [], set()
            for s in sets_of(b.column(1)):
                d = digest(s)
                n.append(len(s))
                digests.append(d)
                bits.append(sketch(s))
                if d not in known:  # copies of a batch count once
                    known.add(d)
                    held.append(s)
                    size += len(s)
                    if size >= COUNT_CHUNK:
                        yield report()
                        held, size = [], 0
            yield batch(_PROFILE, b.column(0), n, digests, [class_key(d) for d in digests], bits, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()))
        if size:
            yield report()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PROFILE)


def recurring(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Recurring shingles (sorted) and their places in the order.  At most
    HEAVY_ROWS: those with counts of at least the smallest sufficient power of
    two."""
    total = materialise(counts.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= HEAVY).withColumn("b", F.floor(F.log2("count")).cast("int")), "recurring", compact=True)
    sizes = {r.b: r.c for r in total.groupBy("b").agg(F.count(F.lit(1)).alias("c")).collect()}
    least, rows = max(sizes, default=0) + 1, 0
    while least > 0 and rows + sizes.get(least - 1, 0) <= HEAVY_ROWS:
        least -= 1
        rows += sizes.get(least, 0)
    got = total.where(F.col("b") >= least).select("token", "count").toArrow()
    token, count = got.column("token").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.lexsort((token, count))
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(1, len(token) + 1)
    by_token = np.argsort(token)
    return token[by_token], place[by_token]


# -- 2. candidates -----------------------------------------------------------
_PREFIX = pa.schema([("token", pa.int64()), ("c", pa.int64()), ("hot", pa.bool_())])


def prefix_rows(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, c, hot): the first shingles of every class, once per task; hot
    are the recurring ones."""
    shared = share(docs.sparkSession, heavy)

    def run(it):
        tokens, place = shared()
        seen: set[bytes] = set()
        for b in it:
            out_t, out_c, out_h = [], [], []
            for s in sets_of(b.column(0)):
                if not len(s):
                    continue
                d = digest(s)
                if d in seen:
                    continue
                seen.add(d)
                p = prefix_length(len(s))
                rank = np.zeros(len(s), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, place[at], 0)
                    if rank.any():
                        order = np.argsort(rank, kind="stable")
                        s, rank = s[order], rank[order]
                out_t.append(s[:p])
                out_c.append(np.full(min(p, len(s)), class_key(d), np.int64))
                out_h.append(rank[:p] > 0)
            if out_t:
                yield batch(_PREFIX, np.concatenate(out_t).view(np.int64), np.concatenate(out_c), np.concatenate(out_h))

    return docs.select("text").mapInArrow(tidy(run), "token long, c long, hot boolean")


def candidate_groups(prefixes: DataFrame) -> DataFrame:
    """(g, k, c): classes by shared prefix shingle, k of them; shingles with the
    same members are one group (equal hash sums can only join groups).

    A shingle's rows meet in one task; those of a recurring one are dealt to
    several by class, and its at most HEAVY_ROWS sums are broadcast."""
    salts = 4 * prefixes.sparkSession.sparkContext.defaultParallelism
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("c"), F.lit(salts))).otherwise(0)
    part = Window.partitionBy("token", "salt")
    count, members = F.count(F.lit(1)), F.bit_xor(F.xxhash64("c"))
    once = prefixes.withColumn("salt", salt).withColumn("before", F.lag("c").over(part.orderBy("c"))).where(F.col("before").isNull() | (F.col("before") != F.col("c")))
    rows = once.select("token", "c", "hot", count.over(part).alias("k"), members.over(part).alias("g"))
    # dealt anew, so that few files do not mean few tasks for the windows
    rows = materialise(rows.where("hot or k > 1").repartition("c"), "prefixes", compact=True)
    often = rows.where("hot").select("token", "c")
    sums = often.groupBy("token").agg(count.alias("k"), members.alias("g"))
    shared = rows.where("not hot").select("g", "k", "c").unionAll(often.join(F.broadcast(sums), "token").where("k > 1").select("g", "k", "c"))
    return shared.select(F.xxhash64("g", "k").alias("g"), "k", "c").distinct()


def size_bucket() -> Column:
    """Linked sets have sizes within a factor of 4/3: their buckets are the same
    or neighbours."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + F.lit(1e-9)).cast("int")


def possible_links(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect whatever classes of a group may link."""
    large = groups.where(F.col("k") > SPLIT_MEMBERS).select("g", "c").join(classes.select("c", "n"), "c")
    cells = large.select("c", F.explode(F.array(F.xxhash64("g", size_bucket()), F.xxhash64("g", size_bucket() + 1))).alias("g"))
    cells = materialise(cells.distinct(), "cells", compact=True)
    sizes = cells.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    cells = cells.join(sizes, "g")
    few = groups.where(F.col("k") <= SPLIT_MEMBERS).select("g", "c").unionAll(cells.where(F.col("k") <= SPLIT_MEMBERS).select("g", "c"))
    return chains(few.join(classes.select("c", "n", "sketch"), "c")).unionAll(hubs(cells.where(F.col("k") > SPLIT_MEMBERS)))


def hubs(members: DataFrame) -> DataFrame:
    """Edges (a, b) that make one component of each group (g, c) of k members:
    salted parts of about SPLIT_MEMBERS around their least class, which are
    chained."""
    parts = F.ceil(F.col("k") / SPLIT_MEMBERS)
    salted = members.select("g", "c", F.pmod(F.xxhash64("c"), parts).alias("salt"))
    heads = salted.groupBy("g", "salt").agg(F.min("c").alias("hub"))
    last = F.lag("hub").over(Window.partitionBy("g").orderBy("salt"))
    between = heads.select(F.col("hub").alias("a"), last.alias("b")).where("b is not null")
    return salted.join(heads, ["g", "salt"]).select(F.col("c").alias("a"), F.col("hub").alias("b")).unionAll(between)


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with ``width`` words: halves are xored."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def reachable(n: np.ndarray, sketches: list[bytes]) -> list[np.ndarray]:
    """Members of a group, split into components of possible links."""
    words = np.array([len(s) // 8 for s in sketches])
    places = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    rows = {w: np.array([np.frombuffer(sketches[i], np.uint64) for i in at]) for w, at in places.items()}
    slot = np.empty(len(n), np.int64)
    for at in places.values():
        slot[at] = np.arange(len(at))
    free = np.ones(len(n), bool)
    out = []
    for root in range(len(n)):
        if not free[root]:
            continue
        free[root] = False
        part, todo = [root], [root]
        while todo:
            x = todo.pop()
            w = int(words[x])
            for other, at in places.items():
                at_free = at[free[at]]
                near = at_free[(4 * n[at_free] >= 3 * n[x]) & (3 * n[at_free] <= 4 * n[x])]
                if not len(near):
                    continue
                low = min(w, other)
                apart = np.bitwise_count(fold(rows[other][slot[near]], low) ^ fold(rows[w][slot[x]][None], low)).sum(1, dtype=np.int64)
                hit = near[7 * apart <= n[near] + n[x]]
                free[hit] = False
                part += hit.tolist()
                todo += hit.tolist()
        if len(part) > 1:
            out.append(np.sort(np.array(part)))  # groups of much the same members then give the same chains
    return out


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def chains(members: DataFrame) -> DataFrame:
    """Edges (a, b) that chain the classes of each group (g, c, n, sketch)
    which may link; rows come sorted by group, one group at a time is held."""

    def run(it):
        group, c, n, bits = None, [], [], []

        def close():
            if len(c) < 2:
                return
            for part in reachable(np.array(n), bits):
                ids = np.array(c)[part]
                yield batch(_EDGE, ids[:-1], ids[1:])

        for b in it:
            for g, cc, nn, ss in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if g != group:
                    yield from close()
                    group, c, n, bits = g, [], [], []
                c.append(cc)
                n.append(nn)
                bits.append(ss)
        yield from close()

    return members.select("g", "c", "n", "sketch").repartition(F.col("g")).sortWithinPartitions("g", "c").mapInArrow(tidy(run), "a long, b long")


# -- 3. prefix trees -----------------------------------------------------------
class PrefixTree:
    """Radix tree of sorted sets; edges are ordered by level."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.vocabulary = np.unique(np.concatenate(sets))
        path = [np.searchsorted(self.vocabulary, sets[i]) for i in order]
        # a node: parent, depth at its end, first and last set below, a set through it
        parent, depth, lo, hi, sample = [-1], [0], [0], [0], [0]
        stack = [0]
        for k, seq in enumerate(path):
            common = 0
            if k:
                m = min(len(seq), len(path[k - 1]))
                apart = np.flatnonzero(seq[:m] != path[k - 1][:m])
                common = int(apart[0]) if len(apart) else m
            child = -1
            while depth[stack[-1]] > common:
                child = stack.pop()
                hi[child] = k - 1
            if depth[stack[-1]] < common:  # cut the edge to ``child``
                parent.append(stack[-1])
                depth.append(common)
                lo.append(lo[child])
                hi.append(0)
                sample.append(k - 1)
                parent[child] = len(parent) - 1
                stack.append(len(parent) - 1)
            if len(seq) > common:
                parent.append(stack[-1])
                depth.append(len(seq))
                lo.append(k)
                hi.append(k)
                sample.append(k)
                stack.append(len(parent) - 1)
        while stack:
            hi[stack.pop()] = len(path) - 1
        self.order, self.size = np.array(order), np.array([len(p) for p in path])
        parent, depth = np.array(parent), np.array(depth)
        children: dict[int, list[int]] = {}
        for node, up in enumerate(parent.tolist()):
            children.setdefault(up, []).append(node)
        self.parent, self.depth, self.lo, self.hi = parent, depth, np.array(lo), np.array(hi)
        self.children = [np.array(children.get(k, []), np.int64) for k in range(len(parent))]
        self.roots = self.children[0]
        pieces, begin, at = [], np.zeros(len(parent) + 1, np.int64), 0
        for k in range(1, len(parent)):
            piece = path[sample[k]][depth[parent[k]] : depth[k]]
            pieces.append(piece)
            begin[k] = at
            at += len(piece)
        begin[len(parent)] = at
        begin[0] = 0
        self.tokens = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        self.begin = begin
        self.last = np.array([0] + [p[-1] for p in pieces], np.int64)
        self.least = np.array([self.size[a : z + 1].min() for a, z in zip(self.lo, self.hi, strict=True)])
        self.most = np.array([self.size[a : z + 1].max() for a, z in zip(self.lo, self.hi, strict=True)])
        # the leaf that ends at a node, if one does
        self.leaf = np.full(len(parent), -1)
        for k in range(1, len(parent)):
            if self.size[self.lo[k]] == depth[k]:
                self.leaf[k] = self.lo[k]
        self.flags = np.zeros(len(self.vocabulary) + 1, np.int64)

    def linked(self, x: np.ndarray) -> np.ndarray:
        """Places of the sets that link with ``x``."""
        n = len(x)
        at = np.searchsorted(self.vocabulary, x)
        inside = at < len(self.vocabulary)
        inside[inside] = self.vocabulary[at[inside]] == x[inside]
        own = at[inside]
        self.flags[own] = 1
        found = []
        nodes, matched = self.roots, np.zeros(len(self.roots), np.int64)
        while len(nodes):
            fit = (4 * self.most[nodes] >= 3 * n) & (3 * self.least[nodes] <= 4 * n)
            nodes, matched = nodes[fit], matched[fit]
            if not len(nodes):
                break
            lo = self.begin[nodes]
            size = self.begin[nodes + 1] - lo
            ahead = np.cumsum(size) - size
            where = np.arange(int(size.sum())) + np.repeat(lo - ahead, size)
            matched = matched + np.add.reduceat(self.flags[self.tokens[where]], ahead)
            depth = self.depth[nodes]
            ends = self.leaf[nodes]
            done = (ends >= 0) & (7 * matched >= 3 * (n + depth))
            found.append(ends[done])
            left = len(own) - np.searchsorted(own, self.last[nodes], "right")
            best = np.clip(depth + left, self.least[nodes], self.most[nodes])
            alive = 7 * (matched + np.minimum(left, best - depth)) >= 3 * (n + best)
            nodes, matched = nodes[alive], matched[alive]
            below = [self.children[k] for k in nodes.tolist()]
            matched = np.repeat(matched, [len(c) for c in below])
            nodes = np.concatenate(below) if below else nodes
        self.flags[own] = 0
        return self.order[np.concatenate(found)] if found else np.zeros(0, np.int64)


def linked_blocks(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of members (or inside one, if they are the
    same): weighted numbers of links, and component labels (least place)."""
    links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    tree = PrefixTree([sets[k] for k in right])
    inside = len(left) == len(right) and bool((left == right).all())
    for x in left.tolist():
        hit = right[tree.linked(sets[x])]
        if inside:
            hit = hit[hit != x]
            links[x] += weights[hit].sum()
        else:
            links[x] += weights[hit].sum()
            links[hit] += weights[x]
        if len(hit):
            old = np.unique(np.append(label[hit], label[x]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return links, label


_TILE = pa.schema([("digest", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _tile(rows: pa.Table) -> pa.Table:
    """One task's groups or pair of blocks: links and roots of the members."""
    digests = rows.column("digest").to_pylist()
    raw = rows.column("tokens").to_pylist()
    sets = [np.frombuffer(t, np.uint64) for t in raw]
    weights = rows.column("copies").to_numpy()
    group, side = np.array(rows.column("part").to_pylist()), rows.column("side").to_numpy()
    out_d, out_l, out_r = [], [], []
    order = np.argsort(group, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        at = np.array(sorted(at.tolist(), key=digests.__getitem__))
        here, w, s = [sets[k] for k in at], weights[at], side[at]
        everyone = np.arange(len(at))
        left, right = everyone[(s == 0) | (s == 1)], everyone[(s == 0) | (s == 2)]
        if not len(left) or not len(right):
            continue
        links, label = linked_blocks(here, w, left, right)
        out_d += [digests[k] for k in at]
        out_l += links.tolist()
        out_r += [digests[k] for k in at[label]]
    return pa.table([pa.array(out_d, pa.binary()), pa.array(out_l, pa.int64()), pa.array(out_r, pa.binary())], schema=_TILE)


_MEMBER = pa.schema([("digest", pa.binary()), ("sg", pa.int64()), ("n", pa.int64()), ("copies", pa.int64()), ("tokens", pa.binary())])


def member_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The shingle set of every member class (digest, doc_id, sg, n, copies),
    made again from the text of one of its documents."""

    def run(it):
        for b in it:
            keep, tokens = [], []
            want = b.column(1).to_pylist()
            for k, s in enumerate(sets_of(b.column(0))):
                if digest(s) == want[k]:  # an id may stand for other texts, too
                    keep.append(k)
                    tokens.append(s.tobytes())
            some = b.take(pa.array(keep, pa.int64()))
            yield batch(_MEMBER, some.column(1), some.column(2), some.column(3), some.column(4), tokens)

    few = members.count() <= BROADCAST_MEMBERS
    members = members.withColumnRenamed("rep", "doc_id")
    joined = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(members) if few else members, "doc_id")
    return joined.select("text", "digest", "sg", "n", "copies").mapInArrow(tidy(run), "digest binary, sg long, n long, copies long, tokens binary")


def tiles(members: DataFrame) -> DataFrame:
    """Rows (tile, part, side) of every member: small groups share tiles; of a
    large one, each member goes to every pair of blocks that it can link in.
    side: 0 queries and tree, 1 queries, 2 tree."""
    rows = members.withColumn("bucket", size_bucket())
    groups = rows.groupBy("sg").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    least, most = BLOCK_MEMBERS
    block = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), 1.5 * F.sqrt("size")))
    groups = groups.withColumn("block", block).withColumn("large", (F.col("size") > F.col("block")) | (F.col("shingles") > BLOCK_SHINGLES))
    cells = rows.groupBy("sg", "bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).join(groups.where("large").select("sg", "block"), "sg")
    cells = cells.select("sg", "bucket", F.ceil(F.greatest(F.col("size") / F.col("block"), F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    by = Window.partitionBy("sg").orderBy("bucket")  # a few dozen buckets in a group
    cells = cells.withColumn("down", F.when(F.lag("bucket").over(by) == F.col("bucket") - 1, F.lag("blocks").over(by)).otherwise(0)).withColumn("up", F.when(F.lead("bucket").over(by) == F.col("bucket") + 1, F.lead("blocks").over(by)).otherwise(0))
    n_members = groups.agg(F.sum("size").alias("n")).first().n or 0
    batches = max(1, n_members // least)
    small = rows.join(groups.where("not large").select("sg"), "sg").select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("sg"), F.lit(batches)).cast("string")).alias("tile"), F.col("sg").alias("part"), F.lit(0).alias("side"), "digest", "copies", "n")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    large = rows.join(cells, ["sg", "bucket"]).withColumn("h", own)
    key = lambda b1, h1, b2, h2: F.concat_ws("-", F.col("sg"), b1, h1, b2, h2)
    same = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(key(F.col("bucket"), F.least("h", o), F.col("bucket"), F.greatest("h", o)).alias("tile"), F.when(o == F.col("h"), 0).when(F.col("h") < o, 1).otherwise(2).alias("side")))
    above = F.transform(F.when(F.col("up") > 0, F.sequence(F.lit(0), F.col("up") - 1)).otherwise(F.array().cast("array<int>")), lambda o: F.struct(key(F.col("bucket"), F.col("h"), F.col("bucket") + 1, o).alias("tile"), F.lit(1).alias("side")))
    below = F.transform(F.when(F.col("down") > 0, F.sequence(F.lit(0), F.col("down") - 1)).otherwise(F.array().cast("array<int>")), lambda o: F.struct(key(F.col("bucket") - 1, o, F.col("bucket"), F.col("h")).alias("tile"), F.lit(2).alias("side")))
    large = large.withColumn("t", F.explode(F.concat(same, above, below))).select("t.tile", F.col("sg").alias("part"), "t.side", "digest", "copies", "n")
    return small.unionAll(large)


def jaccard_links(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links."""
    docs = docs.select("doc_id", "text")
    first = materialise(profiles(docs), "profiles")
    rows = first.where(F.col("digest").isNotNull())
    linkable = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = [F.first(k).alias(k) for k in ("n", "c", "sketch")]
    classes = materialise(linkable.groupBy("digest").agg(*same, F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes", compact=True)

    heavy = recurring(first.where(F.col("token").isNotNull()).select("token", "count"))
    groups = materialise(candidate_groups(prefix_rows(docs, heavy)), "groups", compact=True)
    near = components(possible_links(groups, classes), 2 * groups.count())  # a class is in two cells of a group at most
    members = classes.join(near.select(F.col("node").alias("c"), F.col("label").alias("sg")), "c")
    members = materialise(members.select("digest", "rep", "sg", "n", "copies"), "members", compact=True)

    sets = member_sets(docs, members)
    # a repeated id brings its text more than once: one set per class
    full = tiles(members).join(sets.select("digest", "tokens").dropDuplicates(["digest"]), "digest").select("tile", "part", "side", "digest", "copies", "tokens")
    found = materialise(full.groupBy("tile").applyInArrow(lambda t: _tile(t), "digest binary, links long, root binary"), "links", compact=True)

    counted = found.groupBy("digest").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")), found.count())
    linked = classes.join(comp.select(F.col("node").alias("digest"), "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    heads = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = linked.join(heads, "label").join(counted, "digest", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    special = known.where((F.col("copies") > 1) | (F.col("component_id") != F.col("rep")) | (F.col("links") > 0))
    special = materialise(special.select("digest", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "linked", compact=True)

    out = linkable.join(special, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = rows.where((F.col("n") == 0) | F.col("doc_id").isNull())
    return out.unionAll(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least doc_id, with all
    its columns; documents without a doc_id stay.  Of rows with equal id and
    text one stays: that with the least hash of the other columns."""
    heads = jaccard_links(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__head")).distinct()
    kept = docs.join(heads, docs["doc_id"] == F.col("__head"), "left_semi")
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    if rest:
        others = F.struct(*[F.col(f"`{c}`") for c in rest])
        kept = kept.groupBy("doc_id", "text").agg(F.min_by(others, F.xxhash64(F.to_json(others))).alias("__rest"))
        kept = kept.select(*[F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns])
    else:
        kept = kept.distinct()
    return kept.unionAll(docs.where(F.col("doc_id").isNull()))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = w.doc_id), doc_id)) AS component_id,
  (SELECT count(*) FROM l WHERE l.x = w.doc_id) AS n_links
FROM w LEFT JOIN n USING (doc_id)
"""


@query("op2_ngram_join", SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents", "doc_id", "text"))
