"""N-gram Jaccard join with signature trees.

1. Sets.  A document's set is its distinct word shingles, as 64-bit hashes.
   Equal sets are one class, named by a hash of the set, so copies cost one
   set wherever they are.
2. Candidate groups.  Two sets that reach the similarity differ in at most k
   shingles, k known from their sizes.  Shingles are dealt by hash into m > k
   segments, so at least m - k segments are equal in both sets; sets that share
   the hash of a segment meet in a group.  Sizes fall into levels, and a set
   near a level's lower end also joins the level below, so sizes that may link
   always share a level.  A set with too few filled segments to be sure of a
   filled equal one also deals every shingle on its own, and two such sets then
   meet by a shingle.  No pair is lost.
   Segment hashes travel in blobs by hash range.  A segment that more than
   `BLOCK` sets share says little: texts with one passage in common have it, and
   no task may compare all of them.  Its sets are hot.  Two hot sets meet anew
   by rarity: shingles are ordered by an estimate of the number of hot sets that
   have them (a sketch of `SLOTS` counters; any order is right, a good one is
   fast), and linked sets share one of their few first, rarest shingles (prefix
   filter).  Groups of a rare shingle that are still larger than `BLOCK` are near
   copies nearly always; they are dealt into blocks that hold the same few sets,
   the pivots, and no task gathers such a group.
3. Trees.  The sets of a group get bitmaps of their shingles; a tree's nodes
   hold the OR of the bitmaps below and the range of sizes.  Two trees (or one
   with itself) are walked together, and a pair of nodes is left as soon as the
   largest overlap that its bitmaps and sizes allow is too small, or when all
   sets below both are linked already.  Leaves are compared exactly.
   Groups are walked twice: first on bitmaps alone, which travel with the
   classes and are a thirtieth of the sets' size, so that sets which only share
   a common passage part again; then with the sets of what is left.
   Sets that groups still connect are a cluster.  A cluster of up to `CLUSTER_BYTES`
   goes to a task whole, so each set travels once, unless one of its groups has
   more than `MERGED` sets.  In other clusters every group travels by itself, a
   large one in its blocks; in a second round the sets that are still apart from
   their group's largest component are walked against all of the group, a pair
   of blocks a task.
4. Components.  Links between classes make components; documents get the
   smallest doc_id of theirs.

Defined results: a document without words (or with a null text) has an empty
set and is linked with nothing; a null doc_id takes part, but can't name a
component (null if no other id is there); repeated rows are copies; other
columns are not read.  Two different sets would be taken for one only if their
64-bit hashes met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import SpanHasher, chunks, counters, mix, pack48, shingles, text_bytes, trim, unpack48, written
from .components import components

PID_BYTES = 32 << 20
BLOCK = 256
PIVOTS = 32
FLUSH_ENTRIES = 2_000_000
CLUSTER_BYTES = 32 << 20
BIN_BYTES = 8 << 20
MERGED = 4096
SLOTS = 1 << 20
NARROW_GROUPS = 4000
NARROW_PAIRS = 500_000
BROADCAST_ROWS = 1_000_000
STEP = 1.5
LOW48 = np.uint64((1 << 48) - 1)
LONGS = pa.list_(pa.int64())
MAPPED = pa.schema([("pid", pa.int32()), ("sigs", pa.binary()), ("keys", pa.binary()), ("hot", pa.binary()), ("docs", LONGS), ("sizes", LONGS), ("rks", LONGS), ("bits", pa.list_(pa.binary())), ("bucket", pa.int64()), ("part", pa.int64()), ("members", LONGS)])
REDUCED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("rk", pa.int64()), ("bits", pa.binary()), ("bucket", pa.int64()), ("part", pa.int64()), ("large", pa.bool_()), ("members", LONGS)])


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num / den, in whole numbers."""

    num: int
    den: int

    def reached(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least_overlap(self, a, b):
        """The least overlap that sizes a and b need."""
        return -(-(self.num * (a + b)) // (self.num + self.den))

    def most_apart(self, size: int) -> int:
        """The most shingles in one of two linked sets only, the smaller having at most `size`."""
        return floor(size * (self.den - self.num) / self.num + 1e-9)


@dataclass(frozen=True)
class Levels:
    """Size levels: lows[i] <= size < lows[i + 1], and each level's number of segments."""

    lows: np.ndarray
    segments: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(sim: Similarity, largest: int) -> Levels:
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, ceil(lows[-1] * STEP)))
        apart = np.array([sim.most_apart(hi - 1) for hi in lows[1:]] + [sim.most_apart(ceil(lows[-1] * STEP))])
        return Levels(np.array(lows), apart + 1 + np.maximum(2, (apart + 1) // 6), apart)

    def for_size(self, n: int, sim: Similarity) -> list[int]:
        """A set's own level, and those below from which a smaller set may reach it."""
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        out = [own]
        least = ceil(n * sim.num / sim.den - 1e-9)
        while out[-1] > 0 and self.lows[out[-1]] > least:
            out.append(out[-1] - 1)
        return out


def class_key(u: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(u, 21).sum(dtype=np.uint64) ^ np.uint64(len(u))], dtype=np.uint64), 22)[0]


def segment_hashes(u: np.ndarray, levels: Levels, sim: Similarity) -> list[np.ndarray]:
    """Hashes of the filled segments of a sorted set, for each of its levels."""
    out = []
    mixed = mix(u, 23)
    high = u >> np.uint64(32)
    for level in levels.for_size(len(u), sim):
        if not levels.apart[level]:  # only equal sets are linked, and they are one class
            continue
        m = np.uint64(levels.segments[level])
        seg = (high * m) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        with np.errstate(over="ignore"):
            out.append(mix(np.add.reduceat(mixed, first) + seg[first] * np.uint64(0x9FB21C651E98DF25), 100 + level))
        if len(first) <= levels.apart[level]:  # a filled equal segment isn't sure
            out.append(mix(u, 5000 + level))
    return out


def mapped(**cols) -> pa.RecordBatch:
    size = len(cols["pid"])
    return pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * size), f.type) for f in MAPPED], schema=MAPPED)


class Postings:
    """The (hash, class) entries of a task, sent on by hash range in blobs; of hashes that too many classes share, blocks."""

    def __init__(self, pids: int) -> None:
        from pyspark import TaskContext

        self.pids, self.task = pids, TaskContext.get().partitionId()
        self.sigs: list[np.ndarray] = []
        self.keys: list[np.uint64] = []
        self.count = self.flushes = 0

    def add(self, sigs: np.ndarray, key: np.uint64) -> None:
        self.sigs.append(sigs)
        self.keys.append(key)
        self.count += len(sigs)

    @property
    def full(self) -> bool:
        return self.count >= FLUSH_ENTRIES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        s = np.concatenate(self.sigs)
        k = np.concatenate([np.full(len(a), b, dtype=np.uint64) for a, b in zip(self.sigs, self.keys, strict=True)])
        self.sigs.clear(), self.keys.clear()
        self.count, self.flushes = 0, self.flushes + 1
        order = np.argsort(s, kind="stable")
        s, k = s[order], k[order]
        pid = ((s >> np.uint64(32)) * np.uint64(self.pids)) >> np.uint64(32)
        run = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        go, hot = np.ones(len(s), dtype=bool), []
        for g in np.flatnonzero(np.diff(run) > BLOCK).tolist():
            i, j = run[g], run[g + 1]
            bucket = large_bucket(s[i] & LOW48, int(pid[i]))
            for part, _, members in blocks_of(k[i:j].view(np.int64)):
                yield mapped(pid=[-1 - self.task % self.pids], bucket=[bucket], part=[(self.task << 40) + (self.flushes << 20) + part], members=[members])
            pivots = pivots_of(k[i:j].view(np.int64)).view(np.uint64)
            k[i : i + len(pivots)] = pivots
            go[i + len(pivots) : j] = False
            hot.append(i)
        hot_at = np.zeros(len(s), dtype=bool)
        hot_at[hot] = True
        s, k, pid, hot_at = s[go], k[go], pid[go], hot_at[go]
        cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1], [True]]))
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        yield mapped(pid=pid[cut[:-1]].astype(np.int32), sigs=[pack48(s[i:j]) for i, j in spans], keys=[k[i:j].tobytes() for i, j in spans], hot=[pack48(s[i:j][hot_at[i:j]]) for i, j in spans])


def map_sets(width: int, sim: Similarity, pids: int):
    """Batches of (doc_id, text) to rows: pid >= 0 blobs of segment hashes, pid < 0 the documents' sizes and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels, out, met = SpanHasher(), Levels.of(sim, 1 << 34), Postings(pids), set()
        for batch in batches:
            doc, rk = batch.column("doc_id"), batch.column("rk").to_numpy()
            for c in chunks(batch.column("text")):
                h, first = shingles(c, hasher, width)
                size, named, bits = np.zeros(c.n, dtype=np.int64), np.zeros(c.n, dtype=np.uint64), [b""] * c.n
                for r in np.flatnonzero(np.diff(first)).tolist():
                    u = np.unique(h[first[r] : first[r + 1]])
                    key = class_key(u)
                    size[r], named[r] = len(u), key
                    if int(key) in met:
                        continue
                    met.add(int(key))
                    bits[r] = signature(u)
                    for x in segment_hashes(u, levels, sim):
                        out.add(x, key)
                yield mapped(pid=[-1 - out.task % pids], keys=[named.tobytes()], docs=[doc.slice(c.first, c.n).to_pylist()], sizes=[size], rks=[rk[c.first : c.first + c.n]], bits=[bits])
                if out.full:
                    yield from out.flush()
                    met.clear()
        yield from out.flush()
        trim()

    return run


# ------------------------------------------------------------ the rarest shingles
def slots(u: np.ndarray) -> np.ndarray:
    return (mix(u, 42) % np.uint64(SLOTS)).astype(np.int64)


def rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of sets (key, shingles) each of SLOTS counters got."""
    return counters(sets.select("shingles"), lambda b: (slots(np.frombuffer(x.as_buffer(), dtype=np.uint64)) for x in b.column("shingles")), SLOTS)


def rarest(u: np.ndarray, counts: np.ndarray, sim: Similarity) -> np.ndarray:
    """The first shingles of a set by rarity, as many as make sure that linked sets share one."""
    first = len(u) - -(-sim.num * len(u) // sim.den) + 1
    return u[np.lexsort((u, counts[slots(u)]))[:first]]


def map_rarest(counts: np.ndarray, sim: Similarity, pids: int):
    """Batches of (key, shingles) to blobs of the rarest shingles, as map_sets sends those of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Postings(pids)
        for b in batches:
            for key, x in zip(b.column("key").to_numpy().view(np.uint64), b.column("shingles"), strict=True):
                out.add(mix(rarest(np.frombuffer(x.as_buffer(), dtype=np.uint64), counts, sim), 41), key)
                if out.full:
                    yield from out.flush()
        yield from out.flush()
        trim()

    return run


def large_bucket(low: np.uint64, pid: int) -> int:
    """The id of a segment's group where some task had too many of its sets."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([low + np.uint64(pid) * np.uint64(0x9FB21C651E98DF25)], dtype=np.uint64), 34).view(np.int64)[0])


def reduce_groups(table: pa.Table) -> pa.Table:
    """Rows of one pid to documents (kind 0) or candidate groups (kind 1: bucket, part, large, members)."""
    pid = table.column("pid")[0].as_py()
    if pid < 0:
        ready = table.filter(table.column("members").is_valid())
        table = table.filter(table.column("docs").is_valid())
        doc = [d for x in table.column("docs").to_pylist() for d in x]
        n, rk = (table.column(x).combine_chunks().flatten() for x in ("sizes", "rks"))
        key = np.frombuffer(b"".join(x.as_py() for x in table.column("keys")), dtype=np.int64)
        first = pa.table({"kind": np.zeros(len(doc), np.int32), "doc_id": pa.array(doc, pa.int64()), "n": n, "key": key, "rk": rk, "bits": table.column("bits").combine_chunks().flatten()})
        more = pa.table({"kind": np.ones(len(ready), np.int32), "bucket": ready.column("bucket"), "part": ready.column("part"), "large": pa.array([True] * len(ready), pa.bool_()), "members": ready.column("members")})
        return pa.concat_tables([first, more], promote_options="default").select(REDUCED.names).cast(REDUCED)
    s = unpack48(b"".join(x.as_py() for x in table.column("sigs")))
    k = np.frombuffer(b"".join(x.as_py() for x in table.column("keys")), dtype=np.int64)
    hot = set(unpack48(b"".join(x.as_py() for x in table.column("hot"))).tolist())
    order = np.lexsort((k, s))
    s, k = s[order], k[order]
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
    s, k = s[fresh], k[fresh]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    many = np.flatnonzero(np.diff(cut) > 1)
    named = mix(k.view(np.uint64), 31)
    out, done = [], set()
    for g in many.tolist():
        a, b = cut[g], cut[g + 1]
        large = b - a > BLOCK or bool(hot) and int(s[a]) in hot
        with np.errstate(over="ignore"):
            bucket = large_bucket(s[a], pid) if large else int(mix(np.array([named[a:b].sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64), 32).view(np.int64)[0])
        if bucket not in done:
            done.add(bucket)
            out += [(bucket, -1 - part, large, members) for part, _, members in blocks_of(k[a:b])]
    cols = list(zip(*out, strict=True)) or [[]] * 4
    size = len(out)
    return pa.table([pa.array(np.ones(size, np.int32)), *(pa.nulls(size, pa.int64()) for _ in range(4)), pa.nulls(size, pa.binary()), *(pa.array(list(x), REDUCED.field(n).type) for x, n in zip(cols, ("bucket", "part", "large", "members"), strict=True))], schema=REDUCED)


def signature(u: np.ndarray) -> bytes:
    """A bitmap of a set's shingles: the power of two at or above twice its size in bits, 64 at least."""
    width = max(64, 1 << int(2 * len(u) - 1).bit_length())
    flags = np.zeros(width, dtype=np.uint8)
    flags[(u & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps at the width of the narrowest."""
    w = min(map(len, bits))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, dtype=np.uint8).reshape(-1, w), axis=0) for b in bits]).view(np.uint64)


def narrow(sim: Similarity):
    """Rows (bucket, key, n, bits) of groups to the smaller groups whose bitmaps allow links."""

    def run(table: pa.Table) -> pa.Table:
        bucket, key, n = (table.column(c).to_numpy() for c in ("bucket", "key", "n"))
        bits = [x.as_py() for x in table.column("bits")]
        order = np.lexsort((key, bucket))
        cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
        out: list[np.ndarray] = []
        seen = set()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows = order[a:b]
            maps, size = folded([bits[i] for i in rows]), n[rows]
            label = np.arange(len(rows))
            if len(rows) == 2:
                most = np.bitwise_count(maps[0] & maps[1]).sum() + (size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)).min()
                pairs = [(0, 1)] if min(int(most), int(size.min())) >= sim.least_overlap(int(size[0]), int(size[1])) else []
            else:
                pairs = tree_links(sim, None, label, None, True, maps, size)
            for i, j in pairs:
                label[label == label[j]] = label[i]
            for x in {int(label[i]) for i, _ in pairs}:
                members = np.sort(key[rows[label == x]])
                if members.tobytes() not in seen:
                    seen.add(members.tobytes())
                    out.append(members)
        named = [int(mix(np.array([mix(m.view(np.uint64), 31).sum(dtype=np.uint64) + np.uint64(len(m))], dtype=np.uint64), 35).view(np.int64)[0]) for m in out]
        return pa.table({"bucket": pa.array(named, pa.int64()), "part": pa.array([0] * len(out), pa.int64()), "large": pa.array([False] * len(out), pa.bool_()), "members": pa.array(out, LONGS)})

    return run


def pivots_of(keys: np.ndarray) -> np.ndarray:
    return keys[np.argsort(mix(keys.view(np.uint64), 33))[:PIVOTS]]


def blocks_of(keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, parts, members): all keys, or blocks of them that share pivots."""
    if len(keys) <= BLOCK:
        yield 0, 1, keys
        return
    order = keys[np.argsort(mix(keys.view(np.uint64), 33))]
    pivots, rest = order[:PIVOTS], order[PIVOTS:]
    parts = -(-len(rest) // (BLOCK - PIVOTS))
    for p in range(parts):
        yield p, parts, np.concatenate([pivots, rest[p::parts]])


# ------------------------------------------------------------------ the trees
class SignatureTree:
    """Nodes by level, leaves first; node i of a level is over nodes [i * fan, (i + 1) * fan) of the level below."""

    FAN = 8

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray) -> None:
        excess = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)  # shingles whose bit another has set
        self.levels = [(bitmaps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, more = self.levels[-1]
            at = np.arange(0, len(bits), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def below(self, level: int, node: int) -> range:
        return range(node * self.FAN, min((node + 1) * self.FAN, len(self.levels[level - 1][0])))


def bitmaps_of(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of the shingles, about four bits for one of the largest set's."""
    bits = 1 << max(8, int(np.ceil(np.log2(4 * max(map(len, sets))))))
    bits = min(bits, 1 << 16)
    out = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for i, u in enumerate(sets):
        b = (u & np.uint64(bits - 1)).astype(np.int64)
        flags = np.zeros(bits, dtype=np.uint8)
        flags[b] = 1
        out[i] = np.packbits(flags)
    return out.view(np.uint64)


def tree_links(sim: Similarity, sets: list[np.ndarray] | None, label: np.ndarray, split: int | None = None, spanning: bool = True, bits: np.ndarray | None = None, size: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, by a walk of one tree with itself or, given split, of the trees of [0, split) and [split, end).

    Sets of equal label are linked already.  spanning: enough links to connect
    whatever is linked; otherwise every link.  Without sets, from bitmaps and
    sizes: pairs that may be linked.
    """
    if sets is not None:
        size, bits = np.array([len(u) for u in sets]), bitmaps_of(sets)
    order = np.lexsort(([int(u[0]) for u in sets], size)) if sets is not None else np.argsort(size, kind="stable")
    sides = [order] if split is None else [order[order < split], order[order >= split]]
    trees = [SignatureTree(size[o], bits[o]) for o in sides if len(o)]
    if len(trees) < len(sides):
        return []
    lab, links = label.copy(), []
    left, right = trees[0], trees[-1]
    lo, ro = sides[0], sides[-1]
    same = split is None

    def one_component(ll: int, l: int, lr: int, r: int) -> bool:
        a, b = SignatureTree.FAN**ll, SignatureTree.FAN**lr
        first = lab[lo[l * a]]
        return bool((lab[lo[l * a : (l + 1) * a]] == first).all() and (lab[ro[r * b : (r + 1) * b]] == first).all())

    def leaves(ls: np.ndarray, rs: np.ndarray) -> None:
        """All pairs below two nodes: bounds at once, then exact comparison of what they allow."""
        bl, size_l, _, more_l = (x[ls] for x in left.levels[0])
        br, size_r, _, more_r = (x[rs] for x in right.levels[0])
        most = np.bitwise_count(bl[:, None] & br[None]).sum(axis=2, dtype=np.int64) + np.minimum(more_l[:, None], more_r[None])
        most = np.minimum(most, np.minimum(size_l[:, None], size_r[None]))
        for x, y in zip(*np.nonzero(most >= sim.least_overlap(size_l[:, None], size_r[None])), strict=True):
            i, j = int(lo[ls[x]]), int(ro[rs[y]])
            if same and ls[x] >= rs[y] or label[i] == label[j] or spanning and lab[i] == lab[j]:
                continue
            if sets is None or sim.reached(overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                links.append((i, j))
                if spanning:
                    lab[lab == lab[j]] = lab[i]

    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        ll, l, lr, r = stack.pop()
        bl, lowl, highl, morel = left.levels[ll]
        br, lowr, highr, morer = right.levels[lr]
        if highl[l] * sim.den < lowr[r] * sim.num or highr[r] * sim.den < lowl[l] * sim.num:
            continue
        most = min(int(np.bitwise_count(bl[l] & br[r]).sum()) + max(int(morel[l]), int(morer[r])), int(highl[l]), int(highr[r]))
        if most < sim.least_overlap(int(lowl[l]), int(lowr[r])):
            continue
        if spanning and one_component(ll, l, lr, r):
            continue
        if ll <= 1 and lr <= 1:
            leaves(np.array(left.below(1, l) if ll else [l]), np.array(right.below(1, r) if lr else [r]))
        elif same and ll == lr and l == r:
            kids = left.below(ll, l)
            stack += [(ll - 1, a, lr - 1, b) for a in kids for b in kids if a <= b]
        elif ll >= lr:
            stack += [(ll - 1, a, lr, r) for a in left.below(ll, l)]
        else:
            stack += [(ll, l, lr - 1, b) for b in right.below(lr, r)]
    return links


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


# -------------------------------------------------------------- the operator
class NgramJoin:
    """The join's tables: documents (doc_id, n, key), links (a, b) between classes, and classes' components."""

    def __init__(self, docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), spanning: bool = True) -> None:
        self.width, self.sim, self.spanning = width, Similarity(*similarity), spanning
        self.slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rk"), "text")
        pids = max(8, -(-text_bytes(self.slim) // PID_BYTES))
        blobs = self.slim.mapInArrow(map_sets(width, self.sim, pids), from_arrow_schema(MAPPED))
        both = written(blobs.groupBy("pid").applyInArrow(reduce_groups, from_arrow_schema(REDUCED)), "join")
        self.documents = both.where("kind = 0").select("doc_id", "n", "key", "rk")
        self.maps = both.where("kind = 0 and length(bits) > 0").select("key", "n", "bits").dropDuplicates(["key"])
        groups = written(self._narrowed(both), "groups")
        hot = written(both.where("kind = 1 and large").select(F.explode("members").alias("key")).distinct(), "hot")
        self.wanted = groups.select(F.explode("members").alias("key")).unionByName(hot).distinct()
        self.sets = self._sets()
        groups = written(groups.unionByName(self._rare_groups(hot)).dropDuplicates(["bucket", "part"]).withColumn("lead", F.element_at("members", 1)), "groups")
        spread = groups.select("bucket", "part", "large", "lead", F.explode("members").alias("key"))
        # Sets that groups connect, in clusters; a cluster that fits a task goes there whole, each set once.
        cluster = components(spread.select(F.col("lead").alias("a"), F.col("key").alias("b")))
        sizes = cluster.join(self.sets.select(F.col("key").alias("node"), F.length("shingles").alias("bytes")), "node").groupBy("component").agg(F.sum("bytes").alias("bytes"))
        total = int(sizes.agg(F.sum("bytes")).first()[0] or 0)
        bins = max(1, -(-total // BIN_BYTES))
        big = groups.where("large").groupBy("bucket").agg(F.sum(F.size("members")).alias("c"), F.min("lead").alias("node")).where(F.col("c") > MERGED)
        big = cluster.join(big, "node").select("component", F.lit(True).alias("big")).distinct()
        fits = (F.col("bytes") <= CLUSTER_BYTES) & F.col("big").isNull()
        binned = sizes.join(big, "component", "left").select("component", F.when(fits, F.pmod(F.xxhash64("component"), F.lit(bins))).alias("bin"))
        bin_of = written(cluster.join(binned, "component").select(F.col("node").alias("key"), "bin"), "bins")
        placed = groups.join(bin_of.select(F.col("key").alias("lead"), F.col("bin").alias("gbin")), "lead")
        whole = self._cluster_links(self.sets.join(bin_of.where("bin is not null"), "key"), placed.where("gbin is not null").select("gbin", "bucket", "members"))
        self.members = written(placed.where("gbin is null").select("bucket", "part", "large", F.explode("members").alias("key")), "members")
        rest = self._links(self.members.withColumn("label", F.col("key")).withColumn("side", F.lit(0)), ["bucket", "part"])
        self.links = self._second_round(written(whole.unionByName(rest).distinct(), "links"))
        self.components = components(self.links)

    def _narrowed(self, reduced: DataFrame) -> DataFrame:
        """The small groups of a reduced table, narrowed to the sets whose bitmaps allow links."""
        groups = reduced.where("kind = 1 and not large").select("bucket", "members").dropDuplicates(["bucket"])
        loose = groups.select("bucket", F.explode("members").alias("key")).join(self.maps, "key")
        work = groups.agg(F.count("*"), F.sum(F.size("members").cast("long") * F.size("members"))).first()
        bins = max(1, work[0] // NARROW_GROUPS, (work[1] or 0) // NARROW_PAIRS)
        return loose.groupBy(F.pmod("bucket", F.lit(bins)).alias("bin")).applyInArrow(narrow(self.sim), "bucket long, part long, large boolean, members array<long>").dropDuplicates(["bucket"])

    def _rare_groups(self, hot: DataFrame) -> DataFrame:
        """Groups of the hot sets by their rarest shingles: narrowed small ones, and blocks of large ones."""
        if hot.count() <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        sets = self.sets.join(hot, "key", "left_semi")
        pids = max(8, -(-int(sets.agg(F.sum(F.length("shingles"))).first()[0] or 0) // PID_BYTES))
        blobs = sets.select("key", "shingles").mapInArrow(map_rarest(rarity(sets), self.sim, pids), from_arrow_schema(MAPPED))
        both = written(blobs.groupBy("pid").applyInArrow(reduce_groups, from_arrow_schema(REDUCED)), "rare")
        large = both.where("kind = 1 and large").select("bucket", "part", "large", "members").dropDuplicates(["bucket", "part"])
        return self._narrowed(both).unionByName(large)

    def _sets(self) -> DataFrame:
        """(key, shingles) of the wanted classes, from the text of one document of each."""
        rep = self.documents.where("n > 0").groupBy("key").agg(F.min("rk").alias("rk"))
        rep = written(rep.join(self.wanted, "key"), "wanted")
        if rep.count() <= BROADCAST_ROWS:
            rep = F.broadcast(rep)
        hit = self.slim.join(rep, "rk").select("key", "text")
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = SpanHasher()
            for b in batches:
                key = b.column("key").to_numpy()
                for c in chunks(b.column("text")):
                    h, first = shingles(c, hasher, width)
                    ks, us = [], []
                    for r in range(c.n):
                        u = np.unique(h[first[r] : first[r + 1]])
                        k = key[c.first + r]
                        if len(u) and class_key(u).view(np.int64) == k:
                            ks.append(k)
                            us.append(u.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(us, pa.binary())], names=["key", "shingles"])

        sets = written(hit.mapInArrow(run, "key long, shingles binary"), "sets")
        keys = sets.agg(F.count("*"), F.count_distinct("key")).first()
        return sets if keys[0] == keys[1] else written(sets.dropDuplicates(["key"]), "sets")  # repeated rows give a set twice

    def _cluster_links(self, sets: DataFrame, groups: DataFrame) -> DataFrame:
        """Links in whole clusters: their sets and all their groups meet in one task."""
        sim, spanning = self.sim, self.spanning

        def walk(sets: pa.Table, groups: pa.Table) -> pa.Table:
            key = sets.column("key").to_numpy()
            shingle = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in sets.column("shingles")]
            order = np.argsort(key)
            label, links = key.copy(), set()
            merged: dict[int, list] = {}
            for b, m in zip(groups.column("bucket").to_pylist(), groups.column("members"), strict=True):
                merged.setdefault(b, []).append(m.values.to_numpy(zero_copy_only=False))
            for parts in sorted(merged.values(), key=lambda p: -sum(map(len, p))):
                at = order[np.searchsorted(key[order], np.unique(np.concatenate(parts)))]
                if (label[at] == label[at[0]]).all():
                    continue
                for i, j in tree_links(sim, [shingle[x] for x in at], label[at], None, spanning):
                    a, b = at[i], at[j]
                    links.add((max(key[a], key[b]), min(key[a], key[b])))
                    if spanning:
                        label[label == label[b]] = label[a]
            return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

        return sets.groupBy("bin").cogroup(groups.groupBy("gbin")).applyInArrow(walk, "a long, b long")

    def _links(self, members: DataFrame, group: list[str]) -> DataFrame:
        """Links found by walking each group's tree (or, with sides, its two trees)."""
        sim, spanning = self.sim, self.spanning

        def walk(table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy()
            key = table.column("key").to_numpy()
            order = np.lexsort((key, side))
            sets = [np.frombuffer(table.column("shingles")[int(i)].as_py(), dtype=np.uint64) for i in order]
            label, key, side = table.column("label").to_numpy()[order], key[order], side[order]
            split = int((side == 0).sum()) if side.any() else None
            found = tree_links(sim, sets, label, split, spanning)
            a, b = (key[[x[i] for x in found]] if found else np.zeros(0, np.int64) for i in (0, 1))
            return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

        return members.join(self.sets, "key").groupBy(*group).applyInArrow(walk, "a long, b long")

    def _second_round(self, first: DataFrame) -> DataFrame:
        """Sets of large groups that the first round left apart from their group's largest component, against all of the group."""
        large = self.members.where("large")
        if large.isEmpty():
            return first
        label = components(first)
        large = large.select("bucket", "key").distinct().join(label.select(F.col("node").alias("key"), "component"), "key", "left")
        large = written(large.select("bucket", "key", F.coalesce("component", "key").alias("label")), "large")
        by_label = large.groupBy("bucket", "label").agg(F.count("*").alias("c"))
        main = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most"))
        if not self.spanning:
            main = main.withColumn("main", F.lit(None).cast("long")).withColumn("most", F.lit(0))
        half = BLOCK // 2
        apart = main.where("most < size").select("bucket", "main", F.ceil((F.col("size") - F.col("most")) / half).cast("int").alias("ni"), F.ceil(F.col("size") / half).cast("int").alias("nj"))
        rows = large.join(apart, "bucket").withColumn("h", F.xxhash64("key"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("main is null or label <> main").select("bucket", "key", "label", F.pmod("h", "ni").cast("int").alias("i"), every("nj").alias("j"), F.lit(0).alias("side"))
        right = rows.select("bucket", "key", "label", every("ni").alias("i"), F.pmod("h", "nj").cast("int").alias("j"), F.lit(1).alias("side"))
        return written(first.unionByName(self._links(left.unionByName(right), ["bucket", "i", "j"])).distinct(), "all-links")

    def by_document(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        classes = self.documents.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
        named = classes.join(self.components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        label = named.join(least, "component").select("key", "component_id")
        full = self.documents.where("n > 0").join(label, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return full.unionByName(self.documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def ngram_components(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    return NgramJoin(docs, width, similarity).by_document()


def one_of_each_group(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs whose doc_id names their component (rows repeated under one doc_id are one document); rows of null id stay."""
    from .common import free_name

    found = ngram_components(docs, width, similarity)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    key = free_name(docs.columns, "nj_id")
    return docs.join(gone.select(F.col("doc_id").alias(key)), F.col("doc_id") == F.col(key), "left_anti")
