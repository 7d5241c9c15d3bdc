"""N-gram Jaccard join by parity sketches: documents whose sets of word shingles are alike, and their components.

A document's set holds 64-bit hashes of its distinct runs of SIZE words. Equal sets are one class from the start, so what
follows deals with one node for each distinct set, named by a hash of the set.

Sketches. A sketch flips one bit for each member of the set (an XOR of one-bit vectors), so the Hamming distance of two
sketches is never over the size of the sets' symmetric difference. Sets of n <= m members that are alike at the threshold
t have m <= n/t and a difference of (1-t)/(1+t) * (n+m) at most, which is k for all sets of one size band and the next.
The band's sketch has more than k segments; at least one segment of two such sets is equal, and that is a join key
(pigeonhole). A segment is SEGMENT_BITS wide and enters the key as a linear hash of its bits. Segments that are empty in
both sets agree for free, so a band has more segments to make up for those that are empty in its smallest sets; a set that
has more empty ones still is entered under further seeds, and at last under a key of its band that all such sets share.
No pair is lost.

Verification. Under a key of few nodes all pairs are candidates; a pair must first pass the Hamming distance of whole
(folded) sketches. Under a key of many nodes each node is held against one leader, the best connected of them, and a node
may leave out its most frequent keys, as alike sets share several (prefix filter); pairs under rarer keys must share
as many. First round: every node is verified on the sets against its leaders and its nearest candidate; links join
components. Two nodes near one leader differ by what their differences from it don't share, so the task that holds a
leader's members also links those that aren't alike to it, on the differences; only where a leader has more members than
a task should hold, or they differ by more, do differences travel: pairs must then share much of them and are found by
their rarer hashes. Second round: these pairs, nodes far from a leader with the others that aren't alike to it, and
candidates of the first kind, as far as their ends are in different components still, are verified. Every pair of alike
sets that shares a key is in one of these cases, so components are exact, and a large group of copies costs in proportion
to its members and to what they differ in, not to their pairs.

Layout. Texts are read where they lie; keys travel as packed arrays, one row for each document and bucket of keys, six
bytes a key as the bucket stands for the rest; a task keeps one of equal sets. Sets travel only for nodes that are in a
candidate pair. Leaders with many members are salted, and so are keys with many nodes far from their leader. Nothing is
collected but sums and the few nodes of which two different sets have the same hash; these go by the second hash.

Defined cases: documents without words (or null) have an empty set, no links, and are their own component; shorter texts
than SIZE words are one shingle; rows with the same id are one document in the result of components but each is a row;
rows with a null id join the component of rows with ids and an equal set, and link with no other; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .common import cut, drop, frugal, mix, shingles_of, small_batches, table, text_views, words_of

SIZE = 5
#: The threshold t as a fraction.
NUM, DEN = 80, 100
SEGMENT_BITS = 4096
#: A set is near a leader if it differs from it by this share of its size at most. It must be over what two links in a row can
#: differ by: for t = 0.8, (2.25 + 2.8125) / 9 = 0.5625 of the first set's size.
FAR_NUM, FAR_DEN = 1, 1
SEEDS = 6
FEW = 3  # nodes under a key of which all pairs are taken
SALT_MEMBERS = 2000
#: What a task compares of one leader's members on their differences: bytes of these, and steps (hashes times nodes that aren't alike to it).
HELD_BYTES, HELD_STEPS = 16 << 20, 1 << 31
FAR_NODES = 1000  # nodes of a salt under one key
MOST_CLASHES = 100_000
BROADCAST_PAIRS = 200_000  # up to so many, which is counted, their ends are sent to all tasks
KEYS_PER_BUCKET, PACK_KEYS, KEY_BYTES = 1_500_000, 400_000, 6
ROWS_AT_ONCE = 512  # sets that are Python objects at once
KEEP_NODES = 300_000  # nodes that a task remembers having sent

U = np.uint64


def alike(inter: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * inter >= NUM * (n + m - inter)


@lru_cache
def bands(limit: int) -> np.ndarray:
    """Least sizes of the bands up to limit: a set and one of up to 1/t times its size are in one band or in neighbours."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, (out[-1] - 1) * DEN // NUM + 1))
    return np.array(out)


def layout(band: int, limit: int) -> tuple[int, int]:
    """Of the pairs with their smaller set in this band: the largest difference k, and the number of segments."""
    edges = bands(limit)
    least, most = int(edges[band]), int(edges[band + 1]) - 1
    k = (DEN - NUM) * (most + most * DEN // NUM) // (DEN + NUM)
    if k == 0:
        return 0, 1
    segments = k + 1
    while True:
        empty = segments * np.exp(-least / segments)
        if segments - k > empty + 3 * np.sqrt(empty) or segments >= 2 * k + 2:
            return k, segments
        segments += max(1, segments // 64)


_PLACE = mix(np.arange(SEGMENT_BITS, dtype=np.uint64) + U(1234567))


def segment_keys(members: np.ndarray, band: int, k: int, segments: int) -> tuple[np.ndarray, int]:
    """Join keys of one set (sorted hashes) in one band, and how many keys a set that is alike must share beyond one.

    The band stands in a key's first byte. Of two alike sets all segments but k agree, and at least as many keys less the
    empty segments are shared.
    """
    keys = []
    for seed in range(SEEDS):
        x = members if seed == 0 else np.sort(mix(members ^ U(seed * 0x9E3779B9)))
        own = ((x >> U(32)) * U(segments)) >> U(32)  # hashes are sorted, so segments are runs
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        parity = np.bitwise_xor.reduceat(_PLACE[(x & U(SEGMENT_BITS - 1)).astype(np.int64)], heads)
        keys.append((mix(parity ^ mix(own[heads] + U((seed << 32) + 77))) >> U(8)) | U(band << 56))
        if k == 0 or len(heads) > k:
            return np.concatenate(keys), len(heads) - k - 1 if seed == 0 else 0
    keys.append(np.array([(band << 56) + 5], np.uint64))
    return np.concatenate(keys), 0


def folded(members: np.ndarray) -> bytes:
    """A parity sketch of twice as many bits as members, at least, to a power of two."""
    bits = 64
    while bits < 2 * len(members):
        bits *= 2
    return np.packbits((np.bincount((members & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two folded sketches; the wider one is folded on, which keeps parity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for first, end, data, offsets in text_views(column):
        _, _, hashes, at = words_of(data, offsets)
        # runs over the whole slice at once; each row takes those that are within it
        every = shingles_of(hashes, SIZE) if len(hashes) >= SIZE else None
        for i in range(end - first):
            a, b = int(at[i]), int(at[i + 1])
            own = every[a : b - SIZE + 1] if b - a >= SIZE else shingles_of(hashes[a:b], SIZE)
            if len(own) > 1:
                own = np.sort(own)
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            yield first + i, own


class Names:
    """Names of sets: a 64-bit hash, or a second one where the first is that of several sets. Fewer bits only test that."""

    def __init__(self, bits: int = 64, clashes: frozenset[int] = frozenset()) -> None:
        self.drop, self.clashes = 64 - bits, clashes

    def both(self, members: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            a, b = np.add.reduce(mix(members ^ U(0x51ED27))), np.add.reduce(mix(members + U(0xA076)))
            c = mix(np.array([a + U(len(members)), b ^ mix(np.array([a], np.uint64))[0]], np.uint64)).view(np.int64)
        return int(c[0]) >> self.drop, int(c[1])

    def __call__(self, members: np.ndarray) -> int:
        a, b = self.both(members)
        return b if a in self.clashes else a


def _describe(names: Names):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, node, check, sketch = [], [], [], []
            for _, own in sets_of(batch.column(1)):
                a, b = names.both(own) if len(own) else (None, None)
                n.append(len(own))
                node.append(a)
                check.append(b)
                sketch.append(folded(own) if len(own) and b not in seen else None)
                if len(seen) < KEEP_NODES and b is not None:
                    seen.add(b)
            yield pa.record_batch({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "chk": pa.array(check, pa.int64()), "sketch": pa.array(sketch, pa.binary())})

    return run


def _packed(buckets: int, nodes: list[int], skips: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket: the nodes, how many keys each has there, how many it may skip, and KEY_BYTES of the keys: the
    band and 40 bits, as the bucket hangs on the others."""
    sizes = np.array([len(k) for k in keys])
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
    bucket = (((flat >> U(24)) & U(0xFFFFFFFF)) % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    flat, owner, bucket = flat[order], owner[order], bucket[order]
    flat = (flat & U((1 << 40) - 1)) | (flat >> U(56) << U(40))
    flat = flat.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    runs = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])]))
    times = np.diff(np.append(runs, len(flat)))
    if times.max() > 255:  # a run that is too long for its counter goes as several
        runs = np.concatenate([np.arange(r, r + t, 255) for r, t in zip(runs.tolist(), times.tolist(), strict=True)])
        times = np.diff(np.append(runs, len(flat)))
    counts, who, skip = times.astype(np.uint8), np.array(nodes, np.int64)[owner[runs]], np.minimum(np.array(skips, np.int64)[owner[runs]], 255).astype(np.uint8)
    cuts = np.append(np.searchsorted(runs, heads), len(runs))
    ends = np.append(heads, len(flat))
    pack = lambda x, at: pa.array([x[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
    return pa.record_batch({"bucket": pa.array(bucket[heads]), "nodes": pack(who, cuts), "counts": pack(counts, cuts), "skips": pack(skip, cuts), "keys": pack(flat, ends)})


def _emit(buckets: int, limit: int, names: Names):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        edges, plans = bands(limit), {}
        nodes, skips, keys, held = [], [], [], 0
        for batch in batches:
            for _, own in sets_of(batch.column(0)):
                if not len(own) or (node := names(own)) in seen:
                    continue
                if len(seen) < KEEP_NODES:
                    seen.add(node)
                band = int(np.searchsorted(edges, len(own), side="right")) - 1
                for g in range(max(0, band - 1), band + 1):
                    if g not in plans:
                        plans[g] = layout(g, limit)
                    got, skip = segment_keys(own, g, *plans[g])
                    nodes.append(node)
                    skips.append(skip)
                    keys.append(got)
                    held += len(got)
                if held > PACK_KEYS:
                    yield _packed(buckets, nodes, skips, keys)
                    nodes, skips, keys, held = [], [], [], 0
        if held:
            yield _packed(buckets, nodes, skips, keys)

    return run


def meet(keys: np.ndarray, nodes: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's (key, node, skip): rows (a, b, skip, band, shared keys) of pairs under keys of FEW nodes at most, and the rows of keys with more."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    again = np.zeros(len(keys), bool)  # most keys are one node's only
    again[1:] = same
    again[:-1] |= same
    keys, order = keys[again], order[again]
    nodes, skips = nodes[order], skips[order].astype(np.int64)
    order = np.lexsort((nodes, keys))
    keys, nodes, skips = keys[order], nodes[order], skips[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, skips = keys[new], nodes[new], skips[new]
    if not len(keys):
        return np.zeros((0, 5), np.int64), np.zeros((0, 3), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    found = []
    for size in range(2, FEW + 1):
        own = heads[sizes == size]
        found += [np.stack([nodes[own + i], nodes[own + j], np.maximum(skips[own + i], skips[own + j]), (keys[own] >> U(56)).astype(np.int64)], axis=1) for i in range(size) for j in range(i + 1, size)] if len(own) else []
    pairs = np.zeros((0, 5), np.int64)
    if found:
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (found[1:, [0, 1, 3]] != found[:-1, [0, 1, 3]]).any(axis=1)]))
        pairs = np.concatenate([found[first], np.diff(np.append(first, len(found)))[:, None]], axis=1)
    many = np.repeat(sizes > FEW, sizes)
    return pairs, np.stack([keys[many].view(np.int64), nodes[many], skips[many]], axis=1)


def _unpacked(bucket: int, packed: bytes) -> np.ndarray:
    """Whole keys again: band, 16 bits of the bucket, and the 40 bits."""
    wide = np.zeros((len(packed) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BYTES)
    flat = wide.view(np.uint64)[:, 0]
    return (flat & U((1 << 40) - 1)) | (flat >> U(40) << U(56)) | U((bucket & 0xFFFF) << 40)


@frugal
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, bucket by bucket as they come sorted: rows (kind 0: pair a, b of a band with the keys that they share; kind 1: key a with many nodes, its node b, skip)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            found = meet(*whole)
            for kind, rows in enumerate(found):
                for at in range(0, len(rows), 1 << 16):
                    part = rows[at : at + (1 << 16)]
                    part = np.pad(part, ((0, 0), (0, 5 - part.shape[1])))
                    yield pa.record_batch({"kind": pa.array(np.full(len(part), kind, np.int32)), "a": pa.array(part[:, 0]), "b": pa.array(part[:, 1]), "skip": pa.array(part[:, 2].astype(np.int32)), "band": pa.array(part[:, 3].astype(np.int32)), "shared": pa.array(part[:, 4].astype(np.int32))})

    for batch in batches:
        for bucket, nodes, counts, skips, keys in zip(*batch.columns, strict=True):
            if bucket.as_py() != now:
                yield from done()
                now = bucket.as_py()
            times = np.frombuffer(counts.as_py(), np.uint8)
            held.append((_unpacked(now, keys.as_py()), np.repeat(np.frombuffer(nodes.as_py(), np.int64), times), np.repeat(np.frombuffer(skips.as_py(), np.uint8), times)))
    yield from done()


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, n, m = (batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb"))
    return np.array([hamming(p, q) for p, q in zip(x, y, strict=True)], np.int64), np.array(n, np.int64), np.array(m, np.int64)


@frugal
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, 16 * ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, 16 * ROWS_AT_ONCE)):
        d, n, m = _measured(batch)
        ok = ((DEN + NUM) * d <= (DEN - NUM) * (n + m)) & (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m))
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "d": pa.array(d)}).filter(pa.array(ok))


@frugal
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, _, m = _measured(batch)
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "d": pa.array(d)}).filter(pa.array(FAR_DEN * d <= FAR_NUM * m))


def _with_sets(names: Names):
    """(leader, salt, salts, role, node, want, text) to the same with the set's bytes; a text of another set under the same id goes."""
    columns = ["leader", "salt", "salts", "role", "node", "want", "members"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(4).to_numpy()
            rows, sets, held = [], [], 0
            for row, own in sets_of(batch.column(6)):
                if not len(own) or names(own) != node[row]:
                    continue
                rows.append(row)
                sets.append(own.tobytes())
                held += 8 * len(own)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:6]), pa.array(sets, pa.binary())], names=columns)
                    rows, sets, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:6]), pa.array(sets, pa.binary())], names=columns)

    return run


def links_within(leader: int, members: list[tuple[int, bool, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links (x, y) that join what isn't joined through the leader yet; members are (node, alike to it, set size, sorted difference from it)."""
    place = {leader: leader}

    def root(x: int) -> int:
        while place.setdefault(x, x) != x:
            place[x] = place[place[x]]
            x = place[x]
        return x

    for node, ok, _, _ in members:
        if ok:
            place[root(node)] = leader
    node, size, d = (np.array(x, np.int64) for x in zip(*((m[0], m[2], len(m[3])) for m in members), strict=True))
    flat, owner = np.concatenate([m[3] for m in members]), np.repeat(np.arange(len(members)), d)
    _, flat, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[flat] > 1  # what one member alone has is in no overlap
    flat, owner = flat[shared], owner[shared]
    heads = np.searchsorted(owner, np.arange(len(members) + 1))
    mark, found = np.zeros(len(df), bool), []
    for x, (_, ok, n, diff) in enumerate(members):
        if ok:
            continue
        own = flat[heads[x] : heads[x + 1]]
        mark[own] = True
        both = np.bincount(owner[mark[flat]], minlength=len(members))
        mark[own] = False
        inter = (n + size - (len(diff) + d - 2 * both)) // 2
        for y in np.flatnonzero(alike(inter, n, size)).tolist():
            if y != x and (p := root(int(node[x]))) != (q := root(int(node[y]))):
                place[p] = q
                found.append((int(node[x]), int(node[y])))
    return found


@frugal
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members against the leader that comes before them in the sorted partition; one leader's set is held.

    Each pair (kind 0) tells whether it is alike and, where that is wanted, near. Of a leader in one salt the differences
    of near members are held, up to HELD_BYTES, and give the links between them (kind 1). Beyond, and of leaders in
    several salts, the pairs carry the difference's hashes.
    """
    leader, held, mine, size, spilt = None, None, [], 0, False
    out: list[tuple] = []
    waiting = 0  # bytes in out

    def pack() -> pa.RecordBatch:
        rows = out.copy()
        nonlocal waiting
        out.clear()
        waiting = 0
        a, b, kind, ok, near, n, diff = zip(*rows, strict=True)
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "kind": pa.array(kind, pa.int32()), "alike": pa.array(ok, pa.bool_()), "near": pa.array(near, pa.bool_()), "n": pa.array(n, pa.int64()), "diff": pa.array([None if x is None else x.tobytes() for x in diff], pa.binary())})

    def row(node: int, ok: bool, n: int, diff: np.ndarray | None, travels: bool) -> None:
        nonlocal waiting
        out.append((leader, node, 0, ok, diff is not None, n, diff if travels else None))
        waiting += diff.nbytes if travels and diff is not None else 0

    def done() -> None:
        """What is held of a leader."""
        odd = sum(not m[1] for m in mine)
        steps = odd * sum(len(m[3]) for m in mine)
        if odd and steps <= HELD_STEPS:
            out.extend((x, y, 1, True, False, 0, None) for x, y in links_within(leader, mine))
        for m in mine:
            row(*m, travels=steps > HELD_STEPS)
        mine.clear()

    for batch in batches:
        for l, salts, role, node, want, members in zip(*(batch.column(c) for c in ("leader", "salts", "role", "node", "want", "members")), strict=True):
            own = np.frombuffer(members.as_py(), np.uint64)
            if role.as_py() == 0:
                done()
                leader, held, size, spilt = l.as_py(), own, 0, salts.as_py() > 1
            elif l.as_py() == leader:
                small, large = (own, held) if len(own) <= len(held) else (held, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same = int((large[at] == small).sum())
                ok = bool(alike(same, len(own), len(held)))
                near = want.as_py() and FAR_DEN * (len(own) + len(held) - 2 * same) <= FAR_NUM * len(own)
                diff = np.setxor1d(own, held, assume_unique=True) if near else None
                if near and not spilt:
                    mine.append((node.as_py(), ok, len(own), diff))
                    size += diff.nbytes
                    if size > HELD_BYTES:
                        spilt = True
                        for m in mine:
                            row(*m, travels=True)
                        mine.clear()
                else:
                    row(node.as_py(), ok, len(own), diff, travels=True)
            if len(out) >= ROWS_AT_ONCE or waiting > HELD_BYTES // 4:
                yield pack()
    done()
    if out:
        yield pack()


@frugal
def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, diff) to a row for each hash of the difference, cut to 31 bits; equal ones that weren't only add candidates."""
    for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
        held = batch.column("diff").to_pylist()
        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in held]))
        values = (np.frombuffer(b"".join(held), np.uint64) >> U(33)).astype(np.int32)
        yield pa.record_batch({"a": batch.column("a").take(at), "b": batch.column("b").take(at), "e": pa.array(values)})


def _screen(pairs: DataFrame, nodes: DataFrame, near: bool = False) -> DataFrame:
    """Distinct pairs (a, b) that sizes and sketches leave a chance to be alike, with their distance d; with near, those that may be near."""
    side = lambda x, n, s: nodes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("sketch").alias(s))
    both = pairs.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near if near else _close, "a long, b long, d long")


def _compare(pairs: DataFrame, rep: DataFrame, docs: DataFrame, names: Names) -> DataFrame:
    """(a, b, kind, alike, near, n, diff) of pairs(a, b, want) by their sets; a is the leader. rep(node, doc_id) names a document of each node."""
    crowd = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts"))
    salted = pairs.join(crowd, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = salted.select(F.col("a").alias("leader"), "salt", "salts", F.lit(1).alias("role"), F.col("b").alias("node"), "want")
    leaders = salted.select(F.col("a").alias("leader"), "salt", "salts").distinct().select("leader", "salt", "salts", F.lit(0).alias("role"), F.col("leader").alias("node"), F.lit(False).alias("want"))
    roles = members.unionByName(leaders).join(rep, "node")
    if pairs.count() <= BROADCAST_PAIRS:  # else texts are shuffled by id
        roles = F.broadcast(roles)
    texts = docs.join(roles, F.col("id") == F.col("doc_id")).select("leader", "salt", "salts", "role", "node", "want", "text")
    sets = texts.mapInArrow(_with_sets(names), "leader long, salt int, salts int, role int, node long, want boolean, members binary")
    placed = sets.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return placed.mapInArrow(_verify, "a long, b long, kind int, alike boolean, near boolean, n long, diff binary")


def _candidates(rows: DataFrame, most: int, total: int, names: Names) -> DataFrame:
    """Rows (kind 0: pair a, b of nodes; kind 1: key a with many nodes, its node b; and what meet() tells of them), cut."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = parts * max(1, -(-int(total * 0.6) // (KEYS_PER_BUCKET * parts)))
    placed = rows.select("text").mapInArrow(_emit(buckets, most, names), "bucket int, nodes binary, counts binary, skips binary, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    return cut(placed.mapInArrow(_meet, "kind int, a long, b long, skip int, band int, shared int"), "met")


def _paired(met: DataFrame) -> DataFrame:
    """Pairs (a, b) under keys of few nodes that share enough keys of a band, counting as shared all keys of many nodes that a has."""
    pairs = met.where("kind = 0").groupBy("a", "b", "band").agg(F.sum("shared").alias("shared"), F.max("skip").alias("skip"))
    popular = met.where("kind = 1").groupBy(F.col("b").alias("a"), F.shiftrightunsigned("a", 56).cast("int").alias("band")).agg(F.count("*").alias("popular"))
    enough = pairs.where("shared > skip").select("a", "b")
    perhaps = pairs.where("shared <= skip").join(popular, ["a", "band"]).where("shared + popular > skip").select("a", "b")
    return enough.unionByName(perhaps).distinct()


def _crowded(met: DataFrame) -> DataFrame:
    """(key, node, leader) of keys with many nodes, cut.

    A node leaves out its most frequent keys of a band, one fewer than it shares with any set that is alike (prefix
    filter in the order of frequency). A key's leader is the node under most rows of such keys: in a group of copies the
    text that the others come from.
    """
    many = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "skip")
    sized = many.join(many.groupBy("key").agg(F.count("*").alias("size")), "key")
    rank = F.row_number().over(Window.partitionBy("node", F.shiftrightunsigned("key", 56)).orderBy(F.desc("size"), F.desc("key")))
    kept = cut(sized.withColumn("rank", rank).where("rank > skip").select("key", "node", "size"), "kept")
    known = kept.groupBy("node").agg(F.sum("size").alias("fame"))
    led = kept.join(known, "node").groupBy("key").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"), F.count("*").alias("left")).where("left > 1")
    out = cut(kept.select("key", "node").join(led.select("key", "leader"), "key"), "crowded")
    drop(kept)
    return out


def _named(df: DataFrame, comps: DataFrame, node: str, comp: str) -> DataFrame:
    """df with the component of its column node; a node that has no link is its own."""
    return df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))


def _by_difference(told: DataFrame) -> DataFrame:
    """Pairs of nodes near one leader of many members that can be alike though not both are alike to it.

    Two sets differ in d1 + d2 less twice what their differences from the leader share, so they must share
    (d1 + d2 - k) / 2 hashes of them at least. Hashes are ranked by how few of the leader's nodes have them, and a pair
    must meet at a hash that stands early enough in both (prefix filter with the pair's own bound).
    """
    near = told.where("kind = 0 and diff is not null").withColumn("d", (F.octet_length("diff") / 8).cast("long"))
    # alike sets differ from the leader by figures that are close; what has no such partner is left out
    odd = near.groupBy("a").agg(F.count_if(~F.col("alike")).alias("odd"), F.min(F.when(~F.col("alike"), F.col("d"))).alias("least"), F.max(F.when(F.col("alike"), F.col("d"))).alias("most")).where("odd > 0")
    close = lambda far, by: F.coalesce(NUM * (F.col(far) - F.col(by)) <= (DEN - NUM) * F.col("n"), F.lit(False))
    near = cut(near.join(odd, "a").where(F.when(F.col("alike"), close("least", "d")).otherwise((F.col("odd") > 1) | close("d", "most"))).select("a", "b", "alike", "n", "d", "diff"), "near")
    if near.isEmpty():
        return near.select("a", "b")
    each = spread = cut(near.select("a", "b", "diff").mapInArrow(_spread, "a long, b long, e int"), "differences")
    each = each.join(each.groupBy("a", "e").agg(F.count("*").alias("df")), ["a", "e"])
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("df", "e"))).where("df > 1").select("a", "b", "e", "rank")
    each = each.join(near.select("a", "b", "alike", "n", "d"), ["a", "b"])
    # no partner is larger than 1/t times the set, and none differs by less than one: what no pair can need is left out
    least = (DEN + NUM) * (F.col("d") + 1) * NUM - (DEN - NUM) * (NUM + DEN) * F.col("n")
    each = each.where(2 * (DEN + NUM) * NUM * (F.col("d") - F.col("rank") + 1) >= least)
    x = each.where("not alike").select("a", "e", F.col("b").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"), F.col("rank").alias("rx"))
    y = each.select("a", "e", F.col("b").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("rank").alias("ry"), F.col("alike").alias("ya"))
    # twice the bound, times DEN + NUM, in whole numbers
    need = (DEN + NUM) * (F.col("dx") + F.col("dy")) - (DEN - NUM) * (F.col("nx") + F.col("ny"))
    early = lambda d, r: 2 * (DEN + NUM) * (F.col(d) - F.col(r) + 1) >= need
    met = x.join(y, ["a", "e"]).where((F.col("ya") | (F.col("x") < F.col("y"))) & (F.col("x") != F.col("y")) & early("dx", "rx") & early("dy", "ry"))
    met = cut(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "by-difference")
    drop(near, spread)
    return met


def _far_apart(crowded: DataFrame, told: DataFrame) -> DataFrame:
    """Pairs under a key of which one is far from the key's leader: they differ from it by more than FAR_NUM / FAR_DEN of
    their size.

    Such a node can't be alike to one that is alike to the leader, so it meets the others only. FAR_NODES of a key go to
    a salt, so that no task gets all the pairs of a key.
    """
    where = told.where("kind = 0").select(F.col("a").alias("leader"), F.col("b").alias("node"), "alike", "near")
    known = crowded.where("node != leader").join(where, ["leader", "node"], "left")
    far = known.where("not coalesce(near, false)").select("key", F.col("node").alias("x"))
    rest = known.where("not coalesce(alike, false)").select("key", "node", F.coalesce("near", F.lit(False)).alias("near"))
    salts = far.groupBy("key").agg(F.ceil(F.count("*") / FAR_NODES).cast("int").alias("salts"))
    far = far.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int")).drop("salts")
    rest = rest.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = far.join(rest, ["key", "salt"]).where((F.col("near") & (F.col("x") != F.col("node"))) | (~F.col("near") & (F.col("x") < F.col("node"))))
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _name_nodes(rows: DataFrame, bits: int) -> tuple[DataFrame, Names]:
    """(doc_id, n, node, sketch) of every row, cut, and how sets are named."""
    names = Names(bits)
    described = cut(rows.mapInArrow(_describe(names), "doc_id long, n long, node long, chk long, sketch binary"), "sets")
    clash = described.where("node is not null").groupBy("node").agg((F.min("chk") != F.max("chk")).alias("clash")).where("clash").select("node")
    found = clash.limit(MOST_CLASHES + 1).collect()  # about n * n / 2^65 of n sets
    if len(found) > MOST_CLASHES:
        raise RuntimeError(f"over {MOST_CLASHES} hashes of nodes belong to several sets")
    if found:
        names = Names(bits, frozenset(r.node for r in found))
        described = described.join(F.broadcast(clash.withColumn("clash", F.lit(True))), "node", "left").withColumn("node", F.when(F.col("clash"), F.col("chk")).otherwise(F.col("node")))
    return described.select("doc_id", "n", "node", "sketch"), names


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) of every row; set_id is equal for equal sets."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    described, names = _name_nodes(rows, node_bits)
    # a task writes the sketch of a node once, so max() picks it out
    nodes = cut(described.where("node is not null").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), F.max("sketch").alias("sketch")), "nodes")
    stats = nodes.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    alone = described.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("node").alias("set_id"))
    if not stats.most:
        return alone
    met = _candidates(rows, int(stats.most), int(stats.total), names)
    rep = nodes.where("least is not null").select("node", F.col("least").alias("doc_id"))
    crowded = _crowded(met)
    star = crowded.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = cut(_screen(star, nodes, near=True).select("a", "b"), "star")
    pairs = cut(_screen(_paired(met), nodes), "close")
    drop(met)
    # first round: every node with its leaders and, under rarer keys, with the nearest candidate seen from its larger end
    best = pairs.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b")
    asked = cut(star.withColumn("want", F.lit(True)).unionByName(best.withColumn("want", F.lit(False))).groupBy("a", "b").agg(F.max("want").alias("want")), "asked")
    told = cut(_compare(asked, rep, rows, names), "told-pairs")
    drop(star, asked)
    first = told.where("alike").select("a", "b")
    comps = components(first, small=0)
    more = pairs.select("a", "b").unionByName(_screen(_by_difference(told).unionByName(_far_apart(crowded, told)).distinct(), nodes).select("a", "b"))
    done = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(_named(_named(more.distinct().join(done, ["a", "b"], "left_anti"), comps, "a", "ca"), comps, "b", "cb").where("ca != cb").select("a", "b", F.lit(False).alias("want")), "rest")
    drop(pairs, crowded)
    second = cut(_compare(rest, rep, rows, names).where("alike").select("a", "b"), "links")
    drop(rest)
    comps = components(first.unionByName(second), small=0)
    drop(told, second)
    whose = _named(nodes.select("node", "least"), comps, "node", "comp")
    final = whose.join(whose.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    out = described.where("node is not null").join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("node").alias("set_id"))
    return out.unionByName(alone)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
