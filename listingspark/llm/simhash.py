"""SimHash near-duplicates: fingerprints, links by bit-sliced comparison, and classes of linked documents.

A fingerprint has a bit set when more than half of the hashes of a text's word shingles have it.  Two
fingerprints link when they differ in ``radius`` bits or fewer.  Equal fingerprints are one node.

*Blocks.*  The 64 bits are cut into ``parts``; fingerprints within the radius agree wholly in at least
``parts - radius`` of them, so each node is keyed by every choice of that many parts and compared only
with the nodes of the same key: no link is lost.  More parts make finer keys for more documents.  For
wide radii ``bands`` of minima over the shingle hashes may give the keys instead.

*Comparison.*  A block's bit planes are stored vertically, 64 fingerprints to a word.  A query's
distance to all of them grows plane by plane in carry-save counters, and words of which every lane
exceeds the radius are abandoned.  A key with many nodes is split into tiles that are compared pair
by pair in tasks of their own.  A task keeps only the links that join two trees of its forest, so a
group of n near copies gives at most n - 1 links per tile pair, never all pairs.  Closer pairs join first.

*Similarity.*  Where a ``similarity`` is asked for, a link stays only if the sets of shingles of the two nodes
are that similar (Jaccard), and fingerprints weigh each distinct shingle once, as the sets do; the texts of linked nodes alone are read again for it.  A forest of near bits may
have left out the link that passes, so blocks whose nodes are not all in one class by then are gone through again:
nodes with a candidate in another class travel with their sets, and only pairs that pass join trees.

*Classes.*  Links are contracted by alternating large and small stars until nothing changes.

Null text is the empty text; a text without words has fingerprint zero and links like any other, one
with fewer words than a shingle has one shingle.  Rows without an id take part by their text but name no
class.  Repeated rows are repeated in the result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored, texts

TILE = 4096
SMALL = 16  # nodes of a block up to which all its links are kept
TILE_SHINGLES = 1 << 20  # shingles of a tile whose nodes travel with their sets
_PRIMES = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int, lower: bool) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``words`` words, repeats included."""
    from xxhash import xxh64_intdigest

    split = (text.lower() if lower else text).split()
    if not split:
        return np.zeros(0, np.uint64)
    if len(split) <= words:
        return np.array([xxh64_intdigest(b" ".join(split), 42)], np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(split) - words + 1].tolist()
    return np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: a hash of ``rows`` minima of the shingle hashes, each under a full mixing of its own."""
    n = bands * rows
    own = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _PRIMES)
    least = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 512):  # a slice that stays in the cache of a core
        least = np.minimum(least, _mixed(own[:, None] ^ hashes[None, i:i + 512]).min(1))
    mixed = least.reshape(bands, rows)
    key = np.zeros(bands, np.uint64)
    for r in range(rows):
        key = (key ^ mixed[:, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    return key


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, lower: bool = True,
                 bands: tuple[int, int] | None = None, distinct: bool = False) -> DataFrame:
    """``doc_id, node`` (the fingerprint as a signed integer) and, with ``bands``, ``keys``; repeated shingles
    weigh once with ``distinct``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(texts(batch.column(1))):
                hashes = shingle_hashes(text, words, lower)
                hashes = np.unique(hashes) if distinct else hashes
                nodes[i] = fingerprint(hashes)
                if bands:
                    keys.append(band_keys(hashes, *bands).view(np.int64))
            out = {"doc_id": batch.column(0), "node": nodes.view(np.int64)}
            if bands:
                out["keys"] = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long" + (", keys array<long>" if bands else ""))


def part_keys(node: Column, parts: int, radius: int) -> list[Column]:
    """A key for each choice of ``parts - radius`` of the parts: the bits of those parts, all others zero."""
    cuts = np.linspace(0, 64, parts + 1).round().astype(int)
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(parts)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(parts), parts - radius)]
    return [node.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in chosen]


class _Forest:
    """Union-find over the nodes of one comparison; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.a, self.b = [], []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.a.append(i)
                self.b.append(j)


def planes_of(nodes: np.ndarray) -> np.ndarray:
    """Bit planes stored vertically: (64, words of 64 lanes); lanes past the end repeat the first node."""
    lanes = -(-len(nodes) // 64) * 64
    full = np.concatenate((nodes, np.full(lanes - len(nodes), nodes[0] if len(nodes) else 0, np.uint64)))
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) at ``radius`` differing bits or fewer, by carry-save counters over the planes."""
    width = planes.shape[1]
    query, word = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(width), indexing="ij"))
    levels = radius.bit_length() + 1  # counts up to twice the radius before they stick
    counter = np.zeros((levels, len(query)), np.uint64)
    over = np.zeros(len(query), np.uint64)
    for plane in range(0, 64, 2):
        bits = [planes[p, word] ^ (np.uint64(0) - (queries[query] >> np.uint64(p) & np.uint64(1))) for p in (plane, plane + 1)]
        # A full adder takes two planes and the lowest counter at once; carries ripple up.
        x, y = bits
        half = x ^ y
        carry = (x & y) | (half & counter[0])
        counter[0] ^= half
        for level in range(1, levels):
            counter[level], carry = counter[level] ^ carry, counter[level] & carry
        over |= carry
        if plane % 8 == 6:
            far = over | _above(counter, radius)
            live = np.flatnonzero(far != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(live) < len(query):  # abandon words whose lanes are all beyond the radius
                query, word, counter, over = query[live], word[live], counter[:, live], over[live]
                if not len(query):
                    break
    near = ~(over | _above(counter, radius))
    hit = np.flatnonzero(near)
    bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    q, lane = query[hit][at], word[hit][at] * 64 + lane
    return q[lane < n], lane[lane < n]


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius, compared bit by bit from the highest."""
    more, same = np.zeros(counter.shape[1], np.uint64), np.full(counter.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF))
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            same &= counter[level]
        else:
            more |= same & counter[level]
            same &= ~counter[level]
    return more


def _steps(radius: int) -> list[int]:
    """Radii up to the one asked for, so that near pairs are joined before farther ones."""
    return [radius] if radius < 8 else [3 * radius // 8, 5 * radius // 8, radius]


def _compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest between two tiles, or inside one."""
    nodes = left if right is None else np.concatenate((left, right))
    base = 0 if right is None else len(left)
    forest, other = _Forest(len(nodes)), left if right is None else right
    planes = planes_of(other)
    step = max(1, (1 << 16) // planes.shape[1])
    for reach in _steps(radius):
        for i in range(0, len(left), step):
            q, lane = within(left[i:i + step], planes, len(other), reach)
            if right is None:
                keep = q + i < lane
                q, lane = q[keep], lane[keep]
            near = np.argsort(np.bitwise_count(left[q + i] ^ other[lane]), kind="stable")
            forest.join(zip((q + i)[near].tolist(), (lane + base)[near].tolist(), strict=True))
    return nodes[forest.a], nodes[forest.b]


def _pairs(small: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small groups at once: a lane holds a pair, its planes the differing bits."""
    a, b = [], []
    for nodes in small:
        i, j = np.triu_indices(len(nodes), 1)
        a.append(nodes[i])
        b.append(nodes[j])
    a, b = np.concatenate(a), np.concatenate(b)
    _, lane = within(np.zeros(1, np.uint64), planes_of(a ^ b), len(a), radius)
    return a[lane], b[lane]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (table, key, pair of tiles, side); a group may span batches."""
        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

        def group(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            side, nodes = rows[4], rows[5].view(np.uint64)
            if rows[2, 0] == rows[3, 0]:
                yield out(*_compare(nodes, None, radius))
            elif (side == 0).any() and (side == 1).any():
                yield out(*_compare(nodes[side == 0], nodes[side == 1], radius))

        held, small, waiting = None, [], 0
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = rows if held is None else np.concatenate((held, rows), axis=1)
            if not rows.shape[1]:
                continue
            edges = np.flatnonzero((np.diff(rows[:4], axis=1) != 0).any(0)) + 1
            last = int(edges[-1]) if len(edges) else 0
            starts = np.concatenate(([0], edges))
            sizes = np.diff(starts)
            for i in np.flatnonzero(sizes > 1):
                part = rows[:, starts[i]:starts[i + 1]]
                if part[2, 0] == part[3, 0] and sizes[i] <= SMALL:
                    small.append(part[5].view(np.uint64).copy())
                    waiting += int(sizes[i]) ** 2 // 2
                    if waiting > 1 << 16:
                        yield out(*_pairs(small, radius))
                        small, waiting = [], 0
                else:
                    yield from group(part)
            held = rows[:, last:].copy()
        if held is not None and held.shape[1] > 1:
            if held[2, 0] == held[3, 0] and held.shape[1] <= SMALL:
                small.append(held[5].view(np.uint64))
            else:
                yield from group(held)
        if small:
            yield out(*_pairs(small, radius))
    return run


def _tiled(keyed: DataFrame, sizes: DataFrame, tile: int, *extra: str) -> DataFrame:
    """Rows of the keys in ``sizes``: a key of more than a tile is dealt over tiles; each pair of tiles is a group of its own."""
    tiles = F.ceil(F.col("n") / tile)
    mine = F.when(tiles == 1, 0).otherwise(F.pmod(F.xxhash64("node"), tiles))
    dealt = keyed.join(sizes, ["tab", "key"]).withColumns({"tiles": tiles, "mine": mine}).select(
        "tab", "key", "node", *extra, "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    return dealt.select(F.col("tab").cast("long").alias("tab"), "key", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"),
                        (F.col("mine") > F.col("other")).cast("long").alias("side"), "node", *extra)


def links(nodes: DataFrame, radius: int = 4, parts: int = 6, bands: bool = False, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` (a > b) that connect all nodes within the radius of one another.

    ``nodes`` has ``node`` and, with ``bands``, ``keys``; a node may come more than once.
    """
    if bands:
        keyed = nodes.select("node", F.posexplode("keys").alias("tab", "key")).distinct()
    else:
        keys = part_keys(F.col("node"), parts, radius)
        keyed = nodes.select("node").distinct().select("node", F.posexplode(F.array(*keys)).alias("tab", "key"))
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = _tiled(keyed, sizes, tile)
    grouped = grouped.repartition("tab", "key", "first", "second").sortWithinPartitions("tab", "key", "first", "second", "side")
    return grouped.mapInArrow(_links(radius), "a long, b long").distinct()


def components(pairs: DataFrame, most: int = 60) -> DataFrame:
    """``node, root``: the least node of its component, for every node that has a link.

    Large and small stars in turn; each round is written to the shared folder, and the loop ends when a round
    changes nothing.  A node's neighbours are never gathered: only their least is kept.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(most):
        # Large star: every larger neighbour of a node, and the node, to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(F.col("a").alias("v"), F.col("b").alias("a")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: every smaller neighbour of a node, and the node, to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stored(small.filter("a <> b").distinct(), "links")
        state = [df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for df in (edges, after)]
        edges = after
        if state[0] == state[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """``doc, shingles``: the sorted distinct shingle hashes of the documents in ``wanted``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text")).join(
        wanted.hint("merge"), "doc")  # one plan at every size: the documents with links grow with the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words, lower)).view(np.int64) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "shingles"])

    return rows.mapInArrow(run, "doc long, shingles array<long>").dropDuplicates(["doc"])


def _first(found: DataFrame) -> DataFrame:
    """``node, doc``: the document whose text stands for a node."""
    return found.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"))


def similar_links(docs: DataFrame, found: DataFrame, pairs: DataFrame, similarity: float, words: int, lower: bool,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links of which the two nodes' first documents share at least ``similarity`` of their sets of shingles."""
    first = _first(found)
    ends = pairs.join(first.select(F.col("node").alias("a"), F.col("doc").alias("doc_a")), "a").join(
        first.select(F.col("node").alias("b"), F.col("doc").alias("doc_b")), "b")
    ends = stored(ends, "linked")
    wanted = ends.select(F.col("doc_a").alias("doc")).unionByName(ends.select(F.col("doc_b").alias("doc"))).distinct()
    sets = _sets(docs, wanted, words, lower, id_col, text_col)
    both = ends.join(sets.select(F.col("doc").alias("doc_a"), F.col("shingles").alias("s")), "doc_a").join(
        sets.select(F.col("doc").alias("doc_b"), F.col("shingles").alias("t")), "doc_b")
    common, all_ = F.size(F.array_intersect("s", "t")), F.size(F.array_union("s", "t"))
    return both.filter(common >= similarity * all_ - 1e-9).select("a", "b")


def _apart(radius: int):
    def run(group: pa.Table) -> pa.Table:
        """The nodes of a group that have another within the radius in another class."""
        side, node, root = (group.column(c).to_numpy() for c in ("side", "node", "root"))
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        right = right if len(right) else left
        fits = np.zeros(len(node), bool)
        if len(left) and (root != root[0]).any():
            planes = planes_of(node[right].view(np.uint64))
            step = max(1, (1 << 16) // planes.shape[1])
            for i in range(0, len(left), step):
                q, lane = within(node[left[i:i + step]].view(np.uint64), planes, len(right), radius)
                q, lane = left[q + i], right[lane]
                other = root[q] != root[lane]
                fits[q[other]] = fits[lane[other]] = True
        return group.select(["tab", "key", "node", "root"]).filter(pa.array(fits))
    return run


def _joined(radius: int, similarity: float):
    def run(group: pa.Table) -> pa.Table:
        """Links of a spanning forest over the pairs of a group that are within the radius and similar."""
        side, node, root = (group.column(c).to_numpy() for c in ("side", "node", "root"))
        node = node.view(np.uint64)
        column = group.column("shingles").combine_chunks()
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        _, place = np.unique(column.flatten().to_numpy(), return_inverse=True)
        sizes, tree = np.diff(ends), np.unique(root, return_inverse=True)[1]
        marked = np.zeros(len(place) + 1, bool)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        one, a, b = group.column("first")[0].as_py() == group.column("second")[0].as_py(), [], []
        for at, i in enumerate(left):
            lanes = left[at + 1:] if one else right
            lanes = lanes[(tree[lanes] != tree[i]) & (np.bitwise_count(node[lanes] ^ node[i]) <= radius)]
            lanes = lanes[np.minimum(sizes[lanes], sizes[i]) >= similarity * np.maximum(sizes[lanes], sizes[i]) - 1e-9]
            if not len(lanes):
                continue
            mine = place[ends[i]:ends[i + 1]]
            marked[mine] = True
            hits = np.concatenate(([0], np.cumsum(marked[np.concatenate([place[ends[j]:ends[j + 1]] for j in lanes])])))
            marked[mine] = False
            stops = np.cumsum(sizes[lanes])
            common = hits[stops] - hits[stops - sizes[lanes]]
            for j in lanes[common >= similarity * (sizes[lanes] + sizes[i] - common) - 1e-9]:
                if tree[j] != tree[i]:
                    tree[tree == tree[j]] = tree[i]
                    a.append(i)
                    b.append(j)
        a, b = node[np.array(a, np.int64)].view(np.int64), node[np.array(b, np.int64)].view(np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})
    return run


def missed_links(docs: DataFrame, found: DataFrame, roots: DataFrame, radius: int, similarity: float, words: int, lower: bool,
                 id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame | None:
    """Similar links between the classes ``roots`` that the forests of :func:`links` left out, or None without candidates.

    Only blocks over ``SMALL`` nodes have such links.  Of those, only nodes with a candidate in another class are
    gathered with their sets, in tiles bounded by their shingles; pairs are tested there and never written.
    """
    keyed = found.select("node", F.posexplode("keys").alias("tab", "key")).distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = sizes.filter((F.col("n") > SMALL) & (F.col("low") < F.col("high"))).select("tab", "key", "n")
    group = ["tab", "key", "first", "second"]
    apart = _tiled(keyed, sizes, tile, "root").groupBy(*group).applyInArrow(_apart(radius), "tab long, key long, node long, root long")
    apart = stored(apart.distinct(), "apart")
    if apart.isEmpty():
        return None
    wanted = apart.select("node").distinct().join(_first(found), "node")
    sets = stored(_sets(docs, wanted.select("doc"), words, lower, id_col, text_col).join(wanted, "doc").select("node", "shingles"), "shingles")
    weights = apart.join(sets.select("node", F.size("shingles").alias("w")), "node").groupBy("tab", "key").agg(F.greatest(F.sum("w"), F.lit(1)).alias("n"))
    tiled = _tiled(apart, weights, tile_shingles, "root").join(sets, "node")
    return tiled.groupBy(*group).applyInArrow(_joined(radius, similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, parts: int = 6,
                    lower: bool = True, bands: tuple[int, int] | None = None, similarity: float | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest ``doc_id`` reachable over links, itself included."""
    found = stored(fingerprints(docs, id_col, text_col, words, lower, bands, similarity is not None), "fingerprints")
    pairs = links(found, radius, parts, bands is not None)
    if similarity is not None:
        pairs = stored(similar_links(docs, found, pairs, similarity, words, lower, id_col, text_col), "links")
    roots = components(pairs)
    if similarity is not None:
        missed = missed_links(found=found, docs=docs, roots=roots, radius=radius, similarity=similarity, words=words, lower=lower, id_col=id_col, text_col=text_col)
        roots = roots if missed is None else components(pairs.unionByName(missed))
    least = found.groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    members = classes.select("node", "root").join(named, "root").select("node", "component_id")
    return found.select("doc_id", "node").join(members, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
