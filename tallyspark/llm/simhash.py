"""SimHash near-duplicates: binary-trie self-joins of fingerprints, then connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, cut, field, give_back, lean, packed, small, whole

_FOLD = bytes.maketrans(WHITE, b" " * len(WHITE))
#: Node pairs held at once in a traversal, and leaf pairs compared at once.
FRONTIER, LEAVES = 1 << 14, 1 << 17
#: The wide fingerprint of near copies: 64-bit words, tables cut from it, bits of a table's key, bits by which keys may differ.
WORDS, TABLES, KEY_BITS, KEY_MOST = 6, 8, 24, 2
#: Keys of two MinHash values each, by which a set finds the centre of its group.
MINS = 8
#: Ranges of shingle hashes by which frequent shingles are told from rare ones.
RARE_BITS = 21
RARE = 1 << RARE_BITS


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased; bytes.lower() folds A-Z only."""
    return [w for w in text.encode("utf-8", "surrogatepass").lower().translate(_FOLD).split(b" ") if w]


def votes(hashes: np.ndarray) -> np.ndarray:
    """Per bit, how many of the hashes (rows of 64-bit words) have it."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    full = len(bits) // 255 * 255  # so many ones fit a byte
    out = bits[full:].sum(axis=0, dtype=np.int64)
    return out + bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included.

    A bit is 1 if it is set in over half the XXH64 values (seed 42) of the shingles; a text of fewer
    words has one shingle, one without words the fingerprint 0.
    """
    words = words_of(text)
    if not words:
        return 0
    body = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        total += votes(np.array([digest(body[a:b], 42) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)], "<u8"))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, fingerprint (the 64 bits as a signed long)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return df.select(F.col(f"`{id_col}`").alias("id"), of(whole(text_col)).alias("fingerprint"))


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles_of(text: str, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending; a text of fewer words has one, one without words none."""
    words = words_of(text)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(shingle, len(each))
    out = np.zeros(len(each) - n + 1 if n else 0, np.uint64)
    for j in range(n):
        out = _mix(out + each[j : len(each) - n + 1 + j])
    return np.unique(out)


def node_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes())


def wide_fingerprint(shingles: np.ndarray, words: int = WORDS) -> bytes:
    """The SimHash of a set of shingles in so many 64-bit words; zero bytes for an empty set."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), 65_536):
        part = shingles[at : at + 65_536]
        total += votes(np.stack([_mix(part + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(words)], axis=1))
    return np.packbits(2 * total > len(shingles), bitorder="little").tobytes()


def min_keys(shingles: np.ndarray) -> bytes:
    """MINS keys of 64 bits, each of two MinHash values of a set; zero bytes for an empty set."""
    if not len(shingles):
        return bytes(8 * MINS)
    least = np.array([(shingles * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min() for k in range(1, 2 * MINS + 1)], "<u8")
    return _mix(_mix(least[::2]) + least[1::2]).tobytes()


def alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether the Jaccard similarity of two sets, given as arrays, reaches ``similarity``; two empty ones are alike."""
    both = F.size(F.array_intersect(x, y))
    return both >= similarity * (F.size(x) + F.size(y) - both)


class Sets:
    """Union-find over positions, the smallest of a set its root; edges are the links that joined two sets."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a[k] and b[k]; of several links between two sets the first becomes an edge."""
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            hooked, first = np.unique(np.maximum(x, y), return_index=True)
            self.root[hooked] = np.minimum(x, y)[first]
            self.edges.append((a[first], b[first]))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def trie_links(keys: np.ndarray, depth: int, bits: int, most: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int, orders: list[np.ndarray]) -> Sets:
    """Sets of keys that links connect: pairs at a distance up to ``limit`` whose keys share ``depth`` bits and differ in at most ``most``.

    keys: ascending, ``bits`` bits each, from the highest down. The trie is implicit: a node is a range
    of keys that share their first bits. Every node at ``depth`` is paired with itself, and pairs of
    nodes are descended together, level by level in blocks of a stack, adding up the bits by which they
    differ; a pair is dropped when that exceeds ``most`` or when both its nodes lie in one set already,
    which keeps a dense group of near copies from costing the square of its size. For the same reason
    neighbours in each of ``orders`` are looked at first.
    """
    sets = Sets(len(keys))

    def link(x: np.ndarray, y: np.ndarray) -> None:
        far = distance(x, y)
        near = np.flatnonzero(far <= limit)
        near = near[np.argsort(far[near], kind="stable")]
        sets.link(x[near], y[near])

    for values in orders:
        order = np.argsort(values, kind="stable")
        link(order[1:], order[:-1])
    zeros: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        if level not in zeros:
            zeros[level] = np.r_[0, np.cumsum((keys >> np.uint64(63 - level)) & np.uint64(1) == 0)]
        return lo + zeros[level][hi] - zeros[level][lo]

    def joined(pairs: np.ndarray) -> np.ndarray:
        """Whether all keys of both nodes are in one set."""
        out, root = np.zeros(len(pairs), bool), sets.root
        change = np.r_[0, np.cumsum(root[1:] != root[:-1])]
        one = (change[pairs[:, 1] - 1] == change[pairs[:, 0]]) & (change[pairs[:, 3] - 1] == change[pairs[:, 2]])
        out[one] = root[pairs[one, 0]] == root[pairs[one, 2]]
        return out

    def compare(leaves: np.ndarray) -> None:
        width = leaves[:, 3] - leaves[:, 2]
        size = (leaves[:, 1] - leaves[:, 0]) * width
        ends, first = np.cumsum(size), 0
        while first < len(leaves):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LEAVES, "right")))
            if size[first] > LEAVES:  # equal keys, too many for one block
                a, b, c, d = leaves[first, :4]
                step = max(1, LEAVES // int(d - c))
                for lo in range(a, b, step):
                    rows = np.arange(lo, min(b, lo + step))
                    link(np.repeat(rows, d - c), np.tile(np.arange(c, d), len(rows)))
                last = first + 1
            else:
                some, n = leaves[first:last], size[first:last]
                row = np.repeat(np.arange(len(some)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                wide = width[first:last][row]
                x, y = some[row, 0] + k // wide, some[row, 2] + k % wide
                link(x[x != y], y[x != y])
            first = last

    head = keys >> np.uint64(64 - depth) if depth else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(keys) else np.zeros(0, np.int64)
    stops = np.r_[starts[1:], len(keys)]
    several = stops - starts > 1
    starts, stops = starts[several], stops[several]
    stack = [(depth, np.c_[starts, stops, starts, stops, np.zeros(len(starts), np.int64)])]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(level, pairs[k : k + FRONTIER]) for k in range(0, len(pairs), FRONTIER)]
            continue
        pairs = pairs[~joined(pairs)]
        leaf = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 64) | (level == bits)
        if leaf.any():
            compare(pairs[leaf])
        pairs = pairs[~leaf]
        if len(pairs):
            lo, hi, lo2, hi2, off = pairs.T
            mid, mid2 = middle(lo, hi, level), middle(lo2, hi2, level)
            same = (lo == lo2) & (hi == hi2)
            children = [np.c_[lo, mid, lo2, mid2, off], np.c_[mid, hi, mid2, hi2, off]]
            more = off < most
            children.append(np.c_[lo, mid, mid2, hi2, off + 1][more])
            children.append(np.c_[mid, hi, lo2, mid2, off + 1][more & ~same])
            pairs = np.concatenate(children)
            pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])]
            if len(pairs):
                stack.append((level + 1, pairs))
    return sets


def turned(words: np.ndarray, table: int, block: int, bits: int, most: int) -> tuple[np.ndarray, int]:
    """Keys of a table from the highest bit down, turned so that a block comes first, and the block's bits.

    words: rows of 64-bit words, of which table k has the bits from k * bits on. A key's bits fall into
    ``most`` + 1 blocks; keys that differ in at most ``most`` bits agree in one block at least.
    """
    at, shift = divmod(table * bits, 64)
    key = words[:, at] << np.uint64(shift)
    if shift + bits > 64:
        key = key | (words[:, at + 1] >> np.uint64(64 - shift))
    edges = [bits * k // (most + 1) for k in range(most + 2)]
    first, size = edges[block], edges[block + 1] - edges[block]
    key = key >> np.uint64(64 - bits)
    if first:
        key = (key << np.uint64(first)) | (key >> np.uint64(bits - first))
    return key << np.uint64(64 - bits) if bits < 64 else key, size


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it in one of the columns."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)][: len(columns[0])]


def _matrix(column: pa.ChunkedArray | pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def near_links(nodes: DataFrame, rows: int, words: int, tables: int, bits: int, most: int, limit: int, stars: bool, block_rows: int = 1 << 14) -> DataFrame:
    """u, v (v < u): links of nodes whose fingerprints differ in at most ``limit`` bits and one table's keys in at most ``most``.

    nodes: node, words (binary). A table's trie is partitioned by block: nodes that share the block's
    bits meet in one subtree, so a fingerprint is sent ``most`` + 1 times per table, however many there
    are. Subtrees under a block's first bits are one group of about ``block_rows`` keys, sixteen groups a
    block at least. With ``stars`` each set's nodes are linked to its smallest; else the links are those
    found, as few as connect the same.
    """
    blocks, least = most + 1, bits // (most + 1)
    lead = min(least, max(4, int(np.ceil(np.log2(max(1, rows / block_rows))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1), words)
            for table in range(tables):
                for block in range(blocks):
                    key, _ = turned(matrix, table, block, bits, most)
                    group = (key >> np.uint64(64 - lead)).astype(np.int64) | (table * blocks + block) << 32
                    yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(0), batch.column(1)], names=["part", "node", "words"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        place = key[0].as_py() >> 32
        matrix, node = _matrix(table.column("words"), words), table.column("node").to_numpy()
        keys, depth = turned(matrix, *divmod(place, blocks), bits, most)
        order = np.lexsort((node, keys))
        keys, matrix, node = keys[order], matrix[order], node[order]

        def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), np.int64)
            for at in range(0, len(x), LEAVES):
                out[at : at + LEAVES] = np.bitwise_count(matrix[x[at : at + LEAVES]] ^ matrix[y[at : at + LEAVES]]).sum(axis=1, dtype=np.int64)
            return out

        orders = [matrix[:, k] for k in range(words)] if words > 1 else [(keys << np.uint64(k)) | (keys >> np.uint64(64 - k)) if k else keys for k in (0, 16, 32, 48)]
        sets = trie_links(keys, depth, bits, most, distance, limit, orders)
        if stars:
            a = np.flatnonzero(sets.root != np.arange(len(keys)))
            b = sets.root[a]
        else:
            a, b = (np.concatenate([np.zeros(0, np.int64), *[e[k] for e in sets.edges]]) for k in (0, 1))
        give_back()
        return pa.table({"u": np.maximum(node[a], node[b]), "v": np.minimum(node[a], node[b])})

    return nodes.select("node", "words").mapInArrow(lean(deal), "part long, node long, words binary").groupBy("part").applyInArrow(join, "u long, v long").distinct()


def centres(key: np.ndarray, node: np.ndarray, words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the centre of those with its key, if their fingerprints differ in at most ``limit`` bits.

    The centre is the node nearest to the majority of their fingerprints' bits, of several the smallest.
    """
    order = np.lexsort((node, key))
    key, node, words = key[order], node[order], words[order]
    starts = np.flatnonzero(_heads(key))
    stops = np.r_[starts, len(key)][1:]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in zip(*(x[stops - starts > 1].tolist() for x in (starts, stops)), strict=True):
        some, rows = node[lo:hi], words[lo:hi]
        middle = np.packbits(2 * votes(rows) > hi - lo, bitorder="little").view("<u8")
        centre = np.bitwise_count(rows ^ middle).sum(axis=1, dtype=np.int64).argmin()
        near = (np.bitwise_count(rows ^ rows[centre]).sum(axis=1, dtype=np.int64) <= limit) & (some != some[centre])
        found.append((some[near], np.full(near.sum(), some[centre])))
    u, v = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return np.maximum(u, v), np.minimum(u, v)


def centre_links(nodes: DataFrame, rows: int, limit: int, block_rows: int = 1 << 16) -> DataFrame:
    """u, v (v < u): links of nodes that share a key with its centre; nodes: node, words, keys (MINS of 64 bits).

    A text that few of its group's are like is mostly like the group's centre, so this connects dense groups
    of loose copies by MINS links a node at most; what it misses is left to prefix_links.
    """
    lead = max(8, math.ceil(math.log2(max(1, MINS * rows / block_rows))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _matrix(batch.column(2), MINS)
            for k in range(MINS):
                key = _mix(keys[:, k] + np.uint64(k))
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(64 - lead)).astype(np.int64)), pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], names=["part", "key", "node", "words"])

    def join(table: pa.Table) -> pa.Table:
        u, v = centres(table.column("key").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("words"), WORDS), limit)
        give_back()
        return pa.table({"u": u, "v": v})

    return nodes.select("node", "words", "keys").mapInArrow(lean(deal), "part long, key long, node long, words binary").groupBy("part").applyInArrow(join, "u long, v long").distinct()


def components(links: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """node, root (the smallest node reachable) of every node in links (u, v; v < u).

    Alternating large-star and small-star rounds until nothing changes, each written to the shared
    folder. A round is two aggregates and two joins with what they give; where there are at most
    ``max_broadcast`` links, that is broadcast, so that a hub's links stay where they are; beyond, Spark
    shuffles the links and can split a hub's.
    """
    links = cut(links)
    state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        hint = F.broadcast if state[0] <= max_broadcast else (lambda df: df)
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(hint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(hint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        links = cut(near.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, the smallest id that links reach.

    Two fingerprints link at ``most`` or fewer differing bits. Equal fingerprints are one class, counted
    before the shuffle, so exact copies cost one row; links are found between classes, and only stars
    that connect the same are ever sent, never all pairs of a group.

    Null and empty texts have the fingerprint 0, which links like any other. Null ids never name a
    component unless all of its ids are null. Repeated rows share a component. An empty table gives no
    rows; other columns are ignored.
    """
    rows = cut(fingerprints(df, id_col, text_col, shingle))
    classes = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))

    @F.arrow_udf("binary")
    def as_bytes(values: pa.Array) -> pa.Array:
        return pa.array([v.tobytes() for v in values.to_numpy().astype("<i8")], pa.binary())

    nodes = classes.select(F.col("fingerprint").alias("node"), as_bytes("fingerprint").alias("words"))
    members = components(near_links(nodes, classes.count(), 1, 1, 64, most, most, stars=True))
    labelled = classes.join(members, classes.fingerprint == members.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(roots, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _row_key(id_: Column, text: Column) -> list[Column]:
    """128 bits that stand for an id and text."""
    return [F.xxhash64(id_, whole(text)).alias("a"), F.xxhash64(F.lit(7), id_, whole(text)).alias("b")]


def rarity(df: DataFrame, text_col: Column, shingle: int) -> np.ndarray:
    """How frequent the shingles of each of RARE hash ranges are, in steps of a fourth of a power of two; every row is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARE, np.int64)
        for batch in batches:
            some = [shingles_of(t.as_py(), shingle) for t in batch.column(0)]
            for at in range(0, len(some), 1024):
                total += np.bincount((np.concatenate(some[at : at + 1024]) >> np.uint64(64 - RARE_BITS)).astype(np.int64), minlength=RARE)
        for k, part in enumerate(total.reshape(64, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.astype("<u4").tobytes()], pa.binary())], names=["k", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("n"))
        return pa.table({"k": table.column("k")[:1], "n": pa.array([np.floor(4 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros((64, RARE // 64), np.uint8)
    for r in df.select(text_col.alias("text")).mapInArrow(lean(count), "k long, n binary").groupBy("k").applyInArrow(add, "k long, n binary").collect():
        out[r.k] = np.frombuffer(r.n, np.uint8)
    return out.reshape(-1)


def prefix_pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of nodes of two roots that share a token of their prefixes and can have this similarity.

    place: of the token in its node's order. Where it is the first that both have, no more than what follows
    it is shared, and sizes differ by no more than the similarity lets them; every pair that is alike passes
    at that token. Pairs of one root are not looked at, so a group that is connected but for a few nodes costs
    no more than those times its size.
    """
    order = np.lexsort((node, size, token))
    again = (token[order[1:]] == token[order[:-1]]) & (node[order[1:]] == node[order[:-1]])  # rows of one set
    order = order[np.r_[True, ~again]] if len(order) else order
    token, node, size, place, root = (x[order] for x in (token, node, size, place, root))
    order = np.lexsort((root, token))
    token, node, size, place, root = (x[order] for x in (token, node, size, place, root))
    block = np.cumsum(_heads(token, root)) - 1
    order = np.lexsort((block, -np.bincount(block)[block], token))  # a token's largest root first: its rows meet no others of it
    token, node, size, place, root = (x[order] for x in (token, node, size, place, root))
    first, own = (np.maximum.accumulate(np.where(heads, np.arange(len(token)), 0)) for heads in (_heads(token), _heads(token, root)))
    at = np.flatnonzero(own > first)  # each meets its token's rows of the roots before its own
    ends = np.cumsum(own[at] - first[at])
    found, held, lo = [np.zeros((0, 2), np.int64)], 0, 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 8 * LEAVES, "right")))
        some = at[lo:hi]
        n = own[some] - first[some]
        a = np.repeat(some, n)
        b = np.arange(len(a)) + np.repeat(first[some] - (np.cumsum(n) - n), n)
        most = np.minimum(size[a] - place[a], size[b] - place[b])
        near = most >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6  # sizes too far apart fail as well
        u, v = node[a[near]], node[b[near]]
        found.append(np.c_[np.maximum(u, v), np.minimum(u, v)])
        held += len(u)
        if held > 1 << 21:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = len(found[0])
        lo = hi
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def prefix_links(texts: DataFrame, members: DataFrame, weights: np.ndarray, shingle: int, similarity: float, tokens: int, max_broadcast: int, block_rows: int = 1 << 16) -> DataFrame:
    """u, v (v < u): pairs of nodes of two components that may be alike, with all that are; texts: text; members: node, root.

    A set's node is the hash that node_of() gives.

    A text's shingles are put in one order for all, rare ones first. Two sets of a Jaccard similarity
    have a shingle in common among each one's first n - ceil(similarity * n) + 1, whatever that order; so
    only these are sent, and pairs that meet at none can't be alike.
    """
    lead = max(8, math.ceil(math.log2(max(1, tokens / block_rows))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = [shingles_of(t.as_py(), shingle) for t in batch.column(0)[at : at + 512]]
                taken = []
                for x in some:
                    n = len(x) - math.ceil(similarity * len(x) - 1e-6) + 1 if len(x) else 0
                    taken.append(x[np.argsort(weights[(x >> np.uint64(64 - RARE_BITS)).astype(np.int64)], kind="stable")[:n]])
                n = np.fromiter(map(len, taken), np.int64, len(taken))
                token = np.concatenate(taken)
                place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
                sizes = np.repeat(np.fromiter(map(len, some), np.int64, len(some)), n)
                nodes = np.repeat(np.fromiter(map(node_of, some), np.uint64, len(some)).view(np.int64), n)
                part = (_mix(token) >> np.uint64(64 - lead)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, token.view(np.int64), nodes, sizes.astype(np.int32), place.astype(np.int32))], names=["part", "token", "node", "size", "place"])

    def join(table: pa.Table) -> pa.Table:
        u, v = prefix_pairs(*[table.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "size", "place", "root")], similarity)
        give_back()
        return pa.table({"u": u, "v": v})

    sent = texts.select("text").mapInArrow(lean(deal), "part long, token long, node long, size int, place int")
    rooted = sent.join(small(members, max_broadcast), "node", "left").select("part", "token", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    return rooted.groupBy("part").applyInArrow(join, "u long, v long").distinct()


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_broadcast: int = 1_000_000) -> DataFrame:
    """df with one row of each group of near copies, that of the smallest id; columns as they were, whatever their names.

    Two texts are near copies if the Jaccard similarity of their sets of ``shingle``-word shingles is
    ``similarity`` or more; a group is what such links connect. First candidates come from trie self-joins of
    a wide SimHash (WORDS 64-bit words of the set): texts of that similarity differ in a known share of
    bits, so the budget is that share and three standard deviations; each of TABLES tables joins keys of
    KEY_BITS bits at a Hamming budget of KEY_MOST. Texts that share MinHash values are linked to the most
    central of them besides (see centre_links). Both connect most groups, dense ones above all, but miss some pairs; so texts of two components that share a shingle of their prefixes are candidates as well,
    which leaves no pair out (see prefix_links). Every link is confirmed by the shingles themselves.

    Null text counts as empty; texts without words are one group, shorter ones have one shingle. Of a
    group the row of the smallest id stays, null after all others, ties by a hash of the text; rows
    repeated with one id and text lose all but one. An empty table gives no rows.
    """

    def print_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py(), shingle) for t in batch.column(3)]
            words = pa.array([wide_fingerprint(x) for x in sets], pa.binary())
            node = pa.array(np.fromiter(map(node_of, sets), np.uint64, len(sets)).view(np.int64))
            size, keys = pa.array([len(x) for x in sets], pa.int64()), pa.array([min_keys(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], words, node, size, keys], names=["id", "a", "b", "words", "node", "size", "keys"])

    @F.arrow_udf("array<long>")
    def set_of(texts: pa.Array) -> pa.Array:
        out = pa.array([shingles_of(t.as_py(), shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))
        give_back()
        return out

    rows = packed(df)
    keyed = rows.select("r", *_row_key(field(id_col), field(text_col)))
    texts = rows.select(field(id_col).alias("id"), *_row_key(field(id_col), field(text_col)), whole(field(text_col)).alias("text"))
    prints = cut(texts.mapInArrow(lean(print_of), f"id {texts.schema['id'].dataType.simpleString()}, a long, b long, words binary, node long, size long, keys binary"))
    classes = cut(prints.groupBy("node").agg(F.min("words").alias("words"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "a", "b")).alias("least"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("keys").alias("keys")))
    tokens = classes.agg(F.sum(F.ceil((1 - similarity) * F.col("size")) + 1)).first()[0] or 0

    share, width = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WORDS
    limit = math.ceil(width * (share + 3 * math.sqrt(share * (1 - share) / width)))

    def confirmed(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
        asked = cut(classes.join(ends, "node", "left_semi").select("node", F.col("least.a").alias("a"), F.col("least.b").alias("b")))
        sets = cut(keyed.join(small(asked, max_broadcast), ["a", "b"]).dropDuplicates(["node"]).select("node", set_of(whole(field(text_col))).alias("set")))
        pairs = links.join(sets.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
        return pairs.filter(alike(F.col("x"), F.col("y"), similarity)).select("u", "v")

    filled, count = classes.filter("size > 0"), classes.count()
    candidates = near_links(filled, count, WORDS, TABLES, KEY_BITS, KEY_MOST, limit, stars=False).union(centre_links(filled, count, limit))
    first = cut(confirmed(cut(candidates.distinct())))
    members = components(first)
    weights = rarity(rows, whole(field(text_col)), shingle)
    second = cut(confirmed(cut(prefix_links(texts, members, weights, shingle, similarity, tokens, max_broadcast))))
    if not second.isEmpty():
        members = components(first.union(second))

    labelled = classes.join(members, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    best = labelled.groupBy("root").agg(F.min("least").alias("best"), F.sum("n").alias("all")).filter(F.col("all") > 1).drop("all")
    best = labelled.join(best, "root").select("node", F.col("best.a").alias("own_a"), F.col("best.b").alias("own_b"))
    gone = cut(prints.join(small(cut(best), max_broadcast // 4), "node").filter("a != own_a OR b != own_b").select("a", "b").distinct())
    again = cut(prints.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"))
    out = keyed.join(small(gone, max_broadcast), ["a", "b"], "left_anti")
    if not again.isEmpty():
        again = small(again, max_broadcast)
        out = out.join(again, ["a", "b"], "left_anti").select("r").unionByName(out.join(again, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]).select("r"))
    return out.select("r.*")
