"""LM scoring by context-tree weighting over bytes, beside a unigram base score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, cut, whole

_FOLD = bytes.maketrans(WHITE, b" " * len(WHITE))
_ZSTD = pa.Codec("zstd", 3)
#: Bytes of text that a task turns into arrays at once, of one block of texts, and of text per owner of grams or words.
CHUNK, BLOCK, SHARE = 1 << 20, 8 << 20, 16 << 20
#: Depth down to which the tree is one table of at most 256 ** (TOP + 1) keys; each subtree below it has an owner.
TOP = 1


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The context and byte at every position, as one integer of depth + 1 bytes, oldest first, and each text's first position.

    A text starts after ``depth`` zero bytes and ends with one, which is coded too.
    """
    gap = bytes(depth)
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    key = np.zeros(len(data) - depth, np.int64)
    for j in range(depth + 1):
        key = (key << 8) | data[j : len(data) - depth + j]
    starts = np.r_[0, np.cumsum(sizes + depth)[:-1]]
    coded = np.ones(len(key), bool)
    for j in range(1, depth):  # the gaps' other zeros
        at = starts + sizes + j
        coded[at[at < len(key)]] = False
    return key[coded], np.r_[0, np.cumsum(sizes + 1)[:-1]]


def compressed(data: bytes) -> bytes:
    return _ZSTD.compress(data, asbytes=True)


def decompressed(data: bytes, size: int) -> bytes:
    return _ZSTD.decompress(data, size, asbytes=True) if size else b""


def squeeze(values: np.ndarray) -> bytes:
    """An array compressed by byte planes."""
    return compressed(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unsqueeze(data: bytes, n: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(decompressed(data, width * n), np.uint8).reshape(width, n).T.copy().view(dtype).ravel()


def squeeze_keys(ascending: np.ndarray) -> bytes:
    return squeeze(np.diff(ascending, prepend=ascending.dtype.type(0)))


def unsqueeze_keys(data: bytes, n: int, dtype: type) -> np.ndarray:
    return np.cumsum(unsqueeze(data, n, dtype), dtype=dtype)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, n, len(unique)).astype(np.int64)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of n0 zeros and n1 ones in any order."""

    def half(n: np.ndarray) -> np.ndarray:  # log of (1/2)(3/2)...(n - 1/2)
        return _log_gamma(n + 0.5) - 0.5723649429247001

    return half(n0) + half(n1) - _log_gamma(n0 + n1 + 1.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 1/2: shifted by seven, then Stirling's series."""
    shift = np.ones_like(x, dtype=np.float64)
    for k in range(7):
        shift = shift * (x + k)
    y = x + 7.0
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


class Level:
    """One depth of the tree: its keys, context and byte, ascending, with their counts; a decision's counts are sums over a range."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys, self.sums = keys, np.r_[0, np.cumsum(n)]

    def nodes(self, bit: int) -> np.ndarray:
        """Contexts with the first ``bit`` bits of a byte after them."""
        return distinct(self.keys >> (8 - bit))

    def counts(self, nodes: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones that followed each node."""
        width = 8 - bit
        low = nodes << width
        a, b, c = (np.searchsorted(self.keys, x) for x in (low, low + (1 << (width - 1)), low + (1 << width)))
        return self.sums[b] - self.sums[a], self.sums[c] - self.sums[b]


def levels_of(keys: np.ndarray, n: np.ndarray, low: int, depth: int) -> list[Level]:
    """The levels from ``low`` to ``depth`` of distinct grams of that depth."""
    return [Level(*(summed(keys & ((1 << (8 * (d + 1))) - 1), n) if d < depth else (keys, n))) for d in range(low, depth + 1)]


Below = tuple[np.ndarray, np.ndarray]


def weigh(levels: list[Level], low: int, bit: int, below: Below | None = None) -> tuple[list[np.ndarray], Below]:
    """Weights of the decisions on one bit, from the deepest of these levels up to that of depth ``low``.

    A node's weighted probability of what followed it is the mean of its own estimate and the product of
    its children's. Given are, per level but a deepest without ``below``, the nodes' log odds of the own
    estimate against the children's, and the logs for the level above: its nodes, repeated, each with
    one child's. ``below`` has the same for the deepest level here.
    """
    odds: list[np.ndarray] = []
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].nodes(bit)
        own = log_kt(*levels[k].counts(nodes, bit))
        if below is None:
            weighted = own
        else:
            children = np.bincount(np.searchsorted(nodes, below[0]), below[1], len(nodes))
            weighted = np.logaddexp(own, children) - np.log(2)
            odds.insert(0, np.clip(own - children, -60, 60).astype(np.float32))
        below = nodes & ((1 << (8 * max(0, low + k - 1) + bit)) - 1), weighted
    return odds, below


class Tree:
    """A context tree with its weights: a whole one, or the top and one owner's subtrees.

    Each byte is eight binary decisions, and every decision, known by the bits before it, has a context
    tree of its own over the preceding bytes. odds[d][bit] has, per node, the log odds that weighting
    gives to its own estimate against its children's, from the whole training text. Coding mixes, from
    the deepest context seen upward, the estimates of all depths by them.
    """

    def __init__(self, levels: list[Level], odds: list[list[np.ndarray]]) -> None:
        self.levels, self.odds, self.depth = levels, odds, len(levels) - 1
        self.nodes = [[level.nodes(bit) for bit in range(8)] for level in levels[:-1]]

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte after its context."""
        total = np.zeros(len(key))
        for bit in range(8):
            p = np.full(len(key), -1.0)
            one = (key >> (7 - bit)) & 1 == 1
            for d in range(self.depth, -1, -1):
                node = (key & ((1 << (8 * (d + 1))) - 1)) >> (8 - bit)
                n0, n1 = self.levels[d].counts(node, bit)
                own = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1.0)
                if d < self.depth:
                    nodes, odds = self.nodes[d][bit], self.odds[d][bit]
                    w = odds[np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)] if len(nodes) else np.zeros(len(key))
                    share = 1 / (1 + np.exp(-w.astype(np.float64)))
                    own = np.where(p < 0, own, share * own + (1 - share) * p)
                p = np.where(n0 + n1 > 0, own, p)
            total += np.log10(np.where(p < 0, 0.5, p))
        return total


def owner(key: np.ndarray, top: int, parts: int) -> np.ndarray:
    """The part that has a gram's subtree, by the last top + 1 bytes of its context."""
    cell = ((key >> 8) & ((1 << (8 * (top + 1))) - 1)).astype(np.uint64)
    return (((cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def word_owner(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % parts


class Lookup:
    """An open-addressed hash table from distinct grams to numbers; every gram asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = 2 ** max(4, (2 * len(keys)).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.float32)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot, the last stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def get(self, key: np.ndarray) -> np.ndarray:
        slot = self._slots(key)
        out = self.values[slot].astype(np.float64)
        left = np.flatnonzero(self.keys[slot] != key)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == key[left]
            out[left[hit]] = self.values[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        return out


def held_out(id_: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32(id as text) mod parts is part; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % parts == part


def _word_hashes(raw: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in raw.translate(_FOLD).split(b" ") if w], np.uint64)


_ROW = "block long, part int, n int, keys binary, counts binary, texts binary, ids array<string>, held array<boolean>, sizes array<long>"


def text_blocks(base: DataFrame, depth: int, top: int, parts: int) -> DataFrame:
    """Blocks of texts and, per block and owner, the distinct grams (part from 0) and word hashes (part from ``parts``) with their training counts.

    base: id, held_out, text. A block's own row has part -1 and its texts, compressed.
    """
    kinds = {"block": pa.int64(), "part": pa.int32(), "n": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "texts": pa.binary(), "ids": pa.list_(pa.string()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64())}

    def dealt(keys: np.ndarray, counts: np.ndarray, of: np.ndarray, first: int) -> Iterator[tuple]:
        order = np.lexsort((keys, of))
        keys, counts, of = keys[order], counts[order].astype(np.uint32), of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
            yield int(of[a]) + first, int(b - a), squeeze_keys(keys[a:b]), squeeze(counts[a:b]), None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, size = TaskContext.get().partitionId() << 33, [], 0
        chunks: dict[bool, list[bytes]] = {False: [], True: []}
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[np.ndarray] = []

        def count(held: bool) -> None:
            if chunks[held]:
                unique, n = np.unique(grams(chunks[held], depth)[0], return_counts=True)
                seen.append((unique, n * (not held)))
                chunks[held].clear()

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            count(False), count(True)
            keys, n = summed(np.concatenate([k for k, _ in seen]), np.concatenate([c for _, c in seen]))
            trained = np.repeat(np.array([not held for _, held, _ in docs]), [len(h) for h in words])
            hashes, m = summed(np.concatenate(words), trained)
            texts = compressed(b"".join(raw for _, _, raw in docs))
            rows = [(-1, 0, None, None, texts, [d[0] for d in docs], [d[1] for d in docs], [len(d[2]) for d in docs])]
            rows += dealt(keys, n, owner(keys, top, parts), 0)
            rows += dealt(hashes, m, word_owner(hashes, parts), parts)
            columns = [[number] * len(rows), *zip(*rows, strict=True)]
            number, size = number + 1, 0
            docs.clear(), seen.clear(), words.clear()
            return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), columns, strict=True)})

        pending = {False: 0, True: 0}
        for batch in batches:
            for id_, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass").lower()
                docs.append((id_, held, raw))
                words.append(_word_hashes(raw))
                chunks[held].append(raw)
                size, pending[held] = size + len(raw) + 64, pending[held] + len(raw)
                if pending[held] > CHUNK:
                    count(held)
                    pending[held] = 0
                if size > BLOCK:
                    yield flush()
                    pending = {False: 0, True: 0}
        if docs:
            yield flush()

    return base.select("id", "held_out", "text").mapInArrow(run, _ROW)


def _counted(rows: pa.Table, dtype: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys that blocks sent an owner, the sums of their training counts, and each block's keys."""
    n = rows.column("n").to_pylist()
    keys = [unsqueeze_keys(k, m, dtype) for k, m in zip(rows.column("keys").to_pylist(), n, strict=True)]
    counts = [unsqueeze(c, m, np.uint32) for c, m in zip(rows.column("counts").to_pylist(), n, strict=True)]
    return *summed(np.concatenate(keys), np.concatenate(counts)), keys


def _subtrees(keys: np.ndarray, n: np.ndarray, top: int, depth: int) -> list[Level]:
    """An owner's levels below the top, of the grams that training has."""
    return levels_of(keys[n > 0], n[n > 0], top + 1, depth)


def train_top(blocks: DataFrame, depth: int, top: int, parts: int) -> tuple[list[Level], list[list[np.ndarray]]]:
    """The levels down to depth ``top`` with their odds; at most 256 ** (top + 1) keys reach the driver.

    Owners weigh their subtrees and send, per node of depth ``top``, the sum of the logs of its children
    there; the sums are of decimals, so they don't depend on order.
    """
    mask = (1 << (8 * (top + 1))) - 1

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys, n, _ = _counted(rows, np.int64)
        levels = _subtrees(keys, n, top, depth)
        out = [(-1, *summed(levels[-1].keys & mask, np.diff(levels[-1].sums)))]
        for bit in range(8):
            nodes, logs = weigh(levels, top + 1, bit)[1]
            unique, where = np.unique(nodes, return_inverse=True)
            out.append((bit, unique, np.bincount(where, logs, len(unique))))
        return pa.table({"bit": np.repeat(np.array([b for b, _, _ in out], np.int32), [len(k) for _, k, _ in out]), "node": np.concatenate([k for _, k, _ in out]), "value": np.concatenate([v for _, _, v in out]).astype(np.float64)})

    some = blocks.filter(F.col("part").between(0, parts - 1)).select("part", "n", "keys", "counts").groupBy("part").applyInArrow(run, "bit int, node long, value double")
    table = some.groupBy("bit", "node").agg(F.sum(F.col("value").cast("decimal(28,8)")).cast("double").alias("value")).toArrow()
    bits, nodes, values = (table.column(c).to_numpy() for c in ("bit", "node", "value"))
    order = np.lexsort((nodes, bits))
    bits, nodes, values = bits[order], nodes[order], values[order]
    levels = levels_of(nodes[bits < 0], values[bits < 0].astype(np.int64), 0, top)
    odds = [weigh(levels, 0, bit, (nodes[bits == bit], values[bits == bit]))[0] for bit in range(8)]
    return levels, [[odds[bit][d] for bit in range(8)] for d in range(top + 1)]


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, depth: int = 5, share: int = SHARE) -> DataFrame:
    """One row per input row: id (as a string), held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from rows that are not held_out(). score is the log10 probability that the context tree gives
    to the text, A-Z lower-cased, with its end. base_score adds log10((c+1)/(N+V+1)) over words and one end.

    The tree has every context counted in the training text, whatever its size, and no task has it whole:
    its subtrees below depth TOP, known by the bytes before a position, are dealt to owners, one per
    ``share`` bytes of text, as are the words, known by 64-bit hashes. A task turns its texts into
    blocks and sends each owner a block's distinct grams and words once, with their training counts.
    Owners sum the counts, weigh their subtrees and answer each block with probabilities and counts; the
    top of the tree, at most 65,536 keys, is broadcast. The blocks' texts, compressed, meet the answers in the end.

    Null text counts as empty: one token, the end. Without training rows every word has count 0 and the
    tree is empty, each bit a half. Repeated rows are scored, and learnt from, as rows. An empty table
    gives no rows; other columns are ignored.
    """
    base = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), held_out(F.col(f"`{id_col}`"), parts, part).alias("held_out"), whole(text_col).alias("text"))
    size, ends = base.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    top, owners = min(TOP, depth - 1), max(16, -(-(size or 0) // share))
    blocks = cut(text_blocks(base, depth, top, owners))
    sent = df.sparkSession.sparkContext.broadcast(train_top(blocks, depth, top, owners))

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        words = key[0].as_py() >= owners
        keys, n, asked = _counted(rows, np.uint64 if words else np.int64)
        if words:
            values, totals = n, (int(n.sum()), int((n > 0).sum()))
        else:
            levels, odds = sent.value
            below = _subtrees(keys, n, top, depth)
            more = [weigh(below, top + 1, bit)[0] for bit in range(8)]
            tree = Tree(levels + below, odds + [[more[bit][d] for bit in range(8)] for d in range(len(below) - 1)])
            values, totals = np.concatenate([tree.log10(keys[at : at + CHUNK // 16]) for at in range(0, len(keys), CHUNK // 16)]).astype(np.float32), (0, 0)
        out = [squeeze(values[np.searchsorted(keys, k)]) for k in asked]
        once = [pa.array([x, *[0] * (len(out) - 1)], pa.int64()) for x in totals]
        back = pa.nulls(len(out), pa.binary()) if words else rows.column("keys")  # a block knows its words' order
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "n": rows.column("n"), "keys": back, "answer": pa.array(out, pa.binary()), "tokens": once[0], "types": once[1]})

    asked = blocks.filter("part >= 0").select("block", "part", "n", "keys", "counts").groupBy("part")
    answers = cut(asked.applyInArrow(answer, "block long, part int, n int, keys binary, answer binary, tokens long, types long"))
    n, v = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    n, v = n + ends, v + (ends > 0)
    log_total, log_end = float(np.log10(n + v + 1)), float(np.log10(ends + 1))

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        of, sizes = rows.column("part").to_numpy(), rows.column("n").to_pylist()
        (own,) = np.flatnonzero(of < 0)
        doc = rows.select(["texts", "ids", "held", "sizes"]).slice(int(own), 1).to_pylist()[0]
        raw, texts = decompressed(doc["texts"], sum(doc["sizes"])), []
        for end, size in zip(np.cumsum(doc["sizes"]).tolist(), doc["sizes"], strict=True):
            texts.append(raw[end - size : end])

        def answered(some: np.ndarray, dtype: type) -> tuple[list[int], np.ndarray]:
            some = np.flatnonzero(some)
            some = some[np.argsort(of[some])].tolist()
            return some, np.concatenate([np.zeros(0, dtype), *[unsqueeze(rows.column("answer")[k].as_py(), sizes[k], dtype) for k in some]])

        each = [_word_hashes(text) for text in texts]
        hashes, where = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.zeros(len(hashes), np.int64)
        counts[np.lexsort((hashes, word_owner(hashes, owners)))] = answered(of >= owners, np.int64)[1]
        logs, known = np.log10(counts + 1.0), counts > 0
        some, values = answered((of >= 0) & (of < owners), np.float32)
        probabilities, found = Lookup(np.concatenate([np.zeros(0, np.int64), *[unsqueeze_keys(rows.column("keys")[k].as_py(), sizes[k], np.int64) for k in some]]), values), []
        first = 0
        while first < len(texts):
            last, held = first, 0
            while last < len(texts) and held <= CHUNK:
                held, last = held + len(texts[last]), last + 1
            gram, starts = grams(texts[first:last], depth)
            found += np.add.reduceat(probabilities.get(gram), starts).tolist()
            first = last
        n_words, n_known, base_score = [], [], []
        for at in np.split(where, np.cumsum([len(h) for h in each])[:-1]):
            n_words.append(len(at) + 1)
            n_known.append(int(known[at].sum()) + (ends > 0))
            base_score.append(float(logs[at].sum()) + log_end - (len(at) + 1) * log_total)
        return pa.table(
            {
                "id": pa.array(doc["ids"], pa.string()),
                "held_out": pa.array(doc["held"], pa.bool_()),
                "n_tokens": pa.array(n_words, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([n] * len(texts), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(found, pa.float64()),
                "bits_per_byte": pa.array(-np.array(found) * np.log2(10) / (np.array(doc["sizes"]) + 1), pa.float64()),
            }
        )

    texts = blocks.filter("part < 0").select("block", "part", "n", "keys", F.lit(None).cast("binary").alias("answer"), "texts", "ids", "held", "sizes")
    both = texts.unionByName(answers.select("block", "part", "n", "keys", "answer"), allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(finish, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
