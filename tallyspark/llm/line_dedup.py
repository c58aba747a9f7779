"""Line deduplication: two Bloom filters find the suspects, only those are shuffled and confirmed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, cut, whole

#: Lines of one segment of the hashes, whose owner holds two filters of 16 bits a line; distinct lines that a task sends at once.
SEGMENT, CHUNK = 1 << 18, 1 << 20


def keys_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys, in UTF-8; bytes.lower() folds A-Z only."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.split(b"\n"), [x.strip(WHITE) for x in raw.lower().split(b"\n")]


def positions(hashes: np.ndarray, bits: int, k: int = 4) -> np.ndarray:
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(k, dtype=np.uint64)) & np.uint64(bits - 1)


def has(bloom: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bloom[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(bloom: np.ndarray, at: np.ndarray) -> None:
    flat = np.unique(at)
    if len(flat):
        byte = (flat >> np.uint64(3)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bloom[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8), first)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """63 bits each; the lowest bit is left for whether several rows hold the key."""
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)) & ~np.uint64(1)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    return positions(hashes >> np.uint64(1), bits)


def line_hashes(texts: DataFrame, min_chars: int) -> DataFrame:
    """hashes (ascending, distinct), n: the lines of blocks of rows, CHUNK distinct lines a block; a line counts once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.uint64), 0
        parts: list[np.ndarray] = []

        def merge() -> np.ndarray:
            both = np.sort(np.concatenate([held, *parts]))
            key = both & ~np.uint64(1)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            again = (np.diff(np.r_[first, len(key)]) > 1) | (both[np.r_[first[1:], len(key)] - 1] != key[first]) if len(key) else np.zeros(0, bool)
            parts.clear()
            return key[first] | again.astype(np.uint64)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"hashes": pa.array([held.tobytes()], pa.binary()), "n": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                parts.append(_hashes([k for k in dict.fromkeys(keys_of(text.as_py())[1]) if _long_enough(k, min_chars)]))
                n += len(parts[-1])
                if n > CHUNK // 4:
                    held, n = merge(), 0
                    if len(held) > CHUNK:
                        yield block()
                        held = held[:0]
        held = merge()
        if len(held):
            yield block()

    return texts.select("text").mapInArrow(run, "hashes binary, n long")


def twice_seen(texts: DataFrame, min_chars: int, max_bits: int, segment_lines: int) -> tuple[np.ndarray, int]:
    """A filter of the lines that several rows may hold, in parts by the hash's first bits, and how many bits those are.

    Lines' hashes go to segments by their first bits, as many segments as the lines need. A segment's
    owner fills its two filters, once seen and twice seen, with the blocks that come in, and what the second holds is
    suspected; no line of two rows is missing. Of the suspects, not of all lines, a filter goes to all
    tasks: 16 bits each up to ``max_bits``, beyond which more lines pass than need to.
    """
    blocks = cut(line_hashes(texts, min_chars))
    lines = blocks.agg(F.sum("n")).first()[0] or 0
    lead = min(16, int(lines // segment_lines).bit_length())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                hashes = np.frombuffer(data.as_buffer(), np.uint64)
                of = (hashes >> np.uint64(64 - lead)).astype(np.int64) if lead else np.zeros(len(hashes), np.int64)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                yield pa.RecordBatch.from_pydict({"segment": pa.array(of[first], pa.int32()), "hashes": pa.array([x.tobytes() for x in np.split(hashes, first[1:])], pa.binary())})

    def own(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        bits = 1 << max(10, int(16 * sum(map(len, parts))).bit_length())
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for part in parts:
            at = _positions(part, bits)
            put(twice, at[(part & np.uint64(1) == 1) | has(once, at)])
            put(once, at)
        found = np.unique(np.concatenate([part[has(twice, _positions(part, bits))] & ~np.uint64(1) for part in parts]))
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "hashes": pa.array([found.tobytes()], pa.binary()), "n": pa.array([len(found)], pa.int64())})

    suspects = cut(blocks.select("hashes").mapInArrow(split, "segment int, hashes binary").groupBy("segment").applyInArrow(own, "segment int, hashes binary, n long"))
    n, few = suspects.agg(F.sum("n")).first()[0] or 0, min(lead, 8)
    bits = max(64, min(max_bits, 1 << int(16 * n).bit_length()) >> few)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        bloom = np.zeros(bits // 8, np.uint8)
        for x in table.column("hashes").to_pylist():
            put(bloom, _positions(np.frombuffer(x, np.uint64), bits))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bloom": pa.array([bloom.tobytes()], pa.binary())})

    parts = suspects.withColumn("part", F.call_function("shiftright", F.col("segment"), F.lit(lead - few))).groupBy("part").applyInArrow(fill, "part int, bloom binary")
    out = np.zeros((1 << few, bits // 8), np.uint8)
    for part, bloom in parts.collect():  # max_bits at most
        out[part] = np.frombuffer(bloom, np.uint8)
    return out.ravel(), few


def repeated_keys(texts: DataFrame, min_docs: int, min_chars: int = 1, max_bits: int = 1 << 28, segment_lines: int = SEGMENT) -> DataFrame:
    """key (binary), docs, first_id of the keys that at least min_docs rows hold. texts: text, id.

    Only lines that twice_seen() suspects are shuffled, and the count of those is exact. A task sends a
    suspect once per 100,000 distinct ones with the number of rows that hold it, so a line of a third of
    all rows costs a row per task.
    """
    found, few = twice_seen(texts, min_chars, max_bits, segment_lines)
    bits = len(found) * 8 >> few
    bloom = texts.sparkSession.sparkContext.broadcast(found)

    def suspected(hashes: np.ndarray) -> np.ndarray:
        part = hashes >> np.uint64(64 - few) if few else np.zeros(len(hashes), np.uint64)
        return has(bloom.value, _positions(hashes, bits) + (part * np.uint64(bits))[:, None])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"key": pa.array(list(seen), pa.binary()), "docs": pa.array([v[0] for v in seen.values()], pa.int64()), "first_id": pa.array([v[1] for v in seen.values()], pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text, id_ in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys = [k for k in dict.fromkeys(keys_of(text.as_py())[1]) if _long_enough(k, min_chars)]
                if not keys:
                    continue
                for k in np.flatnonzero(suspected(_hashes(keys))):
                    x = seen.setdefault(keys[k], [0, None])
                    x[0] += 1
                    if id_ is not None and (x[1] is None or id_ < x[1]):
                        x[1] = id_
                if len(seen) > 100_000:
                    yield flush()
        if seen:
            yield flush()

    found = texts.select("text", "id").mapInArrow(suspects, "key binary, docs long, first_id long")
    return found.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first_id").alias("first_id")).filter(F.col("docs") >= min_docs)


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: id, text without the dropped lines, n_lines, n_dropped.

    A line's key is the line stripped of the six ASCII white-space characters with A-Z lower-cased;
    ids must be integers. Keys of at least ``min_chars`` code points (1: not empty) that ``min_docs`` rows or more hold lose all
    their lines, or with ``keep_first`` all but the first line in the row of the smallest id. The keys
    to drop are broadcast up to ``max_broadcast_bytes``; beyond, each row gets its own by a join.

    Null and empty texts are one empty line, which stays. Repeated rows count as rows. An empty table
    gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    texts = df.select(whole(text_col).alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    drop = cut(repeated_keys(texts, min_docs, min_chars))
    size = drop.agg(F.sum(F.octet_length("key") + 80)).first()[0] or 0
    schema = "id long, text string, n_lines int, n_dropped int"

    def strip(text: str, id_: int | None, gone: dict[bytes, int | None]) -> tuple[str, int, int]:
        lines, keys = keys_of(text)
        kept, first = [], set()
        for line, key in zip(lines, keys, strict=True):
            if key not in gone or (keep_first and id_ is not None and gone[key] == id_ and key not in first):
                kept.append(line)
                first.add(key)
        return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)

    def batch_of(ids: list, rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "text": pa.array([r[0] for r in rows], pa.string()), "n_lines": pa.array([r[1] for r in rows], pa.int32()), "n_dropped": pa.array([r[2] for r in rows], pa.int32())})

    if size <= max_broadcast_bytes:
        gone = spark.sparkContext.broadcast({bytes(r.key): r.first_id for r in drop.collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(1).to_pylist()
                yield batch_of(ids, [strip(t.as_py(), i, gone.value) for t, i in zip(batch.column(0), ids, strict=True)])

        return texts.mapInArrow(apply, schema)

    rows = texts.withColumn("row", F.xxhash64("id", "text"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys = list(dict.fromkeys(keys_of(text.as_py())[1]))
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(keys), pa.int64()), "key": pa.array(keys, pa.binary())})

    own = rows.select("text", "row").mapInArrow(explode, "row long, key binary").join(drop, "key").dropDuplicates(["row", "key"])
    own = own.groupBy("row").agg(F.collect_list("key").alias("keys"), F.collect_list(F.coalesce("first_id", F.lit(-(1 << 63)))).alias("firsts"))

    def apply_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, keys, firsts = (c.to_pylist() for c in batch.columns)
            yield batch_of(ids, [strip(t, i, dict(zip(k or (), f or (), strict=True))) for t, i, k, f in zip(text, ids, keys, firsts, strict=True)])

    return rows.join(own, "row", "left").select("text", "id", "keys", "firsts").mapInArrow(apply_own, schema)
