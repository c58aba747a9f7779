"""JSON files that hold one array of objects, read by many tasks however few the files and wherever their lines break."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in '"{[}]']] = 1, 2, 3, 4, 5
_QUOTE, _OPEN, _CLOSE = 1, (2, 3), 4  # from _CLOSE on a level is left; only _CLOSE itself can end an element


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of quotes, braces and brackets; escaped quotes are left out."""
    kind = _KINDS[data]
    at = np.flatnonzero(kind)
    kind = kind[at]
    slashes = np.flatnonzero(data == 92)
    if len(slashes):
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(slashes) > 1], np.arange(len(slashes)), 0))  # the first of each one's run
        odd = slashes[(np.arange(len(slashes)) - run) % 2 == 0]  # the byte after these is escaped, if it is no slash
        escaped = (kind == _QUOTE) & np.isin(at - 1, odd, assume_unique=True)
        at, kind = at[~escaped], kind[~escaped]
    return at, kind


def _levels(at: np.ndarray, kind: np.ndarray, inside: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the closing braces outside of strings: their places, the depths that they lead to, and the depth at the end."""
    own = ~inside & (kind != _QUOTE)
    kinds = kind[own]
    after = depth + np.cumsum(np.where(kinds >= _CLOSE, -1, 1))
    ends = kinds == _CLOSE
    return at[own][ends], after[ends], int(after[-1]) if len(after) else depth


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The bytes of each run of a batch's rows that lie in one split, by file and first byte of the split."""
    file, block = (batch.column(k).to_numpy() for k in (0, 1))
    text = batch.column(2)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)
    edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield (int(file[a]), int(block[a])), data[offsets[a] : offsets[b]]


class _Summary:
    """What a split does to a reader that enters it outside (0) or inside (1) of a string, whatever its depth then."""

    def __init__(self) -> None:
        self.size = self.quotes = self.first = 0
        self.depth = [0, 0]
        self.ends: list[Counter] = [Counter(), Counter()]

    def add(self, data: np.ndarray) -> None:
        if not self.first:
            seen = data[:4096].tobytes().lstrip(b"\xef\xbb\xbf \t\r\n")
            self.first = seen[0] if seen else 0
        at, kind = _tokens(data)
        quotes = kind == _QUOTE
        inside = (np.cumsum(quotes) + self.quotes) % 2 == 1
        for k in (0, 1):
            _, after, self.depth[k] = _levels(at, kind, inside ^ (k == 1), self.depth[k])
            if len(after):
                low = int(after.min())
                self.ends[k] += Counter({low + int(x): int(n) for x, n in enumerate(np.bincount(after - low)) if n})
        self.quotes, self.size = (self.quotes + int(quotes.sum())) % 2, self.size + len(data)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int], _Summary] = {}
    for batch in batches:
        for key, data in _parts(batch):
            found.setdefault(key, _Summary()).add(data)
    for (file, block), s in found.items():
        ends = [pa.array([list(e.items())], pa.map_(pa.int64(), pa.int64())) for e in s.ends]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (file, block, s.size, s.quotes, s.first, *s.depth)] + ends, names=["file", "block", "size", "quotes", "first", "depth0", "depth1", "ends0", "ends1"])


def _cut(spark: SparkSession, paths: list[str]) -> str:
    """Where to cut: at line breaks if every file's first 64 KiB have one, as that makes few large rows, else at closing braces."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            head = bytes(stream.readNBytes(1 << 16))
        finally:
            stream.close()
        if b"\n" not in head or head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] not in (b"[", b"{"):
            return "}"
    return "\n"


def read_elements(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """The objects of each file's array by ``schema``, with src_file and src_index, their place in the array.

    Spark's own reader takes such a file in one task and holds all of its rows. Here the text reader cuts it
    at line breaks or closing braces, so its splits are read side by side. A first pass notes of each split its quotes
    and the depths it reaches, which tells where a reader of the whole file would be when it enters the
    next; a second one gives whole elements and, for those that lie in several splits, their pieces.
    Rows are parsed once and kept as Parquet in the shared folder, as their users read them several times.

    A file of one object instead of an array is one element; elements that are no objects, and what comes after the
    array, give no row; an element that can't be parsed has null fields, as has one that the file's end cuts off
    in part.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name")).collect()
    names, end = {r.file: r.name for r in files}, _cut(spark, [r.path for r in files])
    raw = spark.read.option("lineSep", end).text(paths)
    raw = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit(end)).cast("binary").alias("text"))
    shape = "file long, block long, size long, quotes long, first long, depth0 long, depth1 long, ends0 map<long,long>, ends1 map<long,long>"
    states: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    inside = depth = at = base = 0
    for s in sorted(raw.mapInArrow(_summaries, shape).collect(), key=lambda s: (s.file, s.block)):  # a row a split
        if s.block == 0:
            inside, depth, at, base = 0, 0, 0, int(s.first == ord("["))
        states[s.file, s.block] = (inside, depth, at, base, s.size)
        at += (s.ends1 if inside else s.ends0).get(base - depth, 0)
        depth += s.depth1 if inside else s.depth0
        inside = (inside + s.quotes) % 2

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest, done = None, [], 0
        inside = depth = at = base = size = 0

        def rows(values: pa.Array, first: int, piece: bool) -> pa.RecordBatch:
            n = len(values)
            place = pa.array(np.arange(first, first + n), pa.int64())
            block = pa.array([key[1]] * n if piece else [None] * n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([names[key[0]]] * n, pa.string()), place, block, values], names=["file", "src_file", "at", "piece", "text"])

        def over() -> Iterator[pa.RecordBatch]:
            if key is not None:
                if done != size:
                    raise RuntimeError("the splits of a file have changed between its two passes")
                if any(map(len, rest)):
                    yield rows(pa.array([b"".join(rest)], pa.binary()), at, True)

        for batch in batches:
            for now, data in _parts(batch):
                if now != key:
                    yield from over()
                    key, rest, done = now, [], 0
                    if key not in states:
                        raise RuntimeError("the splits of a file have changed between its two passes")
                    inside, depth, at, base, size = states[key]
                    whole = key[1] == 0  # the first element of a later split may have begun before
                done += len(data)
                places, kind = _tokens(data)
                quotes = kind == _QUOTE
                inner = (np.cumsum(quotes) + inside) % 2 == 1
                inside = (inside + int(quotes.sum())) % 2
                closed, after, depth = _levels(places, kind, inner, depth)
                stops = closed[after == base] + 1
                if not len(stops):
                    rest.append(data.tobytes())
                    continue
                yield rows(pa.array([b"".join([*rest, data[: stops[0]].tobytes()])], pa.binary()), at, not whole)
                if len(stops) > 1:
                    body = np.ascontiguousarray(data[stops[0] : stops[-1]])
                    yield rows(pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer((stops - stops[0]).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())]), at + 1, False)
                at, whole, rest = at + len(stops), True, [data[stops[-1] :].tobytes()]
        yield from over()

    found = raw.mapInArrow(elements, "file long, src_file string, at long, piece long, text binary")
    text = F.col("text").cast("string")
    parsed = lambda text: F.from_json(F.substr(text, F.locate("{", text)), schema)
    path = scratch.folder(spark, "elements")
    found.select("file", "src_file", "at", "piece", F.when(F.col("piece").isNotNull(), F.col("text")).alias("text"), F.when(F.col("piece").isNull(), parsed(text)).alias("r")).write.parquet(path)
    kept = spark.read.parquet(path)
    split = kept.filter("piece IS NOT NULL").groupBy("file", "src_file", "at").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("pieces"))  # some two rows a split
    split = split.select("src_file", "at", F.reduce("pieces", F.lit(b""), lambda text, x: F.concat(text, x["text"])).cast("string").alias("text")).filter(F.col("text").rlike(r"^[\s,\[]*\{"))
    out = kept.filter("piece IS NULL").select("src_file", "at", "r").unionByName(split.select("src_file", "at", parsed(F.col("text")).alias("r")))
    return out.select("r.*", "src_file", F.col("at").cast("int").alias("src_index"))
