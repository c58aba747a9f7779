"""Cost-balanced packing of tokenized documents into sequences of fixed capacity."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, whole

_encoders: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def encoder(model: str, ranks: str) -> Callable[[str], list[int]]:
    """text -> ids as tokenizers gives them with add_special_tokens=False.

    ranks holds the same vocabulary as merge ranks, which tiktoken reads four times as fast; texts
    that hold a special token's string go to tokenizers itself, which a worker loads when it meets one.
    """
    if (model, ranks) not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact: list[Tokenizer] = []
        with open(model, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            if not any(s in text for s in special):
                return fast(text)
            if not exact:
                exact.append(Tokenizer.from_file(model))
            return exact[0].encode(text, add_special_tokens=False).ids

        _encoders[model, ranks] = encode
    return _encoders[model, ranks]


def pack(lengths: list[int], capacity: int, linear: float, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), and what is left over.

    Estimated cost of a piece: linear * length + length squared, as attention stays within a piece.
    Pieces of capacity are sequences by themselves. The rest go, by descending cost, to the sequence of
    lowest cost that has room; what fits nowhere is cut to fill the sequences, again lowest cost first.
    There are as many sequences as the tokens fill; at the end the remainder gets sequences whose
    capacities are the powers of two that sum to it, so nothing is padded.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        full = n - n % capacity
        out += [[(d, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            rest.append((d, full, n - full))
    total = sum(p[2] for p in rest)
    rooms = [capacity] * (total // capacity)
    if last:
        rooms += [1 << b for b in range(total.bit_length() - 1, -1, -1) if total % capacity >> b & 1 and 1 << b < capacity]
    if not rooms:
        return out, rest
    room, cost = np.array(rooms), np.zeros(len(rooms))
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rooms]

    def put(k: int, d: int, s: int, n: int) -> None:
        bins[k].append((d, s, n))
        room[k] -= n
        cost[k] += linear * n + float(n) * n

    homeless = []
    for d, s, n in sorted(rest, key=lambda p: (-p[2], p[0])):
        k = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[k] >= n:
            put(k, d, s, n)
        else:
            homeless.append((d, s, n))
    left = []
    for d, s, n in homeless:
        while n:
            k = int(np.argmin(np.where(room > 0, cost, np.inf)))
            if not room[k]:
                left.append((d, s, n))
                break
            part = min(n, int(room[k]))
            put(k, d, s, part)
            s, n = s + part, n - part
    return out + bins, left


SCHEMA = "id string, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack_documents(df: DataFrame, model: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, linear: float = 6144.0, window: int = 1 << 20, with_ids: bool = True) -> DataFrame:
    """One row per piece: id (as a string), row, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each scan partition packs windows of about ``window`` tokens and hands what is left over to its
    next window, so there is no shuffle and a task holds one window, whatever the table's size; with
    some 500 sequences in a window, choosing among more gains nothing. ``linear`` is the linear cost of
    a token in units of one token pair of attention. sequence_id is the partition's number shifted by
    33 bits plus a count; a task run again gives the same pieces. row numbers the input rows likewise,
    so pieces of copies that share an id are told apart.

    Null or empty text is the end id alone. Null ids stay null; repeated rows are packed as rows of
    their own, with a row number each; a text longer than a sequence is cut; an empty table gives no rows; other columns are
    ignored. ids is null unless ``with_ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, base = encoder(model, ranks), 0, TaskContext.get().partitionId() << 33
        docs: list[tuple[tuple, np.ndarray, int, int]] = []  # id and row, ids of a span, its start, the document's tokens

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, number
            done, left = pack([len(x[1]) for x in docs], capacity, linear, last)
            cols: list[list] = [[] for _ in range(9)]
            for pieces in done:
                at = 0
                for d, s, n in pieces:
                    (id_, row), ids, start, total = docs[d]
                    span = ids[s : s + n]
                    for c, v in zip(cols, (id_, row, start + s, n, zlib.crc32(span.tobytes()), total, base + number, at, span.astype(np.int32) if with_ids else None), strict=True):
                        c.append(v)
                    at += n
                number += 1
            docs = [(docs[d][0], docs[d][1][s : s + n].copy(), docs[d][2] + s, docs[d][3]) for d, s, n in left]
            kinds = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.int32())]
            names = ["id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        held = rows = 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                docs.append(((id_, base + rows), ids, 0, len(ids)))
                rows += 1
                held += len(ids)
                if held >= window:
                    yield from flush(False)
                    held = sum(len(x[1]) for x in docs)
        if docs:
            yield from flush(True)

    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), whole(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)
