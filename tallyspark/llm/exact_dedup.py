"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, field, packed, small, whole

#: Bits of one bitmap, as Spark's bitmap functions have them.
BITMAP = 1 << 15


def _bit(n_bits: int) -> Column:
    """The bit that stands for a length and prefix hash."""
    return F.pmod(F.xxhash64("size", "prefix"), F.lit(n_bits))


def alike_bitmaps(alike: DataFrame, max_bits: int) -> tuple[DataFrame, int]:
    """Bitmaps of the (size, prefix) pairs in alike and their total bits, eight a pair up to ``max_bits``.

    A pair that isn't in alike finds its bit set by chance in one case of eight, and more often beyond
    ``max_bits`` / 8 pairs; its row is hashed for nothing then, the result is the same.
    """
    n_bits = max(BITMAP, min(max_bits, 1 << (8 * alike.count()).bit_length()))
    at = alike.select(_bit(n_bits).alias("bit"))
    place = F.floor(F.col("bit") / BITMAP).alias("place")
    return at.groupBy(place).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits")), n_bits


def marked(rows: DataFrame, bitmaps: DataFrame, n_bits: int) -> DataFrame:
    """rows with alike: whether their bit is set; the bitmaps, at most max_bits / 8 bytes, are broadcast."""
    bit = _bit(n_bits)
    rows = rows.withColumns({"bit": bit % BITMAP, "place": F.floor(bit / BITMAP)}).join(F.broadcast(bitmaps), "place", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")) % 2 == 1
    return rows.withColumn("alike", F.coalesce(hit, F.lit(False))).drop("bit", "place", "bits")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, max_bits: int = 1 << 28, max_broadcast: int = 300_000, hash_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, full_hash.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays. The
    levels read ever less: (1) rows whose byte length is shared, (2) of those, rows whose prefix hash
    is shared too, (3) of those, the SHA-256 of the whole text. Only keys of a few bytes are shuffled,
    never texts, and every grouping is aggregated before its shuffle, so a group of a third of all rows
    is one row per task. Which rows survive the second level is told to the scan by bitmaps of at most
    ``max_bits`` bits. The groups found come back to their rows by a broadcast if there are at most
    ``max_broadcast``, else by a join on the hash.

    Null text counts as empty, and empty texts form one group. A null id is smaller than any other.
    Rows repeated with one id and text: one of them is kept. An empty table gives no rows; other
    columns are ignored, so clashing names don't matter. full_hash is null for rows that no other row
    resembles (some of them have it all the same), unless ``hash_all``.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), ascii_lower(whole(text_col)).alias("body"))
    rows = rows.select("id", "body", F.octet_length("body").alias("size"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix"))
    keys = cut(rows.select("size", "prefix"))
    pairs = keys.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy("size").agg(F.sum("n").alias("total")).filter("total > 1").select("size")
    alike = cut(pairs.filter("n > 1").join(sizes, "size", "left_semi").select("size", "prefix"))
    rows = marked(rows, *alike_bitmaps(alike, max_bits))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    hashed = cut(rows.select("id", F.monotonically_increasing_id().alias("row"), "size", "alike", (digest if hash_all else F.when(F.col("alike"), digest)).alias("full_hash")))
    groups = cut(hashed.filter("alike").groupBy("size", "full_hash").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    out = hashed.join(small(groups, max_broadcast), ["size", "full_hash"], "left")
    return out.select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        "full_hash",
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 300_000) -> DataFrame:
    """df without the rows that exact_groups() doesn't keep; columns as they were, whatever their names.

    A dropped row is known by its id and its text's hash, which is taken only of rows whose id some
    dropped row has. Rows repeated with one id and text lose all but one; which of them stays is open,
    as they differ at most in other columns or letter case. An empty table gives no rows.
    """
    found = exact_groups(df, id_col, text_col, max_broadcast=max_broadcast)
    gone = cut(found.filter("not kept").select("id", F.xxhash64("full_hash").alias("digest"), F.col("id").eqNullSafe(F.col("keep_id")).alias("again")))
    rows, digest = packed(df), F.xxhash64(F.sha2(ascii_lower(whole(field(text_col))).cast("binary"), 256))
    # an equality of the hashes would be a join key, taken of every row; the difference is looked at after the ids
    same = field(id_col).eqNullSafe(F.col("id")) & (digest.bitwiseXOR(F.col("digest")) == 0)
    out = rows.join(small(gone, max_broadcast), same, "left_anti")
    again = gone.filter("again").select("id", "digest").distinct()
    if not again.isEmpty():
        back = rows.join(again, same, "left_semi").select("r", field(id_col).alias("id"), digest.alias("digest")).dropDuplicates(["id", "digest"])
        out = out.unionByName(back.select("r"))
    return out.select("r.*")
