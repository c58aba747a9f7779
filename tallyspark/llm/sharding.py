"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, field, packed, small, whole

#: Bits that the first pass over the sizes looks ahead, and those after it.
FIRST, STEP = 12, 6
#: Bits that a hash has; rows that share them all are dealt by their order instead.
BITS = 60


def _lead(bits: Column | int, h: Column | None = None) -> Column:
    """The first so many of the hash's 60 bits."""
    h = F.col("h") if h is None else h
    return F.call_function("shiftright", h, (F.lit(BITS) - bits).cast("int"))


def row_hash(id_: Column, body: Column) -> Column:
    """The first 60 bits of the MD5 of id:text."""
    text = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), body)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def shard_directory(keys: DataFrame, limit_bytes: int) -> tuple[DataFrame, list[int]]:
    """(depth, prefix, bytes, n) of every bucket that isn't split, and the depths that occur.

    keys: h, bytes. Each round sums the bytes per prefix of some more bits, of rows in oversized buckets
    only; a bucket is the shallowest prefix that fits or has one row, or one of BITS bits. A bucket's
    two halves are looked at together, and their sum tells whether it was split.
    """
    open_, found, depths, at = keys, [], [], 0

    def over(size: Column, n: Column) -> Column:
        return (size > limit_bytes) & (n > 1)

    while at < BITS:
        deep = min(BITS, at + STEP if at else FIRST)
        fine = cut(open_.groupBy(_lead(deep).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
        # all depths of this round from the sums at its end
        tree = fine.select(F.explode(F.sequence(F.lit(at + 1), F.lit(deep))).alias("depth"), "fine", "bytes", "n")
        tree = tree.groupBy("depth", F.call_function("shiftright", F.col("fine"), (F.lit(deep) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        halves = tree.groupBy("depth", F.call_function("shiftright", F.col("prefix"), F.lit(1)).alias("parent")).agg(F.sum("bytes").alias("size"), F.sum("n").alias("all"), F.collect_list(F.struct("prefix", "bytes", "n")).alias("halves"))
        leaf = halves.filter(over(F.col("size"), F.col("all"))).select("depth", F.explode("halves").alias("x")).select("depth", "x.*").withColumn("over", over(F.col("bytes"), F.col("n"))).filter(~F.col("over") | (F.col("depth") == deep))
        if at == 0:
            root = fine.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).filter("n IS NOT NULL").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "bytes", "n")
            leaf = leaf.unionByName(root.withColumn("over", over(F.col("bytes"), F.col("n"))).filter("NOT over"))
        leaf = cut(leaf)
        done = leaf.filter(~F.col("over") | F.lit(deep == BITS)).drop("over")
        left = leaf.filter(F.col("over") & F.lit(deep < BITS))
        found.append(done)
        depths += [r[0] for r in done.select("depth").distinct().collect()]
        if deep == BITS or left.isEmpty():
            break
        open_ = keys.withColumn("prefix", _lead(deep)).join(small(left.select("prefix"), 100_000), "prefix", "left_semi")
        at = deep
    return reduce(DataFrame.unionByName, found), sorted(set(depths))


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 128 << 20) -> DataFrame:
    """One row per input row: id, bytes, shard_id ('depth-prefix' in hex, with '.k' for parts of a full bucket), shard_depth, shard_bytes.

    The hash is that of id and text. Only oversized buckets split on another bit, until every shard
    fits ``limit_bytes``; a single row above the limit is a shard by itself. Rows whose whole hash is
    equal (repeated rows) can't be parted by bits: such a bucket is dealt by order of row number,
    which is counted within each scan partition, so no task sees all of a hot key's rows. Sums are
    aggregated before each shuffle. Null text has 0 bytes; a null id is hashed as an empty one; an
    empty table gives no rows; other columns are ignored.
    """
    keys = _keys(df.select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("body")), F.col("id"), F.col("body"))
    rows = cut(keys.select("id", "row", "h", "bytes"))
    return _assigned(rows, *_directory(rows, limit_bytes), limit_bytes).select("id", "bytes", "shard_id", "shard_depth", "shard_bytes")


def _keys(rows: DataFrame, id_: Column, body: Column) -> DataFrame:
    return rows.withColumns({"row": F.monotonically_increasing_id(), "h": row_hash(id_, body), "bytes": F.octet_length(body).cast("long")})


def _directory(keys: DataFrame, limit_bytes: int) -> tuple[DataFrame, list[int]]:
    directory, depths = shard_directory(keys.select("h", "bytes"), limit_bytes)
    return cut(directory.withColumnsRenamed({"bytes": "bucket_bytes", "n": "bucket_rows"})), depths


def _assigned(rows: DataFrame, directory: DataFrame, depths: list[int], limit_bytes: int) -> DataFrame:
    """rows (row, h, bytes and others) with shard_id, shard_depth, shard_bytes."""
    own = [c for c in rows.columns if c not in ("row", "h", "bytes")]
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _lead(d).alias("prefix")) for d in depths or [0]])).alias("at")
    rows = rows.select("*", at).select(*own, "row", "bytes", "at.depth", "at.prefix").join(small(directory, 200_000), ["depth", "prefix"])
    name = F.concat(F.col("depth").cast("string"), F.lit("-"), F.lower(F.hex("prefix")))
    over = (F.col("bucket_bytes") > limit_bytes) & (F.col("bucket_rows") > 1)
    fits = rows.filter(~over).select(*own, "bytes", name.alias("shard_id"), F.col("depth").alias("shard_depth"), F.col("bucket_bytes").alias("shard_bytes"))
    # equal hashes are equal texts, so the rows of a full bucket have one size and deal evenly
    full = rows.filter(over).withColumn("part", F.call_function("shiftright", F.col("row"), F.lit(33)))
    counts = full.groupBy("depth", "prefix", "part").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("depth", "prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("depth", "prefix", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("depth", "prefix", "part").orderBy("row"))
    full = full.withColumn("nth", nth).join(counts, ["depth", "prefix", "part"], "left")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.col("bytes"), F.lit(1))))
    k = F.floor((F.coalesce("before", F.lit(0)) + F.col("nth") - 1) / per)
    in_part = F.least(per, F.col("bucket_rows") - k * per)
    full = full.select(*own, "bytes", F.concat(name, F.lit("."), k.cast("string")).alias("shard_id"), F.col("depth").alias("shard_depth"), (in_part * F.col("bytes")).cast("long").alias("shard_bytes"))
    return fits.unionByName(full)


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 128 << 20) -> DataFrame:
    """Write df's rows as Parquet, a folder per shard, and return assign_shards().

    Every row is written once, with its columns as they were, null and repeated ids too; an empty table
    gives an empty folder. A column named shard_id, in whatever case, can't be kept beside the folders'
    own and is refused.
    """
    if any(c.lower() == "shard_id" for c in df.columns):
        raise ValueError("a column named shard_id")
    keys = cut(_keys(df.select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("body")), F.col("id"), F.col("body")).select("id", "row", "h", "bytes"))
    directory = _directory(keys, limit_bytes)
    rows = _assigned(_keys(packed(df), field(id_col), whole(field(text_col))), *directory, limit_bytes)
    rows.select("r.*", "shard_id").repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    return _assigned(keys, *directory, limit_bytes).select("id", "bytes", "shard_id", "shard_depth", "shard_bytes")
