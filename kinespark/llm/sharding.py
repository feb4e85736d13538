"""Shards of near-equal bytes by vector bin packing.

A group is the rows of equal text; its demand is a vector of bytes, words and rows.
Groups go, largest first, to the shard where the dot product of their demand with the
shard's residual capacity is highest, among the shards that still hold its bytes. Placing
every group one by one on the driver would not scale, so what is placed is bounded: groups
over 1/64 of a shard in some dimension are placed by themselves (there can be no more than
3 * 64 * shards of them), all others ride in ``BUNDLES_A_SHARD * shards`` hash bundles of
whole groups, each bundle an item with the summed demand of its groups.

A group stays in one shard unless its bytes exceed a whole shard's share, where near-equal
sizes and one shard a group exclude each other. Only such a group is cut, by row hash, into
pieces of at most about a quarter of a shard; it has at least 4 pieces.

Slots count from 0 without gaps: rows are numbered inside hash parts of a shard, and each
part starts where the parts before it end, so no task holds a whole shard.

Defined results: a null text has size 8, crc32 0 and is a group apart from empty texts; ids
may be of any type that sorts, may be null and may repeat, with a slot for each row; a text
of any length is read whole; ties go to the shard of the lowest number and, for slots, by id
and crc32; an empty table gives an empty table; ``law`` is ``bytes`` and ``grown_shard`` is
null. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import clear_of, named, stored

SHARDS = 24
BUNDLES_A_SHARD = 256
BIG, WHOLE, PIECE = 1 / 64, 1.0, 1 / 4  # of a shard's capacity
ROWS_A_PART = 20_000
WORD = r"[^\x20\x09-\x0D]+"
_DIMS = ("bytes", "words", "rows")


def place(demands: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``demands``, bytes first): largest first, by dot product with residual capacity.

    Only shards whose residual bytes hold the item compete; if none does, it goes where most bytes are left.
    """
    capacity = np.maximum(demands.sum(axis=0) / shards, 1e-9)
    need = demands / capacity
    residual = np.ones((shards, demands.shape[1]))
    out = np.zeros(len(demands), dtype=np.int32)
    for i in np.lexsort((np.arange(len(need)), -need.max(axis=1))) if len(need) else []:
        fits = residual[:, 0] >= need[i, 0] - 1e-12
        s = int(np.argmax(np.where(fits, residual @ need[i], -np.inf) if fits.any() else residual[:, 0]))
        residual[s] -= need[i]
        out[i] = s
    return out


def _local(spark, rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names))


def shard(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    clear_of(docs, id_col, text_col)
    spark = docs.sparkSession
    mine = named(text_col)
    text = F.coalesce(mine, F.lit(""))
    none = mine.isNull()
    base = stored(
        docs.select(
            named(id_col).alias("id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.when(none, F.lit(0).cast("long")).otherwise(F.xxhash64(mine)).alias("g1"),
            F.when(none, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(7), mine)).alias("g2"),
        )
    )
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    total = base.agg(*sums).first()
    capacity = {d: max(1.0, (total[d] or 0) / shards) for d in _DIMS}
    n_bundles = shards * BUNDLES_A_SHARD
    share = F.greatest(*(F.col(d) / F.lit(capacity[d]) for d in _DIMS))
    groups = base.groupBy("g1", "g2").agg(*sums).withColumn("share", share)
    big = [tuple(r) for r in groups.where(F.col("share") > BIG).select("g1", "g2", F.when(F.col("bytes") > F.lit(WHOLE * capacity["bytes"]), F.ceil(F.col("bytes") / F.lit(PIECE * capacity["bytes"]))).otherwise(1).cast("int").alias("pieces")).sort("g1", "g2").collect()]
    bigs = F.broadcast(_local(spark, big, ["g1", "g2", "pieces"], [pa.int64(), pa.int64(), pa.int32()]))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id", "g1"), F.col("pieces")).cast("int")).otherwise(F.lit(-1))
    bundle = F.pmod(F.col("g1"), F.lit(n_bundles)).cast("int")
    keyed = base.join(bigs, ["g1", "g2"], "left").withColumn("piece", piece)
    # an item is a piece of a big group, or a bundle of all other groups that hash to it
    item = [F.when(F.col("piece") >= 0, F.col("g1")).otherwise(bundle.cast("long")).alias("i1"), F.when(F.col("piece") >= 0, F.col("g2")).otherwise(F.lit(0).cast("long")).alias("i2"), F.col("piece").alias("i3")]
    keyed = keyed.select("id", "size", "words", "crc", *item)
    items = keyed.groupBy("i1", "i2", "i3").agg(*sums).sort("i1", "i2", "i3").collect()
    where = place(np.array([[r[d] for d in _DIMS] for r in items], dtype=float).reshape(-1, 3), shards)
    placed = F.broadcast(_local(spark, [(r.i1, r.i2, r.i3, int(s)) for r, s in zip(items, where, strict=True)], ["i1", "i2", "i3", "shard"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]))
    parts = max(1, -(-int(total["rows"]) // (shards * ROWS_A_PART)))
    rows = keyed.join(placed, ["i1", "i2", "i3"]).select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int").alias("part"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("shard", "part").orderBy("id", "crc")))
    return numbered.join(starts, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
