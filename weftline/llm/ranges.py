"""Deterministic range shards of a table by an integer id.

Sampled range bounds differ from run to run.  These follow from the rows alone:
ids are counted in equal-width cells, a cell that holds too many rows and more
than one id is counted again in finer cells, and a shard is a run of cells in id
order with about ``shard_rows`` rows, or more where there would be over
``SHARDS``.  An id with more rows than that (or the null id, which stands first)
is spread over several shards by a hash of the row.  Counts come to the driver
and go out again as small tables: at most ``CELLS`` of the first level (6 MB),
and ``FINER`` for each crowded cell, so for each shard at most, of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 1 << 16
CELLS = 4 * SHARDS
FINER = 1 << 4
SHARD = "__shard"


def _count(rows: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
    """(cell, rows, least id, largest id) of ids without their last ``shift`` bits."""
    counted = rows.groupBy(F.shiftright("id", shift).alias("cell")).agg(F.count(F.lit(1)), F.min("id"), F.max("id"))
    return list(zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True))


def _spread(ids: DataFrame, shard_rows: int) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """(least id, shift, cell, rows) of the cells in id order, the rows with a null id, and the rows of a shard."""
    n, none, lo, hi = ids.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull()), F.min("id"), F.max("id")).first()
    shard_rows = max(shard_rows, -(-n // SHARDS))
    if lo is None:
        return [], none, shard_rows
    bits = (hi - lo).bit_length()
    wide = min(CELLS, max(1 << 12, 4 * n // shard_rows)).bit_length() - 1
    shift, done, rows = max(0, bits - wide), [], ids.where("id is not null")
    while True:
        crowded = []
        for cell, count, least, most in _count(rows, shift):
            if count > shard_rows and least < most:
                crowded.append((cell,))
            else:
                done.append((least, shift, cell, count))
        if not crowded:
            return sorted(done), none, shard_rows
        cells = ids.sparkSession.createDataFrame(crowded, "crowded long")
        rows = rows.join(F.broadcast(cells), F.shiftright("id", shift) == F.col("crowded"), "left_semi")
        shift = max(0, shift - (FINER.bit_length() - 1))


def range_sharded(df: DataFrame, id_col: str, row_hash: Column, shard_rows: int) -> DataFrame:
    """``df`` with the long column SHARD, in id order; each shard is a partition."""
    spark = df.sparkSession
    cells, none, shard_rows = _spread(df.select(F.col(f"`{id_col}`").alias("id")), shard_rows)
    before, levels = none, {}
    for _, shift, cell, count in cells:
        levels.setdefault(shift, []).append((cell, before // shard_rows, -(-count // shard_rows)))
        before += count
    first, parts = F.lit(0), F.lit(max(1, -(-none // shard_rows)))
    out, helpers = df, []
    for k, (shift, found) in enumerate(sorted(levels.items())):
        names = [f"__cell{k}", f"__first{k}", f"__parts{k}"]
        table = spark.createDataFrame(found, ", ".join(f"{c} long" for c in names))
        out = out.join(F.broadcast(table), F.shiftright(F.col(f"`{id_col}`"), shift) == F.col(names[0]), "left")
        first, parts, helpers = F.coalesce(names[1], first), F.coalesce(names[2], parts), [*helpers, *names]
    # the hash's upper 31 bits say which of the parts
    part = F.shiftright(F.shiftrightunsigned(row_hash, 33) * parts, 31)
    shards = max(1, -(-before // shard_rows))
    return out.withColumn(SHARD, (first + part).cast("long")).drop(*helpers).repartitionById(shards, F.col(SHARD).cast("int"))
