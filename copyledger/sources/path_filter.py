"""Bloom filters over full paths, stored as rows of one block each.

A path sets two bits in each of the four words of its block. Building one is a hash
aggregation, asking it a join on block numbers; neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ["w0", "w1", "w2", "w3"]
# Bits for each path: about one in 50,000 foreign paths looks known.
BITS_PER_PATH = 32


def blocks_for(paths: int) -> int:
    """Blocks of a filter over ``paths`` paths, a power of two, so that filters come
    in few sizes."""
    return 1 << max(paths * BITS_PER_PATH // (64 * len(WORDS)) - 1, 0).bit_length()


def _bits(word: int) -> Column:
    digest = f"xxhash64(full_path, {word + 1})"
    return F.expr(
        f"shiftleft(1L, cast({digest} & 63 as int)) | shiftleft(1L, cast(shiftright({digest}, 6) & 63 as int))"
    )


def build(paths: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w3) over the ``full_path`` of ``paths``."""
    marks = paths.select(
        F.pmod(F.xxhash64("full_path"), F.lit(blocks)).alias("block"), *[_bits(i).alias(w) for i, w in enumerate(WORDS)]
    )
    return marks.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def maybe_known(paths: DataFrame, filters: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Distinct full paths of ``paths`` that one of ``filters`` (rows and number of
    blocks) may hold. No path that a filter was built over is missing."""
    stored = None
    for rows, blocks in filters:
        rows = rows.withColumn("blocks", F.lit(blocks).cast("bigint"))
        stored = rows if stored is None else stored.unionByName(rows)
    asked = paths.select("full_path").where("full_path is not null").distinct()
    if stored is None:
        return asked.limit(0)
    sizes = F.array(*[F.lit(b).cast("bigint") for b in sorted({b for _, b in filters})])
    probes = asked.select(
        "full_path", F.explode(sizes).alias("_blocks"), *[_bits(i).alias(f"_{w}") for i, w in enumerate(WORDS)]
    ).withColumn("_block", F.pmod(F.xxhash64("full_path"), F.col("_blocks")))
    same = (F.col("_blocks") == F.col("blocks")) & (F.col("_block") == F.col("block"))
    for w in WORDS:
        same = same & (F.col(w).bitwiseAND(F.col(f"_{w}")) == F.col(f"_{w}"))
    return probes.join(stored, same, "left_semi").select("full_path").distinct()
