"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn exactly as a uniform permutation of all rows
would deal them; each block then permutes its rows and sends the first so many to shard 0, the next to shard 1, and so on.
Each shard permutes what it gets, in tiles by a random key, so no task holds a shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows of a block and of a tile; more blocks than MOST are not made, they grow instead.
BLOCK_ROWS, MOST = 10_000, 65_536


def _log_factorials(x: int, d: int) -> float:
    """log((x + d)! / x!), exact to many digits also where both are far beyond what lgamma tells apart."""
    if min(x, x + d) < 1_000_000:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1)
    return (x + d + 0.5) * math.log1p(d / x) + d * math.log(x) - d + (1 / (x + d) - 1 / x) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good: ratio of uniforms, whose work doesn't grow with the numbers.

    A point under the table mountain hat is taken if it lies below the probabilities' ratio to that of the mode, so the draw
    has the hypergeometric law at any size.
    """
    total = good + bad
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if not good or not n:
        return 0
    mean, most = n * good / total, min(n, good)
    mode = (n + 1) * (good + 1) // (total + 2)
    # The hat's width 2 sqrt(2/e) of a standard deviation, and 3 - 2 sqrt(3/e)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(mean * (bad / total) * ((total - n) / max(1, total - 1)) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(2)
        if not u:
            continue
        x = mean + 0.5 + width * (v - 0.5) / u
        if not 0 <= x < most + 1:
            continue
        k = int(x)
        d = k - mode
        log = -_log_factorials(mode, d) - _log_factorials(good - mode, -d) - _log_factorials(n - mode, -d) - _log_factorials(bad - n + mode, d)
        if 2 * math.log(u) <= log:
            return k


def communication(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Counts by block and shard: rows and columns sum to the given sizes, drawn as by a uniform permutation."""
    rng, left, matrix = np.random.default_rng(seed), list(shard_rows), []
    for n in block_rows:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            x = hypergeometric(rng, room, rest - room, n)
            rest -= room
            n -= x
            row.append(x)
            left[s] -= x
        matrix.append(row)
    return matrix


def uniform_shards(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs: shard sizes differ by one at most.

    size is the text's UTF-8 bytes plus 1, 1 if it is null. Equal rows, rows with equal ids and rows without an id are
    rows like others. Of docs, only the two columns are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    rows = shared.stash(rows, "rows")
    total = rows.count()
    blocks = max(1, min(MOST, -(-total // block_rows)))
    tiles = max(1, min(MOST, -(-total // (shards * block_rows))))
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "row")
    rows = rows.withColumn("block", F.pmod(key(1), F.lit(blocks)).cast("int")).withColumn("tile", F.pmod(key(2), F.lit(tiles)).cast("int"))
    in_block = dict(rows.groupBy("block").count().collect())  # at most MOST rows
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication([in_block.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = spark.createDataFrame([(b, np.cumsum(row).tolist()) for b, row in enumerate(matrix)], "block int, ends array<long>")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(key(3), "row")))
    dealt = ranked.join(F.broadcast(ends), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    dealt = shared.stash(dealt.select("doc_id", "size", "text_crc32", "row", "shard", "tile"), "dealt")
    offsets, before = [], {}
    for shard, tile, n in sorted(map(tuple, dealt.groupBy("shard", "tile").count().collect())):  # at most shards * MOST rows
        offsets.append((shard, tile, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    offsets = spark.createDataFrame(offsets, "shard int, tile int, before long")
    slots = dealt.withColumn("place", F.row_number().over(Window.partitionBy("shard", "tile").orderBy(key(4), "row")))
    slots = slots.join(F.broadcast(offsets), ["shard", "tile"])
    shared.discard(rows)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
