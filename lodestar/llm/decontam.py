"""Benchmark decontamination with DataFrame and SQL functions only.

Texts and benchmark items are sequences of words: runs of letters and digits in lower case. A window that resembles an
item holds many of its k-word shingles, in whatever order, so all item-sized windows are looked at that hold as many shingles
shared with items of that length as the similarity needs; running counts find where they begin. Such
a window has a SimHash of its weighted shingles; all items whose fingerprints lie within a Hamming radius are found by equal
blocks of bits, each item being indexed under every value near its own block: of r differing bits at least one of b blocks
has r // b or fewer. Candidates are verified by the exact weighted Jaccard similarity of their shingles, the weight of a
shingle being its number of occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bits by which fingerprints may differ, for a similarity of 0.8; blocks of a fingerprint and their bits.
RADIUS, BLOCKS, BLOCK_BITS = 23, 8, 8
#: A bit is set where most occurrences of shingles have it set.
SIMHASH = "aggregate(transform(sequence(0, 63), b -> IF(2 * aggregate(shingles, 0, (n, h) -> n + CAST(shiftright(h, b) & 1 AS INT)) > size(shingles), shiftleft(1L, b), 0L)), 0L, (f, x) -> f | x)"
#: The values that differ from a block in so few bits that some block of any fingerprint within the radius is met.
NEAR = f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), x -> bit_count(x) <= {RADIUS // BLOCKS})"
#: Occurrences in common: for each different shingle of the item the lesser of its counts.
COMMON = "aggregate(array_distinct(item), 0, (n, x) -> n + least(size(filter(item, y -> y = x)), size(filter(shingles, y -> y = x))))"
#: Begins of the windows whose first shared shingle is the j-th one at, if it and those behind it are enough within the width.
RUNS = "filter(transform(filter(sequence(0, size(at) - 1), j -> get(at, j + need - 1) - at[j] < width), j -> struct(greatest(0, coalesce(get(at, j - 1) + 1, 0), at[j + need - 1] - width + 1) AS lo, least(at[j], size - width) AS hi)), r -> r.lo <= r.hi)"
#: The same with runs that follow each other as one.
HEADS = "filter(runs, (r, i) -> i = 0 OR get(runs, i - 1).hi + 1 < r.lo).lo"
TAILS = "filter(runs, (r, i) -> i = size(runs) - 1 OR get(runs, i + 1).lo > r.hi + 1).hi"
SPANS = "transform(heads, (lo, i) -> struct(size, n, lo, tails[i] AS hi))"


def with_shingles(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """(id, hashes, kept columns): the hashes of all k-word shingles of a text in order; none for one of fewer words."""
    # The word hashes are bound to a lambda's variable, or each shingle would split the text again; and words are taken by
    # their place, for slice() copies the whole array each time.
    words = r"transform(array_remove(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), ''), w -> xxhash64(w))"
    parts = ", ".join(f"ws[i + {j}]" for j in range(k))
    shingles = f"transform(sequence(0, size(ws) - {k}), i -> xxhash64({parts}))"
    bound = f"transform(array({words}), ws -> IF(size(ws) < {k}, CAST(array() AS ARRAY<BIGINT>), {shingles}))[0]"
    return df.select("id", F.expr(bound).alias("hashes"), *keep)


def _block_keys(fingerprint: str) -> str:
    """A number for each block of a fingerprint: which block it is, and its bits."""
    return f"transform(sequence(0, {BLOCKS - 1}), b -> b * {1 << BLOCK_BITS} + CAST(shiftrightunsigned({fingerprint}, b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} AS INT))"


def _leaks(texts: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """Leaks of the items of one part of the benchmark."""
    seeds = items.select(F.size("hashes").alias("n"), F.explode("hashes").alias("hash")).distinct()
    # the size is a column before the array is unfolded, or each of its rows would carry the whole array
    shingled = with_shingles(texts.where("id is not null"), k).withColumn("size", F.size("hashes")).select("id", "size", F.posexplode("hashes").alias("pos", "hash"))
    met = shingled.join(F.broadcast(seeds), "hash")  # PART_SHINGLES at most
    met = met.groupBy("id", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("at")).withColumn("width", F.least("n", "size"))
    met = met.withColumn("need", F.expr(f"CAST(greatest(1, ({percent} * (n + width) + {99 + percent}) div {100 + percent}) AS INT)")).where("size(at) >= need")
    runs = met.withColumn("runs", F.expr(RUNS)).where("size(runs) > 0")
    spans = runs.withColumn("heads", F.expr(HEADS)).withColumn("tails", F.expr(TAILS)).withColumn("spans", F.expr(SPANS))
    places = shared.stash(spans.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("places")), "places")
    again = with_shingles(texts.join(shared.small(places), "id"), k, "places")
    own = F.filter("places", lambda p: p["size"] == F.size("hashes"))  # rows that repeat an id can differ
    starts = F.flatten(F.transform(own, lambda p: F.transform(F.sequence(p["lo"], p["hi"]), lambda s: F.struct(p["n"].alias("n"), s.alias("start")))))
    cut = F.explode(F.transform(starts, lambda p: F.struct(p["n"].alias("n"), p["start"].alias("start"), F.slice("hashes", p["start"] + 1, p["n"]).alias("shingles"))))
    windows = again.select("id", cut.alias("w")).select("id", "w.*").withColumn("print", F.expr(SIMHASH))
    windows = shared.stash(windows, "windows")
    prints = items.select("id", F.col("hashes").alias("shingles")).withColumn("print", F.expr(SIMHASH)).select(F.col("id").alias("item_id"), F.size("shingles").alias("n"), F.col("print").alias("item_print"), F.col("shingles").alias("item"))
    blocks = prints.select("item_id", "n", "item_print", F.explode(F.expr(_block_keys("item_print"))).alias("own"))
    index = blocks.select("item_id", "n", "item_print", F.explode(F.expr(f"transform({NEAR}, x -> own ^ x)")).alias("block"))
    different = windows.select("n", "print").distinct().withColumn("block", F.explode(F.expr(_block_keys("print"))))
    within = different.join(index, ["n", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("n", "print", "item_id").distinct()
    within = shared.stash(within.join(shared.small(prints.select("item_id", "item")), "item_id"), "within")
    shared.discard(places)
    common = windows.join(within, ["n", "print"]).withColumn("common", F.expr(COMMON))
    share = F.col("common") / (F.size("item") + F.size("shingles") - F.col("common"))
    return common.select("id", "item_id", "start", share.alias("similarity"), "common", (F.size("item") + F.size("shingles")).alias("both")).where(f"100 * common >= {percent} * (both - common)")


#: Shingles of the benchmark that are searched for in one pass over the texts.
PART_SHINGLES = 1_000_000


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, windows): documents with a window like a benchmark item.

    A row for each document and item with a window of similarity >= percent / 100: the best one, where its first shingle
    begins, and how many windows reach that. Windows are as long as the item, or the whole text if that is shorter, and begin
    at any shingle. Null texts, and texts and items of fewer
    than k words, match nothing, nor do rows without an id. Rows that repeat an id count as one document. Other columns are not read. An empty
    table on either side gives an empty result.
    """
    items = shared.stash(with_shingles(benchmark.select(F.col("item_id").cast("long").alias("id"), "text"), k).where("id is not null"), "items")
    shingles = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    texts, parts, found = docs.select(F.col("doc_id").cast("long").alias("id"), "text"), max(1, -(-shingles // part_shingles)), None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        more = _leaks(texts, own, k, percent)
        found = more if found is None else found.union(more)
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start")))
    out = found.groupBy("id", "item_id").agg(best.alias("best"), F.countDistinct("start").alias("windows"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "best.similarity", F.col("best.start").alias("start_word"), "windows")


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without a leak, with their columns.

    Rows without an id stay, and so do null and empty texts unless another row of their id leaks: all rows that repeat an
    id go or none. An empty table on either side leaves docs as it is.
    """
    leaked = shared.stash(leaks(docs, benchmark, k, percent).select("doc_id").distinct(), "leaked")
    return docs.join(shared.small(leaked), "doc_id", "left_anti")
