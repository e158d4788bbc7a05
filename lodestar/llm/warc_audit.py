"""Merkle fixity audit of WARC replicas.

A leaf is the SHA-256 of one record's bytes at its recorded offset. A node hashes the digests of the next FAN ordered
offset ranges, up to one root for each file. Replicas compare roots and go down only below nodes that differ, so an intact
file costs one comparison, and each corrupt range is found by a handful of comparisons a level.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Children of a node, and records of a file: no group that one task holds is larger.
FAN, FILE_RECORDS = 16, 1000
#: Stored bytes that a task reads, about.
READ_BYTES = 16 << 20
_INDEX = "page_id long, file string, record int, offset long, length long, sha256 string, place long, stored long, path string"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, file, record, bytes): a WARC resource record for each page, in files by ranges of page_id.

    A null url or html is empty. Pages without an id, and those beyond four files' worth in one range (repeated ids), are
    dealt by a hash to files of their own. Of equal rows each has its record, whose WARC-Record-ID names file and record
    where the page's id is null or not known to be its alone. Other columns are not read. The rows of a file follow each
    other in their order.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("page_id") / file_records), F.lit(-1)))
    many = rows.groupBy("range").count().where(f"count > {4 * file_records}").select("range", F.ceil(F.col("count") / file_records).alias("files"))
    rows = rows.join(shared.small(many), "range", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "row"), F.coalesce("files", F.lit(1))))
    order = Window.partitionBy("range", "part").orderBy("page_id", "url", "row")
    rows = rows.withColumns({"record": F.row_number().over(order) - 1, "before": F.lag("page_id").over(order), "next": F.lead("page_id").over(order)})
    name = F.concat_ws("-", F.lit("warc"), F.col("range").cast("string"), F.col("part").cast("string"))
    alone = F.col("page_id").isNotNull() & F.col("files").isNull() & ~F.col("page_id").eqNullSafe(F.col("before")) & ~F.col("page_id").eqNullSafe(F.col("next"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    record_id = F.when(alone, page).otherwise(F.concat_ws(":", page, name, F.col("record").cast("string")))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:"), record_id, F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    return rows.select("page_id", name.alias("file"), "record", F.concat(head, "html", F.lit("\r\n\r\n")).cast("binary").alias("bytes"))


def write_warc(found: DataFrame, *folders: str, damage: Column | None = None) -> DataFrame:
    """Write each file of records to all folders in one pass; returns the index of their offset ranges and digests, already computed.

    Records are compressed one by one, as WARC files are; offset and length tell a record's place in the file as it is when
    unpacked, place and stored the bytes that hold it. Rows are written as they come, so no task holds a file. A task
    that runs again writes files of its own name, and the index names those of the attempt that counted. For tests
    of an audit the last folder's copies are hurt where damage is "altered" (a byte is changed) or "missing" (left out).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, attempt, file, sinks = [fs.FileSystem.from_uri(f) for f in folders], uuid.uuid4().hex[:12], None, []
        try:
            for b in batches:
                rows = []
                for name, raw, harm in zip(b.column(1).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                    if name != file:
                        for s in sinks:
                            s.close()
                        file, path, offset, place = name, f"{name}.{attempt}.warc.gz", 0, 0
                        for store, root in stores:
                            store.create_dir(root, recursive=True)
                        sinks = [store.open_output_stream(f"{root}/{path}", compression=None) for store, root in stores]
                    raw = raw.as_py()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    stored = packer.compress(raw) + packer.flush()
                    for s in sinks[:-1] if harm else sinks:
                        s.write(stored)
                    if harm == "altered":
                        sinks[-1].write(stored[:-9] + bytes([stored[-9] ^ 1]) + stored[-8:])
                    rows.append((offset, len(raw), hashlib.sha256(raw).hexdigest(), place, len(stored), path))
                    offset, place = offset + len(raw), place + len(stored)
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.record_batch([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], _INDEX_NAMES)
        finally:
            for s in sinks:
                s.close()

    rows = found.select("page_id", "file", "record", "bytes", (damage if damage is not None else F.lit(None).cast("string")).alias("damage"))
    return shared.stash(rows.mapInArrow(write, _INDEX), "index")


def _digest(stored: bytes) -> str:
    """Of the record that the bytes hold, or of the bytes themselves where they hold none."""
    unpacker = zlib.decompressobj(31)
    try:
        raw = unpacker.decompress(stored)
    except zlib.error:
        raw = stored
    return hashlib.sha256(raw if unpacker.eof else stored).hexdigest()


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """(file, record, digest): what a replica holds in the index's offset ranges; null where its bytes end before."""

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/{pdf['path'].iloc[0]}"
        out = pdf[["file", "record"]].assign(digest=None)
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_file(path) as source:
                size = source.size()
                out["digest"] = [_digest(source.read_at(n, at)) if at + n <= size else None for at, n in zip(pdf["place"], pdf["stored"], strict=True)]
        return out

    # an index is small beside the bytes it tells of, so these decide how many tasks read them
    parts = -(-(index.agg(F.sum("stored")).first()[0] or 1) // READ_BYTES)
    return index.select("file", "record", "path", "place", "stored").repartition(parts, "file").groupBy("file").applyInPandas(read, "file string, record int, digest string")


def tree(leaf: DataFrame, file_records: int = 4 * FILE_RECORDS) -> DataFrame:
    """(level, file, node, digest), already computed: leaves at level 0, up to one node for each file."""
    level = shared.stash(leaf.select(F.lit(0).alias("level"), "file", F.col("record").alias("node"), "digest"), "level")
    levels, spread = [level], 1
    while spread < 2 * file_records:
        spread *= FAN
        child = F.struct("node", F.coalesce("digest", F.lit("missing")).alias("digest"))
        above = level.groupBy("file", F.floor(F.col("node") / FAN).cast("int").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        digest = F.sha2(F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"]))), 256)
        level = shared.stash(above.select(F.lit(len(levels)).alias("level"), "file", F.col("up").alias("node"), digest.alias("digest")), "level")
        levels.append(level)
    return reduce(DataFrame.union, levels)


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, record, digest, other), already computed: leaves that differ, found from the roots of two trees downwards."""
    top, below = one.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], None
    for level in range(top, -1, -1):
        a = one.where(F.col("level") == level).select("file", "node", "digest")
        b = two.where(F.col("level") == level).select("file", "node", F.col("digest").alias("other"))
        if below is not None:
            up = [F.col("file"), F.floor(F.col("node") / FAN).cast("int").alias("up")]
            a, b = (x.select(*up, *x.columns[1:]).join(below, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        differ = shared.stash(a.join(b, ["file", "node"], "full").where("not (digest <=> other)"), "differ")
        if below is not None:
            shared.discard(below)
        below = differ.select("file", F.col("node").alias("up"))
    return differ.withColumnRenamed("node", "record")


def audit(index: DataFrame, folder: str, replica: str) -> DataFrame:
    """(page_id, file, record, offset, length, sha256, state) for each record that was written to folder.

    The trees are built over the bytes that the folder and its replica hold now. state is intact, altered (bytes differ, or
    were moved), missing (the replica ends before), or decayed (the folder itself no longer has the indexed bytes). A file
    that the replica lacks is missing throughout; no files give an empty result.
    """
    trees = [tree(leaves(index, f)) for f in (folder, replica)]
    differ = differences(*trees)
    shared.discard(*trees)
    state = F.when(F.col("at").isNull() | F.col("digest").eqNullSafe(F.col("other")), "intact").when(~F.col("digest").eqNullSafe(F.col("sha256")), "decayed").when(F.col("other").isNull(), "missing").otherwise("altered")
    return index.join(differ.withColumn("at", F.lit(True)), ["file", "record"], "left").select("page_id", "file", "record", "offset", "length", "sha256", state.alias("state"))
