"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into windows of the longest context and a rest; the rest is routed to the smallest context tier
that holds it. Tiers are packed from the longest down: each rest opens a window of its tier, and the gap behind it is filled
with rests of shorter tiers, the last of which is cut to fit. Every task packs blocks of its own rows, so nothing is
shuffled; a block leaves less than one short window of padding. Windows of a tier form step groups of STEP_IDS ids, which
are carried from block to block: a task leaves one group of each tier short at most.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode

TIERS = (256, 512, 1024, 2048)
#: A task packs so many ids, or documents, at once; ids of a step group.
BLOCK_IDS, BLOCK_DOCS, STEP_IDS = 1_000_000, 8192, 16_384
Piece = tuple[int, int, int]  # document in the block, first id, ids


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """(tier, pieces) of each window; a window is full, but for the last one."""
    longest, full = tiers[-1], []
    stock: list[tuple[int, int, int]] = []  # rests by size: (ids, document, first id)
    for d, n in enumerate(sizes):
        full += [(longest, [(d, s, longest)]) for s in range(0, n - longest + 1, longest)]
        if n % longest:
            stock.append((n % longest, d, n - n % longest))
    stock.sort()
    while stock:
        n, d, start = stock.pop()
        tier = next(t for t in tiers if t >= n)
        pieces, gap = [(d, start, n)], tier - n
        while gap and stock:
            at = bisect_right(stock, (gap, len(sizes), 0))
            n, d, start = stock.pop(at - 1 if at else 0)  # the longest rest that fits, or the shortest to cut
            take = min(n, gap)
            pieces.append((d, start, take))
            gap -= take
            if take < n:
                insort(stock, (n - take, d, start + take))
        if not gap:
            full.append((tier, pieces))
            continue
        full += _last(pieces, tiers)
    return sorted(full, key=lambda w: -w[0])


def _last(pieces: list[Piece], tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """Windows of the last ids of a block: full ones of ever shorter tiers, then one that is padded."""
    left, out = sum(p[2] for p in pieces), []
    for tier in reversed(tiers):
        while left >= tier or left and tier == tiers[0]:
            window, room = [], tier
            while room and pieces:
                d, start, n = pieces.pop(0)
                take = min(n, room)
                window.append((d, start, take))
                room -= take
                if take < n:
                    pieces.insert(0, (d, start + take, n - take))
            left -= tier - room
            out.append((tier, window))
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int, spaces: bool = True, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids].

    A null or empty text is a document of the end id alone. Rows that repeat an id, or have none, are packed as documents
    of their own. Window numbers hold the task's number in their upper bits and are not gapless. Other columns are not
    read. An empty table gives an empty result.
    """
    end = encode.as_bytes([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, base, made = encode.encoder(tokenizer, spaces), TaskContext.get().partitionId() << 32, [0, 0]
        open_groups: dict[int, tuple[int, int]] = {}  # by tier: the group that is being filled, and its room

        def flush(names: list, held: list[bytes]) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(10 if with_ids else 9)]
            for tier, pieces in pack([len(x) // 4 for x in held], tiers):
                group, room = open_groups.get(tier, (0, 0))
                if room < tier:
                    made[1] += 1
                    group, room = made[1], STEP_IDS
                open_groups[tier] = group, room - tier
                offset = 0
                for d, start, n in pieces:
                    ids = memoryview(held[d])[4 * start : 4 * (start + n)]
                    values = (names[d], start, n, zlib.crc32(ids), len(held[d]) // 4, base + made[0], offset, tier, base + group) + ((bytes(ids),) if with_ids else ())
                    for column, x in zip(rows, values, strict=True):
                        column.append(x)
                    offset += n
                made[0] += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], columns)

        names, held, size = [], [], 0
        for batch in batches:
            for b in encode.slices(batch):
                names += b.column(0).to_pylist()
                new = [ids + end for ids in to_ids(b.column(1))]
                held += new
                size += sum(map(len, new)) // 4
                if size >= BLOCK_IDS or len(held) >= BLOCK_DOCS:
                    yield flush(names, held)
                    names, held, size = [], [], 0
        if held:
            yield flush(names, held)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)
