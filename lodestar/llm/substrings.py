"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

A window of `window` words stands at each length L for the least hash of the L-word windows inside it, so equal windows
stand for equal values wherever they are, and a text has few different values. A window lives on only if another document
has its value at L; those are tested at twice the length, and at last at their whole length, where the value is the
window's own hash with a cryptographic digest of its words. Words of living windows that also start in a document with a
smaller id go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import U, Windows, slices, words

#: The first length that is tested; each next one is twice as long, and the last is the whole window.
FIRST_LENGTH = 13


def lengths(window: int, first: int = FIRST_LENGTH) -> list[int]:
    found = [min(first, window)]
    while found[-1] < window:
        found.append(min(2 * found[-1], window))
    return found


def least_inside(windows: Windows, length: int, window: int) -> np.ndarray:
    """For each window the least hash of the windows of a length inside it."""
    least, span, wanted = windows(length), 1, window - length + 1
    while 2 * span <= wanted:
        least = np.minimum(least[: max(0, len(least) - span)], least[span:])
        span *= 2
    rest = wanted - span
    return np.minimum(least[: max(0, len(least) - rest)], least[rest:]) if rest else least


def _values(least: np.ndarray, begin: int, end: int, window: int, alive: np.ndarray | None = None) -> np.ndarray:
    """The different values of a text's (living) windows."""
    own = least[begin : max(begin, end - window + 1)]
    return np.unique(own if alive is None else own[alive])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, U)]).view(np.int64)))


def _digests(text: bytes, starts: np.ndarray, window: int) -> np.ndarray:
    """A cryptographic digest of the words of each of the windows of a text that begin at the given words."""
    if not len(starts):
        return np.zeros(0, U)
    kept = text.split()
    joined = b" ".join(kept)
    begin = np.cumsum([0, *(len(w) + 1 for w in kept)])
    found = [hashlib.blake2b(joined[b:e], digest_size=8).digest() for b, e in zip(begin[starts].tolist(), (begin[starts + window] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), U)


def _bits(packed: pa.Scalar, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed.as_buffer(), np.uint8), count=max(0, n)).astype(bool)


def _digest(text: bytes, gone: np.ndarray | None = None) -> str:
    kept = text.split()
    if gone is not None:
        kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _kept_text(text: bytes, gone: np.ndarray) -> str:
    return b" ".join(w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g).decode()


def _hits(values: DataFrame, last: bool) -> DataFrame:
    """(doc, value, more), already computed: each document's values that another document has too, or at last that a smaller one has.

    Both sides of the join come from files, so adaptive execution can split a value that many documents have.
    """
    key = [c for c in values.columns if c != "doc"]
    seen = shared.stash(values.groupBy(*key).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "seen")
    met = values.join(seen, key)
    met = (met.where("doc > least") if last else met).groupBy("doc")
    hits = shared.stash(met.agg(*(F.collect_list(c).alias(c) for c in key)), "hits")  # as many as the document has windows
    shared.discard(seen, values)
    return hits


def repeated_words(docs: DataFrame, window: int = 50, first: int = FIRST_LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of docs.

    A null or empty text has no words. A text shorter than the window loses none. Rows that repeat an id are texts of one
    document: a window of any of them counts as the document's, and each row loses its own words. Of rows with equal words
    and different ids, all but those with the smallest id lose every window. Rows without an id are compared with nothing.
    Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    levels = lengths(window, first)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, values = [], [], []
            for lo, hi, raw, at in slices(b.column(1)):
                hashes, _, _, begin = words(raw, at, lower=False)
                least, text = least_inside(Windows(hashes), levels[0], window), raw.tobytes()
                for d in range(hi - lo):
                    i, j = int(begin[d]), int(begin[d + 1])
                    n.append(j - i)
                    sha.append(_digest(text[at[d] : at[d + 1]]))
                    values.append(_values(least, i, j, window))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _lists(values)], ["doc", "n", "sha", "values"])

    surveyed = shared.stash(docs.mapInArrow(survey, "doc long, n long, sha string, values array<long>"), "surveyed")
    equal = surveyed.where("doc is not null").groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("most")).where("first < most")
    equal = shared.stash(equal.drop("most"), "equal")
    known = surveyed.join(shared.small(equal), "sha", "left").select("doc", "n", "sha", "values", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy"))
    values = shared.stash(known.where("not copy and doc is not null").select("doc", F.explode("values").alias("value")).distinct(), "values")
    known = shared.stash(known.drop("values"), "known")
    shared.discard(surveyed, equal)
    # only texts in which a window lives on are read again
    hits, tested = _hits(values, last=False), None
    living = docs.join(shared.small(hits.select("doc")), "doc", "left_semi").join(hits, "doc").select("doc", "text", F.lit(None).cast("binary").alias("alive"), "value")

    def narrow(length: int, extended: int):
        """Which windows live on after a length; with what values they are tested at the next one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                alive_out, values, more = [], [], []
                for lo, hi, raw, at in slices(b.column(1)):
                    hashes, _, _, begin = words(raw, at, lower=False)
                    windows, text = Windows(hashes), raw.tobytes()
                    least, longer = least_inside(windows, length, window), least_inside(windows, extended, window)
                    for d in range(hi - lo):
                        i, j = int(begin[d]), int(begin[d + 1])
                        alive = np.isin(least[i : max(i, j - window + 1)], b.column(3)[lo + d].values.to_numpy().view(U))
                        if b.column(2)[lo + d].is_valid:
                            alive &= _bits(b.column(2)[lo + d], len(alive))
                        alive_out.append(np.packbits(alive).tobytes())
                        if extended < window:
                            values.append(_values(longer, i, j, window, alive))
                        else:  # a window's own hash, and a digest of its words
                            starts = np.flatnonzero(alive)
                            values.append(longer[i + starts])
                            more.append(_digests(text[at[d] : at[d + 1]], starts, window))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(alive_out, pa.binary()), _lists(values), _lists(more) if more else pa.nulls(len(b), pa.list_(pa.int64()))], ["doc", "text", "alive", "values", "more"])

        return run

    for length, extended in zip(levels, levels[1:] or [window], strict=False):
        last = extended == window
        before, tested = tested, shared.stash(living.mapInArrow(narrow(length, extended), "doc long, text string, alive binary, values array<long>, more array<long>"), "tested")
        shared.discard(hits, *([before] if before else []))
        if last:
            values = tested.select("doc", F.explode(F.arrays_zip("values", "more")).alias("v")).select("doc", F.col("v.values").alias("value"), F.col("v.more").alias("more"))
        else:
            values = tested.select("doc", F.explode("values").alias("value"))
        hits = _hits(shared.stash(values.distinct(), "values"), last)
        living = tested.select("doc", "text", "alive").join(hits, "doc").select("doc", "text", "alive", *hits.columns[1:])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, n_gone, sha, kept = [], [], [], []
            for lo, hi, raw, at in slices(b.column(1)):
                hashes, _, _, begin = words(raw, at, lower=False)
                whole, text = Windows(hashes)(window), raw.tobytes()
                for d in range(hi - lo):
                    i, j = int(begin[d]), int(begin[d + 1])
                    own, n = text[at[d] : at[d + 1]], j - i
                    value, more = (b.column(c)[lo + d].values.to_numpy().view(U) for c in (3, 4))
                    starts = np.flatnonzero(_bits(b.column(2)[lo + d], n - window + 1))
                    starts = starts[np.isin(whole[i + starts], value)]
                    wanted = set(zip(value.tolist(), more.tolist(), strict=True))
                    same = [pair in wanted for pair in zip(whole[i + starts].tolist(), _digests(own, starts, window).tolist(), strict=True)]
                    starts = starts[np.array(same, bool)]
                    cover = np.zeros(n + 1, np.int64)
                    cover[starts] += 1
                    cover[starts + window] -= 1
                    gone = np.cumsum(cover[:n]) > 0
                    old.append(_digest(own))
                    n_gone.append(int(gone.sum()))
                    sha.append(_digest(own, gone))
                    kept.append(_kept_text(own, gone) if with_text else None)
            yield pa.record_batch([b.column(0), pa.array(old, pa.string()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc", "sha", "n_removed", "new_sha", "new_text"])

    changed = shared.stash(living.mapInArrow(remove, "doc long, sha string, n_removed long, new_sha string, new_text string").dropDuplicates(["doc", "sha"]), "changed")
    shared.discard(hits, tested)
    emptied = F.col("copy") & (F.col("n") >= window)
    out = known.join(changed, ["doc", "sha"], "left")
    columns = [F.col("doc").alias("doc_id"), F.col("n").alias("n_words"), F.when(emptied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(emptied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256")]
    if not with_text:
        return out.select(*columns)
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "), "^ | $", "")
    texts = docs.select("doc", squeezed.alias("whole")).withColumn("sha", F.sha2(F.col("whole").cast("binary"), 256)).dropDuplicates(["doc", "sha"])
    return out.join(texts, (out["doc"].eqNullSafe(texts["doc"])) & (out["sha"] == texts["sha"]), "left").select(out["doc"].alias("doc_id"), *columns[1:3], F.when(emptied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("new_sha", out["sha"])).alias("kept_sha256"), F.when(emptied, F.lit("")).otherwise(F.coalesce("new_text", "whole")).alias("kept_text"))
