"""N-gram Jaccard join by prefixes of token combinations.

A document is its set of k-word shingles. Sets that share at least `percent` of their union differ in few tokens, so they
meet in a short prefix under any common order of tokens. Here rare tokens come first and stand for themselves; frequent
tokens follow and are indexed only as pairs within a subclass, and very frequent ones, which come last, as triples; the
prefix is extended by one token for each subclass of pairs and by two for each of triples. Candidates are verified on whole
sets.

Why nothing is lost: let t be the most tokens of x that a partner may lack. x's prefix holds rare tokens, and x_c tokens
of each subclass c whose combinations have k_c tokens, with rare + sum(max(0, x_c - k_c + 1)) > t. If a partner y had none
of x's rare prefix tokens and fewer than k_c of each subclass, it would lack more than t. The prefix that ends earlier in
the common order lies, as far as both sets hold it, in the other prefix too, so both index the shared combination.

Only components are asked for, so no group of copies is expanded: equal sets are one representative; of the documents that
share a signature each is verified against the smallest one, its leader; those that miss the threshold there (fringe) are
compared with the others of that leader, unless the links to leaders already connect them. Sets that can link differ little
in size, so a leader's documents are dealt to bands of sizes, each of which meets itself and the next one only, and a large
band to blocks. Two documents that share a signature are then either in one component by links to leaders or have been
compared.

Whole sets travel only where a sketch allows a link. A sketch counts a set's tokens by their low bits; two sets share at
most the sum of the lesser counts, so no link is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import U, mix, shingle_sets

#: A token is frequent (very frequent) from so many sightings on, or from total / MAX_FREQUENT, so that the list is bounded.
FREQUENT, VERY_FREQUENT, MAX_FREQUENT = 32, 1024, 2_000_000
#: Prefix tokens of a subclass of pairs and of triples, about: more make more signatures, fewer a longer prefix.
SUBCLASS = {2: 16, 3: 4}
#: Tokens counted together before a task reports those seen twice; tokens of whole sets that a task holds before it sends them.
COUNTED_TOGETHER, SENT_TOGETHER = 1_000_000, 500_000
#: Documents of a block, of which two meet at a time; tokens of one product; counts of sketches that are compared at once.
BLOCK, PRODUCT_TOKENS, COMPARED = 64, 16_384, 1 << 22


def least_size(n: int, percent: int) -> int:
    """The fewest tokens that two sets share if one has n."""
    return -(-n * percent // 100)


def subclasses(level: int, percent: int, width: int) -> int:
    """Into how many subclasses sets of 2**level to 2**(level+1) tokens deal tokens that are indexed by combinations."""
    return max(1, (2**level * (100 - percent) // 100) // SUBCLASS[width])


def levels(n: int, percent: int) -> list[int]:
    """The level of a set of n tokens, and the next one if a partner may lie there: a pair meets at its higher level."""
    own = n.bit_length() - 1
    return [own, own + 1] if n * 100 >= percent * 2 ** (own + 1) else [own]


def _member(tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(tokens), bool)
    return of[np.minimum(np.searchsorted(of, tokens), len(of) - 1)] == tokens


@lru_cache(maxsize=512)
def _places(n: int, width: int) -> np.ndarray:
    """All choices of so many of n places, a column for each."""
    return np.array(list(combinations(range(n), width)), np.int64).reshape(-1, width).T


def signatures(tokens: np.ndarray, percent: int, frequent: np.ndarray, very: np.ndarray) -> np.ndarray:
    """All index keys of a set of sorted tokens; the frequent and very frequent ones are sorted too."""
    n = len(tokens)
    if not n:
        return tokens
    spare = n - least_size(n, percent)
    kind = _member(tokens, frequent).astype(np.int8)
    rare = tokens[kind == 0][: spare + 1]
    if len(rare) > spare:
        return rare
    kind += _member(tokens, very)
    keys = [rare]
    for level in levels(n, percent):
        need = spare + 1 - len(rare)
        for width in (2, 3):
            own = tokens[kind == width - 1]
            if need <= 0 or not len(own):
                continue
            part = (own % U(subclasses(level, percent, width))).astype(np.int64)
            order = np.argsort(part, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
            counts = np.cumsum(place >= width - 1)  # the first tokens of a subclass don't count towards the prefix
            end = min(len(own), int(np.searchsorted(counts, need)) + 1)
            need -= int(counts[end - 1])
            own, part = own[:end], part[:end]
            for c in np.unique(part):
                chosen = own[part == c]
                if len(chosen) >= width:
                    first, *others = chosen[_places(len(chosen), width)]
                    key = mix(first + U(level))
                    for other in others:
                        key = mix(key + other * U(3))
                    keys.append(key)
    return np.concatenate(keys)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _frequent_tokens(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent and very frequent tokens, sorted. Tasks report tokens that they see twice; any outcome keeps the join exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(held: list[np.ndarray], total: int) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([*held, np.zeros(0, U)]), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            return pa.record_batch([_as_long(np.append(token, U(0))), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(n), np.int64), total))], ["token", "n", "total"])

        held, size = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= COUNTED_TOGETHER:
                    yield report(held, size)
                    held, size = [], 0
        yield report(held, size)

    seen = shared.stash(docs.select(text_col).mapInArrow(count, "token long, n long, total long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where(f"n >= {FREQUENT} or total > 0"), "frequent")
    total = seen.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    least = max(FREQUENT, -(-total // MAX_FREQUENT))  # at most MAX_FREQUENT tokens have so many sightings
    found = seen.where(f"n >= {least}").select("token", (F.col("n") >= max(VERY_FREQUENT, least)).alias("very")).toArrow()
    shared.discard(seen)
    token, very = found.column(0).to_numpy().astype(np.int64).view(U), found.column(1).to_numpy().astype(bool)
    return np.sort(token), np.sort(token[very])


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens have each value of the low bits; four to eight of a large set have the same. 255 is 255 or more."""
    buckets = max(64, 1 << max(0, len(tokens).bit_length() - 3))
    return np.minimum(np.bincount((tokens & U(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _folded(x: np.ndarray, buckets: int) -> np.ndarray:
    """The same counts by fewer bits."""
    return x.reshape(-1, buckets).sum(axis=0, dtype=np.uint16)


def may_link(n: np.ndarray, left: np.ndarray, m: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens can be linked, row by row, from their counts by equally many bits."""
    most = np.minimum(left, right).sum(axis=1, dtype=np.int64)
    return (100 * most >= percent * (n + m - most)) | (left.max(axis=1) >= 255) | (right.max(axis=1) >= 255)


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """(doc, leader) of the pairs (doc, leader, n, leader_n, left, right) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                buckets = min(len(x), len(y))
                keep.append(bool(may_link(n, _folded(x, buckets)[None, :], m, _folded(y, buckets)[None, :], percent)[0]))
            yield b.select(["doc", "leader"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "doc long, leader long")


def _by_group(df: DataFrame, keys: list[str], f, schema: str) -> DataFrame:
    """f over the record batch of each group of rows with equal keys, which come first in df; a group fits in memory.

    Groups are met in a sorted stream, many of them in one Arrow batch, so small ones cost little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out, rows = [], None, [], 0

        def whole() -> pa.RecordBatch:
            return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(len(keys))]
            changed = np.zeros(max(0, len(b) - 1), bool)
            for c in columns:
                changed |= c[1:] != c[:-1]
            begins = [0, *(np.flatnonzero(changed) + 1).tolist(), len(b)]
            for lo, hi in zip(begins, begins[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(c[lo] for c in columns)
                if key != last and held:
                    out.append(f(whole()))
                    rows += len(out[-1])
                    held = []
                    if rows >= 10_000:
                        yield from out
                        out, rows = [], 0
                last = key
                held.append(b.slice(lo, hi - lo))
        if held:
            out.append(f(whole()))
        yield from (x for x in out if len(x))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _binary(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _pairs_within(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All places a < b of ascending sizes that can be linked by their sizes."""
    ends = np.searchsorted(size, size * 100 // percent, "right")  # as large as a partner can be
    times = np.maximum(0, ends - np.arange(len(size)) - 1)
    a = np.repeat(np.arange(len(size)), times)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)


#: A document as a member of a block pair: which of the two blocks it is of, whether it comes from the band below, whether it missed its leader, its component so far.
_MEMBER = ["leader", "band", "i", "j", "own", "doc", "n", "guest", "fringe", "part"]
_MEMBER_SCHEMA = "leader long, band int, i int, j int, own int, doc long, n long, guest boolean, fringe boolean, part long"


def _possible_of_block(percent: int):
    def possible(b: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a block pair that can be linked to some other row of it, as far as the two are to be compared."""
        size = b.column(6).to_numpy()
        order = np.argsort(size, kind="stable")
        size = size[order]
        own, guest, fringe, part = (b.column(c).to_numpy(zero_copy_only=False)[order] for c in (4, 7, 8, 9))
        x, y = _pairs_within(size, percent)
        wanted = (part[x] != part[y]) & (fringe[x] | fringe[y]) & ~(guest[x] & guest[y])
        if b.column(2)[0] != b.column(3)[0]:
            wanted &= own[x] != own[y]
        x, y = x[wanted], y[wanted]
        if not len(x):
            return b.slice(0, 0).select(_MEMBER)
        counts = _binary(b.column(10), np.uint8)
        buckets = min(map(len, counts))
        counts = np.array([_folded(counts[i], buckets) for i in order])
        found, step = np.zeros(len(size), bool), max(1, COMPARED // buckets)
        for lo in range(0, len(x), step):
            p, q = x[lo : lo + step], y[lo : lo + step]
            hit = may_link(size[p], counts[p], size[q], counts[q], percent)
            found[p[hit]] = found[q[hit]] = True
        return b.take(pa.array(np.sort(order[found]))).select(_MEMBER)

    return possible


def _inner(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets."""
    n = np.array([len(s) for s in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    both = times[inverse] > 1
    column, row = (np.cumsum(times > 1) - 1)[inverse][both], row[both]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inner = np.zeros((len(n), len(n)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, PRODUCT_TOKENS):
        width = min(PRODUCT_TOKENS, int(column[-1]) + 1 - lo)
        begin, end = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(n), width), np.float32)
        m[row[begin:end], column[begin:end] - lo] = 1
        inner += m @ m.T
    return inner.astype(np.int64)


def _links_of_block(percent: int):
    def links(b: pa.RecordBatch) -> pa.RecordBatch:
        """A forest over the documents of a block pair that links between its rows connect."""
        sets, doc = _binary(b.column(5), U), b.column(4).to_numpy()
        n, inner = np.array([len(s) for s in sets]), _inner(sets)
        linked = 100 * inner >= percent * (n[:, None] + n[None, :] - inner)
        root = list(range(len(n)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        forest = []
        for i, j in np.argwhere(np.triu(linked, 1)).tolist():
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
                forest.append((doc[i], doc[j]))
        forest = np.array(forest, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(forest[:, 0]), pa.array(forest[:, 1])], ["u", "v"])

    return links


def _links_to_leader(percent: int):
    def links(b: pa.RecordBatch) -> pa.RecordBatch:
        """The documents of a slice that are linked to their leader, whose sets are in it too."""
        sets, doc, leads = _binary(b.column(4), U), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
        found = []
        for lead in np.flatnonzero(leads):
            for i in np.flatnonzero(~leads):
                inner = int(_member(sets[i], sets[lead]).sum())
                if 100 * inner >= percent * (len(sets[i]) + len(sets[lead]) - inner):
                    found.append(doc[i])
        found = np.unique(np.array(found, np.int64))
        return pa.record_batch([pa.array(found), pa.array(np.full(len(found), b.column(0)[0].as_py()), pa.int64())], ["doc", "leader"])

    return links


def _whole_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(doc, tokens), already computed: the sets of the texts of the documents that are needed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sent, held = [], 0, 0
            for at, s in enumerate(shingle_sets(b.column(1), k), 1):
                found.append(s.tobytes())
                held += len(s)
                if held >= SENT_TOGETHER or at == len(b):
                    yield pa.record_batch([b.column(0).slice(sent, len(found)), pa.array(found, pa.binary())], ["doc", "tokens"])
                    found, sent, held = [], at, 0

    needed = shared.stash(needed.distinct(), "needed")
    tokens = shared.stash(docs.join(shared.small(needed), "doc", "left_semi").mapInArrow(sets, "doc long, tokens binary"), "tokens")
    shared.discard(needed)
    return tokens


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; components under links of Jaccard >= percent / 100.

    Texts without words, and null texts, have an empty set and stay alone. Rows that repeat an id are one document with
    several texts, linked by any of them, and each row is returned. Rows without an id are returned too; they take the
    component of the rows that have an equal set and an id, or none. Only id_col and text_col are read, so other columns
    may have any names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_tokens(docs, "text", k))  # MAX_FREQUENT numbers at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digests, sketches, keys, ends = [], [], [], [], [0]
            for s in shingle_sets(b.column(1), k):
                size.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(sketch(s) if len(s) else b"")
                keys.append(signatures(s, percent, *frequent.value))
                ends.append(ends[-1] + len(keys[-1]))
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _as_long(np.concatenate([*keys, np.zeros(0, U)])))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(sketches, pa.binary()), keys], ["doc", "n", "one", "two", "sketch", "keys"])

    indexed = shared.stash(docs.mapInArrow(index, "doc long, n long, one long, two long, sketch binary, keys array<long>"), "indexed")
    equal = shared.stash(indexed.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc").alias("leader")), "equal")
    reps = indexed.join(equal.where("leader is not null").select(F.col("leader").alias("doc"), "n", "one", "two"), ["doc", "n", "one", "two"])
    reps = shared.stash(reps.select("doc", "n", "sketch", "keys"), "reps")
    posted = reps.select("doc", F.explode("keys").alias("sig"))
    heads = shared.stash(posted.groupBy("sig").agg(F.min("doc").alias("leader"), F.max("doc").alias("most")).where("leader < most").drop("most"), "heads")
    pairs = posted.join(heads, "sig").where("doc <> leader").select("doc", "leader").distinct()
    sized = reps.select("doc", "n")
    pairs = shared.stash(pairs.join(sized, "doc").join(sized.toDF("leader", "leader_n"), "leader"), "pairs")
    shared.discard(heads)

    # sizes alone tell that a pair can't be linked, not how far it is: such pairs are fringe without being verified
    near = pairs.where(f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)").select("doc", "leader").distinct()
    near = near.join(reps.select("doc", "n", F.col("sketch").alias("left")), "doc").join(reps.select(F.col("doc").alias("leader"), F.col("n").alias("leader_n"), F.col("sketch").alias("right")), "leader")
    near = shared.stash(_possible(near.select("doc", "leader", "n", "leader_n", "left", "right"), percent).distinct(), "near")
    tokens = _whole_sets(docs, near.select("doc").union(near.select("leader")), k)
    slices = near.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    dealt = near.join(slices, "leader").select("leader", F.pmod(F.xxhash64("doc"), F.col("slices")).cast("int").alias("slice"), "doc", F.lit(False).alias("leads"))
    dealt = dealt.union(dealt.select("leader", "slice", F.col("leader").alias("doc"), F.lit(True)).distinct())
    dealt = dealt.join(tokens, "doc").select("leader", "slice", "doc", "leads", "tokens")
    verified = shared.stash(_by_group(dealt, ["leader", "slice"], _links_to_leader(percent), "doc long, leader long"), "verified")
    shared.discard(near, tokens)

    parts = shared.connected_components(verified.select(F.col("leader").alias("u"), F.col("doc").alias("v")))
    members = pairs.select("doc", "leader", "n").distinct().join(verified.withColumn("core", F.lit(True)), ["doc", "leader"], "left").join(parts.withColumnRenamed("node", "doc"), "doc", "left")
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.000001)).cast("int")
    at = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))))
    members = members.select("doc", "leader", "n", F.col("core").isNull().alias("fringe"), F.coalesce("component", "doc").alias("part"), at.alias("at")).select("doc", "leader", "n", "fringe", "part", "at.*")
    members = shared.stash(members, "members")
    crowds = members.groupBy("leader", "band").agg(F.count("*").alias("rows"), F.max("fringe").alias("any"), (F.min("part") != F.max("part")).alias("apart"), F.min("guest").alias("alone")).where("any and apart and not alone")
    crowds = shared.stash(crowds.select("leader", "band", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "crowds")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    crowd = members.join(crowds, ["leader", "band"]).withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowd = crowd.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    crowd = crowd.join(reps.select("doc", "n", "sketch"), ["doc", "n"]).select(*_MEMBER, "sketch")
    possible = shared.stash(_by_group(crowd, ["leader", "band", "i", "j"], _possible_of_block(percent), _MEMBER_SCHEMA), "possible")
    shared.discard(pairs, members, crowds, reps)
    tokens = _whole_sets(docs, possible.select("doc"), k)
    found = possible.select("leader", "band", "i", "j", "doc").distinct().join(tokens, "doc").select("leader", "band", "i", "j", "doc", "tokens")
    found = shared.stash(_by_group(found, ["leader", "band", "i", "j"], _links_of_block(percent), "u long, v long"), "found")
    shared.discard(possible, tokens)

    components = shared.connected_components(parts.select(F.col("component").alias("u"), F.col("node").alias("v")).union(found))
    group = equal.join(components.withColumnRenamed("node", "leader"), "leader", "left").select("n", "one", "two", F.coalesce("component", "leader").alias("component"))
    group = shared.stash(group, "groups")
    slim = shared.stash(indexed.select("doc", "n", "one", "two"), "slim")
    shared.discard(indexed, equal, verified, parts, found, components)
    return slim.join(group, ["n", "one", "two"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with their columns.

    Rows without an id stay; of rows that repeat an id all stay or none. Texts without words, and null texts, stay. An
    empty table gives an empty result.
    """
    found = jaccard_components(docs, k, percent)
    dropped = shared.stash(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    shared.discard(found)
    return docs.join(shared.small(dropped), "doc_id", "left_anti")
