"""Operators on pairs against brute force: vectors, n-gram sets, benchmark windows, repeated windows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from lodestar.llm import decontam, embed_join, ngram_join, shared, substrings

from . import brute

DOCS = "doc_id long, text string"


def _varied(rng: random.Random, n: int, words: int) -> dict[int, str | None]:
    """Random texts, copies of them with a few words changed, exact copies, and odd ones."""
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "The", "of"] * 30
    docs: dict[int, str | None] = {0: None, 1: "", 2: "one", 3: "One", 4: " \t\n "}
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, words))] for _ in range(n // 6)]
    while len(docs) < n:
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        docs[len(docs) * 3] = " ".join(text)
    return docs


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(spark, monkeypatch, k, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)  # all classes of tokens are met
    monkeypatch.setattr(ngram_join, "VERY_FREQUENT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    docs = _varied(random.Random(k), 160, 90)
    found = ngram_join.jaccard_components(spark.createDataFrame([*docs.items()], DOCS), k, percent).collect()
    wanted = brute.components(list(docs), brute.jaccard_links(docs, k, percent))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {d: (len(brute.shingle_set(t, k)), wanted[d]) for d, t in docs.items()}
    assert len(found) == len(docs)


def test_one_of_each_is_kept(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g", 1), (2, "A b c d e f g", 2), (9, "x y z", 3), (None, "x y z", 4), (7, None, 5)], f"{DOCS}, leader int")
    kept = ngram_join.keep_one_of_each(docs).collect()
    assert sorted(r["leader"] for r in kept) == [2, 3, 4, 5]


@pytest.mark.parametrize(("window", "first"), [(6, 2), (6, 6), (9, 3), (50, 13)])
def test_repeated_words(spark, window, first):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(8)]
    docs: dict[int, str | None] = {0: None, 3: "", 4: "a b"}
    for d in range(10, 70):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(1000)}" for _ in range(rng.randint(1, window))] for _ in range(rng.randint(1, 4))]
        docs[d * 7 % 71 + 5] = rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)
    docs[200], docs[201] = docs[20], docs[20]
    found = substrings.repeated_words(spark.createDataFrame([*docs.items()], DOCS), window, first, with_text=True).collect()
    wanted = brute.kept_words(docs, window)
    assert len(found) == len(docs)
    for r in found:
        kept, n = " ".join(wanted[r["doc_id"]]), len(brute.WORD.findall(docs[r["doc_id"]] or ""))
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, n - len(wanted[r["doc_id"]]), hashlib.sha256(kept.encode()).hexdigest())
        assert r["kept_text"] == kept


def test_repeated_words_of_like_structure_and_repeated_ids(spark):
    def thue_morse(swap: bool) -> str:
        return "".join("ab"[(i.bit_count() % 2) ^ swap] for i in range(1024))

    rest = [f"w{i}" for i in range(60)]
    texts = [(1, [*rest[:30], thue_morse(False), *rest[30:]]), (2, [*rest[:30], thue_morse(True), *rest[30:]]), (4, rest), (4, ["two", "words"]), (5, ["x", *rest, "y"]), (6, rest), (6, ["before", *rest]), (None, rest)]
    found = substrings.repeated_words(spark.createDataFrame([(d, " ".join(t)) for d, t in texts], DOCS), 50, with_text=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == sorted([(1, 61, 0, " ".join(texts[0][1])), (2, 61, 0, " ".join(texts[1][1])), (4, 60, 0, " ".join(rest)), (4, 2, 0, "two words"), (5, 62, 60, "x y"), (6, 60, 60, ""), (6, 61, 60, "before"), (0, 60, 0, " ".join(rest))])


@pytest.mark.parametrize(("cell", "tile"), [(1500, 2048), (20, 16)])
def test_near_vectors(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(embed_join, "CELL", cell)
    monkeypatch.setattr(embed_join, "TILE", tile)
    monkeypatch.setattr(embed_join, "OTHERS", tile * 2)
    monkeypatch.setattr(embed_join, "AT_ONCE", tile * 4)
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(30, 8))
    x = np.repeat(centres, 8, axis=0) + rng.normal(size=(240, 8)) * rng.choice([0.02, 0.1, 0.2], size=(240, 1))
    rows = [(i, v.astype(np.float32).tolist(), i % 3 if i % 11 else None) for i, v in enumerate(x)]
    rows += [(300, rows[5][1], rows[5][2]), (301, rows[5][1], rows[5][2]), (302, None, 1), (303, [], 1), (304, [0.0] * 8, 1), (305, [math.nan] + [1.0] * 7, 1), (306, [math.inf] + [1.0] * 7, 1), (307, [None] + [1.0] * 7, 1), (308, [2 * v for v in rows[5][1]], rows[5][2])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, np.float64), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for n, (a, u, p) in enumerate(good) for b, v, q in good[n + 1 :] if p == q and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98]
    parts = brute.components([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert links and found == {i: (degree[i], parts[i], parts[i] == i) for i in parts}


def test_pivots_grow_with_the_vectors():
    for n, width in [(10, 64), (10**6, 64), (2**31 + 5, 64), (10**11, 1024)]:
        pivots = n * embed_join.pivot_share(n, width) / embed_join.HASHES
        assert pivots == pytest.approx(min(n / embed_join.CELL, embed_join.PIVOT_BYTES / 8 / width), rel=1e-6)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, shared.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 60))) for i in range(12)} | {50: "too short", 51: None, 52: "a b a b a b a b a b a b"}
    docs: dict[int, str | None] = {0: None, 1: "", 2: "a b c"}
    for d in range(3, 80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        if d % 2:
            item = items[d % 12].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = item
        docs[d] = rng.choice([" ", ", "]).join(words).upper()
    docs[90], docs[91] = items[4], "b a " + items[52]
    found = decontam.leaks(spark.createDataFrame([*docs.items()], DOCS), spark.createDataFrame([*items.items()], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    wanted = {(d, i): s for d, t in docs.items() for i, x in items.items() if (s := brute.leak_similarity(t, x, 5)) >= 0.8}
    assert all(got[p] == pytest.approx(wanted[p]) for p in got)  # nothing below the threshold, and the best window of each
    assert {p for p, s in wanted.items() if s >= 0.9} <= set(got)
    assert len(got) >= 0.95 * len(wanted)  # the rest lies beyond the fingerprints' radius
    parts = decontam.leaks(spark.createDataFrame([*docs.items()], DOCS), spark.createDataFrame([*items.items()], "item_id long, text string"), part_shingles=200)
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect()} == set(got)


def test_leaks_of_moved_parts(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = {i: words(59) for i in range(6)} | {7: words(40), 8: words(30)}
    docs = {0: items[0][29:] + items[0][:29], 1: items[1][7:] + items[1][:7], 2: items[2][52:] + items[2][:52], 3: items[7][20:] + items[7][:20], 4: items[3], 5: items[8][15:] + items[8][:15], 6: items[4][:9] + items[4][20:40] + items[4][9:20] + items[4][40:]}
    docs = {d: " ".join(words(30 * (d % 3)) + t + words(40 * (d % 2)) + t * (d % 2) + words(5)) for d, t in docs.items()} | {9: " ".join(items[5][20:] + items[5][:20])}
    texts = {i: " ".join(t) for i, t in items.items()}
    found = decontam.leaks(spark.createDataFrame([*docs.items(), (9, "another text of this id"), (None, docs[0])], DOCS), spark.createDataFrame([*texts.items()], "item_id long, text string")).collect()
    wanted = {(d, i): b for d, t in docs.items() for i, x in texts.items() if (b := brute.best_window(t, x, 5))[0] >= 0.8}
    assert {d for d, _ in wanted} == {0, 1, 2, 3, 4, 9}
    assert {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["windows"]) for r in found} == wanted


def test_leaks_just_over_the_threshold(spark):
    rng = random.Random(5)
    items = {i: [f"w{rng.randrange(3000)}" for _ in range(59)] for i in range(8)}
    docs = {}
    for d in range(400):
        text = list(items[d % 8])
        text[rng.randrange(5, 54)] = f"x{rng.randrange(3000)}"
        text[-1] = f"y{rng.randrange(3000)}"
        docs[d] = " ".join(["before", *text, "behind"])
    texts = {i: " ".join(t) for i, t in items.items()}
    found = decontam.leaks(spark.createDataFrame([*docs.items()], DOCS), spark.createDataFrame([*texts.items()], "item_id long, text string")).collect()
    wanted = {(d, d % 8): b for d, t in docs.items() if (b := brute.best_window(t, texts[d % 8], 5))[0] >= 0.8}
    assert len(wanted) == 400 and max(s for s, _ in wanted.values()) < 0.85
    assert {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["windows"]) for r in found} == wanted
