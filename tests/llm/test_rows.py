"""Operators on rows: round trips, held-out accuracy, laws of sizes, planted damage; and odd rows for all operators."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontam, embed_join, encode, ngram_join, packing, pii, quality, queries, shards, shared, substrings, tokenfiles, warc_audit

from . import brute

KEY = b"a key for tests"
BYTES, WORDS = queries.BYTES, queries.WORDS
TEXTS = [None, "", "word", "two  words", "A line\nand another one, with <|endoftext|> and 1,234.5!", "ÄÖ naïve 日本語 😀", "x" * 3000, "it's o'clock...\t\tend", " lead and trail "]


@lru_cache
def tokenizer(path: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path(path)))
    t.encode_special_tokens = True
    return t


def plain_ids(path: str, text: str | None) -> list[int]:
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


# personal data


@pytest.mark.parametrize("value", ["hein.19@mail5.example.com", "+1 (743) 555-3824", "4316522678525456", "4316 5226 7852 5456", "152.143.123.131", "2024-02-29", "29/02/2024", "02/29/2024", "01.03.1999", "123-45-6789", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"])
def test_pseudonyms_keep_format_and_go_back(value):
    text, n = pii.pseudonymise(f"see {value}, and {value}", KEY)
    new = text.removeprefix("see ").split(", and ")
    assert n == 2 and new[0] == new[1] != value
    if value.replace(" ", "").isdigit() and len(value) > 12:
        assert pii.luhn(new[0].replace(" ", "")) == 0
    if value == "2024-02-29":
        datetime.date.fromisoformat(new[0])
    assert pii.pseudonymise(text, b"another key", back=True)[0] != f"see {value}, and {value}"
    assert pii.pseudonymise(text, KEY, back=True)[0] == f"see {value}, and {value}"


def test_dates_of_single_digits_come_back_as_two():
    text = pii.pseudonymise("1.3.1999", KEY)[0]
    assert text == pii.pseudonymise("01.03.1999", KEY)[0] and pii.pseudonymise(text, KEY, back=True)[0] == "01.03.1999"


def test_a_day_has_one_pseudonym_in_every_notation():
    days = [datetime.date(2024, 2, 29), datetime.date(1999, 3, 1), datetime.date(2010, 12, 13), datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)]
    for d in days:
        ways = ["{0:04d}-{1:02d}-{2:02d}", "{2:02d}.{1:02d}.{0:04d}", "{2:02d}/{1:02d}/{0:04d}", *(["{1:02d}/{2:02d}/{0:04d}"] if d.day > 12 else [])]
        new = [pii.pseudonymise(w.format(d.year, d.month, d.day), KEY)[0] for w in ways]
        day = datetime.date.fromisoformat(new[0])
        assert new == [w.format(day.year, day.month, day.day) for w in ways] and (day.day > 12) == (d.day > 12)


def test_short_mailboxes_change():
    old = [f"{a}@mail{i}.example.org" for a in "abcdefghijklmnopqrstuvwxyz" for i in range(10)]
    new = [pii.pseudonymise(v, KEY)[0] for v in old]
    assert len(set(new)) == len(old) and all(a != b and re.fullmatch(r"[a-z]@[a-z]{4}\d\.example\.org", b) for a, b in zip(old, new, strict=True))
    assert [pii.pseudonymise(v, KEY, back=True)[0] for v in new] == old


@pytest.mark.parametrize("kind", ["{:03d}-{:02d}-1234", "{1:02d}/{0:02d}/2001"])
def test_pseudonyms_are_valid_again(kind):
    values = {kind.format(a, b) for a in range(1, 29) for b in range(1, 13)}
    new = {v: pii.pseudonymise(v, KEY)[0] for v in values}
    assert len(set(new.values())) == len(values)
    assert all(pii.pseudonymise(n, KEY, back=True) == (v, 1) for v, n in new.items())


@pytest.mark.parametrize("text", ["4316522678525457", "300.1.2.3", "2023-02-30", "version 1.2.3", "000-12-3456", "", "٠١٢-٣٤-٥٦٧٨", "call 12 times"])
def test_what_fails_validation_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, 0)


CARD = "4316522678525456"


@pytest.mark.parametrize("text", ["{} 123", "{} 12/25", "12 {}", "12 {} 7", "12-{}", "{}-12", "{} 190.137.223.204", "190.137.223.204 {}", "{} {}", "{} 3.14", "7 {} 190.137.223.204", "1234567890123 190.137.223.204", "123 743-555-3824"])
@pytest.mark.parametrize("card", [CARD, "4316 5226 7852 5456"])
def test_cards_between_other_numbers(text, card):
    new = {v: pii.pseudonymise(v, KEY)[0] for v in (card, "190.137.223.204", "743-555-3824")}
    wanted, n = text.format(*[card] * 2), 0
    for v in new:
        n, wanted = n + wanted.count(v), wanted.replace(v, new[v])
    assert pii.pseudonymise(text.format(*[card] * 2), KEY) == (wanted, n)
    assert pii.pseudonymise(wanted, KEY, back=True) == (text.format(*[card] * 2), n)


def test_a_card_keeps_its_pseudonym_beside_any_number():
    new = pii.pseudonymise(CARD, KEY)[0]
    assert all(pii.pseudonymise(f"{CARD} {i:03d}", KEY) == (f"{new} {i:03d}", 1) for i in range(1000))
    assert all(pii.pseudonymise(pii.pseudonymise(t, KEY)[0], KEY, back=True)[0] == t for t in (f"4316 5226 7852 5456 {i:03d}" for i in range(1000)))
    others = [t for i in range(300) if pii._card_span(t := f"4316 5226 7852 5457 {i:03d}") == (0, len(t))]
    assert all(pii.pseudonymise(pii.pseudonymise(t, KEY)[0], KEY, back=True)[0] == t for t in others)


def test_permutations_have_no_collisions():
    f = pii.Feistel(KEY)
    assert sorted(f.permute(x, 30, 30, "t") for x in range(900)) == list(range(900))
    assert sorted(f.within(x, 700, "t") for x in range(700)) == list(range(700))


def test_pseudonyms_leave_the_rest(spark, docs):
    out = {r["doc_id"]: r for r in pii.pseudonyms(docs, KEY, count_col="n").collect()}
    for r in docs.collect():
        assert (out[r["doc_id"]]["text"], out[r["doc_id"]]["n"]) == pii.pseudonymise(r["text"], KEY)
        assert out[r["doc_id"]]["source"] == r["source"]


# quality


def test_held_out_accuracy(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.is_dir():
        pytest.skip("no test tables here")
    labels = queries.table(spark, str(folder), "labels")
    scored = quality.quality_scores(queries.table(spark, str(folder), "documents"), labels).join(labels, "doc_id").toPandas()
    assert set(scored[scored.held_out].doc_id) == {d for d in scored.doc_id if zlib.crc32(str(d).encode()) % 3 == 1}
    held = scored[scored.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9
    assert ((scored.score >= 0.5) == (scored.predicted == 1)).all() and scored.score.between(0, 1).all()


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    k = len(quality.WEIGHTS)
    raw = [np.hstack([rng.integers(0, 50, (80, k)), rng.integers(50, 99, (80, k))]).astype(float) for _ in (0, 1)]
    rates, sums = np.full(k, 0.3), {}
    for c in (0, 1):
        x = np.hstack([np.ones((80, 1)), quality.transformed(raw[c], rates)])
        sums[c] = x.T @ x
    model = quality.solve(rates, sums)
    densities = []
    for c in (0, 1):
        x, own = quality.transformed(raw[0], rates), quality.transformed(raw[c], rates)
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.trace(cov) / k * np.eye(k)
        d = x - own.mean(axis=0)
        densities.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(raw[0]), 1 / (1 + np.exp(densities[0] - densities[1])))


def test_without_labels_all_score_a_half(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    scores = quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r["score"] for r in scores] == [0.5, 0.5]


# shards


def test_uniform_shards(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = shards.uniform_shards(docs, 16, block_rows=20).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert len(by) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_communication_matrix_is_drawn_as_by_a_permutation():
    blocks, sizes = [30, 50, 20], [34, 33, 33]
    drawn = np.array([shards.communication(blocks, sizes, s) for s in range(3000)])
    assert (drawn.sum(axis=2) == blocks).all() and (drawn.sum(axis=1) == sizes).all()
    assert np.allclose(drawn.mean(axis=0), np.outer(blocks, sizes) / 100, atol=0.2)
    variance = 30 * 0.34 * 0.66 * 70 / 99
    assert abs(drawn[:, 0, 0].var() - variance) < 0.5


@pytest.mark.parametrize(("good", "bad", "n"), [(3, 4, 5), (30, 70, 30), (500, 40, 300), (6 * 10**10, 9 * 10**11, 2 * 10**7), (10**12, 10**9, 10**6), (10**10, 10**14, 10_000)])
def test_hypergeometric_draws_have_the_exact_law(good, bad, n):
    rng, total, times = np.random.default_rng(good % 97), good + bad, 20_000
    drawn = np.array([shards.hypergeometric(rng, good, bad, n) for _ in range(times)], float)
    assert drawn.min() >= max(0, n - bad) and drawn.max() <= min(n, good)
    mean = n * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)))
    z = (drawn - mean) / spread
    assert abs(z.mean()) < 5 / math.sqrt(times) and abs((z**2).mean() - 1) < 0.06
    if total < 1000:
        for k in range(max(0, n - bad), min(n, good) + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(total, n)
            assert abs((drawn == k).mean() - p) < 5 * math.sqrt(p / times) + 1e-4


def test_the_order_of_shards_is_uniform(spark):
    table = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1)
    found = shards.uniform_shards(table, 4, block_rows=500).toPandas()
    place = found.shard * 1500 + found.slot
    assert abs(np.corrcoef(found.doc_id, place)[0, 1]) < 0.07
    halves = Counter(zip(found.doc_id // 1500, place // 1500, strict=True))  # each quarter of the input in each shard
    assert len(halves) == 16 and sum((n - 375) ** 2 / 375 for n in halves.values()) < 35
    step = np.diff(found.sort_values(["shard", "slot"]).doc_id.to_numpy())
    assert 0.45 < (step > 0).mean() < 0.55


# token ids


@pytest.mark.parametrize(("path", "spaces"), [(BYTES, True), (WORDS, False)])
def test_encoder_is_the_tokenizer(path, spaces):
    got = encode.Encoder(path, spaces)(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain_ids(path, t)[:-1] for t in TEXTS]


def test_token_files(spark, docs):
    rows = [(i * 5, t) for i, t in enumerate(TEXTS)]
    table, folder = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select(F.col("doc_id") + 1000, "text")), shared.fresh_path(spark, "test-files")
    manifest = tokenfiles.write_ids(table, folder, WORDS, 1, spaces=False, row_ids=64)
    found = {r["doc_id"]: r for r in tokenfiles.read_digests(manifest, folder).collect()}
    at, all_ids = 0, []
    for doc, text in sorted(map(tuple, table.collect())):
        ids = plain_ids(WORDS, text)
        assert (found[doc]["start"], found[doc]["n_tokens"], found[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        all_ids += ids
    read = []
    for m in sorted(manifest.collect(), key=lambda m: m["part"]):
        part = tokenfiles.TokenFile(folder, m["path"])
        for r in range(-(-m["n_ids"] // 64)):
            ids, mask = part.row(r)
            assert len(ids) == len(mask) == 64 and mask.dtype == np.uint8 and not (ids.flags.owndata or mask.flags.owndata)
            read += ids[mask == 1].tolist()
    assert read == all_ids


def _check_packed(rows, ids: dict[int, list[int]]) -> None:
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        assert [x for r in sorted(own, key=lambda r: r["start"]) for x in range(r["start"], r["start"] + r["length"])] == list(range(len(ids[d])))
    padding, groups = 0, Counter()
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        used, (tier,) = sum(r["length"] for r in own), {r["tier"] for r in own}
        assert used <= tier
        padding += tier - used
        groups[own[0]["step_group"]] += tier
    assert max(groups.values()) <= packing.STEP_IDS
    assert sum(n < packing.STEP_IDS for n in groups.values()) <= 8 * len(packing.TIERS)  # one of each tier and task
    assert padding <= 256 * 8  # less than a short window for each task


def test_packing(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {10**6 + i: t for i, t in enumerate(TEXTS)}
    table = spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(3)
    _check_packed(packing.packed(table, BYTES, 1).collect(), {d: plain_ids(BYTES, t) for d, t in texts.items()})


# WARC


def test_fixity_audit(spark, sf_dir):
    pages = [(i, f"http://x/{i}", f"<p>{'y' * (i % 40)}") for i in range(60)] + [(3, "http://x/3", "again"), (None, None, None)]
    found = warc_audit.records(spark.createDataFrame(pages, "page_id long, url string, html string"), file_records=20)
    one, two = shared.fresh_path(spark, "warc"), shared.fresh_path(spark, "warc")
    index = warc_audit.write_warc(found, one, two)
    assert {r["state"] for r in warc_audit.audit(index, one, two).collect()} == {"intact"}
    rows = {(r["file"], r["record"]): r for r in index.collect()}
    file, at = "warc-0-0", lambda folder, key: Path(folder.removeprefix("file://")) / rows[key]["path"]
    bitten, hurt = rows[file, 7], at(two, (file, 7))
    raw = bytearray(hurt.read_bytes())
    raw[bitten["place"] + 13] ^= 1
    cut = rows[file, 19]["place"]
    hurt.write_bytes(raw[:cut])
    at(two, ("warc-1-0", 0)).unlink()
    kept = at(one, ("warc-2-0", 0))
    kept.write_bytes(b"#" + kept.read_bytes()[1:])
    state = {(r["file"], r["record"]): r["state"] for r in warc_audit.audit(index, one, two).collect()}
    wanted = {k: "missing" if k[0] == "warc-1-0" or k[0] == file and rows[k]["place"] >= cut else "intact" for k in rows} | {(file, 7): "altered", ("warc-2-0", 0): "decayed"}
    assert state == wanted


def test_records_of_odd_pages(spark):
    long_page = "<p>" + "ä" * 3_000_000
    pages = [(1, "u", long_page, "x", "y"), (1, "u", "again", "x", "y"), (2, None, None, None, None), (None, "u", "no id", "x", "y"), (None, "u", "no id", "x", "y"), *((7, "u", "hot", "x", "y") for _ in range(45))]
    folder = shared.fresh_path(spark, "warc")
    index = warc_audit.write_warc(warc_audit.records(spark.createDataFrame(pages, "page_id long, url string, html string, file string, bytes string"), file_records=10), folder)
    found, ids, files = [], [], {}
    for r in sorted(index.collect(), key=lambda r: (r["file"], r["record"])):
        stored = (Path(folder.removeprefix("file://")) / r["path"]).read_bytes()[r["place"] : r["place"] + r["stored"]]
        raw = gzip.decompress(stored)
        assert len(raw) == r["length"] and hashlib.sha256(raw).hexdigest() == r["sha256"] and r["offset"] == files.get(r["file"], 0)
        files[r["file"]] = r["offset"] + r["length"]
        head, body = raw.split(b"\r\n\r\n", 1)
        ids.append(re.search(b"WARC-Record-ID: <(.*)>", head)[1])
        found.append((r["page_id"], body.removesuffix(b"\r\n\r\n").decode()))
    assert len(set(ids)) == len(pages) and b"urn:page:2" not in ids  # its range is dealt to several files
    assert Counter(found) == Counter((p[0], p[2] or "") for p in pages)


def test_fixity_same_as_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.op10_warc_fixity(spark, sf_dir), queries.OP10_SQL)


# odd rows

ODD = "doc_id long, text string, lang string, source string, n_chars long, n int, id string, doc long, value int, tokens string, x double, leader int, hits int, size int, shard int"
LONG = "long text of many words " * 20_000
OPERATORS = {
    "leaks": (lambda d, b, lb: decontam.leaks(d, b), None),
    "keep_clean": (lambda d, b, lb: decontam.keep_clean(d, b), None),
    "quality": (lambda d, b, lb: quality.quality_scores(d, lb), 9),
    "keep_good": (lambda d, b, lb: quality.keep_good(d, lb), None),
    "pii": (lambda d, b, lb: pii.pseudonyms(d, KEY, count_col="n"), 9),
    "shards": (lambda d, b, lb: shards.uniform_shards(d), 9),
    "substrings": (lambda d, b, lb: substrings.repeated_words(d), 9),
    "jaccard": (lambda d, b, lb: ngram_join.jaccard_components(d), 9),
    "one_of_each": (lambda d, b, lb: ngram_join.keep_one_of_each(d), None),
    "token_files": (lambda d, b, lb: tokenfiles.read_digests(tokenfiles.write_ids(d, f := shared.fresh_path(d.sparkSession, "odd"), WORDS, 1, False), f), 9),
    "packing": (lambda d, b, lb: packing.packed(d, BYTES, 1).where("start = 0"), 9),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    run, rows = OPERATORS[name]
    extra = ("en", None, 1, 1, "id", 2, 3, "t", None, 4, 5, 6, 7)
    given = [(1, None), (2, ""), (3, LONG), (4, LONG), (5, "tie"), (5, "tie"), (None, "no id"), (None, None), (8, "an item of the benchmark that is long enough to be found")]
    odd = spark.createDataFrame([(*g, *extra) for g in given], ODD)
    items = spark.createDataFrame([(1, given[-1][1], 0), (None, "no id at all", 0), (2, None, 0), (3, "", 0)], "item_id long, text string, doc_id int")
    labels = spark.createDataFrame([(1, 1, None, "x"), (2, None, 0, "x"), (None, 0, 0, "x"), (3, 7, 0, "x")], "doc_id long, quality int, toxic int, text string")
    found = run(odd, items, labels).collect()
    assert rows is None or len(found) == rows
    assert run(odd.limit(0), items.limit(0), labels.limit(0)).count() == 0


def test_odd_vectors_and_pages(spark):
    odd = spark.createDataFrame([(1, None, None, 1), (2, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1), (None, [1.0, 0.0], 1, 1), (3, [1.0], 1, 1), (4, [1e30, 1.0], 1, 1)], "vec_id long, embedding array<float>, label int, rep int")
    assert embed_join.near_vectors(odd).count() == 6
    assert embed_join.near_vectors(odd.limit(0)).count() == 0
    none = warc_audit.records(spark.createDataFrame([], "page_id long, url string, html string, file string"))
    a, b = shared.fresh_path(spark, "warc"), shared.fresh_path(spark, "warc")
    index = warc_audit.write_warc(none, a)
    assert warc_audit.audit(index, a, b).count() == 0


# the pipeline


def test_pipeline_stage_by_stage(spark, sf_dir, docs):
    """Each stage against a brute-force version on its own input."""
    inputs = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in inputs.collect()}
        out = shared.stash(stage(spark, inputs, sf_dir), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            scores = quality.quality_scores(inputs, queries.table(spark, sf_dir, "labels"))
            assert set(after) == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
        elif name == "near_duplicates":
            least = brute.components(list(before), brute.jaccard_links(before, 5, 80))
            assert set(after) == {d for d in before if least[d] == d}
        elif name == "decontamination":
            items = [r["text"] for r in queries.table(spark, sf_dir, "benchmark").collect()]
            best = {d: max((brute.leak_similarity(t, x, 5) for x in items), default=0) for d, t in before.items()}
            gone = set(before) - set(after)
            assert {d for d, s in best.items() if s >= 0.9} <= gone <= {d for d, s in best.items() if s >= 0.8}
        elif name == "pii":
            assert after == {d: pii.pseudonymise(t, queries.DEMO_KEY)[0] for d, t in before.items()}
        else:
            _check_packed(out.collect(), {d: plain_ids(BYTES, t) for d, t in before.items()})
        inputs = out
