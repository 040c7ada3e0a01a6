"""Operators on small tables: contracts, brute force, and the defined odd cases."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from proofmill.llm import files, language_id, mixing, near_dup, phrase_index, quality, registry, scratch, sharding, token_file, toxicity, url_filter, warc
from proofmill.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, key long, band long, path string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns that clash."""
    long = "alpha beta gamma delta epsilon zeta " * 4000
    rows = [
        (1, None, None, None, None, "x", 1, 1, "p"), (2, "", "en", "", 0, None, None, None, None), (None, "a null id with some words", None, "s", 1, "x", 1, 1, "p"),
        (3, long, "en", "s", 9, "x", 1, 1, "p"), (3, long, "en", "s", 9, "x", 1, 1, "p"), (4, " \n\t ", "en", "s", 1, "x", 1, 1, "p"),
        (5, "one two three", "en", None, 1, "x", 1, 1, "p"), (6, "One  two\nthree", "fr", "s", 1, "x", 1, 1, "p"), (7, "12 34 !!", "en", "t", 1, "x", 1, 1, "p"),
        (8, "café 中文 \U0001f600 <|endoftext|>", "fr", "t", 1, "x", 1, 1, "p"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# URL filter


def test_url_rules(spark):
    rules = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("a.org", "", "block"), Rule("b.org", "/x*z", "block"), Rule("com", "/en/", "allow")]
    urls = ["http://WWW.Example.com/en/75?q", "https://example.com/en/8", "http://com/en/", "http://notcom/en/", "http://x.a.org", "http://xa.org/", "http://b.org/x/y/z1", "http://b.org/xy", None, "no scheme", "http://e.com/EN/", "://", "http://a.org/\n"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = ["example.com/en/7", "com/en/", "com/en/", None, "a.org", None, "b.org/x*z", None, None, None, None, None, "a.org"]
    for most in (50_000, 0):  # by the index in each task, and by a join
        got = {r.page_id: r for r in url_filter.judge(pages, rules, max_broadcast_rules=most).collect()}
        assert [got[i].rule for i in range(len(urls))] == want
        assert got[2].verdict == "block" and got[3].verdict == "allow" and got[8].host == "" and got[0].host == "www.example.com"
        assert url_filter.judge(pages.where("false"), rules, max_broadcast_rules=most).count() == 0
        twice = url_filter.judge(pages.unionAll(pages).withColumns({"host": F.lit("h"), "verdict": F.lit("v")}), rules, keep=("page_id", "host", "verdict"), max_broadcast_rules=most)
        assert twice.columns == ["page_id", "page_host", "page_verdict", "host", "path", "rule", "verdict"]
        assert Counter((r.page_id, r.rule) for r in twice.collect()) == Counter([*enumerate(want)] * 2)


def test_url_tokens():
    assert Rule("example.com", "/en/7", "allow").tokens() == ["example", "com", "en"]  # the last may go on
    assert Rule("b.org", "/x*z/y/", "block").tokens() == ["b", "org", "y"]
    with pytest.raises(ValueError):
        Rule("a", "/b", "maybe")


# WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 5), (5, "u", "é" * 5), (6, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for threshold in (0, 5):
        got = warc.read_archives(warc.write_archives(pages, scratch.path(spark, "warc"), min_dedup_bytes=threshold, roll_bytes=100)).collect()
        assert len(got) == len(rows) and not any(r.error for r in got)
        by = {r.page_id: r for r in got}
        assert by[5].payload_digest == base64.b32encode(hashlib.sha1(("é" * 5).encode()).digest()).decode() and by[5].payload_bytes == 10 and by[5].record_type == "response"
        small = ("revisit", 2) if threshold == 0 else ("response", None)
        assert (by[1].record_type, by[1].refers_to) == small == (by[None].record_type, by[None].refers_to) and by[2].record_type == "response"
        assert (by[3].record_type, by[3].refers_to) == (("revisit", 4) if threshold == 0 else ("response", None))
    none = warc.read_archives(warc.write_archives(pages.where("false"), scratch.path(spark, "warc")))
    assert none.count() == 0


def test_warc_dictionary_and_faults():
    samples = [f"<html><head><title>page {i}</title></head><body><p>text {i * 7}</p></body></html>".encode() for i in range(300)]
    dictionary = warc.train(samples, 2048)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    good = warc.record(7, "http://a", b"hello", None, False, "2024-01-01T00:00:00Z")
    frame = packer.compress(good)
    data = warc.dictionary_frame(dictionary) + frame * 2
    assert struct.unpack("<I", data[:4])[0] == 0x184D2A5D

    def read(data, size=1 << 20):
        return list(warc.Archive(iter([data[i : i + size] for i in range(0, len(data), size)])).records())

    def fine(records):
        return [r["page_id"] for r in records if isinstance(r, dict)]

    for size in (1, 7, 1 << 20):
        assert fine(read(data, size)) == [7, 7] and len(read(data, size)) == 2
    for cut in (data[:-3], data[8 + len(dictionary) :]):  # cut off; without its dictionary
        assert len(fine(read(cut))) < 2 and not all(isinstance(r, dict) for r in read(cut))
    broken = bytearray(frame)
    broken[6:-2] = bytes(len(broken) - 8)
    found = read(warc.dictionary_frame(dictionary) + frame + bytes(broken) + frame)  # later records are still read
    assert fine(found) == [7, 7] and not isinstance(found[1], dict)
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"hello", b"hallo"), good[:-1], good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"WARC-Date", b"Date")):
        with pytest.raises(warc.BadRecord):
            warc.parse([bad])
        found = read(warc.dictionary_frame(dictionary) + packer.compress(bad) + frame)
        assert fine(found) == [7] and isinstance(found[0], warc.BadRecord)
    assert warc.parse([good[i : i + 1] for i in range(len(good))]) == warc.parse([good])


def test_warc_long_record():
    """40 MB of payload are read in pieces, of which none is kept."""
    good = warc.record(9, None, b"x" * (40 << 20), None, False, "2024-01-01T00:00:00Z")
    frame = zstandard.ZstdCompressor(level=1).compress(good)
    archive = warc.Archive(iter([frame]))
    (row,) = archive.records()
    assert row["payload_bytes"] == 40 << 20
    with pytest.raises(warc.BadRecord):
        warc.parse([b"WARC/1.1\r\n" + b"a" * (2 << 20)])


# Mixing


def test_mixing(spark, docs, odd, empty):
    slim, plan, n = mixing.plan_mix(docs)
    rows = {r.source: r for r in plan.collect()}
    total = sum(r.source_size for r in rows.values())
    assert sum(r.target for r in rows.values()) == pytest.approx(total)
    free = [r for r in rows.values() if r.target < 3 * r.source_size]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(rows))}
    levels = [r.target / weight[r.source] for r in free]
    assert max(levels) == pytest.approx(min(levels)) and all(r.target <= 3 * r.source_size for r in rows.values())
    taken, largest = Counter(), Counter()
    for r in mixing._joined(slim, plan.drop("rows"), n).select("source", "size", (F.col("size") * mixing.times_of()).alias("t")).collect():
        assert r.t <= 3 * r.size
        taken[r.source] += r.t
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - r.target) <= largest[s] / 2 for s, r in rows.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    again = mixing.mix(odd)
    assert again.columns == odd.columns and Counter(again.collect()) == Counter(mixing.mix(odd).collect())
    assert mixing.mix(empty).count() == 0


# Sharding


def test_sharding(docs, odd, empty):
    got = sorted(sharding.byte_shards(docs, 7).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    total, at, slots = sum(r.size for r in got), 0, defaultdict(list)
    for r in got:
        assert r.shard == (2 * at + r.size) * 7 // (2 * total)
        at += r.size
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    r = sharding.byte_shards(odd, 40).collect()
    assert len(r) == odd.count() and {x.size for x in r if x.doc_id == 1} == {16}
    assert sharding.byte_shards(empty, 40).count() == 0


# Language


def test_language(docs, odd, empty):
    held = language_id.held_out(F.col("doc_id"))
    learned = language_id.fit(docs.where(~held))
    got = docs.where(held).select("lang", "text", language_id.identify(docs, learned).alias("p")).collect()
    sure = [r for r in got if len(r.text) > 200]
    assert sum(r.p.lang_pred == r.lang for r in sure) >= 0.95 * len(sure)
    assert all(0 <= r.p.score <= 1 for r in got)
    r = {x.doc_id: x.p for x in odd.select("doc_id", language_id.identify(odd, learned).alias("p")).collect()}
    assert r[1].lang_pred == r[2].lang_pred == r[4].lang_pred == r[7].lang_pred == "und" and r[1].rejected and r[3].lang_pred != "und"
    assert language_id.fit(empty) == {} and empty.select(language_id.identify(empty, {})).count() == 0


def test_language_sizes_against_plain_compression(spark, docs):
    """Each decision from sums of plainly compressed blocks; ties and a single language."""
    learned = language_id.fit(docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["\u00bd \u00b2 \u2163 12", "\u4e2d", "a" * 5000]
    for text in texts:
        got = language_id.Classifier(learned).predict(text)
        if not any(c.isalpha() for c in text):
            assert got == ("und", 0.0)
            continue
        data = b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()))
        sums = {}
        for lang, raw in learned.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sums[lang] = sum(len(zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[i : i + 1024])) for i in range(0, len(data), 1024))
        best, second = sorted(sums.values())[:2]
        assert sums[got[0]] == best and got[1] == 1 - best / second
    same = {"b": b"one two three four", "a": b"one two three four"}
    assert language_id.Classifier(same).predict("one two") == ("b", 0.0)  # the one with more rows stands first
    assert language_id.Classifier({"a": b"one two three four"}).predict("one two") == ("a", 1.0)


def test_many_languages(spark):
    """No limit on their number."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}xyz " * 20, f"l{i}") for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.fit(df)
    assert len(learned) == 260 and language_id.fit(df, max_broadcast_languages=0) == learned


# Quality


def base_of(text):
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + d for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if runs[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_base(spark, docs, odd, empty):
    more = [(i, t) for i, t in enumerate(["a b c a b c", "a a a a", "a a a", "x\n x\nx\nx ", "one two one two one", " x #*|", "w " * 5000])]
    for df in (docs.select("doc_id", "text"), odd, spark.createDataFrame(more, "doc_id long, text string")):
        want = Counter((r.doc_id, *base_of(r.text)) for r in df.collect())
        got = quality.judge(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(empty).count() == 0


def em(patterns, n_rules, steps=40, share=0.7, good=0.98, bad=0.3, weight=10.0):
    g, b = np.full(n_rules, good), np.full(n_rules, bad)
    v, n = np.array([p for p, _ in patterns], float), np.array([c for _, c in patterns], float)

    def belief():
        odds = np.log(share / (1 - share)) + ((v > 0) * np.log(g / (1 - b)) + (v < 0) * np.log((1 - g) / b)).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(steps):
        p = belief()
        ng = np.clip((((v > 0).T * n * p).sum(1) + weight * good) / (((v != 0).T * n * p).sum(1) + weight), 0.001, 0.999)
        nb = np.clip((((v < 0).T * n * (1 - p)).sum(1) + weight * bad) / (((v != 0).T * n * (1 - p)).sum(1) + weight), 0.001, 0.999)
        share, g, b = np.clip(((n * p).sum() + weight * 0.7) / (n.sum() + weight), 0.001, 0.999), ng, nb
    return belief()


def test_quality_em(spark):
    patterns = [((1, 1, 1), 900), ((-1, 1, 1), 40), ((1, -1, 0), 30), ((-1, -1, 1), 20), ((0, 1, 1), 10)]
    df = spark.createDataFrame([(i, [float(x) for x in v], float(n)) for i, (v, n) in enumerate(patterns)], "pattern long, votes array<double>, n double")
    got = {r.pattern: r.posterior for r in quality.posteriors(df, 3).collect()}
    assert [got[i] for i in range(len(patterns))] == pytest.approx(em(patterns, 3).tolist(), abs=1e-9)


def test_quality_kept_against_plain_version(docs):
    """Votes, EM and the decision of whole documents from plain figures."""
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    votes = {}
    for i, t in texts.items():
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        n, chars, symbols, dups, repeats = base_of(t)
        if n < 50 or 100 * repeats > 50 * n:
            continue
        figures = {
            "symbols": symbols / chars, "symbol_kinds": sum(k in t for k in "#*$%&|<>"), "dup_lines": dups / len(lines), "repeats": repeats / n,
            "capitals": len(re.findall("[A-Z]", t)) / chars, "shouts": t.count("!") / len(w), "word_length": abs(chars / n - 5.5),
        }
        votes[i] = tuple(1 if figures[name] <= good else -1 if figures[name] >= bad else 0 for name, _, good, bad in quality.RULES)
    patterns = sorted(Counter(votes.values()).items())
    believed = dict(zip([p for p, _ in patterns], em(patterns, len(quality.RULES)), strict=True))
    for r in quality.judge(docs).collect():
        assert r.kept == (r.doc_id in votes and believed[votes[r.doc_id]] >= 0.5)
        assert r.doc_id not in votes or r.posterior == pytest.approx(believed[votes[r.doc_id]], abs=1e-9)


def test_repeats_past_collisions(spark, monkeypatch):
    """With hashes of eight values nearly all windows collide; the counts stay."""
    plain = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: quality.F.pmod(plain(*c), quality.F.lit(8)))
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, k, 120)) for k in (4, 9, 30, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.figures(rows).collect()}
    assert got == {i: base_of(t)[4] for i, t in enumerate(texts)}


# Near-duplicates


def groups_of(rows, shingle, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dup(spark, docs, odd, empty):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):  # a chain of edits, copies of one text, and a shared passage
        chain = base.copy()
        chain[k : k + k % 9] = [f"z{k}"] * (k % 9)
        rows.append((10_000 + k, " ".join(chain)))
        rows.append((20_000 + k, " ".join(base[:80] + [f"v{k}_{i}" for i in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shingle in (4, 5):
        want = groups_of(rows, shingle, 80)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_groups(df, shingle).collect()}
        assert got == want
    r = {x.doc_id: x for x in near_dup.near_groups(odd, 4).collect()}
    assert r[1].component_id == 1 and r[2].component_id == 2 and r[4].n_shingles == 0 and r[4].kept
    assert r[5].component_id == r[6].component_id == 5 and r[5].kept and not r[6].kept and r[5].n_shingles == 1
    assert near_dup.near_groups(empty).count() == 0


def test_leftover_links_lose_nothing(spark):
    """Pairs that only share a bucket, none with a hub."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(6):
        t = [f"a{i}" for i in rng.integers(0, 9999, 150)]
        texts += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(t[:-5] + [f"q{k}"] * 5))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    made = near_dup.sketches(df, 4, "doc_id", "text").collect()
    members = spark.createDataFrame([(1, r.id, r.id, r.n_shingles, [1, *r.bands[1:]], bytes(r.marks)) for r in made], "band long, id long, root long, n_shingles long, bands array<long>, marks binary")
    got = near_dup.leftover_links(members, df.withColumnRenamed("doc_id", "node"), 4, 80).collect()
    assert sorted((r.a, r.b) for r in got) == [(2 * k, 2 * k + 1) for k in range(6)]


def test_circulant_signature():
    signer = near_dup.Signer()
    x = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    places = (near_dup._mix(x ^ np.uint64(near_dup.SEED)) >> np.uint64(42)).astype(np.int64)
    pi = signer.shifted[:, 0]
    k = 17
    assert signer(x)[k] == min(pi[p + k] if p + k < near_dup.PLACES else signer.shifted[p][k] for p in places)
    y = np.concatenate([x[:320], x[:79] + np.uint64(1)])
    same = (signer(x) == signer(y)).mean()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(same - true) < 0.12


def test_near_dup_rows(spark, odd):
    """Null and shared ids, repeated rows, wordless texts: every row goes by its own text."""
    a, b, c = ("".join(f"{x}{i} " for i in range(60)) for x in "abc")
    rows = [(None, a), (5, a), (None, a + "end"), (7, b), (7, b), (7, c), (8, b), (None, "lone words of a null id"), (9, None), (9, ""), (None, " \n"), (3, "One two"), (4, "one\ttwo")]
    df = spark.createDataFrame([(i, t, "x", 1, b"x") for i, t in rows], "doc_id long, text string, set_key string, node long, marks binary").repartition(5)
    want = [(None, 5, False), (5, 5, True), (None, 5, False), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (None, None, False), (9, 9, True), (9, 9, True), (None, None, False), (3, 3, True), (4, 3, False)]
    got = near_dup.near_groups(df)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got.collect()) == Counter(want)
    left = near_dup.one_of_each(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(5, a), (7, b), (7, c), (None, rows[7][1]), (9, None), (9, ""), (None, " \n"), (3, "One two")])
    assert Counter(near_dup.one_of_each(odd).select("doc_id").collect()) == Counter((i,) for i in (1, 2, None, 3, 4, 5, 7, 8))


def test_repeated_rows_leave_the_least(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, s) for s in ("c", "a", "b")], "doc_id long, text string, source string")
    assert [r.source for r in near_dup.one_of_each(df).collect()] == ["a"]


def test_long_chains_settle(spark):
    """A path of 3,000 links is one component, however many rounds that takes."""
    got = near_dup.components(spark.range(3000).selectExpr("id as a", "id + 1 as b"))
    assert got.count() == 3000 and got.select("root").distinct().collect() == [(0,)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (150, 300), (7, 7)]
    got = {r.id: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[300] == got[200] == got[150] == 100


# Decontamination


def test_phrases(spark, odd, empty):
    items = spark.createDataFrame([(1, "The quick brown fox"), (10, "A b c d e f g h i j k l"), (2, None), (3, "--"), (10, "A b c d e f g h i j k l")], "item_id long, text string")
    texts = ["x THE Quick, brown-fox y the quick brown fox", "a b c d e f g h i j", "b c d e f g h i j k l a b", "the quick", "fox brown quick the", None, "a b c d e f g h i", "x the quick"]
    docs = spark.createDataFrame([*enumerate(texts), (8, "brown fox")], "doc_id long, text string")
    got = {r.doc_id: r for r in phrase_index.decontaminate(docs, items).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i].items) for i in range(9)] == [(10, 8, [1]), (10, 10, [10]), (13, 11, [10]), (2, 0, []), (4, 0, []), (0, 0, []), (9, 0, []), (3, 0, []), (2, 0, [])]
    assert [(s.first, s.end) for s in got[0].spans] == [(1, 5), (6, 10)] and got[4].near_items == [1]
    assert phrase_index.decontaminate(odd, items).count() == odd.count()
    assert phrase_index.decontaminate(empty, items).count() == 0
    assert phrase_index.decontaminate(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_phrase_index_keeps_all_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").coalesce(1)
    row = phrase_index.build_index(docs).collect()
    lists = [phrase_index.Shard(r.asDict()) for r in row]
    assert sum(len(s.list(b"a")) for s in lists if b"a" in s.where) == 2 and sum(len(s.list(b"b")) for s in lists if b"b" in s.where) == 2


# Token files


@pytest.fixture(scope="module")
def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def test_encoder(docs, vocabulary):
    encoder = token_file.Encoder(vocabulary)
    odd = ["", " ", "\n", "a  b", "a \n b", "a  b", "a\t\nb", "it's 5 o'clock\nNow", "x\0y", "<|endoftext|> z", "end\n", "  \xa0 \xa0", "café 中文"]
    texts = [r.text for r in docs.select("text").limit(60).collect()] + odd
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(got, encoder.width).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, odd, empty, vocabulary):
    folder = scratch.path(spark, "tokens")
    manifest, dictionary = token_file.write_tokens(odd, folder, vocabulary, 2, roll_bytes=50)
    got = token_file.read_tokens(manifest, folder, with_ids=True).collect()
    tokenizer = token_file.Encoder(vocabulary).tokenizer
    want = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    at = 0
    for r, w in zip(got, want, strict=True):
        ids = [*tokenizer.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    path = manifest.orderBy("part", "seq").first().path
    one = token_file.Reader(files.read(path), dictionary)
    if one.ids[-1] is not None:
        assert token_file.read_document(path, dictionary, one.ids[-1]).tolist() == one.tokens(len(one.ids) - 1).tolist()
    assert token_file.read_document(path, dictionary, 10**12) is None
    first = manifest.where("n_docs > 0").orderBy("part", "seq").first().path
    assert token_file.read_document(first, dictionary, None).tolist() == got[0].ids  # the null id comes first
    with pytest.raises(ValueError):
        token_file.Reader(files.read(path), b"another")
    with pytest.raises(ValueError):
        token_file.Reader(files.read(path)[:-1], dictionary)
    assert token_file.token_table(empty, vocabulary).count() == 0


# Toxicity


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        text = [f"w{x}" for x in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        text = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in text]
        rows.append((i, " ".join(text + ["vile"] * (i % 3 * 3 + 1) * toxic)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == (i % 4 == 0) == (got[i].grade > 0) for i in range(400))
    assert got[8].expected_severity > got[4].expected_severity > got[12].expected_severity > got[1].expected_severity  # seven hits, four, one, none
    assert (np.diff(model.thresholds) > 0).all() and {got[i].grade for i in range(400)} == {0, 1, 2, 3}
    again = toxicity.fit(docs.repartition(3), marks.repartition(2))
    assert again.features == model.features and (again.weights == model.weights).all() and (again.thresholds == model.thresholds).all()
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert not any(r.toxic for r in toxicity.score(odd, toxicity.fit(odd, marks.where("false"))).collect())
    assert not toxicity.fit(empty, marks).features


def test_toxicity_scores_against_plain_sums(spark, docs):
    """Scores of whole texts, and a very long one, from plain counts of words and starts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.limit(30).collect()] + ["", None, "idiot Idiots " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    for i, text in enumerate(texts):
        found = Counter()
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower()):
            found.update([w.encode(), *[w[:k].encode() + b"*" for k in (4, 5, 6) if len(w) > k]])
        x = sum(model.weights[f] * np.log1p(found[t]) for t, f in model.features.items() if found[t])
        above = 1 / (1 + np.exp(model.thresholds - x))
        assert got[i].expected_severity == pytest.approx(above.sum(), abs=1e-9) and got[i].grade == (above >= 0.5).sum()


def test_ordinal_gradient():
    rng = np.random.default_rng(4)
    indptr = np.arange(0, 121, 3)
    rows = toxicity.Rows(indptr, rng.integers(0, 7, 120), rng.random(120))
    grades = rng.integers(0, 4, 40)
    p = rng.normal(size=7 + 3)
    _, gradient = toxicity.loss(p, rows, grades, 7, 0.01)
    for j in range(len(p)):
        step = np.zeros(len(p))
        step[j] = 1e-6
        slope = (toxicity.loss(p + step, rows, grades, 7, 0.01)[0] - toxicity.loss(p - step, rows, grades, 7, 0.01)[0]) / 2e-6
        assert gradient[j] == pytest.approx(slope, abs=1e-6)


@pytest.mark.parametrize("sf, held_out, least", [("sf0.01", False, 0.9), ("sf0.1", True, 0.9)])
def test_toxic_documents_are_found(spark, sf, held_out, least):
    """At sf0.01 there are four to six toxic labels of each language but one, so only all of them teach enough."""
    at = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    judged = labels.where("pmod(crc32(cast(doc_id as string)), 5) = 0") if held_out else labels
    model = toxicity.fit(docs, labels.join(judged, "doc_id", "left_anti") if held_out else labels)
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(judged, "doc_id").collect()
    assert sum(r.grade > 0 for r in rows if r.toxic) >= least * sum(r.toxic for r in rows)
    assert sum(r.grade > 0 for r in rows if not r.toxic) <= 0.005 * len(rows)


# Queries and SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, sql = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    places = [sql.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in places)) for r in sql.fetchall())


def test_nothing_is_made_local_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch.base(Session())
