"""The training-data operators against brute force on a fixture of odd rows."""

import collections
import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from conftest import ROOT
from samplequote.llm import (bpe, bpe_codec, common, components, crf_toxicity, exact_dedup, knn_quality, link_filter,
                             near_dedup, packing, set_hash, sharding, token_counts)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BASE = "The quick brown fox jumps over the lazy dog while seven tall zebras watch from a distant green hill today"
ROWS = [
    (1, BASE), (2, BASE), (3, "  " + BASE.replace(" ", "\t")), (4, BASE + " again"), (5, None), (6, ""), (7, " \n\t "),
    (8, "short text"), (9, "Short\u00a0text"), (10, "<|endoftext|>a<|startoftext|> B\u00e9 I'LL \u4e2d\u6587 \u00bd"),
    (11, "word " * 30_000), (12, "e\u0301 \u1e9b\u0323 \u0130 \u03a3\u03a3"), (13, BASE.upper()),
    (14, "\n".join(f"line {i} of a long list of things" for i in range(300))), (15, "short text"),
]
TABLE = "doc_id long, text string, digest string, word string, kept boolean, score double"


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame([(*r, "x", "y", True, 0.5) for r in ROWS], TABLE).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def odd(docs):
    """Repeated rows and null ids besides."""
    return docs.unionByName(docs.where("doc_id in (1, 8)")).unionByName(
        docs.where("doc_id in (2, 8)").withColumn("doc_id", F.lit(None).cast("long")))


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


# --- 1: exact deduplication --------------------------------------------------------

def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(docs, bits):
    got = rows_of(exact_dedup.deduplicate(*exact_dedup.halves(docs), bits=bits))
    assert {d: (r.keep_id, r.group_size, r.text_sha256) for d, r in got.items()} == brute_exact(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.values())


def test_exact_dedup_odd_rows(odd, empty):
    got = exact_dedup.deduplicate(*exact_dedup.halves(odd)).collect()
    assert len(got) == len(ROWS) + 4
    assert {r.group_size for r in got if r.doc_id in (1, 2, 3)} == {5}
    assert all(r.keep_id == 3 and not r.kept for r in got if r.doc_id in (1, 2))
    assert exact_dedup.deduplicate(empty, empty).count() == 0


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 20_000):
        keys = rng.integers(0, 1 << 60, n)
        f = exact_dedup.build_filter(keys)
        assert n == 0 or exact_dedup.probe_filter(f, keys).all()
        others = rng.integers(0, 1 << 60, 20_000)
        assert exact_dedup.probe_filter(f, others).mean() < 0.02
    assert len(f["slots"]) < 1.4 * n


# --- 2, 10: tokens -----------------------------------------------------------------

@pytest.fixture(scope="module")
def wanted():
    t = Tokenizer.from_file(VOCABULARY)
    return {d: (ids := t.encode(x or "", add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for d, x in ROWS}


@pytest.mark.parametrize("common_words", [50_000, 0, 3])
def test_token_counts(docs, wanted, common_words):
    got = rows_of(token_counts.token_counts(docs, VOCABULARY, common=common_words))
    assert {d: (r.n_bytes, r.n_tokens) for d, r in got.items()} == {
        d: (len((x or "").encode()), len(wanted[d][0])) for d, x in ROWS}
    assert got[11].over_limit and not got[8].over_limit


def test_widespread_words_are_bounded(spark):
    rows = [(f"w{i}", 1000 - i, 1) for i in range(500)] + [(f"rare{i}", 1, 1) for i in range(5000)] + [("long" * 30, 5000, 9)]
    pieces = spark.createDataFrame(rows, "word string, n_docs long, pieces int")
    for bound in (0, 10, 300, 600, 5499, 100_000):
        got = [r.word for r in token_counts.widespread(pieces, bound).collect()]
        assert len(got) <= bound and "long" * 30 not in got
    assert len(got) == 5500 and 0 < token_counts.widespread(pieces, 300).count()
    assert token_counts.widespread(pieces.where("false"), 10).count() == 0


def test_token_counts_odd_rows(odd, empty):
    got = token_counts.token_counts(odd, VOCABULARY, common=1).collect()
    assert len(got) == len(ROWS) + 4 and len({r.n_tokens for r in got if r.doc_id == 1}) == 1
    assert token_counts.token_counts(empty, VOCABULARY).count() == 0


def test_codec(docs, wanted, empty):
    got = rows_of(bpe_codec.encode(docs, VOCABULARY))
    assert {d: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for d, r in got.items()} == wanted
    assert bpe_codec.round_trip_digests(empty, VOCABULARY).count() == 0


def test_merges_on_random_texts():
    enc, random_ = bpe.Encoder(VOCABULARY), random.Random(3)
    for _ in range(1500):
        text = "".join(random_.choice("aA \u00e9e\u0301<|endoftext|>'sS1\u00bd\n\t-!?\u4e2d\u03a3\u0130") for _ in range(random_.randint(0, 30)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids


# --- 3: URL filter -----------------------------------------------------------------

def test_rules_and_hosts(spark):
    urls = ["http://A.Net/x", "https://b.example.net/en/1?q", "http://example.net", "http://x.example.com/de/", None,
            "nothing", "http://notexample.com/de/", "x://fr.org/fr/a#b", "http://u@h:1/p?x#y"]
    pages = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_filter.judge(pages).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("b.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.net", "", None, "allow"), 3: ("x.example.com", "/de/", "example.com/de/", "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("notexample.com", "/de/", None, "allow"),
        7: ("fr.org", "/fr/a", "org/fr/", "allow"), 8: ("u@h:1", "/p", None, "allow")}
    assert link_filter.judge(pages.where("false")).count() == 0


def test_propagation_against_dense_iteration(spark):
    hosts = ["good.org", "bad.net", "farm.com", "friend.com", "other.com"]
    links = {"farm.com": ["bad.net"], "good.org": ["friend.com"], "friend.com": ["other.com", "farm.com"], "bad.net": ["farm.com"]}
    rows = [(i, f"http://{h}/fr/", "".join(f'<a href="http://{t.upper()}/x">t</a>' for t in links.get(h, []))) for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in link_filter.judge(pages, rounds=12).collect()}

    def rank(edges, seeds):
        x = dict(seeds)
        for _ in range(12):
            moved = collections.Counter()
            for s, ts in edges.items():
                for t in ts:
                    moved[t] += x.get(s, 0.0) / len(ts)
            back = 1 - 0.85 * sum(moved.values())
            x = {h: 0.85 * moved[h] + back * seeds.get(h, 0.0) for h in hosts}
        return x
    turned = collections.defaultdict(list)
    for s, ts in links.items():
        for t in ts:
            turned[t].append(s)
    trust, distrust = rank(links, {"good.org": 1.0}), rank(turned, {"bad.net": 1.0})
    for h in hosts:
        assert abs(got[h].trust - trust[h]) < 1e-9 and abs(got[h].distrust - distrust[h]) < 1e-9
        if got[h].rule is None:
            assert got[h].verdict == ("block" if distrust[h] > trust[h] else "allow")
    assert distrust["farm.com"] > 0 and trust["other.com"] > 0


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    rows = [(0, "http://bad.net/", ""), (1, "http://farm.com/", '<a href="//bad.net/x">x</a>'), (2, "http://far.com/", '<a HREF=http://farm.com>')]
    got = {r.host: r.verdict for r in link_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"bad.net": "block", "farm.com": "block", "far.com": "block"}


def test_long_chains_are_followed_to_the_end(spark):
    hosts = [f"h{i}.com" for i in range(30)] + ["bad.net"]
    rows = [(i, f"http://{h}/", f'<a href="//{n}/x">x</a>') for i, (h, n) in enumerate(zip(hosts, hosts[1:]))] + [(30, "http://bad.net/", "")]
    got = {r.host: r for r in link_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    moves = np.eye(31, k=1)  # distrust goes from a host to the one that links to it
    seed = np.eye(31)[30]
    want = np.linalg.solve(np.eye(31) - 0.85 * moves + 0.85 * np.outer(seed, moves.sum(axis=0)), seed)
    assert all(r.verdict == "block" for r in got.values())
    assert np.allclose([got[h].distrust for h in hosts], want, rtol=1e-4, atol=0)


# --- 4: sharding -------------------------------------------------------------------

@pytest.mark.parametrize("limit", [200, 5000, 10 ** 9])
def test_shards_fit(odd, limit):
    got = sharding.shard_documents(odd, limit).collect()
    assert len(got) == len(ROWS) + 4
    sizes, count = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
        count[r.shard] += 1
    for r in got:
        assert r.shard_bytes == sizes[r.shard]
        assert sizes[r.shard] <= limit or (count[r.shard] == 1 and r.oversize)


def test_rows_of_one_key_fill_their_shards(spark):
    docs = spark.createDataFrame([(7, "x" * (10 + 7 * (i % 143))) for i in range(1000)] + [(i, "other") for i in range(50)]
                                 + [(7, "y" * 9000)], "doc_id long, text string").repartition(5)
    got = sharding.shard_documents(docs, 8192).collect()
    assert len(got) == 1051
    sizes, count = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(r.shard_bytes == sizes[r.shard] and (sizes[r.shard] <= 8192 or (r.oversize and count[r.shard] == 1)) for r in got)
    hot = {r.shard for r in got if r.doc_id == 7 and not r.oversize}
    total = sum(r.n_bytes for r in got if r.doc_id == 7 and not r.oversize)
    assert len(hot) <= 2 * -(-total // 8192)


def test_shard_files(spark, docs, empty):
    path = sharding.write_shards(docs, 5000)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS) and set(docs.columns) <= set(back.columns)
    assert sharding.shard_documents(empty, 100).count() == 0


# --- 5: near duplicates ------------------------------------------------------------

def brute_near(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    rows = list(ROWS)
    for i in range(40):  # near copies of one text, and chains of small edits
        t = list(base)
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((100 + i, " ".join(t)))
    for i in range(40):
        base[r.randrange(len(base))] = r.choice(words)
        rows.append((200 + i, " ".join(base)))
    return rows + [(300 + i, " ".join(r.choice(words) for _ in range(30))) for i in range(20)]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, monkeypatch, small):
    if small:  # every large path: branching nodes, clusters over several tasks
        for name, value in (("NODE", 2), ("CLUSTER_ROWS", 4), ("BLOCK", 8), ("CHOSEN", 16)):
            monkeypatch.setattr(near_dedup, name, value)
    rows = near_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(near_dedup.near_duplicates(table, 3, 85))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_near(rows, 3, 85)
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_blocks_are_cut_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
    sets = spark.createDataFrame([(1, i, 40) for i in range(60)] + [(2, 100, 900), (2, 101, 900)], "cluster long, rep long, n long")
    held = collections.Counter()
    rows = near_dedup._in_blocks(sets).collect()
    for r in rows:
        held[r.cluster, r.block] += r.n
    assert max(n for (c, _), n in held.items() if c == 1) <= 4 * 200
    assert {(r.cluster, r.blocks, r.turns) for r in rows} == {(1, 13, 5), (2, 10, 1)}


def test_large_clusters_hold_a_block_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CLUSTER_CHARS", 1000)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    seen = []
    small, large = near_dedup._search_clusters, near_dedup._search_large

    def watch(kind, f):
        def call(rows, *rest):
            seen.extend((kind, r.chars) for r in rows.groupBy("cluster").agg(F.sum(F.length("text")).alias("chars")).collect())
            return f(rows, *rest)
        return call
    monkeypatch.setattr(near_dedup, "_search_clusters", watch("task", small))
    monkeypatch.setattr(near_dedup, "_search_large", watch("blocks", large))
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{text} end{i}") for i in range(5)] + [(9, f"{text} " + " ".join(f"v{i}" for i in range(60)))]  # far fewer than 64 sets
    got = rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_near(rows, 3, 85)
    assert [k for k, _ in seen] == ["blocks"] and all(c <= 1000 for k, c in seen if k == "task")


def test_near_duplicates_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd, 5, 80).collect()
    assert len(got) == len(ROWS) + 4
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(empty, 5, 80).count() == 0


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 10)
    edges = [(500, i) for i in range(600, 700)] + [(i, 3) for i in range(700, 760)] + [(759, 500), (4, 3)] + [(900 + i, 901 + i) for i in range(0, 20, 2)]
    for broadcast in (100, 0):
        monkeypatch.setattr(components, "MAX_HUBS", broadcast)
        got = {r.vertex: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {**{v: 3 for e in edges[:162] for v in e}, **{900 + i: 900 + i // 2 * 2 for i in range(20)}}


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 90), (90, 100), (7, 7)]
    got = {r.vertex: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 90, 90: 90}


# --- 6: fingerprints ---------------------------------------------------------------

def test_fingerprints(docs):
    got = rows_of(set_hash.edited_fingerprints(docs))
    ordered = sorted(((d, t or "") for d, t in ROWS), reverse=True)
    for i, (d, t) in enumerate(ordered):
        half, following = len(t) // 2, ordered[(i + 1) % len(ordered)][1]
        edited = t[:len(t) - half] + following[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint and got[2].near_next == 1.0


def test_fingerprints_odd_rows(odd, empty, spark):
    assert set_hash.edited_fingerprints(odd).count() == len(ROWS) + 4
    assert set_hash.edited_fingerprints(empty).count() == 0
    one = set_hash.edited_fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"a a").hexdigest()


def test_lanes_of_many_equal_lines_do_not_wrap(spark):
    rows = [(2, "ok\n" * 40_000), (1, "something else")]
    got = rows_of(set_hash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[2].near_edited > 0.99
    texts = spark.createDataFrame([(1, "ok\n" * 40_000)], "k long, text string")
    lane = set_hash.text_lanes(texts, ["k"], "text").first().lanes
    assert lane.n == 40_000 and {abs(x) for x in lane.signed} == {40_000}


def test_ranges_split_an_id_with_many_texts(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(77, f"other text {i}") for i in range(300)] + [(None, f"no id {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = [r["count"] for r in set_hash.with_next(docs).groupBy("part").count().collect()]
    assert sum(parts) == 800 and max(parts) < 3 * sorted(parts)[len(parts) // 2]
    texts = {r.text: r.next_text for r in set_hash.with_next(docs).collect()}
    at, seen = "text 3", set()
    while at not in seen:  # one circle through all documents
        seen.add(at)
        at = texts[at]
    assert len(seen) == 800
    ids = {t: i for i, t in rows}
    drops = sum((ids[a] is None, -(ids[a] or 0)) > (ids[b] is None, -(ids[b] or 0)) for a, b in texts.items())
    assert drops == 1  # descending ids, null ids last, then from the start


def test_order_insertion_deletion(spark):
    texts = spark.createDataFrame([(1, "a b\nc d\ne"), (2, "e\na b\nc d"), (3, "a b\ne"), (4, "c d")], "k long, text string")
    lanes = {r.k: r for r in set_hash.text_lanes(texts, ["k"], "text").crossJoin(spark.range(1)).collect()}
    assert lanes[1].lanes == lanes[2].lanes != lanes[3].lanes
    pair = set_hash.text_lanes(texts.where("k = 3"), ["k"], "text").select(F.col("lanes").alias("a")).join(
        set_hash.text_lanes(texts.where("k = 4"), ["k"], "text").select(F.col("lanes").alias("b")), F.lit(True))
    r = pair.select(set_hash.insert_pieces(F.col("a"), F.col("b")).alias("s")).first()
    assert r.s == lanes[1].lanes
    back = pair.select(set_hash.delete_pieces(set_hash.insert_pieces(F.col("a"), F.col("b")), F.col("b")).alias("s")).first()
    assert back.s == lanes[3].lanes


# --- 7, 9: classifiers -------------------------------------------------------------

def test_marginals_against_enumeration():
    model = crf_toxicity.Field(stay=0.7, enter=-0.4, leave=0.3)
    e = np.array([0.5, -1.0, 2.0, 0.1, -0.3, 1.0])
    starts = np.array([0, 4, 4, 6])
    p = crf_toxicity.marginals(e, starts, model)
    for lo, hi in zip(starts[:-1], starts[1:]):
        n, total, mass = hi - lo, 0.0, np.zeros(hi - lo)
        for bits in range(1 << n):
            y = [(bits >> i) & 1 for i in range(n)]
            score = sum(e[lo + i] * y[i] for i in range(n)) + sum(
                (0, model.enter, model.leave, model.stay)[2 * y[i] + y[i + 1]] for i in range(n - 1))
            total += np.exp(score)
            mass += np.exp(score) * np.array(y)
        assert np.allclose(p[lo:hi], mass / max(total, 1e-300))


@pytest.fixture(scope="module")
def real(spark):
    return common.documents(spark, "/root/testdata/sf0.1"), common.labels(spark, "/root/testdata/sf0.1")


def held_out_counts(scored, label_rows, label, threshold):
    joined = scored.join(label_rows, "doc_id").where("held_out")
    hit = (F.col("score") >= threshold).cast("int")
    return {(r.y, r.p): r.n for r in joined.groupBy(F.col(label).alias("y"), hit.alias("p")).agg(F.count("*").alias("n")).collect()}


def test_prefix_that_clean_words_share_is_found():
    plain = [f"common{i % 7} plain{i % 11} other{i % 5}" for i in range(240)]
    toxic = [f"{t} vilename{i % 9} vilename{i % 8}x" for i, t in enumerate(plain[:15])]
    clean = [f"{t} vilename{i}" if i < 14 else t for i, t in enumerate(plain[15:])]
    y = np.array([1] * len(toxic) + [0] * len(clean))
    found = set(crf_toxicity._marking(*crf_toxicity._indexed(toxic + clean), y).tolist())
    assert set(crf_toxicity.features("vilename0")) & found
    assert not set(crf_toxicity.features("common1")) & found
    assert not set(crf_toxicity.features("plain1")) & found


def test_toxicity_held_out(real):
    docs, labels = real
    out = common.held_out("doc_id", 3, 1)
    model = crf_toxicity.fit_from_tables(docs, labels, ~out)
    scored = crf_toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).withColumn("held_out", out)
    n = held_out_counts(scored, labels, "toxic", 0.7)
    assert n.get((0, 1), 0) < 0.02 * (n[0, 0] + n.get((0, 1), 0)) and n[1, 1] > 0.7 * (n[1, 1] + n.get((1, 0), 0))
    _, hits = crf_toxicity.tag_batch(["You are an idiot today", "", "clean words"], crf_toxicity.Emissions(model))
    assert [(h["start"], h["end"]) for h in hits[0]] == [(11, 16)] and hits[1] == [] and hits[2] == []


def test_quality_held_out(real):
    docs, labels = real
    out = common.held_out("doc_id", 5, 0)
    model = knn_quality.fit_from_tables(docs, labels, ~out)
    scored = knn_quality.score_quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).withColumn("held_out", out)
    n = held_out_counts(scored, labels, "quality", 0.3)
    assert n.get((1, 0), 0) < 0.02 * n[1, 1] and n[0, 0] > 0.85 * (n[0, 0] + n.get((0, 1), 0))


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["Ab", "cd!!", "12", "x$$$", "|"], 30)) for _ in range(60)]
    model = knn_quality.fit(texts, rng.integers(0, 2, 60).tolist())
    x = knn_quality.counts(texts, knn_quality.Terms())
    z = model.embed(x)
    want = []
    for v in z:
        cosine = model.vectors @ v
        near = np.argsort(-cosine, kind="stable")[:knn_quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0.0) ** 8
        want.append((float(w @ model.labels[near]) + model.prior) / (w.sum() + 1))
    assert np.allclose(model.scores(x, block=7), want, atol=1e-3)


def test_classifiers_odd_rows(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for fit, score in ((crf_toxicity.fit_from_tables, crf_toxicity.score_toxicity), (knn_quality.fit_from_tables, knn_quality.score_quality)):
        model = fit(odd, none, F.lit(True))
        got = score(odd, model).collect()
        assert len(got) == len(ROWS) + 4 and all(0 <= r.score <= 1 for r in got)
        assert score(empty, model).count() == 0


# --- 8: packing --------------------------------------------------------------------

def check_packing(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(odd, empty, wanted):
    items = packing.pieces(odd, VOCABULARY)
    got = packing.pack(items, per_task=4).collect()
    assert len(got) == items.count() and check_packing(got, 2048) >= -(-sum(r.length for r in got) // 2048)
    for d, (ids, _) in wanted.items():
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d})
        ids = [*ids, 0]
        assert mine == [(k, a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes()))
                        for k, a in enumerate(range(0, len(ids), 2048))]
    assert packing.pack(packing.pieces(empty, VOCABULARY)).count() == 0


def test_bounds_hold_and_best_fit_fits():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = rng.integers(1, 2049, rng.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(lengths)
        assert packing.lower_bound(lengths) <= bins.max() + 1
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 2048 and ((offsets + lengths) <= 2048).all()
    assert packing.lower_bound(np.array([1025] * 7)) == 7 and packing.lower_bound(np.array([])) == 0


def test_good_and_bad_texts_that_differ_by_words_only():
    """Same shapes, lengths and signs: only the vocabulary tells them apart."""
    rng = random.Random(6)
    good, bad = [f"word{c}" for c in "abcdefghijkl"], [f"junk{c}" for c in "abcdefghijkl"]
    shared = ["with", "from", "that", "this"]
    def text(own):
        return " ".join(rng.choice(own) if rng.random() < 0.4 else rng.choice(shared) for _ in range(60))
    texts = [text(bad if i % 3 == 0 else good) for i in range(300)]
    y = [0 if i % 3 == 0 else 1 for i in range(300)]
    model = knn_quality.fit(texts, y)
    fresh = [text(bad) for _ in range(40)] + [text(good) for _ in range(40)]
    p = model.scores(knn_quality.counts(fresh, knn_quality.Terms())) >= knn_quality.THRESHOLD
    assert p[40:].all() and (~p[:40]).sum() >= 38


def test_transitions_are_fitted_and_carry_a_span():
    """Toxic words come in runs of three, clean words of like form alone: what a field
    learns about staying lets a doubtful word between toxic ones pass as toxic."""
    rng = random.Random(8)
    plain = [f"plain{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    def words(n):
        return rng.choices(plain, k=n)
    toxic = [" ".join([*words(20), *rng.choices([f"vile{c}" for c in "abcde"], k=3), *words(20)]) for _ in range(120)]
    clean = [" ".join(words(43)) for _ in range(400)]
    model = crf_toxicity.fit(toxic + clean, [1] * 120 + [0] * 400)
    assert model.stay > 1 and model.stay > model.enter + 1
    def between(before, after):
        p = crf_toxicity.marginals(np.array([model.emission(w) for w in (*before, "doubtful", *after)]), np.array([0, len(before) + 1 + len(after)]), model)
        return p[len(before)]
    alone, inside = between(["plainak"] * 3, ["plainbk"] * 3), between(["vilea", "vileb"], ["vilec", "viled"])
    assert alone < 0.5 < 0.8 < inside


def test_sample_is_of_rows_that_the_table_holds(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "long " * (3000 if i % 4 == 0 else 1)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)] + [(i, 1) for i in range(10_000, 30_000)], "doc_id long, toxic int")
    texts, y = crf_toxicity.training_sample(docs, labels, "toxic", F.lit(True), {1: 150, 0: 120}, 10_000_000)
    assert sum(y) == 150 and len(y) == 270 and sum(len(t) > 6000 for t in texts) > 50
    few, _ = crf_toxicity.training_sample(docs, labels, "toxic", F.lit(True), {1: 150}, 50_000)
    assert 1 <= len(few) < 150 and sum(map(len, few)) <= 50_000
    with pytest.warns(UserWarning, match="no labelled rows"):
        crf_toxicity.training_sample(docs, labels.where("toxic = 0"), "toxic", F.lit(True), {1: 150, 0: 120}, 10_000_000)


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from samplequote.llm import common, crf_toxicity, knn_quality
rng = np.random.default_rng(1)
words = np.array(["word%d" % i for i in range(5000)])
rows, chars = int(sys.argv[2]), int(sys.argv[3])
texts = pa.array([" ".join(rng.choice(words, chars // 8)) for _ in range(rows)])
batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), texts], names=["doc_id", "text"])
if sys.argv[1] == "toxicity":
    memo = crf_toxicity.Emissions(crf_toxicity.Field(stay=1.0))
    made, limit = lambda t: [pa.array(crf_toxicity.tag_batch(t, memo, False)[0])], crf_toxicity.PART_CHARS
else:
    model, terms = knn_quality.fit(texts.to_pylist()[:20] * 3, [0, 1, 1] * (20 if rows > 1 else 1)), knn_quality.Terms()
    made, limit = lambda t: [pa.array(model.scores(knn_quality.counts(t, terms)))], knn_quality.PART_CHARS
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in common.in_parts([batch], 1, [0], ["doc_id", "score"], made, limit))
assert n == rows
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("kind, rows, chars, most", [("toxicity", 10_000, 2500, 150), ("toxicity", 1, 20_000_000, 900), ("quality", 10_000, 2500, 150), ("quality", 1, 20_000_000, 900)])
def test_memory_of_a_batch_is_that_of_a_part(kind, rows, chars, most):
    done = subprocess.run([sys.executable, "-c", MEMORY, kind, str(rows), str(chars)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < most, done.stdout
