"""The Merkle manifest, mixture packing and hard negatives against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from conftest import SF_SMALL
from samplequote.llm import common, hard_negatives, merkle, mixture_packing
from samplequote.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TABLE = "doc_id long, source string, lang string, n_chars long, text string, leaf string, digest string, rank long, tree string, part long"


@pytest.fixture(scope="module")
def table(spark):
    """Documents of several sources: hot, single, null; nulls, empty and long texts,
    repeated rows and ids, and columns named as the operators' own."""
    common.ship(spark)
    rng = random.Random(3)
    words = "the fox jumps Over a lazy dog while Zebras watch from hills".split()
    rows = [(i, "hot", "en", 5, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(70)]
    rows += [(100 + i, f"s{i % 4}", None, i, f"Text {i} of a source") for i in range(23)]
    rows += [(200, "one", "de", None, "LONG word " * 6000), (201, None, "en", 0, None), (202, None, "en", 0, ""), (203, "été", "fr", 3, "Été A"),
             (5, "hot", "en", 5, "another text of the same id"), (None, "hot", "en", 1, "No id"), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[-1]]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "a", "b", 1, "c", 2) for r in rows], TABLE).repartition(3)


# --- 11: Merkle manifest -------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan_out):
    """root and, for each leaf, its (left, right) siblings level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, n in enumerate(at):
            first = n // fan_out * fan_out
            run = nodes[first:first + fan_out]
            steps[i].append(("".join(run[:n - first]), "".join(run[n - first + 1:])))
            at[i] = n // fan_out
        nodes = [h("".join(nodes[i:i + fan_out])) for i in range(0, len(nodes), fan_out)]
    return nodes[0], steps


def brute_manifest(rows, fan_out):
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by_source[s]], fan_out)
    root, tops = tree([trees[s][0] for s in order], fan_out)
    out = []
    for s, top in zip(order, tops):
        for r, steps in zip(by_source[s], trees[s][1]):
            steps = steps + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4]
            if tampered and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of((*r[:4], text))
            for left, right in steps:
                folded = h(left + folded + right)
            out.append((r[0], leaf_of(r), trees[s][0], root, h("".join(x + y for x, y in steps)), folded, folded == root))
    return collections.Counter(out)


def manifest_rows(df, fan_out):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    m = merkle.manifest(df, changed=(tampered, "text", F.translate(F.col("text"), merkle._UPPER, merkle._LOWER)), fan_out=fan_out)
    m = m.withColumn("folded", merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("steps")))
    rows = m.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")), "folded", F.col("folded") == F.col("root")).collect()
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("fan_out", [16, 2, 3])
def test_manifest_is_that_of_a_plain_tree(table, fan_out):
    rows, df = table
    want = brute_manifest(rows, fan_out)
    assert manifest_rows(df, fan_out) == want
    assert {True, False} == {r[-1] for r in want}


def test_manifest_of_few_rows(table):
    rows, df = table
    assert manifest_rows(df.where("false"), 16) == collections.Counter()
    alone = manifest_rows(df.where("doc_id = 200"), 16)
    (row,) = alone
    assert row[1] == row[2] == row[3] and row[4] == h("")
    one_source = [r for r in rows if r[1] == "hot"]
    assert manifest_rows(df.where("source = 'hot'"), 16) == brute_manifest(one_source, 16)


def test_intervals_nest(table):
    _, df = table
    rows = common.stored(df.select(common.ordered_key(F.col("source")).alias("tree"), "doc_id", merkle.field(F.col("text")).alias("digest"))
                         .withColumn("row", F.monotonically_increasing_id()), "test-leaves")
    levels = merkle.build(common.ranked(rows, "tree", ["doc_id", "digest", "row"], "test-ranked"), 4)
    assert len(levels) == 5  # 76 leaves of one source
    for below, above in zip(levels, levels[1:]):
        for r in above.collect():
            assert [c.lo for c in r.children][0] == r.lo and [c.hi for c in r.children][-1] == r.hi and len(r.children) <= 4
            assert all(a.hi == b.lo for a, b in zip(r.children, r.children[1:]))
        assert above.count() < below.count()


# --- 12: mixture packing -------------------------------------------------------------

def packed(df, **more):
    return mixture_packing.pack_mixture(df, VOCABULARY, **more).collect()


def check_pieces(pieces, rows, capacity=2048):
    """Every id of every document once, in sequences without holes or padding."""
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append([*library.encode(r[4] or "", add_special_tokens=False).ids, 1])
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        assert any(p.doc_tokens == len(x) and zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
    lengths = []
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        lengths.append(sum(n for _, n in places))
    assert all(n == capacity or (n < capacity and n & (n - 1) == 0) for n in lengths)
    assert sum(lengths) == sum(len(x) for xs in ids.values() for x in xs)
    by_doc = collections.Counter()
    for p in pieces:
        by_doc[p.doc_id, p.start, p.length] += 1
    for doc, xs in ids.items():
        whole = collections.Counter(i for (d, a, n), c in by_doc.items() if d == doc for i in range(a, a + n) for _ in range(c))
        assert whole == collections.Counter(i for x in xs for i in range(len(x)))


@pytest.mark.parametrize("more", [{}, {"part_ids": 700}, {"weights": {"hot": 1, "one": 5}, "part_ids": 1500}, {"queues": 2, "part_ids": 3000}, {"least": 1}])
def test_every_id_lies_in_one_piece(table, more):
    rows, df = table
    check_pieces(packed(df, **more), rows)


def test_windows_keep_the_mixture(table):
    _, df = table
    pieces = packed(df, part_ids=2048 * 2)
    total, by_window = collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        total[p.source] += p.length
        by_window[p.sequence_id][p.source] += p.length
    n = sum(total.values())
    seen = collections.Counter()
    for w in sorted(by_window)[:n // 2048]:
        seen += by_window[w]
        for s, t in total.items():
            # no window strays by more than the least slice and the ids left over by rounding
            assert abs(seen[s] - (w + 1) * 2048 * t / n) <= 2 * mixture_packing.LEAST + len(total)


def test_empty_table(table):
    assert packed(table[1].where("false")) == []


def test_mixture_states():
    rng = random.Random(5)
    for weighted in (False, True):
        totals = [rng.randint(1, 5000) for _ in range(7)] + [10 ** 15, 1]
        weights = [rng.randint(1, 9) for _ in totals] if weighted else None
        m = mixture_packing.Mixture([str(i) for i in range(9)], totals, weights, 10 ** 12)
        for q in range(9):
            served = [m.served(q, b) for b in range(m.parts + 1)]
            assert served[0] == 0 and served[-1] == totals[q] and served == sorted(served)
            for at in {0, totals[q] - 1, *(rng.randrange(totals[q]) for _ in range(50))}:
                b = m.part_of(q, at)
                assert served[b] <= at < served[b + 1]


def test_round_robin_serves_all_and_carries_deficits():
    rng = np.random.default_rng(2)
    for _ in range(50):
        queues = rng.integers(0, 3000, rng.integers(1, 40))
        queues[0] += 1
        rooms = [r for _, _, r in mixture_packing.windows(100, 100 + int(queues.sum()), 100 + int(queues.sum()))]
        takes = np.array(list(mixture_packing.deficit_round_robin(queues, np.maximum(queues, 1), np.zeros(len(queues)), rooms)))
        assert (takes >= 0).all() and takes.sum(axis=1).tolist() == rooms and takes.sum(axis=0).tolist() == queues.tolist()


# --- 13: hard negatives --------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, block long, rank long, grp long, values string"


def vector_rows(n, seed, dims=8, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        v = middles[i % labels] + 0.4 * rng.normal(size=dims)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, labels)) if i % 5 == 0 else i % labels))
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (n + 2, [None] * dims, 1), (n + 3, [float("nan")] * dims, 1), (n + 4, [float("inf")] * dims, 2),
             (None, rows[0][1], 1), (n + 5, [], 1), (n + 6, [0.5], 0), rows[40], rows[7]]
    return rows


def brute_negatives(rows, every):
    kept = []
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for a, (i, y, v) in enumerate(kept):
        if i % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, z, w) in enumerate(kept) if b != a)
        for s, j, _ in [o for o in others if o[2] == y][:5]:
            hard = [o for o in others if o[2] != y and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, o[1], -s, -o[0]) for k, o in enumerate(hard)]
    return collections.Counter(out)


def mined(spark, rows, every=20):
    df = spark.createDataFrame([(i, v, y, 1, 2, 3, "x") for i, v, y in rows], VECTORS).repartition(3)
    return collections.Counter(map(tuple, hard_negatives.mine(hard_negatives.prepared(df), every).collect()))


def test_negatives_are_those_of_brute_force(spark, monkeypatch):
    rows = vector_rows(300, 1)
    want = brute_negatives(rows, 20)
    assert len(want) > 50 and mined(spark, rows) == want
    # many blocks, groups and chunks; ties and equal vectors
    for name, value in (("BLOCK", 8), ("GROUP_BLOCKS", 4), ("CHUNK_RANKS", 64), ("ZONES", 6)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows += [(1000 + i, rows[3][1], 1) for i in range(30)] + [(2000 + i, rows[3][1], 2) for i in range(30)]
    assert mined(spark, rows) == brute_negatives(rows, 20)


def test_negatives_of_odd_tables(spark):
    assert mined(spark, []) == collections.Counter()
    assert mined(spark, [(100, [1.0, 0.0], 1)]) == collections.Counter()
    huge = [(i, [1e30 * (i % 3), 1e20, -3.0], i % 2) for i in range(0, 40, 2)] + [(i, [1e25, float(i), 2.0], 1) for i in range(1, 40, 2)]
    assert sum(mined(spark, huge).values()) >= 0  # beyond 64 bits: no crash


def test_bounds_hold_and_leave_blocks_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, low = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (9, 6))
    high = low + rng.integers(0, 100, (9, 6))
    least, most = hard_negatives.score_bounds(a, low, high)
    for b in range(9):
        inside = rng.integers(low[b], high[b] + 1, (200, 6))
        s = a @ inside.T
        assert (least[:, b][:, None] <= s).all() and (s <= most[:, b][:, None]).all()
    for name, value in (("BLOCK", 16), ("GROUP_BLOCKS", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    middles = np.random.default_rng(7).normal(size=(12, 4))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 12] + 0.02 * rng.normal(size=4)], i % 3) for i in range(600)]
    df = spark.createDataFrame([(i, v, y, 1, 2, 3, "x") for i, v, y in rows], VECTORS)
    blocks = hard_negatives.candidate_blocks(hard_negatives.prepared(df))
    zones = hard_negatives.zone_maps(blocks)
    last = blocks.agg(F.max("block")).first()[0]
    anchors = blocks.where("vec_id % 20 = 0").withColumn("chunk", F.lit(0).cast("long")).join(hard_negatives.thresholds(blocks, 5, 20), "rank")
    reads = hard_negatives.chosen_blocks(anchors, zones, last, 1, True)
    read = reads.agg(F.sum(F.size("blocks"))).first()[0]
    assert read < 0.5 * anchors.count() * zones.count()


def test_curve_neighbours_touch():
    """The curve over a whole grid visits each cell once, one step at a time."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(grid, bits)
        assert len(set(keys)) == len(grid)
        path = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["op12_mixture_packing"])
def test_query_on_the_smallest_tables(spark, name):
    docs = common.documents(spark, SF_SMALL).select("doc_id", "source", "lang", "n_chars", "text").collect()
    check_pieces(QUERIES[name](spark, SF_SMALL).collect(), [tuple(r) for r in docs])
