"""Operator 5: near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles. Equal sets are
one set from the start. Each set is sketched by minwise tokens, and independent
trees branch the sets by tokens chosen at random: the root of a tree picks one
of the coordinates (a second one in about one tree of five, so that a set goes to
1 / threshold children in expectation), and sets with the same token at that
coordinate meet in a node. Nodes of one set end, small nodes are compared
exhaustively by their sketches; in larger ones every set is compared with the
node's smallest, and if not all are similar to it the node branches again by
tokens chosen from its own hash; what is still large after ``DEPTH`` levels agrees in that
many random tokens and is taken as similar. The sketch comparison is lax, by
more than four standard errors; its links only gather sets into clusters, as
stars (a link fewer than members). Each cluster is then searched on full sets.

Within a cluster the search is breadth first: the sets not yet reached are
compared with one reached set at a time, by exact intersection, until none is
left, so every link between different texts that matters to the components is
confirmed and a cluster of thousands of near copies costs a few passes, not all
pairs. Clusters over ``CLUSTER_ROWS`` sets or ``CLUSTER_CHARS`` characters are
not put into one task: their shingles are stored, and rounds compare blocks of
about ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles, whichever are fewer sets,
with a few chosen sets (those reached but not yet expanded come first), which are
no more than ``BLOCK_SHINGLES`` together or a single set, until each cluster is
one component or all its sets have been expanded. So a task holds two blocks, or
single sets where one is larger than a block.

Recall: a pair at the threshold survives a root with probability 0.85 or more
times; with ``TREES`` trees all miss it with a probability under 1e-6 in small
nodes and about 1e-3 at the deepest level; pairs above the threshold miss less.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.
Texts with fewer words than a shingle are one shingle of all their words; texts
without words (null, empty, white space) have empty sets and are linked with
nothing. Rows with a null id are linked with nothing and stay. Rows repeated
with the same id and set are one document; different sets under one id are linked
each on its own, and each row has the component of its set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, group_bounds, partitions, runs, stored, text_of
from .components import connected_components

COORDINATES, TREES, NODE, DEPTH = 128, 16, 96, 6
CLUSTER_ROWS, CLUSTER_CHARS = 6000, 24 << 20
#: Sets of a large cluster that one task compares, and sets chosen per round.
BLOCK, CHOSEN = 2000, 24
#: Shingles (8 bytes each) of a block, and of the sets chosen per round.
BLOCK_SHINGLES = 2 << 20
_SEED = np.random.default_rng(20240501)
_MUL = _SEED.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash, emptied at ``limit`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        import xxhash
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: Words, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(size, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return np.unique(mixed)


def roots(threshold: float) -> list[tuple[int, int]]:
    """(tree, coordinate) of the first branching: one coordinate for each tree,
    and a second one so often that a set has 1 / threshold children on average."""
    rng = np.random.default_rng(7)
    chosen = [(t, int(rng.integers(COORDINATES))) for t in range(TREES)]
    extra = round(TREES * (1 / threshold - 1))
    return chosen + [(t, int(rng.integers(COORDINATES))) for t in range(extra)]


def minwise(s: np.ndarray, block: int = 4096) -> np.ndarray:
    """The minwise tokens of a non-empty set."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), block):
        x = s[at:at + block, None] * _MUL + _ADD
        best = np.minimum(best, (x ^ (x >> np.uint64(29))).min(axis=0))
    return best


SETS = "doc_id long, n int, key string, sketch binary, nodes array<long>"


def text_digest(text: Column) -> Column:
    """128 bits that tell the texts of one id apart."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def sketches(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, n (set size), key (digest of the set), sketch (a byte for each
    token), nodes (first-level nodes) of (doc_id, text) rows; further columns, of
    strings, are passed on."""
    first = roots(threshold)
    further = docs.columns[2:]
    at = np.array([c for _, c in first])
    salt = np.array([t * 1_000_003 + c for t, c in first], np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        import xxhash
        words = Words()
        for b in batches:
            n, key, sketch, nodes = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words, size)
                n.append(len(s))
                key.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                if len(s):
                    tokens = minwise(s)
                    mixed = _mix(tokens)
                    sketch.append((mixed & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    nodes.append(_mix(mixed[at] + salt).view(np.int64))
                else:
                    sketch.append(b"")
                    nodes.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array(key, pa.string()), pa.array(sketch, pa.binary()),
                 pa.array(nodes, pa.list_(pa.int64())), *b.columns[2:]], names=["doc_id", "n", "key", "sketch", "nodes", *further])
    return docs.mapInArrow(run, ", ".join([SETS, *(f"{c} string" for c in further)]))


# --- branching --------------------------------------------------------------------

def _similar_stars(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: stars of the sets that look similar in each node of (node, rep, n, sketch)."""
    least = threshold - 4.2 * math.sqrt(threshold * (1 - threshold) / COORDINATES)

    def run(batches):
        for t in runs(batches, "node"):
            node, rep, n = (t.column(c).to_numpy() for c in ("node", "rep", "n"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(rep), COORDINATES)
            bounds = group_bounds(node)
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo < 2:
                    continue
                s, r, size = sketch[lo:hi], rep[lo:hi], n[lo:hi]
                left = np.arange(hi - lo)
                while len(left) > 1:  # one similar group after the other
                    group, ahead = [left[0]], [left[0]]
                    left = left[1:]
                    while ahead and len(left):
                        x = ahead.pop()
                        agree = (s[left] == s[x]).mean(axis=1)
                        near = (agree >= least) & (np.minimum(size[left], size[x]) >= threshold * np.maximum(size[left], size[x]))
                        ahead += left[near].tolist()
                        group += left[near].tolist()
                        left = left[~near]
                    if len(group) > 1:
                        members = r[group]
                        top = int(members.min())
                        others = members[members != top]
                        a += others.tolist()
                        b += [top] * len(others)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    near = rows.repartition(F.col("node")).sortWithinPartitions("node")
    return near.select("node", "rep", "n", "sketch").mapInArrow(run, "a long, b long")


def _reach(threshold: float) -> float:
    """How far apart two linked sets' sketch similarities to a third one can lie: Jaccard
    distance is a metric, so by no more than the links' distance, plus 4.2 standard errors."""
    return (1 - threshold) + 4.2 * math.sqrt(2 * threshold * (1 - threshold) / COORDINATES)


def _against_top(rows: DataFrame, threshold: float) -> DataFrame:
    """node, rep, n, sketch, top, agree, near: each set of a node beside the node's smallest one.

    The star goes down to the reach below the threshold, so that a set as similar
    to the top as the threshold asks cannot be linked to one outside the star."""
    least = threshold - _reach(threshold)
    tops = stored(rows.groupBy("node").agg(F.min(F.struct("rep", "n", "sketch")).alias("t")), "tops")
    paired = rows.join(tops, "node").select("node", "rep", "n", "sketch", F.col("t.rep").alias("top"),
                                            F.col("t.n").alias("top_n"), F.col("t.sketch").alias("top_sketch"))

    def run(batches):
        for b in batches:
            own, top = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (3, 6))
            n, m = b.column(2).to_numpy(), b.column(5).to_numpy()
            agree = (own == top).mean(axis=1)
            near = (agree >= least) & (np.minimum(n, m) >= least * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(agree), pa.array(near)],
                                             names=["node", "rep", "n", "sketch", "top", "agree", "near"])
    return paired.mapInArrow(run, "node long, rep long, n int, sketch binary, top long, agree double, near boolean")


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """The next level of (node, rep, n, sketch): child nodes by tokens that the
    node's hash chooses."""
    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(node), COORDINATES)
            for turn in range(2):
                h = _mix(node + np.uint64(turn * 77 + 1))
                at = (h % np.uint64(COORDINATES)).astype(np.int64)
                token = sketch[np.arange(len(node)), at].astype(np.uint64)
                child = _mix(_mix(node) + token * np.uint64(0x9E3779B97F4A7C15) + h).view(np.int64)
                goes = np.ones(len(node), bool) if turn == 0 else (_mix(h) >> np.uint64(11)) / 2.0 ** 53 < 1 / threshold - 1
                keep = pa.array(goes)
                yield pa.RecordBatch.from_arrays([pa.array(child), *(b.column(i) for i in (1, 2, 3))],
                                                 names=["node", "rep", "n", "sketch"]).filter(keep)
    return rows.select("node", "rep", "n", "sketch").mapInArrow(run, "node long, rep long, n int, sketch binary")


def cluster_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that gather similar-looking sets (rep, n, sketch, nodes) into clusters."""
    narrow = sets.select(F.explode("nodes").alias("node"), "rep").distinct()
    sizes = narrow.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    met = stored(narrow.join(sizes, "node"), "nodes")
    body = sets.select("rep", "n", "sketch")
    found = _similar_stars(met.where(F.col("size") <= NODE).join(body, "rep"), threshold)
    large = met.where(F.col("size") > NODE)
    edges = stored(found, "similar")
    rows = stored(large.select("node", "rep").join(body, "rep").select("node", "rep", "n", "sketch"), "large-nodes")
    for depth in range(DEPTH):
        if rows.isEmpty():
            break
        # sets that look like the node's smallest one join its star; a node that is one star needs no branching
        beside = stored(_against_top(rows, threshold), "beside")
        edges = edges.unionByName(beside.where("near and rep <> top").select(F.col("rep").alias("a"), F.col("top").alias("b")))
        # a set of the star can be linked to one outside it only if it is not much closer to the top than
        # that one; the other sets of the star are gathered already
        mixed = stored(beside.where("not near").groupBy("node").agg(F.max("agree").alias("outside")), "mixed")
        open_ = beside.join(mixed, "node").where(~F.col("near") | (F.col("agree") <= F.col("outside") + _reach(threshold)))
        rows = stored(_children(open_, threshold).dropDuplicates(["node", "rep"]), "children")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("top")).where("size > 1")
        grown = stored(rows.join(sizes, "node"), "sized-children")
        edges = edges.unionByName(stored(_similar_stars(grown.where(F.col("size") <= NODE), threshold), "similar"))
        rows = grown.where(F.col("size") > NODE)
        if depth == DEPTH - 1:
            edges = edges.unionByName(rows.where("rep <> top").select(F.col("rep").alias("a"), F.col("top").alias("b")))
    return edges


# --- confirmation on full sets ------------------------------------------------------

def _links(x: np.ndarray, flat: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Whether set ``x`` is linked with each of the sets that ``bounds`` cut out of ``flat``."""
    common = np.add.reduceat(np.isin(flat, x).astype(np.int64), bounds[:-1])
    return 100 * common >= percent * (len(x) + np.diff(bounds) - common)


def search(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """The components of non-empty sets, breadth first; densest sets come first,
    as they reach most of their cluster at once."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    frequency = np.bincount(flat)
    weight = np.add.reduceat(frequency[flat], starts[:-1]) / lengths
    left = np.argsort(-weight, kind="stable")
    mark = np.zeros(len(frequency), np.int64)
    out = []
    while len(left):
        group, ahead = [int(left[0])], [int(left[0])]
        left = left[1:]
        while ahead and len(left):
            ahead.sort(key=lambda i: weight[i])
            i = ahead.pop()
            mine = flat[starts[i]:starts[i + 1]]
            mark[mine] = 1
            # sets of sizes too far apart cannot be linked
            fit = np.minimum(lengths[left], lengths[i]) * 100 >= percent * np.maximum(lengths[left], lengths[i])
            near = np.zeros(len(left), bool)
            if fit.any():
                these = left[fit]
                ends = np.cumsum(lengths[these])
                at = np.arange(ends[-1]) + np.repeat(starts[these] - (ends - lengths[these]), lengths[these])
                common = np.add.reduceat(mark[flat[at]], ends - lengths[these])
                near[fit] = 100 * common >= percent * (lengths[i] + lengths[these] - common)
            mark[mine] = 0
            ahead += left[near].tolist()
            group += left[near].tolist()
            left = left[~near]
        out.append(group)
    return out


def _search_clusters(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: confirmed stars within clusters of (cluster, rep, key, text) that fit a task."""
    def run(batches):
        import xxhash
        words = Words()
        for t in runs(batches, "cluster"):
            bounds = group_bounds(t.column("cluster").to_numpy())
            rep, key, text = t.column("rep").to_pylist(), t.column("key").to_pylist(), t.column("text")
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                sets = [shingles(x, words, size) for x in text.slice(lo, hi - lo).to_pylist()]
                sure = [i for i, s in enumerate(sets) if xxhash.xxh3_128_hexdigest(s.tobytes()) == key[lo + i]]
                if len(sure) < 2:
                    continue
                for group in search([sets[i] for i in sure], percent):
                    members = sorted({rep[lo + sure[i]] for i in group})
                    a += members[1:]
                    b += [members[0]] * (len(members) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    dealt = rows.repartition(F.col("cluster")).sortWithinPartitions("cluster")
    return dealt.select("cluster", "rep", "key", "text").mapInArrow(run, "a long, b long")


def _stored_shingles(rows: DataFrame, size: int) -> DataFrame:
    """cluster, rep, n, shingles (sorted hashes as bytes) of (cluster, rep, key, text),
    without rows of another text under the same id."""
    def run(batches):
        import xxhash
        words = Words()
        for b in batches:
            for at in range(b.num_rows):  # one text at a time, as they can be long
                s = shingles(b.column(3)[at].as_py(), words, size).tobytes()
                if xxhash.xxh3_128_hexdigest(s) == b.column(2)[at].as_py():
                    one = b.slice(at, 1)
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([len(s) // 8], pa.int64()), pa.array([s], pa.binary())],
                                                     names=["cluster", "rep", "n", "shingles"])
    return (rows.select("cluster", "rep", "key", "text").mapInArrow(run, "cluster long, rep long, n long, shingles binary")
            .dropDuplicates(["cluster", "rep"]))


def _in_blocks(sets: DataFrame) -> DataFrame:
    """``sets`` (cluster, rep, n) with their block, blocks (of the cluster) and turns:
    how many of the cluster's sets, whichever they are, fit a block."""
    sized = sets.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.max("n").alias("most"))
    blocks = F.floor(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)) + 1
    turns = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most")))
    return (sets.join(sized.select("cluster", blocks.alias("blocks"), turns.alias("turns")), "cluster")
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))))


def _compare(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """a, b: links between the sets of a block and the chosen ones."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in left.column("shingles")])
        rep = left.column("rep").to_numpy()
        bounds = np.concatenate(([0], np.cumsum(left.column("n").to_numpy())))
        for r, x in zip(right.column("rep").to_pylist(), right.column("shingles")):
            near = rep[_links(np.frombuffer(x.as_buffer(), np.uint64), flat, bounds, percent)]
            near = near[near != r].tolist()
            a += near
            b += [r] * len(near)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _search_large(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: confirmed links within clusters too large for a task, round by round."""
    spark = rows.sparkSession
    state = stored(_in_blocks(stored(_stored_shingles(rows, size), "shingles")), "large")
    done = spark.createDataFrame([], "rep long")
    labels = state.select("cluster", "rep", F.col("rep").alias("root"), "turns")
    edges = None
    chosen_per_round = CHOSEN

    def compare(left, right):
        return _compare(left, right, percent)

    while True:
        # clusters that are one component need no more; of the others the largest components' sets go first
        parts = labels.groupBy("cluster", "root").agg(F.count("*").alias("part"))
        several = parts.groupBy("cluster").agg(F.count("*").alias("parts")).where("parts > 1").select("cluster")
        waiting = (labels.join(several, "cluster", "left_semi").join(done, "rep", "left_anti").join(parts, ["cluster", "root"]))
        # one set for each turn: together they fit a block
        turn = F.pmod(F.xxhash64("rep"), F.least(F.lit(chosen_per_round).cast("long"), F.col("turns")))
        best = F.max(F.struct("part", F.xxhash64("rep", F.lit(1)).alias("h"), "rep"))
        picked = stored(waiting.groupBy("cluster", turn.alias("turn")).agg(best.alias("best")).select("cluster", F.col("best.rep").alias("rep")), "chosen")
        if picked.isEmpty():
            break
        chosen = stored(picked.join(state.select("cluster", "rep", "shingles", "blocks"), ["cluster", "rep"]), "chosen-sets")
        chosen = chosen.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "rep", "shingles")
        # links of expanded sets are known, and so are all of clusters that nothing was chosen from
        left = (state.join(picked.select("cluster").distinct(), "cluster", "left_semi").join(done, "rep", "left_anti")
                .select("cluster", "block", "rep", "n", "shingles"))
        found = stored(left.groupBy("cluster", "block").cogroup(chosen.groupBy("cluster", "block"))
                       .applyInArrow(compare, "a long, b long"), "confirmed")
        edges = found if edges is None else edges.unionByName(found)
        done = stored(done.unionByName(picked.select("rep")), "expanded")
        roots_ = connected_components(edges)
        labels = stored(state.select("cluster", "rep", "turns").join(roots_, F.col("rep") == F.col("vertex"), "left")
                        .select("cluster", "rep", F.coalesce("root", "rep").alias("root"), "turns"), "labels")
        chosen_per_round = min(4 * chosen_per_round, BLOCK)
    return edges if edges is not None else spark.createDataFrame([], "a long, b long")


def _numbered(sets: DataFrame) -> tuple[DataFrame, bool]:
    """``sets`` (key, doc_id, n, sketch, nodes) with rep, a number for each in the order
    of the ids, and whether it differs from them: it is the id unless an id has several sets."""
    if sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets.withColumn("rep", F.col("doc_id")), False
    ordered = sets.repartitionByRange(partitions(sets.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    return stored(ordered.withColumn("rep", F.monotonically_increasing_id()), "numbered-sets"), True


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row: documents are linked
    where 100 * intersection >= ``percent`` * union of their shingle sets. With
    ``digest`` also text_digest, as an id can have several texts."""
    threshold = percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    further = ["text_digest"] if digest else []
    rows = stored(sketches(texts.withColumn("text_digest", text_digest(F.col("text"))) if digest else texts, size, threshold), "sketches")
    linkable = rows.where("n > 0 and doc_id is not null")
    # equal sets are one from here on; a digest tells them apart, so any member's sketch will do
    sets, numbered = _numbered(stored(linkable.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "sketch", "nodes"), "doc_id").alias("s"))
                                      .select("key", "doc_id", "s.*"), "sets"))
    clusters = connected_components(cluster_edges(sets, threshold)).select(F.col("vertex").alias("rep"), F.col("root").alias("cluster"))
    members = stored(sets.select("rep", "key", F.col("doc_id").alias("owner")).join(clusters, "rep"), "clusters")
    # texts are dealt by id at every size: the members grow with the corpus and are no side to broadcast
    body = stored(members.hint("merge").join(texts, members.owner == texts.doc_id).select("cluster", "rep", "key", "text"), "cluster-texts")
    sized = body.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    large = stored(sized.where((F.col("rows") > CLUSTER_ROWS) | (F.col("chars") > CLUSTER_CHARS)).select("cluster"), "large-clusters")
    # clusters that fit a task come back as stars around their smallest id: components already
    final = _search_clusters(body.join(large, "cluster", "left_anti"), size, percent).select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    if not large.isEmpty():
        final = final.unionByName(connected_components(_search_large(body.join(large, "cluster", "left_semi"), size, percent)))
    named = sets.select("key", "rep").join(final, F.col("rep") == F.col("vertex"), "left").select("key", F.coalesce("root", "rep").alias("component_id"))
    if numbered:
        ids = sets.select(F.col("rep").alias("component_id"), "doc_id")
        named = named.join(ids, "component_id").select("key", F.col("doc_id").alias("component_id"))
    joined = linkable.select("doc_id", "n", "key", *further).join(named, "key")
    alone = rows.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", "key", F.col("doc_id").alias("component_id"), *further)
    return (joined.select("doc_id", "n", "key", "component_id", *further).unionByName(alone)
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *further))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)
