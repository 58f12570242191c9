"""Operator 12: packing that keeps a mixture, by deficit round-robin.

Every source is a queue of the ids of its documents. The windows of all sequences
stand in one row of ids; a window takes from each queue what the target
proportions (by default the queues' shares of all ids) give it, and what a queue
is owed or has had too much of is its deficit in the next window. The row is cut
into parts of ``PART_WINDOWS`` windows. How much of each queue has been served
before a part follows from the proportions alone (``Mixture.served``: whole ids,
the fraction is the deficit that the part begins with), so parts are filled in
tasks of their own, deficits carry over between them, and a window across two
parts is filled by both. A queue that ends leaves its share to the others in
proportion. Queues owed less than ``LEAST`` ids wait, so that many small
sources do not shred every window.

Texts become ids once, in tasks, and are stored with their place in the task's
queues (two bytes an id where the vocabulary allows it); a small table of the
tasks' sums turns that into places in the whole queues. Each document is cut at
the parts' borders and its ids move once, to their part. A part holds as many ids
as its windows, whatever their sources, so a source with a third of all ids is
spread as evenly as the rest.

Windows are full but for the last, whose ids are dealt over sequences of powers of
two, which are not padded: no sequence has padding. Null texts are empty (the closing
id alone). A null source is a queue of its own. Repeated rows are documents of their
own. Tables of more than ``MAX_QUEUES`` sources deal them over that many queues by a
hash, which bounds what is broadcast; no row is left out. An empty table gives no
pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import documents, ordered_key, stored, text_of

CAPACITY = 2048
#: Windows of one part: what a task holds at once (one or two MB of ids).
PART_WINDOWS = 256
#: Least ids that a queue gives to a window, unless it or the window ends.
LEAST = 64
MAX_QUEUES = 10_000
_OUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


class Mixture:
    """How far each queue is served after a number of parts. ``totals`` are the ids
    of each queue, ``weights`` whole numbers in the target proportions."""

    def __init__(self, names: list[str], totals: list[int], weights: list[int] | None = None, part_ids: int = PART_WINDOWS * CAPACITY):
        self.names, self.totals = names, totals
        self.weights = [max(1, w) for w in (weights or totals)]
        self.total = sum(totals)
        self.parts = max(1, self.total // part_ids)
        # queues by when they end; before the k-th end, `ended` ids are of queues that
        # have ended and `weight` is that of the others
        self.order = sorted(range(len(names)), key=lambda q: totals[q] / self.weights[q])
        self.place = {q: k for k, q in enumerate(self.order)}
        self.phases = [(0, sum(self.weights))]
        for q in self.order:
            ended, weight = self.phases[-1]
            self.phases.append((ended + totals[q], weight - self.weights[q]))
        self.ends = [ended + weight * totals[q] / self.weights[q] for q, (ended, weight) in zip(self.order, self.phases)]
        self.state = lru_cache(maxsize=4096)(self._state)

    def __reduce__(self):
        return _mixture, (self.names, self.totals, self.weights, self.parts)

    def _state(self, part: int) -> tuple[int, int, int]:
        """Ids that running queues share at a part's begin, their weight, and how many queues have ended."""
        at = self.total * part // self.parts
        k = min(bisect_right(self.ends, at), len(self.order) - 1)
        while k and not self._ended(k - 1, at):
            k -= 1
        while k < len(self.order) and self._ended(k, at):
            k += 1
        ended, weight = self.phases[k]
        return at - ended, weight, k

    def _ended(self, k: int, at: int) -> bool:
        ended, weight = self.phases[k]
        q = self.order[k]
        return (at - ended) * self.weights[q] >= weight * self.totals[q]

    def served(self, queue: int, part: int) -> int:
        """Ids of a queue before a part."""
        shared, weight, ended = self.state(part)
        return self.totals[queue] if self.place[queue] < ended else self.weights[queue] * shared // weight

    def deficit(self, queue: int, part: int) -> float:
        """The fraction of an id that a queue is owed where a part begins."""
        shared, weight, ended = self.state(part)
        return 0.0 if self.place[queue] < ended else self.weights[queue] * shared % weight / weight

    def part_of(self, queue: int, at: int) -> int:
        """The part that serves id number ``at`` of a queue."""
        level = at / self.weights[queue]
        low, high = 0, self.parts
        guess = 0
        for k, (ended, weight) in enumerate(self.phases[:-1]):
            q = self.order[k]
            if level * self.weights[q] <= self.totals[q]:
                guess = int((ended + weight * level) * self.parts / self.total)
                break
        # the guess is right up to rounding: widen around it, then halve
        step = 1
        low = max(0, min(guess, self.parts - 1))
        while low and self.served(queue, low) > at:
            low, step = max(0, low - step), 2 * step
        step, high = 1, low + 1
        while high < self.parts and self.served(queue, high) <= at:
            low, high, step = high, min(self.parts, high + step), 2 * step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.served(queue, middle) <= at else (low, middle)
        return low

    def begin(self, part: int) -> int:
        """Ids of all queues before a part."""
        return sum(self.served(q, part) for q in range(len(self.names)))


def _mixture(names, totals, weights, parts):
    m = Mixture(names, totals, weights)
    m.parts = parts
    return m


def windows(begin: int, end: int, total: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(sequence, offset, ids) of the windows between two places in the row of all ids.
    The last, unfilled window is made of sequences of powers of two."""
    full, rest = divmod(total, capacity)
    out, at = [], begin
    while at < min(end, full * capacity):
        n = min(capacity - at % capacity, end - at)
        out.append((at // capacity, at % capacity, n))
        at += n
    sequence, first = full, full * capacity
    for bit in reversed(range(rest.bit_length())):
        size = 1 << bit
        if rest & size:
            low, high = max(at, first), min(end, first + size)
            if low < high:
                out.append((sequence, low - first, high - low))
                at = high
            sequence, first = sequence + 1, first + size
    return out


def deficit_round_robin(queues, weights, deficits, rooms, least: int = LEAST):
    """Ids that each window of ``rooms`` takes from each queue, all of ``queues`` in the end."""
    left, owed = np.array(queues, dtype=np.int64), np.array(deficits, dtype=float)
    weights = np.array([float(w) for w in weights])
    turn, n = 0, len(left)
    for room in rooms:
        running = left > 0
        share = np.where(running, weights, 0.0)
        owed = owed + room * share / share.sum()
        take = np.where(running & (owed >= np.minimum(least, left)), np.minimum(np.floor(owed), left), 0).astype(np.int64)
        if take.sum() > room:
            order = (np.arange(n) + turn) % n
            asked = take[order]
            take[order] = np.clip(room - (np.cumsum(asked) - asked), 0, asked)
        rest = room - int(take.sum())
        while rest:
            j = int(np.argmax(np.where(left > take, owed - take, -np.inf)))
            more = min(rest, int(left[j] - take[j]), max(least, 1))
            take[j] += more
            rest -= more
        left -= take
        owed = np.where(left > 0, owed - take, 0.0)
        turn = (turn + 1) % n
        yield take


def fill_part(part: int, mix: Mixture, queue, place, doc, start, doc_tokens, ids: list[bytes], width: int, least: int = LEAST) -> dict:
    """The pieces of one part: ``queue``, ``place`` (in the queue), ``doc``, ``start`` and
    ``doc_tokens`` are those of document stretches with ``ids``, ``width`` bytes each."""
    order = np.lexsort((place, queue))
    lengths = np.array([len(x) // width for x in ids], dtype=np.int64)[order]
    at = np.concatenate(([0], np.cumsum(lengths)))
    names = range(len(mix.names))
    before = [mix.served(q, part) for q in names]
    have = [mix.served(q, part + 1) - b for q, b in zip(names, before)]
    begin = sum(before)
    if int(at[-1]) != sum(have):
        raise RuntimeError(f"part {part} holds {at[-1]} ids, not {sum(have)}")
    live = [q for q in names if have[q]]
    rooms = windows(begin, begin + int(at[-1]), mix.total, CAPACITY)
    takes = np.array(list(deficit_round_robin([have[q] for q in live], [mix.weights[q] for q in live],
                                              [mix.deficit(q, part) for q in live], [r[2] for r in rooms], least)))
    inside = np.cumsum(takes, axis=1) - takes
    sizes, window = takes.T.ravel(), np.tile(np.arange(len(rooms)), len(live))
    offsets = (inside + np.array([r[1] for r in rooms])[:, None]).T.ravel()
    some = sizes > 0
    sizes, window, offsets = sizes[some], window[some], offsets[some]
    slices = np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.union1d(at, slices)
    piece, length = cuts[:-1], np.diff(cuts)
    d = np.searchsorted(at, piece, side="right") - 1
    s = np.searchsorted(slices, piece, side="right") - 1
    wide = np.frombuffer(b"".join([ids[i] for i in order]), f"<u{width}").astype("<u4").tobytes()
    view = memoryview(wide)
    crcs = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(piece.tolist(), cuts[1:].tolist())]
    row = order[d]
    sequence = np.array([r[0] for r in rooms], dtype=np.int64)[window[s]]
    return {"doc_id": row, "start": np.asarray(start)[row] + piece - at[d], "length": length, "ids_crc32": np.array(crcs, dtype=np.int64),
            "doc_tokens": np.asarray(doc_tokens)[row], "sequence_id": sequence, "offset": offsets[s] + piece - slices[s],
            "queue": np.asarray(queue)[row]}


def encoded(docs: DataFrame, vocabulary: str, end_id: int, width: int, id_col: str, text_col: str, source_col: str, queues: int) -> DataFrame:
    """doc_id, queue, task, before (ids of the queue earlier in the task), n, ids of each row."""
    source = ordered_key(F.col(source_col))
    if docs.select(source.alias("s")).distinct().count() > queues:
        source = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(queues)).cast("string"))

    def run(batches):
        enc = bpe.encoder(vocabulary, False)
        task, before = TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                names, sums, sizes, made = part.column(1).to_pylist(), [], [], []
                for name, text in zip(names, part.column(2).to_pylist()):
                    ids = np.frombuffer(enc.encode(text) + end, "<u4").astype(f"<u{width}")
                    sums.append(before[name])
                    sizes.append(len(ids))
                    before[name] += len(ids)
                    made.append(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([task] * len(names), pa.int32()), pa.array(sums, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "queue", "task", "before", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("queue"), text_of(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, queue string, task int, before long, n long, ids binary"), "mixture-ids")


def pack_mixture(docs: DataFrame, vocabulary: str, weights: dict[str, int] | None = None, end_id: int = 1, least: int = LEAST,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", queues: int = MAX_QUEUES,
                 part_ids: int = PART_WINDOWS * CAPACITY) -> DataFrame:
    """The pieces of all documents with their places. ``weights`` are target proportions
    in whole numbers by source (others: 1); None keeps the corpus's own."""
    spark = docs.sparkSession
    width = 2 if max(len(bpe.encoder(vocabulary, False).merger.strings), end_id) <= 1 << 16 else 4
    rows = encoded(docs, vocabulary, end_id, width, id_col, text_col, source_col, queues)
    sums = stored(rows.groupBy("queue", "task").agg(F.sum("n").alias("n")), "mixture-sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()  # at most a row for each queue
    names = [r.queue for r in totals]
    given = [int(weights.get(name[1:], 1)) for name in names] if weights is not None else None
    mix = Mixture(names, [r.n for r in totals], given, part_ids)
    shared = spark.sparkContext.broadcast(mix)
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("task")) - F.col("n")
    starts = stored(sums.select("queue", "task", earlier.alias("first")), "mixture-starts")
    placed = rows.join(starts, ["queue", "task"]).select("doc_id", "queue", (F.col("first") + F.col("before")).alias("place"), "n", "ids")

    def cut(batches):
        m = shared.value
        number = {name: q for q, name in enumerate(m.names)}
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, name, place, n, ids in zip(*(b.column(i).to_pylist() for i in range(5))):
                q, at = number[name], place
                while at < place + n:
                    part = m.part_of(q, at)
                    end = min(place + n, m.served(q, part + 1))
                    for column, value in zip(out, (part, q, at, doc, at - place, n, ids[width * (at - place):width * (end - place)])):
                        column.append(value)
                    at = end
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=_STRETCH)

    def fill(t: pa.Table) -> pa.Table:
        m = shared.value
        if not t.num_rows:
            return pa.table({c: pa.array([], k) for c, k in _KINDS.items()})
        part = t.column("part")[0].as_py()
        queue, place, start, n = (t.column(c).to_numpy() for c in ("queue", "place", "start", "doc_tokens"))
        made = fill_part(part, m, queue, place, None, start, n, t.column("ids").to_pylist(), width, least)
        sources = [None if name == "-" else name[1:] for name in m.names]
        made["source"] = [sources[q] for q in made.pop("queue").tolist()]
        made["doc_id"] = t.column("doc_id").combine_chunks().take(pa.array(made["doc_id"]))
        return pa.table({c: made[c] if c == "doc_id" else pa.array(made[c], k) for c, k in _KINDS.items()})

    stretches = placed.mapInArrow(cut, "part long, queue int, place long, doc_id long, start long, doc_tokens long, ids binary")
    return stretches.groupBy("part").applyInArrow(fill, _OUT)


_STRETCH = ["part", "queue", "place", "doc_id", "start", "doc_tokens", "ids"]
_KINDS = {**{c: pa.int64() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}, "source": pa.string()}


def op12_mixture_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_mixture(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
