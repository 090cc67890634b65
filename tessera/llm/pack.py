"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become token ids with a closing 0; longer ones than a sequence are cut. Whole pieces are sequences already. The
others are dealt by hash to cells of a bounded size; in each cell, islands evolve packings whose genes are bins: a child
takes well-filled bins of one parent, drops the other parent's bins that hold the same pieces, and best-fits the
displaced pieces. Between epochs the best packing of each island moves to the next one. Bins of the best packing that
are not full enough are dissolved, and their pieces go to the next level's cells, until one cell holds them all or most
of them are left over again. A cell never grows with the input.

Defined cases: a null or empty text is the single id 0; equal documents are packed one by one; an empty table gives no
rows; further columns are not read."""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SEQUENCE = 2048
#: Pieces that a cell holds on average; islands of a cell; epochs; children of an island in an epoch.
CELL, ISLANDS, EPOCHS, CHILDREN = 4096, 2, 2, 16
POPULATION = 6
#: A bin that is filled to this share is kept; others go to the next level.
FULL = 0.995
#: Words whose ids a worker remembers.
CACHE_WORDS = 3 << 20
#: Slots of the table that is looked up first.
NEAR = 1 << 21

# --- token ids -------------------------------------------------------------------------------------------------------


#: Byte kinds: 0 ASCII white space, 1 letters and digits of ASCII, 2 ASCII punctuation, 3 what is never split at.
_KIND = np.full(256, 3, np.uint8)
_KIND[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = 0
_KIND[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
_LOWER = common.lower_ascii()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans whose ids are independent of what stands around them, the first span of each row, and the bytes with the
    letters lower-cased where that cannot change the ids. Spans end at ASCII white space and between a letter or digit of
    ASCII or Latin-1 and ASCII punctuation (the apostrophe apart, which begins contractions)."""
    n = len(data)
    kind = _KIND[data]
    low = _LOWER[data]
    lead = data == 0xC3
    odd = None
    if lead.any():  # two-byte letters of Latin-1
        at = np.flatnonzero(lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] >= 0x80))
        kind[at] = kind[at + 1] = 1
        low[at + 1] = np.where(data[at + 1] <= 0x9E, data[at + 1] + 0x20, data[at + 1])
    high = (data >= 0x80) & (kind == 3)
    if high.any():
        odd = np.concatenate(([0], np.cumsum(high)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1]))
    before = np.concatenate(([0], kind[:-1]))
    # a span begins where the kind before it is white space, or where 1 meets 2
    begin = (kind != 0) & (edge[:-1] | (change & ((before == 0) | (before + kind == 3) & (before != 0))))
    starts = np.flatnonzero(begin)
    after = np.concatenate((kind[1:], [0]))
    finish = (kind != 0) & (edge[1:] | (after == 0) | (after != kind) & (after + kind == 3))
    ends = np.flatnonzero(finish) + 1
    if odd is not None:
        raw = odd[ends] > odd[starts]
        if raw.any():
            keep = np.zeros(n + 1, np.int32)
            np.add.at(keep, starts[raw], 1)
            np.add.at(keep, ends[raw], -1)
            low = np.where(np.cumsum(keep[:-1]) > 0, data, low)
    return starts, ends, np.searchsorted(starts, offsets), low


class Encoder:
    """Token ids of texts, each distinct span of words_of() encoded once. This is exact for the vocabulary named by
    `word_bpe_49k`, whose pieces never span those ends."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each Python worker, as long as it serves tasks that encode."""
        if path not in cls._own:
            cls._own[path] = cls(path)
            common.hold("encoder", cls._own.clear)
        return cls._own[path]

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.near, self.near_at = np.zeros(NEAR, np.uint64), np.zeros(NEAR, np.int64)  # by the low bits of a hash
        self.near_count = np.zeros(NEAR, np.int32)

    def learn(self, raw: bytes, starts: list[int], ends: list[int], hashes: np.ndarray) -> None:
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = self.used + np.cumsum(count) - count
        size = self.used + int(count.sum())
        if size > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(size, np.uint32)))
        self.ids[self.used : size] = [i for x in found for i in x]
        self.used = size
        place = np.searchsorted(self.hashes, hashes)  # hashes come sorted
        slot = (hashes & np.uint64(NEAR - 1)).astype(np.int64)
        self.near[slot], self.near_at[slot], self.near_count[slot] = hashes, at, count
        self.hashes, self.at, self.count = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.count, place, count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row closed with 0, and the rows' offsets in them."""
        out, at = self._encode(data, offsets)
        raw = data.tobytes()
        if any(x in raw for x in self.special):  # a row with a special token's string is left to the library
            rows = []
            for i in range(len(offsets) - 1):
                own = raw[offsets[i] : offsets[i + 1]]
                rows.append(np.array([*self.tokenizer.encode(own.decode("utf-8", "replace"), add_special_tokens=False).ids, 0], np.uint32) if any(x in own for x in self.special) else out[at[i] : at[i + 1]])
            out, at = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        return out, at

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(rows, np.uint32), np.arange(rows + 1)
        starts, ends, first, low = words_of(data, offsets)
        if not len(starts):
            return np.zeros(rows, np.uint32), np.arange(rows + 1)
        hashes = common.span_hashes(low, starts, ends)
        slot = (hashes & np.uint64(NEAR - 1)).astype(np.int64)
        far = np.flatnonzero(self.near[slot] != hashes)
        at, count = self.near_at[slot], self.near_count[slot].astype(np.int64)
        if len(far):
            unique, where, inverse = np.unique(hashes[far], return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, unique)
            new = np.ones(len(unique), bool) if not len(self.hashes) else self.hashes[np.minimum(place, len(self.hashes) - 1)] != unique
            if new.any():
                first_at = far[where[new]]
                self.learn(data.tobytes(), starts[first_at].tolist(), ends[first_at].tolist(), unique[new])
                place = np.searchsorted(self.hashes, unique)
            at[far], count[far] = self.at[place][inverse], self.count[place][inverse]
        total = np.concatenate(([0], np.cumsum(count)))
        out_offsets = total[first] + np.arange(rows + 1)
        out = np.zeros(int(total[-1]) + rows, np.uint32)
        filled = np.ones(len(out), bool)
        filled[out_offsets[1:] - 1] = False
        out[filled] = self.ids[np.repeat(at - total[:-1], count) + np.arange(int(total[-1]))]
        return out, out_offsets


PIECES = "task int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cutter(path: str, sequence: int):
    """Arrow batches of (doc_id, text) to pieces; (task, nth) tells all pieces apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, nth = Encoder.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = common.buffers(batch.column(1))
            for a, b in common.steps(offsets):
                tokens, at = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                doc, piece, start, length, crc = [], [], [], [], []
                bounds = at.tolist()
                for i in range(b - a):
                    low, high = bounds[i], bounds[i + 1]
                    for k, x in enumerate(range(low, high, sequence)):
                        y = min(x + sequence, high)
                        doc.append(ids[a + i])
                        piece.append(k)
                        start.append(x - low)
                        length.append(y - x)
                        crc.append(zlib.crc32(tokens[x:y]))
                n = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.arange(nth, nth + n)), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["task", "nth", "doc_id", "piece", "start", "length", "ids_crc32"])
                nth += n

    return run


# --- the genetic algorithm in one cell -------------------------------------------------------------------------------

Bins = list[tuple[int, list[int]]]  # (fill, pieces)


def best_fit(bins: Bins, pieces: list[int], lengths: list[int], capacity: int) -> Bins:
    """Put each piece, in the order given, into the fullest bin that it fits; in place."""
    free: dict[int, list[int]] = {}
    rooms: list[int] = []
    fills = [f for f, _ in bins]
    for i, f in enumerate(fills):
        room = capacity - f
        if room:
            if room not in free:
                free[room] = []
            free[room].append(i)
    rooms = sorted(free)
    for p in pieces:
        need = lengths[p]
        k = bisect_left(rooms, need)
        if k == len(rooms):
            bins.append((0, []))
            fills.append(0)
            i, room = len(fills) - 1, capacity
        else:
            room = rooms[k]
            i = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(k)
        bins[i][1].append(p)
        fills[i] += need
        left = room - need
        if left:
            if left not in free:
                free[left] = []
                insort(rooms, left)
            free[left].append(i)
    return [(f, b) for f, (_, b) in zip(fills, bins, strict=True)]


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((f / capacity) ** 2 for f, _ in bins)


def cross(a: Bins, b: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A child: well-filled bins of `b` whole, the bins of `a` that share no piece with them, the displaced best-fitted."""
    good = [x for x in b if x[0] >= FULL * capacity]
    taken = [good[i] for i in rng.choice(len(good), max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)] if good else []
    inside = set().union(*(x[1] for x in taken)) if taken else set()
    child, displaced = [(f, list(x)) for f, x in taken], []
    for f, x in a:
        if inside.isdisjoint(x):
            # poorly filled bins are opened too, so that their pieces get another chance
            if f < FULL * capacity and rng.random() < 0.5:
                displaced += x
            else:
                child.append((f, list(x)))
        else:
            displaced += [p for p in x if p not in inside]
    displaced.sort(key=lambda p: (-lengths[p] + rng.uniform(0, 0.02 * capacity), p))
    return best_fit(child, displaced, lengths, capacity)


def evolve(lengths: list[int], population: list[Bins], capacity: int, seed: int, children: int) -> list[Bins]:
    """The island's population after an epoch, best first; it stops once the bound by total length is met."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(lengths) // capacity)
    by_length = sorted(range(len(lengths)), key=lambda p: (-lengths[p], p))
    if not population:
        population = [best_fit([], by_length, lengths, capacity)]
    while len(population) < POPULATION and len(population[0]) > bound:
        noisy = [lengths[p] + rng.uniform(0, 0.05 * capacity) for p in range(len(lengths))]
        population.append(best_fit([], sorted(by_length, key=lambda p: -noisy[p]), lengths, capacity))
    population.sort(key=lambda x: fitness(x, capacity), reverse=True)
    for _ in range(children):
        if len(population[0]) <= bound:
            break
        i, j = rng.choice(len(population), 2, replace=False)
        population.append(cross(population[min(i, j)], population[max(i, j)], lengths, capacity, rng))
        population.sort(key=lambda x: fitness(x, capacity), reverse=True)
        del population[POPULATION:]
    return population


def _to_bins(flat: list[int], lengths: list[int]) -> Bins:
    """From the bin number of each piece."""
    groups: dict[int, list[int]] = {}
    for p, b in enumerate(flat):
        groups.setdefault(b, []).append(p)
    return [(sum(lengths[p] for p in x), x) for x in groups.values()]


def _to_flat(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, (_, x) in enumerate(bins):
        for p in x:
            out[p] = b
    return out


ISLAND = "cell long, island int, lengths array<int>, elites array<array<int>>"


def _islands(capacity: int, epoch: int, children: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                own = evolve(lengths, [_to_bins(x, lengths) for x in row["elites"]], capacity, row["cell"] * 8191 + row["island"] * 131 + epoch, children)
                yield pa.RecordBatch.from_arrays([pa.array([row["cell"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([lengths], pa.list_(pa.int32())), pa.array([[_to_flat(x, len(lengths)) for x in own[:2]]], pa.list_(pa.list_(pa.int32())))], ["cell", "island", "lengths", "elites"])

    return run


def _cells(cells: DataFrame, capacity: int, islands: int, epochs: int, children: int, tasks: int) -> DataFrame:
    """(cell, members) with members an array of pieces, to (cell, members, flat): the best packing of any island."""
    state = cells.select("cell", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.transform("members", lambda m: m["length"].cast("int")).alias("lengths"), F.expr("cast(array() as array<array<int>>)").alias("elites"))
    for epoch in range(epochs):
        state = state.repartition(tasks, "cell", "island").mapInArrow(common.tidy(_islands(capacity, epoch, children)), ISLAND)
        if epoch + 1 < epochs:  # each island keeps its best and gets the best of the one before it
            moved = state.select("cell", ((F.col("island") + 1) % islands).alias("island"), F.col("elites")[0].alias("guest"))
            state = state.join(moved, ["cell", "island"]).select("cell", "island", "lengths", F.array_distinct(F.concat("elites", F.array("guest"))).alias("elites"))
    best = state.groupBy("cell").agg(F.min_by(F.col("elites")[0], F.struct(F.array_max(F.col("elites")[0]), "island")).alias("flat"))
    return cells.join(best, "cell")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    shared = common.Shared(spark)
    pieces = shared.write(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(common.tidy(cutter(tokenizer, sequence), "encoder"), PIECES), keep=True)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = pieces.where(F.col("length") == sequence).select(*columns, (-(F.col("task").cast("long") * (1 << 36) + F.col("nth") + 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, level = [whole], 0
    rest = pieces.where(F.col("length") < sequence)
    count = rest.count()
    member = F.struct("task", "nth", *columns)
    while count:
        cells = max(1, math.ceil(count / cell))
        tasks = min(cells * islands, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells * islands / 16)))
        dealt = rest.groupBy(F.pmod(F.xxhash64("task", "nth", F.lit(level)), F.lit(cells)).alias("cell")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        packed = _cells(dealt, sequence, islands, epochs, children, tasks)
        piece = packed.select("cell", F.posexplode("members").alias("at", "m"), "flat").select("cell", F.element_at("flat", F.col("at") + 1).alias("bin"), "m")
        # bins are collected within a cell, whose size is bounded
        bins = piece.groupBy("cell", "bin").agg(F.array_sort(F.collect_list("m")).alias("ms"), F.sum("m.length").alias("fill"))
        bins = shared.write(bins, keep=True)
        poor = bins.where(F.col("fill") < F.lit(FULL * sequence))
        left = poor.agg(F.coalesce(F.sum(F.size("ms")), F.lit(0))).first()[0]
        # where the most part of many cells cannot be packed well, other cells of the same lengths would not do better
        last = cells == 1 or left > 0.5 * count
        kept = bins if last else bins.where(F.col("fill") >= F.lit(FULL * sequence))
        fill = F.aggregate(F.slice("ms", 1, F.col("at")), F.lit(0).cast("long"), lambda n, m: n + m["length"])
        number = F.lit(level).cast("long") * (1 << 56) + F.col("cell") * (1 << 20) + F.col("bin")
        parts.append(kept.select("cell", "bin", "ms", F.posexplode("ms").alias("at", "m")).select(*[F.col(f"m.{c}").alias(c) for c in columns], number.alias("sequence_id"), fill.alias("offset")))
        if last:
            break
        rest, count, level = poor.select(F.explode("ms").alias("m")).select("m.*"), left, level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
