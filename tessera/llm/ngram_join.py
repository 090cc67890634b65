"""N-gram Jaccard join of documents, by rare-first prefix filtering.

1. Every document's set of five-word shingles (64-bit hashes) is digested; documents with equal sets are one node. Counts of
   all shingles go to a sketch, sized to the input within bounds, which orders shingles rare-first. (Counts that share a
   cell only spoil the order, never the result: any order that is the same for all sets is right.)
2. Each node sends the rarest shingles of its set, as many as two sets of the wanted similarity must share one of, in
   packed columns to the bucket of the shingle. A bucket keeps shingles of two nodes or more and pairs each node
   with the most central one, by length and positional filter.
3. Pairs are bounded once more by counts of the sets in hash ranges (the suffix filter), and verified on the full sets.
4. Links make components by large-star and small-star rounds. Only shingles whose nodes are in more than one
   component are joined again, between components, by a shuffled join, which Spark splits where a shingle is hot; those
   pairs take the same filters and verification. So no pair inside a found component is looked at again, and no link
   between components is lost.

Defined cases: a null or empty text, and one of white space only, has no shingles and links with nothing; a text of fewer
words than a shingle is one shingle; equal sets are linked; rows of equal doc_id count as documents of their own with one
id; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

WORDS, PERCENT = 5, 75
#: Fewest and most cells of the sketch of shingle counts (a byte each where it is read, four where it is counted), words of
#: text for a cell between those, and the blocks that tasks send it in.
CELLS, MOST_CELLS, CELL_WORDS, BLOCKS = 1 << 20, 1 << 23, 64, 64
#: Steps of a doubling of a count, as cells keep their counts.
STEPS = 8
#: Prefix entries of a bucket, about; a shingle that the sketch counts more often than HOT, beyond what the typical cell
#: holds, is dealt over several buckets.
BUCKET_ENTRIES, HOT = 1_000_000, 500_000
#: Hash ranges of the suffix filter.
RANGES = 32
#: Entries that a task holds before it packs them.
HELD = 600_000
#: Rows of a few numbers each that may be broadcast (tens of MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_LOWER = common.lower_ascii()


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct shingle hashes, sorted, and all of them."""
    data = _LOWER[data]
    starts, ends, first = common.word_spans(data, offsets, common.SOLID_BYTES)
    words = common.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = common.gram_hashes(words, k)
    bounds = first.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = grams[a : b - k + 1] if b - a >= k else common.gram_hashes(words[a:b], b - a) ^ np.uint64(b - a) if b > a else grams[:0]
        yield np.unique(own), own


def node_of(grams: np.ndarray, seed: int) -> tuple[int, int]:
    """128-bit digest of a set as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(grams.tobytes(), seed)
    low, high = h & (2**64 - 1), h >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which a similar set must hold one, whatever the order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The smallest intersection with which sets of these sizes link, as a real number."""
    return (a + b) * percent / (100 + percent)


FIRST = "kind int, doc_id long, row_key long, n long, node long, check long, ranges array<int>, block int, data binary"


def cells_of(size: int) -> int:
    """Cells of the sketch for so many bytes of text."""
    return min(MOST_CELLS, max(CELLS, 1 << max(0, size // 6 // CELL_WORDS - 1).bit_length()))


def digester(k: int, seed: int, size: int):
    """(doc_id, row_key, text) to rows of kind 0, one a document, and of kind 1, the task's share of a sketch of a size."""
    fields = ["kind", "doc_id", "row_key", "n", "node", "check", "ranges", "block", "data"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.uint32)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            data, offsets = common.buffers(batch.column(2))
            for a, b in common.steps(offsets):
                n, node, check, ranges, every = [], [], [], [], []
                for own, everything in sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
                    x, y = node_of(own, seed)
                    n.append(len(own))
                    node.append(x)
                    check.append(y)
                    ranges.append(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=RANGES).astype(np.int32))
                    every.append(everything)
                np.add.at(cells, (np.concatenate(every) & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
                m = b - a
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, RANGES * m + 1, RANGES, dtype=np.int32)), pa.array(np.concatenate(ranges)))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), ids.slice(a, m), keys.slice(a, m), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), lists, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], fields)
        blocks = [zlib.compress(x.tobytes(), 1) for x in cells.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([[1] * BLOCKS, *[[None] * BLOCKS] * 6, list(range(BLOCKS)), blocks], kinds, strict=True)], fields)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sketch summed as they stream by, and then a byte a cell: STEPS times the logarithm of the count."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(data.as_py()), np.uint32).astype(np.uint64)
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.rint(STEPS * np.log2(1.0 + x)).clip(0, 255).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], ["block", "data"])


def sketch(first: DataFrame) -> np.ndarray:
    """Counts of shingles by cell, over all documents, as logarithms: MOST_CELLS bytes on the driver at most."""
    rows = first.where("kind = 1").select("block", "data").repartition(BLOCKS, "block").mapInArrow(common.tidy(_added), "block int, data binary").collect()
    return np.frombuffer(b"".join(bytes(r["data"]) for r in sorted(rows, key=lambda r: r["block"])), np.uint8) if rows else np.zeros(CELLS, np.uint8)


#: Marks an entry whose shingle is dealt over several buckets, beside the number of the shingle's own bucket.
SPREAD = np.uint32(1 << 31)


def pack(gram: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, rank: np.ndarray, home: np.ndarray) -> bytes:
    """Columns of one bucket. 40 bits of the shingle are kept beside its own bucket: a clash only adds a candidate."""
    gram = gram & np.uint64((1 << 40) - 1)
    order = np.argsort(node)
    parts = [(gram & np.uint64(0xFFFFFFFF)).astype(np.uint32), (gram >> np.uint64(32)).astype(np.uint8), node, n.astype(np.uint32), at.astype(np.uint32), rank.astype(np.uint16), home]
    return zlib.compress(len(gram).to_bytes(8, "little") + b"".join(x[order].tobytes() for x in parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    blob = zlib.decompress(blob)
    m, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in (np.uint32, np.uint8, np.int64, np.uint32, np.uint32, np.uint16, np.uint32):
        out.append(np.frombuffer(blob, kind, m, at))
        at += m * out[-1].itemsize
    home = out.pop()
    gram = out[0].astype(np.int64) | out[1].astype(np.int64) << 32 | (home & ~SPREAD).astype(np.int64) << 40
    return [gram, *out[2:], home >= SPREAD]


def prefixes(counts, k: int, percent: int, seed: int, buckets: int, hot: int):
    """(doc_id, text) to packed prefix entries (bucket, data), each set once a task as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, held, size = counts.value, set(), [], 0
        usual = 2.0 ** (float(np.median(cells)) / STEPS) - 1  # of a cell's count, what unrelated shingles make up

        def flush() -> pa.RecordBatch:
            gram, node, n, at, rank, often = (np.concatenate(x) for x in zip(*held, strict=True))
            home = (gram >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            bucket = home.astype(np.int64)
            home = home.astype(np.uint32)
            often = np.exp2(often / STEPS) - 1 - usual
            spread = often > hot
            if spread.any():  # a hot shingle goes to as many buckets as it fills, by the node
                ways = np.ceil(often[spread] / hot).astype(np.int64)
                salt = (common.mix(node[spread].view(np.uint64)) >> np.uint64(1)).astype(np.int64) % ways
                key = common.mix(gram[spread] + salt.astype(np.uint64))
                bucket[spread] = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                home[spread] |= SPREAD
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cut)
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), pa.array([pack(gram[g], node[g], n[g], at[g], rank[g], home[g]) for g in groups], pa.binary())], ["bucket", "data"])

        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            for a, b in common.steps(offsets):
                for own, _ in sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
                    if not len(own):
                        continue
                    node = node_of(own, seed)[0]
                    if node in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    often = cells[(own & np.uint64(len(cells) - 1)).astype(np.int64)]
                    m = prefix_length(len(own), percent)
                    order = np.argsort(often.astype(np.uint64) << np.uint64(56) | own >> np.uint64(8), kind="stable")[:m]
                    central = int(64 / STEPS * float(often.mean()))
                    held.append((own[order], np.full(m, node, np.int64), np.full(m, len(own), np.int64), np.arange(m), np.full(m, central, np.int64), often[order]))
                    size += m
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


SECOND = "kind int, a long, b long, gram long, n int, at int"


def paired(percent: int):
    """Packed buckets to rows of kind 0, candidate pairs (a, b), and of kind 1, the entries of shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(bucket, []).append(unpack(data.as_py()))
        for bucket in list(held):
            gram, node, n, at, rank, spread = (np.concatenate(x) for x in zip(*held.pop(bucket), strict=True))
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            # an entry alone is dropped, unless other buckets may have its shingle too
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False])) | spread[order]]
            order = order[np.lexsort((node[order], -rank[order].astype(np.int64), gram[order]))]
            gram, node, n, at, spread = gram[order], node[order], n[order].astype(np.int64), at[order].astype(np.int64), spread[order]
            fresh = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))[: len(gram)]
            gram, node, n, at, spread = gram[fresh], node[fresh], n[fresh], at[fresh], spread[fresh]
            if not len(gram):
                continue
            head = np.concatenate(([True], gram[1:] != gram[:-1]))
            group = np.cumsum(head) - 1
            shared = (np.bincount(group)[group] > 1) | spread
            gram, node, n, at, head = gram[shared], node[shared], n[shared], at[shared], head[shared]
            if not len(gram):
                continue
            hub = np.maximum.accumulate(np.where(head, np.arange(len(gram)), 0))
            rest = np.minimum(n - at, (n - at)[hub])
            ok = ~head & (100 * np.minimum(n, n[hub]) >= percent * np.maximum(n, n[hub])) & ((100 + percent) * rest >= percent * (n + n[hub]))
            a, b = np.minimum(node, node[hub])[ok], np.maximum(node, node[hub])[ok]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            a, b, m = a[fresh], b[fresh], len(gram)
            none = lambda m, t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b), none(len(a), pa.int64()), none(len(a), pa.int32()), none(len(a), pa.int32())], ["kind", "a", "b", "gram", "n", "at"])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(node), none(m, pa.int64()), pa.array(gram), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], ["kind", "a", "b", "gram", "n", "at"])

    return run


def _full_sets(k: int, seed: int):
    """(doc_id, text) to (node, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            for a, b in common.steps(offsets):
                own = [x for x, _ in sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x, seed)[0] for x in own], pa.int64()), lists], ["node", "grams"])

    return run


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int, seed: int, shared: common.Shared) -> DataFrame:
    """The pairs (a, b) that link. pairs: distinct. Sets are made again from the texts of the nodes that are left, and each
    set travels once for each of its pairs, to the pair."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("ranges").alias(f"ranges_{x}"), F.col("row_key").alias(f"key_{x}"))
    bound = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(bound >= least_overlap(F.col("n_a"), F.col("n_b"), percent))
    near = shared.write(near.select("a", "b", "key_a", "key_b"))
    keys = shared.write(near.select(F.explode(F.array("key_a", "key_b")).alias("row_key")).distinct())
    members = shared.write(near.select("a", "b", F.explode(F.array("a", "b")).alias("node")))
    full = texts.join(small(keys), "row_key", "left_semi").select("row_key", "text").mapInArrow(common.tidy(_full_sets(k, seed)), "node long, grams array<long>")
    dealt = full.join(small(members), "node")
    own = lambda x: F.first(F.when(F.col("node") == F.col(x), F.col("grams")), ignorenulls=True).alias(f"grams_{x}")
    both = dealt.groupBy("a", "b").agg(own("a"), own("b"))
    common_ = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.where(100 * common_ >= percent * (F.size("grams_a") + F.size("grams_b") - common_)).select("a", "b")


def components(edges: DataFrame, shared: common.Shared) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the component's smallest node."""
    rounds = common.Shared(shared.spark)
    now = rounds.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        now = rounds.write(small)
        rounds.drop(keep=1)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark:
            break
        mark = state
    shared.paths += rounds.paths  # the last round, which the result reads
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, hot: int = HOT, bucket_entries: int = BUCKET_ENTRIES, seed: int = 0) -> DataFrame:
    """Rows (doc_id, row_key, n_shingles, component_id, component), one a document; row_key is a hash of id and text.
    component_id is the smallest doc_id of the component, which others may share where ids are null or repeat; component
    is its own smallest node, null without shingles."""
    spark: SparkSession = docs.sparkSession
    shared = common.Shared(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = texts.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    first = shared.write(keyed.mapInArrow(common.tidy(digester(k, seed, cells_of(size))), FIRST), keep=True)
    own = first.where("kind = 0 AND n > 0")
    nodes = shared.write(own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.min("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("most"), F.first("ranges").alias("ranges")))
    facts = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum((F.col("check") != F.col("most")).cast("long")), F.lit(0)).alias("clashes")).first()
    if facts["clashes"]:  # two sets with one 64-bit digest: once in many runs; other digests then
        shared.drop()
        return join(docs, doc_id, text, k, percent, hot, bucket_entries, seed + 1)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(facts["total"] * (100 - percent) / 100 / bucket_entries))
    counts = spark.sparkContext.broadcast(sketch(first))
    packed = texts.mapInArrow(common.tidy(prefixes(counts, k, percent, seed, buckets, hot)), "bucket int, data binary")
    second = shared.write(common.scatter(packed, buckets).mapInArrow(common.tidy(paired(percent)), SECOND))
    pairs = shared.write(second.where("kind = 0").select("a", "b").distinct())
    links = shared.write(verified(pairs, nodes, keyed, k, percent, seed, shared))
    labels = shared.write(components(links, shared))
    # what is left: shingles whose nodes are in more than one component
    entries = second.where("kind = 1").select("gram", F.col("a").alias("node"), "n", "at").join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = entries.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gram")
    rest = shared.write(entries.join(mixed, "gram"))
    x, y = rest.alias("x"), rest.alias("y")
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    crossing = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (left >= least_overlap(F.col("x.n"), F.col("y.n"), percent)))
    crossing = crossing.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = shared.write(verified(crossing, nodes, keyed, k, percent, seed, shared))
    if more.limit(1).count():
        labels = shared.write(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), shared))
    smallest = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = smallest.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = shared.write(smallest.join(ids, "label").select("node", "component_id", F.col("label").alias("component")), keep=True)
    shared.drop()
    counts.unpersist()
    return first.where("kind = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select("doc_id", "row_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns kept, with one of each component: that of the smallest id (of several rows with that
    id, the one of the smallest key). Documents without shingles all stay."""
    shared = common.Shared(docs.sparkSession)
    found = shared.write(join(docs, doc_id, text, **options).where("n_shingles > 0"), keep=True)
    key = "_key"
    while key in docs.columns:
        key += "_"
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_key").alias(key), F.count("*").alias("n"))
    kept = shared.write(kept.select(key, "n"), keep=True)
    most = kept.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    solid = docs.where(has_words).withColumn(key, row_key(doc_id, text)).join(small(kept.select(key)), key, "left_semi")
    if most > 1:  # an id that is there more than once may have equal rows
        solid = solid.dropDuplicates([key])
    return solid.select(*docs.columns).unionByName(docs.where(~has_words))


def brute_force(rows: list[tuple[int, str | None]], k: int = WORDS, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """join() by comparing all pairs, for tests."""
    import re

    def shingles(text: str | None) -> set[tuple[str, ...]]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    own = [shingles(t) for _, t in rows]
    best = [i for i, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            changed |= best[i] != low or best[j] != low
            best[i] = best[j] = low
    return [(i, len(s), b) for (i, _), s, b in zip(rows, own, best, strict=True)]
