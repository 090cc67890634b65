"""Quality scores by a sparse ensemble of rules.

Statistics of every text are counted on its bytes. Boosted trees of small depth are grown on the labelled rows, each path
from a root is a rule (a conjunction of comparisons), and a lasso logistic regression keeps the rules that matter. The kept
rules are one Spark column over the statistics.

Defined cases: a null or empty text has all statistics 0 and gets a score like any other; rows of equal id are each scored
(with several labels for an id, the largest counts); without labels of both kinds every score is 0.5; an empty table gives
no rows; further columns are kept only by keep_good()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Labelled rows that the rules are learned from, at most: those with the lowest hashes of their ids.
SAMPLE = 8000
TREES, DEPTH, LEAF, SHRINK, CUTS = 40, 3, 25, 0.3, 32
#: Weight of the lasso penalty and its iterations.
PENALTY, ITERATIONS = 0.0015, 400

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_length", "upper", "digit", "space", "mark", "stop", "exclaim", "pipe", "symbol", "high",
    "title_words", "upper_words", "marked_words", "odd_end_words", "short_words", "long_words", "longest_word", "distinct_words", "distinct_lines", "line_words", "longest_line", "short_lines", "colon", "quote", "bracket", "repeat_words",
)

_SETS = {"upper": range(65, 91), "digit": range(48, 58), "space": b" \t\n\r", "mark": b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "stop": b".?", "exclaim": b"!", "pipe": b"|", "symbol": b"#$%&*@^~=+<>", "colon": b":;", "quote": b"\"'", "bracket": b"()[]{}"}
_LUTS = {k: np.isin(np.arange(256), list(v)).astype(np.int32) for k, v in _SETS.items()}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, STATISTICS) of a step of rows; shares are of bytes, words or lines."""
    rows = len(offsets) - 1
    out = {k: np.zeros(rows) for k in STATISTICS}
    if not len(data):
        return np.stack([out[k] for k in STATISTICS], 1)
    size = np.diff(offsets).astype(float)
    over = np.maximum(size, 1)

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[at[1:]] - total[at[:-1]]

    out["n_bytes"] = size
    for k, lut in _LUTS.items():
        out[k] = per_row(lut[data], offsets) / over
    out["high"] = per_row(data >= 128, offsets) / over
    starts, ends, first = common.word_spans(data, offsets, common.SOLID_BYTES)
    words = np.diff(first).astype(float)
    per_word = np.maximum(words, 1)
    length = ends - starts
    caps = np.concatenate(([0], np.cumsum(_LUTS["upper"][data])))
    marks = np.concatenate(([0], np.cumsum(_LUTS["mark"][data])))
    n_caps, n_marks = caps[ends] - caps[starts], marks[ends] - marks[starts]
    last = data[ends - 1] if len(ends) else data[:0]
    out["n_words"], out["word_length"] = words, per_row(length, first) / per_word
    out["title_words"] = per_row((n_caps == 1) & (length > 1), first) / per_word
    out["upper_words"] = per_row((n_caps > 1) & (2 * n_caps > length - n_marks), first) / per_word
    out["marked_words"] = per_row(n_marks > 0, first) / per_word
    out["odd_end_words"] = per_row((_LUTS["mark"][last] == 1) & ~np.isin(last, list(b".,;:?\"')")), first) / per_word
    out["short_words"], out["long_words"] = per_row(length <= 3, first) / per_word, per_row(length >= 12, first) / per_word
    hashes = common.span_hashes(common.lower_ascii()[data], starts, ends)
    breaks = np.flatnonzero(data == 10)
    line_first = np.searchsorted(breaks, offsets)
    bounds, lines_at = first.tolist(), line_first.tolist()
    again = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    out["repeat_words"] = per_row(again, first) / per_word
    for i in range(rows):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            continue
        own = hashes[a:b]
        out["distinct_words"][i] = len(np.unique(own)) / (b - a)
        out["longest_word"][i] = length[a:b].max()
        cut = np.searchsorted(starts[a:b], breaks[lines_at[i] : lines_at[i + 1]])
        edge = np.concatenate(([0], cut, [b - a]))
        count = np.diff(edge)
        full = count > 0
        # a sum of word hashes is enough to tell lines apart here
        plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
        line = (plain[edge[1:]] - plain[edge[:-1]])[full]
        out["n_lines"][i] = full.sum()
        out["distinct_lines"][i] = len(np.unique(line)) / full.sum()
        out["line_words"][i], out["longest_line"][i], out["short_lines"][i] = count[full].mean(), count.max(), (count[full] <= 3).mean()
    return np.stack([out[k] for k in STATISTICS], 1)


def _counted(names: list[str]):
    """Batches whose first column is the text, to the other columns and the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            found = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.steps(offsets)]
            x = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(np.round(c, 6)) for c in x.T]], [*names, *STATISTICS])

    return run


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and the statistics of the text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(common.tidy(_counted(keep)), fields)


# --- learning --------------------------------------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut), all must hold


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Split the rows where that lowers the loss most, note the paths, and add the leaves' steps to `out`."""
    g, h = residual[rows].sum(), weight[rows].sum()
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * LEAF:
        for f in range(x.shape[1]):
            k = len(cuts[f])
            if not k:
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=k + 1))[:k] for w in (residual[rows], weight[rows], np.ones(len(rows))))
            ok = (ns >= LEAF) & (len(rows) - ns >= LEAF)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
    if best[1] < 0:
        out[rows] += SHRINK * g / (h + 1)
        return
    _, f, i = best
    above = binned[rows, f] > i
    for side in (False, True):
        rule = (*path, (f, side, float(cuts[f][i])))
        rules.append(rule)
        grow(x, residual, weight, cuts, binned, rows[above == side], depth - 1, rule, rules, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def learn(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """The bias and the weighted rules."""
    if not len(y) or y.min() == y.max():
        return 0.0, []
    cuts = [np.unique(np.round(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1]), 6)) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)  # bin > i: value > cut i
    rules: list[Rule] = []
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grow(x, y - p, p * (1 - p), cuts, binned, np.arange(len(y)), DEPTH, (), rules, score)
    columns, chosen = {}, []
    for rule in dict.fromkeys(tuple(sorted(r)) for r in rules):
        col = holds(rule, x)
        if 0 < col.sum() < len(y) and (mark := col.tobytes()) not in columns:
            columns[mark] = col
            chosen.append(rule)
    a = np.stack(list(columns.values()), 1).astype(float)
    mean, scale = a.mean(0), np.maximum(a.std(0), 0.02)
    a = (a - mean) / scale
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    u = a[: min(len(a), 2000)]
    step = 3.0 / (np.linalg.norm(u, 2) ** 2 / len(u) + 1e-9)
    for _ in range(ITERATIONS):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-np.clip(a @ v + b, -30, 30))) - y
        new = v - step * (a.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b -= 2.0 * error.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    kept = [(r, float(c / s)) for r, c, s in zip(chosen, w, scale, strict=True) if c]
    return float(b - (w * mean / scale).sum()), kept


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as a column over the statistics."""
    total = F.lit(bias)
    for rule, weight in rules:
        all_hold = None
        for f, above, cut in rule:
            term = F.col(STATISTICS[f]) > cut if above else F.col(STATISTICS[f]) <= cut
            all_hold = term if all_hold is None else all_hold & term
        total = total + F.when(all_hold, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Rules from at most `sample` labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
    rows = stats.where(~held_out(F.col(doc_id))).join(known, F.col(doc_id) == F.col("_id"))
    count = rows.count()
    if count > 2 * sample:  # ids of low hashes: about a fifth more than are needed, so that tasks send few rows to the driver
        rows = rows.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 32)) < int(1.2 * sample / count * (1 << 32)))
    rows = rows.orderBy(F.pmod(F.xxhash64(doc_id), F.lit(1 << 32)), doc_id, *STATISTICS).limit(sample).select("_label", *STATISTICS).toPandas()
    return learn(rows[list(STATISTICS)].to_numpy(float), (rows["_label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    shared = common.Shared(docs.sparkSession)
    stats = shared.write(with_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]), keep=True)
    value = compiled(*trained(stats, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("quality"))))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the rules accept, all columns kept, whatever their names."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    stats = with_statistics(docs.toDF(*names), at[text], names)
    value = compiled(*trained(stats.select(F.col(at[doc_id]).alias("doc_id"), *STATISTICS), labels))
    return stats.where(value >= 0.5).select(*[F.col(n).alias(c) for c, n in at.items()])
