"""Hard-negative mining with segment summaries.

A vector is cut into segments. Of every segment the summary holds the mean and the
deviation, each times the square root of the segment's length. The product of two
segments is the product of their means plus or minus at most the product of their
deviations, so the summaries of two vectors bound their inner product from both sides
at the cost of a shorter product. Segments are refined from long to short; a pair that
its bounds rule out is not looked at again, and only what no bound rules out is scored,
in whole numbers.

Candidates are dealt by id into groups of bounded size; anchors travel in chunks that
visit every group, twice. First a group returns each anchor's best rows of its own
label, then, for each of the anchor's positives, the best rows of another label whose
score lies in the window that the positive opens: low % to high % of its score. Lower
bounds give the score that k rows are sure to reach, upper bounds rule out rows below
it; for a window only rows sure not to lie above it count. Nothing else leaves out a
row, so the result is exact, ties going to the smaller id.

Rows with a null id, a null label, a null vector or a null or non-finite component take
no part. Rows of one id count once, with the least (label, vector). A vector shorter
than others ends in zeros. Scores are 64-bit; beyond that they are undefined. An anchor
with fewer positives, or a positive with fewer negatives, returns what there is; a
positive with a negative score opens no window. Very long vectors make smaller groups.
Empty tables give no rows. Columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pitwall.llm.common import rows_per_group, stored
from pitwall.llm.topk import _array, _matrix, _product

GROUP_BYTES = 32 << 20  # vectors of one group
CHUNK = 512             # anchors that travel together
COLUMNS = 4096          # rows looked at together
LENGTHS = (16, 4, 2)    # segment lengths, each a multiple of the next

_PACKED = "no long, n int, ids binary, labels binary, vectors binary, wanted binary"
_POSITIVE = "anchor_id long, vec_id long, score long"
_NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
_LOWEST = np.iinfo(np.int64).min


def labelled_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and ``v``, floor(scale * x) of every component; one row per id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
    least = F.min(F.struct("label", F.transform("x", lambda c: F.floor(scale * c)).alias("v"))).alias("least")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "least.label", "least.v")


def _packed(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows of one partition in blocks of ``size``, by label and id. ``wanted`` (ids and scores) is packed, too, if there."""
    named = "wanted" in rows.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []

        def block(table: pa.Table) -> pa.RecordBatch:
            wanted = b""
            if named:
                flat = table.column("wanted").combine_chunks()
                counts = np.diff(np.asarray(flat.offsets))
                pairs = flat.flatten()
                wanted = np.concatenate([counts, np.asarray(pairs.field("vec_id")), np.asarray(pairs.field("score"))])
                wanted = wanted.astype("<i8").tobytes()
            ids = np.asarray(table.column("vec_id")).astype("<i8")
            return pa.RecordBatch.from_pylist([{
                "no": int(ids[0]), "n": len(ids), "ids": ids.tobytes(),
                "labels": np.asarray(table.column("label")).astype("<i8").tobytes(),
                "vectors": _matrix(table.column("v").combine_chunks(), width).astype("<i8").tobytes(), "wanted": wanted}], schema)

        for batch in batches:
            rest.append(batch)
            while sum(b.num_rows for b in rest) >= size:
                table = pa.Table.from_batches(rest)
                yield block(table.slice(0, size))
                rest = table.slice(size).to_batches()
        if sum(b.num_rows for b in rest):
            yield block(pa.Table.from_batches(rest))

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _PACKED.split(", "))])
    return rows.mapInArrow(build, _PACKED)


def summaries(m: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length the means and the deviations of the segments, times the root of the length."""
    m = np.pad(m.astype(np.float64), ((0, 0), (0, -m.shape[1] % lengths[0])))
    out = []
    for length in lengths:
        parts = m.reshape(len(m), -1, length)
        mean = parts.mean(axis=2)
        deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
        out.append((mean * np.sqrt(length), deviation))
    return out


def _reached(values: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that at least k of its entries reach: the k-th largest maximum of runs of entries."""
    n = values.shape[1]
    if n < k:
        return np.full(len(values), -np.inf)
    best = np.maximum.reduceat(values, np.arange(0, n, max(1, n // (32 * k))), axis=1)
    return np.partition(best, -k, axis=1)[:, -k]


class _Rows:
    """Vectors of a group or a chunk, by label, with their summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.order = order
        self.levels = summaries(self.vectors)
        self.norm = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)

    def bounds(self, level: int, mine: slice, other: "_Rows", theirs: slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores lie between the two; the slack covers the rounding of the products."""
        mean, deviation = self.levels[level]
        mean_, deviation_ = other.levels[level]
        middle = mean[mine] @ mean_[theirs].T
        reach = deviation[mine] @ deviation_[theirs].T
        reach += 1 + 1e-12 * self.norm * other.norm
        return middle - reach, middle + reach

    def scores(self, mine: slice, other: "_Rows", theirs: slice, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact scores of the pairs that are alive: row, column, score."""
        r, c = np.nonzero(alive)
        if len(r) * 8 >= alive.size:
            return r, c, _product(self.vectors[mine], other.vectors[theirs])[r, c]
        a, b, out = self.vectors[mine], other.vectors[theirs], []
        for at in range(0, len(r), 1 << 16):
            i, j = r[at:at + (1 << 16)], c[at:at + (1 << 16)]
            out.append((a[i] * b[j]).sum(axis=1))
        return r, c, np.concatenate(out) if out else np.empty(0, np.int64)


class _Top:
    """The k best (score, id) of each slot; ties go to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.kth = k, np.full(slots, _LOWEST)
        self.slot = self.id = self.score = np.empty(0, np.int64)

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.kth[slot]
        slot, ids, scores = (np.concatenate(x) for x in (
            (self.slot, slot[keep]), (self.id, ids[keep]), (self.score, scores[keep])))
        order = np.lexsort((ids, -scores, slot))
        slot, ids, scores = slot[order], ids[order], scores[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        self.kth[slot[last]] = scores[last]
        keep = rank < self.k
        self.slot, self.id, self.score = slot[keep], ids[keep], scores[keep]


def _columns(start: int, stop: int) -> Iterator[slice]:
    for at in range(start, stop, COLUMNS):
        yield slice(at, min(stop, at + COLUMNS))


def best_positives(anchors: _Rows, group: _Rows, k: int) -> _Top:
    """Each anchor's k best other rows of its label in the group; slots are anchors."""
    top = _Top(len(anchors.ids), k)
    labels, starts = np.unique(anchors.labels, return_index=True)
    for label, start, stop in zip(labels, starts, np.append(starts[1:], len(anchors.ids))):
        mine = slice(start, stop)
        for theirs in _columns(*np.searchsorted(group.labels, [label, label + 1])):
            alive = anchors.ids[mine, None] != group.ids[None, theirs]
            floor = top.kth[mine].astype(np.float64)
            for level in range(len(LENGTHS)):
                low, high = anchors.bounds(level, mine, group, theirs)
                floor = np.maximum(floor, _reached(np.where(alive, low, -np.inf), k))
                alive &= high >= floor[:, None]
            r, c, score = anchors.scores(mine, group, theirs, alive)
            top.add(r + start, group.ids[theirs][c], score)
    return top


def best_negatives(anchors: _Rows, group: _Rows, low: np.ndarray, high: np.ndarray, k: int) -> _Top:
    """The k best rows of another label within each window (columns of low and high) of each anchor.

    Slots are anchor * windows + window. A window with low above high is empty.
    """
    windows = low.shape[1]
    top = _Top(low.size, k)
    every = slice(0, len(anchors.ids))
    for theirs in _columns(0, len(group.ids)):
        other = anchors.labels[:, None] != group.labels[None, theirs]
        floor = np.maximum(low, top.kth.reshape(low.shape)).astype(np.float64)
        alive = other
        for level in range(len(LENGTHS)):
            least, most = anchors.bounds(level, every, group, theirs)
            some = np.zeros(alive.shape, bool)
            for w in range(windows):
                sure = np.where(alive & (most <= high[:, w, None]), least, -np.inf)
                floor[:, w] = np.maximum(floor[:, w], _reached(sure, k))
                some |= (most >= floor[:, w, None]) & (least <= high[:, w, None])
            alive = alive & some & (low <= high).any(axis=1)[:, None]
        r, c, score = anchors.scores(every, group, theirs, alive)
        ids = group.ids[theirs][c]
        for w in range(windows):
            inside = (score >= floor[r, w]) & (score >= low[r, w]) & (score <= high[r, w])
            top.add(r[inside] * windows + w, ids[inside], score[inside])
    return top


def _visits(blocks: DataFrame, chunks: DataFrame, groups: int, work: Callable, result: str) -> DataFrame:
    """Let every chunk of anchors visit every group: the group's blocks come first, then the chunks one by one."""
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    both = blocks.withColumn("kind", F.lit(0)).unionByName(
        chunks.withColumn("group", everywhere).withColumn("kind", F.lit(1)))
    both = both.repartitionById(groups, "group").sortWithinPartitions("group", "kind", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, group = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("group", "kind", "n", "ids", "labels", "vectors", "wanted")}
                arrays = _array(row["ids"]), _array(row["labels"]), _array(row["vectors"]).reshape(row["n"], -1)
                if row["group"] != now:
                    now, parts, group = row["group"], [], None
                if row["kind"] == 0:
                    parts.append(arrays)
                    continue
                if parts:
                    group, parts = _Rows(*(np.concatenate(x) for x in zip(*parts))), []
                if group is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in work(_Rows(*arrays), group, row["wanted"])],
                                                     names=[c.split()[0] for c in result.split(", ")])

    return both.mapInArrow(run, result)


def _grouped(dealt: DataFrame, groups: int, width: int) -> DataFrame:
    """Packed blocks of each group."""
    size = max(1, (1 << 20) // (8 * width))
    together = dealt.repartitionById(groups, "group").select("group", "vec_id", "label", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.asarray(batch.column("group"))
            for g in np.unique(groups):
                mine = batch.filter(pa.array(groups == g))
                for at in range(0, mine.num_rows, size):
                    part = mine.slice(at, size)
                    ids = np.asarray(part.column("vec_id")).astype("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(g)], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([len(ids)], pa.int32()),
                         pa.array([ids.tobytes()]), pa.array([np.asarray(part.column("label")).astype("<i8").tobytes()]),
                         pa.array([_matrix(part.column("v"), width).astype("<i8").tobytes()]), pa.array([b""])],
                        names=["group", "no", "n", "ids", "labels", "vectors", "wanted"])

    return together.mapInArrow(pack, "group int, " + _PACKED)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables hold vec_id, label and ``v``; see ``labelled_vectors``. Negatives score between
    ``low`` and ``high`` hundredths of the positive.
    """
    rows, anchors = stored(rows.select("vec_id", "label", "v"), "rows"), stored(anchors.select("vec_id", "label", "v"), "anchors")
    width, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width = max(1, width or 0, anchors.agg(F.max(F.size("v"))).first()[0] or 0)
    spark = rows.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows_per_group(n, max(1, GROUP_BYTES // (8 * width))))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    blocks = stored(_grouped(dealt, groups, width), "blocks")
    parts = rows_per_group(anchors.count(), CHUNK)

    def chunks(table: DataFrame) -> DataFrame:
        dealt = table.repartitionByRange(parts, "label", "vec_id").sortWithinPartitions("label", "vec_id")
        return stored(_packed(dealt, width, CHUNK), "chunks")

    def first(a: _Rows, group: _Rows, wanted: bytes) -> list[np.ndarray]:
        top = best_positives(a, group, positives)
        return [a.ids[top.slot], top.id, top.score]

    found = _visits(blocks, chunks(anchors), groups, first, _POSITIVE)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("wanted"))
    asked = anchors.join(best, "vec_id")

    def second(a: _Rows, group: _Rows, wanted: bytes) -> list[np.ndarray]:
        given, n = _array(wanted), len(a.ids)
        counts, total = given[:n], int(given[:n].sum())
        ids, scores = given[n:n + total], given[n + total:]
        at = np.repeat(np.arange(n), counts), np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        least, most, who, score = (np.zeros((n, positives), np.int64) for _ in range(4))
        least[:] = 1
        least[at], most[at] = -(-low * scores // 100), high * scores // 100
        who[at], score[at] = ids, scores
        least, most, who, score = (x[a.order] for x in (least, most, who, score))
        top = best_negatives(a, group, least, most, negatives)
        anchor, window = top.slot // positives, top.slot % positives
        return [a.ids[anchor], who[anchor, window], score[anchor, window], top.id, top.score]

    found = _visits(blocks, chunks(asked), groups, second, _NEGATIVE)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
