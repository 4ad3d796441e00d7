"""Hard negatives by a vertical scan of vectors.

Rows lie in blocks of columns, one array per dimension. An anchor reads the dimensions of a block in the order of its own
descending magnitudes, so that the first ones settle most of the inner product. After every few of them each row has a lower
and an upper bound: what is summed up so far and what the dimensions left can add at least and at most, by the block's smallest
and largest value of each. Rows whose bounds miss every window, or stay below what is found already, leave the candidate
bitmap; the few that remain are summed to the end and are exact.

Two scans: the first finds each anchor's positives, the second its negatives inside the windows that the positives' scores
open. Anchors go in chunks and rows in blocks of bounded size, a task takes one chunk past a bounded number of blocks, one at a
time, and keeps only the best few rows of each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import durable

SCALE = 256
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 256
BLOCKS_PER_TASK = 16  # of one chunk of anchors
MOST_TASKS = 20_000
STEP = 8  # dimensions between two looks at the bounds
FEW = 64  # so few candidates are summed to the end at once
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
MOST_NORM = SAFE = float(1 << 62)


class Best:
    """The ``most`` best rows: higher scores first, then smaller ids."""

    def __init__(self, most: int):
        self.most = most
        self.scores = self.ids = self.rows = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores):
            scores, ids, rows = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.rows, rows]
            first = np.lexsort((rows, ids, -scores))[: self.most]
            self.scores, self.ids, self.rows = scores[first], ids[first], rows[first]

    @property
    def bar(self) -> int | None:
        """The score that another row has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.most else None


class Block:
    """Rows by columns: ``columns[j]`` has dimension j of all of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.rows, self.labels, self.columns = ids, rows, labels, columns
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, windows: list[tuple[int | None, int | None]], bests: list[Best]) -> None:
        """Adds to ``bests[k]`` the candidates whose score lies in ``windows[k]`` and that reach its bar."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        weights = anchor[order]
        at = np.flatnonzero(candidates)
        sums = np.zeros(len(at), np.int64)
        if np.abs(weights.astype(float)) @ np.maximum(-self.low[order].astype(float), self.high[order]) >= SAFE:
            for j in order:  # bounds would not fit, only whole scores do
                sums += anchor[j] * self.columns[j, at]
            return self._add(at, sums, windows, bests)
        ends = np.stack([weights * self.low[order], weights * self.high[order]])
        rest_low = np.r_[np.cumsum(ends.min(axis=0)[::-1])[::-1], 0]
        rest_high = np.r_[np.cumsum(ends.max(axis=0)[::-1])[::-1], 0]
        for done in range(0, len(order), STEP):
            if not len(at):
                return
            step = order[done:] if len(at) <= FEW else order[done : done + STEP]
            whole = len(at) == self.columns.shape[1]
            for j in step:
                sums += anchor[j] * (self.columns[j] if whole else self.columns[j, at])
            read = done + len(step)
            low, high = sums + rest_low[read], sums + rest_high[read]
            stay = np.zeros(len(at), bool)
            for (least, most), best in zip(windows, bests):
                bar = self._bar(low, high, least, most, best)
                open_to = np.ones(len(at), bool) if bar is None else high >= bar
                if most is not None:
                    open_to &= low <= most
                stay |= open_to
            at, sums = at[stay], sums[stay]
            if read == len(order):
                break
        self._add(at, sums, windows, bests)

    def _add(self, at: np.ndarray, sums: np.ndarray, windows: list[tuple[int | None, int | None]], bests: list[Best]) -> None:
        for (least, most), best in zip(windows, bests):
            inside = np.ones(len(at), bool) if least is None else sums >= least
            if most is not None:
                inside &= sums <= most
            best.add(sums[inside], self.ids[at[inside]], self.rows[at[inside]])

    @staticmethod
    def _bar(low: np.ndarray, high: np.ndarray, least: int | None, most: int | None, best: Best) -> int | None:
        """What a row's upper bound has to reach: the window's start, the last of the best, the best of the lower bounds inside."""
        bars = [b for b in (least, best.bar) if b is not None]
        sure = np.ones(len(low), bool) if least is None else low >= least
        if most is not None:
            sure &= high <= most
        if np.count_nonzero(sure) >= best.most:
            inside = low[sure]
            bars.append(int(np.partition(inside, len(inside) - best.most)[len(inside) - best.most]))
        return max(bars, default=None)


def vectors_of(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id long, label, vector (floor of ``scale`` times each component, as longs) of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, and neither do rows so long that a
    score might not fit into 64 bits (a squared norm of more than 2^62 after scaling). An empty vector scores 0 with all.
    """
    values = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").dropna()
    rows = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", "label", values.alias("_scaled"))
    norm = F.aggregate("_scaled", F.lit(0.0), lambda total, x: total + x * x)
    return rows.where(norm <= MOST_NORM).select("vec_id", "label", F.transform("_scaled", lambda x: x.cast("long")).alias("vector"))


WINDOW_SQL = "array<struct<row:bigint,id:bigint,score:bigint>>"
PACKED_SQL = "ids binary, row_ids binary, labels binary, wide int, item int, columns binary"
PACKED = ["ids", "row_ids", "labels", "wide", "item", "columns"]


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """One row per vector, shorter ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _packed(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]) -> list:
    wide = max(v.shape[1] for v in vectors)
    columns = np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in vectors]).T
    item = 4 if not columns.size or np.abs(columns).max() < 1 << 31 else 8
    return [ids.tobytes(), rows.tobytes(), labels.tobytes(), wide, item, np.ascontiguousarray(columns, f"<i{item}").tobytes()]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Up to ``size`` rows each, as columns, and the ``windows`` of each of them in the same order."""
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def pack(batches):
        held: list[tuple] = []
        count = 0

        def given():
            ids, numbers, labels = (np.concatenate([part[k] for part in held]) for k in range(3))
            values = _packed(ids, numbers, labels, [part[3] for part in held])
            windows = [w for part in held for w in part[4]]
            columns = [pa.array([v], t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([windows], pa.list_(batch.schema.field("windows").type))], [*PACKED, "windows"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                numbers = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
                held.append((*numbers, _matrix(part.column(3)), part.column(4).to_pylist()))
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield given()
                    held, count = [], 0
        if held:
            yield given()

    return rows.select("vec_id", "row", "label", "vector", "windows").mapInArrow(pack, f"{PACKED_SQL}, windows array<{WINDOW_SQL}>")


def _unpacked(row: dict) -> Block:
    ids, rows, labels = (np.frombuffer(row[name], np.int64) for name in ("ids", "row_ids", "labels"))
    columns = np.frombuffer(row["columns"], f"<i{row['item']}").reshape(row["wide"], len(ids)).astype(np.int64)
    return Block(ids, rows, labels, columns)


def _met(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every chunk of anchors before each slice of blocks: rows of one (chunk, slice), the chunk first.

    A block goes to each chunk, as a search of all rows for every anchor needs; the driver sees the number of each chunk.
    """
    keys = [row.chunk for row in chunks.select("chunk").collect()]
    n_blocks, slots = blocks.count(), chunks.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(n_blocks, max(-(-n_blocks // BLOCKS_PER_TASK), 2 * slots // max(1, len(keys)))))
    number = F.monotonically_increasing_id()
    blocks = blocks.withColumn("slice", F.pmod(F.shiftright(number, 33) + number, F.lit(slices)).cast("int"))
    blocks = blocks.withColumn("chunk", F.explode(F.array(*map(F.lit, keys)) if keys else F.array().cast("array<long>")))
    chunks = chunks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    names = ["chunk", "slice", *PACKED, "windows", "kind"]
    both = chunks.withColumn("kind", F.lit(0)).select(*names).unionByName(blocks.withColumn("kind", F.lit(1)).select(*names))
    return both.repartition(max(1, min(len(keys) * slices, MOST_TASKS)), "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind")


FOUND_SQL = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, found_row long, vec_id long, score long"
FOUND = pa.schema([(part.split()[0], pa.int64()) for part in FOUND_SQL.split(", ")])


def _searched(met: DataFrame, most: int, percents: tuple[int, int] | None) -> DataFrame:
    """The best ``most`` rows of every (chunk, slice) for each anchor: of its own label, or of others in each positive's window."""

    def found(chunk: dict, anchors: Block, bests: list[list[Best]]) -> pa.RecordBatch:
        out = []
        for k, per_window in enumerate(bests):
            for w, best in enumerate(per_window):
                positive = (None, None, None) if percents is None else tuple(chunk["windows"][k][w].values())
                out += [(int(anchors.rows[k]), int(anchors.ids[k]), *positive, *one) for one in zip(best.rows.tolist(), best.ids.tolist(), best.scores.tolist())]
        columns = list(zip(*out)) or [()] * len(FOUND)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    def windows_of(chunk: dict, k: int) -> list[tuple[int | None, int | None]]:
        if percents is None:
            return [(None, None)]
        low, high = percents
        return [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in chunk["windows"][k]]

    def search(batches):
        key = chunk = anchors = windows = bests = None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if chunk is not None:
                        yield found(chunk, anchors, bests)
                    key, chunk, anchors = (row["chunk"], row["slice"]), row, _unpacked(row)
                    windows = [windows_of(row, k) for k in range(len(anchors.ids))]
                    bests = [[Best(most) for _ in w] for w in windows]
                    continue
                if key != (row["chunk"], row["slice"]):
                    raise RuntimeError("a block of rows came without its anchors")
                block = _unpacked(row)
                wide = len(block.columns)
                for k in range(len(anchors.ids)):
                    if not windows[k]:
                        continue
                    same = block.labels == anchors.labels[k]
                    candidates = same & (block.rows != anchors.rows[k]) if percents is None else ~same
                    anchor = np.zeros(wide, np.int64)
                    mine = anchors.columns[:wide, k]
                    anchor[: len(mine)] = mine
                    block.scan(anchor, candidates, windows[k], bests[k])
        if chunk is not None:
            yield found(chunk, anchors, bests)

    return met.mapInArrow(search, FOUND_SQL)


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT,
    scale: int = SCALE, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from vec_id, label and embedding.

    Anchors are the rows whose id is divisible by ``every``. A score is the integer inner product of scaled vectors
    (``vectors_of``), higher ones come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of
    the same label; to each belong the first ``negatives`` rows of another label whose score lies from ``low_percent`` to
    ``high_percent`` of the positive's.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as filled up
    with zeros. Repeated rows are rows of their own: a copy of an anchor is one of its positives, and an anchor too. Anchors
    without a positive, and positives without a negative, give no row; neither does an empty table. Other columns are ignored.
    """
    kept = durable(vectors_of(rows, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    blocks = durable(_blocks(kept.withColumn("windows", F.lit(None).cast(WINDOW_SQL)), block_rows), "blocks")
    anchors = kept.where(F.col("vec_id") % every == 0)
    tasks = max(1, -(-anchors.count() // chunk_anchors))

    def chunks(anchor_rows: DataFrame) -> DataFrame:
        packed = _blocks(anchor_rows.coalesce(tasks), chunk_anchors)
        return durable(packed.withColumn("chunk", F.monotonically_increasing_id()), "anchors")

    found = _searched(_met(chunks(anchors.withColumn("windows", F.lit(None).cast(WINDOW_SQL))), blocks), positives, None)
    best = durable(_best(found, ["anchor_row"], positives), "positives")
    opened = best.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct(F.col("found_row").alias("row"), F.col("vec_id").alias("id"), "score")).alias("windows"))
    found = _searched(_met(chunks(anchors.join(opened, "row")), blocks), negatives, (low_percent, high_percent))
    ranked = _best(found, ["anchor_row", "positive_row"], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
