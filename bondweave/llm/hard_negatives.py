"""Hard negatives: a full sort of each anchor's integer scores, read from each positive's upper limit on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Rows of one block of the table, and anchors of one block of the query set; both are rows of a packed table.
BLOCK_ROWS = 16_384
BLOCK_ANCHORS = 1_024
#: Anchors scored at once against a block: a matrix of 8 MB.
AT_ONCE = 64
#: Tasks a core among which the pairs of blocks are dealt.
TASKS_A_CORE = 2
_LIMIT = 2**63 - 1

_PACKED = "block bigint, uid binary, id binary, known binary, label binary, dims int, width int, v binary, positives array<array<struct<id:bigint,known:boolean,score:bigint>>>"
_POSITIVE = "uid bigint, anchor_id bigint, id bigint, known boolean, score bigint"
_NEGATIVE = "uid bigint, anchor_id bigint, nth int, positive_id bigint, positive_score bigint, id bigint, known boolean, score bigint"


def integer_vectors(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part: a label, a vector, and every component finite; v = floor(scale * x) as long."""
    vector = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    taking_part = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))
    return rows.where(taking_part).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one block, sorted by id (null last), in one row: components as bytes of the least width that holds them all, shorter vectors filled up with zeros."""
    known = ~np.asarray(table["id"].is_null())
    ids = table["id"].fill_null(_LIMIT).to_numpy()
    order = np.lexsort((ids, ~known))
    lists = table["v"].combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(sizes.max())
    v = np.zeros((len(sizes), dims), np.int64)
    v[np.arange(dims) < sizes[:, None]] = flat
    most = np.abs(flat.astype(float)).max(initial=0)
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    packed = {
        "block": [table["block"][0].as_py()],
        "uid": [table["uid"].to_numpy()[order].tobytes()],
        "id": [ids[order].tobytes()],
        "known": [known[order].tobytes()],
        "label": [table["label"].to_numpy()[order].tobytes()],
        "dims": pa.array([dims], pa.int32()),
        "width": pa.array([width], pa.int32()),
        "v": [v[order].astype(f"<i{width}").tobytes()],
        "positives": pa.array([[table["positives"][i].as_py() for i in order]], pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("known", pa.bool_()), ("score", pa.int64())])))),
    }
    return pa.table(packed)


def _packed(rows: DataFrame, block: Column, partitions: int) -> DataFrame:
    if "positives" not in rows.columns:
        rows = rows.withColumn("positives", F.expr("cast(null as array<struct<id:bigint,known:boolean,score:bigint>>)"))
    dealt = rows.select(block.cast("long").alias("block"), "uid", "id", "label", "v", "positives").repartition(partitions, "block")
    return dealt.groupBy("block").applyInArrow(_pack, _PACKED)


class _Block:
    """What ``_pack`` packed, as arrays."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.uid, self.id, self.known, self.label = get("uid", np.int64), get("id", np.int64), get("known", bool), get("label", np.int64)
        self.v = get("v", f"<i{row['width']}").reshape(len(self.uid), row["dims"])
        self.most = float(np.abs(self.v.astype(np.float64)).max(initial=0))
        self.positives = row["positives"]


def scores(a: _Block, b: _Block, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Inner products as longs, exact; beyond a long's limits they stay at them. A component that one side lacks counts as zero."""
    dims = min(a.v.shape[1], b.v.shape[1])
    x, y = a.v[of_a, :dims], b.v[of_b, :dims]
    if a.most * b.most * max(dims, 1) < 2**53:  # every partial sum is a whole number that a double holds
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    exact = x.astype(object) @ y.astype(object).T if dims else np.zeros((len(x), len(y)), object)
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64)


def limits(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score s with ``low * positive_score <= 100 * s <= high * positive_score``."""
    return -((-low * positive_score) // 100), high * positive_score // 100


def read_below(ordered: np.ndarray, order: np.ndarray, wanted: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
    """Places of the first k wanted rows whose score lies in [least, most]; ``ordered`` has the negated scores, ascending, ``order`` their places."""
    at, end = np.searchsorted(ordered, -most, "left"), np.searchsorted(ordered, -least, "right")
    got: list[np.ndarray] = []
    n, step = 0, 4 * k
    while at < end and n < k:
        places = order[at : min(at + step, end)]
        got.append(places[wanted[places]])
        n, at, step = n + len(got[-1]), at + step, 2 * step
    return np.concatenate(got)[:k] if got else order[:0]


def _best(held: list[tuple], new: list[tuple], k: int) -> list[tuple]:
    return sorted(held + new)[:k] if held else new


def _pairs_of_blocks(keep: Callable[[_Block, _Block, dict], None], rows_of: Callable[[dict], Iterator[tuple]], schema: pa.Schema):
    """For each pair of an anchor block and a row block ``keep`` updates what is held for its anchors; at the end of the partition ``rows_of`` gives it out."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        blocks: dict[int, tuple[int, _Block]] = {}
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                sides = []
                for side, value in ((0, a), (1, b)):
                    number = value["block"].as_py()
                    if blocks.get(side, (None,))[0] != number:
                        blocks[side] = (number, _Block(value.as_py()))
                    sides.append(blocks[side][1])
                keep(*sides, held)
        out = list(rows_of(held))
        for at in range(0, len(out), 50_000):
            part = list(zip(*out[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema)], schema=schema)

    return over


def _keep_positives(n: int):
    def keep(a: _Block, b: _Block, held: dict) -> None:
        for label in np.intersect1d(a.label, b.label):
            mine, theirs = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
            for at in range(0, len(mine), AT_ONCE):
                chunk = mine[at : at + AT_ONCE]
                for i, negated in zip(chunk, -scores(a, b, chunk, theirs)):
                    order = np.lexsort((np.arange(len(theirs)), negated))[: n + 1]  # places of a block are in the order of ids
                    first = [p for p in order if b.uid[theirs[p]] != a.uid[i]][:n]
                    new = [(int(negated[p]), not b.known[theirs[p]], int(b.id[theirs[p]])) for p in first]
                    key = (int(a.uid[i]), int(a.id[i]) if a.known[i] else None)
                    held[key] = _best(held.get(key, []), new, n)

    def rows_of(held: dict) -> Iterator[tuple]:
        for (uid, anchor), best in held.items():
            for negated, unknown, i in best:
                yield uid, anchor, i, not unknown, -negated

    schema = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("known", pa.bool_()), ("score", pa.int64())])
    return _pairs_of_blocks(keep, rows_of, schema)


def _keep_negatives(k: int, low: int, high: int):
    def keep(a: _Block, b: _Block, held: dict) -> None:
        every, places = np.arange(len(b.uid)), np.arange(len(b.uid))
        for at in range(0, len(a.uid), AT_ONCE):
            chunk = np.arange(at, min(at + AT_ONCE, len(a.uid)))
            for i, negated in zip(chunk, -scores(a, b, chunk, every)):
                order = np.lexsort((places, negated))
                ordered, other = negated[order], b.label != a.label[i]
                for nth, positive in enumerate(a.positives[i]):
                    found = read_below(ordered, order, other, *limits(positive["score"], low, high), k)
                    new = [(int(negated[p]), not b.known[p], int(b.id[p])) for p in found]
                    key = (int(a.uid[i]), int(a.id[i]) if a.known[i] else None, nth, positive["id"] if positive["known"] else None, positive["score"])
                    if new:
                        held[key] = _best(held.get(key, []), new, k)

    def rows_of(held: dict) -> Iterator[tuple]:
        for key, best in held.items():
            for negated, unknown, i in best:
                yield *key, i, not unknown, -negated

    ints = {"known": pa.bool_(), "nth": pa.int32()}
    schema = pa.schema([(c.split()[0], ints.get(c.split()[0], pa.int64())) for c in _NEGATIVE.split(", ")])
    return _pairs_of_blocks(keep, rows_of, schema)


def mine(rows: DataFrame, is_anchor: Column, k: int = 10, n_positives: int = 5, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, v) of ``integer_vectors``.

    A row's score is its inner product with the anchor; higher scores come first, ties by smaller id, null ids last. An
    anchor's positives are its first ``n_positives`` other rows of its label; for each of them come the first ``k`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Fewer come where there
    are fewer; anchors without a positive or negative have no rows. ``is_anchor`` is an expression of id, label and v.

    Rows that repeat an id are rows of their own, an anchor among them has its own results, and a repeat of an anchor can be
    its positive. Vectors of different lengths meet as if filled up with zeros; scores beyond a long stay at its limits. An
    empty table, or one without anchors, gives no rows.

    All rows meet all anchors in blocks. A task takes blocks of rows past a block of anchors, sorts all of a block's
    scores for each anchor, and holds no more than the best so far: ``n_positives``, then ``k`` for each positive. What the
    tasks hold at their end is merged by a window. A label's size does not matter to how the blocks are dealt.
    """
    spark = rows.sparkSession
    stored = materialize(rows.select("id", "label", "v").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    anchors = stored.where(F.coalesce(is_anchor, F.lit(False)))
    n_rows, n_anchors = stored.count(), anchors.count()
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    anchor_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    row_blocks = max(1, -(-n_rows // BLOCK_ROWS), min(tasks, n_rows // 256))
    row_partitions = min(row_blocks, max(1, -(-tasks // anchor_blocks)))
    dealt = lambda blocks: F.pmod(F.xxhash64("uid"), F.lit(blocks))
    blocks = materialize(_packed(stored, dealt(row_blocks), row_partitions), "row-blocks").select(F.struct("*").alias("b")).coalesce(row_partitions)

    def met(queries: DataFrame, by: Callable, schema: str) -> DataFrame:
        packed = materialize(_packed(queries, dealt(anchor_blocks), anchor_blocks), "anchor-blocks")
        return packed.select(F.struct("*").alias("a")).crossJoin(blocks).mapInArrow(by, schema)

    first = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("known"), "id")
    found = met(anchors, _keep_positives(n_positives), _POSITIVE).withColumn("nth", F.row_number().over(first("uid"))).where(F.col("nth") <= n_positives)
    positives = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "known", "score"))).alias("p"))
    positives = positives.select("uid", F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["known"].alias("known"), p["score"].alias("score"))).alias("positives"))
    negatives = met(anchors.join(positives, "uid"), _keep_negatives(k, low, high), _NEGATIVE)
    ranked = negatives.withColumn("rank", F.row_number().over(first("uid", "nth"))).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", F.when(F.col("known"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
