"""Hard negatives by blocked dense products.

Vectors become whole numbers, so that an inner product is exact.  The anchors are dealt
out to rounds of bounded size.  In a round its anchors go to every task as one block,
candidates stream past in blocks of rows, and each pair of blocks is one matrix product.
The first pass keeps each anchor's best rows of its own label, per task, and a window over
what the tasks kept merges them: the positives.  The second pass keeps the best rows of
other labels within a window of scores below each positive, in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut

#: Bytes of the anchors' matrix in one round at most (and one anchor at least): what the driver
#: gathers and every worker holds.
ROUND_BYTES = 32 << 20
#: Scores in memory at a time.
TILE = 1 << 20

_WORST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The ``k`` highest scores of each of ``n`` lists; ties go to the smaller id.  Merging is
    associative: lists of parts, offered to one another, give the list of the whole."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _WORST, dtype=np.int64)
        self.id = np.full((n, k), _LAST, dtype=np.int64)

    def offer(self, lists: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``scores`` are the given lists, columns are ``ids``."""
        k = self.score.shape[1]
        scores = np.where(allowed, scores, _WORST)
        least, last = self.score[lists, -1][:, None], self.id[lists, -1][:, None]
        better = (scores > least) | ((scores == least) & (ids < last) & allowed)
        if scores.shape[1] > 4 * k and better.sum() > 4 * k * len(lists):
            # Lists that are not full yet: none needs more than the block's own k best, with ties.
            better &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        row, column = np.nonzero(better)
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        old = lists[touched]
        of = np.concatenate([np.repeat(np.arange(len(touched)), k), row])
        score = np.concatenate([self.score[old].ravel(), scores[touched[row], column]])
        its_id = np.concatenate([self.id[old].ravel(), ids[column]])
        order = np.lexsort((its_id, ~score, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], np.arange(len(touched)))[of[order]]
        order = order[place < k]
        self.score[old], self.id[old] = score[order].reshape(-1, k), its_id[order].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, id and score of all that is held."""
        at = np.nonzero(self.score > _WORST)
        return at[0], self.id[at], self.score[at]


def whole_vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose components are all there and finite, and their matrix of floor(scale * x); one
    pair for each dimension among the rows."""
    vectors = batch.column("vector")
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        # A null component turns into NaN.
        flat = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), int(dim))
        good = np.isfinite(flat).all(axis=1)
        with np.errstate(over="ignore"):
            yield at[good], np.floor(scale * flat[good])


def _bounds(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, dim, norm = 0, 0, 0.0
        for batch in batches:
            is_anchor = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            for at, matrix in whole_vectors(batch, scale):
                if len(at):
                    anchors += int(is_anchor[at].sum())
                    dim = max(dim, matrix.shape[1])
                    with np.errstate(over="ignore"):
                        norm = max(norm, float(np.einsum("ij,ij->i", matrix, matrix).max()))
        yield pa.RecordBatch.from_arrays([pa.array([anchors]), pa.array([dim]), pa.array([norm])], names=["anchors", "dim", "norm"])

    return run


class Block:
    """A round's anchors, one matrix for each dimension."""

    def __init__(self, rows: pa.Table, scale: int):
        rows = rows.combine_chunks()
        self.id = rows.column("id").to_numpy()
        self.label = rows.column("label").to_numpy()
        self.matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in rows.to_batches():
            for at, matrix in whole_vectors(batch, scale):
                self.matrices[matrix.shape[1]] = (at, matrix)

    def tiles(self, batch: pa.RecordBatch, scale: int, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors, candidates' ids and labels, and their scores, a bounded number at a time."""
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for at, candidates in whole_vectors(batch, scale):
            anchors, matrix = self.matrices.get(candidates.shape[1], (np.empty(0, dtype=int), candidates[:0]))
            if not exact:
                candidates, matrix = candidates.astype(np.int64), matrix.astype(np.int64)
            step = max(1, TILE // max(1, len(at)))
            for first in range(0, len(anchors) if len(at) else 0, step):
                score = matrix[first : first + step] @ candidates.T
                yield anchors[first : first + step], ids[at], labels[at], score.astype(np.int64)


def _positives(shared, scale: int, exact: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = Best(len(block.id), k)
        for batch in batches:
            for anchors, ids, labels, score in block.tiles(batch, scale, exact):
                best.offer(anchors, score, (block.label[anchors, None] == labels) & (block.id[anchors, None] != ids), ids)
        yield pa.RecordBatch.from_arrays([*map(pa.array, best.rows())], names=["anchor", "id", "score"])

    return run


def _negatives(shared, scale: int, exact: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, positive, low, high = shared.value
        at, places = positive["anchor"], positive["place"]
        best = Best(len(at), k)
        # The windows of an anchor stand together; window w of all anchors is one offer.
        row_of = [np.full(len(block.id), -1) for _ in range(int(places.max(initial=-1)) + 1)]
        for place, rows in enumerate(row_of):
            here = np.flatnonzero(places == place)
            rows[at[here]] = here
        for batch in batches:
            for anchors, ids, labels, score in block.tiles(batch, scale, exact):
                other = block.label[anchors, None] != labels
                for rows in row_of:
                    own = rows[anchors]
                    has = np.flatnonzero(own >= 0)
                    if len(has):
                        own, s = own[has], score[has]
                        best.offer(own, s, other[has] & (s >= low[own, None]) & (s <= high[own, None]), ids)
        window, ids, score = best.rows()
        columns = [window, block.id[at[window]], positive["id"][window], positive["score"][window], ids, score]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["window", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _first(found: DataFrame, key: str, score: str, its_id: str, k: int, name: str) -> DataFrame:
    """The first ``k`` of what tasks kept, numbered from 1."""
    order = Window.partitionBy(key).orderBy(F.desc(score), its_id)
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    rows: DataFrame,
    *,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    A score is the inner product of floor(``scale`` * x) of two rows; higher ones come first, ties by
    smaller id.  An anchor's positives are its first ``positives`` rows of the same label and another
    id; the negatives of a positive are the first ``negatives`` rows of another label whose score is
    between ``low`` and ``high`` per cent of the positive's.  A positive without any gives no row.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.  Only
    vectors of one length meet; empty ones score 0.  Every row counts, repeated ones too: a repeated
    anchor is answered as often as it is there, and a row that repeats an anchor's id is not another.
    Products are float64 where every score is below 2**53 and 64-bit integers beyond; where one may
    reach 2**63, ArithmeticError is raised.  Other columns are not looked at.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    bounds = usable.mapInArrow(_bounds(scale), "anchors long, dim long, norm double")
    n, dim, norm = bounds.agg(F.sum("anchors"), F.max("dim"), F.max("norm")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    if not norm < 2**63:  # |x y| <= |x| |y|, for parts of the sum too
        raise ArithmeticError(f"scores may reach {norm:g} and do not fit 64 bits")
    exact = norm < 2**53
    rounds = math.ceil(n * max(1, dim) * 8 / round_bytes)
    dealt = cut(usable.where("is_anchor").repartition(rounds).withColumn("round", F.spark_partition_id()), "anchors")
    candidates, results = usable.select("id", "label", "vector"), []
    for r in range(rounds):
        block = Block(dealt.where(F.col("round") == r).select("id", "label", "vector").toArrow(), scale)
        sent = spark.sparkContext.broadcast(block)
        kept = candidates.mapInArrow(_positives(sent, scale, exact, positives), "anchor long, id long, score long")
        # As many rows as the round has anchors, times the positives of one.
        best = _first(kept, "anchor", "score", "id", positives, "place").toArrow().to_pydict()
        best = {k: np.array(v, dtype=np.int64) for k, v in best.items()}
        best["place"] -= 1
        score = best["score"].astype(object)  # Python's integers: percentages of large scores
        windows = (np.array([-(-low * s // 100) for s in score], dtype=np.int64), np.array([high * s // 100 for s in score], dtype=np.int64))
        sent = spark.sparkContext.broadcast((block, best, *windows))
        kept = candidates.mapInArrow(_negatives(sent, scale, exact, negatives), "window long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        found = _first(kept, "window", "negative_score", "negative_id", negatives, "rank").selectExpr(*(x.split()[0] for x in out.split(", ")))
        results.append(found if rounds == 1 else cut(found, "negatives"))
    return results[0] if rounds == 1 else spark.read.schema(results[0].schema).parquet(*(x._written_to for x in results))
