"""How filters interact: outcomes of every order of application, by one matrix product.

A document's failures are a mask of five bits.  Each part of the corpus is three
histograms over the 32 masks: all documents, good ones, toxic ones.  What a filter does at
a step of an order depends on the mask alone, so every outcome is a matrix of 32 masks by
600 (order, step) pairs of zeros and ones, and the audit of all parts is their stacked
histograms times these matrices.  Only the histograms depend on the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import pieces, utf8

#: The filters in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Documents' histograms of so many parts are multiplied at a time.
PARTS = 64


@dataclass(frozen=True)
class Rules:
    """A: fewer than ``words`` words; B: distinct words below ``distinct`` per cent; C: capitals A to Z above
    ``upper`` per cent of the characters; D: any of ``symbols``.  E, a copy of an earlier text, has no parameter."""

    words: int = 100
    distinct: int = 80
    upper: int = 10
    symbols: bytes = b"#$%&*|"

    def fails(self, raw: bytes, characters: int) -> int:
        """Bits of A to D."""
        if len(raw) <= 1 << 22:
            words = raw.split()  # bytes are split at ASCII white space
            n, distinct = len(words), len(set(words))
        else:
            n, met = 0, set()
            for piece in pieces(raw):
                words = piece.split()
                n += len(words)
                met.update(words)
            distinct = len(met)
        capitals = len(raw) - len(raw.translate(None, _UPPER))
        with_symbols = len(raw.translate(None, self.symbols)) < len(raw)
        return (n < self.words) | (100 * distinct < self.distinct * n) << 1 | (100 * capitals > self.upper * characters) << 2 | with_symbols << 3


def outcomes() -> dict[str, np.ndarray]:
    """Matrices of 32 masks by (order, step): whether a document of a mask is kept after the step, removed by
    it, fails its filter though removed before, or fails its filter alone."""
    masks = np.arange(1 << len(FILTERS))[:, None]
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    until = np.cumsum(bits, axis=1).ravel()
    own = bits.ravel()
    fails, before = (masks & own) > 0, (masks & (until - own)) > 0
    found = {"kept": (masks & until) == 0, "removed": fails & ~before, "redundant": fails & before, "unique_fails": np.broadcast_to(masks == own, fails.shape)}
    return {k: v.astype(np.int64) for k, v in found.items()}


def _flags(rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            raws, sizes = text.cast(pa.binary()), pc.utf8_length(text).to_numpy(zero_copy_only=False)
            fails, digests = [], []
            for raw, size in zip(raws, sizes, strict=True):
                raw = raw.as_py()
                fails.append(rules.fails(raw, int(size)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], names=["id", "part", "digest", "fails"])

    return run


def histograms(docs: DataFrame, labels: DataFrame, *, rules: Rules = Rules(), part_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail.

    A document is good (toxic) if any label row of its id says 1.  Of equal texts those with the
    smallest id pass E, all others fail it; documents without an id are neither earlier nor later
    than any, pass E and have no label.  Null parts and texts count as empty.  Texts move as
    digests; copies are counted before they meet, so that a group of them is a few rows.
    """
    read = docs.select(F.col(id_col).alias("id"), utf8(part_col).alias("part"), utf8(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    flags = read.mapInArrow(_flags(rules), f"id {kind}, part string, digest binary, fails int")
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    # The label table's size decides how they meet; rows of one id are split by adaptive execution.
    joined = flags.join(told, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["digest", "fails", "part", "good", "toxic"]
    by_id = joined.groupBy(*kinds, "id").agg(F.count("*").alias("n"))
    without = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    by_text = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), without.alias("no_id"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    first = F.min("first").over(Window.partitionBy("digest"))  # as many rows as a text has parts and labels
    passed = F.col("no_id") + F.when(F.col("first") == first, F.col("n_first")).otherwise(0)
    last = 1 << (len(FILTERS) - 1)
    split = F.explode(F.array(F.struct(F.col("fails").alias("mask"), F.col("passed").alias("n")), F.struct((F.col("fails") + last).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    split = by_text.withColumn("passed", passed).select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.mask", "s.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matrices, steps = outcomes(), len(FILTERS)
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    of_filter = (own[:, None] == np.arange(steps)).astype(np.int64)
    orders = pa.array([order for order in ORDERS for _ in FILTERS])
    step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS)))
    for whole in batches:
        for at in range(0, len(whole), PARTS):
            batch = whole.slice(at, PARTS)
            n = len(batch)
            stacked = np.zeros((3, n, 1 << steps), dtype=np.int64)
            for i, cells in enumerate(batch.column("cells").to_pylist()):
                for c in cells:
                    stacked[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            found = {name: stacked[0] @ m for name, m in matrices.items()}
            found |= {"good_lost": stacked[1] @ matrices["removed"], "toxic_lost": stacked[2] @ matrices["removed"]}
            found["shapley"] = (found["removed"] @ of_filter)[:, own]
            parts = batch.column("part").take(pa.array(np.repeat(np.arange(n), len(own))))
            columns = [parts, pa.concat_arrays([orders] * n), pa.concat_arrays([step] * n), *(pa.array(found[c].ravel()) for c in _COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *_COUNTS])


def interactions(counted: DataFrame) -> DataFrame:
    """One row, zeros included, for each part, order and step of ``histograms``: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  A table without rows has no parts."""
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")  # 32 at most
    return counted.groupBy("part").agg(cells).mapInArrow(_products, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))
