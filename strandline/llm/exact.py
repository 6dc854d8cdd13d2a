"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (a bounded prefix of the
normalised text, its digest, the id) and sorted by (prefix, digest, whole text,
id), which spills to disk.  Equal texts then stand next to each other; a group
of any size is spread over as many partitions as its share asks for, because
the id ends the key.  Neighbours are compared in full.  Only the first and last
run of a partition can go on in another one; these edge runs (two a partition
at most) are matched by their whole texts in a second, small step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, partitions, whole_row

#: Characters of the text in the splitters' key: bounds what sampling sends to the driver.
PREFIX = 16

_RUNS = "doc_id long, digest binary, part int, run int, run_size long, run_low long, run_high long, edge boolean, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in a sorted partition.  A run's rows are held as ids
    and digests only, and no more of them than the partition has."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
    run, last = -1, None
    texts: dict[int, str] = {}
    for batch in batches:
        text = batch.column("norm")
        if not len(text):
            continue
        new = np.ones(len(text), dtype=bool)
        new[0] = last is None or text[0].as_py() != last
        if len(text) > 1:
            new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        ids = run + np.cumsum(new)
        if run < 0:
            texts[0] = text[0].as_py()
        run, last = int(ids[-1]), text[len(text) - 1].as_py()
        held.append((batch.column("doc_id"), batch.column("digest"), ids))
    if run < 0:
        return
    texts[run] = last
    runs = np.concatenate([x[2] for x in held])
    docs = pa.concat_arrays([x[0] for x in held])
    digests = pa.concat_arrays([x[1] for x in held])
    table = pa.table({"run": runs, "doc": docs}).group_by("run").aggregate([("doc", "min"), ("doc", "max"), ("run", "count")]).sort_by("run")
    low, high, size = (table.column(c).combine_chunks() for c in ("doc_min", "doc_max", "run_count"))
    step = 1 << 16
    for i in range(0, len(runs), step):
        r = runs[i : i + step]
        edge = (r == 0) | (r == run)
        at = pa.array(r)
        first = edge & ((np.arange(i, i + len(r)) == 0) | np.concatenate([[i == 0 or runs[i - 1] != r[0]], r[1:] != r[:-1]]))
        text = pa.array([texts[x] if f else None for x, f in zip(r.tolist(), first.tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [docs[i : i + step].cast(pa.int64()), digests[i : i + step], pa.array(np.full(len(r), part, np.int32)), at.cast(pa.int32()), size.take(at).cast(pa.int64()), low.take(at), high.take(at), pa.array(edge), text],
            names=["doc_id", "digest", "part", "run", "run_size", "run_low", "run_high", "edge", "edge_text"],
        )


def content_sort(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text to what is compared (default: the text itself);
    ``keep`` is "smallest" or "largest" id of a group.  A null text counts as
    empty.  Rows with the same id and text are copies of each other and share
    ``keep_id``; both are then marked kept.  A null id never stays unless all
    ids of its group are null.  An empty table gives an empty result; further
    columns of the input are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    norm = F.coalesce(normalise if normalise is not None else F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    keyed = keyed.withColumns({"head": F.substring("norm", 1, PREFIX), "digest": F.unhex(F.sha2("norm", 256))})
    dealt = keyed.repartitionByRange(partitions(spark), "head", "digest", "doc_id").sortWithinPartitions("head", "digest", "norm", "doc_id")
    runs = cut(dealt.select("doc_id", "digest", "norm").mapInArrow(_runs, _RUNS), "runs")
    edges = runs.where("edge_text is not null").select("part", "run", "edge_text", "run_size", "run_low", "run_high")
    whole = edges.groupBy("edge_text").agg(F.sum("run_size").alias("all_size"), F.min("run_low").alias("all_low"), F.max("run_high").alias("all_high"))
    # Two rows a partition at most, of six numbers each.
    joined = edges.join(whole, "edge_text").select("part", "run", "all_size", "all_low", "all_high")
    out = runs.drop("edge_text").join(F.broadcast(joined), ["part", "run"], "left")
    pick = "low" if keep == "smallest" else "high"
    keep_id = F.when(F.col("edge"), F.col(f"all_{pick}")).otherwise(F.col(f"run_{pick}"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(F.col("edge"), F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns.  Rows that share the id and the
    text of one that stays are reduced to one of them."""
    decided = content_sort(docs, id_col=id_col, text_col=text_col, **options).where("kept").groupBy(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    decided = cut(decided.agg(F.count("*").alias("_n")), "kept")
    norm = options.get("normalise")
    norm = F.coalesce(norm if norm is not None else F.col(text_col), F.lit(""))
    rows = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("_id"), F.sha2(norm, 256).alias("_own"))
    out = rows.join(decided, rows["_id"].eqNullSafe(decided["_keep"]) & (rows["_own"] == decided["_sha"]))
    if not decided.where("_n > 1").isEmpty():
        out = out.dropDuplicates(["_keep", "_sha"])
    return out.select("row.*")
