"""Fingerprints by one-permutation MinHash.

A text is the set of its shingles of five words.  Each shingle is hashed once; the hash's
top bits choose a bin, and a bin keeps its smallest hash.  An empty bin walks the bins in
an order of its own, a fixed random permutation, and takes the value of the first full one
(optimal densification: any full bin is as likely as any other, and two sets walk alike).
The fingerprint packs the low four bits of each bin.  Bins of different shingles agree by chance
once in 2**4 times, which the estimate corrects.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Words, chained, cut, mix, partitions, pieces, text_slices, utf8, whole_row

SHINGLE = 5
#: Bins, a power of two, and the bits kept of each: 256 bytes a text.
BINS, BITS = 512, 4
#: Steps of the walk that are taken for many texts at once; the few bins left then are filled text by text.
WALK = 12
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE_CHUNK = 1 << 20


@lru_cache
def walks() -> tuple[np.ndarray, np.ndarray]:
    """Each bin's order of all bins, and each bin's place in it."""
    seeds = np.arange(BINS * BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mix(seeds + np.uint64(0x5851F42D4C957F2D)).reshape(BINS, BINS), axis=1, kind="stable")
    return order, np.argsort(order, axis=1)


def _shingles(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer words than a shingle has is one, of all its words."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(h)) + SHINGLE <= bounds[1:][text])
    value = chained(h, SHINGLE)[starts] if len(starts) else np.empty(0, dtype=np.uint64)
    text = text[starts]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    own = np.array([mix(chained(h[bounds[i] : bounds[i + 1]], int(sizes[i])) + np.uint64(sizes[i]))[0] for i in short], dtype=np.uint64)
    return np.concatenate([text, short]), np.concatenate([value, own])


def _smallest(best: np.ndarray, text: np.ndarray, value: np.ndarray) -> None:
    np.minimum.at(best, text * BINS + (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), value)


def minima(column: pa.Array) -> np.ndarray:
    """A row of bins' smallest hashes for each text; empty bins hold the largest number.  A long text goes
    in pieces, each with the last words of the one before."""
    table = np.full((len(column), BINS), _NEVER, dtype=np.uint64)
    for first, end, data, offsets in text_slices(column, _ONE_CHUNK):
        best = table[first:end].reshape(-1)  # a view
        if len(data) <= 2 * _ONE_CHUNK:
            words = Words(data, offsets)
            _smallest(best, *_shingles(words.hashes(), words.bounds))
            continue
        carried, n_words = np.empty(0, dtype=np.uint64), 0
        for piece in pieces(data.tobytes(), _ONE_CHUNK):
            h = Words(np.frombuffer(piece, dtype=np.uint8), np.array([0, len(piece)])).hashes()
            n_words += len(h)
            h = np.concatenate([carried, h])
            if len(h) >= SHINGLE:
                value = chained(h, SHINGLE)
                _smallest(best, np.zeros(len(value), dtype=np.int64), value)
            carried = h[-(SHINGLE - 1) :]
        if 0 < n_words < SHINGLE:
            _smallest(best, *_shingles(carried, np.array([0, n_words])))
    return table


def densified(table: np.ndarray) -> np.ndarray:
    """The table with every empty bin filled, but for texts that have no shingle."""
    full = table != _NEVER
    order, place = walks()
    out = table.copy()
    text, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    for step in range(WALK):
        if not len(text):
            return out
        at = order[empty, step]
        found = full[text, at]
        out[text[found], empty[found]] = table[text[found], at[found]]
        text, empty = text[~found], empty[~found]
    bounds = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
    for first, end in zip(bounds[:-1], bounds[1:], strict=True):
        filled = np.flatnonzero(full[text[first]])
        own = empty[first:end]
        out[text[first], own] = table[text[first], filled[np.argmin(place[np.ix_(own, filled)], axis=1)]]
    return out


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of bytes, two bins each, and which texts have a shingle."""
    table = densified(minima(column))
    low = (table & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, ::2] << BITS | low[:, 1::2], table[:, 0] != _NEVER


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarities of two columns of fingerprints: the share of equal bins, less what
    agrees by chance.  A text without words is like such texts alone."""
    differs = a[0] ^ b[0]
    equal = ((differs & 15) == 0).sum(axis=1) + ((differs >> BITS) == 0).sum(axis=1)
    chance = 2.0**-BITS
    estimate = np.clip((equal / BINS - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a[1] & b[1], estimate, (a[1] == b[1]).astype(np.float64))


def _raw(rows: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    return [x.tobytes() if some else b"" for x, some in zip(*rows, strict=True)]


def _read(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    none = bytes(BINS * BITS // 8)
    raws = [base64.b64decode(x) if x else none for x in column]
    return np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(len(raws), len(none)), np.array([bool(x) for x in column], dtype=bool)


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likeness(_read(a), _read(b)))


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null counts as a text without words."""
    return F.pandas_udf(_likeness, "double")(a, b)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, _, _ in text_slices(batch.column("_fingerprinted")):
            rows = batch.slice(first, end - first)
            text = rows.column("_fingerprinted")
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array([base64.b64encode(x).decode() for x in _raw(packed(text))])], names=["row", "fingerprint"])


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """row (all columns of ``docs`` as one struct) and fingerprint, a string: base64, or empty for a text
    without words (null counts as such).  Equal texts have equal fingerprints; no row moves."""
    read = docs.select(whole_row(docs), utf8(text_col).alias("_fingerprinted"))
    return read.mapInArrow(_fingerprints, f"row {read.schema['row'].dataType.simpleString()}, fingerprint string")


# ------------------------------------------------------- a text, its edit and its neighbour

_FACTS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_FACTS_SCHEMA = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of ``text``'s code points, rounded down, replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _facts(texts: list[str], following: list[str], own: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    edits = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    changed = packed(pa.array(edits, pa.large_string()))
    columns = [[len(t) for t in texts], [hashlib.sha256(e.encode()).digest() for e in edits], _raw(own), _raw(changed), likeness(own, changed), likeness(own, after)]
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _FACTS, strict=True)]


def _rows(ids: pa.Array, facts: list[pa.Array], part: int, kind: int, raw: pa.Array | None = None) -> pa.RecordBatch:
    n = len(ids)
    facts = facts or [pa.nulls(n, t) for _, t in _FACTS]
    raw = pa.nulls(n, pa.string()) if raw is None else raw.cast(pa.string())
    columns = [ids, *facts, pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), raw]
    return pa.RecordBatch.from_arrays(columns, names=["id", *(name for name, _ in _FACTS), "part", "kind", "raw"])


_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of all rows of a partition but the last, whose text is put out for itself, like the first one's."""
    part, held = None, None
    for batch in batches:
        for first, end, _, _ in text_slices(batch.column("text")):
            rows = batch.slice(first, end - first)
            ids, texts = rows.column("id"), rows.column("text").cast(pa.large_string())
            if part is None:
                part = rows.column("part")[0].as_py()
                yield _rows(ids[:1], [], part, _HEAD, texts[:1])
            if held is not None:
                ids, texts = pa.concat_arrays([held[0], ids]), pa.concat_arrays([held[1], texts])
            if len(ids) > 1:
                plain, (prints, some) = texts.to_pylist(), packed(texts)
                yield _rows(ids[:-1], _facts(plain[:-1], plain[1:], (prints[:-1], some[:-1]), (prints[1:], some[1:])), part, _WHOLE)
            held = (pa.concat_arrays([ids[-1:]]), pa.concat_arrays([texts[-1:]]))
    if held is not None:
        yield _rows(held[0], [], part, _TAIL, held[1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, after = batch.column("raw"), batch.column("following")
        yield pa.RecordBatch.from_arrays([batch.column("id"), *_facts(own.to_pylist(), after.to_pylist(), packed(own), packed(after))], names=["id", *(name for name, _ in _FACTS)])


def edit_facts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow one another by id (null first), then by a hash of the text; after the last comes the
    first, which may be the document itself.  A null text counts as empty.  Rows equal in id and text
    may stand in either order; they give equal rows but for the last of them.  Whole texts move once, to
    ranges of ids; a range is read as a stream that holds one text beside the batch, and where ranges
    meet, one text of each side is joined.  What is written in between holds bytes, not their text form.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = read.repartitionByRange(partitions(spark), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text", F.spark_partition_id().alias("part"))
    kind = read.schema["id"].dataType.simpleString()
    passed = cut(dealt.mapInArrow(_neighbours, f"id {kind}, {_FACTS_SCHEMA}, part int, kind int, raw string"), "fingerprints")
    heads = passed.where(F.col("kind") == _HEAD)
    # One number for each partition: the next one that has rows, after the last the first.
    following = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    meets = passed.where(F.col("kind") == _TAIL).select("id", "raw", "part").join(following, "part")
    meets = meets.join(heads.select(F.col("part").alias("next"), F.col("raw").alias("following")), "next")
    ends = meets.select("id", "raw", "following").mapInArrow(_ends, f"id {kind}, {_FACTS_SCHEMA}")
    out = passed.where(F.col("kind") == _WHOLE).select("id", *(name for name, _ in _FACTS)).unionByName(ends)
    as_text = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": F.base64("fingerprint"), "edited_fingerprint": F.base64("edited_fingerprint")}
    return out.withColumns(as_text).withColumnRenamed("id", id_col)
