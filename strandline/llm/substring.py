"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, read in order of (id, place), in blocks: a
block is the text around one anchor, which is the run of a few words with the smallest
hash inside each window of ``window`` words.  A stretch of windows with one anchor
is a unit; its context is the text of all its windows.  The index has a row an
anchor: its first place in the corpus, and whether all its contexts are the same.

A document is factored greedily from left to right.  Each unit is looked up in the
index, and a factor (start, length, source, place there) goes on as long as the
next unit continues in the same source.  Where contexts of an anchor differ, factors
end or begin; such a boundary is checked window by window in an index of the
windows at boundaries, and goes on as far as the windows do.  Factors have
``window`` words at least; their union is what is removed.

Counts and minima are combined before every exchange, so a passage of any
frequency is one row a partition there; the joins back are on keys whose other
side is unique, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Words, chained, cut, mix, partitions, text_slices, _power_tables

#: Words of a window at least.
LEAST = 5

#: What a document's mark says of its units with an anchor: all have the source's context, or contexts differ.
_COVERED, _BOUNDARY = 1, 2
_MARK = np.uint64(3)


def anchor_words(window: int) -> int:
    """Words of an anchor: so many that unlike texts seldom share one, so few that a window has many."""
    return max(2, min(6, window // 3))


class _Units:
    """Stretches of windows with one anchor, over the words of some texts."""

    def __init__(self, words: Words, window: int):
        h = words.hashes()
        n = len(h)
        self.hashes = h
        sizes = np.diff(words.bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        # Windows that lie inside one text.
        ends = np.repeat(words.bounds[1:], sizes)
        starts = np.flatnonzero(np.arange(n) + window <= ends)
        if not len(starts):
            self.first = self.last = self.text = self.place = np.empty(0, dtype=np.int64)
            self.anchor = self.context = np.empty(0, dtype=np.uint64)
            return
        size_of = anchor_words(window)
        grams = chained(h, size_of)
        span = window - size_of + 1
        best = np.arange(len(grams))
        size = 1
        while size < span:  # the leftmost smallest gram of stretches of growing size
            more = min(size, span - size)
            a, b = best[: len(best) - more], best[more:]
            best = np.where(grams[a] <= grams[b], a, b)
            size += more
        at = best[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (text[starts[1:]] != text[starts[:-1]])
        begin = np.flatnonzero(new)
        self.first = starts[begin]
        self.last = starts[np.append(begin[1:], len(starts)) - 1]
        self.text = text[self.first]
        self.place = at[begin]
        # The low bits are left for marks.
        self.anchor = grams[self.place] & ~_MARK
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * power[:n], out=total[1:])
        body = (total[self.last + window] - total[self.first]) * inverse[self.first]
        shape = ((self.last - self.first) * 64 + (self.place - self.first)).astype(np.uint64)
        self.context = mix(body + mix(shape))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _leaders(*keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each item, the item with equal keys that starts first."""
    order = np.lexsort((start, *keys[::-1]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    return out


def _anchors(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text and anchor: the smallest and largest context there, and the first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                u = _Units(words, window)
                if not len(u.first):
                    continue
                order = np.lexsort((u.first, u.anchor, u.text))
                t, a = u.text[order], u.anchor[order]
                new = np.ones(len(t), dtype=bool)
                new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1])
                begin = np.flatnonzero(new)
                c, lead = u.context.view(np.int64)[order], order[begin]
                docs = batch.column("doc_id")[first:end].take(pa.array(t[new]))
                at = (u.place - words.bounds[u.text])[lead].astype(np.int32)
                lo, hi = np.minimum.reduceat(c, begin), np.maximum.reduceat(c, begin)
                yield pa.RecordBatch.from_arrays([_signed(a[new]), pa.array(lo), pa.array(hi), pa.array(at), docs], names=["anchor", "lo", "hi", "at", "doc_id"])

    return run


def _joined_keys(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key) ^ mix(text.astype(np.uint64) + np.uint64(1))


def _looked_up(lists: pa.Array, field: str, text: np.ndarray, wanted: np.ndarray, low_bits: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Where each (text, wanted key) stands in the lists of structs by text: whether it is there,
    its place in the flattened lists, and their fields."""
    columns = lists.flatten()
    fields = dict(zip([f.name for f in columns.type], (x.to_numpy(zero_copy_only=False) for x in columns.flatten()), strict=True))
    if not len(columns) or not len(wanted):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64), fields
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    own = fields[field].view(np.uint64) & ~low_bits
    keys, asked = _joined_keys(of, own), _joined_keys(text, wanted)
    order = np.argsort(keys)
    hit = order[np.minimum(np.searchsorted(keys, asked, sorter=order), len(keys) - 1)]
    return (keys[hit] == asked) & (of[hit] == text) & (own[hit] == wanted), hit, fields


class _Parse:
    """Units of some texts, told apart by the texts' marks."""

    def __init__(self, batch: pa.RecordBatch, first: int, end: int, data: np.ndarray, offsets: np.ndarray, window: int):
        self.words = Words(data, offsets)
        self.units = u = _Units(self.words, window)
        known, hit, fields = _looked_up(batch.column("marks")[first:end], "code", u.text, u.anchor, _MARK)
        code = np.zeros(len(hit), dtype=np.int64)
        self.source, self.at = code.copy(), code.copy()
        if known.any():
            h = hit[known]
            code[known] = (fields["code"].view(np.uint64)[h] & _MARK).astype(np.int64)
            self.source[known], self.at[known] = fields["source"][h], fields["at"][h]
        # A text without an id is in no index: only its own windows are compared.
        nameless = batch.column("doc_id")[first:end].is_null().to_numpy(zero_copy_only=False)[u.text]
        self.covered = code == _COVERED
        self.boundary = (code == _BOUNDARY) | nameless
        self.unmarked = (code == 0) & ~nameless
        picked = np.flatnonzero(self.boundary)
        lengths = u.last[picked] - u.first[picked] + 1
        begin = np.concatenate([[0], np.cumsum(lengths)])
        #: Start, text and hashes of the windows of boundary units.
        self.starts = np.repeat(u.first[picked] - begin[:-1], lengths) + np.arange(begin[-1])
        self.text = np.repeat(u.text[picked], lengths)
        self.key, self.check = (chained(u.hashes, window, *q)[self.starts] if len(self.starts) else np.empty(0, dtype=np.uint64) for q in ((), (0xA24BAED4963EE407,)))
        self.check = self.check >> np.uint64(33)
        self.leader = _leaders(self.text, self.key, self.check, start=self.starts)

    def local(self, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Places in the text itself."""
        return start - self.words.bounds[text]


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text and window at its boundaries, with the first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("edges").fill_null(False))
            for first, end, data, offsets in text_slices(batch.column("text")):
                p = _Parse(batch, first, end, data, offsets, window)
                own = np.flatnonzero(p.leader == np.arange(len(p.leader)))
                if not len(own):
                    continue
                docs = batch.column("doc_id")[first:end].take(pa.array(p.text[own]))
                at = p.local(p.starts, p.text)[own].astype(np.int32)
                yield pa.RecordBatch.from_arrays([_signed(p.key[own]), pa.array(p.check[own].astype(np.int32)), docs, pa.array(at)], names=["key", "check", "doc_id", "at"])

    return run


def _factors(p: _Parse, batch: pa.RecordBatch, first: int, end: int, window: int) -> tuple[np.ndarray, ...]:
    """Start, end, text, source text (-1: the text itself), source id and place of the factors, by start."""
    u = p.units
    leader = _leaders(u.text, u.anchor, start=u.first)
    again = p.unmarked & (leader != np.arange(len(leader)))
    known, hit, fields = _looked_up(batch.column("covered")[first:end], "key", p.text, p.key)
    repeated = ~known & (p.leader != np.arange(len(p.leader)))
    h = hit[known]
    start = np.concatenate([u.first[p.covered], u.first[again], p.starts[known], p.starts[repeated]])
    stop = np.concatenate([u.last[p.covered], u.last[again], p.starts[known], p.starts[repeated]]) + window
    text = np.concatenate([u.text[p.covered], u.text[again], p.text[known], p.text[repeated]])
    own = np.concatenate([np.zeros(p.covered.sum(), bool), np.ones(again.sum(), bool), np.zeros(known.sum(), bool), np.ones(repeated.sum(), bool)])
    nothing = np.zeros(0, dtype=np.int64)
    source = np.concatenate([p.source[p.covered], np.zeros(again.sum(), np.int64), fields["source"][h] if len(h) else nothing, np.zeros(repeated.sum(), np.int64)])
    place = np.concatenate(
        [
            (p.at - (u.place - u.first))[p.covered],
            p.local(u.first[leader], u.text)[again],
            fields["at"][h].astype(np.int64) if len(h) else nothing,
            p.local(p.starts[p.leader], p.text)[repeated],
        ]
    )
    order = np.argsort(start, kind="stable")
    start, stop, text, own, source, place = (x[order] for x in (start, stop, text, own, source, place))
    # Greedy: a factor goes on while the next piece continues in the same source.
    new = np.ones(len(start), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1]) | (source[1:] != source[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (start[1:] > stop[:-1])
    begin = np.flatnonzero(new)
    return start[begin], np.maximum.reduceat(stop, begin) if len(begin) else stop, text[begin], own[begin], source[begin], place[begin]


_FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("place", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _lists(of: np.ndarray, n: int, fields: pa.DataType, columns: list[pa.Array]) -> pa.Array:
    """Structs, ordered by the text they are of, as one list a text."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(fields)))


def _factored(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                p = _Parse(batch, first, end, data, offsets, window)
                words, docs = p.words, batch.column("doc_id")[first:end]
                start, stop, text, own, source, place = _factors(p, batch, first, end, window)
                edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                removed = np.cumsum(edge[:-1]) > 0
                count = np.concatenate([[0], np.cumsum(removed)])[words.bounds]
                ids = pa.array(source)
                if own.any():
                    ids = pc.if_else(pa.array(own), docs.take(pa.array(text)), ids)
                factors = _lists(text, end - first, _FACTOR, [pa.array(p.local(start, text)), pa.array(stop - start), ids, pa.array(place)])
                # Factors that meet or overlap are one span.
                reach = np.maximum.accumulate(stop) if len(stop) else stop
                new = np.ones(len(start), dtype=bool)
                new[1:] = (start[1:] > reach[:-1]) | (text[1:] != text[:-1])
                begin = np.flatnonzero(new)
                upto = np.maximum.reduceat(stop, begin) if len(begin) else stop
                spans = _lists(text[begin], end - first, _SPAN, [pa.array(p.local(start[begin], text[begin])), pa.array(p.local(upto, text[begin]))])
                raw, kept = data.tobytes(), []
                for i in range(end - first):
                    own_words = raw[offsets[i] : offsets[i + 1]].split()
                    if count[i + 1] > count[i]:
                        gone = removed[words.bounds[i] : words.bounds[i + 1]].tolist()
                        own_words = [w for w, g in zip(own_words, gone, strict=True) if not g]
                    kept.append(b" ".join(own_words))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.diff(words.bounds), pa.int64()), pa.array(np.diff(count), pa.int64()), factors, spans, pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "factors", "spans", "kept_text"],
                )

    return run


def parse_repeats(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, factors (start, length, source id and
    place there, in words), spans (word ranges that are removed, end exclusive), kept_text (kept
    words joined by one space).

    A word goes if a window of ``window`` words over it also starts earlier: in
    a smaller id, or earlier in its own text.  Null and empty texts have no
    words.  Of rows with one id none is earlier than the other, and a source's place is
    in one of them; a row with a null id is earlier than none, only repeats within itself are
    found, and their source is null.  An empty table gives no rows.
    """
    if window < LEAST:
        raise ValueError(f"window is {LEAST} words at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    anchors = rows.mapInArrow(_anchors(window), "anchor long, lo long, hi long, at int, doc_id long").where("doc_id is not null")
    index = anchors.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("at"), F.count("*").alias("n"))
    index = index.where("lo <> hi or n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"), "source", "at")
    marks = anchors.select("anchor", "doc_id").join(index, "anchor").where("mixed or doc_id > source")
    code = F.col("anchor") + F.when(F.col("mixed"), _BOUNDARY).otherwise(_COVERED)
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct(code.alias("code"), "source", "at")).alias("marks"), F.bool_or("mixed").alias("edges"))
    marks = cut(marks, "marks", free=True)
    texts = rows.repartition(partitions(docs.sparkSession), "doc_id")
    # Nothing is filtered here: all readers of ``marked`` have one plan, so that texts move once.
    marked = texts.join(marks, "doc_id", "left")
    windows = marked.mapInArrow(_windows(window), "key long, check int, doc_id long, at int")
    firsts = windows.groupBy("key", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("at")).where("source <> last").drop("last")
    covered = windows.select("key", "check", "doc_id").join(firsts, ["key", "check"]).where("doc_id > source")
    covered = covered.groupBy("doc_id").agg(F.collect_list(F.struct("key", "source", "at")).alias("covered"))
    out = "doc_id long, n_words long, n_removed long, factors array<struct<start: long, length: long, source: long, place: long>>, spans array<struct<start: long, end: long>>, kept_text string"
    return marked.join(covered, "doc_id", "left").mapInArrow(_factored(window), out)
