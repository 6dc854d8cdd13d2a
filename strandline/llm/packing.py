"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length l belongs to class k = capacity // l, and a bin of class k
takes k pieces, no more and no fewer.  A document is cut so that each piece
nearly fills its share (within ``slack``): full sequences first, then the
largest reciprocal share below what is left, and so on, without slivers.  Classes are filled
per partition, without any exchange; what stands in unfinished bins when a
partition ends is packed best-fit, so a partition wastes about one sequence.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's memory of words; a full one keeps its oldest third.
REMEMBERED = 300_000

_PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pieces(length: int, capacity: int, slack: float, least: int = 1) -> list[tuple[int, int]]:
    """Piece lengths of a document, in order, each with its class.

    A piece fills its share to at least 1 - ``slack``.  None is shorter than
    ``least``, but for a document or a capacity that is shorter itself: where a cut
    would leave less, it is moved forward, or a smaller share is cut instead.
    """
    out, rest = [(capacity, 1)] * (length // capacity), length % capacity
    if out and 0 < rest < least:
        if capacity - (least - rest) >= (1 - slack) * capacity:
            out[-1], rest = (capacity - (least - rest), 1), least
        else:
            out.pop()
            rest += capacity
    while rest:
        k = capacity // rest
        if rest * k >= (1 - slack) * capacity or rest <= least:
            out.append((rest, k))
            break
        j = k + 1
        while True:
            share = capacity // j
            if rest - share < least:
                share = min(share, rest - least)
            if share >= (1 - slack) * capacity / j or share <= least:
                break
            j += 1
        share = max(share, min(least, rest))
        out.append((share, capacity // share))
        rest -= share
    return out


class Encoder:
    """Token ids of a text as little-endian 32-bit integers.

    The tokenizer lower-cases, splits by its pattern and encodes each part for
    itself, so parts met before are looked up and new ones are encoded together.
    This holds for texts of Latin letters (which are in normal form as they
    are) without an added token, such as an end mark written out; any other text
    goes to the tokenizer whole.
    """

    LATIN = 0x250

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        # The vocabulary file's split pattern, with its classes spelled out for
        # Latin text and its exclusive alternatives in order of frequency.
        of = lambda kind: "".join(re.escape(chr(i)) for i in range(self.LATIN) if unicodedata.category(chr(i))[0] == kind)
        letters, numbers = of("L"), of("N")
        self.split = re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.plain = re.compile("[\t\n\x0b\x0c\r -~\xa1-\u024f]*").fullmatch

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        ids = self._encode(" ".join(new))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(new):
            raw, begin = ids.tobytes(), 0
            for part, end in zip(new, (4 * cuts).tolist(), strict=True):
                self.parts[part] = raw[begin:end]
                begin = end
        else:
            for part in new:
                self.parts[part] = self._encode(part).tobytes()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for i in range(0, len(texts), 64):
            run = [t or "" for t in texts[i : i + 64]]
            # Some capitals have their small letter outside the Latin range, so both forms are tested.
            split = [self.split(low) if self.plain(t) and self.plain(low) and not any(a in low for a in self.added) else None for t, low in ((t, t.lower()) for t in run)]
            if len(self.parts) > REMEMBERED:
                # Common parts are met early, and dictionaries keep their order.
                self.parts = dict(islice(self.parts.items(), REMEMBERED // 3))
            known = self.parts
            new = set().union(*(x for x in split if x)).difference(known)
            if new:
                self._learn(list(new))
            for t, x in zip(run, split, strict=True):
                yield self._encode(t).tobytes() if x is None else b"".join([known[p] for p in x])


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One encoder a worker process; ``tokenizer`` is a path or a name of the public files."""
    if tokenizer not in _encoders:
        path = tokenizer
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _encoders[tokenizer] = Encoder(path)
    return _encoders[tokenizer]


def _packer(capacity: int, tokenizer: str, end_id: int, slack: float, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        open_bins: dict[int, list[tuple]] = {}
        end = int(end_id).to_bytes(4, "little")
        rows: list[tuple] = []
        size = 0

        def close(members: list[tuple]) -> None:
            nonlocal sequence, size
            offset = 0
            for doc, start, length, ids, total in members:
                rows.append((doc, start, length, ids, total, sequence, offset))
                offset += length
            size += 4 * offset
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            size = 0
            return batch

        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 256):
                docs = batch.column("doc_id")[at : at + 256].to_pylist()
                for doc, ids in zip(docs, encode(texts[at : at + 256].to_pylist()), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length, k in pieces(total, capacity, slack, least):
                        members = open_bins.setdefault(k, [])
                        members.append((doc, start, length, ids[4 * start : 4 * (start + length)], total))
                        start += length
                        if len(members) == k:
                            close(members)
                            open_bins[k] = []
                    if size > 1 << 24:
                        yield flush()
        # What is left: at most k - 1 pieces of each class.
        left = sorted((p for members in open_bins.values() for p in members), key=lambda p: -p[2])
        room: list[tuple[int, int]] = []  # (free, bin), ascending
        bins: list[list[tuple]] = []
        for p in left:
            i = bisect_left(room, (p[2], -1))
            if i < len(room):
                free, b = room.pop(i)
            else:
                free, b = capacity, len(bins)
                bins.append([])
            bins[b].append(p)
            if free > p[2]:
                insort(room, (free - p[2], b))
        for members in bins:
            close(members)
            if size > 1 << 24:
                yield flush()
        yield flush()

    return run


def harmonic_pack(docs: DataFrame, *, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, slack: float = 0.02, least_piece: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is one token, the end id.  A piece fills its class's share
    to 1 - ``slack``, and has ``least_piece`` tokens or its whole document.  Repeated rows
    are packed each for itself.  An empty table gives no rows; other columns are ignored.
    """
    if capacity < 1 or not 0 <= slack < 1 or not 1 <= least_piece <= max(1, capacity // 8):
        raise ValueError("capacity is at least 1, slack in [0, 1), the least piece at most an eighth of the capacity")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(capacity, tokenizer, end_id, slack, least_piece), _PACKED)
