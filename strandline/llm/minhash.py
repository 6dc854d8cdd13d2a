"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the weighted set of its word shingles, weights being counts.  Each
shingle sends arrivals of a Poisson process of its weight's rate into random
registers; a register keeps the earliest, and a shingle stops once its next
arrival is later than every register.  Two texts agree in a register with the
probability Jaccard of their sets.  Bands of registers give candidates, which
are verified exactly on the whole texts.

Copies of one text are one node.  Within a bucket no list of all pairs is made:
every node is first verified against the smallest node it shares a bucket with.
Then a bucket's largest component and all other members are dealt out in blocks,
and the others are compared by finer signatures, block by block, with what is not of
their component.  Each node's best partners go to verification, few at first, then
all that are left, and none that the links found so far have joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Words, chained, cut, discard, mix, partitions, text_slices, utf8
from strandline.llm.components import components

#: Members of a bucket in one block; a task compares two of them.
BLOCK = 4096
#: From this many members on a bucket has a few blocks, so that several tasks share it.
SHARED, FEW_BLOCKS = 512, 3
#: Partners that a node puts forward in one group and round, best first.  When less than half of
#: a round's pairs are links, all that is left follows at once.
FEW = 2
#: Registers of the candidates' own, finer signatures.
FINE = 1024


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of all distinct shingles, by text, then hash.

    A text of fewer than ``k`` words is one shingle, of all its words.
    """
    h = words.hashes()
    sizes = np.diff(words.bounds)
    ends = np.repeat(words.bounds[1:], sizes)
    starts = np.flatnonzero(np.arange(len(h)) + k <= ends)
    text = np.repeat(np.arange(len(sizes)), sizes)[starts]
    value = chained(h, k)[starts] if len(starts) else np.empty(0, dtype=np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        own = np.array([chained(h[words.bounds[i] : words.bounds[i + 1]], int(sizes[i]))[0] + np.uint64(sizes[i]) for i in short], dtype=np.uint64)
        text, value = np.concatenate([text, short]), np.concatenate([value, own])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if not len(text):
        return text, value, np.empty(0)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text))).astype(np.float64)


def prob_minhash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """An n x registers table of the winning shingles' low 32 bits."""
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * registers, never, dtype=np.uint64)
    latest = np.full(n, never >> np.uint64(32), dtype=np.uint64)
    time = np.zeros(len(text))
    low = value & np.uint64(0xFFFFFFFF)
    arrival = 0
    while len(text):
        u = mix(value + np.uint64((arrival * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(u >> np.uint64(11)).astype(np.float64) / (1 << 53)) / weight
        register = (mix(u ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        when = time.astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(best, text * registers + register, (when << np.uint64(32)) | low)
        arrival += 1
        if arrival < 6 or arrival % 8 == 0:
            active = np.unique(text)
            latest[active] = best.reshape(n, registers)[active].max(axis=1) >> np.uint64(32)
        go = when <= latest[text]
        if not go.all():
            text, value, weight, time, low = text[go], value[go], weight[go], time[go], low[go]
    return (best & np.uint64(0xFFFFFFFF)).reshape(n, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum over common x of 1 / sum over y of max(a(y)/a(x), b(y)/b(x)), exactly."""
    keys, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    wa, wb = np.zeros(len(keys)), np.zeros(len(keys))
    wa[inverse[: len(a[0])]] = a[1]
    wb[inverse[len(a[0]) :]] = b[1]
    common = (wa > 0) & (wb > 0)
    if not common.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / wb, np.inf)
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    # Elements of a ratio at least that of x count by a(y)/a(x), the others by b(y)/b(x).
    from_a = np.append(np.cumsum(wa[order][::-1])[::-1], 0.0)
    until_b = np.append(0.0, np.cumsum(wb[order]))
    at = np.searchsorted(r, ratio[common], "left")
    return float((1.0 / (from_a[at] / wa[common] + until_b[at] / wb[common])).sum())


def _eight_bits(table: np.ndarray) -> pa.Array:
    """Signatures for comparison keep eight bits a register."""
    small = np.ascontiguousarray((table ^ (table >> np.uint64(8)) ^ (table >> np.uint64(16))).astype(np.uint8))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(table.shape[1]), len(table), [None, pa.py_buffer(small)]).cast(pa.binary())


def _signatures(k: int, registers: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rows = registers // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text"), 1 << 21):
                n = end - first
                text, value, weight = shingles(Words(data, offsets), k)
                table = prob_minhash(text, value, weight, n, registers)
                key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, axis=0)
                parts = table[:, : bands * rows].reshape(n, bands, rows)
                for j in range(rows):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
                some = np.zeros(n, dtype=bool)
                some[text] = True
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], batch.column("digest")[first:end], pa.array(some), lists], names=["doc_id", "digest", "some", "bands"])

    return run


def _fine_signatures(k: int, registers: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text"), 1 << 21):
                table = prob_minhash(*shingles(Words(data, offsets), k), end - first, registers)
                yield pa.RecordBatch.from_arrays([batch.column("id")[first:end], _eight_bits(table)], names=["id", "signature"])

    return run


def _verifier(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, end, data, offsets in text_slices(column):
            text, value, weight = shingles(Words(data, offsets), k)
            cuts = np.searchsorted(text, np.arange(end - first + 1))
            for i in range(end - first):
                yield value[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = [probability_jaccard(x, y) for x, y in zip(sets(batch.column("text_a")), sets(batch.column("text_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the runs of equal keys in sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(starts, starts[1:], strict=False):
            key = tuple(c[x] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(x, y - x))
            last = key
    if held:
        yield pa.concat_tables(held)


#: What a row is in its group: of the largest component; or of the others, on its one side, within
#: one block, or on its other side.
_LARGEST, _ONE_SIDE, _WITHIN, _OTHER_SIDE = 0, 1, 2, 3


def _put_forward(least: float, few: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of different components whose signatures agree enough, and how far each node has come.

    A node goes through its partners in a fixed order, that of the time when blocks were dealt, from
    its cursor on; those of its own component by now are passed over.
    """
    names = ("a", "b", "key", "block", "id", "cursor")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("key", "block")):
            ids, first, label, role, star, cursor = (np.asarray(group.column(c)) for c in ("id", "first_label", "label", "role", "star", "cursor"))
            table = np.stack([np.frombuffer(x, dtype=np.uint8) for x in group.column("signature").to_pylist()])
            key, block = group.column("key")[0].as_py(), group.column("block")[0].as_py()
            keys = [set(k) for k in group.column("keys").to_pylist()]
            rows: list[tuple] = []
            facing = {_ONE_SIDE: (role == _LARGEST) | (role == _OTHER_SIDE), _WITHIN: (role == _LARGEST) | (role == _WITHIN), _OTHER_SIDE: role == _ONE_SIDE}
            for i in np.flatnonzero(role != _LARGEST):
                at = np.flatnonzero(facing[role[i]] & (first != first[i]) & (ids != star[i]) & (star != ids[i]))
                agree = (table[at] == table[i]).mean(axis=1)
                at, agree = at[agree >= least], agree[agree >= least]
                at = at[np.lexsort((ids[at], -agree))]
                apart = np.flatnonzero(label[at] != label[i])
                apart = apart[apart >= cursor[i]][:few]
                for j in at[apart]:
                    # At last a pair comes from one side, and from the first bucket it shares only.
                    once = role[j] == _LARGEST or role[i] == _ONE_SIDE or (role[i] == _WITHIN and ids[i] < ids[j])
                    if few is not None or (once and min(keys[i] & keys[j]) == key):
                        rows.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), None, None, None, None))
                if few is not None and len(apart):
                    rows.append((None, None, key, block, int(ids[i]), int(apart[-1]) + 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b, similarity of the pairs.  A node may be in a third of them: the joins'
    other side has one row a node, so adaptive execution can split the hot one."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return cut(both.mapInArrow(_verifier(k), "a long, b long, similarity double"), "verified")


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, registers: int = 125, bands: int = 25, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, class_id (the smallest id of its class), kept (is it that one).

    Classes are the components of links of probability Jaccard ``threshold`` or
    more.  Null and empty texts, and texts without words, are alike only to
    equal texts.  Rows of one id are one document.  A null id is in no class:
    class_id is null and the row is kept.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    signed = rows.mapInArrow(_signatures(shingle, registers, bands), "doc_id long, digest binary, some boolean, bands array<long>")
    signed = cut(signed, "signatures")
    # Copies are one node; equal texts have equal signatures.
    nodes = signed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("some").alias("some"), F.first("bands").alias("bands"))
    nodes = cut(nodes, "nodes")
    placed = nodes.where("some").select("id", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    members = cut(placed.join(shared, "key"), "members")
    wanted = members.select("id").distinct()
    wanted = nodes.join(wanted, "id", "left_semi").select("id", F.col("digest").alias("own"))
    texts = rows.join(wanted, rows["doc_id"] == wanted["id"]).where("digest = own").groupBy("id").agg(F.first("text").alias("text"))
    texts = cut(texts, "texts")
    shared_keys = members.groupBy("id").agg(F.collect_set("key").alias("keys"))
    signatures = cut(texts.mapInArrow(_fine_signatures(shingle, FINE), "id long, signature binary").join(shared_keys, "id"), "candidates")

    stars = cut(members.groupBy("id").agg(F.min("low").alias("star")).where("star < id"), "stars")
    verified = _verified(stars.select(F.col("star").alias("a"), F.col("id").alias("b")), texts, shingle)
    # Four and a half standard deviations below the threshold.
    least = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / FINE)
    links = verified.where(F.col("similarity") >= threshold)
    labels = components(links)
    dealt, few = _dealt(members, labels, stars), FEW
    while True:
        put = _cross_pairs(dealt, labels, signatures, least, few)
        pairs = cut(put.where("a is not null").select("a", "b").distinct(), "pairs")
        n_pairs, n_links = pairs.count(), 0
        if n_pairs:
            tried = _verified(pairs, texts, shingle)
            if n_links := tried.where(F.col("similarity") >= threshold).count():
                links = links.unionByName(tried.where(F.col("similarity") >= threshold))
                labels = components(links)
        if few is not None and n_pairs:
            come = put.where("a is null").select("key", "block", "id", F.col("cursor").alias("upto"))
            moved = dealt.join(come, ["key", "block", "id"], "left").withColumn("cursor", F.coalesce("upto", "cursor")).drop("upto")
            before, dealt = dealt, cut(moved, "dealt")
            discard(before)
        discard(pairs, put)
        if few is None or not n_pairs:
            break
        few = FEW if 2 * n_links > n_pairs else None
    discard(dealt, signatures, texts, members, stars)
    # Rows of one id are one document, so an id may join the classes of two texts.
    owned = cut(signed.select("doc_id", "digest").join(nodes.select("digest", "id"), "digest", "left").select("doc_id", "id"), "owned")
    own = owned.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    twice = own.groupBy("b").agg(F.countDistinct("a").alias("n")).where("n > 1").drop("n")
    first = nodes.select(F.col("id").alias("b")).join(own, "b", "left_semi")
    if not (twice.isEmpty() and first.isEmpty()):
        labels = components(links.select("a", "b").union(own))
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "id"))
    out = owned.join(labels, "id", "left").select("doc_id", label.alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id stands for its class, with their columns as they were."""
    kept = near_duplicates(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_keep"]), "left_semi")


def _blocks(n: Column) -> Column:
    """Blocks of n members."""
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.least(F.lit(FEW_BLOCKS), F.ceil(n / SHARED))).cast("int")


def _dealt(members: DataFrame, labels: DataFrame, stars: DataFrame) -> DataFrame:
    """The members of buckets with several components, dealt out in groups of two blocks: key, block,
    id, role, first_label (the component at this time), star, cursor.

    A group has a block q of the others, which are compared with the p-th block: first those of the
    largest component, then the others after q; within itself a block q is compared in its first group.
    So a task has two blocks at most, and a member of the largest component is copied as often as
    there are blocks of others.
    """
    labelled = members.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("n", F.negate("label").alias("neg"))).alias("top"), F.sum("n").alias("n")).where("top.n < n")
    sizes = sizes.select("key", (-F.col("top.neg")).alias("major"), _blocks(F.col("top.n")).alias("p"), _blocks(F.col("n") - F.col("top.n")).alias("q"))
    spread = labelled.join(sizes, "key")
    is_major = F.col("label") == F.col("major")
    home = F.pmod(F.xxhash64("id"), F.when(is_major, F.col("p")).otherwise(F.col("q"))).cast("int")
    spread = spread.withColumn("home", home)
    place = lambda q, p, role: F.struct((q * (F.col("p") + F.col("q")) + p).cast("long").alias("block"), F.lit(role).alias("role"))
    upto = lambda first, end: F.filter(F.sequence(F.lit(0), end - 1), lambda x: x >= first)
    as_major = F.transform(upto(F.lit(0), F.col("q")), lambda q: place(q, F.col("home"), _LARGEST))
    as_other = F.concat(
        F.array(place(F.col("home"), F.lit(0), _WITHIN)),
        F.transform(upto(F.lit(1), F.col("p")), lambda p: place(F.col("home"), p, _ONE_SIDE)),
        F.transform(upto(F.col("home") + 1, F.col("q")), lambda q: place(F.col("home"), F.col("p") + q, _ONE_SIDE)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("q") - 1), lambda q: q < F.col("home")), lambda q: place(q, F.col("p") + F.col("home"), _OTHER_SIDE)),
    )
    spread = spread.withColumn("g", F.explode(F.when(is_major, as_major).otherwise(as_other)))
    spread = spread.select("key", F.col("g.block").alias("block"), "id", F.col("g.role").alias("role"), F.col("label").alias("first_label"))
    return cut(spread.join(stars, "id", "left").withColumns({"star": F.coalesce("star", "id"), "cursor": F.lit(0).cast("long")}), "dealt")


def _cross_pairs(dealt: DataFrame, labels: DataFrame, signatures: DataFrame, least: float, few: int | None) -> DataFrame:
    """a, b: pairs of different components in one bucket that are to be verified now; and rows of
    key, block, id, cursor."""
    labelled = dealt.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("key", "block").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key", "block")
    full = labelled.join(mixed, ["key", "block"]).join(signatures, "id")
    rows = full.repartition(partitions(dealt.sparkSession), "key", "block").sortWithinPartitions("key", "block", "id")
    return cut(rows.mapInArrow(_put_forward(least, few), "a long, b long, key long, block long, id long, cursor long"), "put")
