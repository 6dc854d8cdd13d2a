"""Hard negatives, filter audits and fingerprints against plain loops."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import audit, fingerprint, negatives, queries
from tests.compare import assert_same, duck
from tests.llm.fixtures import LONG, documents, embeddings, labels, prose


def write(folder, **tables):
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ------------------------------------------------------------------ hard negatives


def brute_negatives(rows, positives=5, wanted=3, low=50, high=95):
    """Python's own integers, over every pair."""
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, label in (r for r in usable if r[0] % 50 == 0):
        scored = sorted((-sum(map(int.__mul__, v, w)), i, of) for i, w, of in usable if len(w) == len(v))
        for p, pid in [(-s, i) for s, i, of in scored if of == label and i != a][:positives]:
            fits = [(i, -s) for s, i, of in scored if of != label and low * p <= 100 * -s <= high * p][:wanted]
            out += [(a, pid, rank, i, p, s) for rank, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def mined(rows, **options):
    order = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = negatives.mine(rows, anchor=F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r[c] for c in order) for r in found.collect())


def plain(frame):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]


@pytest.mark.parametrize("round_bytes", [32 << 20, 6 * 8 * 3])
def test_negatives_equal_all_pairs_in_any_rounds(spark, round_bytes):
    rows = embeddings(spark)
    got = mined(rows, round_bytes=round_bytes)
    assert got == brute_negatives(plain(rows)) and len(got) > 40
    # A repeated anchor is answered twice, and its copy is no positive of it.
    assert all(n % 2 == 0 for k, n in collections.Counter(got).items() if k[0] == 500)
    assert not any(r[0] == r[1] for r in got)


def test_negatives_do_not_depend_on_partitions(spark):
    rows = embeddings(spark)
    assert mined(rows.repartition(7)) == mined(rows.coalesce(1))


def test_large_components_take_whole_numbers_and_larger_ones_are_refused(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(1e5, 2e6) for _ in range(8)], i % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_negatives(rows)
    assert max(r[4] for r in want) > 2**53 and mined(frame) == want
    with pytest.raises(ArithmeticError, match="64 bits"):
        mined(spark.createDataFrame([(0, [1e9, 1e9], 1), (1, [1e9, 1.0], 1)], frame.schema))


def test_hard_negatives_move_labels_of_sevenths(spark, tmp_path):
    rows = embeddings(spark).where("vec_id is null or vec_id not in (3, 500)")
    folder = write(tmp_path, embeddings=rows)
    assert_same(queries.QUERIES["op11_hard_negatives"](spark, folder), duck_of(folder), queries.SQL["op11_hard_negatives"])


def duck_of(folder):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    return con


def test_best_lists_of_parts_merge_into_the_best_of_the_whole():
    rng = np.random.default_rng(1)
    scores, ids, allowed = rng.integers(-5, 5, (4, 300)), rng.permutation(300), rng.random((4, 300)) < 0.7
    whole = negatives.Best(4, 5)
    whole.offer(np.arange(4), scores, allowed, ids)
    parts = [negatives.Best(4, 5) for _ in range(3)]
    for i, part in enumerate(parts):
        for block in np.array_split(np.arange(300)[i::3], 4):
            part.offer(np.arange(4), scores[:, block], allowed[:, block], ids[block])
    merged = negatives.Best(4, 5)
    for part in reversed(parts):
        for row in range(4):
            held = part.score[row] > negatives._WORST
            merged.offer(np.array([row]), part.score[[row]][:, held], np.ones((1, held.sum()), dtype=bool), part.id[row][held])
    assert (merged.score == whole.score).all() and (merged.id == whole.id).all()
    for row in range(4):
        assert list(zip(-whole.score[row], whole.id[row], strict=True)) == sorted(zip(-scores[row], ids, strict=True) if allowed[row].all() else [(-s, i) for s, i, a in zip(scores[row], ids, allowed[row], strict=True) if a])[:5]


def test_bounded_blocks_of_many_lists(spark):
    # More anchors than one tile of scores holds with a batch of candidates.
    rows = spark.range(4000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1000)) / 1000.0).alias("embedding"), (F.col("id") % 5).alias("label"))
    every = negatives.mine(rows, anchor=F.lit(True)).where("anchor_id % 50 = 0")
    few = negatives.mine(rows, anchor=F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, few.collect()))


# ------------------------------------------------------------------ filter audit


def brute_audit(docs, told):
    """Each order is applied filter by filter to the documents that are left."""
    texts = [(i, t or "", part or "") for i, t, part in docs]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    rows = []
    for i, t, part in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search("[#$%&*|]", t) is not None, "E": i is not None and first[t] < i}
        rows.append((part, bad, any(i is not None and x[0] == i and x[1] == 1 for x in told), any(i is not None and x[0] == i and x[2] == 1 for x in told)))
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        left = rows
        for step, f in enumerate(order, 1):
            gone = [r for r in left if r[1][f]]
            stay = [r for r in left if not r[1][f]]
            for part in {r[0] for r in rows}:
                of = lambda xs, part=part: [r for r in xs if r[0] == part]
                failing = [r for r in of(rows) if r[1][f]]
                out[part, order, step] = [len(of(stay)), len(of(gone)), len(failing) - len(of(gone)), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in of(gone)), sum(r[3] for r in of(gone))]
            left = stay
    shapley = collections.Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return {k: (*x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def audited(docs, told):
    found = audit.interactions(audit.histograms(docs, told)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit._COUNTS) for r in found}
    assert len(got) == len(found)
    return got


def test_audit_of_awkward_documents_equals_orders_applied_in_turn(spark):
    docs, told = documents(spark), labels(spark)
    extra = [(800 + i, f"WORD{i} " * 20, "de") for i in range(3)] + [(900, " ".join(f"w{i}" for i in range(150)), ""), (901, "a # b", None), (700, " ".join(f"w{i}" for i in range(150)), "en")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r)[:3] for r in told.collect()])
    got = audited(docs, told)
    assert got == want and {k[0] for k in got} == {"", "en", "de", "fr"}
    assert sum(x[4] for x in got.values()) and sum(x[5] for x in got.values())


def test_audit_has_a_row_for_every_part_order_and_step(spark):
    docs = spark.createDataFrame([(i, "x", f"part{i}") for i in range(150)], "doc_id long, text string, lang string")
    got = audited(docs, labels(spark).limit(0))
    assert len(got) == 150 * 600
    # Text of one word fails A alone, and E but for the smallest id.
    assert got["part0", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["part0", "ABCDE", 5] == (0, 0, 0, 0, 0, 0, 0)
    assert got["part7", "ABCDE", 1][6] == got["part7", "ABCDE", 5][6] == 60


def test_long_texts_are_counted_in_pieces_as_at_once():
    rules = audit.Rules()
    raw = b"".join(b"word%d\x0b" % (i % 500_000) for i in range(620_000))
    assert len(raw) > 1 << 22
    assert rules.fails(raw, len(raw)) == 0 and rules.fails(raw[: 1 << 21], 1 << 21) == 0
    repeated = raw + raw
    assert rules.fails(repeated, len(repeated)) == 2
    assert rules.fails(b"x" * (5 << 20), 5 << 20) == 1


def test_outcomes_partition_the_documents():
    m = audit.outcomes()
    assert all(x.shape == (32, 600) for x in m.values())
    before = np.concatenate([np.ones((32, 120, 1), dtype=int), m["kept"].reshape(32, 120, 5)[:, :, :-1]], axis=2)
    assert (before - m["removed"].reshape(32, 120, 5) == m["kept"].reshape(32, 120, 5)).all()


# ------------------------------------------------------------------ fingerprints


def word_shingles(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)]


def test_edits_and_estimates_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_one_permutation_minhash(spark, sf_dir).collect()}
    rows = expected([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert len(got) == len(rows)
    errors = []
    for i, t, following in rows:
        k = len(t) // 4
        changed = t[: len(t) - k] + following[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(word_shingles(t), word_shingles(changed)), r["near_next"] - jaccard(word_shingles(t), word_shingles(following))]
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.01 and np.sqrt((errors**2).mean()) < 0.025 and abs(errors).max() < 0.12


def test_edits_do_not_depend_on_partitions(spark):
    docs = documents(spark).where("doc_id is null or doc_id <> 2").dropDuplicates(["doc_id"]).select("doc_id", "text", "kept")
    rows = {i: (t or "", following or "") for i, t, following in expected([(r["doc_id"], r["text"]) for r in docs.collect()])}
    told = []
    for n in ("1", "3", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            told.append(sorted(fingerprint.edit_facts(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told[0] == told[1] == told[2] and len(told[0]) == len(rows)
    for r in told[0]:
        t, following = rows[r["doc_id"]]
        k = len(t) // 4
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()


def test_one_document_follows_itself(spark):
    text = "one two three four five six seven eight"
    (r,) = fingerprint.edit_facts(spark.createDataFrame([(5, text)], "doc_id long, text string")).collect()
    k = len(text) // 4
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256((text[:-k] + text[:k]).encode()).hexdigest()


def test_fingerprints_of_equal_texts_are_equal_and_likeness_is_corrected(spark):
    rows = documents(spark)
    got = fingerprint.fingerprints(rows).select("row.doc_id", "row.text", "row.digest", "fingerprint").collect()
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r["text"] or ""].add(r["fingerprint"])
    assert len(got) == rows.count() and all(len(x) == 1 for x in by_text.values())
    assert by_text[""] == by_text[" \t\n "] == {""} and by_text["x"] != by_text["12345 678"]
    prints = fingerprint.fingerprints(rows.where("doc_id in (1, 3, 4, 7, 8, 11)").dropDuplicates(["doc_id"])).select(F.col("row.doc_id").alias("i"), F.col("fingerprint").alias("f"))
    pairs = prints.crossJoin(prints.select(F.col("i").alias("j"), F.col("f").alias("g"))).select("i", "j", fingerprint.likeness_of(F.col("f"), F.col("g")).alias("like"))
    like = {(r["i"], r["j"]): r["like"] for r in pairs.collect()}
    assert all(like[i, i] == 1.0 for i in (1, 3, 4, 7, 8, 11)) and like[1, 4] == like[4, 1] == 0.0
    assert like[1, 7] < 0.06 and abs(like[1, 3] - 71 / 81) < 0.08 and like[7, 8] > 0.95


def test_long_texts_in_pieces_have_the_bins_of_the_whole(monkeypatch):
    texts = pa.array([LONG, "a b c", LONG[:5000], "x" * 9000 + " y z"])
    whole = fingerprint.minima(texts)
    monkeypatch.setattr(fingerprint, "_ONE_CHUNK", 1000)
    assert (fingerprint.minima(texts) == whole).all()


def test_empty_bins_are_filled_evenly_and_alike():
    rng = np.random.default_rng(2)
    table = np.full((300, fingerprint.BINS), fingerprint._NEVER, dtype=np.uint64)
    for row in table[1:]:
        full = rng.choice(fingerprint.BINS, rng.integers(1, 60), replace=False)
        row[full] = full  # a value tells its bin
    out = fingerprint.densified(table)
    assert (out[0] == fingerprint._NEVER).all() and (out[1:] < fingerprint.BINS).all()
    full = table != fingerprint._NEVER
    assert (out[full] == table[full]).all()
    order, _ = fingerprint.walks()
    for i in (1, 17, 299):
        for b in range(0, fingerprint.BINS, 37):
            assert full[i, b] or out[i, b] == next(x for x in order[b] if full[i, x])
    pair = np.full((1, fingerprint.BINS), fingerprint._NEVER, dtype=np.uint64)
    pair[0, [3, 400]] = 3, 400
    assert 200 < (fingerprint.densified(pair) == 3).sum() < 312


def test_fingerprints_of_prose_estimate_similarity():
    base = prose(77, 400).split()
    changed = [w if i % 40 else "new" for i, w in enumerate(base)]
    texts = [" ".join(base), " ".join(changed), prose(78, 400)]
    rows = fingerprint.packed(pa.array(texts))
    of = lambda i: (rows[0][[i]], rows[1][[i]])
    for i, j in itertools.combinations(range(3), 2):
        assert abs(fingerprint.likeness(of(i), of(j))[0] - jaccard(word_shingles(texts[i]), word_shingles(texts[j]))) < 0.08


def test_registered_queries_meet_their_sql_on_a_larger_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    for name in ("op11_hard_negatives", "op12_filter_interactions"):
        assert_same(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name])
