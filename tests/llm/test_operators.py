import collections
import hashlib
import pathlib
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from strandline.llm import exact, langid, minhash, mixing, packing, pii, quality, queries, sharding, substring, warc
from strandline.llm.components import components
from tests.compare import assert_same, duck
from tests.llm.fixtures import documents, embeddings, labels, pages, prose


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).persist()


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """The awkward tables as files, with their rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    pages(spark).write.parquet(f"{folder}/pages.parquet")
    embeddings(spark).write.parquet(f"{folder}/embeddings.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    pages(spark).limit(0).write.parquet(f"{folder}/pages.parquet")
    embeddings(spark).limit(0).write.parquet(f"{folder}/embeddings.parquet")
    labels(spark).limit(0).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_awkward_tables_give_a_row_each(spark, tables, name):
    out = queries.QUERIES[name](spark, tables).collect()
    if "page_id" in out[0].asDict():
        assert len(out) == 57
    elif name.startswith("op5"):
        assert {r["doc_id"] for r in out} >= {1, 4, 5, None}
    elif name.startswith("op11"):
        assert {r["anchor_id"] for r in out} >= {0, 50, 400, 500, 1000, 1050}
    elif name.startswith("op12"):
        assert len(out) == 4 * 600
    else:
        assert len(out) == documents(spark).count()


# ------------------------------------------------------------------ op1

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_forms():
    rng = random.Random(5)
    bits = ["1", "2", ".", "@", "a", "b-", "+1", " ", "4111111111111111", "_", "%", "(", ")", "-", "9.9.9.9", "c@d.e", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 18)))
        assert brute_spans(t) == pii.base_spans(t), t


def test_long_runs_are_read_once():
    pii.base_spans("1" * 400_000 + "." * 1000 + "a" * 400_000 + "@" + "+1" * 1000 + "a." * 100_000)


def test_patterns_find_unseen_identifiers_and_leave_others(spark):
    rows = [(i, f"name{'x' * i} call me at +1 (743) 555-{1000 + i} now") for i in range(12)]
    rows += [(50, "so call me at 0743 555 2222 please and the 1234567 thing"), (51, "the 7654321 of it")]
    got = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50]["spans"] == "phone:14:27" and got[50]["n_phone"] == 0 and got[51]["spans"] == ""
    assert all(got[i]["n_phone"] == 1 and got[i]["spans"].count(",") == 0 for i in range(12))
    assert got[51]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def planted():
    rng = random.Random(21)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{prose(500 + i, 12)} api_key = \"{key(36)}\" {prose(600 + i, 5)}" for i in range(8)]
    texts += [f"{prose(700 + i, 9)} callback number:\n+1 (743) 555-{1000 + i} ext {prose(800 + i, 4)}" for i in range(8)]
    unseen = {
        "password": 'here api_key = "correct-horse-battery" stands',
        "groups": "my callback number: 0033 1 23 45 67 89 and more",
        "line": "callback number\n743-555-2222 is it",
    }
    clean = [prose(900 + i, 40) for i in range(20)] + ["note: something long-winded", "he had 7654321 of them"]
    clean += [f"the number: {1234567 + 11 * i} of the order" for i in range(6)]
    return texts, unseen, clean


def test_planted_identifiers_are_found_and_clean_texts_left(spark):
    texts, unseen, clean = planted()
    rows = list(enumerate([*texts, *unseen.values(), *clean]))
    got = {r["doc_id"]: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shown = lambda i: [f"{pii.NAMES[s['kind']]}:{rows[i][1][s['start'] : s['end']]}" for s in got[i]["found"]]
    assert all(len(got[i]["found"]) == 1 and shown(i)[0].startswith("secret:") for i in range(8))
    assert all(not got[i]["found"] and got[i]["n_phone"] == 1 for i in range(8, 16))
    assert [shown(16 + i) for i in range(3)] == [["secret:correct-horse-battery"], ["phone:0033 1 23 45 67 89"], ["phone:743-555-2222"]]
    assert all(not got[i]["found"] and got[i]["spans"] == "" for i in range(19, len(rows)))
    origins = [(got[i]["n_pattern"], got[i]["n_form"]) for i in range(len(rows))]
    assert origins == [(0, 1)] * 8 + [(0, 0)] * 8 + [(1, 0)] * 3 + [(0, 0)] * len(clean)


def brute_found(texts, rounds=3, support=5, pattern=0.7, instance=0.7, beside=0.05):
    """The scoring as plain loops over all candidates."""
    seen = [(i, *c) for i, t in enumerate(texts) for c in pii.candidates(t, pii.base_spans(t))]
    of = lambda x: texts[x[0]][x[1] : x[2]].lower()
    words = collections.Counter(w for t in texts for w in regex.split(r"[^\p{L}\p{N}]+", re.sub("[0-9]", "0", t.lower())) if w)
    members, uses, seeds = collections.defaultdict(set), collections.Counter(), set()
    for x in seen:
        for p in x[5]:
            members[p].add(of(x))
            uses[p, of(x)] += 1
            if x[3] is not None:
                seeds.add((of(x), x[3]))
    known, trusted = {k: 1.0 for k in seeds}, {}
    for _ in range(rounds):
        trusted = {}
        for p, all_of in members.items():
            for k in range(len(pii.NAMES)):
                hits = [x for x in all_of if (x, k) in known]
                places = min((words[w] for w in p[2:].split(" ") if words[w]), default=None)
                used = sum(uses[p, x] for x in hits)
                worth = sum(known[x, k] for x in hits) / len(all_of)
                if len(hits) >= support and worth >= pattern and used >= beside * (used if places is None else places):
                    trusted[p, k] = worth
        fresh = collections.defaultdict(set)
        for x in seen:
            if x[3] is None:
                for p in x[5]:
                    for k in x[4]:
                        if (p, k) in trusted:
                            fresh[of(x), k].add(p)
        scores = {(s, k): 1 - np.prod([1 - min(trusted[p, k], 0.999) for p in ps]) for (s, k), ps in fresh.items()}
        known = {k: 1.0 for k in seeds} | {k: v for k, v in scores.items() if v >= instance}
    out = set()
    for x in seen:
        if x[3] == pii.SECRET:
            out.add((x[0], x[1], x[2], x[3]))
        elif x[3] is None:
            led = [(-known[of(x), k], k) for k in x[4] if (of(x), k) in known and any((p, k) in trusted for p in x[5])]
            if led:
                out.add((x[0], x[1], x[2], min(led)[1]))
    return out


def test_scoring_equals_brute_force(spark):
    rng, (texts, unseen, clean) = random.Random(22), planted()
    many = [*texts, *unseen.values(), *clean, texts[0], texts[0]]
    made = {
        "call": lambda: rng.choice([f"+1 (743) 555-{rng.randint(1000, 9999)}"] * 3 + [f"0{rng.randint(10**8, 10**9)}"]),
        "host": lambda: f"10.0.{rng.randint(0, 300)}.{rng.randint(0, 9)}",
        "mail me": lambda: rng.choice([f"a{rng.randint(0, 99)}@b.example"] * 3 + [f"x{rng.randint(0, 9)}@local"]),
        "id": lambda: str(rng.randint(10**13, 10**14)),
    }
    for _ in range(160):
        kind = rng.choice(list(made))
        label = kind if rng.random() < 0.9 else rng.choice(list(made))
        many.append(f"{prose(rng.randint(0, 10**6), 3)} {label}{rng.choice([' ', ': ', '='])}{made[kind]()} {rng.choice(['now', 'end', 'the'])}")
    frame = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], s["start"], s["end"], s["kind"]) for r in pii.extract(frame).collect() for s in r["found"]}
    want = brute_found(many)
    assert got == want and len(want) > 15 and len({k for *_, k in want}) > 1


# ------------------------------------------------------------------ op2


def test_captures_hold_whole_payloads(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages(spark), path, records_per_file=7)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    bodies = {r["page_id"]: (r["html"] or "").encode() for r in pages(spark).collect()}
    assert len(captures) == len(bodies)
    for c in captures:
        page = int(re.search(r":(\d+)>", c["capture_id"])[1])
        assert c["request"]["kind"] == "request" and c["metadata"]["kind"] == "metadata"
        if c["main"]["kind"] == "response":
            assert bytes(c["main"]["body"]) == bodies[page]
        assert c["main"]["digest"] == "sha1:" + warc.digest_of(bodies[page])
    facts = {r["page_id"]: r for r in warc.payload_facts(warc.assemble(warc.read_records(spark, path))).collect()}
    assert facts[1]["refers_to"] == 2 and facts[2]["record_type"] == "response" and facts[3]["refers_to"] == 4
    assert facts[10]["refers_to"] == 59 and facts[6]["payload_bytes"] == len(bodies[6])


def test_small_payloads_can_stay_responses(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"), min_revisit_bytes=1)
    facts = {r["page_id"]: r["record_type"] for r in warc.payload_facts(warc.assemble(warc.read_records(spark, str(tmp_path / "w")))).collect()}
    assert facts[3] == facts[4] == "response" and facts[1] == "revisit"


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"nothing"))


def test_rows_without_an_own_id_stay_apart(spark, tmp_path):
    rows = [(1, "a", "one"), (1, "a", "two"), (None, "b", "three"), (None, None, None), (None, "c", "one"), (5, "d", "four"), (5, "d", "four"), (5, "d", "four"), (4, "e", "four")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    for told in (records, warc.without_payloads(records)):
        got = warc.payload_facts(warc.assemble(told)).collect()
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted(
            [("1", 3, "response", None), ("1", 3, "response", None), ("None", 5, "response", None), ("None", 0, "response", None), ("None", 3, "revisit", 1)]
            + [("5", 4, "response", None)] * 3
            + [("4", 4, "revisit", 5)]
        )
        assert {r["payload_digest"] for r in got} == {warc.digest_of((r[2] or "").encode()) for r in rows}


def test_framing_is_exact_whatever_blocks_hold():
    rng = random.Random(8)
    for _ in range(300):
        blocks = ["".join(rng.choice(["\r", "\n", "\r\n", "a", "WARC/1.1\r\n", "\r\n\r\n"]) for _ in range(rng.randint(0, 9))).encode() for _ in range(5)]
        data = b"".join(b"WARC/1.1\r\nX: y\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in blocks)
        assert [b for _, b in warc.parse(data)] == blocks


def test_very_long_payloads(spark, tmp_path):
    frame = spark.range(2).selectExpr("id as page_id", "'u' as url", "if(id = 0, repeat('0123456789', int(20000000 + id)), 'short') as html")
    warc.write_archives(frame, str(tmp_path / "w"))
    got = warc.payload_facts(warc.assemble(warc.without_payloads(warc.read_records(spark, str(tmp_path / "w"))))).collect()
    assert {(r["page_id"], r["payload_bytes"]) for r in got} == {(0, 200_000_000), (1, 5)}
    assert {r["payload_digest"] for r in got if r["page_id"] == 0} == {warc.digest_of(b"0123456789" * 20_000_000)}


# ------------------------------------------------------------------ op3


def test_shards_fit_or_hold_one_key(spark, docs):
    out = sharding.extendible_shards(docs, max_bytes=3000).collect()
    shards = collections.defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r)
    for s, rows in shards.items():
        total = sum(r["n_bytes"] for r in rows)
        assert {(r["shard_bytes"], r["shard_rows"], r["depth"]) for r in rows} == {(total, len(rows), len(s))}
        assert total <= 3000 or len({r["doc_id"] for r in rows}) == 1
        if s:  # the parent was too large
            assert sum(r["n_bytes"] for r in out if r["shard"].startswith(s[:-1])) > 3000
    assert len(out) == docs.count()
    short = sharding.extendible_shards(docs, max_bytes=3000, stretch=2)
    assert sorted(map(str, short.collect())) == sorted(map(str, out))


def test_shards_are_written_whole(spark, docs, tmp_path):
    sharding.write_shards(docs.where("doc_id >= 100"), str(tmp_path / "s"), max_bytes=4000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.where("doc_id >= 100").count()


def test_shards_of_tables_with_the_same_columns(spark, tmp_path):
    rows = [(i % 3, "text" * 50, "s", 5, 7) for i in range(300)] + [(9, None, "s", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard_id string, id int, key int")
    name = sharding.write_shards(docs, str(tmp_path / "s"), max_bytes=5000)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert name == "_shard_id" and sorted(map(tuple, got.drop(name).select(docs.columns).collect()), key=str) == sorted(rows, key=str)


# ------------------------------------------------------------------ op4


def test_fitted_weights_meet_their_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 40.0), ("b", "y", 20.0), ("c", "x", 5.0)], "s string, l string, tokens double")
    targets = {"s": {"a": 0.5, "b": 0.3, "c": 0.2}, "l": {"x": 0.6, "y": 0.4}}
    got = mixing.rake(cells, targets, sweeps=60).collect()
    for dim, wanted in targets.items():
        for v, share in wanted.items():
            assert abs(sum(r["weight"] for r in got if r[dim] == v) - share) < 1e-6


def test_gaps_tell_what_is_missing(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 30.0)], "s string, l string, tokens double")
    apart = {"s": {"a": 0.5, "b": 0.5}, "l": {"x": 0.2, "y": 0.8}}
    told = {(r["dim"], r["value"]): r for r in mixing.gaps(mixing.rake(cells, apart, sweeps=6), apart).collect()}
    assert abs(told["s", "a"]["gap"] - 0.3) < 1e-9 and told["l", "x"]["gap"] < 1e-9 and told["l", "x"]["target"] == 0.2
    cells = spark.createDataFrame([(s, x, float(1 + i)) for i, (s, x) in enumerate((s, x) for s in "abc" for x in "xy")], "s string, l string, tokens double")
    targets = {"s": 0.5, "l": {"x": 0.6, "y": 0.4}}
    assert mixing.gaps(mixing.rake(cells, targets, sweeps=60), targets).agg(F.max("gap")).first()[0] < 1e-12


def test_unnamed_values_share_the_rest_and_nulls_count(spark, docs):
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = mixing.mix(docs, dims, {"source": 1.0, "lang": {"en": 0.5}}, sweeps=30).collect()
    assert {r["lang"] for r in out} == {"en", "de", "fr", "(null)"} and all(0 <= r["prob"] <= 1 for r in out)
    assert max(r["prob"] for r in out if r["n_tokens"]) == 1.0
    drawn = mixing.sample(docs, dims, {"source": 1.0, "lang": {"en": 0.5}}, sweeps=5)
    assert drawn.columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix(docs, dims, {"source": 1.0})


# ------------------------------------------------------------------ op5


def test_packing_is_an_exact_cut_with_little_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = packing.harmonic_pack(docs).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d in docs.collect():
        rows = sorted(by_doc[d["doc_id"]], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype="<u4").tolist()
        assert ids == [*t.encode(d["text"], add_special_tokens=False).ids, 2]
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()
        assert {r["doc_tokens"] for r in rows} == {len(ids)}
    used = 0
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()
        assert sum(r["length"] for r in rows) <= 4096
        used += sum(r["length"] for r in rows)
    assert used > 0.97 * 4096 * len(by_sequence)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 2048, 3000, 4095, 4096, 4097, 50_000])
def test_pieces_fill_their_class(n):
    got = packing.pieces(n, 4096, 0.01)
    assert sum(x for x, _ in got) == n and all(x * k <= 4096 for x, k in got)
    assert all(x * k > 0.97 * 4096 for x, k in got if k < 64)


def test_no_slivers():
    for n in range(1, 3 * 4096):
        got = packing.pieces(n, 4096, 0.02, 32)
        assert sum(x for x, _ in got) == n and all(0.97 * 4096 < x * k <= 4096 for x, k in got if k < 64) and min(x for x, _ in got) >= min(n, 32)


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), random.Random(9)
    letters = [chr(i) for i in range(0x20, 0x250)]
    capitals = [c for c in letters if any(x > "\u024f" for x in c.lower())]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice([*capitals, "a", " ", "B", "1", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "\u0301", "\u65e5"]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts += [*capitals, "", "a <|endoftext|> b", "x <|startoftext|>"]
    assert len(capitals) > 20
    for text, ids in zip(texts, packing.Encoder(path)(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_crc_of_a_piece(spark, tables):
    got = queries.op5_harmonic_packing(spark, tables).where("doc_id = 5").first()
    assert got["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little")) and got["doc_tokens"] == 1


# ------------------------------------------------------------------ op6


def brute_repeats(rows, k):
    seen, out = {}, {}
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    for i, ws in split:
        for s in range(len(ws) - k + 1):
            key = tuple(ws[s : s + k])
            seen[key] = min(seen.get(key, (i, s)), (i, s))
    for i, ws in split:
        gone = set()
        for s in range(len(ws) - k + 1):
            if seen[tuple(ws[s : s + k])] < (i, s):
                gone |= set(range(s, s + k))
        out[i] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    return out


def test_repeats_equal_brute_force_on_shuffled_passages(spark):
    rng = random.Random(2)
    passages = [prose(1000 + i, rng.randint(15, 70)) for i in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.6 else prose(rng.randint(0, 10**6), rng.randint(1, 30)) for _ in range(rng.randint(0, 6))]
        text = rng.choice([" ", "\n"]).join(parts)
        words = text.split(" ")
        if rng.random() < 0.5 and len(words) > 5:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i * 3 % 1009, " ".join(words)))
    rows += [(5000, "a b " * 60), (5001, "a b " * 60), (5002, None), (5003, "")]
    for k in (20, 6):
        got = {r["doc_id"]: r for r in substring.parse_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=k).collect()}
        for i, (n, gone, kept) in brute_repeats(rows, k).items():
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (n, gone, kept), i
            assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == gone
    with pytest.raises(ValueError):
        substring.parse_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=3)


def test_factors_are_copies_of_their_sources(spark):
    rng = random.Random(12)
    passages = [prose(3000 + i, rng.randint(20, 60)).split() for i in range(5)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += list(rng.choice(passages)) if rng.random() < 0.7 else prose(rng.randint(0, 10**6), rng.randint(1, 30)).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, words))
    got = substring.parse_repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(7)).collect()
    texts, n = dict(rows), 0
    for r in got:
        own, covered = texts[r["doc_id"]], set()
        for f in r["factors"]:
            n += 1
            a, b, source = f["start"], f["start"] + f["length"], texts[f["source"]]
            assert f["length"] >= 20 and (f["source"], f["place"]) < (r["doc_id"], a)
            assert own[a:b] == source[f["place"] : f["place"] + f["length"]]
            covered |= set(range(a, b))
        assert covered == {j for s in r["spans"] for j in range(s["start"], s["end"])}
        # A factor goes on as far as its source does, but where another one has an earlier source.
        for f, g in zip(r["factors"], r["factors"][1:], strict=False):
            assert (f["source"], f["place"] - f["start"]) != (g["source"], g["place"] - g["start"]) or g["start"] > f["start"] + f["length"]
    assert n > 60


def test_texts_without_an_id_repeat_within_themselves(spark):
    one, two = prose(4001, 30), prose(4002, 30)
    edited = " ".join("edit" if i == 4 else w for i, w in enumerate(one.split()))
    text = " ".join([one, two, edited, two])
    got = substring.parse_repeats(spark.createDataFrame([(None, text), (7, one), (7, two), (7, one), (None, one)], "doc_id long, text string")).collect()
    gone = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in got}
    assert gone == {(None, 120): brute_repeats([(0, text)], 20)[0][1], (7, 30): 0, (None, 30): 0}


def shuffled(spark):
    """Bytes of the shuffle files that lie on disk, by path."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p: p.stat().st_size for d in dirs for p in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}


def test_parsing_moves_texts_once_and_frees_what_its_marks_shuffled(spark):
    rng = random.Random(21)
    words = lambda n: " ".join(f"{rng.getrandbits(32):x}" for _ in range(n))
    shared = words(60)
    edited = " ".join("edit" if i == 30 else w for i, w in enumerate(shared.split()))
    rows = [(i, words(1500) + " " + (shared, edited, "end")[min(i % 9, 2)]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    before = shuffled(spark).keys()
    docs.repartition(4, "doc_id").write.format("noop").mode("overwrite").save()
    once = sum(n for p, n in shuffled(spark).items() if p not in before)
    before = shuffled(spark).keys()
    parsed = substring.parse_repeats(docs)
    end = time.time() + 20
    while (left := shuffled(spark).keys() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    parsed.write.format("noop").mode("overwrite").save()
    assert once <= sum(n for p, n in shuffled(spark).items() if p not in before) < 1.5 * once
    assert {r["doc_id"]: r["n_removed"] for r in parsed.collect()} == {i: n for i, (_, n, _) in brute_repeats(rows, 20).items()}


# ------------------------------------------------------------------ op7


def probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def bag(text, k=5):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else collections.Counter()


def test_exact_similarity():
    rng = random.Random(3)
    for _ in range(50):
        a, b = (collections.Counter({x: rng.randint(1, 4) for x in rng.sample(range(30), 15)}) for _ in range(2))
        pair = [(np.array(sorted(c), dtype=np.uint64), np.array([float(c[x]) for x in sorted(c)])) for c in (a, b)]
        assert abs(minhash.probability_jaccard(*pair) - probability_jaccard(a, b)) < 1e-12


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (keys[:200], rng.integers(1, 5, 200).astype(float)), (keys[60:], rng.integers(1, 5, 240).astype(float))
    text = np.repeat([0, 1], [200, 240])
    table = minhash.prob_minhash(text, np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), 2, 4000)
    assert abs((table[0] == table[1]).mean() - minhash.probability_jaccard(a, b)) < 0.035


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for family in range(12):
        base = prose(family, rng.choice([3, 30, 120])).split()
        for _ in range(rng.choice([1, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  ")]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in rows:
        for j, t in rows:
            if i < j and ((s or "") == (t or "") or probability_jaccard(bag(s), bag(t)) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["class_id"] for i in got} == {i: find(i) for i in parent}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_blocks_lose_no_link(spark, monkeypatch):
    """Buckets larger than a block: variants around the threshold of a few texts, each compared with all."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SHARED", 4)
    rng, rows = random.Random(14), []
    for family in range(3):
        base = prose(5000 + family, 100).split()
        for _ in range(45):
            words = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(words)))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in rows:
        for j, t in rows:
            if i < j and probability_jaccard(bag(s), bag(t)) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in parent}


def test_rows_of_one_id_and_null_ids(spark, docs):
    got = minhash.near_duplicates(docs).collect()
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert classes[1] == classes[2] == classes[3] == 1 and classes[None] is None and classes[8] == 7
    assert all(classes[100 + i] == 100 for i in range(60))
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 3").count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [tuple(sorted(rng.sample(range(90), 2))) for _ in range(60)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: find(x) for x in nodes if find(x) != x}


# ------------------------------------------------------------------ op8


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_hot_groups_cross_partitions(spark, docs, keep):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = exact.content_sort(docs, keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == docs.count()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        wanted = (min if keep == "smallest" else max)(known) if known else None
        assert (r["group_size"], r["keep_id"], r["kept"]) == (len(ids), wanted, r["doc_id"] == wanted)


def test_survivors_are_one_row_a_text(spark, docs):
    out = exact.survivors(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    folded = exact.content_sort(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string"), normalise=F.lower("text"))
    assert {r["group_size"] for r in folded.collect()} == {2}
    with pytest.raises(ValueError):
        exact.content_sort(docs, keep="first")


# ------------------------------------------------------------------ op9


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = queries.op9_word_backoff(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 0.98 * len(out) > 0
    assert all(0 <= r["score"] <= 1 for r in out)


def test_backoff_and_texts_without_letters(spark, docs):
    rows = [(i, "straße über schön grün", "de") for i in range(5)] + [(9 + i, "where there is water", "en") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "überstraße"), (2, "whereis"), (3, None), (4, "123 !"), (5, "STRASSE über")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()}
    assert got == {1: "de", 2: "en", 3: "und", 4: "und", 5: "de"}
    nothing = langid.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(asked, nothing).collect()} == {"und"}


def test_numbers_are_no_letters(spark, tables):
    model = langid.fit(spark.read.parquet(f"{tables}/documents.parquet"))
    asked = spark.createDataFrame([(1, "\u00b2\u00bd\u2167"), (2, "\u0663 \u2460 _ 7"), (3, "\u00b2the river\u2167")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[3][1] > 0


def brute_language(learned, asked, longest=4):
    """Predictions from plain counters, by the formulas of the docstrings."""
    langs = sorted({x for _, x in learned})
    words = {x: collections.Counter() for x in langs}
    for text, x in learned:
        words[x].update(regex.findall(r"\p{L}+", text.lower()))

    def table(counts):
        items = set().union(*counts.values())
        return items, lambda i: np.array([np.log((counts[x][i] + 0.5) / (sum(counts[x].values()) + 0.5 * len(items))) for x in langs])

    grams = []
    for size in range(1, longest + 1):
        counts = {x: collections.Counter() for x in langs}
        for x in langs:
            for w, n in words[x].items():
                for i in range(len(w) + 2 - size + 1):
                    counts[x][f" {w} "[i : i + size]] += n
        grams.append(table(counts))
    known, score = table(words)

    def of(w):
        if w in known:
            return score(w)
        marked, i, parts = f" {w} ", 0, []
        while i < len(marked):
            size = next((k for k in range(longest, 0, -1) if marked[i : i + k] in grams[k - 1][0] and i + k <= len(marked)), 0)
            parts.append(grams[size - 1][1](marked[i : i + size]) if size else np.min([g[1]("\0") for g in grams], axis=0))
            i += max(1, size - 1)
        return np.mean(parts, axis=0)

    for text in asked:
        ws = regex.findall(r"\p{L}+", (text or "").lower())
        if not ws:
            yield "und", 0.0
            continue
        total = np.sum([of(w) for w in ws], axis=0) / np.sqrt(len(ws))
        p = np.exp(total - total.max())
        yield langs[int(np.argmax(total))], p.max() / p.sum()


def test_predictions_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 4000").orderBy("doc_id").limit(240).collect()
    learned, asked = docs[:40], [*docs, (9001, None, None), (9002, "Xyzzy \u0416\u0416 qu\u00e4k", None), (9003, "\u00b2 7", None)]
    model = langid.fit(spark.createDataFrame([tuple(r) for r in learned], "doc_id long, text string, lang string"))
    frame = spark.createDataFrame([(r[0], r[1]) for r in asked], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(frame, model).collect()}
    for r, (lang, score) in zip(asked, brute_language([(r["text"], r["lang"]) for r in learned if r["lang"] and r["text"]], [r[1] for r in asked]), strict=True):
        assert got[r[0]]["lang_pred"] == lang and abs(got[r[0]]["score"] - score) < 1e-9


def test_samples_are_even_and_never_empty(spark):
    assert langid.shares({"a": 10, "b": 10**9}, 1000) == {"a": 1.0, "b": 990 / 10**9}
    assert langid.threshold(1e-30) > langid.threshold(0) - 1 >= -(2**63) and langid.threshold(1e-9) > -(2**63) + 10**10
    rows = [(i, "the water", "en") for i in range(300)] + [(900, "das wasser", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train_docs=20)
    assert model.langs == ("de", "en") and list(model.counts("the")) == ["en"] and 2 <= model.counts("the")["en"] <= 60 and model.counts("das") == {"de": 1}


def test_any_number_of_languages_and_all_words_are_kept(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26]
    rows = [(i, f"common {name(i)}qu{name(i * 7 + 3)} {name(i)}xo", f"l{i:03d}") for i in range(620)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 620 and len(model.counts("common")) == 620 and len(model.items[0]) == 1 + 2 * 620
    asked = spark.createDataFrame([(i, t) for i, t, _ in rows], "_text long, text string")
    got = {r["_text"]: r["lang_pred"] for r in langid.predict(asked, model, keep=("_text",)).collect()}
    assert got == {i: x for i, _, x in rows}
    few = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train_docs=310)
    assert 150 < len(few.langs) <= 620


def test_long_words_are_taken_apart_as_short_ones(spark, monkeypatch):
    rows = [(i, prose(40 + i, 40) + " donaudampfschifffahrt über", "de" if i % 2 else "en") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [["garden", "wintergardens", "xyqЖ", "schifffahrtsgarten" * 2, "a" * 39, "𐐀b"], ["q" * 5000, "riverstone" * 300], []]
    at_once = langid._totals(model, asked)
    model = pickle.loads(pickle.dumps(model))  # without what it has looked up
    monkeypatch.setattr(langid, "LONG_WORD", 1)
    assert np.allclose(langid._totals(model, asked), at_once, rtol=0, atol=1e-9) and (at_once[2] == 0).all()


def test_the_hash_of_held_out_rows(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", langid.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# ------------------------------------------------------------------ op10


def brute_quality(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, docs):
    extra = spark.createDataFrame([(1, "a b c d e " * 7), (2, "x\n\n x \nx\r\nx\n"), (3, "#*$ %&|<> ok"), (4, "a a a a a a"), (5, prose(1, 30) + " " + prose(1, 30))], "doc_id long, text string")
    for frame in (docs, extra):
        for r in quality.score(frame).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(r["text"]), r["doc_id"]


def test_helper_columns_of_the_input_stay(spark):
    frame = spark.createDataFrame([(1, "a b c d e " * 4, 5, "w", "t")], "doc_id long, text string, _words int, __lines string, _Text string")
    got = quality.score(frame).first()
    assert (got["_words"], got["__lines"], got["_Text"], got["n_words"], got["n_repeat_words"]) == (5, "w", "t", 20, 20)
    assert {c for c in quality.score(frame).columns if c.startswith("_")} == {"_words", "__lines", "_Text"}


def test_rules_are_named(spark):
    row = spark.createDataFrame([(1, " ".join(f"word{i} ###" for i in range(40)))], "doc_id long, text string")
    assert quality.score(row).first()["failed_rules"] == ["1:symbol_ratio", "2:stop_word_ratio"]
    assert quality.score(row, rules=()).first()["kept"]
    with pytest.raises(ValueError):
        quality.score(row, rules=(quality.Rule("nothing", 1.0),))


def test_queries_are_native(spark, sf_dir):
    for name in ("op3_extendible_sharding", "op4_proportional_mix", "op10_quality_rules"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|MapIn", plan)
