"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import audit, exact, fingerprint, langid, minhash, mixing, negatives, packing, pii, quality, sharding, substring, warc
from strandline.llm.common import scratch
from strandline.session import shipped

#: Target shares of the registered mix: sources are tempered, the rest is named.
MIX_TARGETS = {
    "source": 0.7,
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11},
    "topic": {"prose": 0.94, "tabular": 0.03, "noisy": 0.02, "shouting": 0.01},
}
MIX_SWEEPS = 10

#: Byte limit of a shard in the registered query.
SHARD_BYTES = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    return found.withColumns({"n_found": F.size("found").cast("long"), "n_spans": (F.size("base") + F.size("found")).cast("long")}).drop("base", "found")


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.payload_facts(warc.assemble(warc.without_payloads(warc.read_records(spark, path))))


def op4_proportional_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.content_topic(F.col("text"))}
    mixed = mixing.mix(table(spark, sf_dir, "documents"), dims, MIX_TARGETS, sweeps=MIX_SWEEPS)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 9).alias("prob"), "sampled")


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.harmonic_pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_relative_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring.parse_repeats(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_sort(table(spark, sf_dir, "documents"), keep="largest")


def op9_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), anchor=F.col("vec_id") % 50 == 0)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.histograms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_facts(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS h
  FROM documents),
b AS (
  SELECT depth, substr(h, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth)
  GROUP BY 1, 2
  HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h) OR depth = 60),
m AS (
  SELECT d.doc_id, any_value(d.n_bytes) AS n_bytes, min(b.depth) AS depth, any_value(h) AS h
  FROM d JOIN b ON substr(d.h, 1, b.depth) = b.shard
  GROUP BY d.doc_id)
SELECT m.doc_id, m.n_bytes, b.shard, b.depth, b.shard_bytes, b.shard_rows, b.shard_bytes > {SHARD_BYTES} AS oversized
FROM m JOIN b ON b.depth = m.depth AND b.shard = substr(m.h, 1, m.depth)
"""



def _mix_sql() -> str:
    steps = [
        r"""d AS (
  SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
         CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' WHEN contains(coalesce(text, ''), '!!') THEN 'shouting'
              WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{3}') THEN 'noisy' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, target in MIX_TARGETS.items():
        if isinstance(target, dict):
            named = " ".join(f"WHEN '{v}' THEN {s}" for v, s in target.items())
            left = max(0.0, 1.0 - sum(target.values()))
            steps.append(f"s_{dim} AS (SELECT {dim}, sum(tokens) AS m, CASE {dim} {named} END AS n FROM c GROUP BY 1)")
            # Unnamed values share what is left of 1; where nothing is, they keep their natural share.
            u, k, n = f"(SELECT sum(m) FROM s_{dim} WHERE n IS NULL)", f"(SELECT sum(m) FROM s_{dim} WHERE n IS NOT NULL)", f"(SELECT sum(n) FROM s_{dim})"
            rest = f"{left} * m / nullif({u}, 0)" if left > mixing.NOTHING_LEFT else f"CASE WHEN {k} > 0 AND {n} > 0 THEN {n} * m / {k} ELSE m END"
            steps.append(f"r_{dim} AS (SELECT {dim}, coalesce(n, {rest}) AS s FROM s_{dim})")
        else:
            steps.append(f"r_{dim} AS (SELECT {dim}, pow(sum(tokens), {target}) AS s FROM c GROUP BY 1)")
        steps.append(f"t_{dim} AS (SELECT {dim}, CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE 0.0 END AS t_{dim} FROM r_{dim})")
    joins = " ".join(f"JOIN t_{dim} USING ({dim})" for dim in MIX_TARGETS)
    steps.append(f"w0 AS MATERIALIZED (SELECT *, tokens AS weight FROM c {joins})")
    n = 0
    for _ in range(MIX_SWEEPS):
        for dim in MIX_TARGETS:
            n += 1
            steps.append(f"w{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {dim}) > 0 THEN weight * t_{dim} / sum(weight) OVER (PARTITION BY {dim}) ELSE 0.0 END AS weight) FROM w{n - 1})")
    steps.append(f"q AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0.0 END AS rate FROM w{n})")
    steps.append("p AS (SELECT source, lang, topic, CASE WHEN max(rate) OVER () > 0 THEN rate / max(rate) OVER () ELSE 0.0 END AS prob FROM q)")
    uniform = "CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, n_tokens, round(prob, 9) AS prob, {uniform} < prob AS sampled FROM d JOIN p USING (source, lang, topic)"


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 20)) AS k)),
k AS (SELECT doc_id, ws[i] AS w, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t) ANTI JOIN c USING (doc_id, i)),
j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN j USING (doc_id)
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

OP10_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i+4] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (
  SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda w: lower(w) IN ({_STOPS}))) AS stops,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS uppers,
         length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters
  FROM l LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN 2.0 AND 14.0
       AND n_symbols / n_words <= 0.5
       AND (n_words < 50 OR stops / n_words >= 0.01)
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5)
       AND (letters = 0 OR uppers / letters <= 0.7) AS kept
FROM v
"""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(sha1(b), 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""

OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CASE WHEN len(c.v) = 0 THEN 0 ELSE CAST(list_inner_product(a.v, c.v) AS BIGINT) END AS score
  FROM r a JOIN r c ON len(a.v) = len(c.v)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP12_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
f AS (
  SELECT part, good, toxic,
         CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM t),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
m AS (SELECT *, contains(fails, own) AS failing, translate(earlier, fails, '') <> earlier AS gone FROM s, h),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

_QUERIES: dict[str, Query] = {
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_extendible_sharding": op3_extendible_sharding,
    "op4_proportional_mix": op4_proportional_mix,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_relative_parsing": op6_relative_parsing,
    "op7_prob_minhash": op7_prob_minhash,
    "op8_content_sort": op8_content_sort,
    "op9_word_backoff": op9_word_backoff,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_one_permutation_minhash": op13_one_permutation_minhash,
}

QUERIES: dict[str, Query] = {name: shipped(f) for name, f in _QUERIES.items()}

SQL: dict[str, str] = {
    "op2_warc_transactions": OP2_SQL,
    "op3_extendible_sharding": OP3_SQL,
    "op4_proportional_mix": _mix_sql(),
    "op6_relative_parsing": OP6_SQL,
    "op8_content_sort": OP8_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_interactions": OP12_SQL,
}
