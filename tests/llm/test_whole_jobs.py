"""What an operator must not leave out."""

import collections
import zlib

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mixing, packing, queries
from tests.compare import assert_same
from tests.llm.fixtures import prose


def languages(spark, per_lang=40):
    rows = [(100 * n + i, prose(100 * n + i, 40), lang, "s") for n, lang in enumerate(["en", "de", "fr", "es", "it", None]) for i in range(per_lang)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_registered_targets_leave_a_share_for_unnamed_and_null_languages(spark, tmp_path):
    languages(spark).write.parquet(f"{tmp_path}/documents.parquet")
    mass, drawn = collections.Counter(), collections.Counter()
    for r in queries.op4_proportional_mix(spark, str(tmp_path)).collect():
        mass[r["lang"]] += r["prob"] * r["n_tokens"]
        drawn[r["lang"]] += r["sampled"]
    total = sum(mass.values())
    # Named values divide what the others' natural share leaves.
    for lang, share in queries.MIX_TARGETS["lang"].items():
        assert abs(mass[lang] / total - share * 4 / 6) < 1e-3
    for lang in ("it", "(null)"):
        assert abs(mass[lang] / total - 1 / 6) < 1e-3 and drawn[lang] > 0


def test_a_value_named_with_nothing_is_left_out_and_all_unnamed_stay(spark):
    dims = {"lang": F.col("lang")}
    out = mixing.mix(languages(spark), dims, {"lang": {"en": 1.0, "it": 0.0}}).collect()
    assert {r["lang"] for r in out if r["prob"] == 0} == {"it"}
    only = mixing.mix(languages(spark).where("lang = 'it' or lang is null"), dims, {"lang": queries.MIX_TARGETS["lang"]}).collect()
    assert all(r["prob"] > 0 for r in only)


def test_mixing_sql_has_the_operators_rule_for_unnamed_and_null_values(spark, tmp_path):
    extra = spark.createDataFrame([(5000, None, "it", None), (None, "no id here", None, "t"), (5001, "", "xx", "empty"), (5002, "a | b | c", "en", "t"), (5003, "HEY!! you", "pt", None)], "doc_id long, text string, lang string, source string")
    languages(spark).unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(queries.op4_proportional_mix(spark, str(tmp_path)), con, queries.SQL["op4_proportional_mix"])


def test_mixing_keeps_input_columns_of_any_name(spark):
    docs = languages(spark).limit(30).withColumns({"_d_lang": F.lit("mine"), "_d_source": F.lit(7), "__lang": F.lit("too")})
    out = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, {"lang": 1.0, "source": 0.5})
    assert set(docs.columns) < set(out.columns)
    assert {(r["_d_lang"], r["_d_source"], r["__lang"]) for r in out.collect()} == {("mine", 7, "too")}


def test_pipeline_fills_a_null_language_and_keeps_unnamed_ones(spark, sf_dir):
    docs = languages(spark).withColumn("text", F.concat(F.coalesce("lang", F.lit("it")), F.lit("wort "), F.col("text")))
    told = corpus_pipeline.language(spark, docs, sf_dir)
    assert told.columns == docs.columns
    by_id = {r["doc_id"]: r["lang"] for r in told.collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(by_id) == len(want) and all(want[i] in (None, lang) and lang for i, lang in by_id.items())
    assert "it" in {r["lang"] for r in corpus_pipeline.mix(spark, told, sf_dir).collect()}


def test_packing_encodes_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "<|startoftext|>stone's river<|endoftext|>", "<|ENDOFTEXT|> x", "<| endoftext |>", "plain 12 words", "日本 <|endoftext|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [320, 49407, 321]
    assert [np.frombuffer(raw, dtype="<u4").tolist() for raw in packing.encoder("word_bpe_49k.json")(texts)] == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op5_harmonic_packing(spark, str(tmp_path)).collect():
        ids = [*want[r["doc_id"]], 2]
        assert (r["length"], r["doc_tokens"], r["ids_crc32"]) == (len(ids), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
