"""Tables with many copies, ids that don't name one text, and other cases that small tables hide."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tramo.llm import exact_dedup, langid, ngram_join, token_file


@pytest.mark.parametrize("texts", [20, 1])
def test_languages_of_copies_have_centroids(spark, texts):
    few = spark.range(30_000).select(F.concat(F.lit("sch ung pf "), F.repeat(F.lit("ein "), (F.col("id") % texts + 1).cast("int"))).alias("text"), F.lit("yy").alias("lang"))
    many = spark.range(900).select(F.concat(F.lit("kato miru "), F.col("id").cast("string"), F.lit(" toka"), F.repeat(F.lit(" ka"), (F.col("id") % 7).cast("int"))).alias("text"), F.lit("xx").alias("lang"))
    d = few.union(many)
    model = langid.fit(d)
    assert sorted(model.langs) == ["xx"] * 4 + ["yy"] * min(texts, 4)
    assert model.nearest(["sch ung pf ein ein", "kato miru toka"])[0] == ["yy", "xx"]
    chosen = langid.choose(d.select("lang", langid._key("text").alias("key")), 300)
    assert {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {"xx": 300, "yy": texts}


def test_exact_dedup_drops_rows_for_their_own_text(spark):
    rows = [(None, "a"), (None, "b"), (14, "A"), (13, "a"), (13, "b c"), (15, "d"), (None, None)]
    got = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))).collect()
    assert {(r.doc_id, r.text) for r in got} == {(None, "b"), (14, "A"), (13, "b c"), (15, "d"), (None, None)} and len(got) == 5


def test_ngram_join_drops_rows_for_their_own_text(spark):
    near = " ".join(f"common{k}" for k in range(60))
    rows = [(12, near + " end"), (13, near + " other"), (13, "quite another text of some words"), (None, near), (11, None), (14, near + " end"), (12, near + " end"), (15, "")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)), ngram_join.Join(3, 90)).collect()
    want = [(12, near + " end"), (13, rows[2][1]), (None, near), (11, None), (12, near + " end"), (15, "")]
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(want, key=repr)


def test_token_files_of_the_query_equal_the_library_by_default(spark):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a  b \n c <|endoftext|> \\ </s>", "x<|endoftext|>y", "<|endoftext|>", " <|endoftext|>  z <|endoftext|> ", "b\n <|endoftext|><|endoftext|> c", "<|endoftext |>", "plain words"]
    got = token_file.encode_to_files(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in want[0]
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
