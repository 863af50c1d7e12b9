"""A store whose recipes were damaged is not read."""

import shutil

import public_tokenizers
import pytest

from gridloom.llm import op5_token_store as op5


def test_op5_damaged_recipes_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of a few words " * (i % 3 + 1)) for i in range(20)], "doc_id long, text string")
    path = op5.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store"))
    assert op5.store_digests(spark, path).count() == 20
    recipes = spark.read.parquet(f"{path}/ordered/manifest=false")
    damages = (recipes.where("doc_id <> 7"), recipes.selectExpr("shard", "idx", "doc_id", "start + int(doc_id = 7) AS start", "n_tokens", "addresses"), recipes.where("false"))
    for k, damaged in enumerate(damages):
        other = str(tmp_path / f"other{k}")
        shutil.copytree(path, other)
        shutil.rmtree(f"{other}/ordered/manifest=false")
        damaged.write.parquet(f"{other}/ordered/manifest=false")
        with pytest.raises(ValueError, match="manifest"):
            op5.store_digests(spark, other)
