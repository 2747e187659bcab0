"""Each query of the library against its SQL over the smallest tables; those without SQL must give rows of one schema."""

import compare
import pytest
from pyspark.sql import functions as F

from curato.plans import files, relational, scalars, structures

ALL = {n: (p, c.sql.get(n)) for c in (scalars.catalog, relational.catalog, structures.catalog, files.catalog) for n, p in c.plans.items()}
MAY_BE_EMPTY = {"a25_tag_rate"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.tables(sf)


@pytest.mark.parametrize("name", [n for n in ALL if ALL[n][1]])
def test_against_sql(name, spark, sf, con):
    plan, sql = ALL[name]
    assert compare.difference(plan, sql, spark, sf, con) is None


@pytest.mark.parametrize("name", [n for n in ALL if not ALL[n][1]])
def test_runs(name, spark, sf):
    df = ALL[name][0](spark, sf)
    assert df.columns and (df.select(F.count(F.lit(1))).first()[0] > 0 or name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", ["f25_chinese_patent", "l16_key_sentences"])
def test_sees_every_document(name, spark, sf):
    # the patent splitter finds no section in texts of a few characters
    every = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) >= 40").select("doc_id").collect()}
    assert {r[0] for r in ALL[name][0](spark, sf).select("doc_id").collect()} >= every


def test_simhash_dedup_keeps_long_questions(spark, tmp_path):
    texts = ["a short one. yes", "a short one. no", " ".join(f"word{i}" for i in range(200))]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.id for r in ALL["d04_simhash"][0](spark, str(tmp_path)).collect()} == {0, 2}
