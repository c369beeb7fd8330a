"""The engine's calls: sources that are missing, errors as values, pages."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index, names
from corpusloom.plans.engine import Engine
from corpusloom.sources import adapters as ad


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(spark, ad.catalog(spark, sf_dir), index.build(ad.documents(spark, sf_dir)), ad.messages(spark, sf_dir))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, query string")


def test_too_broad_queries_are_rows(engine, spark):
    rows = engine.search_local_content(asked(spark, "the", " ", "人"), 3).collect()
    assert {r.query_id: r.error_code for r in rows} == {1: None, 2: "QUERY_TOO_BROAD", 3: "QUERY_TOO_BROAD"}
    assert all(r.line >= 1 and r.snippet is not None for r in rows if r.error_code is None)


def test_content_filters_apply_before_the_limit(engine, spark):
    rows = engine.search_local_content(asked(spark, "the"), 100, extensions=["md"]).filter("error_code is null").collect()
    assert rows and all(r.path_key.endswith(".md") for r in rows)


def test_names_and_raw(engine):
    assert engine.search_local_files(names.NameQuery("doc1", limit=5)).count() == 5
    assert all(r.extension == "md" for r in engine.search_catalog_query("ext:md file:").collect())


def test_missing_sources(engine, spark):
    only_index = Engine(spark, None, engine.index)
    only_names = Engine(spark, engine.catalog)
    sources = lambda e: {r.match_source for r in e.search_local_hybrid(asked(spark, "doc1", "the")).collect()}
    assert sources(only_index) == {"content"} and sources(only_names) == {"name"} and "content" in sources(engine)
    for call in (lambda: only_names.search_local_content(asked(spark, "x")), lambda: only_index.search_catalog_query("x"), lambda: Engine(spark).search_local_hybrid(asked(spark, "x"))):
        with pytest.raises(RuntimeError):
            call()
    with pytest.raises(ValueError):
        engine.search_local_content(asked(spark, "x"), 0)


def test_mail_is_merged(engine, spark):
    rows = engine.search_hybrid_with_mail(asked(spark, "the user"), 10).collect()
    assert sorted(r.position for r in rows) == list(range(len(rows))) and any(r.kind == 1 for r in rows)


def test_status(engine, sf_dir, spark):
    assert engine.status().filter("measure = 'documents'").first().n == ad.read(spark, sf_dir, "documents").agg(F.count("*")).first()[0]
