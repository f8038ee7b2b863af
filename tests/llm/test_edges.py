"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pressmill.llm import decontaminate, fingerprints, langid, licenses, packing, quality, queries, records, simhash, storage, substrings, urlfilter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node long, id string, th int, k string, v string, w string, x int, y int, tokens string, `group` string, language string, `a.b` string, text_hash string, n int, count int, root string, copies string, accepted string, item_id string, begin int, spans string, lengths string, `__pm_k` string, `__pm_h` string, `__pm_id` string, `__pm_n` string, `__PM_TEXT` string, places string, kk string, f string, b string, bytes string"
STORY = "The quick brown fox met the lazy dog by the river and they spoke of all the things that had been and would be, until the sun went down over the hills. "
LONG = " ".join(f"w{i % 9973}x{i % 7}" for i in range(120_000))
ROWS = [(None, STORY + "no id"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, STORY * 3), (5, STORY * 3), (6, STORY * 3), (7, "x"), (8, "!!! ???"), (8, "!!! ???"), (9, "\0 nul \U0001f600 é́ ͸"), (None, None), (10, "a " * 3000), (11, "a" * 100_000)]
DOC = ["doc_id", "text"]


@pytest.fixture(scope="module")
def nasty(spark):
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    rows = [(i, t, "en" if t and len(t) > 100 else None, None, None if t is None else len(t), *([None] * (len(names) - 5))) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(nasty):
    return nasty.limit(0).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, STORY, None), (1, STORY, None), (None, STORY, "x"), (2, None, None), (3, "", None), (4, "short", None)], "item_id bigint, text string, doc_id string")


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


def own(i):
    return (i is not None, i or 0)


ALL = sorted(own(i) for i, _ in ROWS)


def test_fingerprints(nasty, empty):
    rows = fingerprints.corpus_containment(nasty).collect()
    assert ids(rows) == ALL
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].digests == [] and by[1].containment == 0
    assert by[5].containment == 1 and by[8].containment == 0 and by[8].bytes == 7  # equal rows are one document
    assert fingerprints.corpus_containment(empty).count() == 0


def test_decontamination(nasty, empty, benchmark):
    rows = decontaminate.leaks(nasty, benchmark).collect()
    assert {r.doc_id for r in rows if r.item_id == 4} == set()  # "short" is in none
    assert sorted((own(r.doc_id), r.item_id, r.begin) for r in rows) == sorted((own(i), 1, k * len(STORY)) for i, n in ((None, 1), (5, 3), (5, 3), (6, 3)) for k in range(n))
    left = decontaminate.drop_leaks(nasty, benchmark)
    assert left.columns == nasty.columns
    assert ids(left.collect()) == sorted(own(i) for i, t in ROWS if not (t and STORY.strip() in t))
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(nasty, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(nasty, benchmark.limit(0)).count() == len(ROWS)


def test_substring_dedup(nasty, empty):
    rows = {(r.doc_id, r.kept_doc_id) for r in substrings.repeats(nasty).collect()}
    assert (6, 5) in rows and all(b is not None for _, b in rows)
    left = substrings.drop_repeats(nasty)
    assert left.columns == nasty.columns
    out = [(r.doc_id, r.text) for r in left.collect()]
    assert {6} == {i for i, _ in ROWS if i is not None} - {i for i, _ in out}
    assert out.count((1, None)) == 1 and out.count((2, "")) == 1 and (4, LONG) in out and out.count((5, STORY * 3)) == 2
    assert substrings.repeats(empty).count() == 0 and substrings.drop_repeats(empty).count() == 0


def test_url_filter(spark):
    schema = "page_id bigint, url string, html string, text string, y int, bad string"
    rows = [(i, u, None, None, None, None) for i, u in enumerate([None, "", "no url", "http://", "http://" + "a" * 50_000 + ".com/?x=%20&y", "https://spam.test/", "https://é.test/ü"])] + [(None, "https://fine.test/a", None, None, None, None)] * 2
    pages = spark.createDataFrame(rows, schema)
    found = urlfilter.score(pages, urlfilter.train(pages)).collect()
    assert len(found) == len(rows) and all((r.bad is None) == (not r.url) for r in found) and not any(r.accepted for r in found if not r.url)
    nothing = urlfilter.train(pages.limit(0))
    assert urlfilter.score(pages.limit(0), nothing).count() == 0 and {r.bad for r in urlfilter.score(pages, nothing).collect()} <= {None, 0.0001}


def test_records(nasty, empty, tmp_path):
    index = records.write(nasty, str(tmp_path / "a")).cache()
    assert ids(index.collect()) == ALL
    back = records.read(index, str(tmp_path / "a")).collect()
    assert ids(back) == ALL and [len(r.ids) for r in back if r.doc_id == 1] == [0]
    assert records.write(empty, str(tmp_path / "b")).count() == 0


def test_quality(nasty, empty):
    rows = quality.judge(nasty, *quality.train(nasty)).collect()
    assert ids(rows) == ALL
    assert all(r.score == 0 and not r.accepted for r in rows if r.doc_id in (1, 2, 3))
    assert quality.judge(empty, *quality.train(empty)).count() == 0 and quality.judge(nasty, *quality.train(empty)).count() == len(ROWS)


def test_simhash(nasty, empty):
    rows = sorted((own(r.doc_id), r.kept_doc_id) for r in simhash.near_duplicates(nasty).collect())
    assert [r for r in rows if r[0][1] in (5, 6, 8)] == [(own(5), 5), (own(6), 5), (own(8), 8)]
    left = simhash.drop_near_duplicates(nasty)
    assert left.columns == nasty.columns
    out = ids(left.collect())
    assert out.count(own(5)) == 1 and out.count(own(8)) == 1 and own(6) not in out and all(own(i) in out for i in (1, 2, 3, 4, 7, 9, 11))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_a_null_id_stays_if_it_is_alone(spark):
    d = spark.createDataFrame([(None, STORY), (3, STORY), (None, "something else altogether")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(d).collect()) == [(0, "something else altogether"), (3, STORY)]
    assert [(r.doc_id, r.kept_doc_id) for r in simhash.near_duplicates(d).collect()] == [(None, 3)]


def test_language_id(nasty, empty):
    found = langid.identify(nasty, langid.train(nasty))
    assert found.columns == [*nasty.columns, "__pm_language", "__pm_cosine", "__pm_accepted"]
    rows = found.select("doc_id", F.col("__pm_language").alias("l"), F.col("__pm_cosine").alias("c"), F.col("__pm_accepted").alias("a")).collect()
    assert ids(rows) == ALL and all(r.l is None and r.c == 0 and not r.a for r in rows if r.doc_id in (1, 2, 3, 8))
    assert all(r.a for r in rows if r.doc_id == 5)
    assert langid.train(empty) == {} and langid.identify(empty, {}).count() == 0
    assert not any(r["__pm_accepted"] for r in langid.identify(nasty, {}).collect())


def test_ties_go_to_the_first_language(spark):
    p = langid.train(spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id int, text string, lang string"))
    assert langid.identify(spark.createDataFrame([(1, "same words")], "doc_id int, text string"), p).first()["__pm_language"] == "a"


def test_license_scan(nasty, empty):
    d = nasty.select(*(F.when(F.col("doc_id") == 7, "MIT. Released under the MIT License").otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in nasty.columns))
    assert [(r.doc_id, r.license, r.begin) for r in licenses.scan(d).collect()] == [(7, "MIT notice", 5)]
    assert licenses.scan(empty).count() == 0 and licenses.scan(d, {}).count() == 0 and licenses.scan(d, {"none": "--"}).count() == 0


def test_packing(nasty, empty):
    rows = packing.pack(nasty).collect()
    assert {own(r.doc_id) for r in rows} == {own(i) for i, t in ROWS if t}
    assert sum(r.tokens for r in rows if r.doc_id == 5) == 2 * sum(r.tokens for r in rows if r.doc_id == 6)
    assert max(r.tokens for r in rows) == packing.CAPACITY and len([r for r in rows if r.doc_id == 4]) > 20
    assert packing.pack(empty).count() == 0


def test_every_query_states_its_table():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11)) and all(q.__doc__ for q in queries.QUERIES.values())


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(spark)


def test_names_that_a_table_lacks(spark):
    d = spark.createDataFrame([(1, 2, 3)], "`__PM_K` int, `__pm_k_` int, k int")
    assert storage.unused(d, "k", "k", "h") == ["__pm_k__", "__pm_k___", "__pm_h"]


def test_helper_columns_of_the_caller_come_back_as_they_were(spark, benchmark):
    rows = [(i, STORY * 2 if i < 2 else f"other text number {i}", f"a{i}", f"b{i}") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, `__pm_k` string, `__pm_h` string")
    for left in (decontaminate.drop_leaks(d, benchmark), substrings.drop_repeats(d), simhash.drop_near_duplicates(d)):
        found = left.collect()
        assert found and all((r["__pm_k"], r["__pm_h"]) == (f"a{r.doc_id}", f"b{r.doc_id}") for r in found)


def test_an_id_that_is_a_limit_is_no_null(spark):
    least, most = -(2**63), 2**63 - 1
    d = spark.createDataFrame([(least, STORY * 3), (most, STORY * 3 + "x"), (None, STORY * 3 + "y z")], "doc_id bigint, text string")
    assert {(r.doc_id, r.kept_doc_id) for r in substrings.repeats(d).collect()} == {(most, least), (None, least)}
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.kept_doc_id) for r in simhash.near_duplicates(d).collect())) == [(False, most, least), (True, 0, least)]
    assert [r.doc_id for r in simhash.drop_near_duplicates(d).collect()] == [least]
