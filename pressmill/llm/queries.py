"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressmill.llm import decontaminate, fingerprints, langid, licenses, packing, quality, records, simhash, substrings, urlfilter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chunk digests, which share of it other documents have too, and which one holds most of it.

    All rows of documents, a row each.  Null and empty texts have an empty fingerprint; rows equal in doc_id and text are one document; ties go to
    the least doc_id; see fingerprints.corpus_containment.
    """
    return fingerprints.corpus_containment(_documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, of however few words, found in a document, with its place in the original text.

    All of documents against all of benchmark.  Null and empty texts have none; each of several equal rows has its own; see decontaminate.scan.
    """
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more that an earlier document has too.

    All of documents.  Null, empty and short texts have none; rows equal in doc_id and text are one document; ties go to the earlier document; see substrings.passages.
    """
    return substrings.repeats(_documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL and how likely it is bad.

    All of pages, a row each; labels are the seed list's.  A null or empty URL has no probability and isn't accepted; see urlfilter.score.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlfilter.score(pages, urlfilter.train(pages))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's token ids as framed records; the rows are their index.

    All of documents, a record each; null and empty texts have one without tokens; see records.write.
    """
    return records.write(_documents(spark, sf_dir), records.new_folder(spark))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality by the labellers' votes and by the scorer trained on them.

    All of documents, a row each; null and empty texts aren't accepted; equal rows are judged alike; see quality.judge.
    """
    docs = _documents(spark, sf_dir)
    return quality.judge(docs, *quality.train(docs))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of each near-duplicate and the kept_doc_id that stays in its place.

    All of documents.  Null, empty and white-space texts have no row; of rows equal in doc_id and text all but one have; ties go to the least doc_id; see simhash.groups.
    """
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, the cosine with its prototype, and whether it is accepted.

    All of documents, a row each.  Null, empty and letterless texts have no language; ties go to the first language by name; see langid.identify.
    """
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.selectExpr("doc_id", "__pm_language as language", "__pm_cosine as cosine", "__pm_accepted as accepted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each license notice in a document, with its coverage and place.

    All of documents.  Null and empty texts have none; each of several equal rows has its own; see licenses.scan.
    """
    return licenses.scan(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, or places, in sequences of 4,096 tokens.

    All of documents.  Null and empty texts have none; each of several equal rows has its own; see packing.pack.
    """
    return packing.pack(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_token_records": op5_token_records,
    "op6_quality": op6_quality,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
}
_WORD, _OTHER = r"[\p{L}\p{N}\p{M}]+", r"[^\p{L}\p{N}\p{M}]+"
ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
        with pieces as (select row, doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from (select row_number() over () as row, doc_id, regexp_extract_all(text, '{_WORD}|{_OTHER}') as tokens from documents where text is not null)),
        placed as (select *, sum(length(token)) over (partition by row order by i) as stop from pieces),
        docs as (select row, any_value(doc_id) as doc_id, list(lower(token) order by i) as w, list(stop - length(token) order by i) as b, list(stop order by i) as e from placed where regexp_matches(token, '{_WORD}') group by row),
        items as (select distinct item_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) as p from benchmark where item_id is not null and text is not null),
        found as (select *, len(p) as n from docs, items where len(p) > 0 and contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
        places as (select *, unnest(range(1, len(w) - n + 2)) as i from found)
        select doc_id, item_id, cast(b[i] as integer) as "begin", cast(e[i + n - 1] as integer) as "end", cast(n as integer) as words from places where w[i : i + n - 1] = p
    """,
}
