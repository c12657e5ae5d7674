"""Answers of outside search services as corpus documents: parsing, filters, union, de-duplication and cache.

Fetching is a hook: `fetched` calls a function for each distinct query in Arrow batches; everything after
that is Column expressions over the JSON bodies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import let, strip_tags

LEAST_CHARS, MOST_DOCS = 80, 40
DOC = ("query", "place", "title", "url", "content")


def cache_key(query: Column) -> Column:
    return F.sha1(F.lower(query))


def fetched(queries: DataFrame, query: str, get: Callable[[str], str | None]) -> DataFrame:
    """(query, body): what `get` answers to each distinct query; null where it fails or has nothing."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for q in batch["query"]:
                try:
                    bodies.append(get(q))
                except Exception:  # a service that fails is one that has nothing
                    bodies.append(None)
            yield pd.DataFrame({"query": batch["query"], "body": pd.Series(bodies, dtype=object)})

    return queries.select(F.col(query).alias("query")).where("query is not null").distinct().mapInPandas(call, "query string, body string")


def inverted_text(index: Column) -> Column:
    """The text of a map from word to its positions; a position without a word is an empty one."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    # In order of position, each word with as many spaces before it as positions it lies after the last one.
    def joined(at: Column) -> Column:
        step = F.zip_with(at, F.concat(F.array(F.lit(0)), F.slice(F.transform(at, lambda x: x["p"]), 1, F.greatest(F.size(at) - 1, F.lit(0)))), lambda x, before: F.concat(F.repeat(F.lit(" "), x["p"] - before), x["w"]))
        return F.trim(F.array_join(step, ""))

    return F.when(F.size(index) > 0, let(F.array_sort(places), joined)).otherwise("")


def _docs(rows: DataFrame, title: Column, other: str, url: Column, abstract: Column) -> DataFrame:
    named = F.when(F.trim(title) != "", F.trim(title)).otherwise(other)
    rows = rows.select("query", "place", named.alias("title"), url.alias("url"), F.trim(F.concat(named, F.lit(". "), F.coalesce(abstract, F.lit("")))).alias("content"))
    return rows.where(F.length("content") >= LEAST_CHARS)


def works(bodies: DataFrame) -> DataFrame:
    """Documents of scholarly works (query, body) whose abstracts come as inverted indexes."""
    schema = "results array<struct<id: string, doi: string, title: string, abstract_inverted_index: map<string, array<int>>>>"
    rows = bodies.select("query", F.posexplode(F.from_json("body", schema)["results"]).alias("place", "x"))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("x.doi")), F.col("x.id"), F.lit("unknown"))
    return _docs(rows, F.col("x.title"), "Untitled work", url, inverted_text(F.col("x.abstract_inverted_index")))


def registry(bodies: DataFrame) -> DataFrame:
    """Documents of a registry of identifiers (query, body) whose abstracts hold mark-up."""
    schema = "message struct<items: array<struct<DOI: string, title: array<string>, abstract: string>>>"
    rows = bodies.select("query", F.posexplode(F.from_json("body", schema)["message"]["items"]).alias("place", "x"))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("x.DOI")), F.lit("unknown"))
    return _docs(rows, F.get("x.title", 0), "Untitled entry", url, strip_tags(F.coalesce("x.abstract", F.lit(""))))


def summaries(bodies: DataFrame) -> DataFrame:
    """Documents of an encyclopedia's page summaries (query, body), of which the extract alone must be long enough."""
    schema = "title string, extract string, content_urls struct<desktop: struct<page: string>>"
    rows = bodies.select("query", F.lit(0).alias("place"), F.from_json("body", schema).alias("x")).where((F.length(F.trim("x.extract")) >= LEAST_CHARS) & F.col("x.title").isNotNull())
    return rows.select("query", "place", F.col("x.title").alias("title"), F.coalesce("x.content_urls.desktop.page", F.lit("unknown")).alias("url"), F.concat("x.title", F.lit(". "), F.trim("x.extract")).alias("content"))


def live_corpus(*sources: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """(id, query, title, url, content): the first `most` documents of each query over all sources, one for each title and address.

    Sources count in the order given, documents in the order of the answer. A cut at `most` is the feature.
    """
    every = None
    for n, source in enumerate(sources):
        one = source.select(*DOC).withColumn("source", F.lit(n))
        every = one if every is None else every.unionByName(one)
    order = [F.col("source"), F.col("place"), F.col("url")]
    kept = every.withColumn("r", F.row_number().over(Window.partitionBy("query", F.lower("title"), F.lower("url")).orderBy(*order))).where("r = 1")
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= most)
    return kept.select(F.concat_ws("-", F.xxhash64("title", "url").cast("string"), cache_key(F.col("query"))).alias("id"), "query", "title", "url", "content")


def external_score(body: Column) -> Column:
    """struct<probability, label> of an outside detector's answer in either of two shapes; null if it holds no number."""
    x = F.from_json(body, "documents array<struct<completely_generated_prob: double>>, probability double, score double, label string")
    nested = F.get(x["documents"], 0)["completely_generated_prob"]
    raw = F.coalesce(nested, x["probability"], x["score"])
    p = F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 10000 + 0.5) / 10000.0
    return F.when(raw.isNotNull() & ~F.isnan(raw), F.struct(p.alias("probability"), F.when(nested.isNotNull(), "nested").otherwise(F.coalesce(x["label"], F.lit("external"))).alias("label")))
