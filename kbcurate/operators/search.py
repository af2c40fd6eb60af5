"""Search documents and finding entities by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbcurate.operators.ranks import gather
from kbcurate.operators.stats import rich_description
from kbcurate.sources.tables import live

# Candidates offered per name.
CANDIDATES = {"Country": 25}
DEFAULT_CANDIDATES = 100


def candidate_limit(entity_type: str) -> int:
    return CANDIDATES.get(entity_type, DEFAULT_CANDIDATES)


def typed_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(wikidata_id, type) of several typed tables."""
    out = None
    for name, df in tables.items():
        part = df.select("wikidata_id", F.lit(name).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def search_documents(typed: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents of live, labelled, typed entities, one each: distinct sorted types and labels. The
    labels of an entity come from its one dump document, which bounds them."""
    wanted = typed.select("wikidata_id", "type").distinct().join(
        live(entities).select("wikidata_id"), "wikidata_id", "left_semi"
    )
    types = wanted.groupBy("wikidata_id").agg(F.array_sort(F.collect_list("type")).alias("types"))
    texts = gather(
        labels.select(F.col("entity_id").alias("wikidata_id"), "label").distinct()
        .join(types, "wikidata_id", "left_semi"),
        ["wikidata_id"], F.col("label"), "labels",
    )
    return types.join(texts, "wikidata_id").select("wikidata_id", "types", "labels")


# --- keyword candidates ---------------------------------------------------------------------


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of a length."""
    count = F.length(text) - (size - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def _all_grams(text: Column) -> Column:
    return F.concat(*[_grams(text, n) for n in (1, 2, 3)])


def _query_grams(text: Column) -> Column:
    return (
        F.when(F.length(text) >= 3, _grams(text, 3))
        .otherwise(F.array(text))
    )


def find_similar_keyword(
    queries: DataFrame, labels: DataFrame, typed: DataFrame, limit: int
) -> DataFrame:
    """Per query ``(query_id, type, query)`` the entities of the type with a label containing it,
    blind to case: exact labels first, then labels starting with it, then shorter ones, then by
    id; at most ``limit`` each.

    Containment is found through a shared substring of up to three letters, for each query its
    rarest one among the labels, so it is an equality join and the text test sees few pairs.
    """
    texts = (
        labels.select(F.col("entity_id").alias("wikidata_id"), F.lower("label").alias("text"))
        .join(typed.select("wikidata_id", "type").distinct(), "wikidata_id")
        .select("wikidata_id", "type", "text").distinct()
    )
    asked = (
        queries.select("type", F.lower("query").alias("query"))
        .where(F.col("query") != "").distinct()
    )
    query_grams = asked.select("type", "query", F.explode(_query_grams(F.col("query"))).alias("gram"))
    index = (
        texts.select("type", "text").distinct()
        .select("type", "text", F.explode(_all_grams(F.col("text"))).alias("gram"))
        .join(query_grams.select("type", "gram").distinct(), ["type", "gram"], "left_semi")
    )
    frequency = index.groupBy("type", "gram").agg(F.count(F.lit(1)).alias("n"))
    probe = (
        query_grams.join(frequency, ["type", "gram"], "left")
        .groupBy("type", "query")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    )
    hits = index.join(probe, ["type", "gram"]).where(F.col("text").contains(F.col("query")))
    order = F.struct(
        (F.col("text") != F.col("query")).alias("inexact"),
        (~F.col("text").startswith(F.col("query"))).alias("inside"),
        F.length("text").alias("size"),
    )
    best = (
        hits.select("type", "query", "text").join(texts, ["type", "text"])
        .groupBy("type", "query", "wikidata_id").agg(F.min(order).alias("order"))
    )
    by_order = Window.partitionBy("type", "query").orderBy("order", "wikidata_id")
    top = best.withColumn("rank", F.row_number().over(by_order)).where(F.col("rank") <= limit)
    return (
        queries.withColumn("_q", F.lower("query")).alias("q")
        .join(top.withColumnRenamed("query", "_q").drop("order"), ["type", "_q"])
        .select("query_id", "type", "wikidata_id", "rank")
    )


# --- hybrid candidates ----------------------------------------------------------------------

_SCORED = "query_id string, wikidata_id string, score double"


def _block_scores(limit: int, ratio: float):
    def score(_key, queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or docs.empty:
            return pd.DataFrame(columns=["query_id", "wikidata_id", "score"])
        q = np.stack(queries["vector"].to_numpy()).astype(float)
        d = np.stack(docs["vector"].to_numpy()).astype(float)
        norms = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1))
        cosine = np.divide(q @ d.T, norms, out=np.zeros((len(q), len(d))), where=norms > 0)
        ids = docs["wikidata_id"].to_numpy()
        owner = np.repeat(np.arange(len(docs)), docs["labels"].map(len).to_numpy())
        texts = pd.Series([t.lower() for row in docs["labels"] for t in row], dtype=object)
        sizes = texts.map(len).to_numpy(dtype=float)
        out = []
        for i, (query_id, text) in enumerate(zip(queries["query_id"], queries["query"])):
            keyword = np.zeros(len(docs))
            if len(texts) and text:
                found = texts.str.contains(text.lower(), regex=False).to_numpy(dtype=bool)
                np.maximum.at(keyword, owner[found], len(text) / sizes[found])
            total = np.round((1 - ratio) * keyword + ratio * (1 + cosine[i]) / 2, 6)
            keep = np.lexsort((ids, -total))[:limit]
            out.append(pd.DataFrame(
                {"query_id": query_id, "wikidata_id": ids[keep], "score": total[keep]}
            ))
        return pd.concat(out)

    return score


def find_similar_hybrid(
    queries: DataFrame, documents: DataFrame, ratio: float, limit: int,
    docs_per_block: int = 20_000, queries_per_block: int = 500,
) -> DataFrame:
    """Per query ``(query_id, query, vector)`` the best documents ``(wikidata_id, labels, vector)``
    by a blend of keyword score (share of a label the query covers, 0 if not contained) and
    embedding similarity, ``ratio`` being the share of the latter. Exact.

    A blocked matrix product: documents and queries are cut into blocks of bounded size by hash,
    each pair of blocks is scored in one vectorised task, which returns its best ``limit`` per
    query only; the best of those are taken at the end.
    """

    def block(df: DataFrame, key: str, size: int) -> tuple[Column, Column]:
        blocks = F.greatest(F.lit(1), F.ceil(df.agg(F.count(F.lit(1))).scalar() / size)).cast("int")
        return blocks, F.pmod(F.xxhash64(key), blocks).cast("int")

    doc_blocks, doc_block = block(documents, "wikidata_id", docs_per_block)
    query_blocks, query_block = block(queries, "query_id", queries_per_block)
    left = queries.select("query_id", "query", "vector", query_block.alias("qb")).withColumn(
        "db", F.explode(F.sequence(F.lit(0), doc_blocks - 1))
    )
    right = documents.select("wikidata_id", "labels", "vector", doc_block.alias("db")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), query_blocks - 1))
    )
    scored = (
        left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db"))
        .applyInPandas(_block_scores(limit, ratio), _SCORED)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "wikidata_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def mapping_candidates(
    names: DataFrame, entity_type: str, labels: DataFrame, typed: DataFrame, entities: DataFrame,
    relations: DataFrame, limit: int | None = None,
) -> DataFrame:
    """Candidate entities for extracted names ``(query_id, query)``: keyword candidates that are
    live, with name and description."""
    asked = names.select("query_id", "query", F.lit(entity_type).alias("type"))
    found = find_similar_keyword(asked, labels, typed, limit or candidate_limit(entity_type))
    shown = live(entities).select("wikidata_id", "name")
    kept = found.join(shown, "wikidata_id")
    described = rich_description(kept.select("wikidata_id"), entities, relations)
    return kept.join(described, "wikidata_id").select(
        "query_id", "rank", "wikidata_id", "name", "description"
    )
