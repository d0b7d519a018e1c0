"""Full-text search by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import shared_root
from . import lists
from .lists import BUCKETS
from .sparse import DIGITS, top_per_query

K1, B = 1.2, 0.75


def term_table(docs: DataFrame, id_col: str = "id", text_col: str = "text", stemming: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, count, length): how often each term stands in each document, and the document's terms in all.

    A row of docs is a document. With wanted, a table of terms, only these are given.
    """
    each = t.term_counts(docs, id_col, text_col, stemming)
    return each if wanted is None else each.join(wanted.select("term"), "term", "left_semi").select("id", "term", "count", "length")


def corpus(docs: DataFrame, id_col: str = "id", text_col: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """(n_docs, avgdl) of the documents with a text, by tokens that count; from their postings if these are known."""
    if postings is None:
        totals = t.lengths(docs, text_col).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    else:
        some = docs.where(F.col(text_col).isNotNull()).agg(F.count("*").alias("n_docs"))
        totals = some.crossJoin(postings.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")))
    return totals.select("n_docs", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs")).alias("avgdl"))


def query_terms(queries: DataFrame, query_id_col: str = "query_id", text_col: str = "text", stemming: bool = True) -> DataFrame:
    """(query_id, term): the distinct terms of each query; how often one stands in the query doesn't count."""
    return queries.select(F.col(query_id_col).alias("query_id"), F.explode(F.array_distinct(t.terms(F.col(text_col), stemming))).alias("term"))


def scored(postings: DataFrame, asked: DataFrame, n_docs: Column, avgdl: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) from postings of the terms asked, all documents' of these terms, as df is counted on them."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = t.tf(F.col("count"), F.col("length"), avgdl, k1, b) * t.idf(n_docs, F.col("df"))
    weighted = postings.join(df, "term").select("term", "id", weight.alias("w"))
    return weighted.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), DIGITS).alias("score"))


def scores(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, avgdl: float | None = None, stemming: bool = True, id_col: str = "id", text_col: str = "text", query_id_col: str = "query_id", query_text_col: str = "text") -> DataFrame:
    """(query_id, id, score) of every document that has a term of the query, without an index.

    Document frequencies are of the documents given. avgdl defaults to their mean. Only postings of terms that some
    query has are kept, before document frequencies are counted, so the shuffle is of those alone.
    """
    asked = query_terms(queries, query_id_col, query_text_col, stemming)
    table = term_table(docs, id_col, text_col, stemming, asked.select("term").distinct())
    totals = corpus(docs, id_col, text_col).first()
    mean = avgdl if avgdl is not None else totals["avgdl"]
    return scored(table, asked, F.lit(totals["n_docs"]), F.lit(mean).cast("double"), k1, b)


def best(found: DataFrame, k: int = 10, bucketed: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k best documents of each query, ties to the smallest id.

    bucketed keeps one document, the best, of each residue of the id modulo 512 first; ids must be whole numbers.
    """
    if bucketed:
        one = F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("best")
        found = found.groupBy("query_id", F.pmod(F.col("id"), F.lit(BUCKETS)).alias("bucket")).agg(one).select("query_id", "best.id", "best.score")
    return top_per_query(found, k)


def list_search(built: lists.Lists, queries: DataFrame, k: int = 10, bucketed: bool = False, k1: float = K1, b: float = B, avgdl: float | None = None, query_id_col: str = "query_id", query_text_col: str = "text", rows: list | None = None) -> DataFrame:
    """(query_id, rank, id, score) over lists of documents' terms; see best(). rows are the queries' terms where they are known."""
    asked = query_terms(queries, query_id_col, query_text_col, built.stemming)
    rows = rows if rows is not None else lists.asked_rows(asked, "term")
    if rows is not None:
        return best(lists.text_best(built, asked, rows, k, k1, b, avgdl, bucketed), k, bucketed)
    postings = built.postings(queries.sparkSession).join(asked.select("term").distinct(), "term", "left_semi")
    mean = avgdl if avgdl is not None else built.total / built.n_docs if built.n_docs else None
    return best(scored(postings, asked.distinct(), F.lit(built.n_docs), F.lit(mean).cast("double"), k1, b), k, bucketed)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, bucketed: bool = False, k1: float = K1, b: float = B, avgdl: float | None = None, stemming: bool = True,
    id_col: str = "id", text_col: str = "text", query_id_col: str = "query_id", query_text_col: str = "text",
) -> DataFrame:
    """(query_id, rank, id, score): the k best documents of each query, ties to the smallest id, without an index; see best().

    The texts are read once: what they have of the terms asked goes to the shared folder, a row a document.
    """
    rows = lists.asked_rows(query_terms(queries, query_id_col, query_text_col, stemming), "term")
    wanted = None if rows is None else sorted({term for _, term, *_ in rows})
    built = lists.build(docs, shared_root(docs.sparkSession), id_col, text_col, stemming, wanted)
    return list_search(built, queries, k, bucketed, k1, b, avgdl, query_id_col, query_text_col, rows)
