"""Line de-duplication: lines that too many documents share are dropped wherever they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, materialise, private

MAX_DOCS = 10


def normalised(line):
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def line_dedup(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the shared lines gone from the text, plus n_lines and n_dropped.

    A line (between newlines) goes from every document if more than max_docs distinct ids have it, compared after
    normalisation; the other lines keep their order. Blank lines are never counted or dropped.

    Null text stays null, with both counts 0; an empty text is one blank line. A null id counts as no document, but its
    text is cleaned too. Repeated rows count once by their id and are all cleaned. A text that loses all its lines
    becomes empty. Columns n_lines and n_dropped of docs are replaced. An empty table gives an empty result.

    Lines are parsed once, to a pair of hashes (96 bits) in the shared folder, so only hashes are shuffled. Which lines go depends on the text
    alone, hence the verdicts, (hash of text, positions), are joined back by the hash of the text: rows with equal
    texts share one verdict, and null or repeated ids need no care.
    """
    docs = docs.drop("n_lines", "n_dropped") if {"n_lines", "n_dropped"} & {c.lower() for c in docs.columns} else docs
    k, g, gone, lines = private(docs, "k", "g", "gone", "lines")
    text = column(text_col)

    cut = docs.where(text.isNotNull()).select(F.xxhash64(text).alias(k), F.hash(text).alias(g), column(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = cut.withColumn("line", normalised(F.col("line"))).where("line <> ''")
    each = materialise(line.withColumns({"h": F.xxhash64("line"), "h2": F.hash("line")}).drop("line"), "lines")
    frequent = each.groupBy("h", "h2").agg(F.countDistinct("id").alias("n")).where(F.col("n") > max_docs).select("h", "h2")
    hit = each.join(frequent, ["h", "h2"], "left_semi")
    verdict = hit.groupBy(k, g).agg(F.collect_set("pos").alias(gone))
    joined = docs.withColumns({k: F.xxhash64(text), g: F.hash(text)}).join(verdict, [k, g], "left").withColumn(lines, F.split(text, "\n"))
    kept = F.filter(F.col(lines), lambda _, i: ~F.array_contains(F.col(gone), i))
    out = joined.withColumns(
        {
            text_col: F.when(F.col(gone).isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_dropped": F.when(F.col(gone).isNull() | text.isNull(), 0).otherwise(F.size(gone)).cast("long"),
        }
    )
    return out.select(*[column(c) for c in docs.columns], "n_lines", "n_dropped")


SQL = f"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line, trim(regexp_replace(lower(parts[i]), '\\s+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), frequent AS (
  SELECT norm FROM lines WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > {MAX_DOCS}
), marked AS (
  SELECT l.*, f.norm IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.norm = f.norm
), cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT doc_id, text, lang, source, n_chars, n_lines, n_dropped
FROM cleaned JOIN (SELECT doc_id, lang, source, n_chars FROM documents) USING (doc_id)
"""
