"""HTML rows of the thumbnail and benchmark pages, as a column of text in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .describe import QUESTIONS
from .evaluate import total_band


def escape(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def thumb_rows(chunks: DataFrame) -> DataFrame:
    """(index, html): a header where the source changes, and a card per chunk.

    ``chunks`` has index, source_video, thumb, start, end, description, score, texts (array).
    """
    last = F.lag("source_video").over(Window.orderBy("index"))
    header = F.when(~last.eqNullSafe(F.col("source_video")), F.concat(F.lit("<h2>"), escape(text.base_name(F.col("source_video"))), F.lit("</h2>"))).otherwise(F.lit(""))
    times = F.format_string("%.1f-%.1f s", "start", "end")
    said = F.array_join(F.coalesce("texts", F.array().cast("array<string>")), " / ")
    card = F.concat(
        F.lit('<div class="card '), scoring.score_band(F.coalesce("score", F.lit(0.0))), F.lit('"><img src="'), escape(F.col("thumb")), F.lit('"><p>#'), F.col("index").cast("string"), F.lit(" "), times,
        F.lit("</p><p>"), escape(text.shorten(F.col("description"), 120)), F.lit("</p><p>"), escape(said), F.lit("</p></div>"),
    )
    return chunks.select("index", F.concat(header, card).alias("html"))


def score_rows(judged: DataFrame) -> DataFrame:
    """(index, html): a block per judged chunk with its answers and total."""
    marks = F.concat(*(F.concat(F.lit("<li class='"), F.when(F.col(q), "yes").otherwise("no"), F.lit(f"'>{q}</li>")) for q in QUESTIONS))
    block = F.concat(F.lit('<div class="'), total_band(F.col("total")), F.lit('"><pre>'), escape(F.col("desc_formatted")), F.lit("</pre><ul>"), marks, F.lit("</ul><b>"), F.col("total").cast("string"), F.lit(" / 7</b></div>"))
    return judged.select("index", block.alias("html"))


def write_page(rows: DataFrame, path: str, title: str) -> None:
    """One text file: a head, the rows in order, a tail. Pages are for reading, so rows are few."""
    body = rows.select(F.col("index").cast("bigint").alias("i"), "html")
    ends = rows.sparkSession.createDataFrame([(-1, f"<!doctype html><meta charset='utf-8'><title>{title}</title>"), (1 << 62, "</html>")], "i long, html string")
    body.unionByName(ends).coalesce(1).sortWithinPartitions("i").select("html").write.mode("overwrite").text(path)
