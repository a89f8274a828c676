"""Structure of paged texts: headed sections with page provenance, and their parts. Statutes are in `statutes`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import relational as R

#: Headings of documents.
HEADING = r"^(?U)\s*(?:(?:Article|ARTICLE|المادة)\s+\S+.*|(?:Objet|OBJET)\s*:.*|(?:CONTRAT DE TRAVAIL|Section|Chapitre|الفصل|الباب).{0,80})\s*$"


def lines(pages: DataFrame) -> DataFrame:
    """pages (doc, page_no, text) -> doc, line (from 0), page_no, start, end, text: offsets in the pages joined by line feeds."""
    rows = pages.select("doc", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
    w = Window.partitionBy("doc").orderBy("page_no", "k")
    size = F.length("text").cast("long")
    return rows.select("doc", "page_no", "text", (F.row_number().over(w) - 1).cast("long").alias("line"), (F.sum(size + 1).over(w) - size - 1).alias("start"), (F.sum(size + 1).over(w) - 1).alias("end"))


def heading_sections(pages: DataFrame) -> DataFrame:
    """pages (doc, page_no, text, confidence, review) -> doc, section (s1..), title, text, page_start, page_end, start, end, confidence, needs_review."""
    every = Window.partitionBy("doc").orderBy("line")
    rows = lines(pages).withColumn("_cut", (F.col("text").rlike(HEADING) & (F.col("start") > 0)).cast("int"))
    rows = rows.withColumn("_part", F.sum("_cut").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("doc", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    body = T.strip(F.array_join(F.transform("l", lambda x: x.text), "\n"))
    first = F.get(F.filter(F.transform("l", lambda x: T.collapse(x.text)), lambda x: F.length(x) > 0), F.lit(0))
    parts = parts.select("doc", "_part", "start", "end", body.alias("text"), F.substring(first, 1, 200).alias("title")).where(F.length("text") > 0)
    order = Window.partitionBy("doc").orderBy("_part")
    parts = parts.withColumn("section", F.concat(F.lit("s"), F.row_number().over(order).cast("string")))
    bounds = lines(pages).groupBy("doc", "page_no").agg(F.min("start").alias("page_start"), F.max("end").alias("page_end"))
    at = parts.select("doc", F.explode(F.array("start", F.greatest(F.col("start"), F.col("end") - 1))).alias("at")).distinct()
    on = R.as_of(at, bounds, "doc", "at", "page_start", "page_no")
    signals = R.overlapping(parts.select("doc", "start", "end"), bounds.join(pages.select("doc", "page_no", "confidence", "review"), ["doc", "page_no"]), "doc")
    out = parts.join(on.select("doc", F.col("at").alias("start"), F.col("page_no").alias("page_start")), ["doc", "start"])
    last = on.select("doc", F.col("at").alias("_last"), F.col("page_no").alias("page_end"))
    out = out.withColumn("_last", F.greatest(F.col("start"), F.col("end") - 1)).join(last, ["doc", "_last"])
    return out.join(signals, ["doc", "start", "end"]).select("doc", "section", "title", "text", "page_start", "page_end", "start", "end", "confidence", "needs_review")


def children(sections: DataFrame, most: int = 2000) -> DataFrame:
    """sections (doc, section, title, text, start) and, of those longer than `most`, their parts: section s.c1.., title (part i/n),
    parent, and offsets found in the parent's text from where the last part ended (its start, where white space was joined)."""
    pieces = F.when(F.length("text") > most, T.pack(T.sentences(F.col("text")))).otherwise(F.array().cast("array<string>"))
    rows = sections.withColumn("_pieces", pieces)
    place = F.expr("""aggregate(_pieces, named_struct('at', 0, 'found', cast(array() as array<struct<at: int, text: string>>)),
        (a, x) -> named_struct('at', greatest(locate(x, text, a.at + 1) - 1, 0) + length(x),
            'found', array_append(a.found, named_struct('at', greatest(locate(x, text, a.at + 1) - 1, 0), 'text', x))), a -> a.found)""")
    parts = rows.withColumn("_n", F.size("_pieces")).select("doc", "section", "title", "start", "_n", F.posexplode(place).alias("_i", "_p"))
    number = (F.col("_i") + 1).cast("string")
    parts = parts.select(
        "doc", F.concat("section", F.lit(".c"), number).alias("section"), F.concat("title", F.lit(" (part "), number, F.lit("/"), F.col("_n").cast("string"), F.lit(")")).alias("title"),
        F.col("_p.text").alias("text"), (F.col("start") + F.col("_p.at")).alias("start"), (F.col("start") + F.col("_p.at") + F.length("_p.text")).alias("end"), F.col("section").alias("parent"),
    )
    whole = sections.select("doc", "section", "title", "text", "start", (F.col("start") + F.length("text")).alias("end"), F.lit(None).cast("string").alias("parent"))
    return whole.unionByName(parts)
