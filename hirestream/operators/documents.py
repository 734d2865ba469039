"""Document segmentation and structure.

A document is a row ``(doc_id, text)``. Lines are produced with ``posexplode``;
section labels are forward-filled with ``last(..., ignorenulls)`` over a window
partitioned by document (a document is bounded in size, so no window partition
can grow with the table).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``(doc_id, line_no, line)`` (line_no from 0)."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.posexplode(tx.split_lines(F.col(text_col))).alias("line_no", "line"))


def label_sections(line_df: DataFrame, heading: Column | None = None) -> DataFrame:
    """``section`` forward-filled from heading lines; heading lines and blank
    lines are dropped; lines before the first heading have no section and are
    dropped. ``heading`` defaults to the alias-table detector."""
    h = tx.detect_section(F.col("line")) if heading is None else heading
    w = (Window.partitionBy("doc_id").orderBy("line_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    labelled = (line_df.withColumn("_head", h)
                .withColumn("section", F.last("_head", ignorenulls=True).over(w)))
    # trim once per line; the filter, the bullet test and the text all use it
    body = (labelled.filter(F.col("_head").isNull() & F.col("section").isNotNull())
            .withColumn("_t", tx.pytrim(F.col("line"))).filter(F.col("_t") != ""))
    return body.select("doc_id", "line_no", "section",
                       tx.is_bullet(F.col("_t")).alias("is_bullet"), F.col("_t").alias("text"))


def group_entries(section_lines: DataFrame) -> DataFrame:
    """F5/R9/R11/T-5: within a section, an entry starts at the section's first line
    or at a non-bullet line carrying a date range; other lines are its bullets.
    Returns one row per entry with title/company/start/end and ordered bullets."""
    w = Window.partitionBy("doc_id", "section").orderBy("line_no")
    rng = tx.date_range(F.col("text"))
    df = (section_lines
          .withColumn("_rn", F.row_number().over(w))
          .withColumn("_rng", rng)
          .withColumn("_hdr", (F.col("_rn") == 1) | (~F.col("is_bullet") & F.col("_rng.has_range")))
          .withColumn("entry_id", F.sum(F.col("_hdr").cast("int")).over(
              w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    role = tx.role_header(F.col("_rng.prefix"))
    header_title = F.when(F.col("_rng.has_range"), role.getField("title")).otherwise(F.col("text"))
    header_company = F.when(F.col("_rng.has_range"), role.getField("company")).otherwise(F.lit(""))
    bullet_text = F.when(F.col("is_bullet"), tx.strip_bullet(F.col("text"))).otherwise(F.col("text"))
    hdr = F.col("_hdr")
    return (df.groupBy("doc_id", "section", "entry_id").agg(
        F.max(F.when(hdr, header_title)).alias("title"),
        F.max(F.when(hdr, header_company)).alias("company"),
        F.max(F.when(hdr & F.col("_rng.has_range"), F.col("_rng.start"))).alias("start_date"),
        F.max(F.when(hdr & F.col("_rng.has_range"), F.col("_rng.end"))).alias("end_date"),
        F.count_if(~hdr).alias("n_bullets"),
        F.transform(F.array_sort(F.collect_list(F.when(~hdr, F.struct("line_no", bullet_text.alias("t"))))),
                    lambda s: s.getField("t")).alias("bullets")))


def contacts_and_name(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """R5 + R6 per document."""
    c = tx.contacts(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), c.getField("email").alias("email"),
                       c.getField("phone").alias("phone"), c.getField("linkedin").alias("linkedin"),
                       c.getField("github").alias("github"),
                       F.coalesce(tx.name_guess(tx.split_lines(F.col(text_col))), F.lit("")).alias("name"))


def layout_from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """D17 layout derived from a web page: ``<p>`` blocks are paragraphs (tags
    stripped), ``<table>``/``<img>`` are counted, ``<header>``/``<footer>`` text is
    kept, ``font-family`` declarations are the fonts."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    paras = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1),
                        lambda p: tx.flatten_ws(F.regexp_replace(p, r"<[^>]+>", " ")))
    def count(pat: str) -> Column:
        return F.size(F.regexp_extract_all(h, F.lit(pat), 0))
    def block(tag: str) -> Column:
        inner = F.regexp_extract(h, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return tx.flatten_ws(F.regexp_replace(inner, r"<[^>]+>", " "))
    fonts = F.array_distinct(F.transform(
        F.regexp_extract_all(h, F.lit(r"(?i)font-family\s*:\s*([^;\"'}]+)"), 1), lambda f: F.trim(f)))
    return pages.select(F.col(id_col).alias("doc_id"), paras.alias("paragraphs"),
                        count(r"(?i)<table[\s>]").alias("n_tables"), count(r"(?i)<img[\s>/]").alias("n_images"),
                        block("header").alias("header_text"), block("footer").alias("footer_text"),
                        fonts.alias("fonts"))
