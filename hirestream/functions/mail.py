"""Message decoding (N1, N2, R14, T-6) as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_to_text


def headers_map(headers: Column) -> Column:
    """``array<struct<name,value>>`` -> lower-cased ``map``; the last duplicate wins."""
    low = F.transform(headers, lambda h: F.struct(F.lower(h.getField("name")).alias("k"),
                                                  F.coalesce(h.getField("value"), F.lit("")).alias("v")))
    last = F.filter(low, lambda h, i: ~F.exists(F.slice(low, i + 2, F.greatest(F.size(low), F.lit(1))),
                                               lambda y: y.getField("k") == h.getField("k")))
    return F.map_from_entries(last)


def b64url_text(data: Column) -> Column:
    """base64url (padding optional) -> UTF-8 text; undecodable data gives NULL."""
    alphabet = F.regexp_replace(F.coalesce(data, F.lit("")), r"[^A-Za-z0-9_\-+/]", "")
    std = F.translate(alphabet, "-_", "+/")
    padded = F.rpad(std, ((F.length(std) + 3) / 4).cast("int") * 4, "=")
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")


def body_text(parts: Column) -> Column:
    """All decodable ``text/plain`` parts joined by newlines; else the
    ``text/html`` parts joined and stripped (R14)."""
    dec = F.transform(parts, lambda p: F.struct(p.getField("mime").alias("mime"),
                                                b64url_text(p.getField("data")).alias("t")))
    ok = F.filter(dec, lambda p: p.getField("t").isNotNull() & (p.getField("t") != ""))
    plain = F.transform(F.filter(ok, lambda p: p.getField("mime") == "text/plain"), lambda p: p.getField("t"))
    html = F.transform(F.filter(ok, lambda p: p.getField("mime") == "text/html"), lambda p: p.getField("t"))
    return F.when(F.size(plain) > 0, F.array_join(plain, "\n")).otherwise(html_to_text(F.array_join(html, "\n")))
