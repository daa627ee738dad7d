"""Markdown as columns: lines, code fences, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a line ends, as Python's splitlines has it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
FENCE = r"^\s*(```|~~~)"
#: A link that is no image, with its target and perhaps a title.
LINK = r"(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"


def links(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1) and target of each link of texts (doc_id, text), but for those in code.

    A line that starts a fence ends it too, so a line is in code if the number of fences before it is odd.  It is counted within
    the row, since a text is one row already: only lines with a link look at the fences' places, and nothing is shuffled.
    """
    escaped = lambda pattern: pattern.replace("\\", "\\\\").replace("'", "\\'")
    lines = docs.select("doc_id", F.split("text", LINE_END).alias("lines"))
    spots = lines.withColumn("fences", F.expr(f"filter(transform(lines, (x, i) -> if(x rlike '{escaped(FENCE)}', i, null)), i -> i is not null)"))
    found = spots.select("doc_id", "fences", F.posexplode(F.expr("lines")).alias("i", "x")).where(F.col("x").contains("]("))
    found = found.where(~F.expr(f"x rlike '{escaped(FENCE)}'") & F.expr("size(filter(fences, f -> f < i)) % 2 = 0"))
    targets = F.regexp_extract_all(F.regexp_replace("x", "`[^`]*`", ""), F.lit(LINK), F.lit(1))
    return found.select("doc_id", (F.col("i") + 1).alias("line"), F.explode(targets).alias("target"))


def broken_links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links to other texts whose path is not among ``known`` (path); links outside and within the text are not looked at, nor is what follows a #."""
    inner = links(docs).where("not (target like 'http://%' or target like 'https://%' or target like 'mailto:%' or target like '#%')")
    return inner.withColumn("path", F.substring_index("target", "#", 1)).join(known.select("path").distinct(), "path", "left_anti").select("doc_id", "line", "target")
