"""Line and byte metrics as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of Unicode, and what a comment line starts with in any language.
SPACE = r"[\t-\r \x{85}\p{Z}]"
BLANK = rf"^{SPACE}*$"
COMMENT = rf"^{SPACE}*(//|#|/\*|\*)"


def lines(text: Column) -> Column:
    """The lines of a text: line ends part them, a last one adds none, an empty text has none."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def metric_columns(text: Column) -> dict[str, Column]:
    """total_lines, blank_lines, comment_lines, code_lines, total_bytes. A null text has nulls."""
    ls = lines(text)
    total = F.size(ls).cast("long")
    blank = F.size(F.filter(ls, lambda x: x.rlike(BLANK))).cast("long")
    comment = F.size(F.filter(ls, lambda x: x.rlike(COMMENT))).cast("long")
    known = lambda c: F.when(text.isNotNull(), c)
    return {
        "total_lines": known(total),
        "blank_lines": known(blank),
        "comment_lines": known(comment),
        "code_lines": known(F.greatest(F.lit(0), total - blank - comment)),
        "total_bytes": F.octet_length(text).cast("long"),
    }


def with_metrics(docs: DataFrame, text: str = "content") -> DataFrame:
    return docs.withColumns(metric_columns(F.col(text)))
