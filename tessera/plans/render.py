"""Source texts rendered from tables, so that what is extracted can be held against the table it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, doc_id: str, content: Column, language: str | Column) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("content"), (F.lit(language) if isinstance(language, str) else language).alias("language"))


def lit(text: str) -> Column:
    return F.lit(text)


def join(*parts: str | Column) -> Column:
    """Text and columns, one after another."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def python_module(name: Column, key: Column) -> Column:
    """A module with a docstring, an import, a comment, a class with a method and a function."""
    return join('"""module ', key, '"""\nimport mod_', key, "\nfrom pkg_", key, " import *\n\n# note ", name, "\nclass C_", key, ':\n    """class ', key, '"""\n\n    def m_', key, "(self):\n        return ", key, "\n\n\ndef f_", key, "():\n    return ", key, "\n")
