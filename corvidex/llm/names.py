"""Names of an operator's own columns that the input doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names`` behind as many underscores as keep them apart from every column of ``docs``, whatever the case."""
    taken, lead = {c.lower() for c in docs.columns}, "_"
    while any(lead + n.lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"
