"""Names for columns that an operator adds for its own use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(docs: DataFrame, stem: str) -> str:
    """The stem, lengthened until the table has no column of that name in any case."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
