"""Helpers for column names and row order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """``df`` with every column that bears one of ``names`` (in any letter case) renamed to ``<name>_input``.

    An operator calls this before it adds its own columns, so that extra input columns with clashing names survive
    under another name instead of making later references ambiguous. Columns in ``keep`` stay as they are.
    """
    taken = {c.lower() for c in df.columns}
    kept = {k.lower() for k in keep}
    wanted = {n.lower() for n in names}
    renamed = {}
    for c in df.columns:
        if c.lower() in wanted and c.lower() not in kept:
            new = f"{c}_input"
            while new.lower() in taken or new.lower() in wanted:
                new += "_"
            taken.add(new.lower())
            renamed[c] = new
    return df.withColumnsRenamed(renamed) if renamed else df
