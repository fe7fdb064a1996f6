"""Tables that cut lineage, in the folder that the cluster shares (see ``tilewise.sources.tables``), and names of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tilewise.sources.tables import drop, folder, root, save

__all__ = ["drop", "folder", "others", "prefix", "root", "save"]


def prefix(df: DataFrame) -> str:
    """What no column name of df begins with, for names of one's own beside them."""
    out = "_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def others(df: DataFrame, made) -> list[str]:
    """df's columns but for those that made columns replace; names differ by more than case."""
    new = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in new]
