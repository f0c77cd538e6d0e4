"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.sources import shared

#: The folder that driver and executors share.
shared_root = shared.root


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of lineage that outlives executors."""
    out = shared.written(df, tag)
    _LIVE[out.shelfmark_path] = out
    return out


#: Tables written and not deleted yet, by path.
_LIVE: dict[str, DataFrame] = {}


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    shared.drop(df)
    _LIVE.pop(df.shelfmark_path, None)


class Scratch:
    """Tables that are deleted together."""

    def __init__(self) -> None:
        """Nothing yet; tables live before are not its own."""
        self._before = set(_LIVE)
        self._own: list[DataFrame] = []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        """As :func:`written`, and remembered."""
        self._own.append(written(df, tag))
        return self._own[-1]

    def clear(self, *others: DataFrame) -> None:
        """Delete the tables remembered, and ``others``."""
        for df in (*self._own, *others):
            drop(df)
        self._own = []

    def clear_all(self) -> None:
        """Delete every table written since this was made."""
        for path in [p for p in _LIVE if p not in self._before]:
            drop(_LIVE[path])
        self._own = []
