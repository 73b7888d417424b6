"""Scoped materialisation: who owns a persisted frame, and when it goes.

Analyses persist intermediates that several of their steps read.  ``keep``
hands each of them to the scope that is open; leaving the scope releases them,
so write or collect every result inside:

    with Scope():
        reports.churn_table(t).write.parquet(path)

Without an open scope frames belong to ``default_scope``, which lives until
its ``release`` is called.  A frame that is released while a result still reads
it is computed again; results never depend on it.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Scope:
    """Owns persisted frames.  Scopes nest; each releases its own."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []
        self._tokens: list = []

    def keep(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        df = df.persist(level)
        self._frames.append(df)
        return df

    def release(self) -> None:
        """Unpersists every frame, the last kept first (it may read earlier ones)."""
        while self._frames:
            self._frames.pop().unpersist()

    def open(self) -> None:
        self._tokens.append(_current.set(self))

    def close(self) -> None:
        """Ends ``open`` without releasing anything."""
        _current.reset(self._tokens.pop())

    def __enter__(self) -> Scope:
        self.open()
        return self

    def __exit__(self, *error) -> None:
        self.close()
        self.release()


default_scope = Scope()
_current: ContextVar[Scope] = ContextVar("scope", default=default_scope)


def keep(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """``df`` persisted, owned by the open scope."""
    return _current.get().keep(df, level)
