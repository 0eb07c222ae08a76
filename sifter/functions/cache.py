"""Persisted intermediate frames and their release.

Several operators persist an intermediate frame that two branches of the
returned plan read (ordinals, value counts, validated records).  The
returned DataFrame is lazy, so they cannot unpersist it themselves; they
register it here, and the caller releases everything once the results are
written (``release()``), as a long-running job must.
"""

from __future__ import annotations

import threading

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_LOCK = threading.Lock()
_PERSISTED: list[DataFrame] = []


def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist ``df`` and remember it for ``release``."""
    out = df.persist(level)
    with _LOCK:
        _PERSISTED.append(out)
    return out


def release() -> int:
    """Unpersist every frame registered so far; returns how many."""
    with _LOCK:
        frames = list(_PERSISTED)
        _PERSISTED.clear()
    for f in frames:
        f.unpersist()
    return len(frames)
