"""Continuous ingest: versions of sources appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.facts import append_versions
from ..sources.versions import commit_batch


def append_each_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for facts that carry the ``version`` of their source.

    A source may arrive in any number of batches; ``latest_versions`` reads the highest version of each.  Rows of a
    version that are written twice, as by a retried batch, are to be read with ``dropDuplicates``.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        append_versions(batch.dropDuplicates(), path)

    return sink


def commit_each_batch(path: str, parts: int | str = 1) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that enters every batch in the store's commit log; a retried batch replaces itself.

    ``read_committed`` gives the newest version of each source of which all ``parts`` have arrived.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        commit_batch(batch, path, batch_id, parts)

    return sink
