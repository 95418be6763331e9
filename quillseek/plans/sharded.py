"""A collection dealt out to a fixed number of partitions.

Partitions are what other engines call shards or workers: each is searched by its own task, and the best of each are
merged by the sort.  Statistics are those of the whole collection, so token search works, and functions in options
are shipped to the tasks.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.options import Options
from quillseek.plans.search import Collection
from quillseek.sources.index import ORDINAL, Index


class ShardedCollection:
    """search, add and set_collection as in `Collection`; `terminate` releases what is cached."""

    def __init__(self, docs: DataFrame, options: Options | None = None, num_workers: int | None = None, **changes):
        self.num_workers = num_workers or docs.sparkSession.sparkContext.defaultParallelism
        self._collection = self._dealt(Collection.of(docs, options, **changes))
        self._open = True

    def _dealt(self, collection: Collection) -> Collection:
        """Even contiguous shards, kept in memory."""
        frame = collection.index.frame.repartitionByRange(self.num_workers, F.col(ORDINAL)).persist()
        return replace(collection, index=replace(collection.index, frame=frame, source=None))

    def _checked(self) -> Collection:
        if not self._open:
            raise RuntimeError("the collection was terminated")
        return self._collection

    @property
    def index(self) -> Index:
        return self._checked().index

    def search(self, query: str | dict, limit: int = -1) -> DataFrame:
        return self._checked().search(query, limit)

    def add(self, docs: DataFrame) -> None:
        """The shards with docs' rows, dealt out anew; the old ones are released."""
        before = self._checked()
        self._keep(self._dealt(before.add(docs)), before)

    def set_collection(self, docs: DataFrame) -> None:
        before = self._checked()
        self._keep(self._dealt(before.set_collection(docs)), before)

    def _keep(self, collection: Collection, before: Collection) -> None:
        collection.index.frame.count()  # reads the old shards, so they are released after it
        before.index.frame.unpersist()
        self._collection = collection

    def terminate(self) -> None:
        if self._open:
            self._collection.index.frame.unpersist()
            self._open = False
