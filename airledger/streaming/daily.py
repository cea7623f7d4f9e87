"""The registry's daily zips as a file stream: each micro-batch brings the published generation up to the feed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.parameters import QueryError
from ..sources.ingest import Ingest

#: What Spark's reader of whole files gives; contents aren't read here, as zips are read by entry.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_zips(ingest: Ingest, forget: str = "5d", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the path and modificationTime of each daily zip that appears.

    Days' names come again each week, and a stream doesn't tell a file that is written anew from one that it has seen
    while it remembers its name. It forgets names of files older than `forget` before the newest, which must be under a
    week; what is older when it appears is left to the next batch's refresh, which lists the folder itself.
    """
    files = ingest.spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.zip").option("maxFileAge", forget)
    return files.option("maxFilesPerTrigger", files_per_batch).load(f"{ingest.root}/daily").select("path", "modificationTime")


class Applying:
    """A foreachBatch function that refreshes the registry, and what became of each batch.

    A batch only says that there is something new: what is pending is told by the published manifest (its checkpoint and
    the files it has applied), so a file counts once, whichever batch brought it and however often that runs. Its outcome
    is written beside the store under the stream's name and the batch's number; a batch that has one does nothing again.

    While the feed has a gap (a day of a code is missing), what comes after it waits: the generation stays, the outcome
    says `waiting` and for which code, and the batch that fills the gap applies all. If the feed no longer reaches back
    to the checkpoint, or nothing is published yet, the registry is built of the snapshots. A zip that can't be read
    fails its batch after the files before it are published, and a later start runs the batch again.
    """

    def __init__(self, ingest: Ingest, name: str = "daily"):
        self.ingest, self.name = ingest, name

    def _at(self, number: int) -> str:
        return f"streams/{self.name}/{number}.json"

    def outcome(self, number: int) -> dict | None:
        """What a batch did: `done`, the generation published after it, and the code that is waited for, if any."""
        text = self.ingest.store._read(self._at(number))
        return None if text is None else json.loads(text)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.outcome(number) is not None:
            return
        made = {"done": "refreshed", "waiting_for": None}
        try:
            if self.ingest.published() is None:
                made["done"] = self.ingest.rebuild()
                self.ingest.refresh()
            else:
                made["done"] = self.ingest.update()
        except QueryError as e:
            if e.reason != "stale_checkpoint":
                raise
            made = {"done": "waiting", "waiting_for": str(e)}
        self.ingest.store._write(self._at(number), json.dumps(made | {"generation": self.ingest.store.current().name}))


def start_daily(ingest: Ingest, checkpoint: str, name: str = "daily", forget: str = "5d", files_per_batch: int = 1000, apply: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies the daily zips that have come, then stops; a later start goes on from the checkpoint.

    name: of the stream, whose batches are numbered by its checkpoint; a new checkpoint needs a new name.
    """
    sink = apply or Applying(ingest, name)
    return read_zips(ingest, forget, files_per_batch).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
