"""H3: progress of dumps, loads and streams, as rows of a table.

A dump and a load call ``progress`` with one event per table (rows are counted by the job itself, with an Observation in
a dump and from the decoded rows in a load). ``StreamProgress`` listens to streaming queries and reports every
micro-batch. ``ProgressTable`` writes each event as a file of its own, so writers never wait for one another.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources import fs

SCHEMA = "job string, phase string, table_name string, batch long, done long, total long, rows long, bytes long, at timestamp"


@dataclass
class Event:
    """``done`` of ``total`` steps of a job; ``table_name`` and ``rows`` are what the last step was about."""

    job: str
    phase: str
    table_name: str | None = None
    batch: int | None = None
    done: int | None = None
    total: int | None = None
    rows: int | None = None
    bytes: int | None = None


class ProgressTable:
    """Callable that appends events under ``path``; ``read`` gives them as a DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, event: Event) -> None:
        row = asdict(event) | {"at": dt.datetime.now(dt.timezone.utc).isoformat()}
        fs.write_bytes(f"{self.path}/{uuid.uuid4().hex}.json", json.dumps(row).encode())

    def read(self) -> DataFrame:
        files = [p for p, _ in fs.list_files(self.path)] if fs.exists(self.path) else []
        return self.spark.read.schema(SCHEMA).json(files) if files else self.spark.createDataFrame([], SCHEMA)


class StreamProgress(StreamingQueryListener):
    """Reports each micro-batch of the session's streaming queries (of one ``name``, if given)."""

    def __init__(self, report, name: str | None = None):
        self.report, self.name = report, name

    def onQueryStarted(self, event):
        if self.name in (None, event.name):
            self.report(Event(event.name or str(event.id), "started"))

    def onQueryProgress(self, event):
        p = event.progress
        if self.name in (None, p.name):
            self.report(Event(p.name or str(p.id), "batch", batch=p.batchId, rows=p.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.name is None:
            self.report(Event(str(event.id), "failed" if event.exception else "ended"))
