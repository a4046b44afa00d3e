"""Watched folders: what arrives is added to the stored corpus that searches read, one change for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, rebuild
from ..plans import schemas
from ..sources import archive
from ..sources.store import Conflict, Store
from .folder import FolderSource

Reader = Callable[[bytes], Iterable[tuple]]


def read_files(files: DataFrame, exams: DataFrame, reader: Reader, force: bool = False, overrides: dict | None = None) -> ingest.Batch:
    """Papers of files(path, filename, sha1, content) by a reader of one file's bytes; known ones are not read unless forced.

    Blocks are read for several steps and decoded once; ``release`` of the batch lets go of them.
    """
    todo = files if force else ingest.fresh(files, exams)
    one = todo.groupBy("sha1").agg(F.first("content").alias("content"))
    blocks = ingest.decode(one, reader).persist(StorageLevel.DISK_ONLY)
    batch = ingest.ingest(todo.drop("content"), blocks, overrides=overrides)
    batch.release = blocks.unpersist
    return batch


def apply(store: Store, exams: DataFrame, batch: ingest.Batch, force: bool = False) -> list:
    """Adds a batch to the store; the log, a short row for each file of the batch."""
    try:
        done = ingest.change(exams, _held(store, batch), force)
        log = done.log.select("status", "filename", "n_questions", "error").orderBy("status", "filename").collect()
        if any(r["status"] in ("added", "replaced") for r in log):
            store.append(done.exams, done.segments, done.gone)
    finally:
        batch.release()
    return log


def _held(store: Store, batch: ingest.Batch) -> ingest.Batch:
    """A batch whose tables are worked out once."""
    return ingest.Batch(*[store.hold(x) for x in (batch.exams, batch.segments, batch.log)])


def maintain(store: Store, files: DataFrame, reader: Reader, target: str | None = None, prune: bool = False, tries: int = 3) -> list:
    """Brings the store up to files(path, filename, sha1, content) by one commit; the log (status, filename, error).

    A commit of another writer in between starts it anew on what the corpus then holds.
    """
    for left in reversed(range(tries)):
        base = store.state()
        exams, _ = store.read(base)
        facts = store.hold(files.select("path", "filename", "sha1"))
        todo = store.hold(rebuild.to_read(exams, facts, target).select("path"))
        batch = read_files(files.join(todo, "path", "left_semi"), exams, reader, force=True)
        try:
            done = rebuild.rebuild(exams, facts, _held(store, batch), prune, store.hold)
            log = done.log.orderBy("status", "filename").collect()
            if any(r["status"] != "failed" for r in log):
                store.append(done.exams, done.segments, done.gone, base)
            return log
        except Conflict:
            if not left:
                raise
        finally:
            batch.release()
    return []


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, reader: Reader | None = None, once: bool = True, interval: str = "5 seconds", told: Callable[[list], None] | None = None, settle: float = 1.0) -> StreamingQuery:
    """Follow a folder: of papers, with a reader of one file's bytes, or else of archives.

    Papers known by their content are skipped, across restarts too, so a micro-batch that runs again changes nothing.  A file that
    the reader fails on is logged and fails nothing else, and comes again when it has changed.  The checkpoint holds which
    files were seen, with their times and sizes (of archives, which must be moved in whole, their paths).  ``told`` gets
    each micro-batch's log.
    """
    if reader:
        spark.dataSource.register(FolderSource)
        stream = spark.readStream.format(FolderSource.name()).option("path", folder).option("glob", "*.pdf").option("settle", str(settle)).load()
    else:
        stream = spark.readStream.schema(schemas.ARCHIVE).json(folder)

    def arrived(rows: DataFrame, number: int) -> None:
        exams, _ = store.read()
        batch = read_files(archive.hashed(rows), exams, reader) if reader else archive.batch(rows.where("sha1 is not null"))
        log = apply(store, exams, batch)
        if told:
            told(log)

    writer = stream.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def status_tallies(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
