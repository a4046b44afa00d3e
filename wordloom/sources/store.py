"""A stored corpus: parts of Parquet, and a log whose every entry names all parts that make up one version of it.

A writer stages its part under a name of its own and then creates the next entry of the log, which either succeeds whole or
finds that another writer was first.  Then it looks at what the corpus holds now, takes out of its part the papers that
have come meanwhile, and tries again, so no paper is lost or doubled however many write.  A reader sees one version.

A part has ``exams``, ``segments`` in files (``slot``) of about SLOT_BYTES, clustered by subject, year and paper, ``slots``
(which papers are in which file), ``postings`` and ``presence`` (see index.py), and ``gone``: papers whose rows in earlier
parts no longer count, all of them (``whole``) or only their facts.  A change costs what it holds.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import concordance
from ..plans import schemas
from . import index

EXAMS, SEGMENTS = schemas.EXAMS, schemas.SEGMENTS.replace("exam_id long,", "exam_id long, seg_no int,")
GONE, SLOTS = "exam_id long, whole boolean", "exam_id long, slot int"
#: Parts after which a writer compacts, so that a version's list stays short.
MAX_PARTS = 50
SLOT_BYTES = 64 << 20
#: Candidates of a file that come with its count, and of all files up to which the scan filters by their ids; beyond, they are joined.
INLINE, LISTED = 64, 5000


class Conflict(RuntimeError):
    """Another writer changed what this change builds on."""


@dataclass(frozen=True)
class State:
    """A version of the corpus: its parts (id, kind, gone), in order."""

    version: int
    parts: tuple[dict, ...]


class Store:
    def __init__(self, spark: SparkSession, path: str, slot_bytes: int = SLOT_BYTES):
        self.spark, self.path, self.slot_bytes = spark, path.rstrip("/"), slot_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # The log

    def _versions(self) -> list[int]:
        log = self._path(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/log/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, version: int, entry: dict) -> bool:
        """Creates a whole entry, or nothing if there is one: by a hard link, or where files are not local by renaming."""
        body, name = json.dumps(entry), f"{self.path}/log/{version:010d}.json"
        draft = f"{self.path}/log/.{uuid.uuid4().hex}"
        if self._fs.getUri().getScheme() == "file":
            draft, name = urlparse(draft).path, urlparse(name).path
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with open(draft, "w", encoding="utf-8") as f:
                f.write(body)
            try:
                os.link(draft, name)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(body.encode()))
        out.close()
        done = self._fs.rename(self._path(draft), self._path(name))
        if not done:
            self._fs.delete(self._path(draft), False)
        return done

    def state(self) -> State:
        """The last version; -1 and no part before the first write."""
        self.check()
        versions = self._versions()
        return State(versions[-1], tuple(self._entry(versions[-1])["parts"])) if versions else State(-1, ())

    def _commit(self, make: Callable[[State], list[dict] | None]) -> int:
        """Adds the entry that ``make`` gives for the last version; asks it again if another writer was first."""
        while True:
            now = self.state()
            parts = make(now)
            if parts is None:
                return now.version
            if self._create(now.version + 1, {"layout": schemas.SCHEMA_VERSION, "parts": parts}):
                return now.version + 1

    def check(self) -> None:
        """A corpus of another layout is refused, never changed."""
        marks = f"{self.path}/layout"
        if self._fs.exists(self._path(marks)):
            held = {r[0] for r in self.spark.read.text(marks).collect()}
            if held != {str(schemas.SCHEMA_VERSION)}:
                raise schemas.SchemaMismatch(f"{self.path} has layout {', '.join(sorted(held))}; this version reads {schemas.SCHEMA_VERSION}")

    # Reading

    def _live(self) -> list[str]:
        return [f"{p['kind']}={p['id']}" for p in self.state().parts]

    def _rows(self, state: State, table: str, schema: str, files: set[tuple[str, int]] | None = None) -> DataFrame:
        """A table of all parts in one scan, with the part's place as ``_at``; of segments only some files, if named."""
        parts = [p["id"] for p in state.parts if table != "gone" or p["gone"]]
        base = f"{self.path}/{table}"
        paths = [f"{base}/lot={p}" for p in parts] if files is None else [f"{base}/lot={p}/slot={s}" for p, s in sorted(files) if p in parts]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, lot string, _at int")
        order = F.array_position(F.array(*[F.lit(p["id"]) for p in state.parts]), F.col("lot")).cast("int")
        return self.spark.read.schema(f"{schema}, lot string").option("basePath", base).parquet(*paths).withColumn("_at", order)

    def _left(self, state: State, rows: DataFrame, whole: bool) -> DataFrame:
        """Rows that no later part has replaced or deleted."""
        if not any(p["gone"] for p in state.parts):
            return rows
        gone = self._rows(state, "gone", GONE)
        since = (gone.where("whole") if whole else gone).groupBy("exam_id").agg(F.max("_at").alias("_since"))
        return rows.join(since, "exam_id", "left").where("_since is null or _at >= _since").select(*rows.columns)

    def read(self, state: State | None = None, files: set[tuple[str, int]] | None = None) -> tuple[DataFrame, DataFrame]:
        """(exams, segments) of a version, the last one unless given; both are empty before the first write."""
        state = state or self.state()
        exams = self._left(state, self._rows(state, "exams", EXAMS), False).drop("lot", "_at")
        segments = self._left(state, self._rows(state, "segments", f"{SEGMENTS}, slot int", files), True).drop("lot", "slot", "_at")
        return exams, segments

    def narrowed(self, query: str | None = None, subject: str | None = None, year: int | None = None, exam: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(exams, segments) with only such files, or rows, of segments as can hold the wording and belong to such papers.

        A key of three characters or more is looked up in the postings, a shorter one in the presence table; papers' files
        are looked up by the papers that the filters leave now.  The searches' own checks still decide.
        """
        state = self.state()
        exams, _ = self.read(state)
        files, ids, near = None, None, None
        key = text.query_key(query) if query is not None else ""
        if state.parts and len(key) > 2:
            near = index.candidates(self._rows(state, "postings", index.POSTINGS), key)
            some = near.select("lot", "slot", F.size("ids").alias("n"), F.slice("ids", 1, INLINE).alias("ids")).collect()  # a short row for each file
            files = {(r["lot"], r["slot"]) for r in some}
            if sum(r["n"] for r in some) <= LISTED:
                some = some if all(r["n"] <= INLINE for r in some) else near.collect()
                ids, near = [i for r in some for i in r["ids"]], None
        elif state.parts and key:
            held = self._rows(state, "presence", index.PRESENCE).where(F.col("gram") == key)
            files = {(r["lot"], r["slot"]) for r in held.select("lot", "slot").distinct().collect()}
        if state.parts and (subject or year or exam):
            papers = exams.where(concordance.paper_predicates(subject, year, exam)).select("exam_id")
            theirs = self._rows(state, "slots", SLOTS).join(papers, "exam_id", "left_semi")
            theirs = {(r["lot"], r["slot"]) for r in theirs.select("lot", "slot").distinct().collect()}
            files = theirs if files is None else files & theirs
        _, segments = self.read(state, files)
        if ids is not None:
            segments = segments.where(f"segment_id IN ({', '.join(map(str, ids))})" if ids else "false")  # parsed at once, not literal by literal
        elif near is not None:
            segments = segments.join(near.select(F.explode("ids").alias("segment_id")), "segment_id", "left_semi")
        return exams, segments

    # Writing

    def _stage(self, exams: DataFrame, segments: DataFrame, gone: DataFrame | None, kind: str) -> dict:
        """Writes a part: exams and segments are evaluated once, and all else is made of what was written."""
        part = uuid.uuid4().hex
        fit = lambda df, schema: df.select(*[f.split(" ")[0] for f in _fields(schema)])
        at = lambda table: f"{self.path}/{table}/lot={part}"
        fit(exams, EXAMS).write.parquet(at("exams"))
        draft = f"{self.path}/draft/{part}"
        fit(segments, SEGMENTS).write.parquet(draft)
        rows = self.spark.read.schema(SEGMENTS).parquet(draft)
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        papers = self.spark.read.schema(EXAMS).parquet(at("exams")).select("exam_id", "subject", "year").dropDuplicates(["exam_id"])
        placed = rows.join(papers, "exam_id", "left").repartitionByRange(max(1, -(-size // self.slot_bytes)), "subject", "year", "exam_id", "seg_no", "segment_id")
        placed = placed.withColumn("slot", F.spark_partition_id()).drop("subject", "year").sortWithinPartitions("slot", "segment_id")
        placed.write.partitionBy("slot").parquet(at("segments"))
        stored = self.spark.read.schema(f"{SEGMENTS}, slot int").parquet(at("segments"))
        stored.select("exam_id", "slot").distinct().write.parquet(at("slots"))
        postings = index.postings(stored)
        postings.write.parquet(at("postings"))
        index.presence(stored, self.spark.read.schema(index.POSTINGS).parquet(at("postings"))).write.parquet(at("presence"))
        if gone is not None:
            whole = F.col("whole") if "whole" in gone.columns else F.lit(True)
            gone.select("exam_id", whole.alias("whole")).distinct().write.parquet(at("gone"))
        self._drop(draft)
        return {"id": part, "kind": kind, "gone": gone is not None}

    def hold(self, rows: DataFrame) -> DataFrame:
        """Rows written once, below the store, to be read for several steps; ``vacuum`` removes them when they are old."""
        at = f"{self.path}/draft/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _drop(self, *paths: str) -> None:
        for p in paths:
            self._fs.delete(self._path(p), True)

    def _drop_part(self, part: dict) -> None:
        self._drop(*[f"{self.path}/{t}/lot={part['id']}" for t in TABLES])

    def _part(self, part: dict) -> tuple[DataFrame, DataFrame]:
        one = State(-1, (part,))
        return self._rows(one, "exams", EXAMS).drop("lot", "_at"), self._rows(one, "segments", f"{SEGMENTS}, slot int").drop("lot", "slot", "_at")

    def _begin(self) -> None:
        self.check()
        if not self._fs.exists(self._path(f"{self.path}/layout")):
            self.spark.createDataFrame([(str(schemas.SCHEMA_VERSION),)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.path}/layout")

    def append(self, exams: DataFrame, segments: DataFrame, gone: DataFrame | None = None, base: State | None = None) -> int:
        """New papers and their segments; the version that has them.

        Without ``gone``, papers whose content the corpus holds when the change is committed stay as they are there.  With
        it, papers in ``gone`` (exam_id, and whole where not all is meant) are deleted, and those that come replace any of
        their content.  With ``base`` the change builds on that version, and any later one is a Conflict.
        """
        self._begin()
        own = self._staged_gone(exams, gone)
        part = self._stage(exams, segments, own, "d")

        def make(now: State) -> list[dict] | None:
            nonlocal part
            if base is not None and base.version != now.version:
                self._drop_part(part)
                raise Conflict(f"{self.path} is at version {now.version}, and this change builds on {base.version}")
            if gone is None and now.parts:
                new_exams, new_segments = self._part(part)
                held = self.read(now)[0]
                known = new_exams.join(held.select("sha1").distinct(), "sha1", "left_semi").unionByName(new_exams.join(held.select("exam_id").distinct(), "exam_id", "left_semi").select(new_exams.columns)).select("exam_id").distinct()
                if known.head():
                    left, old = new_exams.join(known, "exam_id", "left_anti"), part
                    part = self._stage(left, new_segments.join(known, "exam_id", "left_anti"), None, "d") if left.head() else None
                    self._drop_part(old)
            if part is None:
                return None
            return [*now.parts, part if now.parts else {**part, "kind": "v"}]

        version = self._commit(make)
        if len(self.state().parts) > MAX_PARTS:
            self.compact()
        return version

    def _staged_gone(self, exams: DataFrame, gone: DataFrame | None) -> DataFrame | None:
        if gone is None:
            return None
        gone = gone if "whole" in gone.columns else gone.withColumn("whole", F.lit(True))
        kept = gone.where("not whole").select("exam_id")
        replaced = exams.select("exam_id").join(kept, "exam_id", "left_anti").withColumn("whole", F.lit(True))
        return gone.select("exam_id", "whole").unionByName(replaced)

    def write(self, exams: DataFrame, segments: DataFrame) -> int:
        """A whole corpus in the place of all that was there when this began; what came meanwhile stays."""
        self._begin()
        return self._replace(self.state(), exams, segments)

    def _replace(self, base: State, exams: DataFrame, segments: DataFrame) -> int:
        """Puts one part in the place of a version's parts.  Parts that came later stay; if another writer has replaced these
        parts, this one is given up."""
        part = self._stage(exams, segments, None, "v")

        def make(now: State) -> list[dict] | None:
            if now.parts[: len(base.parts)] != base.parts:
                self._drop_part(part)
                return None
            return [part, *now.parts[len(base.parts) :]]

        return self._commit(make)

    def size(self) -> int:
        parts = [p["id"] for p in self.state().parts]
        paths = [self._path(f"{self.path}/{t}/lot={p}") for t in TABLES for p in parts]
        return sum(self._fs.getContentSummary(p).getLength() for p in paths if self._fs.exists(p))

    def compact(self, keep_seconds: int = 3600) -> tuple[int, int]:
        """Rewrites the corpus as one part, clustered anew; (bytes before, bytes after).

        Parts that no version of the last ``keep_seconds`` names are removed, so running readers and writers keep theirs.
        """
        before, base = self.size(), self.state()
        if base.parts:
            self._replace(base, *self.read(base))
        self.vacuum(keep_seconds)
        return before, self.size()

    def vacuum(self, keep_seconds: int = 3600) -> None:
        """Removes old entries of the log, and old parts that none of the others names."""
        old = lambda status: status.getModificationTime() < (time.time() - keep_seconds) * 1000
        versions = self._versions()
        paths = {v: self._path(f"{self.path}/log/{v:010d}.json") for v in versions}
        # An entry was the last version until the next one came.
        past = [v for v, after in zip(versions, versions[1:], strict=False) if old(self._fs.getFileStatus(paths[after]))]
        live = {p["id"] for v in versions if v not in past for p in self._entry(v)["parts"]}
        for v in past:
            self._fs.delete(paths[v], False)
        for table in TABLES:
            top = self._path(f"{self.path}/{table}")
            for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if old(status) and status.getPath().getName().removeprefix("lot=") not in live:
                    self._fs.delete(status.getPath(), True)


TABLES = ("exams", "segments", "slots", "postings", "presence", "gone", "draft")


def _fields(schema: str) -> list[str]:
    """The top-level fields of a DDL string."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [f.strip() for f in out]
