"""Line dedup by a log-template tree.

A line is parsed down a tree of fixed depth: its number of tokens, then its leading tokens, with tokens that hold a digit
generalised to ``<*>``.  In a leaf, lines are one template if their tokens agree but for one variable field:

* 1 or 2 tokens: nothing but digits varies;
* 3 tokens: the last may vary; 4 or 5 tokens: any one may;
* 6 tokens or more: one third of those after the LEAD leading tokens may vary, or one of the leading tokens; from
  WIDE tokens on also two of the thirds.

So each line has one full signature and some with a field generalised, and a template is a signature that recurs.

A template recurs if at least ``min_docs`` documents hold it, copies counted once, whatever stands around it and
however many documents there are; one with a field whose fixed tokens are fewer than FIXED takes FEW_FIXED times as many,
since lines of four words that share three of them by chance are common, and such lines are a text's own.
Candidates are templates of that many distinct texts; only documents that hold one are then grouped by the
near-duplicate operator (similarity 0.8 of their 5-word shingles), and a group counts as one document, so that a text
with many near copies keeps its own lines.  A page that is little but shared lines is alike to others by those lines
alone, so what is left of it decides: where a template has too few groups, a document of them counts by itself if the lines
of it that are no candidates are its own: no two neighbours of OWN words in a row, nor three in four of all their
neighbours, are neighbours in another document of its group (of those that hold such a template; documents with the same
such lines are one).  Edits of a copy change words here and there and leave the rest of a line as it was, so copies stay
one document; pages that each have near copies of their own beside the shared lines stay one too.  All lines of a
recurring template are dropped.

Null and empty texts have no lines to drop and come back as they are.  Blank lines are kept and are no template.  Lines end
at ``\\n``; tokens are the words of the other operators.  Rows with a null doc_id keep their text.  Repeated rows of one
doc_id count as one document and each lose the lines that any of them would.  A column of docs named as one of
the two counts is replaced by it (the names are parameters); other columns stay.

Most signatures have one line.  So lines are counted first, in sorted runs: a task counts the signatures of a chunk and deals
them, in order, to buckets by their leading bits, where the runs meet; a very common line is one entry of a run.  A bitmap of the
signatures with enough lines then picks rows of a signature and a line, and a join with those signatures decides.  From
there on counting is by signature and text first, so one very common line is
spread over many groups; recurring signatures, and ids of documents that hold one, are broadcast up to BROADCAST of them (counted first);
beyond that signatures are joined with each dealt over SALTS tasks, and ids by a plain join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels, neardup
from .kernels import U64

LEAD, WIDE = 3, 9
MIN_DOCS = 5
FIXED, FEW_FIXED = 5, 4
OWN = 5
BROADCAST, SALTS = 500_000, 16
#: Signatures that a task sorts at a time, those of a bucket in which they are counted, and bits of the largest bitmap.
CHUNK, BUCKET, FILTER_BITS = 1 << 19, 1 << 19, 27
_PLACE = U64(0x9E3779B97F4A7C15)


class Lines:
    """Lines with a word of a batch of texts: the document and number of each, its words, and their masked hashes."""

    def __init__(self, text):
        words = kernels.Words(text)
        buf, start = words.buf, words.start
        breaks = np.flatnonzero(buf == 10)
        doc = words.doc()
        line = np.cumsum(np.bincount(np.searchsorted(start, breaks), minlength=len(start) + 1)[: len(start)]) - np.searchsorted(breaks, words.text_off)[doc]
        self.first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]))) if len(start) else np.zeros(0, np.int64)
        self.doc, self.line = doc[self.first], line[self.first]
        self.size = np.diff(np.append(self.first, len(start)))
        place = (np.arange(len(start)) - np.repeat(self.first, self.size)).astype(U64)
        token = words.hash
        token[np.searchsorted(start, np.flatnonzero(buf - np.uint8(48) < 10), "right") - 1] = 1  # a digit is part of a word
        # Hashes of tokens in their places: sums of them stand for what agrees, whatever its order of addition.
        self.sums = np.append(U64(0), np.cumsum(kernels.mix(token + (place + U64(1)) * _PLACE, 31), dtype=U64))
        self.copy = words.range_hash(words.text_off[:-1], words.text_off[1:])

    def signatures(self):
        """(lines, signatures, whether few tokens are fixed) for each kind of field."""
        n, at = self.size, self.first
        whole = self.sums[at + n] - self.sums[at]
        third = -(-(n - LEAD) // 3)
        cut = [np.minimum(at + LEAD + k * third, at + n) for k in range(4)]

        def without(some, kind, *fields):
            left, gone = whole[some], np.zeros(int(some.sum()), np.int64)
            for a, b in fields:
                left = left - (self.sums[b[some]] - self.sums[a[some]])
                gone += b[some] - a[some]
            real = np.flatnonzero(gone > 0) if fields else np.arange(len(left))
            key = kernels.mix(left + n[some].astype(U64) * _PLACE, 32 + kind)
            return np.flatnonzero(some)[real], key[real], (n[some] - gone < FIXED)[real] & bool(fields)

        yield without(n > 0, 0)
        yield without(n == 3, 1, (at + 2, at + 3))
        for k in range(5):
            yield without((n >= 4) & (n <= 5) & (n > k), 2 + k, (at + np.minimum(k, n), at + np.minimum(k + 1, n)))
        for k in range(3):
            yield without(n >= 6, 7 + k, (cut[k], cut[k + 1]))
            yield without(n >= 6, 10 + k, (at + np.minimum(k, n), at + np.minimum(k + 1, n)))
            yield without(n >= WIDE, 13 + k, *[(cut[j], cut[j + 1]) for j in range(3) if j != k])


def _parse(batches):
    """Signatures (the lowest bit: whether few tokens are fixed) and the lines they are of, packed by slices of texts."""
    for batch in batches:
        for part in kernels.slices(batch, limit=kernels.STAGE_BYTES):
            lines = Lines(part.column("text"))
            row, sig, few = (np.concatenate(x) for x in zip(*lines.signatures(), strict=True))
            doc_id = np.asarray(part.column("doc_id"))[lines.doc]
            packed = {"sigs": sig & ~U64(1) | few, "of": row.astype(np.int32), "ids": doc_id, "copies": lines.copy[lines.doc], "lines": lines.line.astype(np.int32)}
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(sig)], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()})


def _counted(chunk: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Signatures of a chunk in order, with their counts, cut where buckets begin."""
    sigs = np.concatenate(chunk)
    sigs.sort()
    first = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
    n, sigs = np.diff(np.append(first, len(sigs))).astype(np.int32), sigs[first]
    begins = (np.arange(buckets, dtype=U64) << U64(32)) // U64(buckets) << U64(32)
    at = np.append(np.searchsorted(sigs, begins), len(sigs))
    some = np.flatnonzero(np.diff(at))
    cut = lambda x: pa.array([x[at[b] : at[b + 1]].tobytes() for b in some], pa.binary())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "sigs": cut(sigs), "counts": cut(n)})


def _runs(buckets: int):
    def run(batches):
        chunk, size = [], 0
        for batch in batches:
            for blob in batch.column("sigs").to_pylist():
                chunk.append(np.frombuffer(blob, U64))
                size += len(chunk[-1])
                if size >= CHUNK:
                    yield _counted(chunk, buckets)
                    chunk, size = [], 0
        if size:
            yield _counted(chunk, buckets)

    return run


def _merged(min_docs: int):
    """Signatures of a bucket that have enough lines."""

    def run(table):
        sigs, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("sigs", U64), ("counts", np.int32)))
        order = np.argsort(sigs)
        sigs, n = sigs[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
        sigs, n = sigs[first], np.add.reduceat(n, first)
        few = (sigs & U64(1)).astype(bool)
        return pa.table({"sig": pa.array(sigs[n >= np.where(few, FEW_FIXED * min_docs, min_docs)].view(np.int64))})

    return run


def _often(packed: DataFrame, min_docs: int) -> DataFrame:
    """Signatures that have enough lines, in the packed rows of _parse."""
    buckets = -(-(packed.agg(F.sum("n")).first()[0] or 0) // BUCKET) or 1
    runs = packed.select("sigs").mapInArrow(_runs(buckets), "bucket int, sigs binary, counts binary")
    return runs.groupBy("bucket").applyInArrow(_merged(min_docs), "sig long")


def _bitmap(sigs: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of the signatures, and how many bits those are: a few more than number the signatures."""
    bits = min(FILTER_BITS, max(15, sigs.count().bit_length() + 6))
    slots = sigs.select((F.shiftrightunsigned("sig", 64 - bits) + 1).alias("slot"))
    pages = slots.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in pages:
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["page"] - 1) * len(page) : r["page"] * len(page)] = page
    return out, bits


def _picked(bitmap):
    """Rows of a signature and a line for signatures that the broadcast bitmap may hold."""

    def run(batches):
        marked, bits = bitmap.value
        for batch in batches:
            for r in batch.to_pylist():
                sigs = np.frombuffer(r["sigs"], U64)
                slot = (sigs >> U64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(marked[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                of = np.frombuffer(r["of"], np.int32)[at]
                ids, copies, lines = (np.frombuffer(r[c], kind)[of] for c, kind in (("ids", np.int64), ("copies", np.int64), ("lines", np.int32)))
                yield pa.RecordBatch.from_pydict({"sig": pa.array(sigs[at].view(np.int64)), "doc_id": pa.array(ids), "copy": pa.array(copies), "line": pa.array(lines)})

    return run


def _need(min_docs: int):
    return F.when(F.col("sig").bitwiseAND(F.lit(1)) == 1, FEW_FIXED * min_docs).otherwise(min_docs)


def _enough(found: DataFrame, column: str, min_docs: int) -> DataFrame:
    """Signatures, and whether they have enough distinct values of column."""
    counted = found.select("sig", column).distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("sig", (F.col("n") >= _need(min_docs)).alias("enough"))


def _holding(found: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows of found with one of these signatures (a table), and the other columns of those."""
    if sigs.count() <= BROADCAST:
        return found.join(F.broadcast(sigs), "sig")
    sigs = sigs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(sigs, ["sig", "_salt"]).drop("_salt")


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of these documents: up to BROADCAST ids are sent to the rows, so that texts stay where they are."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id", "left_semi")


def _neighbours(whole: bool):
    """Pairs of neighbouring words of the texts, or of what is left of them without the lines ``held``, in their places."""

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, limit=kernels.STAGE_BYTES):
                words = kernels.Words(part.column("text"), lower=True)
                doc, n = words.doc(), part.num_rows
                breaks = np.concatenate([[0], np.cumsum(words.buf == 10)])
                line = breaks[words.start] + doc  # no two texts share a number
                held = part.column("held").combine_chunks() if isinstance(part, pa.Table) else part.column("held")
                owner = np.asarray(held.value_parent_indices())
                gone = np.zeros(int(breaks[-1]) + n + 1, bool)
                gone[breaks[words.text_off[owner]] + owner + np.asarray(held.flatten(), dtype=np.int64)] = True
                left = ~gone[line]
                rank = np.cumsum(left)
                sums = np.append(U64(0), np.cumsum(np.where(left, kernels.mix(words.hash + (rank - np.append(0, rank)[words.off[doc]]).astype(U64) * _PLACE, 33), U64(0)), dtype=U64))
                rest = kernels.mix(sums[words.off[1:]] - sums[words.off[:-1]], 34)
                pair = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
                at = np.flatnonzero(pair if whole else pair & left[1:] & left[:-1])
                gram = kernels.mix(words.hash[at] * U64(0xC2B2AE3D27D4EB4F) + words.hash[at + 1], 35) if len(at) else np.zeros(0, U64)
                of = doc[at]
                out = {"component": pa.array(np.asarray(part.column("component"))[of]), "gram": pa.array(gram.view(np.int64)), "rest": pa.array(rest[of].view(np.int64))}
                if not whole:
                    copy = words.range_hash(words.text_off[:-1], words.text_off[1:])
                    out |= {"doc_id": pa.array(np.asarray(part.column("doc_id"))[of]), "copy": pa.array(copy[of].view(np.int64)), "at": pa.array((at - words.off[of]).astype(np.int32)), "size": pa.array(np.bincount(of, minlength=n)[of])}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _with_own_rest(texts: DataFrame) -> DataFrame:
    """doc_id, rest: documents whose words beside their held lines are their own, and a hash of those words.

    texts: component, doc_id, text, held (numbers of lines).
    """
    kind = "component long, gram long, rest long"
    lone = texts.mapInArrow(_neighbours(True), kind).groupBy("component", "gram").agg(F.min("rest").alias("rest"), F.max("rest").alias("last")).where("rest = last").select("component", "gram")
    left = texts.mapInArrow(_neighbours(False), f"{kind}, doc_id long, copy long, at int, size long").join(lone, ["component", "gram"], "left_semi")
    places = left.groupBy("doc_id", "copy", "rest", "size").agg(F.collect_set("at").alias("at")).where(4 * F.size("at") >= 3 * F.col("size"))
    later = lambda at: F.slice(at, OWN - 1, F.size(at))
    run = common.let(F.array_sort("at"), lambda at: F.exists(F.zip_with(at, later(at), lambda a, b: b - a), lambda far: far == OWN - 2))
    return places.where((F.size("at") >= OWN - 1) & run).groupBy("doc_id").agg(F.min("rest").alias("rest"))


def recurring_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, line of the templates that recur; rows (doc_id, text) have no null."""
    parsed = common.materialize(rows.mapInArrow(_parse, "n long, sigs binary, of binary, ids binary, copies binary, lines binary"), "templates")
    # Most signatures have one line: counting lines first leaves few whose texts must be told apart.
    recurring = common.materialize(_often(parsed, min_docs), "recurring")
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(recurring))
    often = common.materialize(_holding(parsed.drop("n").mapInArrow(_picked(bitmap), "sig long, doc_id long, copy long, line int"), recurring), "often")
    bitmap.destroy()
    common.discard(parsed, recurring)
    enough = common.materialize(_enough(often, "copy", min_docs).where("enough").select("sig"), "recurring")
    held = common.materialize(_holding(often.drop("copy"), enough), "held")
    common.discard(often, enough)
    holders = _of(rows, common.materialize(held.select("doc_id").distinct(), "ids"))
    groups = neardup.near_duplicates(holders, **neardup.STAGE).groupBy("doc_id").agg(F.min("component_id").alias("component"))
    groups = common.materialize(groups, "groups")
    judged = _holding(held, common.materialize(_enough(held.join(groups, "doc_id"), "component", min_docs), "recurring"))
    open_ = common.materialize(judged.where("not enough").select("sig", "doc_id", "line"), "undecided")
    ids = common.materialize(open_.select("doc_id").distinct(), "undecided-ids")
    lines = _of(held.select("doc_id", "line"), ids).distinct().groupBy("doc_id").agg(F.collect_list("line").alias("held"))
    texts = _of(rows, ids).join(lines.join(_of(groups, ids), "doc_id"), "doc_id")
    texts = common.materialize(texts.select("component", "doc_id", "text", "held"), "undecided-texts")
    own = _with_own_rest(texts)
    counted = open_.join(groups, "doc_id").join(own, "doc_id", "left").withColumn("page", F.when(F.col("rest").isNull(), F.xxhash64(F.lit(0), "component")).otherwise(F.xxhash64(F.lit(1), "rest")))
    more = _holding(open_, common.materialize(_enough(counted, "page", min_docs).where("enough").select("sig"), "recurring"))
    return judged.where("enough").select("doc_id", "line").unionByName(more.select("doc_id", "line"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All rows and columns of docs, with ``text`` less its recurring lines, and numbers of lines and of dropped ones."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    drop = recurring_lines(rows, min_docs).groupBy("doc_id").agg(F.collect_set("line").alias("drop")).select(F.struct("doc_id", "drop").alias(_OWN))
    out = docs.join(drop.hint("shuffle_hash"), docs["doc_id"] == drop[_OWN]["doc_id"], "left")  # texts needn't be sorted
    gone = drop[_OWN]["drop"]
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return out.withColumns({counts[0]: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"), counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long"), "text": F.when(gone.isNull(), F.col("text")).otherwise(kept)}).drop(_OWN)


#: The one column of this operator's own beside those of docs.
_OWN = "_wordloom_recurring_lines"


def op4_line_templates(docs: DataFrame) -> DataFrame:
    return drop_recurring_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
