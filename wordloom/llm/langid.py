"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting and scoring are vectorised per Arrow batch.  Counts of each task are added up by (language, slice of the
feature space) before the model reaches the driver.  The features are the same for any number of languages.  The model is
cut into groups of languages, by name, of MODEL_CELLS cells at most, which are fetched and broadcast one by one; with more
than one, each group scores the texts in tasks of its own, and scores are brought together by the text's digest.
A task holds HELD_LANGUAGES counters, or one group, at a time.

A text is lower-cased; anything but letters counts as a word break.  Null texts and texts without a letter get
``und`` and score 0.  Rows without a language teach nothing; rows that repeat teach, and are scored, each.  Among languages
of equal score the first by name is taken.  With no labelled row at all, everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

BITS = 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
SLICES = 16
#: Cells of a group of languages at most (8 bytes each), which bounds what is collected and broadcast at a time.
MODEL_CELLS = 1 << 25
HELD_LANGUAGES = 64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str | None], bits: int = BITS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the hashed n-grams of all texts, flat, with the offsets of each text; the texts' numbers of letters."""
    low = [(" " + t.lower() + " ") if t else "" for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    known = _letter_table()
    letter = known[np.minimum(code, len(known) - 1)] & (code < len(known))
    code = np.where(letter, code, np.uint32(32))
    total = np.concatenate([[0], np.cumsum(letter)])
    letters = total[off[1:]] - total[off[:-1]]
    keep = letter | np.append(True, letter[:-1]) if len(letter) else letter  # one break for each run of them
    code = code[keep]
    off = np.concatenate([[0], np.cumsum(keep)])[off] if len(keep) else off
    n, last = len(code), np.repeat(off[1:], np.diff(off))
    ids, ends = [], []
    h = np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        h = h * np.uint32(0x01000193) + np.pad(code[k:], (0, min(k, n)))
        if k + 1 in ORDERS:
            inside = np.arange(n) + k < last
            x = h * np.uint32(0x9E3779B1) + np.uint32(k)
            ids.append((((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits))[inside])
            ends.append(np.concatenate([[0], np.cumsum(inside)])[off])
    return list(zip(ids, ends, strict=True)), letters


def few(part):
    """The rows of a part in pieces of a few languages each."""
    names = sorted(set(part.column("lang").to_pylist()))
    for at in range(0, len(names), HELD_LANGUAGES):
        yield part if len(names) <= HELD_LANGUAGES else part.filter(pc.is_in(part.column("lang"), pa.array(names[at : at + HELD_LANGUAGES])))


def _count(bits: int):
    step = (1 << bits) // SLICES

    def emit(held, docs):
        for x, counts in held.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([x] * SLICES), "part": pa.array(range(SLICES), pa.int32()),
                "docs": pa.array([docs[x]] * SLICES, pa.int64()),
                "counts": pa.array([pa.compress(counts[i * step : (i + 1) * step].astype(np.int64).tobytes(), codec="zstd", asbytes=True) for i in range(SLICES)], pa.binary()),
            })

    def run(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for part in (p for batch in batches for some in kernels.slices(batch, limit=kernels.STAGE_BYTES) for p in few(some)):
            if len(held) > HELD_LANGUAGES:
                yield from emit(held, docs)
                held, docs = {}, {}
            if part.num_rows:
                langs = part.column("lang").to_pylist()
                orders, _ = ngrams(part.column("text").to_pylist(), bits)
                names = sorted(set(langs))
                code = {x: i for i, x in enumerate(names)}
                own, counts = np.array([code[x] for x in langs], np.int64) << bits, 0
                for ids, off in orders:
                    counts = counts + np.bincount(np.repeat(own, np.diff(off)) + ids, minlength=len(names) << bits).reshape(len(names), -1)
                for i, x in enumerate(names):
                    held[x] = held[x] + counts[i] if x in held else counts[i]
                    docs[x] = docs.get(x, 0) + langs.count(x)
        yield from emit(held, docs)

    return kernels.tidied(run)


def _add(bits: int):
    size = 8 * ((1 << bits) // SLICES)

    def run(key, table):
        total = np.zeros(size // 8, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True), np.int64)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()), "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


class Scores:
    """Some learned languages and their log-probability matrix (languages x features)."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The best language, its score, the sum of all scores (both as logarithms), and its log-probability of an n-gram
        of the text, on average; texts without a letter have `und` and -inf."""
        bits = int(self.logp.shape[1]).bit_length() - 1
        orders, letters = ngrams(texts, bits)
        scores, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for ids, off in orders:
            full = np.flatnonzero(np.diff(off))
            size += np.diff(off)
            for i in range(len(self.langs) if len(full) else 0):
                scores[full, i] += np.add.reduceat(self.logp[i][ids], off[:-1][full])
        scores += self.prior
        best = scores.argmax(1)
        top = scores.max(1)
        total = top + np.log(np.exp(scores - top[:, None]).sum(1))
        known = letters > 0
        mean = np.where(known, (top - self.prior[best]) / np.maximum(size, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, top, -np.inf), np.where(known, total, 0.0), mean

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The best language, its posterior among these, and the mean of ``judge``."""
        lang, top, total, mean = self.judge(texts)
        return lang, np.exp(top - total), mean


class Model:
    """Learned languages, by name, and their broadcast groups."""

    def __init__(self, langs: list[str], groups: list, bits: int):
        self.langs, self.groups, self.bits = langs, groups, bits


def fit(docs: DataFrame, bits: int = BITS, cells: int = MODEL_CELLS) -> Model:
    """Learn from every row with a text and a language."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    kind = "lang string, part int, docs long, counts binary"
    found = common.materialize(rows.mapInArrow(_count(bits), kind).groupBy("lang", "part").applyInArrow(_add(bits), kind), "languages")
    docs_of = {r["lang"]: r["docs"] for r in found.where("part = 0").select("lang", "docs").collect()}
    langs, total = sorted(docs_of), sum(docs_of.values())
    step, most, groups = (1 << bits) // SLICES, max(1, cells >> bits), []
    for at in range(0, len(langs), most):
        some = langs[at : at + most]
        row_of, counts = {x: i for i, x in enumerate(some)}, np.zeros((len(some), 1 << bits))
        for r in found.select("lang", "part", "counts").where(F.col("lang").isin(some) if len(langs) > most else F.lit(True)).toLocalIterator():
            counts[row_of[r["lang"]], r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
        logp = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * counts.shape[1])
        groups.append(spark.sparkContext.broadcast(Scores(some, logp, np.log(np.array([docs_of[x] for x in some]) / total))))
    common.discard(found)
    return Model(langs, groups, bits)


def _judged(texts: DataFrame, model: Model) -> DataFrame:
    """lang_pred, score, mean of each digest of the texts (digest, text), over several groups of languages."""

    def scored(number, sent):
        def run(batches):
            for batch in batches:
                for part in kernels.slices(batch, limit=kernels.STAGE_BYTES):
                    lang, top, total, mean = sent.value.judge(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_pydict({"digest": part.column("digest"), "number": pa.array([number] * part.num_rows, pa.int32()), "lang": pa.array(lang, pa.string()), "top": pa.array(top), "total": pa.array(total), "mean": pa.array(mean)})

        return texts.mapInArrow(run, "digest string, number int, lang string, top double, total double, mean double")

    parts = [scored(i, g) for i, g in enumerate(model.groups)]
    every = reduce(DataFrame.unionByName, parts).groupBy("digest", "number").agg(F.first(F.struct("top", (-F.col("number")).alias("o"), "lang", "total", "mean")).alias("s"))
    best = every.groupBy("digest").agg(F.max("s").alias("b"), F.collect_list("s.total").alias("totals"))
    posterior = 1 / F.aggregate("totals", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("b.top")))
    return best.select("digest", F.col("b.lang").alias("lang_pred"), F.when(F.col("b.lang") == "und", 0.0).otherwise(posterior).alias("score"), F.col("b.mean").alias("mean"))


#: The one column of this operator's own beside those of docs, where it joins.
_OWN = "_wordloom_language"


def _with_verdicts(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs with a column _OWN (lang_pred, score, mean)."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    judged = _judged(docs.select(digest.alias("digest"), "text"), model).select(F.struct("digest", "lang_pred", "score", "mean").alias(_OWN))
    return docs.join(judged, digest == F.col(f"{_OWN}.digest"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior of lang_pred) of every row; nothing but the text is looked at."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not model.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(model.groups) > 1:
        return _with_verdicts(docs, model).select("doc_id", f"{_OWN}.lang_pred", f"{_OWN}.score")
    sent = model.groups[0]

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, limit=kernels.STAGE_BYTES):
                pred, score, _ = sent.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5, languages: Collection[str] | None = None) -> DataFrame:
    """Rows of docs, all columns, whose text is in a learned language (one of ``languages``, if given); one pass, no
    shuffle, while one group holds all languages.

    The language's posterior is ``min_score`` or more, and the text is likelier in it than if all n-grams were equally
    likely: the posterior of a long text says which language is closest, even if none is close.  A text that is null or
    has no letter has no language and is rejected.
    """
    common.small_batches(docs.sparkSession)
    least = -float(np.log(1 << model.bits))
    wanted = frozenset(model.langs if languages is None else languages) - {"und"}
    if not model.langs:
        return docs.where(F.lit(False))
    if len(model.groups) > 1:
        v = F.col(_OWN)
        return _with_verdicts(docs, model).where(v["lang_pred"].isin(*wanted) & (v["score"] >= min_score) & (v["mean"] > least)).select(*docs.columns)
    sent = model.groups[0]

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, limit=kernels.STAGE_BYTES):
                found = zip(*sent.value.predict(part.column("text").to_pylist()), strict=True)
                yield part.filter(pa.array([p in wanted and s >= min_score and m > least for p, s, m in found], pa.bool_()))

    return docs.mapInArrow(kernels.tidied(run), docs.schema)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(common.crc_mod(column, 4) == 2, F.lit(False))


def op1_language_id(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
