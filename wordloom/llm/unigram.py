"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists, for each end position, the vocabulary pieces that end there, longest first; dynamic
programming carries the best score and its number of pieces, and no path is kept.  Ties are the tokenizer's:
among equal scores the piece that starts first (the longest) stays, as only a strictly better one replaces it.  A
character that is no piece of its own may be unknown, at the lowest score less 10, and then counts as its UTF-8
bytes (byte fallback) where the vocabulary has them, else a run of them as one.

The public vocabularies hold merges and no probabilities, and none is trained here: a piece's score is its log-probability
under Zipf's law over the vocabulary's own ranks, in steps of 2 ** -16, so that sums are exact and ties are ties.

Spaces become the word mark and the text is led by one; a word mark in the text is a space.  Where no piece runs across
the start of a word, a text's best path is its words' best paths, so words are counted once and cached (but for very long
ones, so a cache is bounded in bytes); otherwise whole texts are searched, in memory linear in the text.
Null and empty texts have no tokens; rows that repeat are counted each.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

MARK = "▁"
CACHE_WORDS = 1_200_000
#: Characters of the longest word that is remembered.
CACHED_CHARS = 64
STEP = 1 << 16


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log-probability) of a sentencepiece model's pieces, in order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)), 1)}
    total = math.log(sum(1 / r for r in rank.values()))
    score = lambda r: -round((math.log(r) + total) * STEP) / STEP
    return [(model.id_to_piece(i), score(rank.get(i, len(ids)))) for i in ids]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.fallback = all(f"<0x{b:02X}>" in pieces for b in range(256))
        # Without fallback a run of unknown characters is one token, also across the start of a word.
        self.by_word = self.fallback and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.line_free = not any("\n" in p for p in pieces)
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces on the best path over text as it is."""
        n, done = len(text), 0
        score: list = [None] * (n + 1)
        score[0], count, single, gap = 0.0, [0] * (n + 1), bytearray(n + 1), bytearray(n + 1)
        for last, (length, s) in self.automaton.iter(text):
            while done < last:  # no piece of an earlier end is to come
                done += 1
                if not single[done]:
                    self._single(text, done, score, count, gap)
            start = last + 1 - length
            new, had = score[start] + s, score[last + 1]
            if had is None or new > had:
                score[last + 1], count[last + 1], gap[last + 1] = new, count[start] + 1, 0
            if length == 1:
                single[last + 1] = 1
        while done < n:
            done += 1
            if not single[done]:
                self._single(text, done, score, count, gap)
        return count[n]

    def _single(self, text: str, e: int, score: list, count: list, gap: bytearray) -> None:
        """The unknown character that ends at e: tried last, as it starts last."""
        new = score[e - 1] + self.unknown
        if score[e] is None or new > score[e]:
            tokens = len(text[e - 1].encode("utf-8", "surrogatepass")) if self.fallback else 1 - gap[e - 1]
            score[e], count[e], gap[e] = new, count[e - 1] + tokens, 1

    def _word(self, word: str, known: dict[str, int], mark: str) -> int:
        n = known.get(word)
        if n is None:
            n = self.best(mark + word)
            if len(word) <= CACHED_CHARS:
                known[word] = n
        return n

    def _line(self, line: str, first: bool) -> int:
        words = line.split(" ")
        if "" in words[1:-1] or len(words) > 1 and not (words[0] and words[-1]):  # runs of spaces go with the word after them
            units = re.findall(" +[^ ]*|[^ ]+", (" " if first else "") + line)
            return sum(self.best(u.replace(" ", MARK)) for u in units)
        known, total = self.words, 0
        if not first:
            head = words.pop(0)
            total = self._word(head, self.heads, "") if head else 0
        try:
            return total + sum(map(known.__getitem__, words))
        except KeyError:
            return total + sum(self._word(w, known, MARK) for w in words)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.best(MARK + text.replace(" ", MARK))
        text = text.replace(MARK, " ")
        if len(self.words) + len(self.heads) > CACHE_WORDS:
            self.words.clear()
            self.heads.clear()
        if not self.line_free:
            return self._line(text, True)
        lines = text.split("\n")
        return len(lines) - 1 + sum(self._line(x, not i) if x or not i else 0 for i, x in enumerate(lines))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(load_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row."""
    common.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches):
        count = counter(path).count
        for batch in batches:
            for part in kernels.slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array([count(t) for t in part.column("text").to_pylist()], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def op7_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
