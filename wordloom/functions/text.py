"""Text normalisation as columns: search keys, surface patterns, cleaning, snippets.

The key of a text drops spaces, newlines and object marks and folds dashes, quotes and tildes.  That a key holds a wording is
asked of the text itself, by a pattern that lets just those characters stand between the wording's and each be spelt as it
folds: one scan, without a key of every text being made or stored.  How a wording was really written is found by a
look-ahead pattern, which also counts overlapping occurrences.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT = "￼"
# Characters that a search key folds, and what they fold to.
FOLDS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "～": "~", "〜": "~"}
# Soft hyphen, zero-width space, non-joiner, joiner, byte-order mark, word joiner.
INVISIBLE = "­​‌‍﻿⁠"
DROPPED = " \n" + OBJECT
UNREADABLE = r"[\x{0}\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}]"
#: What str.isspace holds for; Java's \s is narrower.
BLANK = r"\t-\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def key(text: Column | str) -> Column:
    return F.translate(text, "".join(FOLDS) + DROPPED, "".join(FOLDS.values()))


def query_key(query: str) -> str:
    composed = unicodedata.normalize("NFC", query)
    return "".join(FOLDS.get(c, c) for c in composed if not c.isspace() and c != OBJECT)


def _spelt(query: str, between: str) -> str:
    """A pattern of the wording: each character in any of its spellings, with any of ``between`` in between."""
    spellings = {c: "".join(k for k, v in FOLDS.items() if v == c) for c in set(FOLDS.values())}
    one = lambda c: f"[{re.escape(c)}{spellings[c]}]" if c in spellings else re.escape(c)
    return f"[{between}]*".join(map(one, query_key(query)))


def held(text: Column | str, query: str) -> Column:
    """Whether the text's key holds the query's; an empty query is held by none."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(_spelt(query, DROPPED)) if query_key(query) else F.lit(False)


def surface_pattern(query: str) -> str:
    """A look-ahead whose group is the wording as written, whatever blanks stand between its characters."""
    return f"(?=({_spelt(query, BLANK + OBJECT)}))"


def surface_forms(text: Column | str, query: str) -> Column:
    """All occurrences, overlapping ones too, as written; an empty query has none."""
    if not query_key(query):
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(surface_pattern(query)), F.lit(1))


def readable(text: Column | str) -> Column:
    return F.replace(text, F.lit(OBJECT), F.lit("□"))


def unreadable_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(UNREADABLE))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; Spark has no builtin for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_text(text: Column | str) -> Column:
    """Compose, mark unreadable runs, delete invisible characters, and squeeze blanks line by line."""
    marked = F.regexp_replace(F.regexp_replace(nfc(text), UNREADABLE, OBJECT), OBJECT + "+", OBJECT)
    seen = F.translate(marked, INVISIBLE, "")
    line = lambda x: F.regexp_replace(F.regexp_replace(x, f"[{BLANK}]+", " "), "^ | $", "")
    return F.array_join(F.transform(F.split(seen, "\n", -1), line), "\n")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _spans(text: pd.Series, wanted: pd.Series) -> pd.Series:
    def one(t, q):
        if not t or not q:
            return []
        # A character that composes to several stands for each of them.
        kept = [(i, FOLDS.get(x, x)) for i, c in enumerate(t) if not c.isspace() and c != OBJECT for x in unicodedata.normalize("NFC", c)]
        at, hay = [i for i, _ in kept], "".join(x for _, x in kept)
        out, pos = [], hay.find(q)
        while pos >= 0:
            out.append({"start": at[pos], "end": at[pos + len(q) - 1] + 1})
            pos = hay.find(q, pos + 1)
        return out

    return pd.Series([one(t, q) for t, q in zip(text, wanted, strict=True)])


def spans(text: Column | str, query: str) -> Column:
    """Code-point ranges of all occurrences; JVM regex positions count UTF-16 units, so this one is an Arrow function."""
    return _spans(text, F.lit(query_key(query)))


def snippet(text: Column, query: str, width: int = 60, mark: tuple[str, str] = ("《", "》"), plain: int | None = None) -> Column:
    """The first occurrence with ``width`` characters around it; without one, the text's beginning."""
    # What stands before and after the first occurrence; lengths count code points, as positions in the JVM would not.
    wanted = _spelt(query, BLANK + OBJECT)
    ends = F.split(text, wanted, 2) if wanted else F.array(text)

    def shown(parts: Column) -> Column:
        before, after = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        hit = F.substr(text, F.length(before) + 1, F.length(text) - F.length(before) - F.length(after))
        cut = lambda side, rest: F.when(F.length(rest) > width, side).otherwise("")
        around = F.concat(cut("…", before), F.right(before, F.lit(width)), F.lit(mark[0]), hit, F.lit(mark[1]), F.left(after, F.lit(width)), cut("…", after))
        return F.when(F.size(parts) == 2, around).otherwise(F.substring(text, 1, plain or 2 * width))

    return F.replace(readable(F.get(F.transform(F.array(ends), shown), F.lit(0))), F.lit("\n"), F.lit(" "))


def highlight(text: Column, query: str, width: int = 90, plain: int = 200) -> Column:
    """The snippet as HTML: escaped, the occurrence in ``mark``; ``plain`` characters where there is none."""
    shown = snippet(text, query, width, ("\x02", "\x03"), plain)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\x02", "<mark>"), ("\x03", "</mark>")):
        shown = F.replace(shown, F.lit(sign), F.lit(entity))
    return shown
