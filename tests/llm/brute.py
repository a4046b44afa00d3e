"""Plain versions of the operators: dictionaries, strings and all pairs."""

import math
import re
from collections import Counter, defaultdict

from wordloom.llm import langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ngram_ids(text, bits=langid.BITS):
    """Hashed letter n-grams of a text by whole-number arithmetic, and its number of letters."""
    out, m = [], (1 << 32) - 1
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "] if text else []
    squeezed = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    for n in (1, 2, 3):
        for i in range(len(squeezed) - n + 1):
            h = 0
            for c in squeezed[i : i + n]:
                h = (h * 0x01000193 + ord(c)) & m
            x = (h * 0x9E3779B1 + n - 1) & m
            out.append((((x ^ (x >> 15)) * 0x85EBCA77) & m) >> (32 - bits))
    return out, sum(c != " " for c in letters)


def naive_bayes(rows, bits=langid.BITS):
    """(text, lang) -> a function of a text: its language, posterior and mean log-probability."""
    counts, docs = defaultdict(Counter), Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(ngram_ids(text, bits)[0])
            docs[lang] += 1
    total = {x: sum(c.values()) + langid.ALPHA * 2**bits for x, c in counts.items()}

    def judge(text):
        ids, letters = ngram_ids(text, bits) if text else ([], 0)
        if not letters or not counts:
            return "und", 0.0, 0.0
        own = {x: sum(math.log((counts[x][i] + langid.ALPHA) / total[x]) for i in ids) for x in counts}
        score = {x: own[x] + math.log(docs[x] / sum(docs.values())) for x in counts}
        best = max(sorted(score), key=score.get)
        return best, 1 / sum(math.exp(s - score[best]) for s in score.values()), own[best] / len(ids)

    return judge


def templates(line):
    """What a line is an instance of: (template, whether few of its tokens are fixed)."""
    t = ["<*>" if re.search("[0-9]", w) else w for w in words(line)]
    n = len(t)
    fields = []
    if n == 3:
        fields = [{2}]
    elif n in (4, 5):
        fields = [{k} for k in range(n)]
    elif n >= 6:
        size = -(-(n - 3) // 3)
        thirds = [set(range(3 + k * size, min(3 + (k + 1) * size, n))) for k in range(3)]
        fields = [{0}, {1}, {2}] + thirds
        if n >= 9:
            fields += [thirds[a] | thirds[b] for a, b in ((1, 2), (0, 2), (0, 1))]
    yield tuple(t), False
    for f in fields:
        if f:
            yield (n, tuple(sorted(f)), tuple(w for i, w in enumerate(t) if i not in f)), n - len(f) < 5


def shingles(text, lower=True):
    w = words(text.translate({i: i + 32 for i in range(65, 91)}) if lower else text) if text else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts, num, den):
    """doc_id -> the smallest doc_id that links of this similarity reach."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in texts}


def drop_lines(texts, min_docs=5):
    """doc_id -> its text less the lines of templates that enough documents hold, near copies counted once."""
    held, few = defaultdict(set), {}
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            if words(line):
                for sig, f in templates(line):
                    held[sig].add(d)
                    few[sig] = f
    need = lambda s: min_docs * (4 if few[s] else 1)
    some = {s for s, ds in held.items() if len({texts[d] for d in ds}) >= need(s)}
    of = components({d: texts[d] for s in some for d in held[s]}, 80, 100)
    gone = {s for s in some if len({of[d] for d in held[s]}) >= need(s)}
    page = {d: ("group", of[d]) for s in some - gone for d in held[s]}
    fold = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    all_words, left = {}, {}
    for d in page:
        lines = fold(texts[d]).split("\n")
        free = [not any(s in some for s, _ in templates(x)) for x in texts[d].split("\n")]
        all_words[d] = [(w, f) for x, f in zip(lines, free, strict=True) for w in words(x)]
        left[d] = tuple(w for w, f in all_words[d] if f)
    for d in list(page):
        others = [e for e in page if of[e] == of[d] and left[e] != left[d]]
        pairs = {(x[0], y[0]) for e in others for x, y in zip(all_words[e], all_words[e][1:])}  # noqa: B905
        rest = [x[1] and y[1] for x, y in zip(all_words[d], all_words[d][1:])]  # noqa: B905
        lone = [r and (x[0], y[0]) not in pairs for r, x, y in zip(rest, all_words[d], all_words[d][1:])]  # noqa: B905
        if any(all(lone[i : i + 4]) for i in range(len(lone) - 3)) and 4 * sum(lone) >= 3 * sum(rest):
            page[d] = ("own", left[d])
    gone |= {s for s in some - gone if len({page[d] for d in held[s]}) >= need(s)}
    keep = lambda line: not words(line) or all(s not in gone for s, _ in templates(line))
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if keep(x)) for d, t in texts.items()}


def normal_words(text):
    out = []
    for w in words((text or "").lower()):
        w = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if w:
            out.append(w)
    return out


def contained(texts, refs, share=0.8):
    """(doc_id, ref) of the texts that hold enough of a reference's shingles."""

    def runs(t):
        w = normal_words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r: runs(t) for r, t in refs.items()}
    return {(d, r) for d, t in texts.items() for own in [runs(t)] for r, s in sets.items() if s and len(s & own) >= share * len(s)}
