"""The operators against plain versions of themselves."""

import random
import tempfile
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import common, containment, hostrules, kernels, langid, linetemplates, nbsvm, neardup, packing, substring, unigram

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_languages(documents):
    rows = documents.select("doc_id", "text", "lang", langid.held_out().alias("out")).collect()
    judge = brute.naive_bayes([(r.text, r.lang) for r in rows if not r.out])
    got = {r.doc_id: r for r in langid.op1_language_id(documents).collect()}
    for r in rows:
        lang, score, _ = judge(r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].held_out == r.out


def test_languages_ties_many_and_unlike(spark):
    twins = frame(spark, [(1, "aa bb", "x"), (2, "aa bb", "b"), (2, "aa bb", "b"), (3, "aa bb", "x")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(twins, langid.fit(twins)).collect()} == {"b"}
    many = frame(spark, [(i, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)}", f"l{i:04d}") for i in range(1200)], "doc_id long, text string, lang string")
    model = langid.fit(many)
    assert len(model.langs) == 1200 and len(model.groups) > 1
    assert all(g.value.logp.size <= langid.MODEL_CELLS and g.value.logp.shape[1] == 2**langid.BITS for g in model.groups)
    assert langid.predict(many, model).join(many.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count() > 1150
    known = frame(spark, [(i, "the quick brown fox and the lazy dog", "en") for i in range(3000)] + [(5000 + i, "der schnelle braune fuchs und der faule hund", "de") for i in range(3000)], "doc_id long, text string, lang string")
    asked = frame(spark, [(1, "the brown dog and the fox", None), (2, "γρήγορη καφέ αλεπού και σκύλος", None), (3, "der hund und der fuchs", None), (4, None, "en"), (5, "12 34", "en")], "doc_id long, text string, lang string")
    kept = lambda **x: [r.doc_id for r in langid.keep_known(asked, langid.fit(known), **x).orderBy("doc_id").collect()]
    assert kept() == [1, 3] and kept(languages=["en"]) == [1] and kept(languages=["und"]) == []


def test_languages_alike_in_one_group_and_in_several(spark, documents):
    whole, cut = langid.fit(documents), langid.fit(documents, cells=2**langid.BITS * 2)
    assert len(whole.groups) == 1 and len(cut.groups) == 2
    odd = frame(spark, [(1, None, "en"), (2, "", "en"), (None, "12 34", "en"), (3, "the the of", None), (3, "the the of", None)], "doc_id long, text string, lang string")
    rows = documents.select("doc_id", "text", "lang").unionByName(odd)
    a, b = ([(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(rows, m).collect()] for m in (whole, cut))
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == rows.count()
    a, b = (sorted(map(repr, langid.keep_known(rows, m, languages=["en", "fr"]).collect())) for m in (whole, cut))
    assert a == b and 0 < len(a) < rows.count()


def test_repeats_whose_first_64_bits_collide(monkeypatch):
    def all_alike(words, window, old=substring._run_hashes):
        a, b, owner, first = old(words, window)
        return a * np.uint64(0), b, owner, first

    monkeypatch.setattr(substring, "_run_hashes", all_alike)
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = pa.table({"doc_id": pa.array([1, 2, 3, 4], pa.int64()), "text": [one, two, one + " x", "y " + two]})
    key = (pa.scalar(0),)
    hits = substring._match(key, substring._index_and_probes(7, 1)(key, docs))
    runs = substring._extend(7, 13, 1, 1)(key, docs, hits)
    out = substring._cut(13)(key, docs, substring._first_holder(key, runs)).to_pylist()
    assert [(r["n_removed"], r["kept_text"]) for r in out] == [(0, one), (0, two), (30, "x"), (30, "y")]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_containment(spark, limit, monkeypatch):
    rng = random.Random(3)
    item = [f"w{i}" for i in range(40)]
    stem = "what is the capital city of the country called"
    broken = " ".join(f"{w} x" if i in (11, 30) else w for i, w in enumerate(item))  # short pieces, 9 shingles gone
    pieces = " . ".join(" ".join(item[i : i + 8]) for i in range(0, 36))  # every shingle, in no long run
    docs = [(1, " ".join(item[:20])), (1, " ".join(item[20:])), (2, broken), (3, pieces), (4, None), (5, ""), (None, " ".join(item)), (6, f"{stem} q7 now please tell me"), (6, f"{stem} q9 now please tell me"), (7, " ".join(rng.choice(item) for _ in range(300)))]
    refs = [(0, " ".join(item)), (0, " ".join(item[:9])), (-1, "too short for that"), (-2, None), (None, " ".join(item)), (-3, "One, two three. (Four) five!")] + [(i, f"{stem} q{i} now please") for i in range(1, 5000)]
    docs.append((8, 'So "one" two three four FIVE'))
    d, r = frame(spark, docs), frame(spark, refs, "item_id long, text string")
    got = {tuple(x) for x in containment.search(d, r, "item_id", max_broadcast=limit).select("doc_id", "ref").collect()}
    want = set()
    for i, t in docs:
        for j, u in refs:
            if i is not None and j is not None and i not in (6,):
                want |= {(i, j)} if brute.contained({0: t}, {0: u}) else set()
    for t in (docs[7][1], docs[8][1]):
        want |= {(6, j) for j in range(1, 5000) if brute.contained({0: t}, {0: refs[5 + j][1]})}
    assert got == want and (3, 0) in got and (6, 7) in got and (6, 9) in got and (8, -3) in got
    _, index = containment.references(r, "item_id", 0.8)
    assert index.agg(F.max(F.size("refs"))).first()[0] < 100


def test_short_references_and_texts_with_very_many(spark):
    """A reference of three or four words is one shingle; a text may hold thousands of references."""
    docs = [(1, "So what is two plus two? Four."), (2, "what is two"), (3, " ".join(f"q{i} a b c d e" for i in range(3000)))]
    refs = [(-1, "is two plus two"), (-2, "two plus"), (-3, "What is two"), (-4, "")] + [(i, f"q{i} a b c d") for i in range(3000)]
    for limit in (0, 200_000):
        got = {tuple(x) for x in containment.search(frame(spark, docs), frame(spark, refs, "item_id long, text string"), "item_id", max_broadcast=limit).select("doc_id", "ref").collect()}
        assert got == {(1, -1), (1, -3), (2, -3)} | {(3, i) for i in range(3000)}


def test_containment_on_tables(spark, documents, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {tuple(x) for x in containment.search(documents, bench, "item_id", max_broadcast=0).select("doc_id", "ref").collect()}
    assert got and got == brute.contained(texts, {r.item_id: r.text for r in bench.collect()})


def test_line_templates(spark, documents, texts):
    rng = random.Random(1)
    more = {}
    for i in range(60):
        own = [" ".join(f"v{rng.randrange(10**9):x}z" for _ in range(12)) for _ in range(3)]
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        lines = [f"Posted by {name}", f"{name} shared this page today with friends", f"Sent to {name} by fast courier from {name[::-1]} on day {i}", f"Reply {name} now", "Home"]
        more[10_000 + i] = "\n".join([own[0], rng.choice(lines), own[1], rng.choice(lines), "", own[2]])
    notice = [" ".join("".join(rng.choice("klmnopqr") for _ in range(6)) for _ in range(10)) for _ in range(24)]
    line = lambda n: " ".join(rng.choice(["Tall", "trees", "grow", "where", "rivers", "bend", "and", "birds", "sing"]) + rng.choice("abcdefghij") for _ in range(n))
    for i in range(24):  # pages of a notice and a line of their own, of few words too, and near copies of one text
        more[11_000 + i] = "\n".join([*notice[:12], line(3 + i % 9)])
        copy = notice[12:].copy()
        copy[i % 12] = copy[i % 12].replace(" ", f" edit{chr(97 + i)} ", 1 + i % 2)
        more[12_000 + i] = "\n".join(copy)
    all_texts = texts | more | {20_000: None, 20_001: "", 20_002: "\n\n \n"}
    got = {r.doc_id: r.text for r in linetemplates.drop_recurring_lines(frame(spark, list(all_texts.items()))).collect()}
    want = brute.drop_lines(all_texts)
    assert got == want and sum(got[d] != t for d, t in more.items() if d < 11_000) > 40
    assert all(notice[0] not in got[11_000 + i] and got[12_000 + i] == more[12_000 + i] for i in range(24))


def test_hilbert_curve():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))  # every cell once
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()  # and the next one beside it
        halves = packing.hilbert_keys(grid // 2, bits - 1)
        assert (keys >> d == halves).all()  # the coarser curve goes the same way


def test_packing_order_and_padding(spark):
    p = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    p = p.toPandas()
    assert p.length.sum() / (4096 * p.sequence_id.nunique()) > 0.98
    ids = [np.array(x, "<u4").tobytes() for x in ([5, 6, 7, 2], [2], [9] * 50 + [2])]
    for x, key in zip(ids, packing.document_keys(ids), strict=True):
        flat, point = np.frombuffer(x, "<u4"), []
        for k in range(packing.DIMS):
            signs = [1 if int(b) >> (7 + k) & 1 else -1 for b in packing.kernels.mix(flat.astype(np.uint64), 11)]
            side = 1 << packing.KEY_BITS
            point.append(min(max(int((np.tanh(sum(signs) / len(flat) ** 0.5 / 2) + 1) / 2 * side), 0), side - 1))
        assert packing.hilbert_keys(np.array([point]), packing.KEY_BITS)[0] == key
    bins = packing.Bins(10)
    seq, off = bins.place(np.array([4, 6, 7, 3, 5]))
    assert seq.tolist() == [1, 1, 0, 0, 2] and off.tolist() == [6, 0, 0, 7, 0]


@pytest.mark.parametrize("hosts", [0, 200_000])
def test_host_verdicts_decide(spark, tmp_path, monkeypatch, hosts):
    monkeypatch.setattr(hostrules, "BROADCAST_HOSTS", hosts)
    rng, good, bad = random.Random(5), " ".join(f"g{i}" for i in range(30)), "bad"
    rows = []
    for h in range(40):
        share = 0.9 if h % 4 == 0 else 0.1
        rows += [(len(rows) + i, bad if rng.random() < share else good, "en", f"h{h}" if h else None, 1) for i in range(rng.randrange(1, 60))]
    rows += [(10_000 + i, bad if i < 2000 else good, "en", "hot", 1) for i in range(3000)] + [(20_000, None, None, "one", None), (None, good, "en", "h5", 1), (3, good, "en", "h4", 1)]
    docs = frame(spark, rows, COLUMNS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = hostrules.op6_host_quality_rules(docs)
    key = lambda r: tuple(-1 if x is None else int(x) for x in r)
    names = ", ".join(got.columns)
    assert sorted(map(key, got.collect())) == sorted(map(key, con.sql(f"select {names} from ({hostrules.OP6_SQL})").fetchall()))
    assert got.where("not base_failed and not kept").count() > 1000 and got.where("kept").count() > 300


def test_token_counts_of_random_texts():
    from tokenizers import Tokenizer, models, normalizers

    rng = random.Random(2)
    toys = [[("<unk>", -9.0), ("▁", -1.0), ("a", -2.0), ("aa", -4.0), ("▁a", -3.0)], [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b▁", -2.5), ("ab", -4.5)]]
    for vocabulary, fallback in ((unigram.load_vocabulary(unigram.default_vocabulary()), True), (toys[0], False), (toys[1], False)):
        model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        asked = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for letters in ("abcd  ▁", "the of▁\n ", "é☃\n a▁한", "ab cx") for _ in range(3000)]
        asked += ["w" * 100 + " " + "é" * 70, "▁ ", " ▁", "▁"]
        own = unigram.Counter(vocabulary)
        assert [own.count(t) for t in asked] == [len(e.ids) for e in model.encode_batch(asked, add_special_tokens=False)]


def test_quality_learner_reaches_the_optimum():
    rng = np.random.default_rng(4)
    n, size = 60, 12
    ids = [np.sort(rng.choice(size, 5, replace=False)) for _ in range(n)]
    y = np.where(np.array([2 in x for x in ids]) ^ (rng.random(n) < 0.15), 1.0, -1.0)
    rows = [(x, rng.normal(size=5)) for x in ids]
    cost = np.where(y > 0, 0.7, 0.4)
    w, bias = nbsvm.dual_coordinate_descent(rows, y, size, cost, 4000)
    dense = np.zeros((n, size + 1))
    for i, (x, v) in enumerate(rows):
        dense[i, x] = v
        dense[i, size] = 1
    primal = lambda u: u @ u / 2 + np.sum(cost * np.maximum(0, 1 - y * (dense @ u)))
    a, g = np.zeros(n), (dense * y[:, None]) @ (dense * y[:, None]).T
    for _ in range(100_000):  # projected gradient ascent on the dual
        a = np.clip(a + (1 - g @ a) / np.linalg.norm(g, 2), 0, cost)
    best = (dense * y[:, None]).T @ a
    assert abs(primal(np.append(w, bias)) - primal(best)) < 1e-4 and np.allclose(np.append(w, bias), best, atol=1e-2)


def test_quality_features_and_ratios():
    texts = ["The cat, the cat.\nTHE Dog9 ''' über", "the cat the cat", "", None, "x" * 40 + " !!! 12"]
    code, off = nbsvm.shape_tokens(pa.array(texts))

    def shape(w, before, first):
        up, low, dig = (sum(a <= b <= z for b in w) for a, z in ((65, 90), (97, 122), (48, 57)))
        low += sum(b >= 128 for b in w)
        case = 1 if not up and low else 2 if up and not low else 3 if up == 1 and low else 4 if up > 1 else 0
        tail = w[-1] if w[-1] < 128 and not chr(w[-1]).isalnum() else 0
        return case, min(len(w) - up - low - dig, 3), tail, sum(len(w) >= x for x in (2, 4, 8, 16, 32)), w == before, first, dig > 0

    plain = []
    for t in texts:
        before = None
        for i, line in enumerate((t or "").split("\n")):
            for k, w in enumerate(brute.words(line)):
                plain.append(shape(w.encode(), before, k == 0))
                before = w.encode()
    assert len(plain) == len(code) and len(set(zip(plain, code.tolist(), strict=True))) == len(set(plain)) == len(set(code.tolist()))
    ids, at = nbsvm.features(pa.array(texts), 18)
    sets = [set(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert [len(s) == b - a for s, a, b in zip(sets, at, at[1:], strict=False)] == [True] * 5 and not sets[2] and not sets[3]
    assert sets[0] & sets[1] and sets[0] != sets[1]
    labels = np.array([1, 1, 0, 0, 0])
    model = nbsvm.train([ids[a:b] for a, b in zip(at, at[1:], strict=False)], labels, 18)
    p, q = ([1 + sum(f in s for s, x in zip(sets, labels, strict=True) if x == c) for f in range(1 << 18)] for c in (1, 0))
    f = next(iter(sets[0]))
    assert abs(model.ratio[f] - np.log(p[f] / sum(p) / (q[f] / sum(q)))) < 1e-12
    own = sorted(sets[0])
    norm = sum(model.ratio[f] ** 2 for f in own) ** 0.5
    margin = model.intercept + sum(model.weights[f] * model.ratio[f] for f in own) / norm
    want = 1 / (1 + np.exp(-(model.scale[0] * margin + model.scale[1])))
    assert abs(model.score(pa.array(texts))[0] - want) < 1e-9


def test_quality_sample_is_bounded(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    seen = []
    train, nbsvm.train = nbsvm.train, lambda ids, y, *a: seen.append(sum(4 * len(x) for x in ids)) or train(ids, y, *a)
    try:
        nbsvm.fit(documents.unionByName(documents), labels, max_bytes=20_000)
        nbsvm.fit(documents, labels, max_bytes=20_000)
    finally:
        nbsvm.train = train
    assert seen[0] == seen[1] and 5_000 < seen[0] <= 20_000


# The pipeline: every stage on its own input.

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rst"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with what each stage looks for, nulls, repeats and columns whose names clash with those of the operators."""
    rng = random.Random(9)
    item = prose(rng, 30)
    rows = [(i, f"{prose(rng, 60)}\n{'Subscribe to our letter' if i % 3 == 0 else prose(rng, 9)}\n{prose(rng, 40)}", "en") for i in range(40)]
    base = [prose(rng, 100).split() for _ in range(3)]
    rows += [(100 + 10 * k + i, " ".join([*b[:50], f"edit{i}", *b[50:]]), "en") for k, b in enumerate(base) for i in range(5)]
    rows += [(200 + i, f"{prose(rng, 20)} {item} {prose(rng, 20)}", None) for i in range(3)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34 !!", "en"), (303, "γρήγορη καφέ αλεπού και σκύλος", None), (304, "καφέ", None), (None, prose(rng, 50), "en"), (5, rows[5][1], "en"), (305, prose(rng, 5000), None)]
    extra = ("n_lines", "n_dropped", "drop", "_doc", "_gone", "_leak", "component_id", "sig", "line", "row", "value")
    docs = spark.createDataFrame([(d, t, x, "s", len(t or ""), *["own"] * len(extra)) for d, t, x in rows], COLUMNS + "".join(f", {c} string" for c in extra))
    folder = tempfile.mkdtemp()
    spark.createDataFrame([(1, item), (2, "four words are few"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs, folder, item


def held(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.sig) for r in df.collect())


def test_lines_are_counted_in_sorted_runs():
    """A slice of texts is one row, however many signatures it has; runs of any chunks meet in their buckets."""
    texts = [f"Home page {i}\n" + "\n".join(f"line {chr(97 + (i * k) % 26)} of {chr(97 + k)} and some more words here" for k in range(12)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40)), "text": texts})
    packed = list(linetemplates._parse(iter([batch.slice(0, 15), batch.slice(15)])))
    sigs = np.concatenate([np.frombuffer(b.column("sigs")[0].as_py(), np.uint64) for b in packed])
    assert [b.num_rows for b in packed] == [1, 1] and sum(b.column("n")[0].as_py() for b in packed) == len(sigs) > 2000
    want = {s for s, n in Counter(sigs.tolist()).items() if n >= (20 if s & 1 else 5)}
    for cut, buckets in ((1, 1), (3, 7), (1, 64)):
        runs = pa.Table.from_batches([linetemplates._counted(np.array_split(part, 2), buckets) for part in np.array_split(sigs, cut)])
        got = [linetemplates._merged(5)(runs.filter(pc.equal(runs.column("bucket"), b))).column("sig") for b in runs.column("bucket").unique()]
        assert {x % (1 << 64) for c in got for x in c.to_pylist()} == want and sum(map(len, got)) == len(want)
        assert runs.num_rows <= cut * buckets


def test_blocks_of_members_are_read_many_at_a_time():
    rng = np.random.default_rng(2)
    n = 60
    key, i = np.sort(rng.integers(0, 12, n)), np.zeros(n, np.int32)
    sig = rng.integers(0, 2, (n, 16), dtype=np.uint8)
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array(key), "i": pa.array(i), "j": pa.array(i), "own": pa.array(i), "doc_id": pa.array(rng.permutation(n)), "component": pa.array(rng.integers(0, 5, n)),
        "band": pa.array(i), "sig": pa.array([x.tobytes() for x in sig], pa.binary()), "keys": pa.array([bytes(8)] * n, pa.binary()),
    })
    ids, comp = batch.column("doc_id").to_pylist(), batch.column("component").to_pylist()
    want = {(key[a], min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(n) for b in range(a) if key[a] == key[b] and comp[a] != comp[b] and (sig[a] == sig[b]).mean() >= 0.5}
    for size in (n, 7, 1):
        out = list(neardup._block_pairs(16, 0.5)(iter([batch.slice(k, size) for k in range(0, n, size)])))
        got = [(r["key"], min(r["doc_id"], p), max(r["doc_id"], p)) for b in out for r in b.to_pylist() for p in r["partners"]]
        assert set(got) == want and len(got) == len(want) > 20
    a, b = rng.integers(0, 2, (50, 256), dtype=np.uint8), np.zeros(256, np.uint8)
    a[0] = 0
    for width in (256, 20):
        assert neardup._agree(a[:, :width].copy(), b[:width]).tolist() == (a[:, :width] == b[:width]).sum(1).tolist()


def test_workers_of_shared_stages_hold_little():
    """What a batch of 4 MB takes: 14 to 42 MB with slices of 512 KB; of 2 MB, or unsliced, it took 50 to 160 MB."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    texts = ["\n".join(" ".join(rng.choices(words, k=12)) for _ in range(60)) for _ in range(900)]
    n = range(len(texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(n), "row": pa.array(n), "text": texts, "lang": ["a", "b", "c"] * 300, "component": pa.array(n), "held": pa.array([[0] for _ in n], pa.list_(pa.int32())), "block": pa.array([0] * len(n)), "partners": pa.array([[] for _ in n], pa.list_(pa.int64()))})
    for run, most in ((langid._count(16), 70), (linetemplates._parse, 60), (linetemplates._neighbours(False), 60), (neardup._signatures(256, 24, 4), 30), (neardup._confirm(80, 100), 80)):
        tracemalloc.start()
        parts = [part.num_rows for part in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert parts
        assert peak < most


def test_pipeline_stages(spark, corpus):
    docs, folder, item = corpus
    rows = [r.asDict() for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    judge = brute.naive_bayes([(r["text"], r["lang"]) for r in rows])
    least = -np.log(1 << langid.BITS)

    out = stage["language_id"](spark, docs, folder)
    want = [r for r in rows for lang, s, m in [judge(r["text"])] if lang != "und" and s >= 0.5 and m > least]
    assert held(out) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], "own") for r in want) and out.columns == docs.columns
    assert {300, 301, 302, 303} & {r["doc_id"] for r in want} == set() and len(want) >= len(rows) - 5

    out = stage["line_dedup"](spark, docs, folder)
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    kept = brute.drop_lines(texts) | {None: next(r["text"] for r in rows if r["doc_id"] is None)}
    assert held(out) == sorted((-1 if r["doc_id"] is None else r["doc_id"], kept[r["doc_id"]] or "", "own") for r in rows) and out.columns == docs.columns
    assert out.where("text like '%Subscribe%'").count() == 0 and out.where("n_lines = 'own' and n_dropped = 'own'").count() == len(rows)
    assert out.where("n_chars <> length(coalesce(text, ''))").count() == 0

    out = stage["near_dedup"](spark, docs, folder)
    of = brute.components(texts, 80, 100)
    assert held(out) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", "own") for r in rows if r["doc_id"] is None or of[r["doc_id"]] == r["doc_id"]) and out.columns == docs.columns
    assert {r.doc_id for r in out.where("doc_id between 100 and 199").collect()} == {100, 110, 120}

    out = stage["decontamination"](spark, docs, folder)
    leaks = {d for d, _ in brute.contained(texts, {1: item})}
    assert leaks == {200, 201, 202} and out.columns == docs.columns
    assert held(out) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", "own") for r in rows if r["doc_id"] not in leaks)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = stage["packing"](spark, docs, folder).toPandas()
    want = sorted((r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in rows if r["doc_id"] is not None)
    got = []
    for _, g in pieces.sort_values(["doc_id", "start"]).groupby(["doc_id", "doc_tokens"]):
        for k in range(int((g.start == 0).sum())):
            got.append((int(g.doc_id.iloc[0]), [t for ids in g.sort_values("start").ids.iloc[k :: int((g.start == 0).sum())] for t in ids]))
    assert sorted(got) == want
    assert (pieces.groupby("sequence_id").length.sum() <= 4096).all()


def test_pipeline_of_all_stages(spark, corpus):
    docs, folder, item = corpus
    rows = [r.asDict() for r in docs.collect()]
    judge = brute.naive_bayes([(r["text"], r["lang"]) for r in rows])
    left = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None and judge(r["text"])[0] != "und" and judge(r["text"])[2] > -np.log(1 << langid.BITS)}
    left = brute.drop_lines(left)
    of = brute.components(left, 80, 100)
    left = {d: t for d, t in left.items() if of[d] == d}
    left = {d: t for d, t in left.items() if not brute.contained({d: t}, {1: item})}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(left)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, corpus, name):
    docs, folder, _ = corpus
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), folder)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_packing_in_a_stage_leaves_nothing_in_workers(spark, documents):
    docs = documents.select("doc_id", "text").where("doc_id is not null").limit(600).toArrow().combine_chunks().to_batches()
    task = lambda **x: packing._tokenised(packing.default_tokenizer(), 4096, True, 1000, kernels.STAGE_BYTES, **x)(iter(docs))
    packing.release()
    kept = list(task())
    assert packing._encoders
    assert list(task(keep=False)) == kept and not packing._encoders
    ended = []
    assert list(kernels.tidied(lambda batches: (b + 1 for b in batches), lambda: ended.append(1))([1, 2])) == [2, 3] and ended == [1]
    pieces = packing.pack(documents, with_ids=True, keep=False)
    assert "ExistingRDD" not in pieces._jdf.queryExecution().toString()  # no rows that pass through workers of another kind
    key = ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert sorted(map(tuple, pieces.select(*key).collect())) == sorted(map(tuple, packing.pack(documents).select(*key).collect()))


def test_packing_with_ids_in_small_ranges_and_row_groups(spark, monkeypatch):
    """A task that sorts, writes or reads token ids holds a range and a row group, so both are small; results don't depend on the groups."""
    docs = spark.range(10_400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> cast((id * 61 + x * 37) % 5003 AS string))) AS text").coalesce(1)
    tables, write = {}, common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name, *more: tables.setdefault(name, write(df, name, *more)))
    monkeypatch.setattr(packing, "GROUP_BYTES", 128 << 10, raising=False)
    got = packing.pack(docs, with_ids=True, keep=False)
    assert tables["placed"].select("range").distinct().count() == 2
    for name, table in tables.items():
        sizes = [meta.row_group(k).total_byte_size for f in Path(table._table.removeprefix("file:")).glob("*.parquet") for meta in [pq.read_metadata(f)] for k in range(meta.num_row_groups)]
        assert len(sizes) > 4 and max(sizes) < 1 << 20, name
    plain = {r["doc_id"]: (r["ids_crc32"], r["length"]) for r in packing.pack(docs).collect()}
    rows = got.selectExpr("doc_id", "length", "ids_crc32", "ids", "sequence_id", "offset").toArrow().to_pylist()
    assert {r["doc_id"]: (zlib.crc32(np.array(r["ids"], "<u4").tobytes()), len(r["ids"])) for r in rows} == plain
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 4096
    assert len(ends) <= 1.02 * sum(ends.values()) / 4096 + 2
