"""The operators against SQL, brute force or the tokenizer itself, and on nulls, ties, empty tables and odd columns."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import components, decontam, hostrules, langid, licenses, linetemplates, nbsvm, neardup, packing, queries, substring, unigram

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, chunk long"
LONG = " ".join(f"w{i}" for i in range(60))
ODD = [(1, LONG), (2, LONG + " tail"), (2, LONG + " tail"), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (None, LONG), (7, "b" * 300_000), (8, "\n".join(["Same line here 1"] * 3)), (9, " ".join(f"q{i % 50}" for i in range(30_000)))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i == 4 else "h", None, "k", 0) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(frame):
    cols = sorted(frame.columns)
    values = frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()
    return sorted(repr([float(x) if isinstance(x, (int, float)) else x for x in row]) for row in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def test_substring_edges(odd, none):
    got = defaultdict(list)
    for r in substring.remove_repeats(odd).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_text))
    assert got[1] == [(60, 0, LONG)] and got[2] == [(61, 60, "tail")] * 2 and got[3] == got[4] == got[5] == [(0, 0, "")]
    assert None not in got and got[9][0][1] == 0
    assert substring.remove_repeats(odd, chunk_bytes=500, bucket_bytes=200).agg(F.sum("n_removed")).first()[0] == 120
    assert substring.remove_repeats(none).count() == 0


def test_neardup_edges(odd, none):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert got[2].component_id == 1 and got[3].n_shingles == 0 and got[6].n_shingles == 1 and got[4].component_id == 4 and None not in got
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id is null").count() == 1


def test_neardup_blocks_find_links_of_a_family(spark):
    rng = np.random.default_rng(0)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(200, 3, replace=False):
            words[at] = f"x{i}{at}"
        docs.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in docs}
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=7)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: root(i) for i in sets}


def test_rows_of_one_id_with_different_texts_keep_their_links(spark):
    def text(name, tail=""):
        return " ".join(f"{name}{i}" for i in range(60)) + tail

    docs = [(5, text("a")), (5, text("b")), (7, text("a", " z")), (9, text("b", " z")), (3, text("c")), (4, text("d")), (8, text("c")), (8, text("d")), (11, text("d", " y")), (12, text("e"))]
    docs += [(-2, text("f")), (-2, text("g")), (-1, text("g", " z")), (6, text("g", " y"))]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(5, 5), (7, 5), (9, 5), (3, 3), (4, 3), (8, 3), (11, 3), (12, 12), (-2, -2), (-1, -2), (6, -2)}
    assert got.count() == len(docs)


def test_near_duplicate_stage_drops_from_0_8_up(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(1, words[:100]), (2, words[:83]), (3, words[200:324]), (4, words[200:300]), (5, words[340:400]), (6, words[340:386])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == [1, 3, 5, 6]
    assert neardup.op8_minhash_near_dedup(docs).where("kept").count() == 6


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1)] + [(100 + i, 101 + i) for i in range(20)], "a long, b long")
    got = {r.node: r.component for r in components.connected(e).collect()}
    assert got[3] == 1 and got[9] == 8 and got[120] == 100 and 5 not in got


def test_languages(spark, odd, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    p = langid.op1_language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p.lang_pred == p.lang).mean() > 0.95 and p.score.between(0, 1).all()
    got = {r.doc_id: r.lang_pred for r in langid.op1_language_id(odd).collect()}
    assert got[3] == got[4] == got[5] == "und"
    assert langid.op1_language_id(none).count() == 0
    assert langid.keep_known(odd, langid.fit(odd)).columns == odd.columns


def test_line_templates(spark, odd, none):
    docs = [(i, f"start {c} alpha\nVisit us at page {i} of the big site today\nend {c} omega") for i, c in enumerate("abcdefgh")] + [(20 + i, "copied first line\ncopied second line\ncopied third line") for i in range(8)]
    got = {r.doc_id: r for r in linetemplates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all("Visit" not in got[i].text and got[i].n_lines == 3 for i in range(8))
    assert all(got[20 + i].n_dropped == 0 for i in range(8))
    out = linetemplates.drop_recurring_lines(odd)
    assert out.count() == len(ODD) and out.where("doc_id = 3").first().text is None
    assert linetemplates.op4_line_templates(none).count() == 0


def test_letters_of_every_plane():
    assert langid.ngrams(["\U00020000\U0002a700 \U00030000", "a\U0010ffff", "\U0001f600"])[1].tolist() == [3, 1, 0]


def dropped(spark, docs):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r for r in linetemplates.drop_recurring_lines(docs).collect()}


def own(i, n=12):
    return " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(n))


def test_line_templates_of_a_block_and_beside_copies(spark):
    block = ["Share this story", "Read more below", "All rights reserved", "Contact our desk"]
    got = dropped(spark, [(i, "\n".join([own(i), *block, own(i + 100)])) for i in range(8)])
    assert all(r.text == f"{own(i)}\n{own(i + 100)}" and r.n_dropped == 4 for i, r in got.items())
    copies = [(100 + i, f"{own(50)}\nSubscribe to us\n{own(51)}") for i in range(60)]
    got = dropped(spark, [(i, f"{own(i)}\nSubscribe to us\n{own(i + 100)}") for i in range(6)] + copies)
    assert all(r.n_dropped == 1 and "Subscribe" not in r.text for r in got.values())
    got = dropped(spark, [(i, f"Home page\nSubscribe to us\nBack to top\n{own(i)}") for i in range(40)])
    assert all(r.text == own(i) for i, r in got.items())


def test_line_templates_keep_the_lines_of_near_copies(spark):
    lines = [own(i, 20) for i in range(10)]
    got = dropped(spark, [(i, "\n".join([*lines[:i], lines[i].replace(" ", " edited ", 1), *lines[i + 1 :]])) for i in range(10)])
    assert all(r.n_dropped == 0 for r in got.values())


def test_line_templates_of_pages_that_are_little_but_a_notice(spark):
    notice = [own(200 + i, 10) for i in range(12)]
    page = lambda i, n=8: "\n".join([*notice[:6], own(i, n), *notice[6:]])
    got = dropped(spark, [(i, page(i)) for i in range(60)])
    assert all(r.text == own(i, 8) and r.n_dropped == 12 for i, r in got.items())
    copies = [(100 + i, page(0)) for i in range(30)] + [(200 + i, page(1).replace(" ", f" word{chr(97 + i)} ", 1)) for i in range(8)]
    got = dropped(spark, [(i, page(i)) for i in range(4)] + copies + [(300 + i, page(i)) for i in range(4)])
    assert all(r.n_dropped == 0 for r in got.values())  # four pages and their copies


def test_line_templates_of_repeated_rows(spark):
    notice = [own(200 + i, 10) for i in range(12)]
    pages = [(i, "\n".join([*notice[:6], own(i, 8), *notice[6:]])) for i in range(12)]
    got = dropped(spark, pages + pages)
    assert all(r.text == own(i, 8) and r.n_dropped == 12 for i, r in got.items())


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["It's, so. A.B, c.. d,. É. x–, ÷. 5. <|endoftext|> <|STARTOFTEXT|> Σας.", "Été, ß. ñ,\nNaïve.\n", "…. a", ". a", "", None, "ÀÉ. İ, K."]
    enc = packing.Encoder(packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    p = packing.pack(odd, with_ids=True).toPandas()
    want = Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in ODD if d is not None)
    assert Counter(zip(p[p.start == 0].doc_id, p[p.start == 0].doc_tokens, strict=True)) == want
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 4096
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in p.itertuples())
    assert packing.pack(none).count() == 0


def test_host_rules(spark, odd, none):
    got = {r.doc_id: r for r in hostrules.judge(odd).collect()}
    assert got[3].base_failed and got[8].n_dup_lines == 2 and got[9].base_failed and got[None].n_words == 60
    assert hostrules.op6_host_quality_rules(none).count() == 0
    docs = [(i, LONG if i % 10 else "bad", "good") for i in range(100)] + [(100 + i, "bad" if i % 10 else LONG, "poor") for i in range(100)]
    kept = hostrules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("kept").select("host").distinct().collect()
    assert [r.host for r in kept] == ["good"]


def test_token_counts(odd, none):
    from tokenizers import Tokenizer, models, normalizers

    v = unigram.load_vocabulary(unigram.default_vocabulary())
    m = Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True))
    m.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = ["a", "  a  b", " ", "\n", "a\n\nb \n c", "x☃y \U0001f600", "한국어 text  \n  ", "naïve\tcafé", "a b  "]
    assert [unigram.Counter(v).count(t) for t in texts] == [len(e.ids) for e in m.encode_batch(texts, add_special_tokens=False)]
    toy = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("aa", -4.0), ("▁a", -3.0)]
    t = Tokenizer(models.Unigram(toy, unk_id=0))
    assert all(unigram.Counter(toy).best(x) == len(t.encode(x).ids) for x in ("▁aa", "aaa", "▁aaaa"))
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(odd).collect()}
    assert got[3] == got[4] == 0 and unigram.token_counts(none).count() == 0


def test_quality(spark, odd, none):
    d, lb = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    p = nbsvm.op9_quality_classifier(d, lb).join(lb, "doc_id").where("held_out").toPandas()
    assert (p.predicted == p.quality).mean() > 0.9 and p.score.between(0, 1).all()
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert nbsvm.op9_quality_classifier(odd, labels).count() == len(ODD) and nbsvm.op9_quality_classifier(none, labels).count() == 0


def test_containment(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(10, 40))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item), (4, "W1, w2 w3 w4 w5.")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, bench).collect()}
    assert got == {(d, i) for d in (1, 2) for i in (1, 4)}
    assert got == {(r.doc_id, r.ref) for r in decontam.containment.search(odd, bench, "item_id", max_broadcast=0).collect()}
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(odd, bench.where("false")).count() == 0
    assert decontam.decontaminate(odd, bench).where("doc_id is null").count() == 1
    assert licenses.scan(odd).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    pieces = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept and len(kept) > 100
