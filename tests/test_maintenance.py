"""Watched folders that change, and the rebuild of a corpus as one change."""

import os

import pytest

from wordloom import __main__ as cli
from wordloom.sources.store import Store
from wordloom.streaming import folder, watch

from tests.readers import read_lines

BODY = " 다음 글을 읽고 물음에 답하시오 가나다라마바사"


def put(path, *lines, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))
    if at:
        os.utime(path, (at, at))


def test_offsets_are_what_was_seen(tmp_path, monkeypatch):
    put(tmp_path / "a.pdf", "one", at=100)
    put(tmp_path / "sub" / "B.PDF", "two", at=100)
    put(tmp_path / "c.txt", "no", at=100)
    (tmp_path / "empty.pdf").touch()
    reader = folder.FolderReader(str(tmp_path), "*.pdf", 0)
    first = reader.latestOffset()
    assert [os.path.basename(p) for p in first] == ["a.pdf", "B.PDF"]
    names = lambda parts: sorted(os.path.basename(p) for x in parts for p in x.paths)
    assert names(reader.partitions({}, first)) == ["B.PDF", "a.pdf"] and reader.latestOffset() == first
    rows = [r for p in reader.partitions({}, first) for r in reader.read(p)]
    assert sorted(r[3] for r in rows) == [b"one", b"two"]
    put(tmp_path / "a.pdf", "one more", at=200)

    def growing(seconds):
        put(tmp_path / "half.pdf", "more of it", at=301)

    put(tmp_path / "half.pdf", "half", at=300)
    monkeypatch.setattr(folder.time, "sleep", growing)
    second = reader.latestOffset()
    assert names(reader.partitions(first, second)) == ["a.pdf"]
    monkeypatch.setattr(folder.time, "sleep", lambda s: None)
    third = reader.latestOffset()
    assert names(reader.partitions(second, third)) == ["half.pdf"]
    os.unlink(tmp_path / "half.pdf")
    assert list(reader.read(folder.Files([str(tmp_path / "half.pdf")]))) == [] and reader.partitions(third, reader.latestOffset()) == []


def test_a_changed_file_comes_again_after_a_restart(spark, tmp_path):
    store, logs = Store(spark, f"{tmp_path}/store"), []
    follow = lambda: watch.watch(spark, f"{tmp_path}/in", store, f"{tmp_path}/check", read_lines, told=logs.append, settle=0.05).awaitTermination()
    put(tmp_path / "in" / "a.pdf", "broken", at=100)
    follow()
    put(tmp_path / "in" / "a.pdf", "1. 빛 에너지", BODY, at=200)
    follow()
    follow()
    assert [[(r["status"], r["filename"]) for r in log] for log in logs if log] == [[("failed", "a.pdf")], [("added", "a.pdf")]]
    assert store.read()[0].count() == 1


@pytest.fixture
def corpus(spark, tmp_path):
    root = tmp_path / "papers"
    put(root / "2019" / "x_y_국어.pdf", "1. 빛 에너지", BODY, "2. 둘", BODY)
    put(root / "2020" / "2020_수능_수학.pdf", "표지")
    at = ["--store", f"{tmp_path}/store"]
    run = lambda *more: cli.run(spark, [*at, "maintain", str(root), "--reader", "tests.readers:read_lines", *more])
    return root, Store(spark, f"{tmp_path}/store"), run


def facts(store):
    return {(r.filename, r.year, r.subject, r.n_questions) for r in store.read()[0].collect()}


def test_a_rebuild_is_one_change(spark, corpus, capsys, monkeypatch):
    root, store, run = corpus
    assert run() == 0 and store.state().version == 0
    assert facts(store) == {("x_y_국어.pdf", 2019, "국어", 2), ("2020_수능_수학.pdf", 2020, "수학", 0)}
    # A rename repairs, a readable paper replaces an unreadable one, and a new one is added: all or nothing.
    os.rename(root / "2019" / "x_y_국어.pdf", root / "2019" / "x_y_영어.pdf")
    put(root / "2020" / "2020_수능_수학_배포.pdf", "1. 빛 에너지", BODY + "!", "2. 둘", BODY)
    before, create, calls = facts(store), Store._create, []

    def fails(self, *a):
        calls.append(a)
        raise OSError("disk full")

    monkeypatch.setattr(Store, "_create", fails)
    with pytest.raises(OSError):
        run()
    monkeypatch.setattr(Store, "_create", create)
    assert calls and facts(store) == before and store.state().version == 0
    capsys.readouterr()
    assert run("--prune") == 0 and store.state().version == 1
    told = {tuple(x.split("\t")[:2]) for x in capsys.readouterr().out.splitlines()}
    assert told == {("added", "2020_수능_수학_배포.pdf"), ("repaired", "x_y_영어.pdf"), ("superseded", "2020_수능_수학.pdf")}
    assert facts(store) == {("x_y_영어.pdf", 2019, "영어", 2), ("2020_수능_수학_배포.pdf", 2020, "수학", 2)}
    assert store.read()[1].where("text like '%빛%'").count() == 2


