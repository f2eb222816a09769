"""Incremental ingest of a folder, and hash trees of generations."""

import os

import pytest

from tidemark.operators import ingest
from tidemark.sources import manifests


def states(spark, inbox, root):
    rows = ingest.ingest(ingest.folder(spark, str(inbox)), str(root), parts=8).collect()
    return {r.path.rsplit("/", 1)[-1]: r.state for r in rows}


def texts(spark, root):
    return sorted(r.text for r in ingest.opened(spark, str(root)).documents.collect())


def test_runs_over_a_folder(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "root"
    (inbox / "deep").mkdir(parents=True)
    write = lambda name, data: (inbox / name).write_bytes(data)
    for i in range(12):
        write(f"f{i}.txt", f"text {i}".encode())
    write("deep/copy.txt", b"text 3")
    write("broken.txt", b"\xff\xfe\x00bad")
    first = states(spark, inbox, root)
    assert first == {**{f"f{i}.txt": "INDEXED" for i in range(12)}, "f3.txt": "DUPLICATE", "copy.txt": "INDEXED", "broken.txt": "FAILED"}
    assert texts(spark, root) == sorted(f"text {i}" for i in range(12))

    before = ingest.opened(spark, str(root))
    again = states(spark, inbox, root)
    assert set(again.values()) == {"UNCHANGED", "FAILED"} and ingest.opened(spark, str(root)).generation == before.generation

    write("f1.txt", b"text changed")  # changed
    write("f2.txt", b"text 5")  # changed into a copy
    (inbox / "f4.txt").unlink()  # removed
    (inbox / "deep/copy.txt").unlink()  # the other alias stays
    write("new.txt", b"text new")
    write("broken.txt", b"mended")
    third = states(spark, inbox, root)
    assert {k: v for k, v in third.items() if v != "UNCHANGED"} == {"f1.txt": "INDEXED", "f2.txt": "DUPLICATE", "f4.txt": "REMOVED", "copy.txt": "REMOVED", "new.txt": "INDEXED", "broken.txt": "INDEXED"}
    assert texts(spark, root) == sorted(["text 0", "text changed", "text 3", *(f"text {i}" for i in range(5, 12)), "text new", "mended"])
    after = ingest.opened(spark, str(root))
    shared = {g for g in after.places.values()}
    assert after.generation != before.generation and before.generation in shared and after.generation in shared  # parts without changes stay where they are
    assert set(states(spark, inbox, root).values()) == {"UNCHANGED"}


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    inbox, root = tmp_path / "in", tmp_path / "root"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    states(spark, inbox, root)
    (inbox / "b.txt").write_text("two")

    def dies(*_):
        raise RuntimeError("gone")

    monkeypatch.setattr(ingest.files, "publish", dies)
    with pytest.raises(RuntimeError, match="gone"):
        states(spark, inbox, root)
    monkeypatch.undo()
    assert texts(spark, root) == ["one"]
    assert states(spark, inbox, root) == {"a.txt": "UNCHANGED", "b.txt": "INDEXED"} and texts(spark, root) == ["one", "two"]


def test_everything_removed(spark, tmp_path):
    feed = lambda rows: spark.createDataFrame(rows, "path string, sha string, text string")
    root = str(tmp_path)
    ingest.ingest(feed([("a", "1", "x"), ("b", "1", "x")]), root)
    assert {r.path: r.state for r in ingest.ingest(feed([]), root).collect()} == {"a": "REMOVED", "b": "REMOVED"}
    assert ingest.opened(spark, root).documents.count() == 0
    assert {r.path: r.state for r in ingest.ingest(feed([("b", "1", "x")]), root).collect()} == {"b": "INDEXED"}


def generation(spark, path, rows=400, files=40):
    spark.range(rows).selectExpr("id", "concat('row ', id) as text", f"id % {files} as part").repartition(files, "part").write.partitionBy("part").json(str(path))


def changes(found):
    rows, looked = found
    return {r.path: r.change for r in rows.collect()}, looked


def test_trees_name_what_differs(spark, tmp_path):
    generation(spark, tmp_path / "g")
    manifests.write(spark, str(tmp_path / "g"), str(tmp_path / "before"))
    assert changes(manifests.verified(spark, str(tmp_path / "g"), str(tmp_path / "before"))) == ({}, 0)
    data = sorted(p for p in (tmp_path / "g").rglob("*.json"))
    name = lambda p: str(p.relative_to(tmp_path / "g"))
    flipped, short, lost = data[3], data[7], data[11]
    text = flipped.read_bytes()
    flipped.write_bytes(text[:5] + bytes([text[5] ^ 1]) + text[6:])
    os.utime(flipped, (1, 1))
    short.write_bytes(b"".join(short.read_bytes().splitlines(keepends=True)[1:]))
    lost.unlink()
    (data[0].parent / "part-added.json").write_text('{"id": 1}\n')
    for p in tmp_path.glob("g/**/.*.crc"):
        p.unlink()
    want = {name(flipped): "CHANGED", name(short): "CHANGED", name(lost): "LOST", name(data[0].parent / "part-added.json"): "ADDED"}
    found, read = changes(manifests.verified(spark, str(tmp_path / "g"), str(tmp_path / "before")))
    assert found == want and read == 3
    manifests.write(spark, str(tmp_path / "g"), str(tmp_path / "after"))
    assert manifests.root_of(spark, str(tmp_path / "before")) != manifests.root_of(spark, str(tmp_path / "after"))
    found, looked = changes(manifests.differences(spark, str(tmp_path / "before"), str(tmp_path / "after")))
    assert found == want and looked < 40
    assert changes(manifests.differences(spark, str(tmp_path / "after"), str(tmp_path / "after"))) == ({}, 1)
