"""Files, stores and titles: what is missing, equal, twice, too large; entities and pair answers by rule."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from turnstone.operators import entities, files
from turnstone.operators.classify import judged
from turnstone.sources import files as source
from turnstone.sources.jsonl import load_store, save_store

WANTED = "owner string, place long, path string, filename string, mime_type string"
FILES = "file_id string, content_id string, filename string, mime_type string, byte_length long"
CONTENTS = "content_id string, bytes binary"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def folder(spark, tmp_path):
    data = spark.createDataFrame([("a/x.txt", b"same"), ("b/y.bin", b"same"), ("z", b""), ("long", b"0" * 5000), (None, b"no"), ("n", None)], "path string, bytes binary")
    done = source.write_bytes(data, str(tmp_path / "in"))
    assert rows(done) == [("a/x.txt", 4), ("b/y.bin", 4), ("long", 5000), ("z", 0)]
    return str(tmp_path / "in")


def test_bytes_by_path(spark, folder):
    asked = spark.createDataFrame([("a/x.txt",), ("a/x.txt",), ("z",), ("a",), ("gone",), ("long",), (f"{folder}/b/y.bin",), (None,)], "path string")
    got = {r.path: (None if r.bytes is None else bytes(r.bytes), r.problem) for r in source.read_bytes(asked, folder, most=4999).collect()}
    assert got == {"a/x.txt": (b"same", ""), "z": (b"", ""), "a": (None, "no file"), "gone": (None, "missing"), "long": (None, "too large"), f"{folder}/b/y.bin": (b"same", "")}
    assert source.read_bytes(asked.where("false"), folder).count() == 0


def test_writing_stays_inside_and_is_one_thing(spark, folder):
    for bad in ([("../out", b"x")], [("/out", b"x")], [("a", b"x"), ("a", b"y")]):
        with pytest.raises(Exception):  # noqa: B017
            source.write_bytes(spark.createDataFrame(bad, "path string, bytes binary"), folder)
    again = spark.createDataFrame([("z", b"new"), ("z", b"new")], "path string, bytes binary")
    source.write_bytes(again, folder)
    assert bytes(source.read_bytes(again, folder).first().bytes) == b"new"


def test_attachments(spark, folder):
    wanted = spark.createDataFrame(
        [("o", 0, "a/x.txt", None, None), ("o", 1, "b/y.bin", "x.txt", None), ("o", 2, "b/y.bin", None, "t"), ("o", 3, "gone", None, None), ("p", 0, "z", "", None), ("p", 1, "z", None, ""), ("p", 2, "a/x.txt", None, None), ("p", 3, None, None, None)], WANTED
    )
    got = files.attached(wanted, folder, spark.createDataFrame([], FILES), spark.createDataFrame([], CONTENTS))
    problems = [(r[0], r[1], r[3]) for r in rows(got["rejected"])]
    assert problems == [("o", 1, "repeated"), ("o", 3, "missing"), ("p", 0, "no filename"), ("p", 1, "empty type"), ("p", 3, "no filename")]
    links = {(r.owner, r.place): r.file_id for r in got["links"].collect()}
    assert set(links) == {("o", 0), ("o", 2), ("p", 2)} and links["o", 0] == links["p", 2] != links["o", 2]
    assert sorted((r.filename, r.byte_length) for r in got["files"].collect()) == [("x.txt", 4), ("y.bin", 4)]
    assert [(r.content_id, bytes(r.bytes)) for r in got["contents"].collect()] == [(hashlib.sha256(b"same").hexdigest(), b"same")]
    # a second time nothing is new; a stored file that says something else is a conflict
    more = files.attached(wanted, folder, got["files"], got["contents"])
    assert more["files"].count() == more["contents"].count() == 0 and rows(more["links"]) == rows(got["links"])
    other = files.attached(wanted, folder, got["files"].withColumn("byte_length", F.col("byte_length") + 1), got["contents"])
    assert other["links"].count() == 0 and other["rejected"].where("problem = 'conflict'").count() == 3
    empty = files.attached(wanted.where("false"), folder, got["files"], got["contents"])
    assert [df.count() for df in empty.values()] == [0, 0, 0, 0]


def test_bytes_of_files(spark):
    good = hashlib.sha256(b"abc").hexdigest()
    held = spark.createDataFrame([("f", good, "n", None, 3), ("short", good, "n", None, 4), ("none", "c", "n", None, 1), ("other", "d", "n", None, 3)], FILES)
    contents = spark.createDataFrame([(good, b"abc"), ("d", b"abc")], CONTENTS)
    got = files.file_bytes(spark.createDataFrame([(x,) for x in ("f", "f", "short", "none", "other", "who")], "file_id string"), held, contents)
    assert sorted((r.file_id, r.problem, r.bytes is None) for r in got.collect()) == [("f", "", False), ("f", "", False), ("none", "no content", True), ("other", "corrupt", True), ("short", "corrupt", True), ("who", "missing", True)]


def test_compact_copies(spark):
    held = spark.createDataFrame([(f, c, f, None, 1) for f, c in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("e", "4"))], FILES)
    contents = spark.createDataFrame([(c, b"x") for c in "12345"], CONTENTS)
    bound = spark.createDataFrame([(f,) for f in ("a", "c", "c", "d", "gone")], "file_id string")
    others = spark.createDataFrame([("3",), (None,)], "content_id string")
    kept, dropped = files.repacked(held, contents, bound, others)
    assert [r[0] for r in rows(dropped)] == ["2"] and [r[0] for r in rows(kept)] == ["1", "3", "4", "5"]
    with pytest.raises(ValueError):
        files.repacked(held, contents, bound.where("file_id = 'a'"), others)


def test_stores_are_made_once(spark, tmp_path):
    path = str(tmp_path / "store")
    source.create_store(spark, path, {"a": "x long"}, "me")
    with pytest.raises(FileExistsError):
        source.create_store(spark, path, {"a": "x long"}, "you")
    save_store({"a": spark.range(2).withColumnRenamed("id", "x")}, path)
    got = load_store(spark, path, ["a", "owner"])
    assert rows(got["a"]) == [(0,), (1,)] and rows(got["owner"]) == [("me",)]
    for owner, schemas in (("", {}), ("me", {"owner": "x long"})):
        with pytest.raises(ValueError):
            source.create_store(spark, str(tmp_path / "bad"), schemas, owner)


def test_titles(spark, tmp_path, monkeypatch):
    (tmp_path / "t").mkdir()
    with gzip.open(tmp_path / "t/1.csv.gz", "wt", encoding="utf-8") as f:
        f.write('more,title,conversation_id\n,  One\t,a\n,"Say ""hi"",\nand bye",b\n,,a\n,One,a\n,Two,a\n,Lost,nobody\n,  ,c\n')
    (tmp_path / "t/2.csv").write_text("more,title,conversation_id\n,Two,a\n,One,a\n,Kept,d\n", encoding="utf-8")
    known = spark.createDataFrame([("a", "One"), ("b", None), ("c", "C"), ("d", "Kept")], "conversation_id string, title string")
    want = [("a", "One", 5, 2), ("b", 'Say "hi",\nand bye', 1, 1), ("d", "Kept", 1, 0)]
    for stretch in (1, 2, 65536):
        monkeypatch.setattr(files, "STRETCH", stretch)
        assert rows(files.backfilled(source.read_title_rows(spark, str(tmp_path / "t")), known)) == want, stretch


def test_entities_of_a_batch(spark):
    log = spark.createDataFrame([("a", 1, "m", "A", [], "k", 0), ("b", 1, "n", "B", [], "k", 0)], "id string, revision int, mutation_id string, name string, aliases array<string>, kind string, created_ns long")
    gone = spark.createDataFrame([("b", 2, "a")], "id string, revision int, replacement_id string")
    drafts = [("m", "a", 1, "A", [], "k", 0), ("n", "b", 2, "B", [], "k", 0), ("q", None, 0, "Q", [], "k", 0), ("r", "b", 2, "B", [], "k", 9), ("s", "a", 2, "A", [], "k", 0)]
    got = entities.published(log, gone, spark.createDataFrame(drafts, "mutation_id string, id string, expected_revision int, name string, aliases array<string>, kind string, created_ns long"))
    assert {r.mutation_id: (r.outcome, r.revision) for r in got.collect()} == {"m": ("repeated", None), "n": ("conflict", None), "q": ("new", 1), "r": ("contested", None), "s": ("contested", None)}
    commands = spark.createDataFrame([("a", 1, "b"), ("b", 2, "a"), ("c", 1, "a"), (None, 1, "a")], "id string, expected_revision int, replacement_id string")
    got = entities.tombstoned(log, gone, commands)
    assert {r.id: r.outcome for r in got.collect() if r.id} == {"a": "invalid", "b": "repeated", "c": "missing"}


def test_quotes_are_trimmed_of_white_space_of_any_kind(spark):
    answer = '{"relation": "topical", "direction": "none", "evidence": [{"side": "a", "quote": "\\n one\\u00a0"}, {"side": "b", "quote": "\\ttwo"}]}'
    got = judged(spark.createDataFrame([(1, 2, "x one\ny", "two", answer)], "a long, b long, a_text string, b_text string, answer string")).first()
    assert (got.problem, got.a_quote, got.b_quote) == ("", "one", "two")
