"""The source of tagged lines: splits of any size, files that grow, bad lines; imports."""

import json

import pytest
from turnstone.operators.importing import imported
from turnstone.sources import graphlines
from turnstone.sources.graphlines import lines, parsed, sizes, stretches


def node(i, conversation="c", parent=None, content="text", **more):
    return json.dumps({"kind": "node", "id": f"n{i}", "conversation_id": conversation, "parent_id": parent, "role": "user", "timestamp_ns": i, "content": content, **more}, ensure_ascii=False)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    a = [node(0), "", "  ", node(1, parent="n0", content="é漢" * 50), "broken {", '"text"', node(2, parent="n1", timestamp_ns="late")]
    (tmp_path / "in/a.jsonl").write_text("\n".join(a) + "\n", encoding="utf-8")
    (tmp_path / "in/b.jsonl").write_bytes(b'\xff\xfe\n{"kind":"node","id":"x"}\r\n' + node(9, "d").encode())  # no line break at the end
    (tmp_path / "in/_hidden").write_text("no data")
    return str(tmp_path / "in")


def test_splits_of_any_size_give_the_same(folder):
    found = {f: (0, n) for f, n in sizes(folder).items()}
    assert sorted(found) == ["a.jsonl", "b.jsonl"]
    whole = [r for s in stretches(found, 1 << 20) for r in lines(folder, s)]
    assert [r[2] for r in whole] == ["node", "node", "rejected", "rejected", "rejected", "rejected", "rejected", "node"]
    assert [r[-1] for r in whole if r[2] == "rejected"] == ["not JSON", "not an object", "wrong type of timestamp_ns", "not JSON", "lacks conversation_id"]
    for split in (1, 2, 7, 64, 300):
        assert [r for s in stretches(found, split) for r in lines(folder, s)] == whole, split


def test_a_stream_reads_what_is_whole_and_new(spark, folder, tmp_path):
    graphlines.register(spark)

    def run():
        s = spark.readStream.format("graphlines").option("splitBytes", "100").load(folder)
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file, r.offset) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    batch = sorted((r.file, r.offset) for r in spark.read.format("graphlines").option("splitBytes", "100").load(folder).collect())
    first = run()
    assert first == batch[:-1]  # the last line of b isn't whole yet
    with open(f"{folder}/b.jsonl", "ab") as f:
        f.write(b"\n" + node(10, "d").encode() + b"\n")
    with open(f"{folder}/c.jsonl", "w") as f:
        f.write(node(0, "e") + "\n")
    again = run()
    assert again == sorted((r.file, r.offset) for r in spark.read.format("graphlines").load(folder).collect()) and len(again) == len(first) + 3
    assert run() == again


def test_import(spark):
    branch = lambda b, leaf, **more: json.dumps({"kind": "branch", "id": b, "conversation_id": "c", "leaf_node_id": leaf, **more})
    text = [node(0), node(1, parent="n0"), node(2, parent="n1"), node(2, parent="n1"), node(3, parent="n1"), node(4, parent="gone"), node(5), node(5, content="other"), branch("x", "n0"), branch("x", "n2", title="T"), branch("y", "n3", canonical=True), branch("z", "n4"), branch("w", "n5"), json.dumps({"kind": "echo", "conversation_id": "c", "message_id": "m", "sequence": 1, "event_kind": "call"})]
    rows = spark.createDataFrame([parsed("f", i, t.encode()) for i, t in enumerate(text)], graphlines.SCHEMA)
    got = {k: sorted(map(tuple, df.collect()), key=repr) for k, df in imported(rows, turns=2, overlap=1).items()}
    assert [n[0] for n in got["nodes"]] == ["n0", "n1", "n2", "n3", "n4"] and len(got["echoes"]) == 1 and got["titles"] == [("c", "T")]
    assert got["branches"] == [("c", "x", "n2", False, 3), ("c", "y", "n3", True, 3)]
    assert [f[:4] for f in got["fragments"]] == [("c", b, s, s + 2) for b in "xy" for s in (0, 1)]
    assert sorted((r[2], r[3]) for r in got["rejected"]) == [("conflict", "other"), ("conflict", "text"), ("dangling", "w"), ("dangling", "z")]
    with pytest.raises(ValueError):
        imported(rows, turns=2, overlap=2)


def test_small_splits_of_large_files_share_partitions(tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / f"in/{name}.jsonl").write_text("".join(node(i, name, content="x" * 50) + "\n" for i in range(9000)))
    reader = graphlines.Reader(str(tmp_path / "in"), 512)
    parts = reader.partitions()
    assert len(parts) <= 300 and sum(p.end - p.start for p in parts) == sum(sizes(reader.path).values())
    assert [(r[0], r[3]) for p in parts for r in reader.read(p)] == [(f"{x}.jsonl", f"n{i}") for x in "ab" for i in range(9000)]
