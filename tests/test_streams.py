from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from filigree.operators import messages
from filigree.operators.messages import assemble_messages, to_parts
from filigree.schemas import MESSAGE_PARTS
from filigree.streaming.ingest import ingest_available, stored_chunks
from filigree.streaming.turns import (
    TurnAssembler,
    commit_available,
    committed_messages,
    expired_messages,
    failed_messages,
    milliseconds,
)

LOG = "message_id string, text string, sources array<string>, error string"


def test_assembly_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(messages, "BLOCK", 4)
    log = spark.createDataFrame(
        [("a", "one two\nthree  four five six seven", ["s1"], None), ("b", "", [], None), ("c", "x y", [], "retrieval_failed")],
        LOG,
    )
    parts = to_parts(log)
    got = {r["message_id"]: r for r in assemble_messages(parts.orderBy(F.desc("seq"))).collect()}
    assert got["a"]["text"] == "one two\nthree  four five six seven" and got["a"]["n_deltas"] == 7
    assert [got[m]["status"] for m in "abc"] == ["complete", "complete", "error"]
    cut = assemble_messages(parts.where("part_type <> 'finish' AND part_type <> 'error'"))
    assert {r["status"] for r in cut.collect()} == {"partial"}


def write_parts(spark, path, rows):
    spark.createDataFrame(rows, MESSAGE_PARTS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, source):
    return spark.readStream.schema(MESSAGE_PARTS).option("maxFilesPerTrigger", 1).parquet(source)


def test_messages_commit_when_their_end_arrives(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(**options):
        commit_available(stream(spark, source), out, **options)
        done = {r["message_id"]: r["text"] for r in committed_messages(spark, out).collect()}
        return done, {r["message_id"]: r["error"] for r in failed_messages(spark, out).collect()}

    write_parts(spark, source, [("a", 0, "text-delta", "hello "), ("b", 0, "text-delta", "bad")])
    write_parts(spark, source, [("c", 0, "text-delta", "c"), ("c", 1, "finish", None)])
    write_parts(spark, source, [("e", 2, "finish", None), ("e", 1, "source", "s")])
    assert run() == ({"c": "c"}, {})
    # out of order, twice, and late: c has ended
    write_parts(spark, source, [("b", 1, "error", "grounding_failed"), ("a", 1, "text-delta", "world"), ("c", 0, "text-delta", "again")])
    write_parts(spark, source, [("a", 2, "finish", None), ("a", 1, "text-delta", "world"), ("e", 0, "text-delta", "first"), ("c", 1, "finish", None)])
    assert run() == ({"c": "c", "a": "hello world", "e": "first"}, {"b": "grounding_failed"})
    assert run() == ({"c": "c", "a": "hello world", "e": "first"}, {"b": "grounding_failed"})
    told = {r["message_id"]: (r["n_deltas"], r["n_sources"]) for r in committed_messages(spark, out).collect()}
    assert told == {"c": (1, 0), "a": (2, 0), "e": (1, 1)}
    assert expired_messages(spark, out).collect() == []


def test_messages_that_never_end_expire_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(spark, source, [("d", 0, "text-delta", "open")])
    write_parts(spark, source, [("x", 0, "finish", None)])
    write_parts(spark, source, [("d", 1, "finish", None), ("y", 0, "finish", None)])
    commit_available(stream(spark, source), out, idle="1 millisecond")
    # the timer fires after the batch of x; the end of d comes too late
    assert [r["message_id"] for r in expired_messages(spark, out).collect()] == ["d"]
    assert {r["message_id"]: r["text"] for r in committed_messages(spark, out).collect()} == {"x": "", "y": ""}
    assert milliseconds("2 minutes") == 120_000


def test_a_restart_from_the_checkpoint_gives_the_same_rows(spark, tmp_path):
    source, whole, parted = (str(tmp_path / n) for n in ("in", "whole", "parted"))
    rows = [(f"m{i}", seq, "text-delta", f"{i}.{seq} ") for i in range(12) for seq in range(4)] + [(f"m{i}", 4, "finish", None) for i in range(11)]
    for k in range(3):
        write_parts(spark, source, [r for j, r in enumerate(rows) if j % 3 == k])
        commit_available(stream(spark, source), parted)
    commit_available(stream(spark, source), whole)
    told = [sorted(tuple(r) for r in committed_messages(spark, p).collect()) for p in (whole, parted)]
    assert told[0] == told[1] and len(told[0]) == 11


def test_parts_that_come_together_are_one_value_of_state():
    """A batch costs a message the same few calls of the state, however many parts it has."""
    appended, turn = [], [None]
    parts = SimpleNamespace(appendValue=appended.append, get=lambda: iter(appended), clear=lambda: None)
    value = SimpleNamespace(get=lambda: turn[0], update=lambda v: turn.__setitem__(0, v))
    said = TurnAssembler(1000, 1000)
    said.init(SimpleNamespace(getListState=lambda *_: parts, getValueState=lambda *_: value, registerTimer=lambda _: None))
    timer = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    rows = [Row(message_id="a", seq=i, part_type="text-delta", payload=f"{i} ") for i in range(90)]
    rows.append(Row(message_id="a", seq=90, part_type="finish", payload=None))
    for k in (1, 2):
        assert list(said.handleInputRows(("a",), iter(rows[k::3]), timer)) == []
    assert [len(block) for (block,) in appended] == [30, 30]
    (done,) = said.handleInputRows(("a",), iter(rows[0::3]), timer)
    assert done["status"] == "complete" and done["text"] == "".join(f"{i} " for i in range(90)) and done["n_deltas"] == 90


def test_ingest_takes_new_files_once_and_replaces_documents(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    schema = "doc_id long, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest_available(spark.readStream.schema(schema).parquet(source), out, size=3, stride=2)
        return {(r["chunk_id"], r["text"]) for r in stored_chunks(spark, out).collect()}

    assert arrive([(1, "a b c d e"), (2, "x")]) == {("1-0", "a b c"), ("1-1", "c d e"), ("2-0", "x")}
    assert arrive([(1, "new text")]) == {("1-0", "new text"), ("2-0", "x")}
    assert arrive([(3, "twice here"), (3, "twice here"), (2, "x")]) == {("1-0", "new text"), ("2-0", "x"), ("3-0", "twice here")}
    assert stored_chunks(spark, out).count() == 3
