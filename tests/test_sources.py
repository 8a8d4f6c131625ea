"""Readers and writers on temporary folders."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from archivolt.operators import moderation
from archivolt.sources import readers, writers


def test_json_lines_and_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"x"}\n\nbroken{\n{"text":" "}\n{"other":1}\n{"text":"y","k":2}\n', encoding="utf-8")
    rows = readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), "text string, k int").collect()
    assert sorted((r.text, r.k) for r in rows) == [("x", None), ("y", 2)]
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"segments": [{"text": " a"}, {"text": None}, {"text": "b"}]}))
    (folder / "2.json").write_text('{"k": 1}')
    (folder / "3.json").write_text("no json")
    got = {r.path[-6:]: r.text for r in readers.read_transcripts(spark, str(folder)).collect()}
    assert got == {"1.json": "a\n\nb", "2.json": '{"k":1}', "3.json": None}


def test_archives_round_trip(spark, tmp_path):
    members = spark.createDataFrame(
        [("p", "b.txt", bytearray(b"bb")), ("p", "life-package.json", bytearray(b"{}")), ("p", "a/c.txt", bytearray(b""))], "package string, path string, content binary"
    )
    first, again = (bytes(writers.build_archives(members, "life-package.json").first().archive) for _ in range(2))
    assert first == again
    assert zipfile.ZipFile(io.BytesIO(first)).namelist() == ["life-package.json", "a/c.txt", "b.txt"]
    (tmp_path / "x.life").write_bytes(first)
    (tmp_path / "y.life").write_bytes(b"not a zip")
    rows = readers.read_archives(spark, str(tmp_path)).collect()
    assert {r.path: r.size for r in rows if r.path} == {"life-package.json": 2, "a/c.txt": 0, "b.txt": 2}
    assert [r.error for r in rows if r.error] == ["bad_zip"]
    digests = {r.path[-6:]: r.size for r in readers.read_digests(spark, str(tmp_path)).collect()}
    assert digests["y.life"] == 9


def test_policy_forbidden_files_and_keys(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"rules": [{"name": "n", "patterns": ["x"]}]}))
    policy = readers.read_policy(str(tmp_path / "p.json"))
    assert (policy.name, policy.version, policy.rules[0].severity) == ("p", "user-supplied", "medium")
    both = moderation.select_policy(policy, moderation.Policy("b", "2", moderation.BUILTIN))
    assert both.name == "p@user-supplied+b@2" and len(both.rules) == 6
    (tmp_path / "q.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_policy(str(tmp_path / "q.json"))
    paths = spark.createDataFrame([("a/x.MP4",), ("docs/y.png",), ("z.txt",)], "path string")
    assert [r.path for r in readers.forbidden_files(paths).collect()] == ["a/x.MP4"]
    docs = spark.createDataFrame([("a", '{"$schema":1,"$id":2,"title":3,"description":4}'), ("b", '{"title":1}'), ("c", "x")], "path string, text string")
    assert {r.path: len(r.missing) for r in readers.missing_keys(docs).collect()} == {"b": 3, "c": 4}


def test_csv_html_and_append(spark, tmp_path):
    df = spark.createDataFrame([("e1", ["a", "b"], "<x>")], "event_id string, badges array<string>, name string")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().badges == "a|b"
    assert df.select(writers.html_row([F.col("name")])).first()[0] == "<tr><td>&lt;x&gt;</td></tr>"
    log = df.select("event_id")
    writers.append_events(log.where("false"), log, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    more = spark.createDataFrame([("e2",)], "event_id string")
    for bad in (log.union(more), more.union(more), spark.createDataFrame([(None,)], "event_id string")):
        with pytest.raises(ValueError, match="refused"):
            writers.append_events(stored, bad, str(tmp_path / "log"))
    writers.append_events(stored, more, str(tmp_path / "log"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["e1", "e2"]
    writers.write_json_lines(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_forbidden_files(spark):
    paths = ["a/b.WEBP", "m.safetensors", "x.tar", "y.gz", "docs/z.png", "assets/public/v.mp4", "assets/v.mp4", "ok.txt", "noext"]
    got = readers.forbidden_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r.path for r in got.collect()) == ["a/b.WEBP", "assets/v.mp4", "m.safetensors", "x.tar", "y.gz"]


def test_bad_archives(spark):
    def zipped(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x")
        return bytearray(out.getvalue())

    rows = [("ok", zipped(["d.json", "a/b.txt"])), ("unsafe", zipped(["d.json", "../x", "/abs"])), ("none", zipped(["a"])), ("bad", bytearray(b"nope")), ("gone", None)]
    got = readers.archive_members(spark.createDataFrame(rows, "package string, content binary"), "d.json").collect()
    assert {(r.package, r.error) for r in got} == {("ok", None), ("unsafe", "unsafe_member_name"), ("none", "missing_descriptor"), ("bad", "bad_zip"), ("gone", "missing")}
    assert next(r.path for r in got if r.package == "unsafe") == "../x, /abs"


def test_manifests_and_pointers(spark, tmp_path):
    for at, doc in (("a/m.json", '{"id":"x"}'), ("b/m.json", "broken"), ("b/p.pointer.json", '{"uri":"u"}'), (".git/q.pointer.json", '{"uri":"v"}')):
        (tmp_path / at).parent.mkdir(exist_ok=True)
        (tmp_path / at).write_text(doc)
    got = readers.read_manifests(spark, str(tmp_path / "*/m.json"), "id string").collect()
    assert sorted((r.path[-8:], r.id) for r in got) == [("a/m.json", "x"), ("b/m.json", None)]
    assert [r.uri for r in readers.read_pointers(spark, str(tmp_path), "uri string").collect()] == ["u"]
    texts = readers.read_texts(spark, str(tmp_path / "b")).collect()
    assert sorted(r.text for r in texts) == ["broken", '{"uri":"u"}']
