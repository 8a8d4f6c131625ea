"""The driver's entry points."""

import hashlib
import os
import struct

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert "p4_found" in queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"create view {p[:-8]} as select * from '{SF}/{p}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)

    def rows(df):
        cells = [
            df[c].map(lambda v: None if v is None or v != v else (f"{v:.9g}" if isinstance(v, float) else str(v))) for c in sorted(df.columns)
        ]
        return sorted(zip(*cells, strict=True), key=repr)

    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_document_embeddings_against_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    chunks = con.execute(entry.oracle_sql()["document_chunks"]).df()
    want = {}
    for c in chunks.itertuples():
        seed = f"{c.doc_id}#{c.chunk_id}\0{c.text}".encode()
        words = struct.unpack("<64I", b"".join(hashlib.sha256(seed + struct.pack(">H", i)).digest() for i in range(8)))
        v = [w / 4294967295.0 * 2.0 - 1.0 for w in words]
        norm = sum(x * x for x in v) ** 0.5
        want[c.doc_id, c.chunk_id] = (c.text_sha256, [x / norm for x in v])
    got = entry.queries()["document_embeddings"](spark, SF).collect()
    assert len(got) == len(want) > 100
    for r in got:
        digest, v = want[r.doc_id, r.chunk_id]
        assert r.text_sha256 == digest and r.embedding == pytest.approx(v, abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_descendants_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view audit_events as select * from '{SF}/audit_events.parquet'")
    want = con.execute(entry.oracle_sql()["p4_pairs"]).fetchall()
    got = [(r.ancestor, r.descendant, r.distance) for r in entry.queries()["p4_pairs"](spark, SF).collect()]
    assert len(got) > 0 and sorted(got) == sorted(want)


def test_only_a_missing_subpackage_is_left_out(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(missing):
        def load(name, *args, **kwargs):
            if name == "archivolt.llm":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *args, **kwargs)

        return load

    monkeypatch.setattr(builtins, "__import__", without("archivolt.llm"))
    assert "p4_found" in entry.queries() and "p1_found" not in entry.queries()
    monkeypatch.setattr(builtins, "__import__", without("ahocorasick"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
