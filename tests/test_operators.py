"""Segments, moderation, graph, vectors, audit, relations and hierarchy on small tables."""

import hashlib
import json
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.operators import audit, cascade, graph, lineage, moderation, relations, segments, timeline
from archivolt.operators import hierarchy as h
from archivolt.operators.neighbours import neighbours
from archivolt.operators.vectors import hash_embedding


def test_chunks_slice_back(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("é" * rng.randint(0, 1500) + " x" for _ in range(4)) + "  \n \n tail " for _ in range(5)] + ["", " \n\n ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = segments.chunks(df).collect()
    for r in rows:
        assert texts[r.doc_id][r.char_start : r.char_end] == r.text and len(r.text) <= 600
        assert r.text_sha256 == "sha256:" + hashlib.sha256(r.text.encode()).hexdigest()
    for i in range(5):
        own = sorted((r.chunk_id, r.char_start) for r in rows if r.doc_id == i)
        assert [c for c, _ in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])
    with pytest.raises(ValueError):
        segments.chunks(df, max_chars=10, overlap=10)


def test_atoms_are_redacted_and_capped(spark):
    df = spark.createDataFrame([(1, "a@b.cc here\n\n" + "y" * 5000 + "\n \n\n z"), (2, None)], "doc_id int, text string")
    rows = sorted(segments.paragraph_atoms(df).collect(), key=lambda r: r.para)
    assert [r.text[:12] for r in rows] == ["<EMAIL> here", "y" * 12, "z"] and len(rows[1].text) == 4096
    assert [r.is_cut for r in rows] == [False, True, False] and len(segments.paragraph_atoms(df, cap=9).collect()[1].text) == 9
    assert len({r.atom_id for r in rows}) == 3


def test_transcript(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, " a"), (1, 1, "b"), (1, 2, None), (2, 0, None)], "transcript_id int, seg_index int, text string")
    assert {r.transcript_id: r.text for r in segments.transcript_text(df).collect()} == {1: "a\nb", 2: ""}


def test_moderation_equals_python(spark):
    rules = (
        moderation.Rule("r1", (r"\bkill\s+you\b", r"you\w*"), "violence", "high"),
        moderation.Rule("r2", (r"[\w.]+@[\w.]+",), "pii", "medium"),
    )
    texts = ["I kill you, YOURS a@b.c 😀 kill  You", "nothing", "", "x@y 😀 z@w", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.start, r.end, r.rule) for r in moderation.flags(df, rules).collect())
    want = sorted(
        (i, m.start(), m.end(), r.name) for i, t in enumerate(texts) if t for r in rules for p in r.patterns for m in re.finditer(p, t, re.I)
    )
    assert got == want
    out = {r.doc_id: r.outcome for r in moderation.outcomes(df, moderation.flags(df, rules), "doc_id").collect()}
    assert out == {0: "block", 1: "pass", 2: "pass", 3: "flag", 4: "pass"}
    with pytest.raises(ValueError):
        moderation.Rule("x", ())


def test_graph(spark):
    units = [(1, 0, "The Hague met Ada Lovelace and Ada Lovelace in Paris"), (1, 1, "Paris saw The\nHague. Paris"), (2, 0, None)]
    df = spark.createDataFrame(units, "g int, u int, text string")
    found = graph.mentions(df, "g", ["u"])
    nodes = {r.key: (r.mentions, r.salience) for r in graph.nodes(found, "g", ["u"]).collect()}
    assert nodes == {"the hague": (1, 0.5), "ada lovelace": (1, 0.5), "paris": (2, 1.0), "hague": (1, 0.5)}
    edges = sorted((r.u, r.source, r.target) for r in graph.edges(found, "g", ["u"]).collect())
    ids = {r.node_id for r in graph.nodes(found, "g", ["u"]).collect()}
    ends = graph.links(graph.edges(found, "g", ["u"]), "g").collect()
    assert {i for r in ends for i in (r.subject_node_id, r.object_node_id)} <= ids
    assert edges == [(0, "ada lovelace", "paris"), (0, "the hague", "ada lovelace"), (1, "paris", "hague")]
    assert {r.key for r in graph.mentions(df, "g", ["u"], min_mentions=2).collect()} == {"paris"}


def test_hash_embedding(spark):
    def want(chunk, text):
        seed = f"{chunk}\0{text}".encode()
        buf = b"".join(hashlib.sha256(seed + i.to_bytes(2, "big")).digest() for i in range(8))
        v = [struct.unpack("<I", buf[i * 4 : i * 4 + 4])[0] / 0xFFFFFFFF * 2 - 1 for i in range(64)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    df = spark.createDataFrame([("1#0", "text é😀"), ("2", "")], "id string, t string")
    for r in df.select("id", "t", hash_embedding(F.col("id"), F.col("t")).alias("v")).collect():
        assert np.allclose(r.v, want(r.id, r.t), atol=1e-12)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id int, embedding array<double>")
    got = {(r.query_id, r.rank): r.neighbour_id for r in neighbours(df, df.where("vec_id % 20 = 0"), k=3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        order = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:3]
        assert [got[q, k + 1] for k in range(3)] == order
    assert neighbours(df, df.where("false")).count() == 0


def _event(i, prev, reason="r", meta=None, record="a", actor=None):
    body = {
        "event_id": f"e{i}", "event_type": "t", "record_id": record, "actor_role": "system", "actor_id": actor, "timestamp": f"2024-01-01T00:00:{i:02d}Z",
        "reason": reason, "evidence_ref": None, "prev_hash": prev,
    }
    if meta:
        body["metadata"] = meta
    if reason is None:
        del body["reason"]
    dump = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return body | {"hash": "sha256:" + hashlib.sha256(dump.encode()).hexdigest(), "event_time": body["timestamp"]}


EVENTS = (
    "event_id string, event_type string, record_id string, actor_role string, actor_id string, event_time string, reason string, evidence_ref string, "
    "prev_hash string, hash string, metadata map<string,string>, ingested_at string"
)


def _table(spark, events):
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return spark.createDataFrame([tuple({**e, "ingested_at": f"{i:04d}"}.get(n) for n in names) for i, e in enumerate(events)], EVENTS)


def test_audit_hashes_chain_and_emission(spark):
    a = _event(0, None, meta={"z": "1", "a": 'q"\\é'})
    b = _event(1, a["hash"], reason=None, actor="x/y")
    c = _event(2, b["hash"])
    forged = dict(_event(3, c["hash"]), reason="changed")
    df = _table(spark, [a, b, c, forged, a])
    ok = {r.event_id: r.intact for r in audit.verify_hashes(audit.first_deliveries(df)).collect()}
    assert ok == {"e0": True, "e1": True, "e2": True, "e3": False}
    report = audit.chain_report(df).collect()[0]
    assert (report.n_events, report.n_unlinked, report.first_bad) == (4, 0, None)
    emitted = {r.event_id: r for r in audit.emit_chain(df).collect()}
    assert [emitted[f"e{i}"]["hash"] for i in range(3)] == [a["hash"], b["hash"], c["hash"]]
    assert emitted["e1"].prev_hash == a["hash"] and emitted["e0"].prev_hash is None
    assert audit.append(df, df).count() == 0
    assert audit.chain_report(df.where("false")).count() == 0
    backwards = df.withColumn("line", 9 - F.substring("event_id", 2, 1).cast("int"))
    report = audit.chain_report(backwards, ["line"]).collect()[0]
    assert (report.n_events, report.n_unlinked, report.first_bad) == (4, 4, 1)


def test_combine_hashes(spark):
    df = spark.createDataFrame([("r", 2, "sha256:bb"), ("r", 1, "aa"), ("s", 1, None)], "g string, p int, d string")
    rows = lineage.combine_hashes(df, "g", "p", "d").collect()
    assert [(r.g, r.n_inputs, r.input_hash) for r in rows] == [("r", 2, "sha256:" + hashlib.sha256(b"sha256:aa\nsha256:bb").hexdigest())]


def test_inventory(spark):
    declared = spark.createDataFrame([("p", "a", 1, "sha256:x"), ("p", "b", 2, "y"), ("p", "c", 3, "z"), ("q", "a", None, None)], "g string, path string, size int, sha256 string")
    actual = spark.createDataFrame([("p", "a", 1, "x"), ("p", "b", 9, "y"), ("p", "d", 1, "w"), ("q", "a", 5, "v")], "g string, path string, size int, sha256 string")
    compared = relations.compare_inventory(declared, actual, "g")
    assert {(r.g, r.path): r.status for r in compared.collect()} == {
        ("p", "a"): "ok", ("p", "b"): "size", ("p", "c"): "missing", ("p", "d"): "extra", ("q", "a"): "ok",
    }
    verdict = {r.g: (r.verdict, r.extras) for r in relations.inventory_verdict(compared, "g").collect()}
    assert verdict == {"p": ("missing", "d"), "q": ("ok", "")}


def test_relations(spark):
    score = relations.weighted_score({"a": ["x", "y", "z"], "b": ["l", "m"]}, {"a": 2, "b": 1})
    df = spark.createDataFrame([("x", "l"), ("z", "m"), ("y", "l"), ("x", "m"), (None, "m")], "a string, b string")
    assert [r[0] for r in df.select(score).collect()] == [0, 100, 33, 33, None]
    assert df.select(relations.band(F.lit(32), [(0, "I"), (25, "IV"), (33, "V")])).first()[0] == "IV"
    paths = spark.createDataFrame([("a/b/c.txt",), ("a/x.txt",), ("z.txt",)], "path string")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, owner string")
    assert {r.path: r.owner for r in relations.nearest_owner(paths, owners).collect()} == {"a/b/c.txt": "B", "a/x.txt": "A", "z.txt": "<unknown>"}
    bounds = [
        ("2024-01-01T00:00:00Z", "2025-01-01T00:00:00Z", None), (None, "2025-01-01T00:00:00Z", "missing"), ("2024-01-01T00:00:00", "2025-01-01T00:00:00Z", "created_unparseable"),
        ("2024-06-01T00:00:29Z", "2025-01-01T00:00:00Z", None), ("2024-06-01T00:00:31Z", "2025-01-01T00:00:00Z", "created_in_future"), ("2024-01-01T00:00:00Z", "2024-06-01T00:00:00Z", "expired"),
        ("2024-01-01T00:00:00Z", "soon", "expires_unparseable"), ("2024-06-01T00:00:20Z", "2024-06-01T00:00:10Z", "expires_before_created"),
    ]
    df = spark.createDataFrame(bounds, "c string, e string, want string")
    for r in df.select("want", relations.time_bounds(F.col("c"), F.col("e"), F.to_timestamp(F.lit("2024-06-01T00:00:00Z"))).alias("got")).collect():
        assert r.got == r.want
    checks = {"one": F.col("c").isNotNull(), "two": F.col("e") == "soon"}
    assert df.where("c is null").select(relations.first_failure(checks)).first()[0] == "one"


LINKS = "node string, parent string"


def brute_hierarchy(links):
    parent = {n: p for n, p in links}
    out = {}
    for n in parent:
        path, at = [n], parent[n]
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        out[n] = None if at in parent else path[::-1]
    return out


@pytest.mark.parametrize("broadcast", [h.BROADCAST_VALUES, 0])
def test_hierarchy_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(h, "BROADCAST_VALUES", broadcast)
    rng = random.Random(1)
    links = [(f"n{i}", None if i % 17 == 0 else f"n{rng.randint(max(0, i - 3), i - 1)}") for i in range(1, 120)]
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x4", "x1"), ("self", "self"), ("below", "x4"), ("lost", "nowhere"), ("chain0", None)]
    links += [(f"chain{i}", f"chain{i - 1}") for i in range(1, 40)]
    df = spark.createDataFrame(links, LINKS)
    tree = h.build_hierarchy(df, with_paths=True)
    levels = h.build_hierarchy(df, with_paths=True, doubling=False)  # one level a round
    assert sorted(levels.collect(), key=lambda r: r.node) == sorted(tree.collect(), key=lambda r: r.node)
    want = brute_hierarchy(links)
    for r in tree.collect():
        path = want[r.node]
        assert (r.cyclic, r.path) == (path is None, path), r.node
        assert path is None or (r.root, r.depth) == (path[0], len(path) - 1)
    counts = {r.node: r.n_descendants for r in h.descendant_counts(tree).collect()}
    for n in counts:
        assert counts[n] == sum(1 for m, p in want.items() if p and n in p and m != n)
    on = {r.node: r.on_circle for r in h.circles(df, tree).collect()}
    assert on == {"x1": True, "x2": True, "x3": True, "x4": False, "below": False, "self": True}
    hit = {r.node: (r.origin, r.distance) for r in cascade.tainted(df, spark.createDataFrame([("chain2",), ("chain5",), ("x1",), ("chain5",)], "node string")).collect()}
    withdrawn = ("chain2", "chain5", "x1")
    for n, path in want.items():
        above = [(m, k) for k, m in enumerate((path or [])[-2::-1], start=1) if m in withdrawn]
        assert hit.get(n) == (above[0] if above else None), n
    assert hit["chain3"] == ("chain2", 1) and hit["chain6"] == ("chain5", 1) and "chain2" not in hit and hit["chain5"] == ("chain2", 3)


def test_hierarchy_of_nothing(spark):
    assert h.build_hierarchy(spark.createDataFrame([], LINKS)).count() == 0


def test_parent_links_spellings_nulls_and_repeats(spark):
    hexa, hexb = "ab" * 32, "cd" * 32
    rows = [
        ("e1", "r", "sha256:" + hexa, None, "1", 7), ("e2", "r", hexb.upper(), f" SHA256:{hexa.upper()} ", "2", 7), ("e2", "r", hexb, hexa, "3", 8),
        ("e3", "other", None, hexa, "4", 7), ("e4", None, None, hexb, "5", 7), (None, "r", hexa, None, "6", 7), ("e5", "r", "bad", "", "7", None),
    ]
    df = spark.createDataFrame(rows, "event_id string, record_id string, hash string, prev_hash string, ingested_at string, node int")
    assert {r.node: r.parent for r in h.parent_links(df).collect()} == {"e1": None, "e2": "e1", "e3": None, "e4": None, "e5": None}


def test_priced_defaults(spark):
    df = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3)], "k string, n int")
    prices = spark.createDataFrame([("a", 1.0, None), ("std", 9.0, "x"), ("std", 9.5, "y"), ("a", 1.0, None)], "k string, price double, unit string")
    got = {r.n: (r.price, r.unit) for r in relations.priced(df, prices, "k", "std").collect()}
    assert got == {1: (1.0, None), 2: (9.0, "x"), 3: (9.0, "x")}
    without = relations.priced(df, prices.where("k = 'a'"), "k", "std").collect()  # no row of the default: nothing is lost
    assert {r.n: r.price for r in without} == {1: 1.0, 2: None, 3: None}
    assert relations.priced(df, prices.where("false"), "k", "std").count() == 3


def test_moderation_keeps_references_apart(spark):
    rules = (moderation.Rule("group", (r"(foo)",), "c", "low"), moderation.Rule("echo", (r"\b\w(\w)\1\w\b",), "c", "high"))
    df = spark.createDataFrame([(1, "noon"), (2, "foo"), (3, "none"), (4, None), (5, "NOON foo")], "doc_id int, text string")
    found = moderation.flags(df, rules)
    assert sorted((r.doc_id, r.rule) for r in found.collect()) == [(1, "echo"), (2, "group"), (5, "echo"), (5, "group")]
    want = {r.doc_id: (r.outcome, r.n_flags) for r in moderation.outcomes(df, found, "doc_id").collect()}
    assert {r.doc_id: (r.outcome, r.n_flags) for r in moderation.judge(df, rules).collect()} == want
    assert [r.name for r in moderation.merge(rules, rules[:1])] == ["group", "echo", "group"]
    with pytest.raises(ValueError):
        moderation.merge()


def test_fully_tainted(spark):
    members = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a"), ("s", "c")], "rec string, node string")
    found = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "node string, origin string, distance int")
    assert [r.rec for r in cascade.fully_tainted(members, found, "rec").collect()] == ["r"]


def test_fold_digest(spark):
    rows = [("r", 2, "b"), ("r", 1, "a"), ("r", 3, None), ("s", 1, "é"), (None, 1, "x"), ("t", 1, None)] + [("big", i, "y" * 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, p int, v string")
    got = {r.g: (r.n, r.byte_size, r.digest) for r in lineage.fold_digest(df, "g", "p", "v", after="\n").collect()}
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    big = "\n".join(["y" * 50] * 3000) + "\n"
    assert got == {"r": (2, 4, sha("a\nb\n")), "s": (1, 3, sha("é\n")), None: (1, 2, sha("x\n")), "big": (3000, len(big), sha(big))}
    assert lineage.fold_digest(df.where("false"), "g", "p", "v").count() == 0


def test_descriptors_and_events(spark):
    inputs = spark.createDataFrame([("r", 1, "sha256:aa")], "record_id string, position int, digest string")
    payload = spark.createDataFrame([("r", 1, "{}"), ("s", 1, "{}")], "record_id string, position int, line string")
    made = lineage.descriptors(inputs, payload, "record_id", "atoms", "1")
    faults = {r.record_id: r.f for r in made.select("record_id", lineage.descriptor_faults(F.col("output_path"), F.col("pipeline"), F.col("n_inputs")).alias("f")).collect()}
    assert faults == {"r": None, "s": "no_inputs"}
    assert made.select(lineage.descriptor_faults(F.lit("other/x"), F.col("pipeline"), F.lit(1)).alias("f")).first().f == "path"
    log = spark.createDataFrame([("e1", "r", "ab" * 32, 1), ("e2", "r", "SHA256:" + "CD" * 32, 2), ("e2", "r", "ef" * 32, 3)], "event_id string, record_id string, hash string, ingested_at int")
    events = {r.record_id: r for r in lineage.audit_descriptors(made, log, "2026-01-01T00:00:00Z").collect()}
    assert (events["r"].prev_hash, events["r"].audit_event_ref) == ("sha256:" + "cd" * 32, "audit/events.jsonl#L3")
    assert (events["s"].prev_hash, events["s"].audit_event_ref) == (None, "audit/events.jsonl#L1")
    body = {
        "actor_id": "pipelines.atoms", "actor_role": "system", "event_id": events["r"].event_id, "event_type": "derived_asset_emitted", "evidence_ref": "derived/atoms/r.jsonl.descriptor.json",
        "metadata": {"descriptor_path": "derived/atoms/r.jsonl.descriptor.json", "output_path": "derived/atoms/r.jsonl", "outputs_hash": events["r"].outputs_hash, "pipeline": "atoms", "pipeline_version": "1"},
        "prev_hash": "sha256:" + "cd" * 32, "reason": "derived asset emitted by pipeline atoms", "record_id": "r", "timestamp": "2026-01-01T00:00:00Z",
    }
    assert events["r"].hash == "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_timeline(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [("k", "a", t(0), "open"), ("k", "b", t(3), "close"), ("k", "c", t(20), "open"), ("k", "d", t(27), "close"), ("k", "e", t(29), "open"), (None, "f", t(0), "open"), ("k", "g", None, "open")]
    df = spark.createDataFrame(rows, "key string, id string, ts timestamp, kind string")
    got = timeline.dispute_windows(df, "key", "id", "ts", F.col("kind") == "open", F.col("kind") == "close", F.lit(t(31)))
    assert {r.id: r.status for r in got.collect()} == {"a": "cancelled", "c": "expired", "e": "open"}
    moved = timeline.changes(df.where("key is not null and ts is not null"), "key", ["ts"], "kind").collect()
    assert [(r.before, r.after) for r in sorted(moved, key=lambda r: r.ts)] == [(None, "open"), ("open", "close"), ("close", "open"), ("open", "close"), ("close", "open")]
    report = {r.kind: (r.n, r.n_failed, r.passed) for r in timeline.run_report(df.withColumn("ok", F.when(F.col("kind") == "open", True)), "kind", "ok").collect()}
    assert report == {"open": (5, 0, True), "close": (2, 2, False), None: (7, 2, False)}


def test_sentences(spark):
    df = spark.createDataFrame([(1, "One. Two!  Three\n\nFour 3.5 x?"), (2, "你好。好！"), (3, None), (4, " \n "), (5, "a" * 5000)], "id int, text string")
    got = {}
    for r in segments.sentence_atoms(df).collect():
        got.setdefault(r.id, []).append((r.sentence, r.text, r.is_cut))
    assert [x for _, x, _ in sorted(got[1])] == ["One.", "Two!", "Three", "Four 3.5 x?"] and [x for _, x, _ in sorted(got[2])] == ["你好。", "好！"]
    assert set(got) == {1, 2, 5} and len(got[5][0][1]) == 4096 and got[5][0][2]


def test_aliases_and_labels(spark):
    """The most frequent form is the label, the others are aliases in the order in which they were first seen."""
    rows = [("g", 0, 0, "ann", "ANN"), ("g", 0, 1, "ann", "Ann"), ("g", 1, 0, "ann", "aNN"), ("g", 2, 0, "ann", "Ann"), ("g", 3, 0, "bob", "Bob"), ("g", 4, 0, "bob", "BOB")]
    df = spark.createDataFrame(rows, "g string, u int, pos int, key string, label string")
    got = {r.key: (r.label, r.aliases) for r in graph.nodes(df, "g", ["u"]).collect()}
    assert got == {"ann": ("Ann", ["ANN", "aNN"]), "bob": ("Bob", ["BOB"])}
