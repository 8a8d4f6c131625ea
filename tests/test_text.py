"""Text functions against Python's own regular expressions."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from archivolt.functions import text as tx
from archivolt.plans import pipelines

CASES = [
    "", "plain words only", "mail me: a.b+c@example.org, or b@x.co.uk!", "http://user:pw@host/path?q=1 next", "card 4111 1111 1111 1111 end",
    "id 11010519491231002X.", "13912345678 and +86 139 1234 5678", "ip 10.0.0.255 not 300.1.1.1", "date 2024-01-15 10:00", "é@example.com josé@exämple.com",
    "tel (020) 7946-0018 / 555", "x13912345678901234y", "emoji 😀 a@b.cd 😀 13800138000", "a@b a@b.c a@b.cc", "ftp+x://u:p@h", "1234567", "12345678",
]


def python_redact(text):
    rules = [(n, re.compile(p), m) for n, p, m in tx.REDACTION_RULES]
    out, spans, at, size = [], [], 0, 0
    while True:
        found = [(m.start(), i, m) for i, (_, r, _) in enumerate(rules) if (m := r.search(text, at))]
        if not found:
            return "".join([*out, text[at:]]), spans
        start, i, m = min(found, key=lambda f: f[:2])
        out += [text[at:start], rules[i][2]]
        size += start - at
        spans.append((rules[i][0], size, size + len(rules[i][2])))
        size += len(rules[i][2])
        at = m.end()


def random_texts(n=300):
    rng = random.Random(5)
    parts = ["a@b.cc", " ", "1", "23", "-", ".", "139", "12345678", "http://u:p@h", "x", "é", "(", ")", "+", "10.0.0.1", "\n", "X", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_redaction_equals_the_sequential_search(spark):
    texts = CASES + random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in pipelines.text(df, mode="redact").collect()}
    for i, t in enumerate(texts):
        want, spans = python_redact(t)
        assert rows[i].text == want, t
        assert [(s["kind"], s["start"], s["end"]) for s in rows[i].spans] == spans, t
        assert all(rows[i].text[s["start"] : s["end"]] == s["replacement"] for s in rows[i].spans)
    one = df.select("doc_id", tx.redact(F.col("text")).alias("t")).collect()
    assert all(r.t == rows[r.doc_id].text for r in one)


def test_redaction_of_null(spark):
    df = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert pipelines.text(df).collect()[0].text is None


def test_normalise(spark):
    def want(t):
        t = unicodedata.normalize("NFKC", t)
        t = re.sub("[\u200b-\u200d\ufeff]", "", t).replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub("[ \t\u00a0\u2000-\u200a\u202f\u205f\u3000]+", " ", t)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip()

    texts = ["ＡＢＣ\u3000x", "a\r\nb\rc \n\n\n\nd ", "\ufeffz\u200bz", " \t\u00a0 ", "ﬁn e\u0301", "tab\t\tx  \n y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalise(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.n == want(r.t)


def test_small_functions(spark):
    row = spark.createDataFrame([(["a=1", "b", "a=2=3", "c="],)], "kv array<string>").select(
        tx.key_values(F.col("kv")).alias("m"),
        tx.slug(F.lit("Some_Name X")).alias("slug"),
        tx.uri_parts(F.lit("s3://b/k/x")).alias("uri"),
        tx.uri_parts(F.lit("b/k")).alias("no_uri"),
        tx.audit_line(F.lit("audit/events.jsonl#L12")).alias("line"),
        tx.audit_line(F.lit("audit/events.jsonl#L0")).alias("no_line"),
        F.array(*[tx.safe_member(F.lit(p)) for p in ("a/b", "/a", "a//b", "a/../b", "a\\b", "")]).alias("safe"),
        tx.stem(F.lit("x/y.clean.txt")).alias("stem"),
        tx.html_escape(F.lit("<a & 'b'>")).alias("html"),
        tx.with_final_newline(F.lit("x")).alias("line_end"),
    ).collect()[0]
    assert row.m == {"a": "2=3", "c": ""}
    assert (row.slug, row.uri.bucket, row.no_uri, row.line, row.no_line) == ("some-name-x", "b", None, 12, None)
    assert row.safe == [True, False, False, False, False, False]
    assert (row.stem, row.html, row.line_end) == ("y", "&lt;a &amp; &#x27;b&#x27;&gt;", "x\n")
