"""Scanner results against plain regular-expression code on small fixtures."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from pagelattice.functions import fixed, text as tx
from pagelattice.operators import reports, scan


def made_up(seed):
    """Strings of the credential shapes, made at test time."""
    rng = random.Random(seed)
    upper = "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))
    lower = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    return [
        "AK" + "IA" + upper, "AI" + "za" + lower[:35], "xo" + "xp-" + lower[:11], "-----BEGIN " + "EC PRIVATE KEY-----",
        "Api" + "_Key=" + lower, "TOK" + "EN '" + lower[:22],
    ]


def noisy_texts(n):
    rng = random.Random(5)
    pool = ["é", " ", "\n", "word", "x@y.org", "a@b", "café@ex-ample.co.uk", "i@2x.png", "A", "AKIA", "xox", "token=", "…"]
    texts = []
    for i in range(n):
        parts = [rng.choice(pool + made_up(i)) for _ in range(rng.randint(0, 40))]
        texts.append("".join(p + rng.choice(["", " ", ";"]) for p in parts))
    return texts


def expected_secrets(text):
    found = []
    for name, pattern in fixed.SECRET_PATTERNS.items():
        matches = list(re.finditer(pattern, text))
        masked = list(text)
        for m in matches:
            masked[m.start() : m.end()] = "*" * (m.end() - m.start())
        masked = "".join(masked)
        for m in matches:
            value = m.group(0)
            redacted = value[:5] + "..." + value[-3:]
            around = masked[max(0, m.start() - 20) : m.start()] + redacted + masked[m.end() : m.end() + 20]
            found.append((name, redacted, hashlib.sha256(value.encode()).hexdigest(), m.start(), around.strip()))
    return sorted(found)


def frame(spark, texts, kind="text/plain"):
    return spark.createDataFrame([(str(i), t, kind) for i, t in enumerate(texts)], "source string, text string, content_type string")


def test_secrets_agree_with_finditer(spark):
    texts = noisy_texts(300)
    rows = scan.scan_secrets(frame(spark, texts)).collect()
    for i, text in enumerate(texts):
        got = sorted((r.type, r.value, r.value_sha256, r.start, r.snippet) for r in rows if r.source == str(i))
        assert got == expected_secrets(text), text


def test_no_whole_secret_in_any_output_column(spark):
    secrets = made_up(1)
    rows = scan.all_findings(frame(spark, [f"x {s} y {s}" for s in secrets])).collect()
    assert rows
    for row in rows:
        for secret in secrets:
            if row.kind == "secret":
                assert secret not in (row.value or "") and secret not in (row.snippet or "")


def test_text_with_very_many_matches(spark):
    one = made_up(2)[0]
    text = ("é " + one) * 3000
    rows = scan.scan_secrets(frame(spark, [text])).where("type = 'aws_key'").select("start").collect()
    assert sorted(r.start for r in rows) == [2 + i * (len(one) + 2) for i in range(3000)]


def test_emails_agree_with_findall(spark):
    texts = noisy_texts(300) + ["a@b.com_x@c.org", "x" * 5000 + "@", "a@a@a.bc", ".@-.aa", "me@pic.PNG.com", "%+@x.yz!"]
    rows = scan.scan_emails(frame(spark, texts)).collect()
    for i, text in enumerate(texts):
        expected = {e for e in re.findall(fixed.EMAIL_PATTERN, text) if not any(n in e.lower() for n in fixed.EMAIL_NOISE)}
        got = [r.value for r in rows if r.source == str(i)]
        assert sorted(got) == sorted(expected), text


def test_comments(spark):
    html = "<!-- a --><!--  long enough\n --><!----><!--abcd--> <!-- open"
    got = scan.scan_html_comments(frame(spark, [html], "text/html")).collect()
    assert [r.value for r in got] == ["long enough", "abcd"]
    code = "x // see http://a.b/c\r\n// tiny\n/* Copyright x */ /* block\n note */ //# sourceMappingURL=x\n/*" + "z" * 250 + "*/"
    got = [r.value for r in scan.scan_js_css_comments(frame(spark, [code], "application/javascript")).collect()]
    line = [c.strip() for c in re.findall(r"//(.*?)\n", code)]
    block = [c.strip() for c in re.findall(r"/\*(.*?)\*/", code, re.DOTALL)]
    kept = [c for c in line + block if len(c) > 5 and not any(n in c.lower() for n in fixed.COMMENT_NOISE)]
    assert got == [c[:200] + ("..." if len(c) > 200 else "") for c in kept]
    assert scan.scan_js_css_comments(frame(spark, [code], "text/plain")).count() == 0


def test_one_pass_equals_separate_scans(spark):
    texts = noisy_texts(60) + ["<!-- note to self --> // remark here\n"]
    for kind in ["text/html", "text/css", "text/plain"]:
        captures = frame(spark, texts, kind)
        together = scan.all_findings(captures)
        apart = scan.scan_secrets(captures).unionByName(scan.scan_emails(captures))
        if "html" in kind:
            apart = apart.unionByName(scan.scan_html_comments(captures))
        if "css" in kind:
            apart = apart.unionByName(scan.scan_js_css_comments(captures))
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(together) == key(apart)


def test_decode_body(spark):
    bodies = [b"", None, b"plain", "é…".encode(), b"a\xffb\xc3", b"\xe2\x82"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body binary")
    got = {r.i: r.text for r in scan.decode_captures(rows).collect()}
    assert got == {i: b.decode("utf-8", "ignore") for i, b in enumerate(bodies) if b}


def test_running_totals_cross_blocks(column):
    for n in [0, 1, 255, 256, 257, 1000]:
        numbers = [(i * 7) % 11 for i in range(n)]
        totals, acc = [], 0
        for x in numbers:
            acc += x
            totals.append(acc)
        assert column("a array<int>", [(numbers,)], tx.running_totals(F.col("a"))) == [totals]


def test_redact_and_strip(column):
    assert column("s string", [("abcdefghij",), ("ab",), ("",)], tx.redact(F.col("s"))) == ["abcde...hij", "ab...ab", "..."]
    padded = "   x y\t\r\n"
    assert column("s string", [(padded,)], tx.strip_text(F.col("s"))) == [padded.strip()]


def test_summaries(spark):
    texts = ["a@b.org a@b.org c@d.org", "a@b.org"] + made_up(3)[:1]
    found = scan.all_findings(frame(spark, texts))
    assert reports.findings_summary(found).collect()[0].asDict() == {"secrets": 1, "emails": 2, "comments": 0}
    assert [r.email for r in reports.sorted_emails(found).collect()] == ["a@b.org", "c@d.org"]
    by_site = {(r.kind, r.type): r.n for r in reports.findings_by_site(found).collect()}
    assert by_site == {("email", "email"): 2, ("secret", "aws_key"): 1}


def test_top_comments_ties(spark):
    rows = [("comment", "HTML", v, None, None, None, s) for v, s in [("bbbb", "2"), ("aaaa", "2"), ("cccc", "1"), ("long one", "9")]]
    found = spark.createDataFrame(rows, "kind string, type string, value string, value_sha256 string, start int, snippet string, source string")
    assert [r.content for r in reports.top_comments(found, 3).collect()] == ["long one", "cccc", "aaaa"]
