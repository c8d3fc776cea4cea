"""Every query that SQL can express gives the rows that SQL gives; the others those of plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from oracle import compare, connect

from tracewright import queries
from tracewright.detect import artifacts, pii, scan, tables
from tracewright.detect.filters import excluded

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    compare(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLE_SQL[name])


# --- what SQL cannot say, against plain Python over the same texts ---


FAKE = "a1B2" * 30
PLANTED = (
    "key AKIA" + "A1" * 8 + " and ghp_" + FAKE[:36] + "\npassword = hunter2hunter2\ntoken: $HOME",
    "discord_token = '" + "ab12" * 16 + "'\nx = \"" + "0f9a3c7d5e1b8264" * 2 + "\"\nuser_id = k9Jd72hSaa",
    "-----BEGIN RSA PRIVATE KEY-----\nfigd_" + FAKE[:32] + "\nsk_live_" + FAKE[:24],
    "password = 'pass%dword'\n" * 3 + "".join(f"password = s3cret{k:04d}x\n" for k in range(60)),
    "ssn 666-45-6789 and 123-45-6789, card 4111 1111 1111 1111, bo@example.org, GB82 WEST 1234 5698 7654 32, 10.1.2.3 8.8.8.8, 48.8566, 2.3522, call +1 415 555 2671",
    "customer_email,x,phone\na@b.org,c@d.org,no\ne@f.org,g@h.org,\n",
    "| n | mail |\n|---|---|\n| x | y@z.org |\n| z | w@v.org |",
    "ENV API_KEY=ab12CD34ef56\nexport DB_PASSWORD='s3cr3t-Value'\nTOKEN=${TOKEN}\n  - SECRET=xxxx\nPATH=/usr/bin\n",
)


@pytest.fixture(scope="module")
def folder(con, tmp_path_factory):
    """The documents and some that hold secrets, personal data, tables and build files."""
    at = tmp_path_factory.mktemp("planted")
    con.execute("create table planted as select * from documents")
    for k, text in enumerate(PLANTED):
        con.execute("insert into planted values (?, ?, 'en', ?, ?)", [1_000_000 + k, text, f"planted{k % 3}", len(text)])
    con.execute(f"copy planted to '{at}/documents.parquet' (format parquet)")
    return str(at)


@pytest.fixture(scope="module")
def documents(con, folder):
    return con.execute("select source, doc_id::varchar, text from planted where text is not null and text <> ''").fetchall()


def python_secrets(documents):
    """(session, message, family, rule, severity, index, length, fingerprint, gate): every rule over every text, without the literals that spare the operator most of them."""
    rules = [(r, re.compile(r.pattern, re.ASCII)) for r in scan.catalogue()]
    out = []
    for session, message, text in documents:
        kept = Counter()
        found = []
        for r, pattern in rules:
            for m in pattern.finditer(text):
                group = 1 if pattern.groups and m[1] is not None else 0
                found.append((m.start(group), r.id, r, m[group]))
        for at, _, r, secret in sorted(found, key=lambda x: x[:2]):
            gate = "filtered" if r.family == "detect-secrets" and excluded(r.id, secret, text, at) else None
            if gate is None:
                kept[r.family] += 1
                gate = "capped" if kept[r.family] > 50 else None
            out.append((session, message, r.family, r.id, r.severity, at, len(secret), hashlib.sha256(secret.encode()).hexdigest()[:16], gate))
    return out


def test_secrets(spark, folder, documents):
    want = python_secrets(documents)
    got = queries.QUERIES["secret_findings"](spark, folder).collect()
    assert Counter((r.session_id, r.message_id, r.family, r.rule_id, r.severity, r.match_index, r.match_length, r.fingerprint, r.gate) for r in got) == Counter(want) and len(want) > 60 and {w[8] for w in want} == {None, "filtered", "capped"}
    kept = [w for w in want if w[8] is None]
    sessions = {(s, f): sum(k[0] == s and k[2] == f for k in kept) for s, f in {(w[0], w[2]) for w in want}}
    got = queries.QUERIES["session_leaks"](spark, folder).collect()
    assert {(r.session_id, r.family): r.leak_count for r in got} == sessions
    assert {(r.session_id, r.family): r.filtered for r in got} == {k: sum(w[0] == k[0] and w[2] == k[1] and w[8] == "filtered" for w in want) for k in sessions}
    high = [w for w in kept if w[4] in ("high", "critical")]
    report = {(f, r, s): (len(ws := [w for w in high if w[2:5] == (f, r, s)]), len({w[7] for w in ws}), len({w[0] for w in ws})) for f, r, s in {w[2:5] for w in high}}
    assert {(r.family, r.rule_id, r.severity): (r.findings, r.secrets, r.sessions) for r in queries.QUERIES["leak_report"](spark, folder).collect()} == report


def python_pii(documents):
    """(session, message, entity, index, length, overlapped) straight from the rules: candidates by place, longer first; what starts inside a taken one is covered; of the taken ones those below the floor aren't told."""
    out = []
    for session, message, text in documents:
        found = []
        for r in pii.RECOGNIZERS:
            for p in r.patterns:
                for m in re.compile(p, re.ASCII).finditer(text):
                    verdict = pii.judge(r, m[0])
                    if verdict:
                        found.append((m.start(), -len(m[0]), r.id, r.entity, verdict[0]))
        taken = []
        for start, size, _, entity, score in sorted(found):
            covered = any(a <= start < b for a, b in taken)
            if not covered:
                taken.append((start, start - size))
            if covered or score >= 0.3:
                out.append((session, message, entity, start, -size, covered))
    return out


def test_pii(spark, folder, documents):
    want = python_pii(documents)
    got = queries.QUERIES["pii_findings"](spark, folder).collect()
    assert Counter((r.session_id, r.message_id, r.entity_type, r.match_index, r.match_length, r.overlapped) for r in got) == Counter(want) and len(want) > 5
    report = Counter((w[0], w[2]) for w in want if not w[5])
    assert {(r.session_id, r.entity_type): r.n for r in queries.QUERIES["pii_report"](spark, folder).collect() if r.n} == dict(report)


def test_tables_and_artifacts(spark, folder, documents):
    verdicts = Counter((v, label, entity or "") for _, _, text in documents for t in tables.fragments(text) for _, label, entity, _, _, v in tables.profile(t))
    assert {(r.verdict, r.label, r.entity_type or ""): r.columns for r in queries.QUERIES["column_profiles"](spark, folder).collect()} == dict(verdicts)
    secrets = Counter((m, kind, line, name) for _, m, text in documents for kind, line, name, value in artifacts.extract(text) if artifacts.judged(name, value))
    assert Counter((r.message_id, r.kind, r.line, r.name) for r in queries.QUERIES["artifact_secrets"](spark, folder).collect()) == secrets and len(secrets) >= 2 and len(verdicts) >= 3


def test_every_query_is_compared():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"secret_findings", "session_leaks", "leak_report", "pii_findings", "pii_report", "column_profiles", "artifact_secrets"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
