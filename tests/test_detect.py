import re

import pytest

from tracewright.detect import artifacts, filters, pii, scan, tables

FAKE = "a1B2" * 30


def secrets(text):
    return {r.id for r, _, _ in scan.candidates(text)}


def test_catalogue_is_whole():
    rules = scan.catalogue()
    count = lambda family: sum(r.family == family for r in rules)
    assert (count("secret-leak"), count("gitleaks"), count("nosey-parker"), count("detect-secrets"), count("trufflehog")) == (19, 109, 61, 4, 4)
    assert {r.severity for r in rules} <= set(scan.SEVERITIES) and {r.confidence for r in rules} <= set(scan.CONFIDENCES)


@pytest.mark.parametrize("text, rule", [
    ("key AKIA" + "A1" * 8, "aws_access_key_id"), ("ghp_" + FAKE[:36], "github_pat_classic"), ("-----BEGIN RSA PRIVATE KEY-----", "private_key_block"), ("sk_live_" + FAKE[:24], "stripe_live_secret_key"),
    ("discord_token = '" + "ab12" * 16 + "'", "discord-api-token"), ("telegram: 12345678:A" + FAKE[:34] + " ", "telegram-bot-api-token"), ("figd_" + FAKE[:32], "figma-pat-figd"), ("password = hunter2hunter2", "keyword-assignment"),
])
def test_finds(text, rule):
    assert rule in secrets("see " + text + "\n")


def test_prefilter_loses_nothing():
    texts = ["key AKIA" + "A1" * 8, "discord_token = '" + "ab12" * 16 + "'", 'x = "' + "ab12" * 10 + '"', "password: 'abcdefgh1'", "twilio SK" + "0" * 32, "$2a$10$" + "a" * 53, "00D" + "a" * 12 + "!" + "b" * 96]
    for text in texts:
        whole = {r.id for r in scan.catalogue() if re.compile(r.pattern, re.ASCII).search(text)}
        assert whole == secrets(text), text


def test_preview_never_shows_the_middle():
    assert scan.preview("abcdefghijklmnop") == "abcd…" and scan.preview("short") == "…"


@pytest.mark.parametrize("value, text, why", [
    ("{secret}", "x = {secret}", "templated-secret"), ("$TOKEN", "x = $TOKEN", "dollar-prefix"), ("12345678", "x = 12345678", "not-alphanumeric"), ("ABCDEFGH", "x = ABCDEFGH", "sequential-string"),
    ("changeme", "x = changeme", "placeholder-value"), ("aaaaaaaa", "x = aaaaaaaa", "placeholder-value"), ("k9Jd72hS", "user_id = k9Jd72hS", "likely-id-string"), ("get_secret(a)", "x = get_secret(a)", "indirect-reference"),
    ("k9Jd72hS", "see https://api.example.com/?k=k9Jd72hS", "documentation-url"), ("k9Jd72hS", "x = k9Jd72hS # example", "code-sample-context"), ("k9Jd72hS", "```sample\nx = k9Jd72hS\n```\n", "code-sample-context"), ("k9Jd72hS", "x = k9Jd72hS", None),
])
def test_filters(value, text, why):
    assert filters.excluded("keyword-assignment", value, text, text.index(value)) == why


def test_low_entropy():
    assert filters.excluded("hex-high-entropy-string", "abababababababab", "'abababababababab'", 1) == "low-entropy"
    assert filters.excluded("hex-high-entropy-string", "0f9a3c7d5e1b8264", "'0f9a3c7d5e1b8264'", 1) is None


def found(text):
    return [(r.entity, value, score, over) for _, value, r, score, _, over in pii.chosen(text)]


@pytest.mark.parametrize("text, entity", [("a@b.org", "EMAIL_ADDRESS"), ("call +1 415 555 2671", "PHONE_NUMBER"), ("at 8.8.8.8 now", "IP_ADDRESS"), ("card 4111 1111 1111 1111", "CREDIT_CARD"), ("GB82 WEST 1234 5698 7654 32", "IBAN_CODE"), ("ssn 123-45-6789", "US_SSN"), ("48.8566, 2.3522", "COORDINATES")])
def test_pii(text, entity):
    assert entity in {e for e, *_ in found(text)}


def test_pii_checks():
    assert not [e for e in found("card 4111 1111 1111 1112") if e[0] == "CREDIT_CARD"]
    assert found("10.1.2.3") == [] and pii.judge(pii.RECOGNIZERS[2], "10.1.2.3") == (0.1, "low")
    assert pii.judge(pii.RECOGNIZERS[5], "666-45-6789") == (0.2, "high") and pii.judge(pii.RECOGNIZERS[5], "666-45-6789", validate=False) == (0.9, "high")
    assert not [e for e in found("95.0, 181.5") if e[0] == "COORDINATES"]


def test_tables():
    kinds = lambda t: [(f.kind, f.header, len(f.rows)) for f in tables.fragments(t)]
    assert kinds('[{"a": 1, "b": null}, {"a": 2}]') == [("json", ["a", "b"], 2)]
    assert kinds("| n | m |\n|---|---|\n| x | y |\n| z | w |") == [("ruled", ["n", "m"], 2)]
    assert kinds("n,m\nx,y\nz,w\n") == [("csv", ["n", "m"], 2)] and kinds("name   mail\nbo     b@c.org\nal     a@c.org") == [("aligned", ["name", "mail"], 2)]
    assert kinds("just prose, with commas\nand lines") == []
    verdicts = {c: v for f in tables.fragments("customer_email,x,phone\na@b.org,c@d.org,no\ne@f.org,g@h.org,\n") for c, *_, v in tables.profile(f)}
    assert verdicts == {"customer_email": "confirmed", "x": "values-only", "phone": "label-only"}


def test_artifacts():
    kinds = {n: (k, artifacts.judged(n, v)) for k, _, n, v in artifacts.extract("ENV API_KEY=ab12CD34ef56\nexport DB_PASSWORD='s3cr3t-Value'\nTOKEN=${TOKEN}\n  - SECRET=xxxx\nPATH=/usr/bin\n")}
    assert kinds["API_KEY"] == ("containerfile", ("structure", "named-secret")) and kinds["DB_PASSWORD"][0] == "shell-export" and kinds["DB_PASSWORD"][1] is not None
    assert kinds["TOKEN"][1] is None and kinds["SECRET"] == ("compose-env", None) and kinds["PATH"][1] is None


def test_gates(spark):
    text = "password = hunter2hunter2\n" * 3 + "ghp_" + FAKE[:36]
    fields = spark.createDataFrame([("s", "m", "content_text", text), ("s", "n", "content_text", None)], "session_id string, message_id string, field string, text string")
    found = scan.scan(fields)
    gates = {(r.rule_id, r.match_index): r.gate for r in scan.gate(found, scan.Gates(cap=2, floor="high")).collect()}
    assert sorted(str(v) for k, v in gates.items() if k[0] == "keyword-assignment") == ["None", "None", "capped"] and gates[("github_pat_classic", 78)] is None
    assert {r.gate for r in scan.gate(found, scan.Gates(disabled=("keyword-assignment",))).where("family = 'detect-secrets'").collect()} == {"disabled"}
    mark = scan.fingerprint("hunter2hunter2")
    assert {r.gate for r in scan.gate(found, scan.Gates(allow=(mark,))).where("family = 'detect-secrets'").collect()} == {"allowlisted"}
    assert scan.listed(scan.gate(found), 1).first().omitted == 3


def test_a_low_hit_still_covers_what_it_overlaps():
    # an invalid number of this shape scores below the floor, but what starts inside it is covered by it
    text = "666-45-6789"
    hits = list(pii.chosen(text))
    assert all(over for *_, over in hits) and "US_SSN" not in {r.entity for _, _, r, _, _, over in hits if not over}
    mark = scan.fingerprint(text)
    assert [r.entity for _, _, r, _, _, over in pii.chosen(text, deny=frozenset([mark])) if not over] == ["US_SSN"]


def test_fences():
    text = "a\n```demo\nx\n```\nb\n~~~\ny\n~~~\n"
    assert [filters.fence_around(text, text.index(c)) for c in "axby"] == [None, "demo", None, ""]
    assert filters.documentation("https://user@api.example.com:80/x") and filters.documentation("//localhost/") and not filters.documentation("https://notexample.com/") and not filters.documentation("https://[bad")


def test_best_class_of_a_column(spark):
    text = "customer_email,x\na@b.org,c@d.org\ne@f.org,g@h.org\n\nsome prose\n\ncustomer_email,x\nno,1\nnope,2\n"
    fields = spark.createDataFrame([("s", "m", "content_text", text)], "session_id string, message_id string, field string, text string")
    best = {r.column: (r.verdict, r.score) for r in tables.best_classes(tables.column_profiles(fields)).collect()}
    assert best["customer_email"][0] == "confirmed" and best["x"][0] == "values-only"
