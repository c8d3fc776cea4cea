"""Search, words, failures, secrets and personal data over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import views
from tracewright.detect import artifacts, pii, scan, tables
from tracewright.operators import failures, lexicon, search, turns
from tracewright.queries.conversations import _FRICTION as FRICTION
from tracewright.views import table, with_views


def _searched(spark, sf_dir, query):
    docs = table(spark, sf_dir, "documents")
    return search.search(search.index(docs, "doc_id", ("text",), query), query, *search.statistics(sizes=search.lengths(docs, "doc_id", ("text",))))


def search_words(spark, sf_dir):
    """Documents with both words, by BM25."""
    return _searched(spark, sf_dir, "license AND released").select("doc_id", "score")


def search_phrase(spark, sf_dir):
    return _searched(spark, sf_dir, '"general public license" NOT rights').select("doc_id", "score", "first")


def search_boolean(spark, sf_dir):
    return _searched(spark, sf_dir, "(licen* OR NEAR(public version, 4)) NOT apache").select("doc_id")


def search_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = _searched(spark, sf_dir, "mit")
    return hits.join(docs, "doc_id").select("doc_id", search.snippet(F.col("text"), F.col("first")).alias("snippet"))


def lexicon_terms(spark, sf_dir):
    return lexicon.nominate(lexicon.term_counts(views.messages(spark, sf_dir))).select("session_id", "term", "n", "rank", "distinct_terms", "total_words")


def _lexicon(spark, sf_dir):
    """A stand-in for judged terms: the tokens of the benchmark, negative where their length is even."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(lexicon.words("text")).alias("term")).distinct()
    return terms.select("term", F.when(F.length("term") % 2 == 0, "negative").otherwise("neutral").alias("polarity"), (F.length("term") / 10).alias("confidence"))


def turn_frustration(spark, sf_dir):
    muted = _lexicon(spark, sf_dir).where("length(term) = 4").select("term")
    found = lexicon.frustration(turns.turn_pairs(views.messages(spark, sf_dir)), _lexicon(spark, sf_dir), muted)
    return found.groupBy("session_id", "turn_idx").agg(F.count("*").alias("signals"), F.round(F.sum("weight"), 6).alias("weight"))


def unjudged_terms(spark, sf_dir):
    return lexicon.unjudged(lexicon.term_counts(views.messages(spark, sf_dir)), _lexicon(spark, sf_dir))


def enrichment_selection(spark, sf_dir):
    scored = turns.friction(turns.turn_pairs(views.messages(spark, sf_dir)))
    signals = scored.select("session_id", "turn_idx", (F.length("user_text") % 3 / 4).alias("weight"))
    return lexicon.select_for_enrichment(scored, signals).select("session_id", "turn_idx", "rank_score", "rank")


#: Error texts that stand in for those of failed events, by the event's number.
ERRORS = (
    "prompt tokens limit exceeded", "invalid tool input: x", "payment required", "401 unauthorized", "no endpoints found for m", "502 bad gateway", "stream closed", "could not find the exact text", "found 3 occurrences of the text", "blocked: by the hook",
    "validation failed for field", "unknown tool frobnicate", "secondary rate limit", "connection refused", "deadline exceeded", "make: *** no rule", "usage: tool [-x]", "exited with code 2", "(no output yet)", "x" * 2500 + " command not found",
    "429 too many requests", "bash: line 3: foo: command not found", "Permission denied (publickey)", "fatal: not a git repository 1234", "Traceback (most recent call last): x", "operation aborted", "something else went wrong", "ENOENT: no such file or directory, open '/tmp/a/b/c'", "request timed out after 30s", "",
)
COMMANDS = ("grep foo bar", "ls -la", "diff a b", "make all")


def failure_groups(spark, sf_dir):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    text, command = pick(ERRORS, F.col("event_id")), pick(COMMANDS, F.floor(F.col("event_id") / 10))
    both = F.when(F.col("event_id") % 2 == 0, failures.turn_failure(text)).otherwise(failures.tool_failure(text, command))
    found = rows.select((F.col("user_id") % 20).alias("session_id"), F.when(F.col("event_id") % 2 == 0, "turn").otherwise("tool").alias("axis"), F.lit("").alias("tool"), both.alias("failure"), text.alias("text"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("cost_usd"))
    return failures.groups(found).select("session_id", "axis", "class_id", "n_failures", "distinct_errors", F.round("cost_usd", 2).alias("cost_usd"), "priced", "confidence")


def _fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("message_id"), F.lit("content_text").alias("field"), "text")


def secret_findings(spark, sf_dir):
    return scan.gate(scan.scan(_fields(spark, sf_dir))).select("session_id", "message_id", "family", "rule_id", "severity", "confidence", "match_index", "match_length", "fingerprint", "redacted_preview", "gate")


def leak_report(spark, sf_dir):
    return scan.leak_report(scan.gate(scan.scan(_fields(spark, sf_dir))))


def session_leaks(spark, sf_dir):
    return scan.session_leaks(scan.gate(scan.scan(_fields(spark, sf_dir)))).drop("message_ids")


def pii_findings(spark, sf_dir):
    return pii.find_pii(_fields(spark, sf_dir))


def pii_emails(spark, sf_dir):
    """Addresses by document; no other recognizer starts before an address within it, so SQL can count them."""
    found = pii.find_pii(_fields(spark, sf_dir)).where("entity_type = 'EMAIL_ADDRESS' and not overlapped")
    return found.groupBy(F.col("message_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))


def pii_report(spark, sf_dir):
    return pii.pii_report(pii.find_pii(_fields(spark, sf_dir)))


def column_profiles(spark, sf_dir):
    return tables.profile_report(tables.column_profiles(_fields(spark, sf_dir)))


def artifact_secrets(spark, sf_dir):
    return artifacts.scan_artifacts(_fields(spark, sf_dir))


QUERIES = {f.__name__: f for f in (search_words, search_phrase, search_boolean, search_snippets, lexicon_terms, turn_frustration, unjudged_terms, enrichment_selection, failure_groups, secret_findings, leak_report, session_leaks, pii_findings, pii_emails, pii_report, column_profiles, artifact_secrets)}

_TOKENS = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok WHERE len(t) > 0)"""
_PART = "greatest(1e-6, ln((n - {df} + 0.5) / ({df} + 0.5))) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(t) / mean))"


def _case(table_: tuple, text: str) -> str:
    flags = lambda f: f"'{f}'" if f else "'c'"
    q = lambda p: p.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{q(p if 'm' in f else p.replace(chr(92) + '$', chr(0)).replace('$', chr(92) + 'z').replace(chr(0), chr(92) + '$'))}'{', ' + flags(f) if f else ''}) THEN '{c}'" for c, _, p, f in table_) + " END"


def _pick(values: tuple, by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({by}) % {len(values)} + 1]"


_WORDS = r"""list_filter(list_transform(regexp_extract_all(nfc_normalize(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{M}}\p{{N}}]+)*'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 32 AND NOT regexp_matches(x, '[0-9]'))"""
_TERMS = f"tc AS (SELECT session_id, term, count(*) AS n FROM (SELECT session_id, unnest({_WORDS.format('content_text')}) AS term FROM messages WHERE role IN ('user', 'custom_message')) GROUP BY 1, 2)"
_LEXICON = f"lx AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS term FROM benchmark)"
_CAPS = r"(length({0}) > 1 AND {0} = upper({0}) AND {0} <> lower({0}))"

ORACLE_SQL = {
    # the shared conversations and benchmark hold prose alone, so words need no stripping of code, paths and addresses
    "lexicon_terms": with_views(f"""{_TERMS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, term)::INT AS rank, count(*) OVER (PARTITION BY session_id) AS distinct_terms, sum(n) OVER (PARTITION BY session_id)::BIGINT AS total_words FROM tc) WHERE rank <= 2000""", "messages"),
    "unjudged_terms": with_views(f"{_TERMS}, {_LEXICON} SELECT term, sum(n)::BIGINT AS n, count(*) AS sessions FROM tc WHERE term NOT IN (SELECT term FROM lx) GROUP BY 1", "messages"),
    "turn_frustration": with_views(
        rf"""{FRICTION}, {_LEXICON}, us AS (SELECT term FROM lx WHERE length(term) % 2 = 0 AND length(term) / 10 >= 0.5 AND length(term) <> 4),
ht AS (SELECT session_id, turn_idx, 0.5 AS weight FROM (SELECT session_id, turn_idx, unnest(list_distinct({_WORDS.format("user_text")})) AS term FROM fr) WHERE term IN (SELECT term FROM us)),
cw AS (SELECT session_id, turn_idx, user_text AS t, regexp_extract_all(user_text, '[\p{{L}}\p{{M}}'']+') AS w FROM fr),
mk AS (SELECT session_id, turn_idx, 0.3 AS weight FROM cw WHERE regexp_matches(t, '\p{{Lu}}{{3,}}[^\p{{L}}]*[?!]') OR len(list_filter(range(1, len(w)), lambda i: {_CAPS.format("w[i]")} AND {_CAPS.format("w[i + 1]")} AND greatest(length(w[i]), length(w[i + 1])) >= 5)) > 0
  UNION ALL SELECT session_id, turn_idx, 0.3 FROM cw WHERE regexp_matches(t, '[?!]{{2,}}')
  UNION ALL SELECT session_id, turn_idx, 0.3 FROM cw WHERE len(list_filter(range(1, length(t) - 1), lambda i: t[i] = t[i + 1] AND t[i] = t[i + 2] AND regexp_matches(t[i], '\p{{L}}'))) > 0)
SELECT session_id, turn_idx, count(*) AS signals, round(sum(weight), 6)::DOUBLE AS weight FROM (SELECT * FROM ht UNION ALL SELECT * FROM mk) GROUP BY 1, 2""",
        "messages",
    ),
    "enrichment_selection": with_views(
        f"""{FRICTION}, s AS (SELECT *, round(friction_score + length(user_text) % 3 / 4, 6)::DOUBLE AS rank_score FROM fr),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank_score DESC, turn_idx) AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM s) SELECT session_id, turn_idx, rank_score, rank::INT AS rank FROM k WHERE rank <= least(40, greatest(1, round(0.2 * n)))""",
        "messages",
    ),
    "search_words": f"""WITH {_TOKENS}, c AS (SELECT *, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'released')) AS b FROM tok), f AS (SELECT count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(-({_PART.format(df="da", tf="a")} + {_PART.format(df="db", tf="b")}), 6) AS score FROM c, st, f WHERE a > 0 AND b > 0""",
    "search_phrase": f"""WITH {_TOKENS}, c AS (SELECT *, list_filter(range(len(t)), lambda k: t[k + 1] = 'general' AND t[k + 2] = 'public' AND t[k + 3] = 'license') AS p FROM tok), f AS (SELECT count(*) FILTER (len(p) > 0) AS d FROM c)
SELECT doc_id, round(-({_PART.format(df="d", tf="len(p)")}), 6) AS score, p[1]::INT AS first FROM c, st, f WHERE len(p) > 0 AND NOT list_contains(t, 'rights')""",
    "search_snippets": r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+') AS p, list_position(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)), 'mit') - 1 AS first FROM documents),
s AS (SELECT *, greatest(0, first - 8) AS start FROM c WHERE first >= 0),
m AS (SELECT *, array_to_string(list_transform(list_slice(p, start + 1, start + 16), lambda x, k: CASE WHEN k - 1 + start = first THEN regexp_replace(x, '([\p{L}\p{N}]+)$', '⟦\1⟧') ELSE x END), '') AS body FROM s)
SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE '' END || regexp_replace(body, '^[^\p{L}\p{N}⟦]+', '') || CASE WHEN start + 16 < len(p) THEN '…' ELSE '' END AS snippet FROM m""",
    "search_boolean": f"""WITH {_TOKENS}, c AS (SELECT *, list_filter(range(len(t)), lambda k: t[k + 1] = 'public') AS p, list_filter(range(len(t)), lambda k: t[k + 1] = 'version') AS v FROM tok)
SELECT doc_id FROM c WHERE (len(list_filter(t, lambda x: starts_with(x, 'licen'))) > 0 OR len(list_filter(p, lambda a: len(list_filter(v, lambda b: abs(a - b) <= 5)) > 0)) > 0) AND NOT list_contains(t, 'apache')""",
    "failure_groups": f"""WITH e AS (SELECT user_id % 20 AS session_id, CASE WHEN event_id % 2 = 0 THEN 'turn' ELSE 'tool' END AS axis, {_pick(ERRORS, "event_id")} AS text, {_pick(COMMANDS, "event_id // 10")} AS command, CASE WHEN event_id % 3 = 0 THEN value END AS cost_usd FROM events WHERE event_type = 'error'),
c AS (SELECT *, coalesce(CASE WHEN axis = 'turn' THEN {_case(failures.TURN, "text")} ELSE coalesce({_case(failures.TOOL, "text")}, {_case(failures.COMMAND, "command")}) END, 'unclassified') AS class_id FROM e),
g AS (SELECT session_id, axis, class_id, count(*) AS n_failures, count(DISTINCT text)::INT AS distinct_errors, round(sum(cost_usd), 2) AS cost_usd, count(cost_usd) AS priced FROM c GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_failures >= 3 AND class_id NOT IN ('aborted', 'pending-background-task', 'unclassified') THEN round(least(0.9, 0.6 + 0.05 * (n_failures - 3)), 6)::DOUBLE END AS confidence FROM g""",
    "pii_emails": r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b')) FROM documents) GROUP BY 1""",
}
