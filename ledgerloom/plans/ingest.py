"""Registered queries of import and parsing, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.views import MESSAGES, messages, table
from ledgerloom.sources.eml import import_errors, import_report, parse_eml, write_eml


def _eml(s, d):  # noqa: ANN001, ANN202
    m = messages(s, d)
    return m.select("email_id", write_eml(F.col("message_id"), F.concat(F.lit("n"), "email_id"), F.concat("sender", F.lit("@example.com")), F.concat("recipient", F.lit("@example.com, b@example.com")), F.col("body")).alias("eml"))


def _imported(s, d, *fields):  # noqa: ANN001, ANN002, ANN202
    return _eml(s, d).select("email_id", parse_eml(F.col("eml"), *fields).alias("m")).select("email_id", "m.*")


def _faulty(s, d, *fields):  # noqa: ANN001, ANN002, ANN202
    """The same messages, some of them empty files or without a header."""
    eml = F.when(F.col("email_id") % 11 == 3, F.lit("").cast("binary")).when(F.col("email_id") % 13 == 5, F.lit("no header at all").cast("binary")).otherwise(F.col("eml"))
    return _eml(s, d).select(F.concat(F.lit("m"), "email_id", F.lit(".eml")).alias("file"), parse_eml(eml, *fields).alias("m")).select("file", "m.*")


QUERIES = {
    "src8_eml_import": lambda s, d: (
        _imported(s, d, "message_id", "subject", "sender", "recipients", "text_body", "ok")
        .select("email_id", "message_id", "subject", "sender", "recipients", "ok", F.sha2(F.rtrim(F.regexp_replace("text_body", r"\s+", " ")), 256).alias("body_hash"))
    ),
    "src10_import_report": lambda s, d: import_report(_faulty(s, d, "ok")),
    "src10_import_errors": lambda s, d: import_errors(_faulty(s, d, "ok", "error")),
    "fn18_recipients": lambda s, d: _imported(s, d, "recipients").select("email_id", "recipients"),
    "src_events_by_hour": lambda s, d: (
        table(s, d, "events")
        .groupBy(F.date_trunc("hour", F.col("ts")).alias("hour"), "event_type")
        .agg(F.count("*").alias("n"))
    ),
}

_M = f"WITH {MESSAGES}"
ORACLE_SQL = {
    "src8_eml_import": f"""{_M} SELECT email_id, '<' || message_id || '>' AS message_id, 'n' || email_id AS subject, sender || '@example.com' AS sender,
recipient || '@example.com; b@example.com' AS recipients, true AS ok, sha256(rtrim(regexp_replace(body, '\\s+', ' ', 'g'))) AS body_hash FROM emails""",
    "src10_import_report": f"{_M} SELECT count(*) FILTER (WHERE email_id % 11 <> 3 AND email_id % 13 <> 5) AS imported, count(*) FILTER (WHERE email_id % 11 = 3 OR email_id % 13 = 5) AS failed FROM emails",
    "src10_import_errors": f"{_M} SELECT 'm' || email_id || '.eml: ' || CASE WHEN email_id % 11 = 3 THEN 'empty message' ELSE 'no header' END AS error FROM emails WHERE email_id % 11 = 3 OR email_id % 13 = 5",
    "fn18_recipients": f"{_M} SELECT email_id, recipient || '@example.com; b@example.com' AS recipients FROM emails",
    "src_events_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
