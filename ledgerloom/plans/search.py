"""Registered queries of tokenisers, postings and search, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import search as S
from ledgerloom.operators.inverted import having, stored
from ledgerloom.plans.views import CUTS, MESSAGES, POSTINGS, messages, table

FIELD_TERM, ALL_QUERY, ANY_QUERY, RANK_QUERY = "from", "the with from", "ther edthe with tion from", "the onion with from andther from tion"
INDEX_SQL_CUTS = r"'[ \t\n\r.,;:!?]+'"
STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
RANK_TERMS = [t for t in RANK_QUERY.split() if len(t) >= 3 and t not in X.STOP_WORDS]
INDEX_POSTINGS = f"""postings AS (SELECT DISTINCT email_id, unnest(list_filter(string_split_regex(lower(x), {INDEX_SQL_CUTS}), lambda t: length(t) >= 3)) AS term
  FROM (SELECT email_id, unnest([subject, body, sender, recipient]) AS x FROM emails))"""



def _stored(s, d):  # noqa: ANN001, ANN202
    return stored(messages(s, d), S.postings(messages(s, d)), "body")[0]


def _ranked(s, d):  # noqa: ANN001, ANN202
    return S.ranked_search(*stored(messages(s, d), S.index_postings(messages(s, d)), "fields"), RANK_TERMS)


def _term(s, d, *terms):  # noqa: ANN001, ANN002, ANN202
    return having(_stored(s, d), terms)


def _tags(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "labels").select(F.col("doc_id").alias("email_id"), F.explode(F.array(F.concat(F.lit("quality-"), "quality"), F.concat(F.lit("toxic-"), "toxic"))).alias("label"))


def _dated(s, d):  # noqa: ANN001, ANN202
    return messages(s, d).withColumn("sent", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.pmod("write_seq", F.lit(365)).cast("int")))


QUERIES = {
    "fn1_store_tokens": lambda s, d: (
        messages(s, d)
        .select("email_id", F.array_join(F.array_sort(X.store_tokens(F.col("body"))), " ").alias("tokens"))
    ),
    "fn2_index_tokens": lambda s, d: (
        messages(s, d)
        .select("email_id", F.array_join(F.array_sort(X.index_tokens(F.col("body"))), " ").alias("tokens"))
    ),
    "fn3_query_terms": lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms")),
    "fn4_first_term": lambda s, d: table(s, d, "benchmark").select("item_id", X.first_term(F.concat("text", F.lit(" AND x OR y"))).alias("term")),
    "agg1_postings": lambda s, d: S.postings(messages(s, d)).select("term", "email_id"),
    "agg1_index_postings": lambda s, d: S.index_postings(messages(s, d)).select("term", "email_id"),
    "agg1_term_counts": lambda s, d: S.postings(messages(s, d)).groupBy("term").agg(F.count("*").alias("n_messages")),
    "agg1_stored_index": lambda s, d: _stored(s, d).groupBy("term").agg(F.count("*").alias("n_messages")),
    "agg6_term_matches": lambda s, d: _term(s, d, *S.terms_of(ANY_QUERY)).groupBy("email_id").agg(F.count("*").alias("n_terms")),
    "sr1_field_search": lambda s, d: S.field_search(messages(s, d), FIELD_TERM),
    "sr2_boolean_search": lambda s, d: S.field_search(messages(s, d), S.first_term_of("The AND nothing OR else")),
    "sr3_search_all": lambda s, d: S.search_all(_stored(s, d), ALL_QUERY),
    "sr3_unknown_first": lambda s, d: S.search_all(_stored(s, d), "zzzunknownzzz the with"),
    "sr3_unknown_later": lambda s, d: S.search_all(_stored(s, d), "the zzzunknownzzz with"),
    "sr4_search_any": lambda s, d: S.search_any(_stored(s, d), ANY_QUERY),
    "sr5_ranked_search": _ranked,
    "sr6_advanced_search": lambda s, d: (
        S.advanced_search(_dated(s, d), sender="en", body="the with", start="2024-02-10 00:00:00", end="2024-11-20 00:00:00", tags=_tags(s, d), wanted=("quality-1", "toxic-0"))
    ),
    "sr7_keyword_search": lambda s, d: S.keyword_search(_stored(s, d), subject="tion from", sender="with"),
    "sr8_term_lookup": lambda s, d: _term(s, d, "from").select("email_id"),
    "sr9_indexed_fields": lambda s, d: S.indexed_fields(messages(s, d)),
    "set1_union": lambda s, d: _term(s, d, "with", "from").select("email_id").distinct(),
    "set3_intersection": lambda s, d: _term(s, d, "with").select("email_id").intersect(_term(s, d, "from").select("email_id")),
    "set4_difference": lambda s, d: _term(s, d, "with").select("email_id").exceptAll(_term(s, d, "from").select("email_id")),
    "set5_distinct_terms": lambda s, d: S.postings(messages(s, d)).select("term").distinct(),
    "jn2_hits_with_metadata": lambda s, d: (
        _term(s, d, "from")
        .join(messages(s, d).select("email_id", "folder", "size"), "email_id")
        .select("email_id", "folder", "size")
    ),
    "jn3_hits_by_block": lambda s, d: (
        _term(s, d, "from")
        .select("email_id", F.floor(F.col("email_id") / 100).alias("block_id"))
        .groupBy("block_id")
        .agg(F.count("*").alias("n_hits"), F.min("email_id").alias("first_id"))
    ),
    "tk2_first_n": lambda s, d: messages(s, d).select("email_id", "folder").orderBy("email_id").limit(25),
}

_E = f"WITH {MESSAGES}"
_P = f"{_E}, {POSTINGS}"


def _field(term: str) -> str:
    flags = {k: f"CASE WHEN contains(lower({c}), '{term}') THEN 1 ELSE 0 END" for k, c in (("subject", "subject"), ("from", "sender"), ("to", "recipient"), ("body", "body"))}
    names = ", ".join(f"CASE WHEN {v} = 1 THEN '{k}' END" for k, v in flags.items())
    return f"""{_E}, h AS (SELECT email_id, {' + '.join(flags.values())} AS n, concat_ws(',', {names}) AS matched_fields FROM emails)
SELECT email_id, CAST(1.0 + 0.5 * n AS DOUBLE) AS relevance, matched_fields FROM h WHERE n > 0 ORDER BY relevance DESC, email_id LIMIT 50"""


def _any(terms: list[str]) -> str:
    return f"""{_P} SELECT email_id, count(*) / CAST({len(terms)} AS DOUBLE) AS score FROM postings WHERE term IN ({', '.join(f"'{t}'" for t in terms)})
GROUP BY email_id ORDER BY score DESC, email_id LIMIT 50"""


_ALL = f"{_P} SELECT email_id FROM postings WHERE term IN ('the', 'with') GROUP BY email_id HAVING count(*) = 2"
_SORTED = "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(body), {}), lambda x: length(x) >= 3))), ' ') AS tokens"
ORACLE_SQL = {
    "fn1_store_tokens": f"{_E} SELECT email_id, {_SORTED.format(CUTS)} FROM emails",
    "fn2_index_tokens": f"{_E} SELECT email_id, {_SORTED.format(INDEX_SQL_CUTS)} FROM emails",
    "fn3_query_terms": rf"SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: length(x) >= 3 AND x NOT IN ({STOPS})), ' ') AS terms FROM benchmark",
    "fn4_first_term": "SELECT item_id, trim(string_split_regex(lower(text || ' AND x OR y'), ' and | or | not ')[1]) AS term FROM benchmark",
    "agg1_postings": f"{_P} SELECT term, email_id FROM postings",
    "agg1_index_postings": f"{_E}, {INDEX_POSTINGS} SELECT term, email_id FROM postings",
    "agg1_term_counts": f"{_P} SELECT term, count(*) AS n_messages FROM postings GROUP BY term",
    "agg1_stored_index": f"{_P} SELECT term, count(*) AS n_messages FROM postings GROUP BY term",
    "agg6_term_matches": f"""{_P} SELECT email_id, count(*) AS n_terms FROM postings WHERE term IN ({', '.join(f"'{t}'" for t in S.terms_of(ANY_QUERY))}) GROUP BY email_id""",
    "sr1_field_search": _field(FIELD_TERM),
    "sr2_boolean_search": _field("the"),
    "sr3_search_all": f"{_P} SELECT email_id FROM postings WHERE term IN ('the', 'with', 'from') GROUP BY email_id HAVING count(*) = 3",
    "sr3_unknown_first": "SELECT doc_id AS email_id FROM documents WHERE false",
    "sr3_unknown_later": _ALL,
    "sr4_search_any": _any(S.terms_of(ANY_QUERY)),
    "sr5_ranked_search": f"""{_E}, {INDEX_POSTINGS}, q AS (SELECT unnest([{', '.join(f"'{t}'" for t in RANK_TERMS)}]) AS term),
h AS (SELECT email_id, count(*) / CAST({len(RANK_TERMS)} AS DOUBLE) * (1 + (email_id // 100) / 1e6) AS score FROM postings JOIN q USING (term) GROUP BY email_id ORDER BY score DESC, email_id LIMIT 50)
SELECT email_id, score, message_id, subject, sender, folder FROM h JOIN emails USING (email_id)""",
    "sr6_advanced_search": f"""{_P} SELECT DISTINCT email_id FROM emails JOIN postings USING (email_id) JOIN labels ON doc_id = email_id WHERE sender = 'en' AND term IN ('the', 'with')
AND quality = 1 AND toxic = 0 AND TIMESTAMP '2024-01-01' + INTERVAL (write_seq % 365) DAY BETWEEN TIMESTAMP '2024-02-10' AND TIMESTAMP '2024-11-20'""",
    "sr7_keyword_search": _any(["tion", "from", "with"]),
    "sr8_term_lookup": f"{_P} SELECT email_id FROM postings WHERE term = 'from'",
    "sr9_indexed_fields": f"""{_E} SELECT email_id, concat_ws(',', CASE WHEN subject <> '' THEN 'subject' END, CASE WHEN sender <> '' THEN 'from' END,
CASE WHEN recipient <> '' THEN 'to' END, CASE WHEN body <> '' THEN 'body' END) AS fields FROM emails""",
    "set1_union": f"{_P} SELECT DISTINCT email_id FROM postings WHERE term IN ('with', 'from')",
    "set3_intersection": f"{_P} SELECT email_id FROM postings WHERE term = 'with' INTERSECT SELECT email_id FROM postings WHERE term = 'from'",
    "set4_difference": f"{_P} SELECT email_id FROM postings WHERE term = 'with' EXCEPT ALL SELECT email_id FROM postings WHERE term = 'from'",
    "set5_distinct_terms": f"{_P} SELECT DISTINCT term FROM postings",
    "jn2_hits_with_metadata": f"{_P} SELECT email_id, folder, size FROM postings JOIN emails USING (email_id) WHERE term = 'from'",
    "jn3_hits_by_block": f"{_P} SELECT email_id // 100 AS block_id, count(*) AS n_hits, min(email_id) AS first_id FROM postings WHERE term = 'from' GROUP BY 1",
    "tk2_first_n": f"{_E} SELECT email_id, folder FROM emails ORDER BY email_id LIMIT 25",
}
