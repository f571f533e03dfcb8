"""Search over messages: field search, inverted index, boolean and ranked full-text search.

Terms are filtered before any shuffle; posting lists are rows, never arrays, so a frequent term is no large value.
The functions take postings: those of a stored index (inverted.py), where the terms of a query are pushed into the scan,
or `postings(messages)`, which splits all texts again, where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import LEAST, STORE_CUTS, index_tokens, store_tokens
from ledgerloom.operators.inverted import having

FIELDS = (("subject", "subject"), ("from", "sender"), ("to", "recipient"), ("body", "body"))


def postings(messages: DataFrame, columns: tuple[str, ...] = ("body",)) -> DataFrame:
    """(term, email_id): one row for each distinct term of the columns of a message."""
    words = [F.explode(F.array_distinct(F.split(F.lower(F.col(c)), STORE_CUTS))).alias("term") for c in columns]
    tokens = [messages.select("email_id", w).where(F.length("term") >= LEAST) for w in words]  # store_tokens, but short words go as rows
    return reduce(DataFrame.unionByName, tokens).distinct() if len(tokens) > 1 else tokens[0]


def index_postings(messages: DataFrame) -> DataFrame:
    """Postings of the index manager: subject, body, sender and recipient as one set, split by the second tokeniser."""
    every = F.array_distinct(F.flatten(F.array(*(index_tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "body", "sender", "recipient")))))
    return messages.select("email_id", F.explode(every).alias("term"))


def field_search(messages: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """One point and half a point more for each field that holds the term as a substring; the best `limit`."""
    hit = {name: F.instr(F.lower(F.col(c)), F.lit(term.lower())) > 0 for name, c in FIELDS}
    n = sum((F.coalesce(h, F.lit(False)).cast("int") for h in hit.values()), F.lit(0))
    found = messages.select("email_id", n.alias("n"), F.array_compact(F.array(*(F.when(h, F.lit(k)) for k, h in hit.items()))).alias("fields")).where("n > 0")
    return found.select("email_id", (1.0 + 0.5 * F.col("n")).cast("double").alias("relevance"), F.array_join("fields", ",").alias("matched_fields")).orderBy(F.desc("relevance"), "email_id").limit(limit)


def first_term_of(query: str) -> str:
    import re

    return re.split(" and | or | not ", query.lower())[0].strip()


def terms_of(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split(STORE_CUTS, query.lower()) if len(t) >= 3))


def search_all(postings: DataFrame, query: str) -> DataFrame:
    """Messages with all known terms. Unknown terms count for nothing after a known one, and for an empty result before.

    One pass over the postings: a message's terms are bits of one number, and the known terms are all bits of all of them.
    """
    terms = terms_of(query)
    if not terms:
        return postings.select("email_id").where(F.lit(False))
    if len(terms) > 63:
        raise ValueError("a query has 63 terms at most")
    place = F.create_map(*(x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(1 << i).cast("long"))))
    hits = having(postings, terms).groupBy("email_id").agg(F.bit_or(F.element_at(place, F.col("term"))).alias("has"))
    known = hits.agg(F.coalesce(F.bit_or("has"), F.lit(0).cast("long")).alias("known"))
    return hits.join(F.broadcast(known), (F.col("has") == F.col("known")) & (F.col("known") % 2 == 1)).select("email_id")


def search_any(postings: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Share of the query's terms that a message has; the best `limit`."""
    terms = terms_of(query)
    found = having(postings, terms).groupBy("email_id").agg((F.count("*") / F.lit(float(max(len(terms), 1)))).alias("score"))
    return found.orderBy(F.desc("score"), "email_id").limit(limit)


def ranked_search(postings: DataFrame, envelopes: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """Share of matched terms, repeats counted, times 1 + block / 1e6 (newer blocks first), with envelopes joined."""
    weight = F.create_map(*(x for t in dict.fromkeys(terms) for x in (F.lit(t), F.lit(terms.count(t)))))
    hits = having(postings, terms).groupBy("email_id").agg(F.sum(F.element_at(weight, F.col("term"))).alias("hits"))
    ranked = hits.select("email_id", (F.col("hits") / F.lit(float(len(terms))) * (1 + F.floor(F.col("email_id") / 100) / 1e6)).alias("score")).orderBy(F.desc("score"), "email_id").limit(limit)
    return envelopes.join(F.broadcast(ranked), "email_id").select("email_id", "score", "message_id", "subject", "sender", "folder")  # limit rows


def advanced_search(
    messages: DataFrame, sender: str | None = None, recipient: str | None = None, subject: str | None = None, body: str | None = None, folder: str | None = None,
    start: str | None = None, end: str | None = None, tags: DataFrame | None = None, wanted: tuple[str, ...] = (),
) -> DataFrame:
    """Conjunction of the criteria given. start and end bound the column `sent`, both inclusive.

    tags: rows (email_id, label); a message must have all of `wanted`, and needs no tag if none is wanted.
    """
    out = messages
    for column, value in (("sender", sender), ("recipient", recipient), ("folder", folder)):
        if value is not None:
            out = out.where(F.lower(F.col(column)) == value.lower())
    for column, value in (("subject", subject), ("body", body)):
        if value is not None:
            out = out.where(F.arrays_overlap(store_tokens(F.col(column)), F.array(*map(F.lit, terms_of(value)))))
    if start is not None:
        out = out.where(F.col("sent") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("sent") <= F.lit(end).cast("timestamp"))
    if wanted and tags is not None:
        having_all = tags.where(F.col("label").isin(*wanted)).groupBy("email_id").agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(set(wanted)))
        out = out.join(having_all, "email_id", "left_semi")
    return out.select("email_id")


def keyword_search(postings: DataFrame, subject: str = "", sender: str = "", recipient: str = "", keywords: str = "", limit: int = 50) -> DataFrame:
    return search_any(postings, keywords or " ".join(x for x in (subject, sender, recipient) if x), limit)


def indexed_fields(messages: DataFrame) -> DataFrame:
    filled = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.lit(name)) for name, c in FIELDS)))
    return messages.select("email_id", F.array_join(filled, ",").alias("fields"))
