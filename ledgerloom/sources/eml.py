"""Import of EML messages: MIME parsing by slices of Arrow batches; a message that can't be parsed is a row with an error."""

from __future__ import annotations

from collections.abc import Iterator
from email.parser import BytesParser
from email.policy import EmailPolicy
from email.utils import getaddresses
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ledgerloom.functions.slices import slices

PARSED = StructType(
    [
        StructField("message_id", StringType()), StructField("subject", StringType()), StructField("sender", StringType()), StructField("recipients", StringType()),
        StructField("date", StringType()), StructField("text_body", StringType()), StructField("html_body", StringType()), StructField("size", LongType()),
        StructField("attachments", IntegerType()), StructField("ok", BooleanType()), StructField("error", StringType()),
    ]
)


class _Remembering(EmailPolicy):
    """The default policy. It reads a header anew each time that it's asked for, up to 15 times a message; here short ones are kept."""

    def header_fetch_parse(self, name: str, value: str):  # noqa: ANN201
        return _header(name, value) if type(value) is str and len(value) < 500 else super().header_fetch_parse(name, value)


@lru_cache(4096)
def _header(name: str, value: str):  # noqa: ANN202
    return EmailPolicy.header_fetch_parse(_POLICY, name, value)


_POLICY = _Remembering()


def parse_one(raw: bytes | None) -> tuple:
    if not raw:
        return ("", "", "", "", "", "", "", 0, 0, False, "empty message")
    try:
        m = BytesParser(policy=_POLICY).parsebytes(raw)
        text, html = m.get_body(("plain",)), m.get_body(("html",))
        senders = [a for _, a in getaddresses(m.get_all("from", []))]
        to = "; ".join(a for _, a in getaddresses(m.get_all("to", [])))
        if not m.keys():
            return ("", "", "", "", "", "", "", len(raw), 0, False, "no header")
        body = text.get_content() if text else ""
        return (
            m["message-id"] or "", m["subject"] or "", senders[0] if senders else "", to, m["date"] or "", body, html.get_content() if html else "",
            len(raw), sum(1 for _ in m.iter_attachments()), True, None,
        )
    except Exception as e:  # any malformed message is a row, never a failed task
        return ("", "", "", "", "", "", "", len(raw), 0, False, f"{type(e).__name__}: {e}")


def parse_eml(raw: Column, *fields: str) -> Column:
    """A struct of the fields of PARSED that are named, or of all. Each message is parsed as a whole whatever is named; bodies that nobody asks for stay in the worker."""
    kind = StructType([PARSED[f] for f in fields or PARSED.names])
    at = [PARSED.names.index(f) for f in kind.names]
    types = [to_arrow_type(f.dataType) for f in kind]

    @F.arrow_udf(kind)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, n in slices(batch):
                rows = [parse_one(x) for x in batch.slice(start, n).to_pylist()]
                plain = ([str(x) if isinstance(x, str) else x for x in (row[i] for row in rows)] for i in at)
                yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(plain, types)], kind.names)

    return parsed.asNondeterministic()(raw)  # else a filter on ok would parse each message for itself


def write_eml(message_id: Column, subject: Column, sender: Column, recipient: Column, body: Column) -> Column:
    """A plain message in UTF-8, as bytes."""
    head = F.concat(F.lit("Message-ID: <"), message_id, F.lit(">\r\nSubject: "), subject, F.lit("\r\nFrom: "), sender, F.lit("\r\nTo: "), recipient)
    return F.concat(head, F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), body).cast("binary")


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under path: its name and what parse_eml finds."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), parse_eml(F.col("content")).alias("m")).select("file", "m.*")


def import_report(parsed: DataFrame) -> DataFrame:
    """Counts of messages that parsed and that didn't; the errors themselves are rows of import_errors."""
    return parsed.agg(F.count_if("ok").alias("imported"), F.count_if(~F.col("ok")).alias("failed"))


def import_errors(parsed: DataFrame) -> DataFrame:
    """(error): 'file: message' for each message that didn't parse, a row each."""
    return parsed.where(~F.col("ok")).select(F.concat_ws(": ", "file", "error").alias("error"))
