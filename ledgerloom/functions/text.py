"""Scalar text functions of the message store as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_CUTS = r"""[ \t\n\r.,!?;:"'()\[\]{}]+"""
INDEX_CUTS = r"[ \t\n\r.,;:!?]+"
QUERY_CUTS = r"[ \t\n\r]+"
STOP_WORDS = ("about and at but by for from in into of on or the through to up with").split()
LEAST = 3


def _long(words: Column) -> Column:
    return F.filter(words, lambda w: F.length(w) >= LEAST)


def store_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of three characters or more; quotes and brackets cut too."""
    return F.array_distinct(_long(F.split(F.lower(text), STORE_CUTS)))


def index_tokens(text: Column) -> Column:
    """Like store_tokens, but quotes and brackets stay in the tokens."""
    return F.array_distinct(_long(F.split(F.lower(text), INDEX_CUTS)))


def query_terms(query: Column) -> Column:
    """Terms of a ranked query, split at white space, repeats kept, without stop words."""
    return F.filter(_long(F.split(F.lower(query), QUERY_CUTS)), lambda w: ~w.isin(*STOP_WORDS))


def first_term(query: Column) -> Column:
    """What a boolean-looking query searches for: the part before its first operator."""
    return F.trim(F.get(F.split(F.lower(query), " and | or | not "), 0))


def preview(subject: Column, sender: Column, date: Column) -> Column:
    return F.concat(subject, F.lit(" - "), sender, F.lit(" ("), F.date_format(date, "MM/dd/yyyy"), F.lit(")"))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def human_bytes(size: Column) -> Column:
    """Size in steps of 1024 with two decimals."""
    out = F.format_string("%.2f TB", size / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", size / 1024.0**power)).otherwise(out)
    return out


def folder_parent(path: Column) -> Column:
    """The path before the last backslash, '' for a root."""
    return F.regexp_extract(path, r"^(.*)\\[^\\]*$", 1)


def folder_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"\\"), -1)


def folder_join(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("\\"), name))


def folder_valid(path: Column) -> Column:
    """Not blank, no doubled or trailing separator, none of the forbidden characters."""
    return (F.trim(path) != "") & ~path.contains("\\\\") & ~path.endswith("\\") & ~path.rlike(r'[<>:"|?*]')


def compound_key(block: Column, local: Column) -> Column:
    return F.concat_ws(":", block.cast("string"), local.cast("string"))


def parse_key(key: Column) -> Column:
    """struct(block, local), null unless the key has exactly two parts that are numbers."""
    parts = F.split(key, ":")
    ok = (F.size(parts) == 2) & key.rlike(r"^-?\d+:-?\d+$")
    return F.when(ok, F.struct(F.get(parts, 0).cast("long").alias("block"), F.get(parts, 1).cast("int").alias("local")))


def block_type(block_id: Column) -> Column:
    """Type by the range of a block's id."""
    span = 10_000_000_000_000
    return (
        F.when(block_id.isin(0, 1), "Metadata").when(block_id == 3, "WAL").when(block_id == 2, "FolderTree")
        .when((block_id >= span) & (block_id < 2 * span), "Folder").when((block_id >= 2 * span) & (block_id < 3 * span), "Segment")
        .when((block_id >= 3 * span) & (block_id < 4 * span), "Cleanup").otherwise("Metadata")
    )


def adaptive_block_mb(store_bytes: Column) -> Column:
    gb = 1 << 30
    return F.when(store_bytes < 5 * gb, 50).when(store_bytes < 25 * gb, 100).when(store_bytes < 100 * gb, 250).when(store_bytes < 500 * gb, 500).otherwise(1024)


def segment_group(segment_id: Column) -> Column:
    return F.floor(segment_id / 1000).cast("long")


def codec_of(flags: Column) -> Column:
    return F.shiftright(flags.bitwiseAND(0xFE), 1)


def with_codec(flags: Column, codec: Column) -> Column:
    """Flags with the codec's id set; id 0 clears the compressed bit too."""
    kept = flags.bitwiseAND(0xFF00)
    return F.when(codec == 0, kept).otherwise(kept.bitwiseOR(F.shiftleft(codec, 1)).bitwiseOR(1))
