"""Content addresses: envelope, content and block hashes in the JVM; SHA3 ids and codecs, which Spark lacks, by Arrow."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ledgerloom.functions.slices import mapped

GENESIS = "0" * 64
_Z32 = "ybndrfg8ejkmcpqxot1uwisza345h769"


def joined_hash(*fields: Column) -> Column:
    """SHA-256, in hex, of fields joined by '|'; a null counts as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chain_hash(previous: Column, own: Column) -> Column:
    return F.sha2(F.concat(previous, own), 256)


def z_base_32(data: bytes) -> str:
    bits = "".join(f"{b:08b}" for b in data)
    bits += "0" * (-len(bits) % 5)
    return "".join(_Z32[int(bits[i : i + 5], 2)] for i in range(0, len(bits), 5))


@F.pandas_udf(StringType())
def message_id(identity: pd.Series) -> pd.Series:
    """z-base-32 text of the SHA3-256 of a message's identity string."""
    return identity.map(lambda x: None if x is None else z_base_32(hashlib.sha3_256(x.encode()).digest()))


def _gzip(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


@F.arrow_udf(BinaryType())
def gzipped(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in data:
        yield from mapped(pa.binary(), _gzip, batch)


@F.arrow_udf(BinaryType())
def gunzipped(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in data:
        yield from mapped(pa.binary(), _gunzip, batch)


@F.arrow_udf(BinaryType())
def gzip_round_trip(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What comes back of data that is gzipped and unzipped, row by row: one worker, and no column of what lies between."""
    for batch in data:
        yield from mapped(pa.binary(), lambda x: _gunzip(_gzip(x)), batch)


#: Codec ids of block flags. Sizes of what was compressed come from the block's header.
CODECS = {0: None, 1: "gzip", 2: "lz4", 3: "zstd", 4: "brotli"}


@lru_cache
def _codec(number: int) -> pa.Codec | None:
    if number not in CODECS:
        raise ValueError(f"there is no codec {number}")
    return pa.Codec(CODECS[number]) if CODECS[number] else None


def _known(codec: pa.Array) -> None:
    """An error where codec has an unknown id, be the data of its row null or not."""
    for n in codec.unique().to_pylist():
        _codec(int(n))


def _pack(data: bytes, codec: int) -> bytes:
    tool = _codec(codec)
    return tool.compress(data, asbytes=True) if tool else data


def _unpack(data: bytes, codec: int, size: int) -> bytes:
    tool = _codec(codec)
    return tool.decompress(data, size, asbytes=True) if tool else data


@F.arrow_udf(BinaryType())
def compressed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Data (first column) in the codec of each row (second); an unknown id is an error."""
    for data, codec in batches:
        _known(codec)
        yield from mapped(pa.binary(), _pack, data, codec)


@F.arrow_udf(BinaryType())
def unpacked(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Data (first column) out of the codec (second) of each row, whose size (third) is known."""
    for data, codec, size in batches:
        _known(codec)
        yield from mapped(pa.binary(), _unpack, data, codec, size)


@F.arrow_udf(BinaryType())
def codec_round_trip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What comes back of data (first column) that is compressed and unpacked in the codec of each row (second)."""
    for data, codec in batches:
        _known(codec)
        yield from mapped(pa.binary(), lambda x, n: _unpack(_pack(x, n), n, len(x)), data, codec)
