"""The binary record format as column expressions: length u32, index u64, op u8, key length u32, key, value length u32, value; big-endian. Keys and values are bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a decode, in the order in which the checks are made.
STATUSES = ("short_prefix", "short_body", "short_header", "short_key", "short_value_length", "short_value", "ok")
_INDEX = "decimal(20,0)"


def encoded_size(k: Column, v: Column) -> Column:
    """Bytes of a record with its length prefix."""
    return (F.octet_length(k) + F.octet_length(v) + 21).cast("long")


def encode_hex(idx: Column, op: Column, k: Column, v: Column, unsigned: bool = False) -> Column:
    """The record as upper-case hex. k, v: binary, or strings, which stand for their UTF-8 bytes. unsigned: idx may be a decimal up to 2^64 - 1."""
    u = lambda x, w: F.lpad(F.hex(x.cast("long")), w, "0")
    index = F.lpad(F.conv(idx.cast("string"), 10, 16), 16, "0") if unsigned else u(idx, 16)
    data = lambda x: F.hex(x.cast("binary"))
    return F.concat(u(F.octet_length(k) + F.octet_length(v) + 17, 8), index, u(op, 2), u(F.octet_length(k), 8), data(k), u(F.octet_length(v), 8), data(v))


def encode(idx: Column, op: Column, k: Column, v: Column, unsigned: bool = False) -> Column:
    """The record as binary."""
    return F.unhex(encode_hex(idx, op, k, v, unsigned))


def decode(record: Column) -> Column:
    """A struct (status, idx, op, k, v, consumed) of the first record in binary data; k and v are binary, idx is a decimal that holds any u64.

    Any bytes whatever give one of STATUSES, and nulls unless it is ok: lengths are compared as longs before anything is cut by them. Null gives nulls.
    """
    most = F.lit((1 << 31) - 1).cast("long")

    def part(at: Column, n: Column) -> Column:
        """n bytes from a place (from 0); places past what an array can hold lie past the record's end too, and give nothing."""
        return F.substring(record, F.least(at + 1, most).cast("int"), F.least(n, most).cast("int"))

    def number(at: Column, n: int) -> Column:
        return F.conv(F.hex(part(at, F.lit(n).cast("long"))), 16, 10)

    at = lambda n: F.lit(n).cast("long")
    n = F.octet_length(record).cast("long")
    body = number(at(0), 4).cast("long")
    end = body + 4
    klen = number(at(13), 4).cast("long")
    vlen = number(klen + 17, 4).cast("long")
    status = (
        F.when(n < 4, "short_prefix").when(n < end, "short_body").when(end < 17, "short_header")
        .when(end < klen + 17, "short_key").when(end < klen + 21, "short_value_length").when(end < klen + 21 + vlen, "short_value").when(n.isNotNull(), "ok")
    )
    ok = status == "ok"
    return F.struct(
        status.alias("status"),
        F.when(ok, number(at(4), 8).cast(_INDEX)).alias("idx"),
        F.when(ok, number(at(12), 1).cast("int")).alias("op"),
        F.when(ok, part(at(17), klen)).alias("k"),
        F.when(ok, part(klen + 21, vlen)).alias("v"),
        F.when(ok, end).alias("consumed"),
    )


def decode_hex(h: Column) -> Column:
    """decode of hex text; text that isn't hex gives nulls."""
    return decode(F.unhex(h))


def as_text(data: Column) -> Column:
    """Bytes as a string; null where they are not UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def _records(stream: bytes) -> list[tuple] | None:
    """(idx as a signed long, op, k, v) of all records of a byte stream, or None if any framing check fails: then the whole stream is an error."""
    out, at = [], 0
    while at < len(stream):
        if at + 4 > len(stream):
            return None
        (size,) = struct.unpack_from(">I", stream, at)
        end = at + 4 + size
        if end > len(stream) or size < 17:
            return None
        idx, op, klen = struct.unpack_from(">qBI", stream, at + 4)
        if 17 + klen > size:
            return None
        (vlen,) = struct.unpack_from(">I", stream, at + 17 + klen)
        if 17 + klen + vlen != size:
            return None
        out.append((idx, op, stream[at + 17 : at + 17 + klen], stream[at + 21 + klen : end]))
        at = end
    return out


def decode_streams(streams: DataFrame) -> DataFrame:
    """(stream_id, status, pos, idx, op, k, v): the records of each (stream_id, data[, first]), in order; k and v are binary, idx is a decimal that holds any u64.

    A stream may be cut at record boundaries into segments, a row each, so that none grows without bound: `first` is then the position of the segment's first record (0 where it is
    missing). A segment with a framing error gives one row of status error, an empty one none. Framing is sequential, hence Arrow batches.
    """
    first = F.col("first") if "first" in streams.columns else F.lit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, data, start in zip(b["stream_id"], b["data"], b["first"], strict=True):
                found = _records(bytes(data))
                out += [(sid, "error", None, None, None, None, None)] if found is None else [(sid, "ok", start + i, *r) for i, r in enumerate(found)]
            x = pd.DataFrame(out, columns=["stream_id", "status", "pos", "idx", "op", "k", "v"])
            yield x.astype({"pos": "Int64", "idx": "Int64", "op": "Int32"})

    out = streams.select("stream_id", "data", first.cast("long").alias("first")).mapInPandas(run, "stream_id string, status string, pos long, idx long, op int, k binary, v binary")
    return out.withColumn("idx", F.col("idx").cast(_INDEX) + F.when(F.col("idx") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))).withColumn("idx", F.col("idx").cast(_INDEX))
