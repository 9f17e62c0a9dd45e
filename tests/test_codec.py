"""Record format, command language and Bloom filters."""

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom, codec, grammar

REC = "idx long, op int, k string, v string"


def encoded(spark, records):
    return [r[0] for r in spark.createDataFrame(records, REC).select(codec.encode_hex(F.col("idx"), F.col("op"), F.col("k"), F.col("v"))).collect()]


def test_layout(spark):
    a, b = encoded(spark, [(42, 0, "foo", "bar"), (7, 1, "baz", "")])
    assert a == "00000017" + "000000000000002A" + "00" + "00000003" + "666F6F" + "00000003" + "626172"
    assert len(b) == 48 and b[24:26] == "01" and b.endswith("00000000")


@pytest.mark.parametrize(("data", "status"), [
    ("000102", "short_prefix"),
    ("00000017", "short_body"),
    ("00000004" + "00000000", "short_header"),
    ("0000000F" + "0000000000000001" + "00" + "0000000A" + "6162", "short_key"),
    ("0000000F" + "0000000000000001" + "00" + "00000002" + "6162", "short_value_length"),
    ("00000015" + "0000000000000001" + "00" + "00000001" + "61" + "00000005" + "616263", "short_value"),
])
def test_truncated(spark, data, status):
    assert spark.createDataFrame([(data,)], "h string").select(codec.decode_hex(F.col("h"))["status"]).first()[0] == status


@pytest.mark.parametrize(("data", "status"), [
    ("7FFFFFFF" + "00" * 17, "short_body"),
    ("FFFFFFFF" + "00" * 17, "short_body"),
    ("00000011" + "0000000000000001" + "00" + "FFFFFFFF" + "00000000", "short_key"),
    ("00000011" + "0000000000000001" + "00" + "7FFFFFFF" + "00000000", "short_key"),
    ("00000012" + "0000000000000001" + "00" + "00000001" + "61" + "FFFFFFFF", "short_value"),
    ("00000012" + "0000000000000001" + "00" + "00000001" + "61" + "7FFFFFFF", "short_value"),
    ("00000012" + "8000000000000000" + "FF" + "00000000" + "00000001" + "FF", "ok"),
    ("", "short_prefix"), ("zz", None), (None, None),
])
def test_hostile_bytes_give_a_status(spark, data, status):
    """No bytes fail the job: lengths up to 2^32 - 1, indices from 2^63 on, and values that aren't UTF-8."""
    got = spark.createDataFrame([(data,)], "h string").select(codec.decode_hex(F.col("h")).alias("x")).select("x.*").first()
    assert got["status"] == status
    if status == "ok":
        assert int(got["idx"]) == 2**63 and got["op"] == 255 and bytes(got["k"]) == b"" and bytes(got["v"]) == b"\xff" and got["consumed"] == 22


def test_any_bytes_decode_as_by_hand(spark):
    rng = random.Random(5)

    def by_hand(b):
        if len(b) < 4:
            return "short_prefix"
        size = int.from_bytes(b[:4], "big")
        if len(b) < size + 4:
            return "short_body"
        body = b[4 : 4 + size]
        for need, name in ((13, "short_header"),):
            if len(body) < need:
                return name
        klen = int.from_bytes(body[9:13], "big")
        if len(body) < 13 + klen:
            return "short_key"
        if len(body) < 17 + klen:
            return "short_value_length"
        vlen = int.from_bytes(body[13 + klen : 17 + klen], "big")
        return "short_value" if len(body) < 17 + klen + vlen else ("ok", int.from_bytes(body[:8], "big"), body[8], body[13 : 13 + klen], body[17 + klen : 17 + klen + vlen])

    rows = []
    for _ in range(400):
        b = bytearray(rng.choice([0, 0, 0, 1, 255, rng.randrange(256)]) for _ in range(rng.randrange(60)))
        if len(b) >= 4 and rng.random() < 0.8:
            b[:4] = (len(b) - 4 - rng.randrange(3)).to_bytes(4, "big", signed=True)
        rows.append((bytes(b),))
    got = spark.createDataFrame([(bytearray(b),) for b, in rows], "b binary").select("b", codec.decode(F.col("b")).alias("x")).select("b", "x.*").collect()
    assert len(got) == 400
    for r in got:
        want = by_hand(bytes(r["b"]))
        assert r["status"] == (want if isinstance(want, str) else "ok")
        if not isinstance(want, str):
            assert (int(r["idx"]), r["op"], bytes(r["k"]), bytes(r["v"])) == want[1:]


def test_round_trip_and_streams(spark):
    records = [(1, 0, "a", "x"), (2, 1, "b", ""), (3, 0, "c", "yzé")]
    hexes = encoded(spark, records)
    back = spark.createDataFrame([(h,) for h in hexes], "h string").select(codec.decode_hex(F.col("h")).alias("x")).select("x.*")
    assert sorted((r["status"], int(r["idx"]), r["op"], bytes(r["k"]).decode(), bytes(r["v"]).decode()) for r in back.collect()) == sorted(("ok", *r) for r in records)
    whole = bytes.fromhex("".join(hexes))
    streams = spark.createDataFrame([("s", bytearray(whole)), ("junk", bytearray(whole + b"\1\2\3")), ("empty", bytearray())], "stream_id string, data binary")
    got = [(r["stream_id"], r["status"], r["pos"], r["idx"] and int(r["idx"]), r["op"], *(r[c] if r[c] is None else bytes(r[c]).decode() for c in "kv")) for r in codec.decode_streams(streams).orderBy("stream_id", "pos").collect()]
    assert got == [("junk", "error", None, None, None, None, None)] + [("s", "ok", i, *r) for i, r in enumerate(records)]


def test_bytes_and_unsigned_indices_round_trip(spark):
    records = [(i, 0, bytearray(k), bytearray(v)) for i, (k, v) in zip((0, 2**63 - 1, 2**63, 2**64 - 1), ((b"", b""), (b"\xff\x00", b"\xfe"), (b"a", b"\x80" * 300), (b"\xc3", b"z")), strict=True)]
    rows = spark.createDataFrame([(Decimal(i), o, k, v) for i, o, k, v in records], "idx decimal(20,0), op int, k binary, v binary")
    data = rows.select(codec.encode(F.col("idx"), F.col("op"), F.col("k"), F.col("v"), unsigned=True).alias("data"))
    want = sorted((i, o, bytes(k), bytes(v)) for i, o, k, v in records)
    one = data.select(codec.decode(F.col("data")).alias("x")).select("x.*")
    assert sorted((int(r["idx"]), r["op"], bytes(r["k"]), bytes(r["v"])) for r in one.collect()) == want
    segments = data.withColumns({"stream_id": F.lit("s"), "first": F.lit(7).cast("long")})
    got = codec.decode_streams(segments).collect()
    assert sorted((int(r["idx"]), r["op"], bytes(r["k"]), bytes(r["v"])) for r in got) == want and {r["pos"] for r in got} == {7}
    assert one.select(codec.as_text(F.col("k")).alias("k")).where("k is null").count() == 2


@pytest.mark.parametrize(("command", "expected"), [
    ("set key1 val1", ("set", "key1", "val1")), ("SET key1 val1", ("set", "key1", "val1")), ("Delete key1", ("delete", "key1", None)),
    ("", ("noop", None, None)), ("  ", ("noop", None, None)), ("get key1", ("error", None, None)), ("set key1", ("error", None, None)), ("set k a b", ("error", None, None)),
])
def test_grammar(spark, command, expected):
    assert tuple(spark.createDataFrame([(command,)], "c string").select(grammar.parse(F.col("c")).alias("x")).select("x.*").first()) == expected


def test_bloom(spark):
    keys = [f"key{i}" for i in range(200)]
    runs = spark.createDataFrame([(1, k) for k in keys], "file_id long, k string")
    bits = 64 * 150
    filters = bloom.build(runs, bits)
    assert filters.agg(F.max("bit_pos")).first()[0] < bits
    assert {r["k"] for r in bloom.passes(filters, runs.select("k"), bits).collect()} == set(keys)
    few = spark.createDataFrame([("key7",), ("none",)], "k string")
    assert {tuple(r) for r in bloom.passes(bloom.probed_bits(runs, few, bits), few, bits).collect()} == {tuple(r) for r in bloom.passes(filters, few, bits).collect()}
    assert bloom.passes(filters.where("false"), runs.select("k"), bits).count() == 0
    h = hashlib.sha256(b"key7").digest()
    h1, h2 = int.from_bytes(h[:8], "big"), int.from_bytes(h[8:16], "big")
    got = [r["bit_pos"] for r in bloom.probe_rows(spark.createDataFrame([("key7",)], "k string"), bits).orderBy("i").collect()]
    assert got == [(h1 + i * h2) % 2**64 % bits for i in range(1, 8)]
    assert bloom.chunks(filters).agg(F.sum(F.bit_count("mask"))).first()[0] == filters.count()
