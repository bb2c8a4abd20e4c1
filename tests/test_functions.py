import zlib

from pyspark.sql import functions as F

from lamina.functions import codec


def one(spark, col, data=b""):
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(col.alias("x")).first()["x"]


def test_known_values(spark):
    b = F.col("b")
    assert one(spark, codec.crc32(b), b"123456789") == 3421780262
    assert one(spark, codec.block_crc(b), b"abc") == zlib.crc32(b"abc\x00")
    assert one(spark, codec.hash32(b), b"key1") == 1821306779
    assert one(spark, codec.hash32(b, codec.BLOOM_SEED), b"key1") == 2278508694
    assert bytes(one(spark, codec.fixed32(F.lit(0x01020304)))) == bytes([4, 3, 2, 1])
    assert bytes(one(spark, codec.fixed64(F.lit(1)))) == b"\x01" + bytes(7)
    assert one(spark, codec.read_fixed(b), bytes([4, 3, 2, 1])) == 0x01020304


def test_varints(spark):
    for n, size in ((0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (1 << 21, 4), (1 << 28, 5), ((1 << 62) + 5, 9)):
        raw = bytes(one(spark, codec.varint(F.lit(n))))
        assert len(raw) == size == one(spark, codec.varint_length(F.lit(n)))
        assert tuple(one(spark, codec.read_varint(F.col("b")), raw + b"tail")) == (n, size)
    assert one(spark, codec.read_varint(F.col("b")), b"\x80") is None
    wire = bytes(one(spark, codec.length_prefixed(F.col("b")), b"z" * 300))
    assert bytes(one(spark, codec.read_length_prefixed(F.col("b")), wire)) == b"z" * 300
    assert one(spark, codec.read_length_prefixed(F.col("b")), wire[:-1]) is None
    assert len(one(spark, codec.footer(codec.block_handle(F.lit(1), F.lit(2)), codec.block_handle(F.lit(3), F.lit(400))))) == 48


def test_ten_byte_varints_handles_and_footers(spark):
    raw = bytes(one(spark, codec.varint(F.lit(-1).cast("long"))))
    assert raw == b"\xff" * 9 + b"\x01" and tuple(one(spark, codec.read_varint(F.col("b")), raw)) == (-1, 10)
    assert one(spark, codec.read_varint(F.col("b")), b"\xff" * 11) is None
    foot = bytes(one(spark, codec.footer(codec.block_handle(F.lit(1), F.lit(2)), codec.block_handle(F.lit(3), F.lit(400)))))
    read = one(spark, codec.read_footer(F.col("b")), foot)
    assert tuple(read["metaindex"]) == (1, 2, 2) and tuple(read["index"]) == (3, 400, 3)
    assert one(spark, codec.read_footer(F.col("b")), foot[:-1] + b"x") is None and one(spark, codec.read_footer(F.col("b")), foot[1:]) is None


def test_batches_encode_and_decode(spark):
    from lamina.operators.ops import WriteBatch

    rows = [(1, i, 10 + i, *op) for i, op in enumerate([(1, bytearray(b"a"), bytearray(b"x" * 300)), (0, bytearray(b""), None), (1, bytearray(b"\x00"), bytearray(b""))])]
    ops = spark.createDataFrame(rows, "batch_id long, op_idx int, seq long, type int, k binary, v binary")
    wire = codec.encode_batches(ops)
    assert sorted(map(tuple, codec.decode_batches(wire).collect())) == sorted(map(tuple, ops.collect()))
    data = bytes(wire.first()["data"])
    torn = spark.createDataFrame([(1, bytearray(data[:-2]))], "batch_id long, data binary")
    assert codec.decode_batches(torn).count() == 2
    batch = WriteBatch.from_rows(ops.select("op_idx", "type", "k", "v").collect())
    seen = []

    class Handler:
        def put(self, k, v):
            seen.append((k, v))

        def delete(self, k):
            seen.append((k, None))

    batch.iterate(Handler())
    assert seen == [(b"a", b"x" * 300), (b"", None), (b"\x00", b"")] and batch.approximate_size() >= len(data) and sorted(map(tuple, batch.to_df(spark).collect()))[1][1] == b""


def test_seeks_and_neighbours_of_many_keys(spark):
    from lamina.operators import cursor

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        ops = spark.range(0, 100_000, 2).select(F.format_string("k%06d", "id").alias("k"), F.col("id").alias("seq"), F.lit(1).alias("type"), F.lit("v").alias("v"))
        near = cursor.neighbours(ops, parts=7)
        n = F.substring("k", 2, 6).cast("int")
        bad = near.filter(~(F.coalesce(F.substring("prev_k", 2, 6).cast("int"), F.lit(-2)) == n - 2) | ~(F.coalesce(F.substring("next_k", 2, 6).cast("int"), F.lit(100_000)) == n + 2))
        assert near.count() == 50_000 and bad.count() == 0
        probes = spark.range(1, 100_000, 2).select(F.format_string("k%06d", "id").alias("k"))
        for before, d in ((False, 1), (True, -1)):
            out = cursor.multi_seek(ops, probes, before=before, parts=7)
            wrong = out.filter(F.coalesce(F.substring("at", 2, 6).cast("int"), F.lit(100_000)) != n + d)
            assert out.count() == 50_000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_files_pruned_by_broadcast_and_by_ranges(spark):
    from lamina.sources.catalog import file_prune

    files = spark.createDataFrame([(i, f"k{i * 3:04d}", f"k{i * 3 + 4:04d}") for i in range(300)], "number long, smallest string, largest string")
    probes = spark.range(0, 910, 7).select(F.format_string("k%04d", "id").alias("k"))
    both = [sorted((r["k"], r["number"]) for r in file_prune(probes, files, few).collect()) for few in (20_000, 100)]
    assert both[0] == both[1] and len(both[0]) > 130


def test_packed_bloom(spark):
    keys = spark.range(100).select(F.lit(1).alias("number"), F.format_string("key%d", F.col("id")).cast("binary").alias("k"))
    packed = codec.bloom_pack(codec.bloom_build(keys, ["number"], 1000, 6), ["number"], 1000, 6)
    asked = spark.range(2000).select(F.col("id"), F.format_string("key%d", F.col("id")).cast("binary").alias("k")).crossJoin(packed)
    hit = {r["id"] for r in asked.filter(codec.bloom_contains(F.col("bits"), F.col("k"), 1000, 6)).collect()}
    assert set(range(100)) <= hit and len(hit) < 200 and packed.first()["num_bits"] == 1000 and len(packed.first()["bits"]) == 128


def test_bloom(spark):
    keys = spark.range(1000).select(F.lit(1).alias("number"), F.format_string("key%d", F.col("id")).cast("binary").alias("k"))
    bits, probes = codec.bloom_bits(1000), codec.bloom_probes()
    filters = codec.bloom_build(keys, ["number"], bits, probes)
    assert codec.bloom_probe(keys, filters, ["number"], bits, probes).filter("not may_contain").count() == 0
    other = spark.range(1000, 4000).select(F.lit(1).alias("number"), F.format_string("key%d", F.col("id")).cast("binary").alias("k"))
    assert codec.bloom_probe(other, filters, ["number"], bits, probes).filter("may_contain").count() < 0.05 * 3000
    assert codec.bloom_bits(0) == codec.bloom_bits(10_000)
