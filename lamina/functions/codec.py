"""Scalars: checksums, hashes, integer codecs, Bloom filters, block and prefix-compression models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the storage format.
BLOOM_SEED = 0xBC9F1D34
HASH_M, HASH_R = 0xC6A4A793, 24
TABLE_MAGIC = 0x57FB088B46DB80E8
MASK = (1 << 32) - 1


def crc32(data: Column) -> Column:
    return F.crc32(data)


def crc32_extend(head: Column, tail: Column) -> Column:
    """The checksum of head followed by tail."""
    return F.crc32(F.concat(head, tail))


def block_crc(data: Column, kind: int = 0) -> Column:
    """The checksum in a block's trailer: of its bytes and its type."""
    return crc32_extend(data, F.lit(bytearray([kind])))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is named."""
    return F.transform(F.array(value), use)[0]


def _hash_rows(data: pa.Array, seed: int) -> np.ndarray:
    """hash32 of an array without nulls: word by word through all rows that are long enough, so no row is looped over."""
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8).astype(np.uint32)
    start, size = at[:-1], np.diff(at)
    h = np.uint32(seed) ^ (size.astype(np.uint32) * np.uint32(HASH_M))
    order = np.argsort(-size, kind="stable")
    ends = np.searchsorted(-size[order], -4 * np.arange(1, size.max(initial=0) // 4 + 1), side="right")
    for i, rows in enumerate(ends.tolist()):
        own = order[:rows]
        p = start[own] + 4 * i
        x = (h[own] + (raw[p] | raw[p + 1] << 8 | raw[p + 2] << 16 | raw[p + 3] << 24)) * np.uint32(HASH_M)
        h[own] = x ^ x >> 16
    left = size % 4
    for j in range(3):
        own = np.flatnonzero(left > j)
        h[own] += raw[start[own] + size[own] - left[own] + j] << np.uint32(8 * j)
    own = np.flatnonzero(left)
    x = h[own] * np.uint32(HASH_M)
    h[own] = x ^ x >> HASH_R
    return h


def hash32(data: Column, seed: int = 0) -> Column:
    """The 32-bit hash that shards caches and probes Bloom filters, as a long; null for null.

    Four bytes at a time are added, multiplied and folded; what is left (three at most) is added with shifts. Wrapping
    arithmetic over Arrow batches took 0.7 s where the same in SQL functions, whose lambdas are interpreted, took 14 (1,000,000
    keys of 64 bytes).
    """

    @F.arrow_udf("long")
    def hashed(rows: pa.Array) -> pa.Array:
        fine = rows.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(rows), np.int64)
        out[fine] = _hash_rows(rows.drop_null().cast(pa.binary()), seed)
        return pa.array(out, mask=~fine)

    return hashed(data.cast("binary"))


def cache_shard(data: Column, bits: int = 4) -> Column:
    return F.shiftrightunsigned(hash32(data), 32 - bits)


def _le(n: Column, size: int) -> Column:
    hexed = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 2 * (size - i) - 1, 2) for i in range(size)]))


def fixed32(n: Column) -> Column:
    """Four bytes, least first."""
    return _le(n.bitwiseAND(F.lit(MASK)), 4)


def fixed64(n: Column) -> Column:
    return _le(n, 8)


def read_fixed(data: Column, size: int = 4) -> Column:
    hexed = F.hex(F.substring(data, 1, size))
    return F.when(F.octet_length(data) >= size, F.conv(F.concat(*[F.substring(hexed, 2 * (size - i) - 1, 2) for i in range(size)]), 16, 10).cast("decimal(20,0)").cast("long"))


def varint_length(n: Column) -> Column:
    """Bytes of a varint: seven bits a byte."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(n >= F.lit(1 << (7 * k)), 1).otherwise(0)
    return F.when(n < 0, 10).otherwise(size)


def varint(n: Column) -> Column:
    """Seven bits a byte, least first, the top bit set on all but the last; a negative n stands for n + 2 ** 64."""
    part = lambda i: F.call_function("shiftrightunsigned", n, 7 * i).bitwiseAND(F.lit(127))
    byte = lambda size, i: F.lpad(F.hex(part(i) + F.when(i + 1 < size, 128).otherwise(0)), 2, "0")
    return _once(varint_length(n), lambda size: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: byte(size, i)), "")))


def read_varint(data: Column) -> Column:
    """struct(value, size) of the varint that data begins with; null if it is cut short or longer than ten bytes.

    A value of 2 ** 63 or more, ten bytes long, comes as the signed number of the same bits.
    """
    return _once(F.hex(F.substring(data, 1, 10)), _varint_hex)


def _varint_hex(hexed: Column) -> Column:
    ends = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.length(hexed) > 2 * i) & (F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long") < 128)), True).cast("int")
    value = F.aggregate(F.sequence(F.lit(0), F.greatest(ends - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)), 7 * i)))
    return F.when(ends > 0, F.struct(value.alias("value"), ends.alias("size")))


def length_prefixed(data: Column) -> Column:
    return F.concat(varint(F.octet_length(data).cast("long")), data)


def read_length_prefixed(data: Column) -> Column:
    """The bytes behind a length prefix; null if they are cut short."""
    body = lambda d, head: F.when(F.octet_length(d) >= head["size"] + head["value"], F.substring(d, head["size"] + 1, head["value"].cast("int")))
    return _once(data, lambda d: _once(read_varint(d), lambda head: body(d, head)))


def block_handle(offset: Column, size: Column) -> Column:
    return F.concat(varint(offset), varint(size))


def footer(metaindex: Column, index: Column) -> Column:
    """48 bytes: two handles padded to 20 each, and the magic number."""
    pad = lambda h: F.unhex(F.rpad(F.hex(h), 40, "0"))
    return F.concat(pad(metaindex), pad(index), F.lit(bytearray(TABLE_MAGIC.to_bytes(8, "little"))))


def read_handle(data: Column) -> Column:
    """struct(offset, size, length) of the handle that data begins with; null if it is cut short."""
    rest = lambda d, head: _once(read_varint(F.substring(d, head["size"] + 1, F.lit(10))), lambda two: F.when(two.isNotNull(), F.struct(head["value"].alias("offset"), two["value"].alias("size"), (head["size"] + two["size"]).alias("length"))))
    return _once(data, lambda d: _once(read_varint(d), lambda head: rest(d, head)))


def read_footer(data: Column) -> Column:
    """struct(metaindex, index), two handles; null if data has not 48 bytes that end in the magic number."""
    whole = (F.octet_length(data) == 48) & (F.substring(data, 41, 8) == F.lit(bytearray(TABLE_MAGIC.to_bytes(8, "little"))))
    return F.when(whole, F.struct(read_handle(F.substring(data, 1, 20)).alias("metaindex"), read_handle(F.substring(data, 21, 20)).alias("index")))


def encode_entry(kind: Column, k: Column, v: Column) -> Column:
    """An operation of a batch: type, and length-prefixed key and value (no value for a deletion)."""
    head = F.concat(F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), length_prefixed(k))
    return F.when(v.isNull(), head).otherwise(F.concat(head, length_prefixed(F.coalesce(v, F.lit(b"").cast("binary")))))


def encode_batches(ops: DataFrame, batch: str = "batch_id", index: str = "op_idx") -> DataFrame:
    """batch, count, size, data: each batch as its header (first sequence number, count) and its operations in order.

    A batch is written and read whole, so it is the unit that has to fit into memory.
    """
    rows = F.array_sort(F.collect_list(F.struct(index, encode_entry(F.col("type"), F.col("k"), F.col("v")).alias("data"))))
    held = ops.groupBy(batch).agg(F.min("seq").alias("first"), F.count("*").alias("count"), rows.alias("rows"))
    data = F.concat(fixed64(F.col("first")), fixed32(F.col("count")), F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["data"])), "")))
    return held.select(batch, "count", data.alias("data")).withColumn("size", F.octet_length("data"))


def decode_batches(batches: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, op_idx, seq, type, k, v of encoded batches, in the order they have; rows of a torn batch are missing from where it is torn."""
    import struct

    def varint_at(data: bytes, at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n, at

    def part(data: bytes, at: int) -> tuple[bytes, int]:
        n, at = varint_at(data, at)
        if at + n > len(data):
            raise IndexError
        return data[at : at + n], at + n

    def run(batches):
        for held in batches:
            out = []
            for name, data in zip(held.column(0).to_pylist(), held.column(1).to_pylist()):
                if len(data) < 12:
                    continue
                (first, count), at = struct.unpack("<QI", data[:12]), 12
                try:
                    for i in range(count):
                        kind = data[at]
                        k, at = part(data, at + 1)
                        v, at = part(data, at) if kind == 1 else (None, at)
                        out.append((name, i, first + i, kind, k, v))
                except IndexError:
                    pass
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=[batch, "op_idx", "seq", "type", "k", "v"])

    return batches.select(F.col(batch).cast("long").alias(batch), "data").mapInArrow(run, f"{batch} long, op_idx int, seq long, type int, k binary, v binary")


def entry_size(k: Column, v: Column) -> Column:
    """Bytes of an encoded entry: type, and length-prefixed key and value (no value for a deletion)."""
    part = lambda x: varint_length(F.octet_length(x)) + F.octet_length(x)
    return (F.lit(1) + part(k) + F.when(v.isNull(), 0).otherwise(part(v))).cast("long")


def sst_name(number: Column) -> Column:
    return F.format_string("%d.sst", number)


def manifest_name(number: Column) -> Column:
    return F.format_string("MANIFEST-%06d", number)


# Bloom filters


def bloom_bits(n: int, fpr: float = 0.01) -> int:
    """Bits for n keys at a false-positive rate; no keys are sized as 10,000."""
    return int(-(n or 10_000) * math.log(fpr) / math.log(2) ** 2)


def bloom_probes(fpr: float = 0.01) -> int:
    return max(1, math.floor(math.log2(1 / fpr)))


def bloom_bits_col(n: Column, fpr: float = 0.01) -> Column:
    return F.floor(-F.when(n == 0, 10_000).otherwise(n) * F.log(F.lit(fpr)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long")


def bloom_probes_col(fpr: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.log2(1 / fpr)).cast("int"))


def bloom_positions(data: Column, bits: Column | int, probes: int) -> Column:
    """The bits that a key sets: double hashing, the step being the hash turned right by 17."""
    m = F.lit(bits) if isinstance(bits, int) else bits
    step = lambda h: F.shiftrightunsigned(h, 17) + F.shiftleft(h.bitwiseAND(F.lit(0x1FFFF)), 15)
    return _once(hash32(data, BLOOM_SEED), lambda h: F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: ((h + i * step(h)).bitwiseAND(F.lit(MASK))) % m))


def bloom_build(keys: DataFrame, by: list[str], bits: int, probes: int) -> DataFrame:
    """The set bits of one filter per group: by, pos. Map-side distinct; at most bits rows a group."""
    return keys.select(*by, F.explode(bloom_positions(F.col("k"), bits, probes)).alias("pos")).distinct()


def bloom_probe(keys: DataFrame, filters: DataFrame, by: list[str], bits: int, probes: int) -> DataFrame:
    """keys (with by) and may_contain: whether all of a key's bits are set in its group's filter."""
    asked = keys.withColumn("pos", F.explode(F.array_distinct(bloom_positions(F.col("k"), bits, probes))))
    hit = asked.join(filters.withColumn("is_set", F.lit(True)), [*by, "pos"], "left")
    return hit.groupBy(*keys.columns).agg(F.min(F.coalesce("is_set", F.lit(False))).alias("may_contain"))


def bloom_pack(positions: DataFrame, by: list[str], bits: int, probes: int) -> DataFrame:
    """One row a filter: by, num_bits, num_probes, bits (bytes, least bit first). positions: by, pos; combined in words of 32 bits, map-side."""
    words = positions.groupBy(*by, F.expr("pos div 32").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 32).cast("int"))).alias("x"))
    held = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    data = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit((bits - 1) // 32).cast("long")), lambda w: F.hex(fixed32(F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))))), "")
    return held.select(*by, F.lit(bits).cast("long").alias("num_bits"), F.lit(probes).alias("num_probes"), F.unhex(data).alias("bits"))


def bloom_contains(bits: Column, data: Column, num_bits: int, probes: int) -> Column:
    """Whether all of a key's bits are set in a packed filter."""
    byte = lambda p: F.conv(F.hex(F.substring(bits, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.forall(bloom_positions(data, num_bits, probes), lambda p: F.call_function("shiftright", byte(p), (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)


# Blocks of a sorted run


def shared_prefix(k: Column, previous: Column) -> Column:
    """Leading bytes in common, as characters of a string column or bytes of a binary one."""
    n = F.least(F.octet_length(k), F.octet_length(previous))
    same = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda j: F.substring(k, F.lit(1), j) == F.substring(previous, F.lit(1), j))
    return F.coalesce(F.size(same), F.lit(0))


def prefix_compressed(run: DataFrame, by: str = "number", restart: int = 16) -> DataFrame:
    """k of sorted runs (one per by) with shared and unshared key bytes; every restart-th key is kept whole."""
    w = Window.partitionBy(by).orderBy("k")
    at = run.withColumn("i", F.row_number().over(w)).withColumn("prev", F.lag("k").over(w))
    shared = F.when((F.col("i") - 1) % restart == 0, 0).otherwise(shared_prefix(F.col("k"), F.col("prev")))
    return at.select(by, "k", "i", shared.alias("shared")).withColumn("unshared", F.octet_length("k") - F.col("shared"))


def block_index(run: DataFrame, by: str = "number", block_size: int = 4096) -> DataFrame:
    """The sparse index of sorted runs: by, block_id, offset, size, last_key, n_entries. A block holds block_size bytes of entries."""
    size = entry_size(F.col("k"), F.col("v"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = run.withColumn("b", size).withColumn("before", before).withColumn("block_id", F.expr(f"before div {block_size}L").cast("int"))
    blocks = cut.groupBy(by, "block_id").agg(F.min("before").alias("offset"), F.sum("b").alias("size"), F.max("k").alias("last_key"), F.count("*").alias("n_entries"))
    return blocks


def approximate_offset(probes: DataFrame, index: DataFrame, by: str = "number") -> DataFrame:
    """k, by, offset for probes (k, by): where in its run a key would lie; behind all blocks, the run's size.

    The least last_key at or after the probe is found by sorting probes and blocks of a run together, from the greatest key
    down, so that a frame only grows.
    """
    ends = index.groupBy(by).agg(F.max(F.col("offset") + F.col("size")).alias("total"))
    blocks = index.select(by, F.col("last_key").alias("k"), "offset", F.lit(0).alias("is_probe"))
    both = blocks.unionByName(probes.select(by, "k").distinct().withColumns({"offset": F.lit(None).cast("long"), "is_probe": F.lit(1)}))
    ahead = Window.partitionBy(by).orderBy(F.col("k").desc(), F.col("is_probe").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("at", F.last("offset", True).over(ahead)).filter("is_probe = 1")
    return found.join(ends, by).select("k", by, F.coalesce("at", "total").alias("offset"))
