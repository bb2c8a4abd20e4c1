"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine, Options
from ..functions import codec
from ..operators import compaction, cursor, metrics
from ..operators.latest import latest, live, merged, snapshot_diff, tombstones, version_counts
from ..operators.ops import batch_last_ops, synthetic_ops
from ..sources.catalog import VersionEdit, file_prune, fold_edits, obsolete_files
from ..sources.iterator import SyntheticSource
from ..sources.runs import dump_run
from ..sources.shared import work_folder
from ..sources.wal import log_entries
from ..streaming.upsert import append_runs, append_view, upsert_view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

OPS_SQL = """ops as (select concat('user_', cast(user_id as varchar)) as k, event_id as seq,
    case when event_type = 'error' then 0 else 1 end as type,
    case when event_type = 'error' then null
         else concat(event_type, ':', cast(cast(round(value * 100) as bigint) as varchar)) end as v
    from events)"""
LATEST_SQL = f"{OPS_SQL}, r as (select *, row_number() over (partition by k order by seq desc) as rn from ops), cur as (select k, seq, type, v from r where rn = 1), live as (select k, seq, v from cur where type = 1)"


def _varint_sql(x: str) -> str:
    return f"(case when {x} < 128 then 1 when {x} < 16384 then 2 when {x} < 2097152 then 3 when {x} < 268435456 then 4 else 5 end)"


_K, _V = "octet_length(encode(k))", "octet_length(encode(v))"
BYTES_SQL = f"(1 + {_varint_sql(_K)} + {_K} + case when v is null then 0 else {_varint_sql(_V)} + {_V} end)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def events_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an op log: an error deletes its user, any other event is the user's newest value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    error = F.col("event_type") == "error"
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("k"), F.col("event_id").alias("seq"), F.when(error, 0).otherwise(1).alias("type"), F.when(~error, F.concat(F.col("event_type"), F.lit(":"), cents)).alias("v"))


def files_of(ops: DataFrame, width: int = 1000) -> DataFrame:
    return ops.withColumn("number", F.expr(f"seq div {width}L"))


PROBES_SQL = "probes as (select concat('user_', cast(i as varchar)) as k from range(0, 400, 7) t(i))"


def probes(spark: SparkSession) -> DataFrame:
    return spark.range(0, 400, 7).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("k"))


@query(f"with {LATEST_SQL} select k, seq, v from live")
def kv_current(spark, sf_dir):
    return live(events_ops(spark, sf_dir))


@query(f"with {LATEST_SQL}, {PROBES_SQL} select p.k, l.k is not null as found, l.v from probes p left join live l on p.k = l.k")
def kv_multi_get(spark, sf_dir):
    return cursor.multi_get(events_ops(spark, sf_dir), probes(spark))


@query(f"with {LATEST_SQL} select k, seq, v from live where k = 'user_7'")
def kv_get(spark, sf_dir):
    return cursor.get(events_ops(spark, sf_dir), "user_7")


@query(f"with {LATEST_SQL} select k, seq, v from live where k >= 'user_2' and k < 'user_5'")
def kv_scan_range(spark, sf_dir):
    return cursor.scan(events_ops(spark, sf_dir), "user_2", "user_5", ordered=False)


@query(f"with {LATEST_SQL} select k, seq, v from live where starts_with(k, 'user_1')")
def kv_prefix(spark, sf_dir):
    return cursor.scan(events_ops(spark, sf_dir), prefix="user_1", ordered=False)


@query(f"with {LATEST_SQL}, {PROBES_SQL} select p.k, (select min(l.k) from live l where l.k >= p.k) as at from probes p")
def kv_seek_ge(spark, sf_dir):
    return cursor.multi_seek(events_ops(spark, sf_dir), probes(spark))


@query(f"with {LATEST_SQL}, {PROBES_SQL} select p.k, (select max(l.k) from live l where l.k < p.k) as at from probes p")
def kv_seek_lt(spark, sf_dir):
    return cursor.multi_seek(events_ops(spark, sf_dir), probes(spark), before=True)


@query(f"with {LATEST_SQL} select min(k) as first_k, max(k) as last_k, arg_min(v, k) as first_v, arg_max(v, k) as last_v from live")
def kv_first_last(spark, sf_dir):
    return live(events_ops(spark, sf_dir)).agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.min_by("v", "k").alias("first_v"), F.max_by("v", "k").alias("last_v"))


@query(f"with {LATEST_SQL} select k, lag(k) over (order by k) as prev_k, lead(k) over (order by k) as next_k from live")
def kv_neighbors(spark, sf_dir):
    return cursor.neighbours(events_ops(spark, sf_dir))


@query(f"with {LATEST_SQL} select k, seq, v from live order by k desc limit 10")
def kv_reverse_top(spark, sf_dir):
    return cursor.scan(events_ops(spark, sf_dir), reverse=True, limit=10)


@query(f"with {LATEST_SQL} select k from live")
def kv_keys_only(spark, sf_dir):
    return cursor.scan(events_ops(spark, sf_dir), keys_only=True, ordered=False)


@query(f"with {OPS_SQL}, r as (select *, row_number() over (partition by k order by seq desc) as rn from ops where seq <= 5000) select k, seq, v from r where rn = 1 and type = 1")
def kv_snapshot(spark, sf_dir):
    return live(events_ops(spark, sf_dir), 5000)


@query(
    f"""with {LATEST_SQL}, r0 as (select *, row_number() over (partition by k order by seq desc) as rn from ops where seq <= 5000),
    old as (select k, seq, v from r0 where rn = 1 and type = 1)
    select * from (select coalesce(o.k, n.k) as k,
        case when n.k is null then 'delete' when o.k is null then 'insert' when o.seq <> n.seq then 'update' end as change,
        o.v as old_v, n.v as new_v from old o full join live n on o.k = n.k) where change is not null"""
)
def kv_snapshot_diff(spark, sf_dir):
    return snapshot_diff(events_ops(spark, sf_dir), 5000)


@query(
    f"""with {OPS_SQL}, b as (select *, seq // 100 as batch_id, seq % 100 as op_idx from ops),
    r as (select *, row_number() over (partition by batch_id, k order by op_idx desc) as rn, count(*) over (partition by batch_id, k) as n_ops from b)
    select batch_id, k, type, v, n_ops from r where rn = 1"""
)
def kv_batch_apply(spark, sf_dir):
    ops = events_ops(spark, sf_dir).withColumn("batch_id", F.expr("seq div 100L")).withColumn("op_idx", F.col("seq") % 100)
    return batch_last_ops(ops)


@query(f"with {LATEST_SQL} select k, seq from cur where type = 0")
def kv_tombstones(spark, sf_dir):
    return tombstones(events_ops(spark, sf_dir))


@query(f"with {OPS_SQL} select k, count(*) as n_versions, cast(sum(1 - type) as bigint) as n_deletes, max(seq) as last_seq from ops group by k")
def kv_version_count(spark, sf_dir):
    return version_counts(events_ops(spark, sf_dir))


FILES_SQL = f"f as (select seq // 1000 as number, count(*) as num_entries, cast(sum({BYTES_SQL}) as bigint) as file_size, min(k) as smallest, max(k) as largest, min(seq) as min_seq, max(seq) as max_seq from ops group by 1)"


@query(f"with {OPS_SQL}, {FILES_SQL} select * from f")
def kv_flush_files(spark, sf_dir):
    return compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"])


@query(
    f"""with {OPS_SQL}, s as (select *, {BYTES_SQL} as bytes from ops), c as (select *, sum(bytes) over (order by seq) as upto from s)
    select cast((upto - bytes) // 32768 as bigint) as run, count(*) as num_entries, cast(sum(bytes) as bigint) as bytes, min(seq) as min_seq, max(seq) as max_seq from c group by 1"""
)
def kv_memtable_cut(spark, sf_dir):
    cut = compaction.memtable_cut(events_ops(spark, sf_dir), 32768)
    return cut.groupBy("run").agg(F.count("*").alias("num_entries"), F.sum("bytes").alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


@query(f"with {OPS_SQL}, {FILES_SQL}, {PROBES_SQL} select p.k, count(*) as n_files from probes p join f on p.k between f.smallest and f.largest group by p.k")
def kv_file_prune(spark, sf_dir):
    files = compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"])
    return file_prune(probes(spark), files).groupBy("k").agg(F.count("*").alias("n_files"))


_LEVEL = "case when number >= 8 then 0 when number >= 4 then 1 else 2 end"


@query(f"with {OPS_SQL}, g as (select *, seq // 1000 as number from ops), l as (select *, {_LEVEL} as level from g), r as (select *, row_number() over (partition by k order by level, number desc, seq desc) as rn from l) select k, seq, level, number, v from r where rn = 1 and type = 1")
def kv_leveled_get(spark, sf_dir):
    ops = files_of(events_ops(spark, sf_dir)).withColumn("level", F.expr(_LEVEL))
    return cursor.leveled_get(ops).filter("type = 1").select("k", "seq", "level", "number", "v")


@query(f"with {OPS_SQL}, r as (select *, row_number() over (partition by k order by seq desc) as rn from ops where seq // 1000 <= (select max(seq) // 2000 from ops)) select k, seq, type, v from r where rn = 1")
def kv_compact_l0(spark, sf_dir):
    """The older half of the files, as many as the table has."""
    files = files_of(events_ops(spark, sf_dir))
    half = files.agg(F.expr("max(seq) div 2000L")).first()[0]
    return compaction.compacted(files.filter(F.col("number") <= half).drop("number"), bottom=False)


@query(f"with {LATEST_SQL} select k, seq, type, v from cur where type = 1")
def kv_compact_bottom(spark, sf_dir):
    return compaction.compacted(events_ops(spark, sf_dir), bottom=True)


@query(
    f"""with {OPS_SQL}, r as (select *, row_number() over (partition by k, case when seq <= 3000 then 0 when seq <= 7000 then 1 else 2 end order by seq desc) as rn from ops)
    select k, seq, type, v from r where rn = 1"""
)
def kv_compact_pinned(spark, sf_dir):
    return compaction.compacted(events_ops(spark, sf_dir), bottom=False, pinned=[3000, 7000])


_PICK_FILES = "case when number < 3 then 1 when number < 7 then 2 else 3 end"


@query(
    f"""with {OPS_SQL}, {FILES_SQL}, l as (select {_PICK_FILES} as level, number, file_size * 1500 as file_size from f),
    t(level, target) as (values (0, 0), (1, 10485760), (2, 104857600), (3, 1073741824)),
    s as (select l.level, sum(file_size) as total, min(number) as first_number from l group by l.level),
    d as (select s.level, s.first_number from s join t using (level) where s.level = 0 or s.total > t.target order by s.level limit 1)
    select l.level, l.number from l join d using (level) where l.level = 0 or l.number = d.first_number"""
)
def kv_pick_compaction(spark, sf_dir):
    files = compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"])
    leveled = files.select(F.expr(_PICK_FILES).alias("level"), "number", (F.col("file_size") * 1500).alias("file_size"))
    return compaction.pick_compaction(leveled)


EDITS_SQL = f"""{FILES_SQL}, e as (
    select number as edit_id, 'add' as event, 0 as level, number, file_size from f
    union all select 1000 + number, 'delete', 0, number, file_size from f where number % 3 = 0
    union all select 1000 + number, 'add', 1, number + 100, file_size from f where number % 3 = 0),
    w as (select *, row_number() over (partition by level, number order by edit_id desc) as rn from e)"""


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"]).select("number", "file_size")
    third = f.filter("number % 3 = 0")
    row = lambda df, edit, event, level, number: df.select(F.expr(edit).alias("edit_id"), F.lit(event).alias("event"), F.lit(level).alias("level"), F.expr(number).alias("number"), "file_size")
    return row(f, "number", "add", 0, "number").unionByName(row(third, "1000 + number", "delete", 0, "number")).unionByName(row(third, "1000 + number", "add", 1, "number + 100"))


@query(f"with {OPS_SQL}, {EDITS_SQL} select level, number, edit_id, file_size from w where rn = 1 and event = 'add'")
def kv_live_files(spark, sf_dir):
    return fold_edits(edit_events(spark, sf_dir))


@query(f"with {OPS_SQL}, {EDITS_SQL} select distinct number from e where number not in (select number from w where rn = 1 and event = 'add')")
def kv_obsolete_files(spark, sf_dir):
    events = edit_events(spark, sf_dir)
    return obsolete_files(events.select("number").distinct(), fold_edits(events))


BLOCKS_SQL = f"""u as (select seq // 1000 as number, k, seq, v, {BYTES_SQL} as b, row_number() over (partition by seq // 1000, k order by seq desc) as rn from ops),
    s as (select number, k, b, coalesce(sum(b) over (partition by number order by k rows between unbounded preceding and 1 preceding), 0) as before from u where rn = 1),
    blk as (select number, cast(before // 512 as integer) as block_id, cast(min(before) as bigint) as "offset", cast(sum(b) as bigint) as size, max(k) as last_key, count(*) as n_entries from s group by 1, 2)"""


def runs_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("seq", "v"), "seq").alias("x")
    return files_of(events_ops(spark, sf_dir)).groupBy("number", "k").agg(newest).select("number", "k", "x.seq", "x.v")


@query(f"with {OPS_SQL}, {BLOCKS_SQL} select * from blk")
def kv_block_index(spark, sf_dir):
    return codec.block_index(runs_by_file(spark, sf_dir), block_size=512)


@query(
    f"""with {OPS_SQL}, {BLOCKS_SQL}, {PROBES_SQL}, ends as (select number, max("offset" + size) as total from blk group by number)
    select p.k, e.number, coalesce((select min(b."offset") from blk b where b.number = e.number and b.last_key >= p.k), e.total) as "offset" from probes p, ends e where e.number = length(p.k) % 3"""
)
def kv_approx_offset(spark, sf_dir):
    index = codec.block_index(runs_by_file(spark, sf_dir), block_size=512)
    return codec.approximate_offset(probes(spark).withColumn("number", (F.length("k") % 3).cast("long")), index)


@query(
    f"""with {OPS_SQL}, d as (select distinct seq // 1000 as number, k from ops),
    o as (select *, row_number() over (partition by number order by k) as i, lag(k) over (partition by number order by k) as pk from d)
    select number, k, cast(i as integer) as i, cast(shared as integer) as shared, cast(length(k) - shared as integer) as unshared from (
    select *, case when (i - 1) % 16 = 0 then 0 else len(list_filter(range(1, strlen(k) + 1), lambda j: j <= length(pk) and substring(k, 1, j) = substring(pk, 1, j))) end as shared from o)"""
)
def kv_prefix_compress(spark, sf_dir):
    return codec.prefix_compressed(files_of(events_ops(spark, sf_dir)).select("number", "k").distinct())


@query(f"with {OPS_SQL} select seq, {_varint_sql('seq')} as n_seq, {_varint_sql('seq * 1000')} as n_big, {BYTES_SQL} as entry_bytes from ops")
def kv_varint_len(spark, sf_dir):
    ops = events_ops(spark, sf_dir)
    return ops.select("seq", codec.varint_length(F.col("seq")).alias("n_seq"), codec.varint_length(F.col("seq") * 1000).alias("n_big"), codec.entry_size(F.col("k"), F.col("v")).alias("entry_bytes"))


@query(f"with {OPS_SQL}, {FILES_SQL} select number, cast(floor(-(case when num_entries = 0 then 10000 else num_entries end) * ln(0.01) / (ln(2.0) * ln(2.0))) as bigint) as num_bits, 6 as num_probes from f")
def kv_bloom_params(spark, sf_dir):
    files = compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"])
    return files.select("number", codec.bloom_bits_col(F.col("num_entries")).alias("num_bits"), codec.bloom_probes_col(F.lit(0.01)).alias("num_probes"))


BLOOM_BITS, BLOOM_PROBES = codec.bloom_bits(1000), codec.bloom_probes()


def _hash_sql(seed: int) -> str:
    """The 32-bit hash of k, whose characters are one byte each."""
    at = lambda i: f"ascii(substring(k, {i}, 1))::hugeint"
    mul = lambda x: f"(({x} & {codec.MASK}) * {codec.HASH_M} & {codec.MASK})"
    word = f"{at('4 * i + 1')} + ({at('4 * i + 2')} << 8) + ({at('4 * i + 3')} << 16) + ({at('4 * i + 4')} << 24)"
    words = f"list_transform(range(0, strlen(k) // 4), lambda i: {word})"
    body = f"list_reduce({words}, lambda h, x: xor({mul('(h + x)')}, {mul('(h + x)')} >> 16), xor({seed}::hugeint, (strlen(k)::hugeint * {codec.HASH_M}) & {codec.MASK}))"
    first = "strlen(k) // 4 * 4 + 1"
    tail = " + ".join(f"case when strlen(k) % 4 > {j} then {at(f'{first} + {j}')} << {8 * j} else 0 end" for j in range(3))
    return f"(select case when strlen(k) % 4 = 0 then b else xor({mul('(b + t)')}, {mul('(b + t)')} >> {codec.HASH_R}) end::bigint from (select {body} as b, {tail} as t))"


BLOOM_SQL = f"""hk as (select k, {_hash_sql(codec.BLOOM_SEED)} as h from (select distinct k from ops union select k from probes)),
    pos as (select k, list_transform(range(0, {BLOOM_PROBES}), lambda i: ((h::hugeint + i * ((h >> 17) + ((h & 131071) << 15))) & {codec.MASK}) % {BLOOM_BITS}) as ps from hk),
    member as (select distinct seq // 1000 as number, k from ops),
    bits as (select distinct number, unnest(ps) as pos from member join pos using (k))"""


@query(f"with {OPS_SQL}, {PROBES_SQL}, {BLOOM_SQL} select k, array_to_string(ps, ',') as positions from pos")
def kv_bloom_positions(spark, sf_dir):
    keys = events_ops(spark, sf_dir).select("k").union(probes(spark)).distinct()
    return keys.select("k", F.array_join(codec.bloom_positions(F.col("k").cast("binary"), BLOOM_BITS, BLOOM_PROBES).cast("array<string>"), ",").alias("positions"))


def _filters(spark, sf_dir, keys: DataFrame | None = None, by: tuple = ("number",)) -> DataFrame:
    keys = files_of(events_ops(spark, sf_dir)).select("number", "k").distinct() if keys is None else keys
    return codec.bloom_build(keys.withColumn("k", F.col("k").cast("binary")), list(by), BLOOM_BITS, BLOOM_PROBES)


@query(
    f"""with {OPS_SQL}, {PROBES_SQL}, {BLOOM_SQL}, f as (select number, list(pos) as held from bits group by number)
    select p.k, f.number, list_has_all(held, ps) as may_contain, exists (select 1 from member m where m.number = f.number and m.k = p.k) as there from probes p join pos using (k), f"""
)
def kv_bloom_probe(spark, sf_dir):
    """Each probe against each file's packed filter, and whether the key is there."""
    packed = codec.bloom_pack(_filters(spark, sf_dir), ["number"], BLOOM_BITS, BLOOM_PROBES)
    there = files_of(events_ops(spark, sf_dir)).select("number", "k").distinct().withColumn("there", F.lit(True))
    asked = probes(spark).crossJoin(packed)  # the stated probes, in each file
    return asked.select("k", "number", codec.bloom_contains(F.col("bits"), F.col("k").cast("binary"), BLOOM_BITS, BLOOM_PROBES).alias("may_contain")).join(there, ["number", "k"], "left").select("k", "number", "may_contain", F.coalesce("there", F.lit(False)).alias("there"))


@query(
    f"""with {OPS_SQL}, {PROBES_SQL}, {BLOOM_SQL}, w as (select number, pos // 8 as byte_no, cast(sum(1 << (pos % 8)::int) as bigint) as x from bits group by 1, 2),
    n as (select distinct number from member), every as (select n.number, byte_no from n, range(0, {(BLOOM_BITS + 31) // 32 * 4}) r(byte_no))
    select number, {BLOOM_BITS}::bigint as num_bits, {BLOOM_PROBES} as num_probes, string_agg(lpad(hex(coalesce(x, 0)::bigint), 2, '0'), '' order by byte_no) as bits from every left join w using (number, byte_no) group by number"""
)
def kv_bloom_serde(spark, sf_dir):
    return codec.bloom_pack(_filters(spark, sf_dir), ["number"], BLOOM_BITS, BLOOM_PROBES).withColumn("bits", F.hex("bits"))


@query(
    f"""with {OPS_SQL}, {PROBES_SQL}, {BLOOM_SQL}, u as (select seq // 1000 as number, k, {BYTES_SQL} as b, row_number() over (partition by seq // 1000, k order by seq desc) as rn from ops),
    s as (select number, k, coalesce(sum(b) over (partition by number order by k rows between unbounded preceding and 1 preceding), 0) // 2048 as part from u where rn = 1)
    select number, cast(part as bigint) as part, count(distinct k) as n_keys, count(distinct p) as n_bits from (select number, part, k, unnest(ps) as p from s join pos using (k)) group by all"""
)
def kv_bloom_blocks(spark, sf_dir):
    """A filter for each 2,048 bytes of a run's offsets: its keys and how many bits they set."""
    runs = runs_by_file(spark, sf_dir).withColumn("block_bytes", codec.entry_size(F.col("k"), F.col("v")))
    before = F.coalesce(F.sum("block_bytes").over(Window.partitionBy("number").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = runs.select("number", "k", F.floor(before / 2048).alias("part"))
    bits = _filters(spark, sf_dir, keys, ("number", "part")).groupBy("number", "part").agg(F.count("*").alias("n_bits"))
    return keys.groupBy("number", "part").agg(F.count("*").alias("n_keys")).join(bits, ["number", "part"])


def _crc_sql(x: str) -> str:
    """The checksum of x, text whose characters are one byte each, or a list of bytes."""
    held = f"list_transform(range(0, strlen({x})), lambda i: ascii(substring({x}, i + 1, 1))::bigint)" if not x.startswith("[") else x[1:-1]
    bits = f"flatten(list_transform({held}, lambda y: list_transform(range(0, 8), lambda j: (y >> j) & 1)))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, case when (xor(c, b) & 1) = 1 then 3988292384 else 0 end), {codec.MASK}::bigint), {codec.MASK}::bigint)"


@query(f"with {OPS_SQL}, d as (select seq, concat(k, '=', coalesce(v, '')) as x from ops), y as (select seq, list_transform(range(0, strlen(x)), lambda i: ascii(substring(x, i + 1, 1))::bigint) as b from d) select seq, {_crc_sql('[b]')} as crc, {_crc_sql('[list_append(b, 0::bigint)]')} as block_crc from y")
def kv_crc32(spark, sf_dir):
    ops = events_ops(spark, sf_dir)
    data = F.concat_ws("=", "k", F.coalesce("v", F.lit(""))).cast("binary")
    return ops.select("seq", codec.crc32(data).alias("crc"), codec.block_crc(data).alias("block_crc"))


@query(f"with {OPS_SQL}, d as (select distinct k from ops), h as (select k, {_hash_sql(0)} as h, {_hash_sql(codec.BLOOM_SEED)} as bloom_h from d) select k, h, bloom_h, h >> 28 as shard from h")
def kv_hash(spark, sf_dir):
    return events_ops(spark, sf_dir).select("k").distinct().select("k", codec.hash32(F.col("k").cast("binary")).alias("h"), codec.hash32(F.col("k").cast("binary"), codec.BLOOM_SEED).alias("bloom_h"), codec.cache_shard(F.col("k").cast("binary")).alias("shard"))


@query(f"with {OPS_SQL} select seq, upper(hex(encode(k))) as key_hex, {_varint_sql('seq')} as prefix_size, seq as value from ops")
def kv_codec_roundtrip(spark, sf_dir):
    ops = events_ops(spark, sf_dir)
    wire = codec.length_prefixed(F.col("k").cast("binary"))
    number = codec.read_varint(codec.varint(F.col("seq")))
    return ops.select("seq", F.hex(codec.read_length_prefixed(wire)).alias("key_hex"), number["size"].alias("prefix_size"), number["value"].alias("value"))


@query(
    f"""with {OPS_SQL}, t as (select case when type = 1 then 'write' else 'read' end as kind, seq % 97 as ns, seq % 3 = 0 as hit from ops)
    select count(*) filter (kind = 'read') as reads, count(*) filter (kind = 'write') as writes,
    cast(sum(ns) filter (kind = 'read') as bigint) as read_ns, cast(sum(ns) filter (kind = 'write') as bigint) as write_ns,
    coalesce(count(*) filter (hit) / nullif(count(*), 0), 0.0) as hit_rate from t"""
)
def kv_metrics(spark, sf_dir):
    ops = events_ops(spark, sf_dir)
    trace = ops.select(F.when(F.col("type") == 1, "write").otherwise("read").alias("kind"), (F.col("seq") % 97).alias("ns"), (F.col("seq") % 3 == 0).alias("hit"))
    return metrics.trace_metrics(trace)


@query(f"with {LATEST_SQL}, a as (select cast(sum({BYTES_SQL}) as bigint) as u from ops), b as (select cast(sum({BYTES_SQL}) as bigint) as c from cur) select u as user_bytes, c as compacted_bytes, coalesce((u + c) / nullif(u, 0), 1.0) as write_amplification from a, b")
def kv_write_amplification(spark, sf_dir):
    size = F.sum(codec.entry_size(F.col("k"), F.col("v")))
    ops = events_ops(spark, sf_dir)
    both = ops.agg(size.alias("user_bytes")).join(latest(ops).agg(size.alias("compacted_bytes")))  # a row each
    return both.withColumn("write_amplification", metrics.ratio(F.col("user_bytes") + F.col("compacted_bytes"), F.col("user_bytes"), 1.0))


@query("select concat('key_', cast(o_orderkey as varchar)) as k, o_orderkey as seq, concat(o_orderstatus, ':', cast(cast(round(o_totalprice * 100) as bigint) as varchar)) as v from orders where concat('key_', cast(o_orderkey as varchar)) >= 'key_2' and concat('key_', cast(o_orderkey as varchar)) < 'key_7'")
def kv_orders_store(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    ops = o.select(F.concat(F.lit("key_"), F.col("o_orderkey").cast("string")).alias("k"), F.col("o_orderkey").alias("seq"), F.lit(1).alias("type"), F.concat("o_orderstatus", F.lit(":"), cents).alias("v"))
    return cursor.scan(ops, "key_2", "key_7", ordered=False)


@query("select concat('key_', cast(i as varchar)) as k, i + 1 as seq, 100 as n_bytes from range(0, 1000) t(i)")
def kv_synthetic(spark, sf_dir):
    return synthetic_ops(spark, 1000, 100).select(F.col("k").cast("string").alias("k"), "seq", F.octet_length("v").alias("n_bytes"))


@query(f"with {LATEST_SQL} select k, seq, v from live")
def kv_stream_upsert(spark, sf_dir):
    """The op log as a stream, appended by micro-batches to a log of runs, then resolved."""
    at = work_folder(spark, "stream")
    append_runs(events_stream(spark, sf_dir), f"{at}/log", f"{at}/state").awaitTermination()
    return live(spark.read.schema(events_ops(spark, sf_dir).schema).parquet(f"{at}/log"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op log of events as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    error = F.col("event_type") == "error"
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return stream.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("k"), F.col("event_id").alias("seq"), F.when(error, 0).otherwise(1).alias("type"), F.when(~error, F.concat(F.col("event_type"), F.lit(":"), cents)).alias("v"))


@query(f"with {LATEST_SQL} select k, seq, type, v from cur")
def kv_stream_state(spark, sf_dir):
    """The newest version of each key, kept in a stream's state; what micro-batches raised is resolved by seq."""
    at = work_folder(spark, "state")
    append_view(upsert_view(events_stream(spark, sf_dir)), f"{at}/view", f"{at}/state").awaitTermination()
    raised = spark.read.parquet(f"{at}/view")
    return latest(raised.select("k", "seq", "type", "v"))


# The engine, end to end: events as batches of a store in the shared folder

BATCHES = 4
BATCH_SQL = f"b as (select *, least({BATCHES - 1}, seq * {BATCHES} // (select max(seq) + 1 from ops)) as part from ops)"


def batches_of(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """events in BATCHES batches of the engine's kind, by ranges of their sequence numbers."""
    ops = events_ops(spark, sf_dir)
    top = ops.agg(F.max("seq")).first()[0] or 0
    part = F.least(F.lit(BATCHES - 1), F.expr(f"seq * {BATCHES} div {top + 1}"))
    rows = ops.select(F.col("seq").cast("int").alias("op_idx"), F.col("k").cast("binary").alias("k"), "type", F.col("v").cast("binary").alias("v"), part.alias("part"))
    return [rows.filter(F.col("part") == i).drop("part") for i in range(BATCHES)]


def loaded(spark: SparkSession, sf_dir: str, **options) -> Engine:
    db = Engine.open(spark, work_folder(spark, "store"), Options(**options))
    for batch in batches_of(spark, sf_dir):
        db.write_df(batch)
    return db


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("k", "v") if c in df.columns})


@query(f"with {LATEST_SQL} select k, seq + 1 as seq, v from live")
def kv_engine_reopen(spark, sf_dir):
    """Runs of level 0, read by another engine that knows the folder alone."""
    path = loaded(spark, sf_dir).path
    return shown(Engine.open(spark, path, Options(create_if_missing=False)).scan(ordered=False))


@query(f"with {LATEST_SQL} select k, seq + 1 as seq, v from live")
def kv_engine_replay(spark, sf_dir):
    """Nothing flushed: what another engine sees comes from the log."""
    db = Engine.open(spark, work_folder(spark, "store"))
    for batch in batches_of(spark, sf_dir):
        db.write_df(batch, log=True)
    return shown(Engine.open(spark, db.path).scan(ordered=False))


@query(f"with {OPS_SQL}, {BATCH_SQL} select cast(part as bigint) as record, count(*) as n, min(seq) + 1 as first_seq, max(seq) + 1 as last_seq from b group by part")
def kv_engine_log(spark, sf_dir):
    """The records of the log."""
    db = Engine.open(spark, work_folder(spark, "store"))
    for batch in batches_of(spark, sf_dir):
        db.write_df(batch, log=True)
    rows = log_entries(db.log).groupBy("record").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    order = {name: i for i, (_, _, name) in enumerate(db.log.records())}
    return rows.select(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("record")].cast("long").alias("record"), "n", "first_seq", "last_seq")


@query(f"with {LATEST_SQL} select k, seq + 1 as seq, v from live")
def kv_engine_layers(spark, sf_dir):
    """The last 100 operations wait in the memtable, half of them frozen; those before are in runs."""
    db = Engine.open(spark, work_folder(spark, "store"))
    ops = events_ops(spark, sf_dir)
    top = ops.agg(F.max("seq")).first()[0] or 0
    db.write_df(ops.filter(F.col("seq") <= top - 100).select(F.col("seq").cast("int").alias("op_idx"), F.col("k").cast("binary").alias("k"), "type", F.col("v").cast("binary").alias("v")))
    for i, r in enumerate(sorted(ops.filter(F.col("seq") > top - 100).collect(), key=lambda r: r["seq"])):  # 100 rows
        db.put(r["k"], r["v"]) if r["type"] else db.delete(r["k"])
        if i == 49:
            db.freeze()
    return shown(db.scan(ordered=False))


@query(f"with {LATEST_SQL}, s as (select *, {BYTES_SQL} as bytes from cur where type = 1), c as (select *, cast((sum(bytes) over (order by encode(k)) - bytes) // 1024 as bigint) as file from s) select file, count(*) as num_entries, cast(sum(bytes) as bigint) as file_size, min(k) as smallest, max(k) as largest, min(seq) + 1 as min_seq, max(seq) + 1 as max_seq from c group by file")
def kv_engine_compact(spark, sf_dir):
    """All of level 0 into level 1, deletions gone, cut into runs of 1,024 bytes: the catalogue's rows."""
    db = loaded(spark, sf_dir, target_file_bytes=1024)
    db.compact()
    files = sorted(db.catalog.version.files, key=lambda f: f.smallest)
    cut = spark.createDataFrame([(f.number, f.num_entries, f.file_size, f.smallest, f.largest, f.min_seq, f.max_seq) for f in files], "number long, num_entries long, file_size long, smallest string, largest string, min_seq long, max_seq long")
    before = F.sum("file_size").over(Window.orderBy("smallest").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    return cut.select(F.floor(F.coalesce(before, F.lit(0)) / 1024).alias("file"), "num_entries", "file_size", F.unhex("smallest").cast("string").alias("smallest"), F.unhex("largest").cast("string").alias("largest"), "min_seq", "max_seq")


@query(f"with {LATEST_SQL} select k, seq + 1 as seq, v from live")
def kv_engine_compacted_scan(spark, sf_dir):
    """The same keys after two compactions, obsolete runs removed, on a new engine."""
    db = loaded(spark, sf_dir, target_file_bytes=4096, level1_size=1)
    db.compact()
    db.compact()
    db.delete_obsolete()
    return shown(Engine.open(spark, db.path).scan(ordered=False))


@query(f"with {OPS_SQL}, {BATCH_SQL}, f as (select part, count(*) as n, min(k) as lo, max(k) as hi from b group by part) select cast(part + 2 as bigint) as edit_id, 'add' as event, 0 as level, cast(part + 2 as bigint) as number, n as num_entries, lo as smallest, hi as largest from f")
def kv_engine_manifest(spark, sf_dir):
    """The edit log, a row for each file added or deleted."""
    edits = loaded(spark, sf_dir).catalog.edits_df()
    return edits.withColumns({c: F.col(c).cast("string") for c in ("smallest", "largest")})


@query(f"with {OPS_SQL}, {BATCH_SQL} select cast(part + 2 as bigint) as edit_id, (select count(*) from b c where c.part <= b.part) as last_sequence, cast(part + 3 as bigint) as next_file_number, cast(part + 1 as bigint) as n_files from (select distinct part from b) b")
def kv_engine_versions(spark, sf_dir):
    """The counters and live files after each edit, edits encoded, decoded and folded."""
    catalog = loaded(spark, sf_dir).catalog
    versions = [(e, catalog.version_at(e)) for e, edit in catalog.edits() if VersionEdit.decode(edit.encode()) == edit and edit.added]
    return spark.createDataFrame([(e, v.last_sequence, v.next_file_number, len(v.live_files())) for e, v in versions], "edit_id long, last_sequence long, next_file_number long, n_files long")


@query(f"with {OPS_SQL}, {BATCH_SQL} select k, seq + 1 as seq, type, v from b where part = {BATCHES - 1}")
def kv_engine_dump(spark, sf_dir):
    """All entries of the newest run."""
    db = loaded(spark, sf_dir)
    number = max(f.number for f in db.catalog.version.files)
    rows = dump_run(spark, db.path, number).select("k", "v")
    held = db.ops().filter(F.col("seq") >= [f.min_seq for f in db.catalog.version.files if f.number == number][0])
    return shown(held.join(rows.distinct(), held["k"].eqNullSafe(rows["k"]) & held["v"].eqNullSafe(rows["v"]), "left_semi").select("k", "seq", "type", "v"))


@query(f"with {LATEST_SQL}, {PROBES_SQL}, c as (select k, row_number() over (order by k) as rn from live) select (select min(k) from live where k >= 'user_3') as at_or_after, (select max(k) from live where k < 'user_3') as before, (select min(k) from live) as first_k, (select max(k) from live) as last_k, exists (select 1 from live where k = 'user_7') as holds_7")
def kv_engine_seeks(spark, sf_dir):
    db = loaded(spark, sf_dir)
    db.compact()
    key = lambda df: next((bytes(r["k"]).decode() for r in df.collect()), None)  # noqa: E731  one row or none
    row = (key(db.seek("user_3")), key(db.seek_prev("user_3")), key(db.first()), key(db.last()), cursor.contains(db.ops(b"user_7", b"user_7"), b"user_7"))
    return spark.createDataFrame([row], "at_or_after string, before string, first_k string, last_k string, holds_7 boolean")


@query(f"with {OPS_SQL}, {BATCH_SQL}, s as (select part, sum({BYTES_SQL}) as bytes from b group by part) select cast(count(*) as bigint) as cache_misses, cast(2 * count(*) as bigint) as cache_hits, cast(count(*) as bigint) as table_misses, cast(sum(bytes) as bigint) as total_charge, 2 / 3.0::double as block_cache_hit_rate from s")
def kv_engine_cache(spark, sf_dir):
    """Counters of the caches after three scans of all runs."""
    db = loaded(spark, sf_dir, block_cache_size=1 << 40)
    for _ in range(3):
        db.scan(ordered=False)
    row = (db.metrics.cache_misses, db.metrics.cache_hits, db.metrics.table_misses, db.blocks.total_charge(), db.metrics.block_cache_hit_rate())
    db.close()
    return spark.createDataFrame([row], "cache_misses long, cache_hits long, table_misses long, total_charge long, block_cache_hit_rate double")


@query(f"with {OPS_SQL} select 2::bigint as writes, 1::bigint as reads, 0::bigint as after_reset, cast(octet_length(encode(min(k))) + 1 + octet_length(encode(max(k))) as bigint) as memory_usage from ops")
def kv_engine_metrics(spark, sf_dir):
    """Counters of two writes and a read, of the memtable's bytes, and after a reset."""
    low, high = events_ops(spark, sf_dir).agg(F.min("k"), F.max("k")).first()
    db = Engine.open(spark, work_folder(spark, "store"))
    db.put(low, "1")
    db.delete(high)
    db.get(low)
    m = db.metrics
    row = [m.writes, m.reads]
    m.reset()
    return spark.createDataFrame([(*row, m.writes + m.reads + m.read_ns + m.write_ns, db.memory_usage())], "writes long, reads long, after_reset long, memory_usage long")


@query(f"with {LATEST_SQL} select k, seq, type, v from cur")
def kv_merge_runs(spark, sf_dir):
    """Runs of the op log merged, the newest version by rank."""
    ops = files_of(events_ops(spark, sf_dir))
    runs = [ops.filter(F.col("number") % 3 == i).drop("number") for i in range(3)]
    return latest(merged(*runs))


_ENTRY_SQL = "concat(lpad(hex(type), 2, '0'), lpad(hex(strlen(k)), 2, '0'), hex(encode(k)), case when v is null then '' else concat(lpad(hex(strlen(v)), 2, '0'), hex(encode(v))) end)"
_LE_SQL = lambda x, n: "concat(" + ", ".join(f"lpad(hex(({x} >> {8 * i}) & 255), 2, '0')" for i in range(n)) + ")"


@query(f"with {OPS_SQL}, e as (select seq // 100 as batch_id, seq, {_ENTRY_SQL} as x from ops) select batch_id, count(*) as count, concat({_LE_SQL('min(seq)', 8)}, {_LE_SQL('count(*)', 4)}, string_agg(x, '' order by seq)) as data, cast(12 + sum(strlen(x) // 2) as integer) as size from e group by batch_id")
def kv_batch_encode(spark, sf_dir):
    ops = events_ops(spark, sf_dir).select(F.col("k").cast("binary").alias("k"), "seq", "type", F.col("v").cast("binary").alias("v"), F.expr("seq div 100L").alias("batch_id"), (F.col("seq") % 100).alias("op_idx"))
    return codec.encode_batches(ops).withColumn("data", F.hex("data"))


@query(f"with {OPS_SQL} select seq // 100 as batch_id, cast(seq % 100 as integer) as op_idx, seq, type, k, v from ops")
def kv_batch_replay(spark, sf_dir):
    ops = events_ops(spark, sf_dir).select(F.col("k").cast("binary").alias("k"), "seq", "type", F.col("v").cast("binary").alias("v"), F.expr("seq div 100L").alias("batch_id"), (F.col("seq") % 100).alias("op_idx"))
    return shown(codec.decode_batches(codec.encode_batches(ops)))


@query(f'with {OPS_SQL}, {BLOCKS_SQL} select number, block_id, "offset", size, {_varint_sql(chr(34) + "offset" + chr(34))} + {_varint_sql("size")} as handle_bytes, "offset" + size as index_offset, true as magic, false as torn from blk')
def kv_footer_codec(spark, sf_dir):
    """Handles of blocks through handles and footers and back; a footer with another magic number is refused."""
    blocks = codec.block_index(runs_by_file(spark, sf_dir), block_size=512)
    handle = codec.block_handle(F.col("offset"), F.col("size"))
    foot = codec.footer(handle, codec.block_handle(F.col("offset") + F.col("size"), F.lit(7).cast("long")))
    read = blocks.select("number", "block_id", F.octet_length(handle).alias("handle_bytes"), codec.read_footer(foot).alias("f"), codec.read_footer(F.concat(F.substring(foot, 1, 47), F.lit(b"\0"))).isNotNull().alias("torn"))
    return read.select("number", "block_id", F.col("f.metaindex.offset").alias("offset"), F.col("f.metaindex.size").alias("size"), "handle_bytes", F.col("f.index.offset").alias("index_offset"), (F.col("f.index.size") == 7).alias("magic"), "torn")


@query(f"with {OPS_SQL}, {FILES_SQL} select number, concat(number, '.sst') as sst, concat('MANIFEST-', lpad(cast(number as varchar), 6, '0')) as manifest, least(number % 9 + 1, 6) as output_level from f")
def kv_file_names(spark, sf_dir):
    files = compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"])
    return files.select("number", codec.sst_name(F.col("number")).alias("sst"), codec.manifest_name(F.col("number")).alias("manifest"), compaction.output_level(F.col("number") % 9).alias("output_level"))


@query(f"with {OPS_SQL} select seq, seq * 1000 as n, {_LE_SQL('seq * 1000', 4)} as f32, {_LE_SQL('seq * 1000', 8)} as f64, seq * 1000 as back from ops")
def kv_fixed_codec(spark, sf_dir):
    n = F.col("seq") * 1000
    return events_ops(spark, sf_dir).select("seq", n.alias("n"), F.hex(codec.fixed32(n)).alias("f32"), F.hex(codec.fixed64(n)).alias("f64"), codec.read_fixed(codec.fixed64(n), 8).alias("back"))


@query(f"with {OPS_SQL} select type, count(*) as n, cast(sum(seq % 97 + 1) as bigint) as ms, count(*) * 1000.0::double / cast(sum(seq % 97 + 1) as bigint) as qps from ops group by type")
def kv_qps(spark, sf_dir):
    """Operations a second of a trace in which an operation takes seq % 97 + 1 milliseconds."""
    sums = events_ops(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("seq") % 97 + 1).alias("ms"))
    return sums.withColumn("qps", metrics.ratio(F.col("n") * F.lit(1000.0), F.col("ms"), 0.0))


@query(f"with {OPS_SQL}, {FILES_SQL}, l as (select {_PICK_FILES} as level, * from f) select level, count(*) as n_inputs, cast(sum(num_entries) as bigint) as num_entries, min(smallest) as smallest, max(largest) as largest, string_agg(cast(number as varchar), ',' order by number) as numbers from l group by level")
def kv_compaction_inputs(spark, sf_dir):
    files = compaction.file_stats(files_of(events_ops(spark, sf_dir)), ["number"]).withColumn("level", F.expr(_PICK_FILES))
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda n: n.cast("string")), ",")
    return files.groupBy("level").agg(F.count("*").alias("n_inputs"), F.sum("num_entries").alias("num_entries"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), numbers.alias("numbers"))


@query("select concat('key_', cast(i as varchar)) as k, i + 1 as seq, 1 as type, 100 as n_bytes from range(0, (select count(*) from events)) t(i)")
def kv_iterator_source(spark, sf_dir):
    """A cursor in Python as a Spark source, as many keys as events has rows."""
    spark.dataSource.register(SyntheticSource)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = spark.read.format("lamina_synthetic").option("rows", str(rows)).load()
    return out.select(F.col("k").cast("string").alias("k"), "seq", "type", F.octet_length("v").alias("n_bytes"))
