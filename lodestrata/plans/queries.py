"""Registered queries on the given tables; ordered results carry their position.

The events are the mutations (see model.events_log).  Tiers and files are derived from them: a tier
from a version's rank in the sequence (newest first: memory, frozen memory, level 0, 1, 2), a file from
the key range and the sequence number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..model import KEY_WIDTH, PUT, events_log, key_of, orders_log
from ..operators import compaction, policy, pruning
from ..operators import versions as V
from ..sources.commits import scratch
from ..sources.store import Busy, Corruption, InvalidArgument, Options, Store
from ..streaming.ingest import latest_by_key, stream_ingest

#: Keys that the given tables have at every scale.
KEY, FROM, TO = "0000000007", "0000000003", "0000000012"


def _at_share(log: DataFrame, tenths: int) -> int:
    """The sequence number that so many tenths of the log lie at or below."""
    return (log.agg(F.max("seq")).first()[0] or 0) * tenths // 10


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its tier: 0 and 1 in memory, 2 to 4 levels 0 to 2."""
    log = events_log(spark, sf_dir)
    last = log.agg(F.max("seq").alias("last"))
    share = F.col("seq") / F.col("last")
    tier = F.when(share > 0.9, 0).when(share > 0.8, 1).when(share > 0.6, 2).when(share > 0.3, 3).otherwise(4)
    return log.crossJoin(F.broadcast(last)).withColumn("tier", tier.cast("int")).drop("last")


def _with_files(log: DataFrame) -> DataFrame:
    """The log with the file of each version, and the file's level."""
    number = F.expr("cast(key as bigint) div 20") * 10 + F.pmod(F.col("seq"), F.lit(3))
    return log.withColumn("file", number.cast("long")).withColumn("level", F.pmod(F.col("seq"), F.lit(3)).cast("long"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruning.file_table(_with_files(events_log(spark, sf_dir)), "file", "level")


def _long(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


# --- reads and writes ---


def put_get_latest(spark, sf_dir):
    return V.get(events_log(spark, sf_dir), KEY)


def delete_hides(spark, sf_dir):
    """Keys whose newest version is a delete."""
    return V.head(events_log(spark, sf_dir)).filter(F.col("op") != PUT).select("key", "seq")


def get_missing(spark, sf_dir):
    return V.get(events_log(spark, sf_dir), "no such key")


def multi_get(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key_of("c_custkey").alias("key"))
    return V.multi_get(events_log(spark, sf_dir), keys)


def as_of_get(spark, sf_dir):
    """Every key at three snapshots: the newest version that each sees, deletes included."""
    log = events_log(spark, sf_dir)
    snapshots = F.explode(F.array(*[F.lit(_at_share(log, n)).cast("long") for n in (2, 6, 10)])).alias("snapshot")
    asked = log.select("*", snapshots).filter(F.col("seq") <= F.col("snapshot"))
    return asked.groupBy("key", "snapshot").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").cast("long").alias("op"))


def memtable_get_at_seq(spark, sf_dir):
    """Reads at a snapshot among the versions that memory would hold."""
    log = events_log(spark, sf_dir)
    return V.live(log.filter(F.col("seq") > _at_share(log, 1)), _at_share(log, 6))


def tiered_get(spark, sf_dir):
    return V.head_by_tier(_tiered(spark, sf_dir)).filter(F.col("op") == PUT).drop("op")


def scan_forward(spark, sf_dir):
    return V.positioned(V.live(events_log(spark, sf_dir)))


def scan_reverse(spark, sf_dir):
    return V.positioned(V.live(events_log(spark, sf_dir)), descending=True)


def seek_lower_bound(spark, sf_dir):
    """The first live row at or after a target that lies between two keys."""
    return V.seek(events_log(spark, sf_dir), KEY + "5")


def range_scan(spark, sf_dir):
    return V.positioned(V.scan(events_log(spark, sf_dir), FROM, TO))


def prefix_scan(spark, sf_dir):
    return V.positioned(V.prefix_scan(events_log(spark, sf_dir), "000000000"))


def custom_order_scan(spark, sf_dir):
    """A scan in another order than that of bytes: of keys read from their end."""
    return V.positioned(V.scan(events_log(spark, sf_dir), "0000000003", "0000000007", by=F.reverse), by=F.reverse)


def keyset_next(spark, sf_dir):
    return V.positioned(V.page(events_log(spark, sf_dir), 5, after=FROM))


def keyset_prev(spark, sf_dir):
    return V.positioned(V.page(events_log(spark, sf_dir), 5, before=TO), descending=True)


def snapshot_scan(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return V.positioned(V.live(log, _at_share(log, 6)))


def scan_count(spark, sf_dir):
    return V.live(events_log(spark, sf_dir)).agg(F.count("*").alias("n_live"))


def first_n(spark, sf_dir):
    return V.positioned(V.page(events_log(spark, sf_dir), 10))


def orders_live(spark, sf_dir):
    return V.live(orders_log(spark, sf_dir))


def lineitem_latest(spark, sf_dir):
    """The newest line of each order and line number; all columns break the ties of the ship date."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat(key_of("l_orderkey"), F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    newest = F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")).alias("n")
    return lines.select(key.alias("key"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").groupBy("key").agg(newest).select("key", "n.l_partkey", "n.l_suppkey", "n.l_extendedprice")


# --- versions ---


def kway_merge(spark, sf_dir):
    """All versions of all tiers by key, newest first, with their place within the key."""
    log = _tiered(spark, sf_dir)
    merged = V.merge([log.filter(F.col("tier") == t) for t in range(5)])
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return merged.select("key", "seq", *_long("op", "tier"), place.cast("long").alias("pos"))


def version_history(spark, sf_dir):
    found = V.history(events_log(spark, sf_dir), KEY)
    return found.select("key", "seq", *_long("op"), F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc())).cast("long").alias("pos"))


def newest_by_rank(spark, sf_dir):
    return V.head_by_rank(events_log(spark, sf_dir)).select("key", "seq", *_long("op"))


def compat_forward(spark, sf_dir):
    return V.puts_above_newest_delete(events_log(spark, sf_dir)).select("key", "seq", "event_type")


def compat_reverse(spark, sf_dir):
    return V.all_puts(events_log(spark, sf_dir)).select("key", "seq", "event_type")


def seq_assign(spark, sf_dir):
    """Consecutive numbers for the orders by date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return V.assign_sequence(orders, ["o_orderdate", "o_orderkey"], base=1000).select("o_orderkey", "seq")


def group_commit_state(spark, sf_dir):
    """Batches of 100 mutations: each one's last sequence number, puts and deletes."""
    log = events_log(spark, sf_dir).withColumn("batch", F.expr("(seq - 1) div 100"))
    return log.groupBy("batch").agg(F.max("seq").alias("last_seq"), F.sum("op").cast("long").alias("puts"), F.count(F.when(F.col("op") != PUT, 1)).alias("deletes"))


# --- files, levels, compaction ---


def level_scores(spark, sf_dir):
    return policy.level_scores(_files(spark, sf_dir)).select("level", "n_files", "n_bytes", F.round("score", 9).alias("score"))


def l0_closure(spark, sf_dir):
    """Level-0 files with their islands of transitively overlapping ranges."""
    files = _files(spark, sf_dir).filter("level = 0")
    return policy.islands(files).select("file", "island")


def overlap_inputs(spark, sf_dir):
    """Files of level 1 that meet some file of level 0."""
    files = _files(spark, sf_dir)
    return policy.overlapping_files(files.filter("level = 0"), files.filter("level = 1")).select("file", "lo", "hi")


def round_robin_pick(spark, sf_dir):
    return policy.next_by_pointer(_files(spark, sf_dir).filter("level = 1"), F.lit(TO)).select("file", "lo", "hi")


def compact_merge(spark, sf_dir):
    """Levels 0 and 1 merged: newest versions, deletes kept."""
    log = _tiered(spark, sf_dir).filter("tier in (2, 3)").drop("tier")
    return compaction.merge_runs(log).select("key", "seq", *_long("op"), "event_type")


def _upper_and_lower(spark, sf_dir):
    log = _tiered(spark, sf_dir)
    return log.filter("tier < 4").drop("tier"), _with_files(log.filter("tier = 4").drop("tier"))


def tombstone_gc(spark, sf_dir):
    """A merge of all but the deepest tier, over all files of that tier."""
    upper, lower = _upper_and_lower(spark, sf_dir)
    return compaction.compact(upper, pruning.file_table(lower, "file", "level")).select("key", "seq", *_long("op"))


def compaction_preserves_live(spark, sf_dir):
    """The live view after that merge, which must be the one before."""
    upper, lower = _upper_and_lower(spark, sf_dir)
    merged = compaction.compact(upper, pruning.file_table(lower, "file", "level"))
    return V.live(merged.unionByName(lower.drop("file", "level")))


def file_minmax_prune(spark, sf_dir):
    return pruning.may_hold(_files(spark, sf_dir), KEY).select("file", "level", "lo", "hi")


def find_file(spark, sf_dir):
    """For each key of the log its file on a level of disjoint files."""
    log = events_log(spark, sf_dir)
    level = pruning.file_table(log.filter("seq % 3 = 1").withColumn("file", F.expr("cast(key as bigint) div 20")), "file")
    return pruning.find_file(level, log.select("key").distinct()).select("key", "file", "in_range")


def range_overlap(spark, sf_dir):
    return pruning.overlapping(_files(spark, sf_dir), FROM, TO).select("file", "lo", "hi")


def bloom_no_false_negative(spark, sf_dir):
    """Keys of each file, and how many of them its filter admits: all."""
    log = _with_files(events_log(spark, sf_dir))
    filters = pruning.bloom_build(log, "file")
    return pruning.bloom_probe(filters, log, "file").groupBy("file").agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("maybe"), 1)).alias("n_maybe"))


def bloom_false_positive_rate(spark, sf_dir):
    """Whether under 2 % of 10,000 absent keys pass a filter of ten bits a key."""
    log = events_log(spark, sf_dir).withColumn("all", F.lit(1))
    absent = spark.range(10_000).select(F.lit(1).alias("all"), F.concat(F.lit("missing_"), F.col("id").cast("string")).alias("key"))
    passed = pruning.bloom_probe(pruning.bloom_build(log, "all"), absent, "all")
    return passed.agg(F.count("*").alias("probes"), (F.count(F.when(F.col("maybe"), 1)) < 200).alias("below_bound"))


def approx_offset(spark, sf_dir):
    return pruning.approximate_offset(_files(spark, sf_dir), TO)


# --- keys ---


def internal_key_pack(spark, sf_dir):
    packed = events_log(spark, sf_dir).select("key", "seq", "op", K.pack(F.col("seq"), F.col("op")).alias("packed"))
    seq, op = K.unpack(F.col("packed"))
    return packed.select("key", "packed", seq.alias("seq_back"), op.cast("long").alias("op_back"))


def prefix_compare(spark, sf_dir):
    """Comparison and prefix tests of part names and brands."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a, b = F.col("p_name"), F.col("p_brand")
    return part.select("p_partkey", K.compare(a, b).cast("long").alias("order"), K.prefix_filter(a, "Part").alias("starts"), F.octet_length(a).cast("long").alias("size"), F.expr("substring(p_name, 3)").alias("rest"))


def shared_prefix(spark, sf_dir):
    """How much of each live key the one after it repeats."""
    rows = V.positioned(V.live(events_log(spark, sf_dir)))
    pairs = rows.select("key", "pos").join(rows.select(F.col("key").alias("after"), (F.col("pos") - 1).alias("pos")), "pos")
    return pairs.select("key", K.shared_prefix_length(F.col("key"), F.col("after")).cast("long").alias("shared"))


def varint_lengths(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", K.varint_length(F.col("o_orderkey") * 1000).cast("long").alias("n_bytes"))


# --- the store on disk ---


def _event_batches(spark, sf_dir, n: int = 3):
    log = events_log(spark, sf_dir)
    return [log.filter(F.expr(f"pmod(seq, {n}) = {i}")) for i in range(n)]


def _store(spark, name: str, **options) -> Store:
    defaults = {"payload": "event_type string, value double", "write_buffer_size": 1, "level0_compaction_trigger": 2}
    return Store.open(spark, scratch(spark, name), Options(**(defaults | options)))


def _nations(spark, sf_dir) -> list[tuple[str, str]]:
    """A dimension of fixed size, for what is done row by row."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(key_of("n_nationkey").alias("key"), "n_name")
    return [tuple(r) for r in rows.orderBy("key").collect()]


def store_flushed(spark, sf_dir):
    """Three batches, each flushed to its own run, read back."""
    store = _store(spark, "flushed")
    for i, batch in enumerate(_event_batches(spark, sf_dir)):
        store.write(batch, batch_id=f"b{i}")
        store.flush()
    return store.live()


def store_compacted(spark, sf_dir):
    """The same with a batch delivered twice, compactions in between and a full one at the end."""
    store = _store(spark, "compacted")
    for i, batch in enumerate(_event_batches(spark, sf_dir)):
        store.write(batch, batch_id=f"b{i}")
        store.write(batch, batch_id=f"b{i}")
        store.maintain()
    store.settle(store.snapshot().seq)
    store.compact()
    return store.versions().select("key", "seq", *_long("op"), "event_type", "value")


def store_recovered(spark, sf_dir):
    """What a second opening finds of log and runs, in a key range."""
    store = _store(spark, "recovered")
    first, second, third = _event_batches(spark, sf_dir)
    store.write(first)
    store.flush()
    store.write(second)
    store.write(third)
    store.close()
    return Store.open(spark, store.path, Options(create_if_missing=False)).scan(FROM, TO)


def store_snapshot(spark, sf_dir):
    """A snapshot's rows after more was written and compacted."""
    store = _store(spark, "snapshot")
    log = events_log(spark, sf_dir)
    at = _at_share(log, 6)
    store.write(log.filter(F.col("seq") <= at))
    snapshot = store.snapshot()
    store.write(log.filter(F.col("seq") > at))
    store.compact()
    return store.live(snapshot)


def stream_live(spark, sf_dir):
    """The live view of a store that a stream of the events has filled."""
    store = _store(spark, "streamed")
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, value double")
    put = F.col("event_type") != "error"
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    mutations = events.select(F.lpad(F.col("user_id").cast("string"), KEY_WIDTH, "0").alias("key"), (F.col("event_id") + 1).alias("seq"), put.cast("tinyint").alias("op"), F.when(put, F.col("event_type")).alias("event_type"), F.when(put, F.col("value")).alias("value"))
    query = stream_ingest(mutations, store, "events", scratch(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.live()


def store_ordered_write(spark, sf_dir):
    """Events without numbers of their own, written in the order of their ids."""
    store = _store(spark, "ordered")
    store.write(events_log(spark, sf_dir).withColumnRenamed("seq", "at"), order=["at"])
    return store.live()


def store_destroyed(spark, sf_dir):
    """A store that was destroyed, and made again by another third of the events."""
    first, second, _ = _event_batches(spark, sf_dir)
    store = _store(spark, "destroyed")
    store.write(first)
    Store.destroy(spark, store.path)
    again = Store.open(spark, store.path, store.options)
    again.write(second)
    return again.live()


def store_checkpointed(spark, sf_dir):
    """A store whose manifest is checkpointed and cut, whose unused files are gone, opened again."""
    store = _store(spark, "checkpointed", checkpoint_every=2)
    for batch in _event_batches(spark, sf_dir, 4):
        store.write(batch)
        store.flush()
    store.compact()
    store.vacuum()
    return Store.open(spark, store.path, Options(create_if_missing=False)).live()


def store_pressure(spark, sf_dir):
    """What writers are told after each of four flushes; the last write has had to compact."""
    store = _store(spark, "pressure", level0_slowdown_trigger=2, level0_stop_trigger=3)
    said = []
    for i, batch in enumerate(_event_batches(spark, sf_dir, 4)):
        store.write(batch)
        store.flush()
        said.append((i, store.pressure()))
    return spark.createDataFrame(said, "batch bigint, pressure string")


def store_puts(spark, sf_dir):
    """Single puts and deletes under a small write buffer, some of them synced at once."""
    with _store(spark, "puts", payload="name string", write_buffer_size=1_000) as store:
        for i, (key, name) in enumerate(_nations(spark, sf_dir)):
            store.put(key, name=name, sync=i % 10 == 9)
            if i % 5 == 0:
                store.delete(key)
    return Store.open(spark, store.path, store.options).live().select("key", "name")


def store_cursor(spark, sf_dir):
    """Steps of a cursor: to the end, then back to the start."""
    store = _store(spark, "cursor", payload="name string")
    for key, name in _nations(spark, sf_dir):
        store.put(key, name=name)
    cursor, seen = store.cursor(page=4), []
    cursor.seek_to_first()
    while cursor.valid():
        seen.append((len(seen), cursor.key(), cursor.value()["name"]))
        cursor.next()
    cursor.seek_to_last()
    while cursor.valid():
        seen.append((len(seen), cursor.key(), cursor.value()["name"]))
        cursor.prev()
    return spark.createDataFrame(seen, "step bigint, key string, name string")


def store_trivial_move(spark, sf_dir):
    """A run that overlaps nothing changes its level and stays the same file."""
    store = _store(spark, "moved", level0_compaction_trigger=1)
    store.write(events_log(spark, sf_dir))
    store.flush()
    before = [r.path for r in store.state().level(0)]
    store.compact_once()
    moved = store.state().level(1)
    return spark.createDataFrame([(1, [r.path for r in moved] == before, sum(r.rows for r in moved))], "level bigint, same_files boolean, n_rows bigint")


def store_split(spark, sf_dir):
    """In how many files each key lies after a compaction into files of bounded size: one."""
    store = _store(spark, "split", max_file_size=2_000)
    for batch in _event_batches(spark, sf_dir):
        store.write(batch)
    store.settle(store.snapshot().seq)
    store.compact()
    rows = store.versions().select("key", F.col("_metadata.file_path").alias("file"))
    several = len(store.state().level(6)) > 1
    return rows.groupBy("key").agg(F.countDistinct("file").alias("n_files")).withColumn("several", F.lit(several))


def store_vacuumed(spark, sf_dir):
    """Folders of data before and after a vacuum that keeps what the last version names."""
    store = _store(spark, "vacuumed")
    for batch in _event_batches(spark, sf_dir):
        store.write(batch)
    store.compact()
    before = len(store.files.names("data"))
    store.vacuum()
    left = store.live().agg(F.count("*").alias("n_live"))
    return left.select(F.lit(before).cast("long").alias("n_before"), F.lit(len(store.files.names("data"))).cast("long").alias("n_after"), "n_live")


def store_log_damage(spark, sf_dir):
    """What is left of three batches in the log after one was damaged and a recovery dropped it."""
    store = _store(spark, "damaged")
    for batch in _event_batches(spark, sf_dir):
        store.write(batch)
    hurt = min(store.state().level(-1), key=lambda r: (r.seq_lo, r.number)).folder
    for r in store.state().level(-1):
        if r.folder == hurt:
            store.files.overwrite(r.path, b"PAR1 no longer")
    store.repair_log("drop")
    return store.live()


def store_compressions(spark, sf_dir):
    """The same rows by compressed and by plain files, pages verified on the read."""
    found = []
    for codec in ("zstd", "none"):
        store = _store(spark, codec, compression=codec, verify_checksums=True)
        store.write(events_log(spark, sf_dir))
        store.verify()
        found.append(store.live().withColumn("codec", F.lit(codec)))
    return found[0].unionByName(found[1])


def store_custom_order(spark, sf_dir):
    """A scan of a store that orders its keys from their end."""
    store = _store(spark, "backwards", key_order="reversed text")
    store.write(events_log(spark, sf_dir))
    again = Store.open(spark, store.path, store.options)
    return V.positioned(again.scan("0000000003", "0000000007"), by=F.reverse)


def status_texts(spark, sf_dir):
    """How the failures of a store are written."""
    return spark.createDataFrame([(type(e).__name__, str(e)) for e in (InvalidArgument("a"), Corruption("b"), Busy("c"))], "kind string, text string")


def key_bounds(spark, sf_dir):
    """Separators, successors and prefix bounds of neighbouring names: short, and in between."""
    names = sorted(n.encode() for _, n in _nations(spark, sf_dir))
    rows = []
    for a, b in zip(names, names[1:]):
        s, t, u = K.shortest_separator(a, b), K.short_successor(a), K.prefix_upper_bound(a)
        rows.append((a.decode(), a <= s < b and len(s) <= len(a), t >= a and len(t) <= len(a), u > a + b"\xff" and u[:-1] == a[:-1]))
    return spark.createDataFrame(rows, "name string, separator_ok boolean, successor_ok boolean, bound_ok boolean")


def key_hashes(spark, sf_dir):
    """CRC-32C, as it is and masked, and Murmur3 of the keys."""
    keys = events_log(spark, sf_dir).select("key").distinct()
    data = F.encode("key", "UTF-8")
    return keys.select("key", K.crc32c_column(data).alias("crc"), K.murmur3(data, 7).alias("murmur")).withColumn("masked", K.mask_crc_column(F.col("crc")))


def stream_latest(spark, sf_dir):
    """The newest version of each key of a stream, without a store; each batch's rows replace the last's."""
    out = scratch(spark, "stream-latest")
    events = spark.readStream.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{sf_dir}/event[s].parquet")
    put = F.col("event_type") != "error"
    mutations = events.select(F.lpad(F.col("user_id").cast("string"), KEY_WIDTH, "0").alias("key"), (F.col("event_id") + 1).alias("seq"), put.cast("tinyint").alias("op"), F.when(put, F.col("event_type")).alias("event_type"))
    writer = latest_by_key(mutations).writeStream.outputMode("complete").option("checkpointLocation", scratch(spark, "stream-checkpoint"))
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("key", "seq", *_long("op"), "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        put_get_latest, delete_hides, get_missing, multi_get, as_of_get, memtable_get_at_seq, tiered_get, scan_forward,
        scan_reverse, seek_lower_bound, range_scan, prefix_scan, custom_order_scan, keyset_next, keyset_prev, snapshot_scan, scan_count,
        first_n, orders_live, lineitem_latest, kway_merge, version_history, newest_by_rank, compat_forward,
        compat_reverse, seq_assign, group_commit_state, level_scores, l0_closure, overlap_inputs, round_robin_pick,
        compact_merge, tombstone_gc, compaction_preserves_live, file_minmax_prune, find_file, range_overlap,
        bloom_no_false_negative, bloom_false_positive_rate, approx_offset, internal_key_pack, prefix_compare,
        shared_prefix, varint_lengths, store_flushed, store_compacted, store_recovered, store_snapshot, stream_live,
        store_ordered_write, store_destroyed, store_checkpointed, store_pressure, store_puts, store_cursor, store_trivial_move,
        store_split, store_vacuumed, store_log_damage, store_compressions, store_custom_order, status_texts, key_bounds,
        key_hashes, stream_latest,
    )
}
