"""DuckDB SQL of the registered queries."""

from ..functions.keys import _ADDED, _MASK_DELTA, _MULTIPLIERS, _TABLE

_KEY, _FROM, _TO = "0000000007", "0000000003", "0000000012"
_SNAPSHOT = "(SELECT max(seq) * 6 // 10 FROM ev)"

_LOG = """ev AS (SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id + 1 AS seq,
    CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS TINYINT) AS op,
    CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
    CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


def _head(source: str, name: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {source}) WHERE r = 1)"


_HEAD = f"{_LOG}, {_head('ev', 'head')}"
_LIVE = f"{_HEAD}, live AS (SELECT key, seq, event_type, value FROM head WHERE op = 1)"
_TIERED = f"""{_LOG}, tiered AS (SELECT *, CASE WHEN s > 0.9 THEN 0 WHEN s > 0.8 THEN 1 WHEN s > 0.6 THEN 2 WHEN s > 0.3 THEN 3 ELSE 4 END AS tier
    FROM (SELECT *, seq / (SELECT CAST(max(seq) AS DOUBLE) FROM ev) AS s FROM ev))"""
_FILED = f"""{_LOG}, filed AS (SELECT *, CAST(key AS BIGINT) // 20 * 10 + seq % 3 AS file, seq % 3 AS level FROM ev),
  files AS (SELECT file, level, min(key) AS lo, max(key) AS hi, min(seq) AS seq_lo, count(*) AS n_rows, CAST(sum(strlen(key) + 9) AS BIGINT) AS n_bytes FROM filed GROUP BY file, level)"""
_POS = "row_number() OVER (ORDER BY key) AS pos"
_RPOS = "row_number() OVER (ORDER BY key DESC) AS pos"

#: A merge of the tiers 0 to 3 over all files of the deepest one.
_GC = f"""{_TIERED}, upper AS (SELECT * FROM tiered WHERE tier < 4), {_head('upper', 'merged')},
  low AS (SELECT *, CAST(key AS BIGINT) // 20 * 10 + seq % 3 AS file FROM tiered WHERE tier = 4),
  ranges AS (SELECT file, min(key) AS lo, max(key) AS hi, min(seq) AS seq_lo FROM low GROUP BY file),
  kept AS (SELECT * FROM merged m WHERE op = 1 OR EXISTS (SELECT 1 FROM ranges WHERE m.key BETWEEN lo AND hi AND m.seq > seq_lo))"""


def _hashes() -> str:
    """CRC-32C byte by byte through its table; Murmur3 of keys of ten bytes, two words and a tail."""
    word = lambda *at: " + ".join(f"(ascii(substr(key, {i}, 1))::HUGEINT << {8 * j})" for j, i in enumerate(at))
    times = lambda x, m: f"(({x}) * {m}::HUGEINT) % 4294967296"
    turned = lambda x, by: f"(({x} * {1 << by}::HUGEINT) % 4294967296 + {x} // {1 << (32 - by)})"
    cols = ["7::HUGEINT AS h0"]
    for i, at in enumerate(((1, 2, 3, 4), (5, 6, 7, 8), (9, 10))):
        cols += [f"{times(word(*at), _MULTIPLIERS[0])} AS a{i}", f"{times(turned(f'a{i}', 15), _MULTIPLIERS[1])} AS b{i}", f"xor(h{i}, b{i}) AS x{i}"]
        cols.append(f"({times(turned(f'x{i}', 13), 5)} + {_ADDED}) % 4294967296 AS h{i + 1}" if i < 2 else f"xor(x{i}, 10::HUGEINT) AS h{i + 1}")
    for i, (shift, by) in enumerate(((16, _MULTIPLIERS[2]), (13, _MULTIPLIERS[3]))):
        cols.append(f"{times(f'xor(h{i + 3}, h{i + 3} // {1 << shift})', by)} AS h{i + 4}")
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 11), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda c, b: xor(c // 256, {_TABLE}[xor(c, b) % 256 + 1])), 4294967295)"
    return f"""WITH {_LOG}, k AS (SELECT DISTINCT key FROM ev), m AS (SELECT key, {crc} AS crc, {", ".join(cols)} FROM k)
      SELECT key, CAST(crc AS BIGINT) AS crc, CAST(xor(h5, h5 // 65536) AS BIGINT) AS murmur,
             CAST((crc // 32768 + (crc * 131072) % 4294967296 + {_MASK_DELTA}) % 4294967296 AS BIGINT) AS masked FROM m"""


ORACLES = {
    "put_get_latest": f"WITH {_LIVE} SELECT * FROM live WHERE key = '{_KEY}'",
    "delete_hides": f"WITH {_HEAD} SELECT key, seq FROM head WHERE op = 0",
    "get_missing": f"WITH {_LIVE} SELECT * FROM live WHERE key = 'no such key'",
    "multi_get": f"WITH {_LIVE}, k AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer) SELECT k.key, seq, event_type, value, live.key IS NOT NULL AS found FROM k LEFT JOIN live ON k.key = live.key",
    "as_of_get": f"WITH {_LOG} SELECT key, snapshot, max(seq) AS seq, CAST(max_by(op, seq) AS BIGINT) AS op FROM ev, (SELECT max(seq) * unnest([2, 6, 10]) // 10 AS snapshot FROM ev) WHERE seq <= snapshot GROUP BY key, snapshot",
    "memtable_get_at_seq": f"WITH {_LOG}, b AS (SELECT * FROM ev WHERE seq > (SELECT max(seq) // 10 FROM ev) AND seq <= {_SNAPSHOT}), {_head('b', 'h')} SELECT key, seq, event_type, value FROM h WHERE op = 1",
    "tiered_get": f"WITH {_LIVE} SELECT * FROM live",
    "scan_forward": f"WITH {_LIVE} SELECT *, {_POS} FROM live",
    "scan_reverse": f"WITH {_LIVE} SELECT *, {_RPOS} FROM live",
    "seek_lower_bound": f"WITH {_LIVE} SELECT * FROM live WHERE key >= '{_KEY}5' ORDER BY key LIMIT 1",
    "range_scan": f"WITH {_LIVE} SELECT *, {_POS} FROM live WHERE key >= '{_FROM}' AND key < '{_TO}'",
    "prefix_scan": f"WITH {_LIVE} SELECT *, {_POS} FROM live WHERE starts_with(key, '000000000')",
    "custom_order_scan": f"WITH {_LIVE} SELECT *, row_number() OVER (ORDER BY reverse(key)) AS pos FROM live WHERE reverse(key) >= reverse('0000000003') AND reverse(key) < reverse('0000000007')",
    "keyset_next": f"WITH {_LIVE} SELECT *, {_POS} FROM (SELECT * FROM live WHERE key > '{_FROM}' ORDER BY key LIMIT 5)",
    "keyset_prev": f"WITH {_LIVE} SELECT *, {_RPOS} FROM (SELECT * FROM live WHERE key < '{_TO}' ORDER BY key DESC LIMIT 5)",
    "snapshot_scan": f"WITH {_LOG}, b AS (SELECT * FROM ev WHERE seq <= {_SNAPSHOT}), {_head('b', 'h')} SELECT key, seq, event_type, value, {_POS} FROM h WHERE op = 1",
    "scan_count": f"WITH {_LIVE} SELECT count(*) AS n_live FROM live",
    "first_n": f"WITH {_LIVE} SELECT *, {_POS} FROM (SELECT * FROM live ORDER BY key LIMIT 10)",
    "orders_live": f"""WITH o AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS op,
      CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders), {_head('o', 'h')} SELECT key, seq, price FROM h WHERE op = 1""",
    "lineitem_latest": """SELECT key, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r
      FROM (SELECT *, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || ':' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS key FROM lineitem)) WHERE r = 1""",
    "kway_merge": f"WITH {_TIERED} SELECT key, seq, CAST(op AS BIGINT) AS op, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS pos FROM tiered",
    "version_history": f"WITH {_LOG} SELECT key, seq, CAST(op AS BIGINT) AS op, row_number() OVER (ORDER BY seq DESC) AS pos FROM ev WHERE key = '{_KEY}'",
    "newest_by_rank": f"WITH {_HEAD} SELECT key, seq, CAST(op AS BIGINT) AS op FROM head",
    "compat_forward": f"WITH {_LOG} SELECT key, seq, event_type FROM ev a WHERE op = 1 AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.key = a.key AND b.op = 0 AND b.seq > a.seq)",
    "compat_reverse": f"WITH {_LOG} SELECT key, seq, event_type FROM ev WHERE op = 1",
    "seq_assign": "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders",
    "group_commit_state": f"WITH {_LOG} SELECT (seq - 1) // 100 AS batch, max(seq) AS last_seq, CAST(sum(op) AS BIGINT) AS puts, count(*) FILTER (op = 0) AS deletes FROM ev GROUP BY ALL",
    "level_scores": f"WITH {_FILED} SELECT level, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, round(CASE WHEN level = 0 THEN count(*) / 4.0 ELSE sum(n_bytes) / (10485760.0 * pow(10, level - 1)) END, 9) AS score FROM files GROUP BY level",
    "l0_closure": f"""WITH {_FILED}, f AS (SELECT *, CASE WHEN lo > max(hi) OVER (ORDER BY lo, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM files WHERE level = 0)
      SELECT file, CAST(1 + sum(fresh) OVER (ORDER BY lo, file) AS BIGINT) AS island FROM f""",
    "overlap_inputs": f"WITH {_FILED}, i AS (SELECT * FROM files WHERE level = 0) SELECT file, lo, hi FROM files f WHERE level = 1 AND EXISTS (SELECT 1 FROM i WHERE i.lo <= f.hi AND f.lo <= i.hi)",
    "round_robin_pick": f"WITH {_FILED} SELECT file, lo, hi FROM files WHERE level = 1 ORDER BY hi > '{_TO}' DESC, lo LIMIT 1",
    "compact_merge": f"WITH {_TIERED}, b AS (SELECT * FROM tiered WHERE tier IN (2, 3)), {_head('b', 'h')} SELECT key, seq, CAST(op AS BIGINT) AS op, event_type FROM h",
    "tombstone_gc": f"WITH {_GC} SELECT key, seq, CAST(op AS BIGINT) AS op FROM kept",
    "compaction_preserves_live": f"WITH {_LIVE} SELECT * FROM live",
    "file_minmax_prune": f"WITH {_FILED} SELECT file, level, lo, hi FROM files WHERE '{_KEY}' BETWEEN lo AND hi",
    "find_file": f"""WITH {_LOG}, f AS (SELECT CAST(key AS BIGINT) // 20 AS file, min(key) AS lo, max(key) AS hi FROM ev WHERE seq % 3 = 1 GROUP BY 1),
      k AS (SELECT DISTINCT key FROM ev) SELECT key, file, file IS NOT NULL AND (SELECT lo FROM f WHERE f.file = x.file) <= key AS in_range
      FROM (SELECT key, (SELECT min_by(file, hi) FROM f WHERE hi >= key) AS file FROM k) x""",
    "range_overlap": f"WITH {_FILED} SELECT file, lo, hi FROM files WHERE lo <= '{_TO}' AND hi >= '{_FROM}'",
    "bloom_no_false_negative": f"WITH {_FILED} SELECT file, count(DISTINCT key) AS n_keys, count(DISTINCT key) AS n_maybe FROM filed GROUP BY file",
    "bloom_false_positive_rate": "SELECT CAST(10000 AS BIGINT) AS probes, true AS below_bound",
    "approx_offset": f"WITH {_FILED} SELECT CAST(coalesce(sum(n_bytes) FILTER (hi < '{_TO}'), 0) AS BIGINT) AS \"offset\" FROM files",
    "internal_key_pack": f"WITH {_LOG} SELECT key, seq * 256 + op AS packed, seq AS seq_back, CAST(op AS BIGINT) AS op_back FROM ev",
    "prefix_compare": """SELECT p_partkey, CAST(CASE WHEN p_name < p_brand THEN -1 WHEN p_name > p_brand THEN 1 ELSE 0 END AS BIGINT) AS "order",
      starts_with(p_name, 'Part') AS starts, strlen(p_name) AS size, substr(p_name, 3) AS rest FROM part""",
    "shared_prefix": f"""WITH {_LIVE}, p AS (SELECT key, lead(key) OVER (ORDER BY key) AS after FROM live)
      SELECT key, CAST(len(list_filter(range(1, 11), lambda i: left(key, i) = left(after, i))) AS BIGINT) AS shared FROM p WHERE after IS NOT NULL""",
    "varint_lengths": "SELECT o_orderkey, CAST(CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 WHEN x < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS n_bytes FROM (SELECT o_orderkey, o_orderkey * 1000 AS x FROM orders)",
    "store_flushed": f"WITH {_LIVE} SELECT * FROM live",
    "store_compacted": f"WITH {_LIVE} SELECT key, seq, CAST(1 AS BIGINT) AS op, event_type, value FROM live",
    "store_recovered": f"WITH {_LIVE} SELECT * FROM live WHERE key >= '{_FROM}' AND key < '{_TO}'",
    "store_snapshot": f"WITH {_LOG}, b AS (SELECT * FROM ev WHERE seq <= {_SNAPSHOT}), {_head('b', 'h')} SELECT key, seq, event_type, value FROM h WHERE op = 1",
    "stream_live": f"WITH {_LIVE} SELECT * FROM live",
    "store_ordered_write": f"WITH {_LIVE} SELECT * FROM live",
    "store_destroyed": f"WITH {_LOG}, b AS (SELECT * FROM ev WHERE seq % 3 = 1), {_head('b', 'h')} SELECT key, seq, event_type, value FROM h WHERE op = 1",
    "store_checkpointed": f"WITH {_LIVE} SELECT * FROM live",
    "store_pressure": "SELECT CAST(i AS BIGINT) AS batch, p AS pressure FROM (VALUES (0, 'ok'), (1, 'slow'), (2, 'stop'), (3, 'ok')) AS t(i, p)",
    "store_puts": "SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS key, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0",
    "store_cursor": """WITH n AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS key, n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS c FROM nation)
      SELECT CAST(i AS BIGINT) AS step, key, name FROM n UNION ALL SELECT CAST(2 * c - 1 - i AS BIGINT), key, name FROM n""",
    "store_trivial_move": "SELECT CAST(1 AS BIGINT) AS level, true AS same_files, count(*) AS n_rows FROM events",
    "store_split": f"WITH {_LIVE} SELECT key, CAST(1 AS BIGINT) AS n_files, true AS several FROM live",
    "store_vacuumed": f"WITH {_LIVE} SELECT CAST(5 AS BIGINT) AS n_before, CAST(1 AS BIGINT) AS n_after, count(*) AS n_live FROM live",
    "store_log_damage": f"WITH {_LOG}, b AS (SELECT * FROM ev WHERE seq % 3 <> 1), {_head('b', 'h')} SELECT key, seq, event_type, value FROM h WHERE op = 1",
    "store_compressions": f"WITH {_LIVE} SELECT *, unnest(['zstd', 'none']) AS codec FROM live",
    "store_custom_order": f"WITH {_LIVE} SELECT *, row_number() OVER (ORDER BY reverse(key)) AS pos FROM live WHERE reverse(key) >= reverse('0000000003') AND reverse(key) < reverse('0000000007')",
    "status_texts": "SELECT * FROM (VALUES ('InvalidArgument', 'Invalid argument: a'), ('Corruption', 'Corruption: b'), ('Busy', 'Busy: c')) AS t(kind, text)",
    "key_bounds": "SELECT n_name AS name, true AS separator_ok, true AS successor_ok, true AS bound_ok FROM nation WHERE n_name < (SELECT max(n_name) FROM nation)",
    "key_hashes": _hashes(),
    "stream_latest": f"WITH {_HEAD} SELECT key, seq, CAST(op AS BIGINT) AS op, event_type FROM head",
}
