"""The same queries as SQL over the raw tables, to check results in another engine.

Written from the definitions, not from the Spark plans: sketches are filled and read
row by row in SQL, running values use plain windows, chained epochs a recursive CTE.
"""

from __future__ import annotations

from collections.abc import Sequence

DAY, HOUR, MINUTES = 86400, 3600, 900
SEED = 42
FLOW = ["src_ip", "dst_port"]
PAIR = ["dst_ip", "src_ip"]

FRAMES = """raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
timed AS (
  SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts_sec,
    '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS src_ip, '10.0.0.' || CAST(k % 16 AS VARCHAR) AS dst_ip,
    CAST(1024 + user_id % 64 AS INT) AS src_port, CAST(k AS INT) AS dst_port,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 18 WHEN 'click' THEN 16 WHEN 'view' THEN 1
      ELSE 17 END AS tcp_flags,
    CAST(40 + floor(value) AS BIGINT) AS total_len, CASE WHEN k % 10 = 9 THEN 17 ELSE 6 END AS protocol
  FROM raw)"""


def _epochs(seconds: int) -> str:
    return f"""{FRAMES},
frames AS (SELECT *, (ts_sec - (SELECT min(ts_sec) FROM timed)) // {seconds} AS epoch_id FROM timed),
packets AS (SELECT * FROM frames WHERE protocol = 6)"""


_FRAMES_BY_DAY = f"frames AS (SELECT *, (ts_sec - (SELECT min(ts_sec) FROM timed)) // {DAY} AS epoch_id FROM timed)"


def _sql(body: str, *ctes: str, seconds: int = DAY, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([_epochs(seconds), *ctes]) + "\n" + body


def _names(keys: Sequence[str], table: str = "") -> str:
    return ", ".join((f"{table}." if table else "") + k for k in keys)


def _text(keys: Sequence[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"


def _hash(index: int, text: str, width: int) -> str:
    return f"CAST('0x' || substr(md5('{index}:' || {text}), 1, 8) AS BIGINT) % {width}"


def _counts(keys: Sequence[str], value: str = "1", where: str = "TRUE", out: str = "count", source: str = "packets") -> str:
    return (
        f"SELECT epoch_id, {_names(keys)}, CAST(sum({value}) AS BIGINT) AS {out} FROM {source} "
        f"WHERE {where} GROUP BY epoch_id, {_names(keys)}"
    )


def _slots(name: str, source: str, keys: Sequence[str], depth: int, width: int, keep: str = "") -> str:
    """A CTE with one row per source row and hash function: keys, hash row r, bucket b."""
    keep = f", {keep}" if keep else ""
    rows = " UNION ALL ".join(
        f"SELECT epoch_id, {_names(keys)}{keep}, {i} AS r, {_hash(SEED + i, _text(keys), width)} AS b FROM {source}"
        for i in range(depth)
    )
    return f"{name} AS ({rows})"


def _minimum(keys: Sequence[str], value: str, width: int, out: str, source: str = "packets", depth: int = 2, tag: str = ""):
    """CTEs ending in est{tag}: the smallest counter per key."""
    return [
        f"sums{tag} AS ({_counts(keys, value, out='v', source=source)})",
        _slots(f"slots{tag}", f"sums{tag}", keys, depth, width, "v"),
        f"cells{tag} AS (SELECT epoch_id, r, b, sum(v) AS c FROM slots{tag} GROUP BY epoch_id, r, b)",
        f"est{tag} AS (SELECT epoch_id, {_names(keys)}, CAST(min(c) AS BIGINT) AS {out} FROM slots{tag} "
        f"JOIN cells{tag} USING (epoch_id, r, b) GROUP BY epoch_id, {_names(keys)})",
    ]


def _tree(keys: Sequence[str], value: str, out: str, where: str = "TRUE", t1: int = 254, t2: int = 600, width: int = 256):
    """CTEs ending in est: counter tree, excess passed upwards."""
    return [
        f"sums AS ({_counts(keys, value, where, 'v')})",
        _slots("slots", "sums", keys, 2, width, "v"),
        "c1 AS (SELECT epoch_id, r, b, sum(v) AS v1 FROM slots GROUP BY epoch_id, r, b)",
        f"c2 AS (SELECT epoch_id, r, b // 8 AS p, sum(greatest(v1 - {t1}, 0)) AS v2 FROM c1 GROUP BY epoch_id, r, b // 8)",
        f"c3 AS (SELECT epoch_id, r, p // 8 AS q, sum(greatest(v2 - ({t2} - {t1}), 0)) AS v3 FROM c2 "
        "GROUP BY epoch_id, r, p // 8)",
        f"cells AS (SELECT c1.epoch_id, c1.r, c1.b, CASE WHEN v1 <= {t1} THEN v1 WHEN {t1} + v2 <= {t2} THEN {t1} + v2 "
        f"ELSE {t2} + v3 END AS c FROM c1 JOIN c2 ON c1.epoch_id = c2.epoch_id AND c1.r = c2.r AND c1.b // 8 = p "
        "JOIN c3 ON c1.epoch_id = c3.epoch_id AND c1.r = c3.r AND c1.b // 64 = q)",
        f"est AS (SELECT epoch_id, {_names(keys)}, CAST(min(c) AS BIGINT) AS {out} FROM slots "
        f"JOIN cells USING (epoch_id, r, b) GROUP BY epoch_id, {_names(keys)})",
    ]


def _bloom(keys: Sequence[str], where: str = "TRUE", size: int = 97, hashes: int = 3) -> list[str]:
    """CTEs ending in passed: keys let through by a Bloom filter fed in arrival order."""
    return [
        f"firsts AS (SELECT epoch_id, {_names(keys)}, min(seq) AS s FROM packets WHERE {where} "
        f"GROUP BY epoch_id, {_names(keys)})",
        _slots("touched", "firsts", keys, hashes, size, "s"),
        "bits AS (SELECT epoch_id, b, min(s) AS t FROM touched GROUP BY epoch_id, b)",
        f"passed AS (SELECT epoch_id, {_names(keys)}, s FROM touched JOIN bits USING (epoch_id, b) "
        f"GROUP BY epoch_id, {_names(keys)}, s HAVING max(t) = s)",
    ]


def _coupons(
    keys: Sequence[str], coupon_text: list[list[str]], where: str = "TRUE", m: int = 8, n: int = 1024, index: int | None = None
) -> list[str]:
    """CTEs ending in fill (coupons per row) and fullest (most coupons per key)."""
    d = len(coupon_text)
    draws = " UNION ALL ".join(
        f"SELECT epoch_id, {_hash(SEED + i, _text(keys), m)} AS r, {_hash(SEED + (i if index is None else index), text, n)} AS coupon "
        f"FROM packets WHERE {where}"
        for i in range(d)
        for text in coupon_text[i]
    )
    return [
        f"draws AS ({draws})",
        "fill AS (SELECT epoch_id, r, count(DISTINCT coupon) AS k FROM draws GROUP BY epoch_id, r)",
        f"named AS (SELECT DISTINCT epoch_id, {_names(keys)} FROM packets)",
        _slots("places", "named", keys, d, m).replace(" AS r,", " AS h,").replace(" AS b FROM", " AS r FROM"),
        f"fullest AS (SELECT epoch_id, {_names(keys)}, max(coalesce(k, 0)) AS k FROM places "
        f"LEFT JOIN fill USING (epoch_id, r) GROUP BY epoch_id, {_names(keys)})",
    ]


def _drawn(n: int = 1024) -> str:
    return f"CASE WHEN k = 0 OR k >= {n} THEN 0 ELSE CAST(floor({n}.0::DOUBLE * ln({n}.0::DOUBLE / ({n} - k))) AS BIGINT) END"


PER_PACKET = [[f"('{j}:' || CAST(seq AS VARCHAR))" for j in range(2)] for _ in range(3)]

SYN_FIN = [
    f"syn AS ({_counts(['dst_ip', 'dst_port'], where='tcp_flags = 2', out='left_count')})",
    f"fin AS ({_counts(['src_ip', 'dst_port'], where='tcp_flags = 1', out='right_count')})",
]
JOIN = "FROM syn l JOIN fin r ON l.epoch_id = r.epoch_id AND l.dst_ip = r.src_ip"


def _light(keys: Sequence[str], value: str = "1") -> str:
    return (
        f"light AS (SELECT epoch_id, {_hash(SEED, _text(keys), 64)} AS bucket, "
        f"CAST(least(sum({value}), 255) AS BIGINT) AS value FROM packets GROUP BY 1, 2)"
    )


SIZES = "sizes AS (SELECT epoch_id, value, count(*) AS n FROM light GROUP BY epoch_id, value)"

_BY_DAY = f"SELECT ts_sec // {DAY} * {DAY} AS epoch_start, * FROM packets"
_CLOSED = f"ts_sec // {DAY} < (SELECT max(ts_sec) // {DAY} FROM packets)"


def _closed_days(where: str = "TRUE") -> str:
    return f"days AS (SELECT * FROM ({_BY_DAY}) WHERE {_CLOSED} AND {where})"


def _per_address(flag: int, address: str, out: str, source: str = "packets", epoch: str = "epoch_id") -> str:
    return (
        f"(SELECT {epoch}, {address}, count(*) AS {out} FROM {source} WHERE tcp_flags = {flag} "
        f"GROUP BY {epoch}, {address})"
    )


def _arrival(levels: bool) -> str:
    """The sketch as it stands at each packet, from plain running windows."""
    ctes = [_slots("slots", "packets", FLOW, 2, 256 if levels else 64, "seq, total_len AS v")]
    if not levels:
        ctes.append("seen AS (SELECT *, sum(v) OVER (PARTITION BY epoch_id, r, b ORDER BY seq) AS e FROM slots)")
    else:
        t1, t2 = 254, 600
        ctes += [
            "s1 AS (SELECT *, sum(v) OVER (PARTITION BY epoch_id, r, b ORDER BY seq) AS v1 FROM slots)",
            f"s2 AS (SELECT *, {t1} + sum(CASE WHEN v1 > {t1} THEN v ELSE 0 END) OVER "
            "(PARTITION BY epoch_id, r, b // 8 ORDER BY seq) AS v2 FROM s1)",
            f"s3 AS (SELECT *, {t1 + t2} + sum(CASE WHEN v1 > {t1} AND v2 > {t2} THEN v ELSE 0 END) OVER "
            "(PARTITION BY epoch_id, r, b // 64 ORDER BY seq) AS v3 FROM s2)",
            f"seen AS (SELECT *, CASE WHEN v1 <= {t1} THEN v1 WHEN v2 <= {t2} THEN v2 ELSE v3 END AS e FROM s3)",
        ]
    ctes.append(f"per_row AS (SELECT epoch_id, {_names(FLOW)}, r, arg_max(e, seq) AS e FROM seen GROUP BY ALL)")
    body = f"SELECT epoch_id, {_names(FLOW)}, CAST(min(e) AS BIGINT) AS total FROM per_row GROUP BY epoch_id, {_names(FLOW)}"
    return _sql(body, *ctes)


_CHAIN = [
    "secs AS (SELECT ts_sec, min(seq) AS seq FROM frames GROUP BY ts_sec)",
    f"hops AS (SELECT ts_sec, min(ts_sec) OVER (ORDER BY ts_sec RANGE BETWEEN {HOUR} FOLLOWING "
    "AND UNBOUNDED FOLLOWING) AS next_sec FROM secs)",
    "starts(t) AS (SELECT min(ts_sec) FROM secs UNION ALL "
    "SELECT h.next_sec FROM starts s JOIN hops h ON h.ts_sec = s.t WHERE h.next_sec IS NOT NULL)",
    "opened AS (SELECT secs.seq, secs.ts_sec FROM starts JOIN secs ON secs.ts_sec = starts.t)",
]
_CHAINED = (
    "(SELECT f.seq, CAST(greatest(count(o.seq) - 1, 0) AS BIGINT) AS epoch_id "
    "FROM frames f LEFT JOIN opened o ON o.seq < f.seq GROUP BY f.seq)"
)

_CALENDAR = (
    f"calendar AS (SELECT epoch_id, start_sec, start_sec + {MINUTES} AS end_sec, frames, "
    "CAST(sum(frames) OVER (ORDER BY epoch_id) AS BIGINT) AS total_frames FROM ("
    f"SELECT s.e AS epoch_id, (SELECT min(ts_sec) FROM frames) + s.e * {MINUTES} AS start_sec, "
    "(SELECT count(*) FROM frames f WHERE f.epoch_id = s.e) AS frames "
    "FROM (SELECT unnest(range(0, (SELECT max(epoch_id) + 1 FROM frames))) AS e) s))"
)

_ROW = "seq, dst_ip, src_ip, dst_port, tcp_flags, total_len"


def oracle_sql() -> dict[str, str]:
    oracles = {
        # sources and accounting
        "packets_view": _sql(
            "SELECT seq, ts_sec, src_ip, dst_ip, src_port, dst_port, tcp_flags, total_len, protocol, "
            "-1 AS dns_ns_type FROM packets"
        ),
        "packets_decoded": _sql(
            "SELECT arrival, ts_sec, src_ip, dst_ip, src_port, dst_port, tcp_flags, total_len, protocol "
            "FROM (SELECT *, row_number() OVER (ORDER BY seq) AS arrival FROM frames) WHERE protocol = 6"
        ),
        "tcp_only": _sql("SELECT seq, protocol FROM packets"),
        "frame_accounting": _sql(
            "SELECT epoch_id, frames, CAST(sum(frames) OVER (ORDER BY epoch_id) AS BIGINT) AS total_frames "
            "FROM (SELECT epoch_id, count(*) AS frames FROM frames GROUP BY epoch_id)"
        ),
        "run_metrics": _sql(
            "SELECT count(*) AS total_frames, count(DISTINCT epoch_id) AS epochs, "
            "round(count(*)::DOUBLE / count(DISTINCT epoch_id), 6) AS avg_frames_per_epoch FROM frames"
        ),
        "epoch_report": _sql(
            "SELECT epoch_id, flow_key, count AS value, "
            "row_number() OVER (PARTITION BY epoch_id ORDER BY count DESC, flow_key) AS position FROM "
            f"(SELECT epoch_id, 'dst_ip: ' || dst_ip || ', src_ip: ' || src_ip AS flow_key, count FROM ({_counts(PAIR)})) "
            "WHERE count > 1"
        ),
        # epochs
        "epoch_tumbling": _sql("SELECT seq, epoch_id FROM frames", seconds=HOUR),
        "epoch_chained": _sql(f"SELECT seq, epoch_id FROM {_CHAINED}", *_CHAIN, recursive=True),
        "epoch_bounds": _sql("SELECT * FROM calendar", _CALENDAR, seconds=MINUTES),
        "epoch_bounds_chained": _sql(
            "SELECT c.epoch_id, start_sec, coalesce(end_sec, -1) AS end_sec, frames, "
            "CAST(sum(frames) OVER (ORDER BY c.epoch_id) AS BIGINT) AS total_frames "
            f"FROM (SELECT epoch_id, count(*) AS frames FROM {_CHAINED} GROUP BY epoch_id) c "
            "JOIN (SELECT row_number() OVER (ORDER BY ts_sec) - 1 AS epoch_id, ts_sec AS start_sec, "
            "lead(ts_sec) OVER (ORDER BY ts_sec) AS end_sec FROM opened) b ON b.epoch_id = c.epoch_id",
            *_CHAIN,
            recursive=True,
        ),
        "epoch_report_full": _sql(
            "SELECT c.*, coalesce(position, 0) AS position, coalesce(flow_key, 'none') AS flow_key, "
            "coalesce(value, 0) AS value FROM calendar c LEFT JOIN ("
            "SELECT epoch_id, 'dst_ip: ' || dst_ip AS flow_key, count AS value, "
            "row_number() OVER (PARTITION BY epoch_id ORDER BY count DESC, dst_ip) AS position "
            f"FROM ({_counts(['dst_ip'])}) WHERE count > 2) r ON r.epoch_id = c.epoch_id",
            _CALENDAR,
            seconds=MINUTES,
        ),
        "last_epoch": _sql(_counts(["dst_ip"], where="epoch_id = (SELECT max(epoch_id) FROM frames)")),
        # filters, projections, expressions
        "filter_conj": _sql(
            "SELECT epoch_id, seq, src_ip, dst_ip, tcp_flags FROM packets "
            "WHERE tcp_flags = 2 AND src_ip = '10.0.0.3' AND protocol = 6"
        ),
        "having_ge": _sql(_counts(["src_ip"]) + " HAVING count(*) >= 20"),
        "map_project": _sql("SELECT epoch_id, dst_ip, src_ip FROM packets"),
        "map_const": _sql("SELECT epoch_id, dst_ip, CAST(1 AS BIGINT) AS count, 'tcp' AS kind FROM packets"),
        "arith_ops": _sql(
            "SELECT seq, a + b AS plus, greatest(b - a, 0) AS minus, a * b AS times, "
            "CASE WHEN b = 0 THEN 0 ELSE a // b END AS quotient "
            "FROM (SELECT seq, total_len AS a, CAST(src_port - 1024 AS BIGINT) AS b FROM packets)"
        ),
        "flow_key": _sql(
            "SELECT epoch_id, 'dst_ip: ' || dst_ip || ', dst_port: ' || CAST(dst_port AS VARCHAR) AS flow_key, count "
            f"FROM ({_counts(['dst_ip', 'dst_port'])})"
        ),
        # joins
        "epoch_join": _sql(
            f"SELECT l.epoch_id, l.dst_ip, l.dst_port, l.left_count, r.src_ip, r.right_count {JOIN}", *SYN_FIN
        ),
        "join_left_wins": _sql(
            "SELECT l.epoch_id, l.dst_ip, l.n AS count, r.src_ip "
            f"FROM {_per_address(2, 'dst_ip', 'n')} l JOIN {_per_address(1, 'src_ip', 'n')} r "
            "ON l.epoch_id = r.epoch_id AND l.dst_ip = r.src_ip"
        ),
        "join_one_per_left": _sql(
            "SELECT epoch_id, dst_ip, port, left_count, src_ip, right_port, right_count FROM ("
            "SELECT l.epoch_id, l.dst_ip, l.dst_port AS port, l.left_count, r.src_ip, r.dst_port AS right_port, "
            "r.right_count, row_number() OVER (PARTITION BY l.epoch_id, l.dst_ip, l.dst_port ORDER BY r.dst_port) AS n "
            f"{JOIN}) WHERE n = 1",
            *SYN_FIN,
        ),
        "map_join": _sql(
            "SELECT l.epoch_id, l.dst_ip, l.dst_port, left_count + right_count AS total, "
            f"greatest(left_count - right_count, 0) AS diff {JOIN}",
            *SYN_FIN,
        ),
        "post_join_filter": _sql(
            f"SELECT l.epoch_id, l.dst_ip, l.dst_port, l.left_count, r.src_ip, r.right_count {JOIN} "
            "WHERE r.right_count >= 2",
            *SYN_FIN,
        ),
        # distinct
        "distinct_exact": _sql(
            f"SELECT epoch_id, {_ROW} FROM (SELECT *, row_number() OVER "
            "(PARTITION BY epoch_id, dst_ip, src_ip ORDER BY seq) AS n FROM packets) WHERE n = 1"
        ),
        "distinct_bloom": _sql(
            "SELECT epoch_id, dst_ip, src_ip, total_len FROM passed", *_bloom(["dst_ip", "src_ip", "total_len"])
        ),
        "distinct_bloom_rows": _sql(
            f"SELECT epoch_id, {_ROW} FROM packets WHERE seq IN (SELECT s FROM passed)", *_bloom(PAIR)
        ),
        "bloom_semi_join": _sql(
            "SELECT epoch_id, seq, dst_ip, dst_port FROM packets p WHERE tcp_flags = 1 AND "
            + " AND ".join(
                f"(epoch_id, {_hash(SEED + i, _text(['dst_ip', 'dst_port']), 97)}) IN (SELECT epoch_id, b FROM built)"
                for i in range(3)
            ),
            "syn AS (SELECT * FROM packets WHERE tcp_flags = 2)",
            _slots("built", "syn", ["dst_ip", "dst_port"], 3, 97),
        ),
        # reduce
        "reduce_exact": _sql(_counts(FLOW, "total_len", out="total")),
        "reduce_running": _sql(
            "SELECT epoch_id, seq, src_ip, CAST(sum(total_len) OVER (PARTITION BY epoch_id, src_ip ORDER BY seq) "
            "AS BIGINT) AS total FROM packets"
        ),
        "reduce_last_row": _sql(
            "SELECT epoch_id, seq, src_ip, count, dst_ip, dst_port, total_len FROM (SELECT *, "
            "count(*) OVER (PARTITION BY epoch_id, src_ip) AS count, "
            "row_number() OVER (PARTITION BY epoch_id, src_ip ORDER BY seq DESC) AS n FROM packets) WHERE n = 1"
        ),
        "reduce_cms": _sql("SELECT * FROM est", *_minimum(FLOW, "total_len", 64, "total")),
        "reduce_cms_arrival": _arrival(levels=False),
        "reduce_fcm": _sql("SELECT * FROM est", *_tree(FLOW, "total_len", "total")),
        "reduce_fcm_heavy": _sql("SELECT *, total > 1000 AS is_heavy FROM est", *_tree(FLOW, "total_len", "total")),
        "reduce_fcm_arrival": _arrival(levels=True),
        "reduce_fcm_l1": _sql("SELECT * FROM est", *_minimum(FLOW, "total_len", 64, "total")),
        "reduce_elastic": _sql(
            "SELECT *, total > 1000 AS is_heavy FROM est", *_minimum(FLOW, "total_len", 64, "total")
        ),
        "reduce_beaucoup": _sql(
            f"SELECT epoch_id, src_ip, dst_port, {_drawn()} AS estimate FROM fullest", *_coupons(FLOW, PER_PACKET)
        ),
        "coupon_distinct": _sql(
            f"SELECT epoch_id, src_ip, {_drawn()} AS distinct_values FROM fullest",
            *_coupons(["src_ip"], [[_text(["dst_ip", "dst_port"])]] * 3, index=3),
        ),
        "beaucoup_contains": _sql(
            "SELECT epoch_id, dst_ip, src_ip FROM fullest WHERE k > 0",
            *_coupons(PAIR, PER_PACKET[:2], "tcp_flags = 2", m=64),
        ),
        "sketch_probe": _sql(
            "SELECT epoch_id, src_ip, dst_port, CAST(min(coalesce(c, 0)) AS BIGINT) AS estimate "
            "FROM probes LEFT JOIN cells USING (epoch_id, r, b) GROUP BY epoch_id, src_ip, dst_port",
            f"sums AS ({_counts(FLOW, where='tcp_flags = 2', out='v')})",
            _slots("slots", "sums", FLOW, 2, 64, "v"),
            "cells AS (SELECT epoch_id, r, b, sum(v) AS c FROM slots GROUP BY epoch_id, r, b)",
            "named AS (SELECT DISTINCT epoch_id, src_ip, dst_port FROM packets WHERE tcp_flags = 1)",
            _slots("probes", "named", FLOW, 2, 64),
        ),
        # statistics
        "cardinality_linear": _sql(
            "SELECT epoch_id, CASE WHEN avg(empty) > 0 THEN round(256 * ln(256 / avg(empty)), 4) END AS cardinality "
            "FROM (SELECT epoch_id, r, 256 - count(DISTINCT b) AS empty FROM slots GROUP BY epoch_id, r) "
            "GROUP BY epoch_id",
            _slots("slots", "packets", FLOW, 2, 256),
        ),
        "light_count": _sql("SELECT * FROM light", _light(FLOW, "total_len")),
        "light_max": _sql(
            f"SELECT epoch_id, {_hash(SEED, _text(FLOW), 64)} AS bucket, max(least(total_len, 255)) AS value "
            "FROM packets GROUP BY 1, 2"
        ),
        "light_cardinality": _sql(
            "SELECT epoch_id, CASE WHEN count(*) < 64 THEN round(64 * ln(64.0::DOUBLE / (64 - count(*))), 4) END "
            "AS cardinality FROM light GROUP BY epoch_id",
            _light(["src_ip", "tcp_flags"]),
        ),
        "flow_size_distribution": _sql(
            "SELECT e.epoch_id, v.value, CAST(CASE WHEN v.value = 0 THEN 64 - e.used ELSE coalesce(s.n, 0) END AS BIGINT) "
            "AS counters FROM (SELECT epoch_id, count(*) AS used FROM light GROUP BY epoch_id) e "
            "CROSS JOIN (SELECT CAST(range AS BIGINT) AS value FROM range(256)) v "
            "LEFT JOIN sizes s ON s.epoch_id = e.epoch_id AND s.value = v.value",
            _light(FLOW),
            SIZES,
        ),
        "flow_entropy": _sql(
            "SELECT epoch_id, CAST(sum(n * value) AS BIGINT) AS total, round(sum(n * value * log2(value)), 6) "
            "AS size_log_size, round(log2(sum(n * value)) - sum(n * value * log2(value)) / sum(n * value), 6) AS entropy "
            "FROM sizes WHERE value > 0 GROUP BY epoch_id",
            _light(FLOW),
            SIZES,
        ),
        "light_fold": _sql(
            "SELECT p.epoch_id, p.src_ip, p.dst_port, coalesce(f.value, 0) AS estimate FROM "
            f"(SELECT DISTINCT epoch_id, src_ip, dst_port, {_hash(SEED, _text(FLOW), 64)} % 16 AS bucket FROM packets) p "
            "LEFT JOIN (SELECT epoch_id, bucket % 16 AS bucket, max(value) AS value FROM light GROUP BY 1, 2) f "
            "ON f.epoch_id = p.epoch_id AND f.bucket = p.bucket",
            _light(FLOW),
        ),
        "heavy_hitters": _sql(
            "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY epoch_id ORDER BY total_len DESC, dst_ip, src_ip) "
            f"AS INT) AS position FROM ({_counts(PAIR, 'total_len', out='total_len')})) WHERE position <= 10"
        ),
        "heavy_hitters_approx": _sql(
            "SELECT epoch_id, 'src_ip: ' || src_ip AS flow_key, count FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY epoch_id ORDER BY count DESC, src_ip) AS n FROM ({_counts(['src_ip'])})) WHERE n <= 16"
        ),
        "frequent_keys": _sql(
            f"SELECT epoch_id, src_ip, total_len FROM ({_counts(['src_ip'], 'total_len', out='total_len')}) "
            "JOIN (SELECT epoch_id, sum(total_len) AS every FROM packets GROUP BY epoch_id) USING (epoch_id) "
            "WHERE total_len * 14 >= every"
        ),
        # telemetry queries
        "q1_new_tcp": _sql(_counts(["dst_ip"], where="tcp_flags = 2") + " HAVING count(*) >= 2"),
        "q2_ssh_brute": _sql(
            "SELECT epoch_id, dst_ip, total_len, count(DISTINCT src_ip) AS count FROM packets "
            "GROUP BY epoch_id, dst_ip, total_len HAVING count(DISTINCT src_ip) >= 2"
        ),
        "q2_as_coded": _sql(
            "SELECT epoch_id, dst_ip, count(DISTINCT src_ip) AS count FROM packets "
            "GROUP BY epoch_id, dst_ip HAVING count(DISTINCT src_ip) >= 10"
        ),
        "q3_superspreader": _sql(
            "SELECT epoch_id, src_ip, count(DISTINCT dst_ip) AS count FROM packets "
            "GROUP BY epoch_id, src_ip HAVING count(DISTINCT dst_ip) >= 10"
        ),
        "q4_port_scan": _sql(
            "SELECT epoch_id, src_ip, count(DISTINCT dst_port) AS count FROM packets "
            "GROUP BY epoch_id, src_ip HAVING count(DISTINCT dst_port) >= 10"
        ),
        "q5_heavy_flows": _sql(_counts(PAIR, "total_len", out="total_len") + " HAVING sum(total_len) >= 1"),
        "q6_syn_flood": _sql(
            "SELECT l.epoch_id, l.dst_ip, l.a + r.b AS count "
            f"FROM {_per_address(2, 'dst_ip', 'a')} l JOIN {_per_address(17, 'src_ip', 'b')} r "
            "ON l.epoch_id = r.epoch_id AND l.dst_ip = r.src_ip WHERE l.a + r.b >= 8"
        ),
        "q7_completed_flow": _sql(
            "SELECT l.epoch_id, l.dst_ip "
            f"FROM {_per_address(2, 'dst_ip', 'a')} l JOIN {_per_address(1, 'src_ip', 'b')} r "
            "ON l.epoch_id = r.epoch_id AND l.dst_ip = r.src_ip WHERE l.a - r.b >= 1"
        ),
        "q8_slowloris": _sql(
            "SELECT b.epoch_id, b.dst_ip, b.total_len, c.count FROM "
            f"({_counts(['dst_ip'], 'total_len', out='total_len')}) b JOIN "
            "(SELECT epoch_id, dst_ip, count(*) AS count FROM "
            "(SELECT DISTINCT epoch_id, dst_ip, src_ip, src_port FROM packets) GROUP BY epoch_id, dst_ip) c "
            "ON b.epoch_id = c.epoch_id AND b.dst_ip = c.dst_ip WHERE b.total_len >= 500 AND c.count >= 5"
        ),
        # sketch-backed variants
        "q1_cms": _sql(
            "SELECT * FROM est WHERE count >= 2",
            "syn AS (SELECT * FROM packets WHERE tcp_flags = 2)",
            *_minimum(["dst_ip"], "1", 64, "count", "syn"),
        ),
        "q1_fcm": _sql("SELECT * FROM est WHERE count >= 2", *_tree(["dst_ip"], "1", "count", "tcp_flags = 2")),
        "q1_beaucoup": _sql(
            f"SELECT * FROM (SELECT epoch_id, dst_ip, {_drawn()} AS count FROM fullest) WHERE count >= 2",
            *_coupons(["dst_ip"], PER_PACKET, "tcp_flags = 2"),
        ).replace("named AS (SELECT DISTINCT epoch_id, dst_ip FROM packets)",
                  "named AS (SELECT DISTINCT epoch_id, dst_ip FROM packets WHERE tcp_flags = 2)"),
        "q2_bloom_cms": _sql(
            "SELECT * FROM est WHERE count >= 2",
            *_bloom(["dst_ip", "src_ip", "total_len"]),
            *_minimum(["dst_ip", "total_len"], "1", 64, "count", "passed"),
        ),
        "q3_bloom_cms": _sql(
            "SELECT * FROM est WHERE count >= 5", *_bloom(PAIR), *_minimum(["src_ip"], "1", 64, "count", "passed")
        ),
        "q4_bloom": _sql(
            "SELECT epoch_id, src_ip, count(*) AS count FROM passed GROUP BY epoch_id, src_ip HAVING count(*) >= 5",
            *_bloom(FLOW),
        ),
        "q5_fcm": _sql("SELECT * FROM est WHERE total_len >= 1", *_tree(PAIR, "total_len", "total_len")),
        "q6_cms": _sql(
            "SELECT l.epoch_id, l.dst_ip, l.a + r.b AS count FROM est_l l JOIN est_r r "
            "ON l.epoch_id = r.epoch_id AND l.dst_ip = r.src_ip WHERE l.a + r.b >= 8",
            "syn AS (SELECT * FROM packets WHERE tcp_flags = 2)",
            "fin_ack AS (SELECT * FROM packets WHERE tcp_flags = 17)",
            *_minimum(["dst_ip"], "1", 64, "a", "syn", tag="_l"),
            *_minimum(["src_ip"], "1", 64, "b", "fin_ack", tag="_r"),
        ),
        "q7_cms": _sql(
            "SELECT l.epoch_id, l.dst_ip FROM est_l l JOIN est_r r "
            "ON l.epoch_id = r.epoch_id AND l.dst_ip = r.src_ip WHERE l.a - r.b >= 1",
            "syn AS (SELECT * FROM packets WHERE tcp_flags = 2)",
            "fin AS (SELECT * FROM packets WHERE tcp_flags = 1)",
            *_minimum(["dst_ip"], "1", 64, "a", "syn", tag="_l"),
            *_minimum(["src_ip"], "1", 64, "b", "fin", tag="_r"),
        ),
        "q8_bloom_cms": _sql(
            "SELECT l.epoch_id, l.dst_ip, l.total_len, r.count FROM est_l l JOIN est_r r "
            "ON l.epoch_id = r.epoch_id AND l.dst_ip = r.dst_ip WHERE l.total_len >= 500 AND r.count >= 3",
            *_bloom(["dst_ip", "src_ip", "src_port"]),
            *_minimum(["dst_ip"], "total_len", 64, "total_len", tag="_l"),
            *_minimum(["dst_ip"], "1", 64, "count", "passed", tag="_r"),
        ),
        # streams: calendar days, without the last, still open one
        "stream_q1": _sql(
            "SELECT epoch_start, dst_ip, count(*) AS count FROM days GROUP BY epoch_start, dst_ip HAVING count(*) >= 2",
            _closed_days("tcp_flags = 2"),
        ),
        "stream_q3": _sql(
            "SELECT epoch_start, src_ip, count(DISTINCT dst_ip) AS count FROM days GROUP BY epoch_start, src_ip "
            "HAVING count(DISTINCT dst_ip) >= 10",
            _closed_days(),
        ),
        "stream_q6": _sql(
            "SELECT l.epoch_start, l.dst_ip, l.a + r.b AS count "
            f"FROM {_per_address(2, 'dst_ip', 'a', 'days', 'epoch_start')} l "
            f"JOIN {_per_address(17, 'src_ip', 'b', 'days', 'epoch_start')} r "
            "ON l.epoch_start = r.epoch_start AND l.dst_ip = r.src_ip WHERE l.a + r.b >= 8",
            _closed_days(),
        ),
        "stream_q1_flushed": _sql(
            f"SELECT epoch_start, dst_ip, count(*) AS count FROM ({_BY_DAY}) WHERE tcp_flags = 2 "
            "GROUP BY epoch_start, dst_ip HAVING count(*) >= 2"
        ),
    }
    # days of the calendar instead of days from the first frame on
    by_calendar = f"frames AS (SELECT *, ts_sec // {DAY} * {DAY} AS epoch_id FROM timed)"
    for stream, batch in {
        "stream_q2_flushed": "q2_ssh_brute",
        "stream_q3_flushed": "q3_superspreader",
        "stream_q4_bloom": "q4_bloom",
        "stream_q5_fcm": "q5_fcm",
        "stream_q6_flushed": "q6_syn_flood",
        "stream_q7_flushed": "q7_completed_flow",
        "stream_q8_flushed": "q8_slowloris",
        "stream_report": "epoch_report",
    }.items():
        own = oracles[batch].replace(_FRAMES_BY_DAY, by_calendar)
        closed = "WHERE epoch_id < (SELECT max(ts_sec) // 86400 * 86400 FROM timed)" if stream == "stream_report" else ""
        head, body = own.rsplit("\n", 1)
        oracles[stream] = f"{head}\nSELECT * EXCLUDE (epoch_id), epoch_id AS epoch_start FROM ({body}) {closed}"
    ten = "seq % 10 = 9 AND epoch_id < (SELECT max(ts_sec) // 86400 * 86400 FROM timed WHERE seq % 10 <> 9)"
    oracles["stream_late"] = _sql(
        f"SELECT epoch_id AS epoch_start, src_ip, CAST(sum(CASE WHEN {ten} THEN 0 ELSE 1 END) AS BIGINT) AS count, "
        f"CAST(sum(CASE WHEN {ten} THEN 1 ELSE 0 END) AS BIGINT) AS late FROM frames GROUP BY epoch_id, src_ip"
    ).replace(_FRAMES_BY_DAY, by_calendar)
    oracles["beaucoup_merged"] = oracles["reduce_beaucoup"]
    return oracles
