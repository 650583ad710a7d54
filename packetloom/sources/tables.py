"""The ``frames`` and ``packets`` tables.

``frames`` has one row per captured frame, ``packets`` only the TCP ones:

    seq LONG, ts TIMESTAMP, ts_sec LONG, src_ip STRING, dst_ip STRING, src_port INT,
    dst_port INT, tcp_flags INT, total_len LONG, protocol INT, dns_ns_type INT
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = (
    "seq BIGINT, ts TIMESTAMP, ts_sec BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "tcp_flags INT, total_len BIGINT, protocol INT, dns_ns_type INT"
)
FRAME_COLUMNS = tuple(field.split()[0] for field in FRAME_SCHEMA.split(", "))
TCP = 6


# fixed layout of the events table
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _instant(df: DataFrame, name: str) -> str:
    """SQL for the column as TIMESTAMP; a zoneless timestamp is read as UTC whatever the session zone."""
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return name
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z"):
        return f"CAST({name} AS TIMESTAMP)"
    # date, hour and second of a zoneless value do not depend on the session zone
    return (
        f"timestamp_micros((unix_date(CAST({name} AS DATE)) * 86400L + hour({name}) * 3600 + minute({name}) * 60) "
        f"* 1000000 + CAST(date_part('SECOND', {name}) * 1000000 AS BIGINT))"
    )


def frames_from_events(events: DataFrame) -> DataFrame:
    """Read the ``events`` test table (batch or stream) as frames; see FIXTURES.md for the mapping.

    ``explode`` of one element makes ``k`` a column of its own: a plain projection
    would be folded into later filters and parse the JSON text twice.
    """
    instant = _instant(events, "ts")
    return events.selectExpr(
        "event_id AS seq",
        f"{instant} AS ts",
        f"unix_seconds({instant}) AS ts_sec",
        "user_id",
        "event_type",
        "value",
        "explode(array(CAST(get_json_object(props, '$.k') AS INT))) AS k",
    ).selectExpr(
        "seq",
        "ts",
        "ts_sec",
        "concat('10.0.0.', CAST(user_id % 16 AS STRING)) AS src_ip",
        "concat('10.0.0.', CAST(k % 16 AS STRING)) AS dst_ip",
        "CAST(1024 + user_id % 64 AS INT) AS src_port",
        "k AS dst_port",
        "CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 18 WHEN 'click' THEN 16 WHEN 'view' THEN 1 "
        "ELSE 17 END AS tcp_flags",
        "CAST(40 + floor(value) AS BIGINT) AS total_len",
        "CASE WHEN k % 10 = 9 THEN 17 ELSE 6 END AS protocol",
        "CAST(NULL AS INT) AS dns_ns_type",
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{folder}/events.parquet")


def clock_of_events(events: DataFrame) -> DataFrame:
    """Only ``ts_sec`` of the frames, without touching the other columns."""
    return events.selectExpr(f"unix_seconds({_instant(events, 'ts')}) AS ts_sec")


def read_events_as_frames(spark: SparkSession, folder: str) -> DataFrame:
    return frames_from_events(read_events(spark, folder))


def read_frames(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Frames that are already stored in the layout above, in any format Spark reads."""
    return spark.read.format(format).schema(FRAME_SCHEMA).load(path)


def tcp_only(frames: DataFrame) -> DataFrame:
    """``frames`` -> ``packets``. Assign epochs before: other frames also move the clock."""
    return frames.where(F.col("protocol") == TCP)
