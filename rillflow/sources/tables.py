"""Packet and flow views over the driver's tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PACKETS = """
    SELECT event_id AS pkt_no, {micros} AS t_us, user_id,
           CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'A' ELSE 'B' END AS way,
           concat('10.1.', CAST(CAST(floor(user_id / 256) AS BIGINT) % 256 AS VARCHAR(9)), '.', CAST(user_id % 256 AS VARCHAR(9))) AS client_ip,
           concat('192.168.0.', CAST(user_id % 7 + 1 AS VARCHAR(9))) AS server_ip,
           20000 + user_id % 1000 AS client_port,
           CAST(CASE user_id % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 25 WHEN 5 THEN 21 ELSE 8080 END AS BIGINT) AS server_port,
           CAST(CASE WHEN user_id % 3 < 2 THEN 6 ELSE 17 END AS BIGINT) AS l4_proto,
           CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 16 WHEN 'purchase' THEN 24 WHEN 'error' THEN 4 ELSE 1 END AS BIGINT) AS tcp_flags,
           CAST(floor(abs(value)) AS BIGINT) AS len, value, event_type, props,
           (event_id * 7919) % 65536 AS ip_id, CAST(floor(abs(value) * 13) AS BIGINT) % 65536 AS tcp_win, user_id * 1000 AS tcp_seq, user_id * 1000 + CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS tcp_ack, 32 + (event_id * 31) % 5 AS ip_ttl
    FROM events"""

FLOW_SQL = """
    SELECT l_orderkey * 8 + l_linenumber AS flow_ind, CASE WHEN l_returnflag = 'R' THEN 'B' ELSE 'A' END AS dir,
           CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END + CASE WHEN l_orderkey % 11 = 0 THEN 32768 ELSE 16384 END AS BIGINT) AS flow_stat,
           CAST(l_shipdate AS DATE) AS day_first, l_linenumber * 10.0e0 AS duration,
           concat('10.0.', CAST(CAST(floor(l_suppkey / 256) AS BIGINT) % 256 AS VARCHAR(9)), '.', CAST(l_suppkey % 256 AS VARCHAR(9))) AS src_ip,
           concat('172.16.', CAST(CAST(floor(l_partkey / 256) AS BIGINT) % 256 AS VARCHAR(9)), '.', CAST(l_partkey % 256 AS VARCHAR(9))) AS dst_ip,
           1024 + l_orderkey % 60000 AS src_port,
           CAST(CASE l_partkey % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 25 WHEN 5 THEN 21 WHEN 6 THEN 8080 ELSE 123 END AS BIGINT) AS dst_port,
           CAST(CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS BIGINT) AS l4_proto,
           CAST(l_quantity AS BIGINT) AS pkts_snt, CAST(floor(l_quantity * l_discount * 10) AS BIGINT) AS pkts_rcvd,
           CAST(floor(l_extendedprice) AS BIGINT) AS bytes_snt, CAST(floor(l_extendedprice * l_tax * 5) AS BIGINT) AS bytes_rcvd,
           (l_orderkey * 37 + l_partkey) % 65536 AS tcp_anomaly, (l_partkey * 5 + l_linenumber) % 256 AS tcp_flags,
           CASE l_partkey % 5 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'TLS.HTTP' WHEN 2 THEN 'DNS' WHEN 3 THEN 'SSH' ELSE 'SMTP.Mail' END AS appl,
           sn.n_name AS src_cc, cn.n_name AS dst_cc
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
         JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey"""

#: The same rows for Spark: an order's customer is looked up before the lines meet the order, so that these, the largest table, are dealt by order and supplier only.
_FLOWS = FLOW_SQL.partition("FROM lineitem")[0] + """FROM lineitem
         JOIN (SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) cn ON l_orderkey = o_orderkey
         JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) sn ON l_suppkey = s_suppkey"""

#: A line ending in both dialects.
_END = "chr(13) || chr(10)"
MESSAGE_SQL = f"""
    SELECT event_id AS pkt_no, CASE event_id % 16
        WHEN 0 THEN 'GET /' || event_type || '/' || user_id || ' HTTP/1.1' || {_END} || 'Host: h' || user_id % 7 || '.example.org' || {_END} || 'User-Agent: agent/' || user_id % 5 || {_END} || {_END}
        WHEN 1 THEN 'HTTP/1.1 ' || (200 + user_id % 300) || ' X' || {_END} || 'Server: s' || user_id % 3 || ' ' || {_END} || 'Content-Type: text/' || event_type || '; charset=utf-8' || {_END} || {_END}
        WHEN 2 THEN 'POST /p?q=' || user_id || ' HTTP/1.0' || {_END} || 'host:h.example.net' || {_END} || {_END} || 'x=1'
        WHEN 3 THEN 'MAIL FROM:<u' || user_id || '@example.org>' || {_END} WHEN 4 THEN 'rcpt to: <u' || user_id || '@example.com>' || {_END} WHEN 5 THEN (220 + user_id % 9) || ' ready' || {_END}
        WHEN 6 THEN 'USER u' || user_id || {_END} WHEN 7 THEN 'PASS p' || event_id || {_END} WHEN 8 THEN 'PORT 10,0,' || user_id % 250 || ',7,' || user_id % 200 || ',' || event_id % 256 || {_END}
        WHEN 9 THEN 'SSH-2.0-Shell_' || user_id % 9 || {_END} WHEN 10 THEN ':srv NICK n' || user_id || {_END} WHEN 11 THEN 'NICK n' || user_id || {_END}
        WHEN 12 THEN '<' || user_id % 192 || '>host: ' || event_type WHEN 13 THEN 'INVITE sip:u@example.org SIP/2.0' || {_END} || 'Call-ID: c' || event_id || {_END}
        WHEN 14 THEN 'SIP/2.0 ' || (180 + user_id % 20) || ' OK' || {_END} || 'CALL-ID:  d' || event_id || {_END} ELSE props END AS text
    FROM events"""



def _hex(number: str, size: int) -> str:
    return f"lpad(hex({number}), {2 * size}, '0')"


def _string(text: str, extra: int = 0) -> str:
    """Length in a byte, and the text."""
    return f"{_hex(f'length({text}) + {extra}', 1)} || hex({text})"


_U, _E = "user_id", "event_id"
_GROUP = f"(CASE {_E} % 5 WHEN 0 THEN 17 WHEN 1 THEN 18 WHEN 2 THEN 22 ELSE 23 END * 256 + {_U} % 10 + 57344 + {_U} % 65536)"
_GROUP_SUM = f"(65535 - ({_GROUP} % 65536 + CAST(floor({_GROUP} / 65536) AS BIGINT)) + {_E} % 2) % 65536"
_KINDS = [
    f"{_hex(f'{_U} % 4 * 64 + (3 + {_U} % 2) * 8 + {_E} % 5 + 1', 1)} || {_hex(f'{_E} % 16', 1)} || '06EC' || {_hex(f'{_U} * 7 + {_E} % 1000', 4)} || {_hex(f'{_E} % 65536', 4)} || {_hex(f'3232235520 + {_U} % 256', 4)} || " + " || ".join(f"{_hex(f'3900000000 + {_U} + {i}', 4)} || {_hex(f'{_E} % 2 * 2147483648', 4)}" for i in range(4)),
    f"{_hex(f'CASE {_E} % 5 WHEN 0 THEN 17 WHEN 1 THEN 18 WHEN 2 THEN 22 ELSE 23 END', 1)} || {_hex(f'{_U} % 10', 1)} || {_hex(_GROUP_SUM, 2)} || 'E000' || {_hex(f'{_U} % 65536', 2)}",
    f"'02' || {_hex(f'{_E} % 5 + 1', 1)} || '0018' || {_hex(f'167772160 + {_U}', 4)} || {_hex(f'{_U} % 7', 4)} || '0000' || {_hex(f'{_E} % 3', 2)} || repeat('00', 8)",
    f"'000002' || CASE {_E} % 5 WHEN 0 THEN '80' ELSE '02' || {_hex(f'{_U} % 256', 1)} || '8001' || {_hex(_U, 6)} || {_hex(f'{_E} % 1000', 4)} || {_hex(f'32768 + {_U} % 16', 2)} || {_hex(_E, 6)} || {_hex(f'32768 + {_U} % 200', 2)} || '0100140002000F00' END",
    f"'0B590B590000000000000000' || CASE {_E} % 5 WHEN 0 THEN '01000014' || '00000001' || {_hex(f'{_U} * 10 + {_E} % 100', 4)} || '0001000100000001' ELSE '00' || {_hex(f'{_E} % 8', 1)} || '0013' || '00000001' || {_hex(f'{_U} % 32', 2)} || '00000000003CABCDEF00' || '03000010' || '00000002' || {_hex(f'{_E} % 100000', 4)} || '00000000' END",
    f"{_hex(f'{_E} % 5 + 1', 2)} || CASE WHEN {_E} % 5 < 2 THEN hex('f' || {_U} || '.bin') || '00' || hex('Octet') || '00' WHEN {_E} % 5 < 4 THEN {_hex(f'{_U} % 65536', 2)} ELSE {_hex(f'{_U} % 8', 2)} || hex('no') || '00' END",
    f"{_hex(f'{_E} % 5 + 1', 1)} || {_hex(f'{_E} % 256', 1)} || '0000' || repeat('00', 16) || '01' || {_string(f"('u' || {_U})", 2)} || '0406' || {_hex(f'167772160 + {_U} % 256', 4)} || '0806' || {_hex(f'2886729728 + {_U}', 4)} || '2806' || {_hex(f'{_E} % 3 + 1', 4)} || '2A06' || {_hex(f'{_E} % 100000', 4)}",
    f"CASE {_E} % 5 WHEN 0 THEN '0001' WHEN 1 THEN '0111' WHEN 2 THEN '0103' ELSE '0101' END || '0024' || '2112A442' || repeat('01', 12) || '00060003' || hex('abc') || '00' || '002000080001' || {_hex(f'{_U} % 65536', 2)} || {_hex(f'{_U} + 553820160', 4)} || '000900040000' || '04' || {_hex(f'{_U} % 100', 1)}",
    f"'30' || {_hex(f"8 + length('c' || {_U})", 1)} || '0201' || {_hex(f'{_E} % 2', 1)} || '04' || {_string(f"('c' || {_U})")} || 'A' || {_E} % 5 || '00'",
    f"'020704' || {_hex(_U, 6)} || '04' || {_hex(f"1 + length('p' || {_U})", 1)} || '05' || hex('p' || {_U}) || '06020078' || '0A' || {_string(f"('sw' || {_U})")} || '0E04' || {_hex(f'{_U} % 2048', 2)} || {_hex(f'{_U} % 16', 2)} || '0000'",
    f"'02B40000' || '000100' || {_string(f"('dev' || {_U})", 4)} || '000300' || {_string(f"('eth' || {_U} % 48)", 4)} || '00040008' || {_hex(f'{_U} % 128', 4)} || '000A0006' || {_hex(f'{_U} % 4095', 2)} || '000B0005' || {_hex(f'{_E} % 2', 1)}",
    f"'FFFB' || {_hex(f'{_U} % 40', 1)} || 'FFFD03' || 'FFFA18' || '01' || 'FFF0' || hex('ls ' || {_U}) || '0D0A'",
]
#: Hexadecimal frames of twelve binary protocols, by ``kind``.
FRAME_SQL = f"SELECT event_id, user_id, event_id % 12 AS kind, CASE event_id % 12 {' '.join(f'WHEN {i} THEN {k}' for i, k in enumerate(_KINDS))} END AS frame FROM events"

PACKET_SQL = _PACKETS.format(micros="epoch_us(ts)")


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each event: two endpoints, a direction, lengths, header fields and a payload."""
    return _view(spark, sf_dir, _PACKETS.format(micros="unix_micros(CAST(ts AS TIMESTAMP))"), "events")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text message of some protocol for each event."""
    return _view(spark, sf_dir, MESSAGE_SQL, "events")


def frames(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """A binary message for each event of a kind: event_id, user_id, payload."""
    return _view(spark, sf_dir, FRAME_SQL, "events").where(f"kind = {kind}").selectExpr("event_id", "user_id", "unhex(frame) AS payload")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow for each line of an order."""
    return _view(spark, sf_dir, _FLOWS, "lineitem", "orders", "supplier", "nation", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
