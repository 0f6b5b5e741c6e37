"""Binary protocols: header fields of messages, and their flow features. The SQL computes what the frames were written from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.operators import headers
from rillflow.plans.registry import query
from rillflow.sources.tables import frames


def _fields(name: str, kind: int, decoder: Callable[[Column], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query of some fields of each message of a kind."""

    @query(f"SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM events WHERE event_id % 12 = {kind}", name=f"fields_{name}")
    def run(spark, d):
        return headers.fields(frames(spark, d, kind), decoder, list(sql)).drop("user_id")


_IP = lambda n, first: f"'{first}.' || CAST(floor({n} / 65536) AS BIGINT) % 256 || '.' || CAST(floor({n} / 256) AS BIGINT) % 256 || '.' || {n} % 256"
_MAC = lambda n: f"regexp_replace(lower(lpad(hex({n}), 12, '0')), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"
_CONFIG = lambda v: f"CASE WHEN event_id % 5 <> 0 THEN {v} END"
_OP = lambda low, high, v: f"CASE WHEN event_id % 5 BETWEEN {low} AND {high} THEN {v} END"

_fields("time", 0, headers.time_protocol, {
    "leap": "user_id % 4", "version": "3 + user_id % 2", "mode": "event_id % 5 + 1", "stratum": "event_id % 16", "poll": "6", "precision": "-20", "root_delay": "user_id * 7 + event_id % 1000", "root_dispersion": "event_id % 65536",
    "reference": "'192.168.0.' || user_id % 256", "origin_time": "3900000001 + user_id + event_id % 2 * 0.5e0", "transmit_time": "3900000003 + user_id + event_id % 2 * 0.5e0",
})
_fields("group", 1, headers.group_membership, {
    "kind": "CASE event_id % 5 WHEN 0 THEN 17 WHEN 1 THEN 18 WHEN 2 THEN 22 ELSE 23 END", "code": "user_id % 10", "version": "CASE event_id % 5 WHEN 0 THEN CASE WHEN user_id % 10 = 0 THEN 1 ELSE 2 END WHEN 1 THEN 1 ELSE 2 END",
    "group": _IP("(user_id % 65536)", "224"), "entries": "CAST(NULL AS BIGINT)", "valid": "event_id % 2 = 0",
})
_fields("link_states", 2, headers.link_states, {"version": "2", "kind": "event_id % 5 + 1", "length": "24", "router": _IP("user_id", "10"), "area": _IP("(user_id % 7)", "0"), "auth": "event_id % 3"})
_fields("spanning_tree", 3, headers.spanning_tree, {
    "protocol": "0", "version": "2", "kind": "CASE event_id % 5 WHEN 0 THEN 128 ELSE 2 END", "flags": _CONFIG("user_id % 256"), "root_priority": _CONFIG("32768"), "root": _CONFIG(_MAC("user_id")), "cost": _CONFIG("event_id % 1000"),
    "bridge_priority": _CONFIG("32768"), "bridge": _CONFIG(_MAC("event_id")), "port": _CONFIG("32768 + user_id % 200"), "message_age": _CONFIG("256"), "forward": _CONFIG("3840"),
})
_fields("trivial_transfer", 5, headers.trivial_transfer, {"op": "event_id % 5 + 1", "file": _OP(0, 1, "'f' || user_id || '.bin'"), "mode": _OP(0, 1, "'octet'"), "block": _OP(2, 3, "user_id % 65536"), "error": _OP(4, 4, "user_id % 8"), "said": _OP(4, 4, "'no'")})
_fields("access", 6, headers.access, {"code": "event_id % 5 + 1", "ident": "event_id % 256", "user": "'u' || user_id", "server": "'10.0.0.' || user_id % 256", "framed": "'172.16.' || CAST(floor(user_id / 256) AS BIGINT) || '.' || user_id % 256", "called": "CAST(NULL AS VARCHAR)", "accounting": "event_id % 3 + 1", "bytes_in": "event_id % 100000"})
_fields("traversal", 7, headers.traversal, {
    "kind": "CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END", "method": "CASE event_id % 5 WHEN 2 THEN 3 ELSE 1 END", "attributes": str(1 << 6 | 1 << 32 | 1 << 9), "user": "'abc'", "error": "400 + user_id % 100", "mapped_port": "xor(user_id % 65536, 8466)",
    "mapped_ip": " || '.' || ".join(f"((xor(user_id + 553820160, 554869826) >> {s}) & 255)" for s in (24, 16, 8, 0)),
})
_fields("management", 8, headers.management, {"version": "event_id % 2", "community": "'c' || user_id", "request": "event_id % 5", "user": "CAST(NULL AS VARCHAR)"})
_fields("neighbours", 9, headers.neighbours, {
    "kinds": str(1 | 2 | 4 | 8 | 32 | 128), "chassis_kind": "4", "chassis": _MAC("user_id"), "port_kind": "5", "port": "'p' || user_id", "ttl": "120", "name": "'sw' || user_id", "description": "CAST(NULL AS VARCHAR)", "capable": "user_id % 2048", "enabled": "user_id % 16",
})
_fields("device_discovery", 10, headers.device_discovery, {"version": "2", "ttl": "180", "kinds": str(2 | 8 | 16 | 1024 | 2048), "device": "'dev' || user_id", "port": "'eth' || user_id % 48", "capable": "user_id % 128", "platform": "CAST(NULL AS VARCHAR)", "vlan": "user_id % 4095", "duplex": "event_id % 2"})


@query(r"SELECT event_id, '11;13;10' AS commands, CASE user_id % 40 WHEN 3 THEN '3;24' WHEN 24 THEN '24;3' ELSE user_id % 40 || ';3;24' END AS options, CAST(1 AS BIGINT) << (user_id % 40) | 8 | (1 << 24) AS option_bits, 'ls ' || user_id || chr(13) || chr(10) AS typed FROM events WHERE event_id % 12 = 11")
def fields_terminal(spark, d):
    listed = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ";").alias(a)
    return headers.fields(frames(spark, d, 11), headers.terminal).select("event_id", listed("commands"), listed("options"), "option_bits", "typed")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 5 = 0 AS i, CASE WHEN event_id % 5 = 0 THEN user_id * 10 + event_id % 100 ELSE event_id % 100000 END AS w FROM events WHERE event_id % 12 = 4),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, sum(CASE WHEN i THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM e),
    k AS (SELECT user_id, round(sum(w * pow(0.7e0, back - 1) * CASE WHEN i OR r = 1 THEN 1 ELSE 0.3e0 END), 4) AS smoothed FROM o WHERE coalesce(later, 0) = 0 GROUP BY user_id),
    a AS (SELECT user_id, count(*) AS pkts, bit_or(CASE WHEN i THEN 2 ELSE 9 END) AS types, bit_or(CASE WHEN i THEN 0 ELSE event_id % 8 END) AS flags, count(*) FILTER (NOT i) AS data, count(*) FILTER (i) AS initial, 0 AS aborts, max(CASE WHEN NOT i THEN user_id % 32 END) AS stream, min(w) AS least, max(w) AS largest FROM e GROUP BY user_id)
    SELECT * FROM a JOIN k USING (user_id)""")
def flow_stream_transport(spark, d):
    return headers.stream_transport(frames(spark, d, 4), ["user_id"], "payload", ["event_id"])


@query("SELECT user_id, count(*) AS pkts, bit_or(1 << CAST(event_id % 5 + 1 AS INTEGER)) AS types, bit_or(1 << CAST(event_id % 3 AS INTEGER)) AS auths FROM events WHERE event_id % 12 = 2 GROUP BY user_id")
def flow_link_states(spark, d):
    at = headers.link_states(F.col("payload"))
    return headers.flow_bits(frames(spark, d, 2), ["user_id"], {"types": at["kind"], "auths": at["auth"]})


@query("SELECT user_id, count(*) AS pkts, bit_or(CASE event_id % 5 WHEN 0 THEN 128 ELSE 2 END) AS kinds, bit_or(CASE event_id % 5 WHEN 0 THEN 0 ELSE user_id % 256 END) AS flags FROM events WHERE event_id % 12 = 3 GROUP BY user_id")
def flow_spanning_tree(spark, d):
    at = headers.spanning_tree(F.col("payload"))
    return headers.flow_bits(frames(spark, d, 3), ["user_id"], {}, {"kinds": at["kind"], "flags": at["flags"]})


@query("SELECT user_id, count(*) AS pkts, bit_or(1 << CAST(event_id % 5 + 1 AS INTEGER)) AS modes, min(user_id * 7 + event_id % 1000) AS min_root_delay, max(user_id * 7 + event_id % 1000) AS max_root_delay, min(event_id % 65536) AS min_root_dispersion, max(event_id % 65536) AS max_root_dispersion FROM events WHERE event_id % 12 = 0 GROUP BY user_id")
def flow_time(spark, d):
    at = headers.time_protocol(F.col("payload"))
    return headers.flow_bits(frames(spark, d, 0), ["user_id"], {"modes": at["mode"]}, bounds={k: at[k] for k in ("root_delay", "root_dispersion")})


@query("SELECT user_id, count(*) FILTER (event_id % 5 = 0) AS queries, count(*) FILTER (event_id % 5 IN (1, 2)) AS reports, count(*) FILTER (event_id % 5 > 2) AS leaves, count(*) FILTER (event_id % 2 = 1) AS bad FROM events WHERE event_id % 12 = 1 GROUP BY user_id")
def flow_group(spark, d):
    at = headers.group_membership(F.col("payload"))
    kinds = frames(spark, d, 1).select("user_id", at["kind"].alias("kind"), at["valid"].alias("valid"))
    return kinds.groupBy("user_id").agg(F.count_if(F.col("kind") == 0x11).alias("queries"), F.count_if(F.col("kind").isin(0x12, 0x16, 0x22)).alias("reports"), F.count_if(F.col("kind") == 0x17).alias("leaves"), F.count_if(~F.col("valid")).alias("bad"))


_REQUESTS = {0: "get", 1: "get_next", 2: "response", 3: "set"}


@query(f"SELECT user_id, {', '.join(f'count(*) FILTER (event_id % 5 = {k}) AS {v}' for k, v in _REQUESTS.items())}, count(*) FILTER (event_id % 5 > 3) AS others FROM events WHERE event_id % 12 = 8 GROUP BY user_id")
def flow_management(spark, d):
    return headers.kind_counts(frames(spark, d, 8), ["user_id"], headers.management(F.col("payload"))["request"], _REQUESTS)
