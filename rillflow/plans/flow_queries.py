"""Flow formation, statistics, histograms, ordered arrays, bit fields and TCP features over packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import arrays, connections, flows, protocols, stats, tcp
from rillflow.plans.registry import P, S, query
from rillflow.sources.tables import packets

#: Seconds of idle time that end a session of the event tables.
IDLE = 21_600
KEY, ORDER = ["user_id"], ["t_us", "pkt_no"]


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessionize(packets(spark, d), KEY, timeout=IDLE)


@query(f"WITH {S} SELECT user_id, session, count(*) AS pkts, round(sum(value), 2) AS bytes, min(t_us) AS t_first, max(t_us) AS t_last, (max(t_us) - min(t_us)) / 1000000.0e0 AS duration FROM s GROUP BY ALL")
def flow_sessions(spark, d):
    return flows.flow_stats(sessions(spark, d), [*KEY, "session"], "value")


@query(f"WITH {S} SELECT user_id, session, count(*) AS pkts, round(sum(value), 2) AS bytes, min(t_us) AS t_first, max(t_us) AS t_last FROM s GROUP BY ALL ORDER BY bytes DESC, user_id, session LIMIT 20")
def flow_top_bytes(spark, d):
    return flow_sessions(spark, d).drop("duration").orderBy(F.desc("bytes"), "user_id", "session").limit(20)


@query(f"""WITH {S}, a AS (SELECT user_id, session, count(*) AS pkts, round(sum(value), 2) AS bytes, (max(t_us) - min(t_us)) / 1000000.0e0 AS duration FROM s GROUP BY ALL)
    SELECT user_id, session, CASE WHEN duration > 0 THEN round(pkts / duration, 6) ELSE 0.0e0 END AS pktps, CASE WHEN duration > 0 THEN round(bytes / duration, 6) ELSE 0.0e0 END AS bytps FROM a""")
def flow_duration_rates(spark, d):
    return flows.rates(flow_sessions(spark, d)).select("user_id", "session", "pktps", "bytps")


_COUNT = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in (("pkts_a", "way = 'A'"), ("pkts_b", "way = 'B'"), ("syns", "(tcp_flags & 2) <> 0"), ("fins", "(tcp_flags & 1) <> 0"), ("resets", "(tcp_flags & 4) <> 0"), ("band0", "len < 32"), ("band1", "len BETWEEN 32 AND 63"), ("band2", "len BETWEEN 64 AND 127"), ("band3", "len >= 128")))


@query(f"""WITH {S}, i AS (SELECT *, coalesce((t_us - lag(t_us) OVER (PARTITION BY user_id, session ORDER BY t_us, pkt_no)) / 1000000.0e0, 0.0e0) AS gap FROM s),
    a AS (SELECT user_id, session, {_COUNT}, CAST(coalesce(sum(len) FILTER (way = 'A'), 0) AS BIGINT) AS bytes_a, CAST(coalesce(sum(len) FILTER (way = 'B'), 0) AS BIGINT) AS bytes_b, min(t_us) AS t_first, max(t_us) AS t_last,
          min(len) AS len_min, max(len) AS len_max, round(avg(len), 4) AS len_mean, round(stddev_pop(len), 4) AS len_std, max(gap) AS gap_max, (max(t_us) - min(t_us)) / count(*) AS gap_mean_us, bit_or(tcp_flags) AS flags,
          min(ip_ttl) AS ttl_min, max(ip_ttl) AS ttl_max, min(tcp_win) AS win_min, max(tcp_win) AS win_max FROM i GROUP BY user_id, session)
    SELECT *, CASE WHEN pkts_a + pkts_b > 0 THEN round((pkts_a - pkts_b) / (pkts_a + pkts_b), 6) ELSE 0.0e0 END AS pkts_asym, CASE WHEN bytes_a + bytes_b > 0 THEN round((bytes_a - bytes_b) / (bytes_a + bytes_b), 6) ELSE 0.0e0 END AS bytes_asym FROM a""")
def flow_features(spark, d):
    return flows.features(sessions(spark, d), ["user_id", "session"])


@query(f"WITH {S} SELECT user_id, session, arg_min(way, struct_pack(t := t_us, n := pkt_no)) AS first_way, CAST(max(CASE WHEN way = 'B' THEN 1 ELSE 0 END) AS INTEGER) AS answered FROM s GROUP BY ALL")
def flow_direction_ab(spark, d):
    return sessions(spark, d).groupBy("user_id", "session").agg(F.min_by("way", F.struct("t_us", "pkt_no")).alias("first_way"), F.max(F.when(F.col("way") == "B", 1).otherwise(0)).alias("answered"))


@query(f"""WITH RECURSIVE {S}, o AS (SELECT user_id, session, t_us, row_number() OVER (PARTITION BY user_id, session ORDER BY t_us, pkt_no) AS r FROM s),
    c AS (SELECT user_id, session, r, t_us AS first, 0 AS part FROM o WHERE r = 1
          UNION ALL SELECT o.user_id, o.session, o.r, CASE WHEN o.t_us - c.first >= 28800000000 THEN o.t_us ELSE c.first END, c.part + CASE WHEN o.t_us - c.first >= 28800000000 THEN 1 ELSE 0 END
          FROM c JOIN o ON o.user_id = c.user_id AND o.session = c.session AND o.r = c.r + 1)
    SELECT user_id, session, CAST(part AS BIGINT) AS part, count(*) AS pkts FROM c GROUP BY ALL""")
def flow_lifespan_cut(spark, d):
    return flows.lifespan_cut(sessions(spark, d), ["user_id", "session"], 28_800).groupBy("user_id", "session", "part").agg(F.count("*").alias("pkts"))


@query(f"""WITH {P} SELECT CASE WHEN client_ip < server_ip THEN client_ip ELSE server_ip END AS low, CASE WHEN client_ip < server_ip THEN server_ip ELSE client_ip END AS high, count(*) AS pkts FROM p GROUP BY ALL""")
def canonical_pairs(spark, d):
    k = flows.canonical_key(F.when(F.col("way") == "A", F.col("client_ip")).otherwise(F.col("server_ip")), F.when(F.col("way") == "A", F.col("server_ip")).otherwise(F.col("client_ip")))
    return packets(spark, d).groupBy(k.alias("k")).agg(F.count("*").alias("pkts")).select(F.col("k")[0].alias("low"), F.col("k")[1].alias("high"), "pkts")


@query(f"WITH {P} SELECT CAST(floor(user_id / 16) AS BIGINT) * 16 AS net, CASE WHEN server_port BETWEEN 1 AND 1023 THEN 1 ELSE 0 END AS low_port, count(*) AS pkts FROM p GROUP BY ALL")
def aggregated_keys(spark, d):
    ip, port = flows.masked_key("user_id", 28, "server_port", (1, 1023))
    return packets(spark, d).groupBy(ip.alias("net"), port.alias("low_port")).agg(F.count("*").alias("pkts"))


@query(f"""WITH {P}, a AS (SELECT user_id, coalesce(sum(CASE WHEN way = 'A' THEN len END), 0) AS len_a, coalesce(sum(CASE WHEN way = 'B' THEN len END), 0) AS len_b FROM p GROUP BY user_id)
    SELECT user_id, CAST(len_a AS BIGINT) AS len_a, CAST(len_b AS BIGINT) AS len_b, CASE WHEN len_a + len_b > 0 THEN round((len_a - len_b) * 1.0e0 / (len_a + len_b), 6) ELSE 0.0e0 END AS len_asym FROM a""")
def ab_asymmetry(spark, d):
    return flows.pair(packets(spark, d), "user_id", "way", ["len"])


@query(f"""WITH {S}, h AS (SELECT user_id, session, way, count(*) AS pkts, sum(len) AS bytes FROM s GROUP BY ALL)
    SELECT a.user_id, a.session, a.pkts AS pkts_snt, coalesce(b.pkts, 0) AS pkts_rcvd, CAST(coalesce(b.bytes, 0) AS BIGINT) AS bytes_rcvd
    FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND a.session = b.session AND b.way = 'B' WHERE a.way = 'A'""")
def ab_pair_join(spark, d):
    both = sessions(spark, d).groupBy("user_id", "session").agg(*(f(F.when(F.col("way") == w, F.col("len"))).alias(n) for f, w, n in ((F.count, "A", "pkts_snt"), (F.count, "B", "pkts_rcvd"), (F.sum, "B", "bytes_rcvd"))))
    return both.where("pkts_snt > 0").withColumn("bytes_rcvd", F.coalesce("bytes_rcvd", F.lit(0)))


@query(f"WITH {P} SELECT user_id, sum(CASE WHEN CAST(user_id AS VARCHAR) = json_extract_string(props, '$.k') THEN 1 ELSE 0 END)::BIGINT AS land, count(*) AS pkts FROM p GROUP BY user_id")
def land_attack(spark, d):
    same = F.col("user_id").cast("string") == F.get_json_object("props", "$.k")
    return packets(spark, d).groupBy("user_id").agg(F.sum(F.when(same, 1).otherwise(0)).alias("land"), F.count("*").alias("pkts"))


@query(f"""WITH {S}, h AS (SELECT user_id, session, arg_min(tcp_flags, struct_pack(t := t_us, n := pkt_no)) AS flags, min(server_port) AS sp, min(client_port) AS cp FROM s GROUP BY ALL)
    SELECT user_id, session, CASE WHEN (flags & 18) = 18 OR (sp < 1024 AND sp < cp) THEN true ELSE false END AS inverted FROM h""")
def inverted_flows(spark, d):
    first = sessions(spark, d).groupBy("user_id", "session").agg(F.min_by("tcp_flags", F.struct("t_us", "pkt_no")).alias("f"), F.min("server_port").alias("sp"), F.min("client_port").alias("cp"))
    return first.select("user_id", "session", flows.inverted(F.col("f"), F.col("sp"), F.col("cp")).alias("inverted"))


@query(f"WITH {P} SELECT user_id, way, min(len) AS min, max(len) AS max, round(avg(len), 6) AS avg FROM p GROUP BY ALL")
def basic_minmaxavg(spark, d):
    return flows.min_max_avg(packets(spark, d), ["user_id", "way"], "len")


@query(f"""WITH {P}, i AS (SELECT user_id, coalesce((t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no)) / 1000000.0e0, 0.0e0) AS iat FROM p)
    SELECT user_id, round(min(iat), 6) AS min_iat, round(max(iat), 6) AS max_iat, round(avg(iat), 4) AS avg_iat FROM i GROUP BY user_id""")
def basic_iat(spark, d):
    return flows.interarrival(packets(spark, d), KEY).groupBy("user_id").agg(F.round(F.min("iat"), 6).alias("min_iat"), F.round(F.max("iat"), 6).alias("max_iat"), F.round(F.avg("iat"), 4).alias("avg_iat"))


@query(f"""WITH {P}, m AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no ROWS UNBOUNDED PRECEDING) AS m FROM p)
    SELECT user_id, round(avg((value - m) * (value - m)), 4) AS run_var FROM m GROUP BY user_id""")
def basic_running_var(spark, d):
    return flows.running_variance(packets(spark, d), KEY, "value", *ORDER)


@query(f"WITH {S}, a AS (SELECT user_id, session, sum(len) AS len FROM s GROUP BY ALL) SELECT user_id AS talker, CAST(len AS BIGINT) AS len FROM a ORDER BY len DESC, user_id LIMIT 1")
def biggest_talker(spark, d):
    return flows.biggest_talker(sessions(spark, d).groupBy("user_id", "session").agg(F.sum("len").alias("len")), "len", "user_id", "user_id")


@query(f"WITH {P} SELECT server_ip, count(DISTINCT client_ip) AS peers, count(*) AS flows FROM p GROUP BY ALL")
def conn_distinct_peers(spark, d):
    return connections.distinct_peers(packets(spark, d), "server_ip", "client_ip")


@query(f"""WITH {S}, h AS (SELECT user_id, session, min(t_us) AS t0, max(t_us) AS t1, user_id * 100000 + session AS id, min(server_ip) AS server_ip FROM s GROUP BY user_id, session),
    e AS (SELECT server_ip, t0 AS t, 1 AS d, id FROM h UNION ALL SELECT server_ip, t1, -1, id FROM h),
    r AS (SELECT server_ip, sum(d) OVER (PARTITION BY server_ip ORDER BY t, d DESC, id ROWS UNBOUNDED PRECEDING) AS live FROM e)
    SELECT server_ip, CAST(max(live) AS BIGINT) AS most_live FROM r GROUP BY server_ip""")
def conn_active_overlap(spark, d):
    h = sessions(spark, d).groupBy("user_id", "session").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.min("server_ip").alias("server_ip")).withColumn("id", F.col("user_id") * 100000 + F.col("session"))
    return connections.active_overlap(h, ["server_ip"], "t0", "t1", "id")


_FLOWS = f"{S}, h AS (SELECT user_id * 100000 + session AS id, min(client_ip) AS src, min(server_ip) AS dst, min(server_port) AS port, min(t_us) AS t0, max(t_us) AS t1 FROM s GROUP BY user_id, session)"


@query(f"""WITH {_FLOWS}, l AS (SELECT a.id, b.src = a.src AS s, b.dst = a.dst AS t, b.port = a.port AS p, b.src AS bs, b.dst AS bd FROM h a JOIN h b ON (b.src = a.src OR b.dst = a.dst) AND b.t0 <= a.t1 AND b.t1 >= a.t1),
    c AS (SELECT id, count(DISTINCT CASE WHEN s THEN bd END) AS conn_src, count(DISTINCT CASE WHEN t THEN bs END) AS conn_dst, count(*) FILTER (s AND t) AS conn_pair, count(DISTINCT CASE WHEN s AND p THEN bd END) AS conn_src_port FROM l GROUP BY id)
    SELECT *, round(conn_src_port / conn_src, 6) AS conn_f FROM c""")
def conn_flow_end(spark, d):
    h = sessions(spark, d).groupBy("user_id", "session").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.min("client_ip").alias("src"), F.min("server_ip").alias("dst"), F.min("server_port").alias("port")).withColumn("id", F.col("user_id") * 100000 + F.col("session"))
    return connections.connection_counters(h, "src", "dst", "port", "t0", "t1", "id")


@query(f"WITH {P} SELECT user_id, count(*) AS pkts, count(*) FILTER (len BETWEEN 20 AND 80) AS counted, coalesce(min(len) FILTER (len BETWEEN 20 AND 80), 0) AS min, coalesce(max(len) FILTER (len BETWEEN 20 AND 80), 0) AS max, round(coalesce(avg(len) FILTER (len BETWEEN 20 AND 80), 0.0e0), 4) AS mean FROM p GROUP BY user_id")
def size_band_stats(spark, d):
    return stats.band_stats(packets(spark, d), KEY, "len", 20, 80)


@query(f"""WITH {P}, r AS (SELECT user_id, tcp_win, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, pkt_no DESC) AS r FROM p)
    SELECT user_id, round(sum(tcp_win * 0.3e0 * pow(0.7e0, r - 1)) + arg_max(tcp_win, r) * pow(0.7e0, count(*)), 4) AS smoothed FROM r GROUP BY user_id""")
def window_smoothed(spark, d):
    return tcp.smoothed(packets(spark, d), KEY, "tcp_win", ORDER)


@query(f"""WITH {P}, a AS (SELECT server_ip, server_port, count(*) AS port_flows FROM p GROUP BY ALL), b AS (SELECT server_ip, count(DISTINCT client_ip) AS peers FROM p GROUP BY ALL)
    SELECT server_ip, server_port, port_flows, peers, round(port_flows / peers, 6) AS conn_f FROM a JOIN b USING (server_ip)""")
def conn_f(spark, d):
    return connections.connection_ratio(packets(spark, d), "server_ip", "client_ip", "server_port")


_IAT = f"""{P}, i AS (SELECT *, coalesce((t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no)) / 100000000.0e0, 0.0e0) AS ms FROM p),
    b AS (SELECT *, CAST(CASE WHEN ms < 200 THEN floor(ms) WHEN ms < 400 THEN 200 + floor((ms - 200) / 5) WHEN ms < 1000 THEN 240 + floor((ms - 400) / 10) ELSE 300 END AS BIGINT) AS bin FROM i)"""


def _scaled_iat(spark, d):
    """Events lie hours apart: a hundred seconds stand for a millisecond."""
    return flows.interarrival(packets(spark, d), KEY).withColumn("ms", F.coalesce((F.col("t_us") - F.lag("t_us").over(flows.Window.partitionBy("user_id").orderBy(*ORDER))) / 100_000_000.0, F.lit(0.0)))


@query(f"""WITH {_IAT}, c AS (SELECT user_id, len AS size, bin, count(*) AS cnt FROM b GROUP BY ALL)
    SELECT user_id, size, bin, cnt, CAST(sum(cnt) OVER (PARTITION BY user_id, size) AS BIGINT) AS size_cnt, CAST(sum(cnt) OVER (PARTITION BY user_id, bin) AS BIGINT) AS bin_cnt FROM c""")
def ps_iat_hist(spark, d):
    return stats.size_iat_histogram(_scaled_iat(spark, d), KEY, "len", "ms")


@query(f"""WITH {P}, u AS (SELECT len FROM p WHERE len > 0), t AS (SELECT pow(10.0e0, floor(log10(max(len))) + 1) AS top FROM u),
    c AS (SELECT CAST(least(floor(len / (top / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM u, t GROUP BY ALL), e AS (SELECT unnest(range(10)) AS bin, top FROM t)
    SELECT e.bin, e.bin * (top / 10) AS low, coalesce(n, 0) AS n, round(100.0e0 * coalesce(n, 0) / sum(n) OVER (), 4) AS percent FROM e LEFT JOIN c USING (bin)""")
def flowstat_hist(spark, d):
    return stats.value_histogram(packets(spark, d), "len")


@query(f"""WITH {P}, o AS (SELECT user_id, len AS x, row_number() OVER (PARTITION BY user_id ORDER BY len) AS r, count(*) OVER (PARTITION BY user_id) AS n, avg(len) OVER (PARTITION BY user_id) AS mu FROM p),
    k AS (SELECT user_id, min(x) AS min, max(x) AS max, max(mu) AS mean, max(n) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4,
          {", ".join(f"max(CASE WHEN r = greatest(1, least(n, floor(n*{q}+0.5e0))) THEN x END) AS {n}_0, max(CASE WHEN r = greatest(1, least(n, ceil(n*{q}+0.5e0))) THEN x END) AS {n}_1, max(n*{q}+0.5e0-floor(n*{q}+0.5e0)) AS {n}_2" for n, q in (("q1", "0.25e0"), ("med", "0.5e0"), ("q3", "0.75e0")))} FROM o GROUP BY user_id),
    c AS (SELECT user_id, x, count(*) AS c FROM o GROUP BY ALL), md AS (SELECT user_id, x AS mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, x) = 1),
    v AS (SELECT *, {", ".join(f"CASE WHEN n = 1 THEN min ELSE {n}_0 + ({n}_1 - {n}_0) * {n}_2 END AS {n}" for n in ("q1", "med", "q3"))} FROM k)
    SELECT user_id, min, max, round(mean, 4) AS mean, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, mode, round(sqrt(m2), 4) AS std, round(least(sqrt(m2), 0.7413e0 * (q3 - q1)), 6) AS robust_std,
           round(CASE WHEN m2 > 0 THEN m3 / pow(sqrt(m2), 3) ELSE 0 END, 4) AS skew, round(CASE WHEN m2 > 0 THEN m4 / pow(m2, 2) - 3 ELSE 0 END, 4) AS excess FROM v JOIN md USING (user_id)""")
def desc_stats_pl(spark, d):
    return stats.length_stats(packets(spark, d), KEY, "len")


@query(f"""WITH {_IAT}, e AS (SELECT user_id, CASE WHEN bin >= 300 THEN 1000.0e0 WHEN bin < 200 THEN bin + 0.5e0 WHEN bin < 240 THEN 200 + (bin - 200) * 5 + 2.5e0 ELSE 400 + (bin - 240) * 10 + 5.0e0 END AS x FROM b),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e)
    SELECT user_id, {", ".join(f"round((max(CASE WHEN r = greatest(1, least(n, ceil((n-1)*{q}+1))) THEN x END) + max(CASE WHEN r = greatest(1, least(n, CASE WHEN floor((n-1)*{q}+1) = (n-1)*{q}+1 THEN (n-1)*{q}+2 ELSE ceil((n-1)*{q}+1) END)) THEN x END)) / 2, 4) AS {n}" for n, q in (("q1", "0.25e0"), ("med", "0.5e0"), ("q3", "0.75e0")))} FROM o GROUP BY user_id""")
def desc_stats_iat(spark, d):
    return stats.iat_quartiles(_scaled_iat(spark, d), KEY, "ms")


@query(f"""WITH {S}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY t_us, pkt_no) AS r FROM s)
    SELECT user_id, session, string_agg(CAST(len AS VARCHAR), ';' ORDER BY r) AS lens FROM o WHERE r <= 20 GROUP BY ALL""")
def first_n_packets(spark, d):
    first = arrays.first_packets(sessions(spark, d), ["user_id", "session"], ["len"], ORDER)
    return first.select("user_id", "session", F.array_join(F.transform("first", lambda x: x["len"].cast("string")), ";").alias("lens"))


@query(f"""WITH {P}, m AS (SELECT user_id, event_type, min(struct_pack(t := t_us, n := pkt_no)) AS t FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM m)
    SELECT user_id, string_agg(event_type, ';' ORDER BY r) AS listed, max(n) AS n_distinct FROM r WHERE r <= 3 GROUP BY user_id""")
def distinct_mac_list(spark, d):
    return arrays.distinct_in_order(packets(spark, d), KEY, "event_type", ORDER, 3)


@query(f"""WITH {S}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY t_us, pkt_no) AS r, lag(event_type) OVER (PARTITION BY user_id, session ORDER BY t_us, pkt_no) AS pe FROM s),
    h AS (SELECT *, sum(CASE WHEN pe = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, session ORDER BY r) AS grp FROM o),
    c AS (SELECT user_id, session, grp, event_type, count(*) AS n FROM h GROUP BY ALL)
    SELECT user_id, session, string_agg(event_type || CASE WHEN n > 1 THEN '{{' || n || '}}' ELSE '' END, ':' ORDER BY grp) AS chain FROM c GROUP BY ALL""")
def header_desc_counts(spark, d):
    return arrays.header_runs(sessions(spark, d), ["user_id", "session"], "event_type", ORDER)


@query(f"""WITH {P}, i AS (SELECT *, coalesce((t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no)) / 1000000.0e0, 0.0e0) AS iat FROM p),
    g AS (SELECT *, CAST(sum(CASE WHEN iat >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pulse FROM i)
    SELECT user_id, pulse, count(*) AS pkts, CAST(sum(len) AS BIGINT) AS bytes FROM g GROUP BY ALL""")
def packet_pulses(spark, d):
    return arrays.pulses(flows.interarrival(packets(spark, d), KEY), KEY, "iat", "len", ORDER, 3600)


@query()
def flow_wavelet(spark, d):
    w = arrays.flow_wavelets(packets(spark, d), KEY, "len", ORDER)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.round(x, 4).cast("string")), ";")
    return w.select("user_id", "n", F.array_join(F.transform("detail", text), "|").alias("detail"), text(F.col("approx")).alias("approx"))


@query(f"WITH {P} SELECT user_id, bit_or(tcp_flags) AS flags, bool_or((tcp_flags & 24) = 24) AS all_set, bool_or((tcp_flags & 5) <> 0) AS any_set FROM p GROUP BY user_id")
def bit_or_flags(spark, d):
    f = F.col("tcp_flags")
    return packets(spark, d).groupBy("user_id").agg(F.bit_or("tcp_flags").alias("flags"), F.bool_or(tcp.bits(f, 24, True)).alias("all_set"), F.bool_or(tcp.bits(f, 5, False)).alias("any_set"))


@query(f"""WITH {P}, o AS (SELECT user_id, bit_or(tcp_flags) AS f FROM p GROUP BY user_id) SELECT user_id, {" || ".join(f"CASE WHEN (f & {b}) <> 0 THEN '{c}' ELSE '.' END" for c, b in (("C", 128), ("E", 64), ("U", 32), ("A", 16), ("P", 8), ("R", 4), ("S", 2), ("F", 1)))} AS flags FROM o""")
def tcpflags_string(spark, d):
    return packets(spark, d).groupBy("user_id").agg(F.bit_or("tcp_flags").alias("f")).select("user_id", tcp.flags_text(F.col("f")).alias("flags"))


@query(f"""WITH {P}, m AS (SELECT user_id, t_us, pkt_no, sign(tcp_win - lag(tcp_win) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no)) AS d FROM p),
    n AS (SELECT *, coalesce(last_value(CASE WHEN d <> 0 THEN d END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS e FROM m)
    SELECT user_id, count(*) FILTER (d > 0) AS ups, count(*) FILTER (d < 0) AS downs, count(*) FILTER (d <> 0 AND d <> e) AS turns FROM n GROUP BY user_id""")
def window_updown_changes(spark, d):
    return tcp.window_moves(packets(spark, d), KEY, "tcp_win", ORDER)


@query(f"""WITH {P}, x AS (SELECT user_id, pkt_no - (lag(pkt_no) OVER w + lag(len) OVER w) AS o FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t_us, pkt_no))
    SELECT user_id, CAST(sum(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, CAST(sum(CASE WHEN o < 0 THEN 1 ELSE 0 END) AS BIGINT) AS repeats FROM x GROUP BY user_id""")
def seq_gap_faults(spark, d):
    return tcp.sequence_faults(packets(spark, d), KEY, "pkt_no", "len", ORDER)


@query(f"""WITH {P}, x AS (SELECT user_id, ip_id, lag(ip_id) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no) AS b FROM p)
    SELECT user_id, min(((ip_id - b) % 65536 + 65536) % 65536) AS min_step, max(((ip_id - b) % 65536 + 65536) % 65536) AS max_step, CAST(sum(CASE WHEN ip_id < b THEN 1 ELSE 0 END) AS BIGINT) AS rollovers FROM x GROUP BY user_id""")
def ipid_rollover(spark, d):
    return tcp.rolling_delta(packets(spark, d), KEY, "ip_id", ORDER, 65536)


@query(f"""WITH {P}, x AS (SELECT user_id, ip_ttl, lag(ip_ttl) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no) AS b FROM p)
    SELECT user_id, min(ip_ttl) AS min, max(ip_ttl) AS max, CAST(sum(CASE WHEN ip_ttl <> b THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM x GROUP BY user_id""")
def ttl_change_count(spark, d):
    return tcp.changes(packets(spark, d), KEY, "ip_ttl", ORDER)


@query(f"""WITH {P}, m AS (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no ROWS UNBOUNDED PRECEDING) AS m FROM p)
    SELECT user_id, round(avg(value), 4) AS rtt, round(avg(abs(value - m)), 4) AS jitter FROM m GROUP BY user_id""")
def rtt_running_avg(spark, d):
    return tcp.running_average(packets(spark, d), KEY, "value", ORDER)


@query(f"""WITH {S}, h AS (SELECT user_id, session, min(client_ip) AS src, min(server_ip) AS dst, count(*) AS pkts, bit_or(tcp_flags) AS flags, max(CASE WHEN way = 'B' THEN 1 ELSE 0 END) AS answered FROM s GROUP BY ALL)
    SELECT src, count(*) AS scan_flows, count(DISTINCT dst) AS targets FROM h WHERE answered = 0 AND pkts < 5 AND (flags & 6) <> 0 GROUP BY src""")
def scan_detector(spark, d):
    h = sessions(spark, d).groupBy("user_id", "session").agg(F.min("client_ip").alias("src"), F.min("server_ip").alias("dst"), F.count("*").alias("pkts"), F.bit_or("tcp_flags").alias("flags"), F.max(F.when(F.col("way") == "B", 1).otherwise(0)).alias("answered"))
    return tcp.scanners(h.where("answered = 0"), "src", "dst", "pkts", "flags", "flags", 0)


@query()
def tcp_state_machine(spark, d):
    return tcp.connection_states(sessions(spark, d).where("l4_proto = 6"), ["user_id", "session"])


@query(f"""WITH {P}, a AS (SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS requests, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS replies FROM p GROUP BY user_id)
    SELECT *, CASE WHEN requests > 0 THEN round(replies / requests, 6) ELSE -CAST(replies AS DOUBLE) END AS ratio FROM a""")
def icmp_echo_ratio(spark, d):
    return protocols.echo_ratio(packets(spark, d), KEY, F.col("event_type") == "click", F.col("event_type") == "view")


# DuckDB can't shift into the sign bit: bit 63 is written as the smallest number.
@query(f"""WITH {P} SELECT user_id, coalesce(bit_or(CASE WHEN len % 70 < 63 THEN CAST(1 AS BIGINT) << (len % 70) WHEN len % 70 = 63 THEN CAST(-9223372036854775808 AS BIGINT) END), 0) AS types, count(*) FILTER (len % 70 < 64) AS pkts FROM p GROUP BY user_id""")
def modbus_function_bits(spark, d):
    return protocols.type_bits(packets(spark, d), KEY, F.col("len") % 70)


@query(f"WITH {P} SELECT server_ip, len % 8 AS severity, CAST(floor(len / 8) AS BIGINT) % 24 AS facility, least(count(*), 65535) AS n FROM p GROUP BY ALL")
def syslog_matrix(spark, d):
    return protocols.matrix(packets(spark, d), ["server_ip"], F.col("len") % 8, F.floor(F.col("len") / 8) % 24)


@query(f"""WITH {P}, c AS (SELECT user_id, server_ip, event_type, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, server_ip, event_type) AS r FROM c)
    SELECT user_id, string_agg(server_ip || '_' || event_type || '_' || n, ';' ORDER BY r) AS pairs FROM r WHERE r <= 16 GROUP BY user_id""")
def mac_pairs(spark, d):
    return protocols.endpoint_pairs(packets(spark, d), KEY, "server_ip", "event_type")


@query(f"""WITH {P}, s AS (SELECT user_id, ((ip_id - lag(ip_id) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no)) % 65536 + 65536) % 65536 AS step FROM p), a AS (SELECT user_id, CAST(sum(CASE WHEN step <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS missed, count(*) AS pkts FROM s GROUP BY user_id)
    SELECT *, round(missed / pkts, 6) AS miss_ratio FROM a""")
def voip_sequence_misses(spark, d):
    return protocols.sequence_misses(packets(spark, d), KEY, "ip_id", ORDER)


@query(f"WITH {P} SELECT server_ip, min(ip_ttl) AS min_ip_ttl, max(ip_ttl) AS max_ip_ttl, min(len) AS min_len, max(len) AS max_len FROM p GROUP BY server_ip")
def vrrp_ranges(spark, d):
    return protocols.ranges(packets(spark, d), ["server_ip"], ["ip_ttl", "len"])
