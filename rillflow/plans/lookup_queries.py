"""Lookups, links in time, payload features and learning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.functions import query as q
from rillflow.operators import flows as flow_ops
from rillflow.operators import learning, lookups, payload
from rillflow.plans.flow_queries import sessions
from rillflow.plans.registry import L, P, S, query
from rillflow.sources.tables import flows, packets, table


@query(f"""WITH {P}, m AS (SELECT server_port, min(name) AS name FROM (SELECT * FROM (VALUES (80, 'http'), (443, 'https'), (53, 'domain'), (22, 'ssh'), (25, 'smtp')) v(server_port, name)) GROUP BY ALL)
    SELECT p.server_port, coalesce(name, 'unknown') AS name, count(*) AS pkts FROM p LEFT JOIN m ON p.server_port = m.server_port GROUP BY ALL""")
def port_class_lookup(spark, d):
    rows = [(80, "http", 1), (443, "https", 2), (53, "domain", 3), (22, "ssh", 4), (25, "smtp", 5), (80, "www", 6)]
    names = lookups.first_definition(spark.createDataFrame(rows, "server_port long, name string, line int"), ["server_port"], "line")
    return lookups.look_up(packets(spark, d), names, ["server_port"], "name", "unknown").groupBy("server_port", "name").agg(F.count("*").alias("pkts"))


_BANDS = "b AS (SELECT p_size AS band, min(p_retailprice) AS low, max(p_retailprice) + 10 AS high FROM part GROUP BY p_size)"


@query(f"WITH {_BANDS} SELECT band, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high GROUP BY band")
def range_join_subnet(spark, d):
    bands = table(spark, d, "part").groupBy(F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("low"), (F.max("p_retailprice") + 10).alias("high"))
    hit = lookups.range_join(table(spark, d, "orders"), "o_totalprice", bands, "low", "high", 500)
    return hit.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_NETS = """n AS (SELECT CAST(s_suppkey % 200 AS BIGINT) * 16 AS net, 28 AS bits, 'half' AS label FROM supplier UNION SELECT CAST(s_suppkey % 20 AS BIGINT) * 256, 24, 'wide' FROM supplier)"""


@query(f"""WITH {_NETS}, e AS (SELECT event_id, user_id FROM events), h AS (SELECT event_id, label, bits FROM e JOIN n ON CAST(floor(user_id / CASE WHEN bits = 28 THEN 16 ELSE 256 END) AS BIGINT) * CASE WHEN bits = 28 THEN 16 ELSE 256 END = net),
    r AS (SELECT event_id, arg_max(label, bits) AS label FROM h GROUP BY event_id) SELECT coalesce(label, '--') AS label, count(*) AS n FROM e LEFT JOIN r USING (event_id) GROUP BY ALL""")
def lpm_prefix_join(spark, d):
    s = table(spark, d, "supplier")
    nets = s.select((F.col("s_suppkey") % 200 * 16).cast("long").alias("net"), F.lit(28).alias("bits"), F.lit("half").alias("label")).union(s.select((F.col("s_suppkey") % 20 * 256).cast("long"), F.lit(24), F.lit("wide"))).distinct()
    return lookups.longest_prefix(table(spark, d, "events"), "user_id", nets, "net", "bits", "label", "--", ["event_id"]).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0) GROUP BY ALL")
def blacklist_semi(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return lookups.listed(table(spark, d, "orders"), bad, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0) GROUP BY ALL")
def blacklist_anti(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return lookups.listed(table(spark, d, "orders"), bad, "o_custkey", present=False).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"""WITH {L} SELECT appl, dst_port, count(*) AS flows, CAST(sum(bytes_snt) AS BIGINT) AS bytes FROM f
    WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('HTTP', 80), ('HTTP', 8080), ('TLS.HTTP', 443), ('DNS', 53), ('SSH', 22), ('SMTP.Mail', 25)) v(a, p) WHERE a = appl AND p = dst_port) GROUP BY ALL""")
def nonstd_port_anti(spark, d):
    known = spark.createDataFrame([("HTTP", 80), ("HTTP", 8080), ("TLS.HTTP", 443), ("DNS", 53), ("SSH", 22), ("SMTP.Mail", 25)], "appl string, dst_port long")
    return lookups.nonstandard_ports(flows(spark, d), known, ["appl", "dst_port"]).groupBy("appl", "dst_port").agg(F.count("*").alias("flows"), F.sum("bytes_snt").alias("bytes"))


@query("""SELECT label, count(*) AS n FROM (SELECT p_partkey, CASE WHEN p_size <= 10 AND p_retailprice < 1000 THEN 'tiny' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 30 AND p_retailprice > 1200 THEN 'dear' ELSE NULL END AS label FROM part) GROUP BY ALL""")
def first_match_rule(spark, d):
    rules = spark.createDataFrame([(1, 10, 0.0, 1000.0, "tiny"), (2, 20, 0.0, 1e12, "small"), (3, 30, 1200.0, 1e12, "dear")], "no int, size int, low double, high double, label string")
    met = (F.col("p_size") <= F.col("size")) & (F.col("p_retailprice") < F.col("high")) & ((F.col("low") == 0) | (F.col("p_retailprice") > F.col("low")))
    return lookups.first_rule(table(spark, d, "part"), rules, met, "no", "label", ["p_partkey"]).groupBy("label").agg(F.count("*").alias("n"))


_RULES = [(1, "(?i)licen[sc]e", "legal", 2), (2, "AKIA[A-Z0-9]{14}", "key", 5), (3, "[0-9]{3}-[0-9]{4}", "number", 3), (4, "(?i)(token|secret|password)", "credential", 5)]


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS m{i}" for i, p, _, _ in _RULES) + """ FROM documents)
    SELECT doc_id, CAST(m1 AS INTEGER) + CAST(m2 AS INTEGER) + CAST(m3 AS INTEGER) + CAST(m4 AS INTEGER) AS hits, CASE WHEN m2 THEN 'key' WHEN m4 THEN 'credential' WHEN m3 THEN 'number' WHEN m1 THEN 'legal' END AS class, CASE WHEN m2 OR m4 THEN 5 WHEN m3 THEN 3 WHEN m1 THEN 2 END AS severity FROM h""")
def regex_max_severity(spark, d):
    return lookups.regex_rules(table(spark, d, "documents"), "text", _RULES, ["doc_id"])


@query(f"""WITH {P}, x AS (SELECT user_id, server_ip, event_type, lag(event_type) OVER (PARTITION BY server_ip ORDER BY t_us, pkt_no) AS b FROM p) SELECT server_ip, CAST(sum(CASE WHEN event_type <> b THEN 1 ELSE 0 END) AS BIGINT) AS spoofs, count(DISTINCT event_type) AS macs FROM x GROUP BY server_ip""")
def arp_spoof_lag(spark, d):
    p = flow_ops.previous(packets(spark, d), ["server_ip"], "t_us", "pkt_no", "event_type", "before")
    return p.withColumn("__s", F.when(F.col("event_type") != F.col("before"), 1).otherwise(0)).groupBy("server_ip").agg(F.sum("__s").alias("spoofs"), F.countDistinct("event_type").alias("macs"))


@query(f"""WITH {P}, a AS (SELECT * FROM p WHERE event_type = 'purchase'), b AS (SELECT user_id, t_us, max(pkt_no) AS n FROM p WHERE event_type = 'signup' GROUP BY ALL)
    SELECT a.pkt_no, b.n AS seen FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t_us >= b.t_us""")
def dhcp_asof_mac(spark, d):
    p = packets(spark, d)
    seen = p.where("event_type = 'signup'").groupBy("user_id", "t_us").agg(F.max("pkt_no").alias("seen"))
    return lookups.as_of(p.where("event_type = 'purchase'"), seen, ["user_id"], "t_us", "seen", ["pkt_no"])


@query(f"""WITH {S}, h AS (SELECT user_id, server_ip, session, min(t_us) AS t0, max(t_us) AS t1 FROM s GROUP BY ALL), e AS (SELECT pkt_no, user_id, t_us FROM p WHERE event_type = 'error')
    SELECT pkt_no, user_id, session FROM e JOIN h USING (user_id) WHERE t_us BETWEEN t0 AND t1""")
def parent_flow_interval_join(spark, d):
    h = sessions(spark, d).groupBy("user_id", "session").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    e = packets(spark, d).where("event_type = 'error'").select("pkt_no", "user_id", "t_us")
    return lookups.interval_links(e, "t_us", h, "t0", "t1", ["user_id"]).select("pkt_no", "user_id", "session")


@query(f"""WITH {P}, f AS (SELECT user_id, t_us, pkt_no, last_value(CASE WHEN event_type = 'click' THEN pkt_no END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no ROWS UNBOUNDED PRECEDING) AS first_part FROM p)
    SELECT first_part, count(*) AS parts FROM f GROUP BY ALL""")
def fragment_attach_asof(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_us", "pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    return packets(spark, d).withColumn("first_part", F.last(F.when(F.col("event_type") == "click", F.col("pkt_no")), ignorenulls=True).over(w)).groupBy("first_part").agg(F.count("*").alias("parts"))


@query("""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), n AS (SELECT doc_id, b, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n FROM n),
    e AS (SELECT doc_id, CASE WHEN max(n) <= 2 THEN -1.0e0 ELSE round(-sum(c / n * ln(c / n)) / ln(256.0e0), 6) END AS entropy FROM t GROUP BY doc_id)
    SELECT d.doc_id, coalesce(entropy, -1.0e0) AS entropy FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""")
def payload_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(payload.byte_entropy(F.col("text").cast("binary")), 6).alias("entropy"))


@query(r"""SELECT doc_id, round((length(text) - length(regexp_replace(text, '[\x20-\x7F\n\r]', '', 'g'))) * 1.0e0 / greatest(length(text), 1), 6) AS char_ratio,
    round((length(text) - length(regexp_replace(text, '[\x00-\x09]', '', 'g'))) * 1.0e0 / greatest(length(text), 1), 6) AS bin_ratio FROM documents""")
def char_binary_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", *(e.alias(n) for n, e in payload.character_ratios(F.col("text")).items()))


_URL = "regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', {})"


@query(f"SELECT page_id, {_URL.format(1)} AS scheme, {_URL.format(2)} AS host, {_URL.format(3)} AS path, {_URL.format(4)} AS query FROM pages")
def http_url_parse(spark, d):
    return table(spark, d, "pages").select("page_id", *(e.alias(n) for n, e in payload.url_parts(F.col("url")).items()))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"SELECT list_extract(string_split({_HOST}, '.'), -1) AS tld, count(*) AS n FROM pages GROUP BY ALL ORDER BY n DESC, tld LIMIT 10")
def tld_top(spark, d):
    host = payload.url_parts(F.col("url"))["host"]
    return table(spark, d, "pages").groupBy(payload.last_labels(host, 1).alias("tld")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tld").limit(10)


@query(f"SELECT array_to_string(list_slice(string_split({_HOST}, '.'), greatest(len(string_split({_HOST}, '.')) - 1, 1), len(string_split({_HOST}, '.'))), '.') AS sld, count(*) AS n FROM pages GROUP BY ALL ORDER BY n DESC, sld LIMIT 10")
def sld_top(spark, d):
    host = payload.url_parts(F.col("url"))["host"]
    return table(spark, d, "pages").groupBy(payload.last_labels(host, 2).alias("sld")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sld").limit(10)


@query("SELECT md5(concat_ws(',', p_brand, p_type, CAST(p_size AS VARCHAR))) AS print, count(*) AS n FROM part GROUP BY ALL")
def md5_fingerprint(spark, d):
    return table(spark, d, "part").groupBy(payload.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("print")).agg(F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def json_field_agg(spark, d):
    return table(spark, d, "events").groupBy(payload.json_field(F.col("props"), "k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {L} SELECT flow_ind, CASE WHEN tcp_anomaly > 4 THEN 1 ELSE 0 END AS label FROM f")
def anomaly_label_gt4(spark, d):
    text = F.concat(F.lit("0x"), F.lower(F.hex("tcp_anomaly")))
    return flows(spark, d).select("flow_ind", learning.anomaly_label(text).alias("label"))


_KNN = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), qs AS (SELECT * FROM e WHERE vec_id % 50 = 0),
    d AS (SELECT qs.vec_id AS q, e.vec_id AS i, e.label AS y, round(list_dot_product(qs.x, qs.x) - 2 * list_dot_product(qs.x, e.x) + list_dot_product(e.x, e.x), 9) AS d FROM qs JOIN e ON qs.vec_id <> e.vec_id),
    t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, i) <= 5), v AS (SELECT q, y, count(*) AS n FROM t GROUP BY ALL),
    r AS (SELECT q AS vec_id, y AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, y) = 1)"""


def _knn(spark, d):
    e = table(spark, d, "embeddings")
    return learning.nearest_labels(e, e.where("vec_id % 50 = 0"), 5)


@query(_KNN + " SELECT vec_id, predicted FROM r")
def knn_vote(spark, d):
    return _knn(spark, d)


@query(_KNN + " SELECT label, predicted, count(*) AS n FROM r JOIN embeddings USING (vec_id) GROUP BY ALL")
def confusion_matrix(spark, d):
    return learning.confusion(_knn(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id"), "label", "predicted")


@query()
def kmeans_clusters(spark, d):
    return learning.clusters(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "cluster")


@query("SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name, unnest([" + ", ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + "]) AS nulls FROM events")
def missing_values(spark, d):
    return learning.missing(table(spark, d, "events"))


@query(f"""WITH {L} SELECT flow_ind, src_ip LIKE '10.%' AS in_ten, dst_ip LIKE '172.16.%' AS private_dst, upper(src_ip) AS up, CASE WHEN l4_proto = 6 THEN 'TCP' WHEN l4_proto = 17 THEN 'UDP' ELSE 'ICMP' END AS proto,
    src_port BETWEEN 2000 AND 3000 OR dst_port BETWEEN 2000 AND 3000 OR src_port = 80 OR dst_port = 80 AS ports, (flow_stat & 16384) <> 0 AS v4, split_part(appl, '.', 1) = 'TLS' AS tls FROM f""")
def query_functions(spark, d):
    return flows(spark, d).select(
        "flow_ind", q.in_net("src_ip", "10.0.0.0/8").alias("in_ten"), q.private("dst_ip").alias("private_dst"), F.upper(q.ip_text(q.ip_number("src_ip"))).alias("up"), q.protocol_name().alias("proto"),
        q.port(["2000-3000", 80]).alias("ports"), q.status("ipv4").alias("v4"), q.value_contains("appl", ".", "tls", ignore_case=True).alias("tls"),
    )


_PLACES = """n AS (SELECT CAST(n_nationkey AS BIGINT) * 8 AS lo, 8 AS width, 5 AS bits, n_name AS label FROM nation
    UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 4, 2, 7, lower(n_name) FROM nation)"""


@query(f"""WITH {_PLACES}, e AS (SELECT event_id, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 2) AS BIGINT) AS x FROM events), h AS (SELECT event_id, arg_max(label, bits) AS label FROM e JOIN n ON x >= lo AND x < lo + width GROUP BY event_id)
    SELECT coalesce(label, '--') AS label, count(*) AS n FROM e LEFT JOIN h USING (event_id) GROUP BY ALL""")
def ip6_place_lookup(spark, d):
    """Places of 128-bit addresses (digests of the users) by the longest subnet that holds them."""
    n = table(spark, d, "nation")
    digits = lambda v: F.rpad(F.lpad(F.hex(v.cast("long")), 2, "0"), 32, "0")
    nets = n.select(digits(F.col("n_nationkey") * 8).alias("net"), F.lit(5).alias("bits"), F.col("n_name").alias("label"))
    nets = nets.unionByName(n.select(digits(F.col("n_nationkey") * 8 + 4).alias("net"), F.lit(7).alias("bits"), F.lower("n_name").alias("label")))
    e = table(spark, d, "events").select("event_id", F.md5(F.col("user_id").cast("string")).alias("ip6"))
    return lookups.longest_prefix_hex(e, "ip6", nets, "net", "bits", "label", "--", ["event_id"]).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN n_regionkey IS NULL THEN 'unknown' ELSE n_name END AS maker, count(*) AS n FROM events LEFT JOIN nation ON CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 2) AS BIGINT) = n_nationkey GROUP BY ALL")
def mac_maker_lookup(spark, d):
    """Makers of hardware addresses (the first twelve digits of the users' digests) by their prefix."""
    makers = table(spark, d, "nation").select(F.rpad(F.lpad(F.hex(F.col("n_nationkey").cast("long")), 2, "0"), 6, "0").alias("prefix"), F.lit(8).alias("bits"), F.col("n_name").alias("maker"))
    e = table(spark, d, "events").select("event_id", F.substring(F.md5(F.col("user_id").cast("string")), 1, 12).alias("mac"))
    return lookups.longest_prefix_hex(e, "mac", makers, "prefix", "bits", "maker", "unknown", ["event_id"]).groupBy("maker").agg(F.count("*").alias("n"))


@query(f"""WITH {P} SELECT coalesce(CASE WHEN tcp_flags = 2 AND ip_ttl <= 33 AND tcp_win > 500 THEN 'alpha' WHEN tcp_flags = 2 AND ip_ttl <= 34 THEN 'beta' WHEN tcp_flags = 16 AND tcp_win % 13 = 0 AND ip_ttl <= 36 THEN 'gamma' END, 'unknown') AS os, count(*) AS n FROM p GROUP BY ALL""")
def os_first_rule(spark, d):
    """Systems by the first rule that flags, time to live, window and its multiple meet."""
    rules = spark.createDataFrame([(1, 2, 33, 501, 1, "alpha"), (2, 2, 34, 0, 1, "beta"), (3, 16, 36, 0, 13, "gamma")], "no int, flags long, ttl long, least long, multiple long, os string")
    met = (F.col("tcp_flags") == F.col("flags")) & (F.col("ip_ttl") <= F.col("ttl")) & (F.col("tcp_win") >= F.col("least")) & (F.col("tcp_win") % F.col("multiple") == 0)
    return lookups.first_rule(packets(spark, d), rules, met, "no", "os", ["pkt_no"]).groupBy(F.coalesce("os", F.lit("unknown")).alias("os")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) < 858993459 THEN 'test' ELSE 'train' END AS part FROM embeddings")
def train_test_split(spark, d):
    return learning.split(table(spark, d, "embeddings").select("vec_id"), "vec_id")


@query(f"""WITH {L}, t AS (SELECT *, src_ip || '_' || dst_port || '_' || appl AS c, src_cc || ';' || dst_cc AS r FROM f)
    SELECT flow_ind, greatest(pkts_snt, pkts_rcvd, tcp_flags) AS top, least(bytes_snt, bytes_rcvd) AS low, NOT (l4_proto = 6) AS other, split_part(c, '_', 2) AS second, split_part(r, ';', -1) AS last, split_part(c, '_', 1) || ':' || split_part(c, '_', 2) AS endpoint,
           strftime(to_timestamp(flow_ind) AT TIME ZONE 'UTC' + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') || '.000000' AS local, flow_ind * 1000000 AS us, flow_stat <> 0 AS has_ip,
           CAST('0x' || substr(md5(src_ip), 1, 2) AS INTEGER) & 254 = 34 AS in6 FROM t WHERE flow_ind BETWEEN 100 AND 5000 OR flow_ind = 17""")
def query_functions_parts(spark, d):
    """Choice, parts, times, masks and numbers of flows in ranges."""
    t = q.numbered(flows(spark, d), "flow_ind", ["100-5000", 17]).withColumns({"c": F.concat_ws("_", "src_ip", F.col("dst_port").cast("string"), "appl"), "r": F.concat_ws(";", "src_cc", "dst_cc"), "us": F.col("flow_ind") * 1_000_000})
    return t.select(
        "flow_ind", q.largest("pkts_snt", "pkts_rcvd", "tcp_flags").alias("top"), q.smallest("bytes_snt", "bytes_rcvd").alias("low"), q.negated(q.protocol("TCP")).alias("other"), q.compound("c", 2).alias("second"), q.repetition("r", -1).alias("last"),
        q.split_parts("c", "_", 1, 2, ":").alias("endpoint"), q.local_text("us", "+02:00").alias("local"), q.unix_micros(q.utc_text("us")).alias("us"), q.has_status("flow_stat").alias("has_ip"), q.in_net6(F.md5("src_ip"), "2200::", 7).alias("in6"),
    )
