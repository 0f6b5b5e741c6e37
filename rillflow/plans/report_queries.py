"""The report catalogue over flows: one scan each, A and B halves told apart by the status bit."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.functions import query as q
from rillflow.functions.dialects import column_filter, display_filter
from rillflow.operators import decoders, lookups, payload, reports
from rillflow.operators import flows as flow_ops
from rillflow.operators.reports import outward
from rillflow.plans.registry import L, P, query
from rillflow.sources.tables import MESSAGE_SQL, flows, messages, packets, table

_SQL_MEASURE = {"flows": "count(*)", "pkts": "CAST(sum(pkts_snt) AS BIGINT)", "bytes": "CAST(sum(bytes_snt) AS BIGINT)"}


def _sides(a: str, b: str) -> tuple:
    """A label in Spark and in SQL: the initiator's column, the responder's for inverted flows."""
    return lambda: outward(a, b), f"CASE WHEN (flow_stat & 1) = 0 THEN {a} ELSE {b} END"


#: Label name, its two texts, and a condition on both sides.
_LABELS = {
    "srcIP": ("ip", *_sides("src_ip", "dst_ip"), None, "true"), "dstIP": ("ip", *_sides("dst_ip", "src_ip"), None, "true"),
    "srcCC": ("cc", *_sides("src_cc", "dst_cc"), None, "true"), "dstCC": ("cc", *_sides("dst_cc", "src_cc"), None, "true"),
    "tcp_srcPort": ("port", *_sides("src_port", "dst_port"), 6, "l4_proto = 6"), "tcp_dstPort": ("port", *_sides("dst_port", "src_port"), 6, "l4_proto = 6"),
    "udp_srcPort": ("port", *_sides("src_port", "dst_port"), 17, "l4_proto = 17"), "udp_dstPort": ("port", *_sides("dst_port", "src_port"), 17, "l4_proto = 17"),
    "proto": ("proto", lambda: F.col("l4_proto"), "l4_proto", None, "(flow_stat & 49152) <> 0"),
    "appl": ("appl", lambda: F.split_part("appl", F.lit("."), F.lit(1)), "split_part(appl, '.', 1)", None, "dir = 'A'"),
}


def _top(kind: str, measure: str, span: tuple[str, str] | None = None) -> None:
    name, label, sql, proto, condition = _LABELS[kind]
    where = {"proto": lambda: q.is_any_ip(), "appl": lambda: F.col("dir") == "A"}.get(kind, lambda: None if proto is None else F.col("l4_proto") == proto)

    def run(spark, d):
        return reports.top(flows(spark, d), label(), name, measure, 10, where(), *(F.to_date(F.lit(t)) for t in span or ()))

    run.__doc__ = f"Top {kind} by {measure}" + (f" from {span[0]} to {span[1]}." if span else ".")
    during = f" AND day_first >= DATE '{span[0]}' AND day_first <= DATE '{span[1]}'" if span else ""
    query(f"WITH {L} SELECT {sql} AS {name}, {_SQL_MEASURE[measure]} AS {measure} FROM f WHERE ({condition}){during} GROUP BY ALL ORDER BY {measure} DESC, {name} LIMIT 10", f"top_{kind}_{measure}" + "_in_time" * bool(span))(run)


for _kind in _LABELS:
    for _measure in _SQL_MEASURE:
        _top(_kind, _measure)
    _top(_kind, "bytes", ("1995-03-01", "1995-09-30"))


def _top_items(name: str, source: str, column: str, pattern: str, sql_item: str) -> None:
    """Top lists over a repetitive column: unnest, then count."""

    def run(spark, d):
        rows = table(spark, d, source).select(F.explode(F.split(F.coalesce(column, F.lit("")), pattern)).alias("item")).where("item <> ''")
        return reports.top(rows, F.col("item"), "item", "flows")

    query(f"WITH i AS (SELECT unnest({sql_item}) AS item FROM {source}) SELECT item, count(*) AS flows FROM i WHERE item <> '' GROUP BY ALL ORDER BY flows DESC, item LIMIT 10", name)(run)


_top_items("top_dns_queries", "pages", "url", "[/?#&=]+", "string_split_regex(coalesce(url, ''), '[/?#&=]+')")
_top_items("top_http_host", "pages", "url", "^[a-z]+://|[/?#].*$", "string_split_regex(coalesce(url, ''), '^[a-z]+://|[/?#].*$')")
_top_items("top_http_content_type", "part", "p_type", "_", "string_split(coalesce(p_type, ''), '_')")
_top_items("top_http_content_subtype", "part", "p_name", " ", "string_split(coalesce(p_name, ''), ' ')")
_top_items("top_http_server", "orders", "o_orderpriority", "-", "string_split(coalesce(o_orderpriority, ''), '-')")
_top_items("top_http_user_agent", "customer", "c_mktsegment", ";", "string_split(coalesce(c_mktsegment, ''), ';')")


@query("SELECT md5(p_brand) AS ja3, count(*) AS flows FROM part GROUP BY ALL ORDER BY flows DESC, ja3 LIMIT 10")
def top_https_ja3(spark, d):
    return reports.top(table(spark, d, "part"), F.md5("p_brand"), "ja3", "flows")


_KNOWN = "k AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 5)"


@query(f"WITH {_KNOWN} SELECT p_brand AS brand, count(*) AS flows FROM part WHERE p_brand IN (SELECT b FROM k) GROUP BY ALL ORDER BY flows DESC, brand LIMIT 10")
def top_https_ja3_known(spark, d):
    p = table(spark, d, "part")
    return reports.top(p.join(p.where("p_size < 5").select("p_brand").distinct(), "p_brand", "left_semi"), F.col("p_brand"), "brand", "flows")


@query(f"WITH {_KNOWN} SELECT p_brand AS brand, count(*) AS flows FROM part WHERE p_brand NOT IN (SELECT b FROM k) GROUP BY ALL ORDER BY flows DESC, brand LIMIT 10")
def top_https_ja3_unknown(spark, d):
    p = table(spark, d, "part")
    return reports.top(p.join(p.where("p_size < 5").select("p_brand").distinct(), "p_brand", "left_anti"), F.col("p_brand"), "brand", "flows")


@query(f"WITH {L} SELECT count(*) AS flows, min(day_first) AS first, max(day_first) AS last, CAST(sum(pkts_snt) AS BIGINT) AS pkts, CAST(sum(bytes_snt) AS BIGINT) AS bytes FROM f")
def summary(spark, d):
    return reports.summary(flows(spark, d))


@query(f"WITH {L} SELECT min(day_first) AS min_time FROM f")
def min_time(spark, d):
    return flows(spark, d).agg(F.min("day_first").alias("min_time"))


@query(f"WITH {L} SELECT max(day_first) AS max_time FROM f")
def max_time(spark, d):
    return flows(spark, d).agg(F.max("day_first").alias("max_time"))


@query(f"WITH {L} SELECT src_ip AS ip FROM f UNION SELECT dst_ip FROM f")
def unique_ips(spark, d):
    return reports.unique_hosts(flows(spark, d))


@query(f"WITH {L} SELECT CASE tcp_flags % 4 WHEN 0 THEN 'FTP' WHEN 1 THEN 'POP' WHEN 2 THEN 'IMAP' ELSE 'SMTP' END AS kind, src_ip, count(*) AS flows FROM f WHERE tcp_anomaly > 32768 GROUP BY ALL ORDER BY flows DESC, kind, src_ip LIMIT 10")
def passwords_case(spark, d):
    kind = F.element_at(F.create_map(*(F.lit(x) for p in enumerate(("FTP", "POP", "IMAP", "SMTP")) for x in p)), (F.col("tcp_flags") % 4).cast("int"))
    return reports.aggregate(flows(spark, d).where("tcp_anomaly > 32768"), [kind.alias("kind"), "src_ip"], n=10)


@query(f"WITH {L} SELECT CASE WHEN (flow_stat & 1) = 0 THEN src_ip ELSE dst_ip END AS src, CASE WHEN (flow_stat & 1) = 0 THEN dst_ip ELSE src_ip END AS dst, flow_ind FROM f WHERE (tcp_anomaly & 12288) = 12288")
def dns_zone_transfer(spark, d):
    return flows(spark, d).where(q.bits_all("tcp_anomaly", 12288)).select(outward("src_ip", "dst_ip").alias("src"), outward("dst_ip", "src_ip").alias("dst"), "flow_ind")


@query(f"WITH {L} SELECT flow_ind, src_ip, dst_ip, appl FROM f WHERE regexp_matches(appl, '^SSH') AND dst_port = 22")
def ssh_connections(spark, d):
    return flows(spark, d).where(F.col("appl").rlike("^SSH") & (F.col("dst_port") == 22)).select("flow_ind", "src_ip", "dst_ip", "appl")


@query(f"WITH {P}, x AS (SELECT server_ip, client_ip, event_type, count(*) AS n FROM p GROUP BY ALL) SELECT server_ip, event_type, count(*) AS hosts, CAST(max(n) AS BIGINT) AS most FROM x GROUP BY ALL")
def arp_spoofing(spark, d):
    x = packets(spark, d).groupBy("server_ip", "client_ip", "event_type").agg(F.count("*").alias("n"))
    return x.groupBy("server_ip", "event_type").agg(F.count("*").alias("hosts"), F.max("n").alias("most"))


@query(f"""WITH {L}, t AS (SELECT CAST(sum(bytes_snt) AS BIGINT) AS total FROM f), g AS (SELECT src_cc, dst_port, CAST(sum(bytes_snt) AS BIGINT) AS weight FROM f WHERE pkts_snt >= 10 AND l4_proto = 6 OR dst_port = 53 GROUP BY ALL)
    SELECT src_cc, dst_port, weight, round(100.0e0 * weight / total, 4) AS percent FROM g, t WHERE round(100.0e0 * weight / total, 4) BETWEEN 0.05 AND 50""")
def topn_percent(spark, d):
    return reports.top_percent(flows(spark, d), ["src_cc", "dst_port"], F.sum("bytes_snt"), 0.05, 50, column_filter("pkts_snt >= 10 && l4_proto == 6 || dst_port == 53"))


@query(f"WITH {L} SELECT src_ip, count(*) AS n FROM f WHERE l4_proto = 6 AND (tcp_flags & 2) <> 0 AND (src_ip LIKE '10.0.0.%' OR dst_ip LIKE '10.0.0.%') GROUP BY ALL")
def shark_filter(spark, d):
    return flows(spark, d).where(display_filter("tcp && tcp.flags.syn == 1 && ip.addr == 10.0.0.0/24")).groupBy("src_ip").agg(F.count("*").alias("n"))


@query(f"WITH {L} SELECT src_ip AS ip, CAST(sum(pkts_snt) AS BIGINT) AS pkts, count(*) AS flows FROM f GROUP BY ALL ORDER BY pkts DESC, ip LIMIT 15")
def aggr_sums(spark, d):
    return reports.aggregate(flows(spark, d), [F.col("src_ip").alias("ip")], {"pkts": F.sum("pkts_snt"), "flows": F.count("*")}, 15)


@query(f"WITH {L}, i AS (SELECT unnest(string_split(appl, '.')) AS appl FROM f) SELECT appl, count(*) AS flows FROM i WHERE appl <> '' GROUP BY ALL")
def aggrrep_items(spark, d):
    return reports.aggregate_lists(flows(spark, d), "appl", r"\.")


@query(f"WITH {L} SELECT flow_ind, bytes_snt FROM f ORDER BY bytes_snt DESC, flow_ind LIMIT 25")
def t2sort_top(spark, d):
    return flows(spark, d).select("flow_ind", "bytes_snt").orderBy(F.desc("bytes_snt"), "flow_ind").limit(25)


@query(f"WITH {L} SELECT DISTINCT src_cc, dst_cc, l4_proto FROM f")
def distinct_values(spark, d):
    return flows(spark, d).select("src_cc", "dst_cc", "l4_proto").distinct()


@query(f"WITH {L} SELECT src_cc, dst_port FROM f WHERE dir = 'A' EXCEPT ALL SELECT src_cc, dst_port FROM f WHERE dir = 'B'")
def diff_except(spark, d):
    f = flows(spark, d)
    return f.where("dir = 'A'").select("src_cc", "dst_port").exceptAll(f.where("dir = 'B'").select("src_cc", "dst_port"))


@query(f"WITH {L} SELECT src_ip, dst_ip FROM f WHERE dir = 'A' INTERSECT SELECT src_ip, dst_ip FROM f WHERE dir = 'B'")
def intersect_keys(spark, d):
    f = flows(spark, d)
    return f.where("dir = 'A'").select("src_ip", "dst_ip").intersect(f.where("dir = 'B'").select("src_ip", "dst_ip"))


@query("""WITH l AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders),
    j AS (SELECT l.o_orderkey AS lk, l.o_custkey AS a1, r.o_custkey AS b1, l.o_orderstatus AS a2, r.o_orderstatus AS b2 FROM l FULL JOIN r USING (o_orderkey))
    SELECT unnest(['o_custkey', 'o_orderstatus']) AS column_name, unnest([count(*) FILTER (a1 IS DISTINCT FROM b1), count(*) FILTER (a2 IS DISTINCT FROM b2)]) AS differing FROM j""")
def file_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    other = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return reports.differing_columns(o.where("o_orderkey % 3 <> 0"), other, "o_orderkey")


@query(f"""WITH {P}, r AS (SELECT l4_proto, server_port, count(*) AS pkts, CAST(sum(len) AS BIGINT) AS bytes, CAST(grouping(l4_proto) * 2 + grouping(server_port) AS BIGINT) AS level FROM p GROUP BY ROLLUP (l4_proto, server_port))
    SELECT l4_proto, server_port, pkts, bytes, level, round(100.0e0 * pkts / (SELECT count(*) FROM p), 4) AS percent FROM r""")
def rollup_proto_port(spark, d):
    return reports.protocol_totals(packets(spark, d), "l4_proto", "server_port", "len")


_MON = f"""{P}, m AS (SELECT CAST(floor(t_us / 3600000000) AS BIGINT) AS hour, count(*) AS pkts, CAST(sum(len) AS BIGINT) AS bytes FROM p GROUP BY ALL)"""


@query(f"WITH {_MON} SELECT hour, pkts, bytes FROM m")
def mon_tumbling(spark, d):
    p = packets(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    return reports.monitor(p, "ts", "1 hour", "len").select(F.floor(F.unix_micros("t") / 3_600_000_000).alias("hour"), "pkts", "bytes")


@query(f"WITH {_MON} SELECT hour, pkts - coalesce(lag(pkts) OVER (ORDER BY hour), 0) AS pkts_diff, bytes - coalesce(lag(bytes) OVER (ORDER BY hour), 0) AS bytes_diff FROM m")
def mon_diff_lag(spark, d):
    p = packets(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    return reports.monitor(p, "ts", "1 hour", "len").select(F.floor(F.unix_micros("t") / 3_600_000_000).alias("hour"), "pkts_diff", "bytes_diff")


@query(f"WITH {P}, g AS (SELECT server_ip, (t_us - lag(t_us) OVER (PARTITION BY server_ip ORDER BY t_us, pkt_no)) AS gap FROM p) SELECT server_ip, max(gap) AS widest FROM g GROUP BY ALL")
def widest_gap(spark, d):
    p = flow_ops.previous(packets(spark, d), ["server_ip"], "t_us", "pkt_no", "t_us", "before")
    return p.groupBy("server_ip").agg(F.max(F.col("t_us") - F.col("before")).alias("widest"))


_top_items("top_dns_answers", "orders", "o_orderstatus", ";", "string_split(coalesce(o_orderstatus, ''), ';')")
_top_items("top_http_rscode", "lineitem", "l_linestatus", ";", "string_split(coalesce(l_linestatus, ''), ';')")
_top_items("top_https_cert_cn", "part", "p_brand", "#", "string_split(coalesce(p_brand, ''), '#')")
_top_items("top_https_sni", "supplier", "s_name", "#", "string_split(coalesce(s_name, ''), '#')")


def _top_addresses(name: str, bit: int) -> None:
    def run(spark, d):
        return reports.top(flows(spark, d), F.col("dst_ip"), "ip", "flows", 10, q.bits_any("flow_stat", bit))

    query(f"WITH {L} SELECT dst_ip AS ip, count(*) AS flows FROM f WHERE (flow_stat & {bit}) <> 0 GROUP BY ALL ORDER BY flows DESC, ip LIMIT 10", name)(run)


_top_addresses("top_dns_ipv4", 0x4000)
_top_addresses("top_dns_ipv6", 0x8000)

_KNOWN_PORTS = [("HTTP", 80), ("HTTP", 8080), ("TLS", 443), ("DNS", 53), ("SSH", 22), ("SMTP", 25)]


def _top_nonstandard(measure: str) -> None:
    def run(spark, d):
        known = spark.createDataFrame(_KNOWN_PORTS, "appl string, dst_port long")
        rows = flows(spark, d).withColumn("appl", F.split_part("appl", F.lit("."), F.lit(1)))
        return reports.top(lookups.nonstandard_ports(rows, known, ["appl", "dst_port"]), F.concat_ws(":", "appl", "dst_port"), "appl_port", measure)

    pairs = ", ".join(f"('{a}', {p})" for a, p in _KNOWN_PORTS)
    query(f"""WITH {L}, g AS (SELECT *, split_part(appl, '.', 1) AS a FROM f) SELECT a || ':' || dst_port AS appl_port, {_SQL_MEASURE[measure]} AS {measure} FROM g
        WHERE NOT EXISTS (SELECT 1 FROM (VALUES {pairs}) v(n, p) WHERE n = a AND p = dst_port) GROUP BY ALL ORDER BY {measure} DESC, appl_port LIMIT 10""", f"top_proto_over_nonstd_ports_{measure}")(run)


for _measure in _SQL_MEASURE:
    _top_nonstandard(_measure)


@query(f"WITH {L}, u AS (SELECT src_port AS port, bytes_snt AS b FROM f WHERE (flow_stat & 1) = 0 UNION ALL SELECT dst_port, bytes_snt FROM f WHERE (flow_stat & 1) <> 0) SELECT port, count(*) AS flows, CAST(sum(b) AS BIGINT) AS bytes FROM u GROUP BY ALL")
def union_all_ab(spark, d):
    return flows(spark, d).groupBy(outward("src_port", "dst_port").alias("port")).agg(F.count("*").alias("flows"), F.sum("bytes_snt").alias("bytes"))


@query(f"WITH {L} SELECT flow_ind FROM f WHERE (tcp_anomaly & 4096) <> 0 OR pkts_rcvd = 0 AND (tcp_flags & 2) <> 0")
def alarm_filter(spark, d):
    return reports.alarmed(flows(spark, d), q.bits_any("tcp_anomaly", 4096), (F.col("pkts_rcvd") == 0) & q.bits_any("tcp_flags", 2)).select("flow_ind")


_PART = "regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', {})"


@query(f"WITH u AS (SELECT {_PART.format(2)} AS host, {_PART.format(3)} AS path FROM pages), c AS (SELECT host, path, count(*) AS n FROM u WHERE host <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, path) AS r FROM c) SELECT host, CAST(sum(n) AS BIGINT) AS visits, string_agg(path || ' ' || n, ';' ORDER BY r) FILTER (r <= 10) AS paths FROM r GROUP BY host")
def hosts_and_urls(spark, d):
    """Visits of each host, and its ten most visited paths with their visits."""
    u = payload.url_parts(F.col("url"))
    c = table(spark, d, "pages").groupBy(u["host"].alias("host"), u["path"].alias("path")).agg(F.count("*").alias("n")).where("host <> ''")
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path")))
    listed = F.sort_array(F.collect_list(F.when(F.col("r") <= 10, F.struct("r", F.concat_ws(" ", "path", F.col("n").cast("string")).alias("t")))))
    return r.groupBy("host").agg(F.sum("n").alias("visits"), F.array_join(F.transform(listed, lambda x: x["t"]), ";").alias("paths"))


@query(f"WITH u AS (SELECT page_id, {_PART.format(4)} AS q FROM pages), i AS (SELECT page_id, unnest(string_split(q, '&')) AS i FROM u WHERE q <> '') SELECT split_part(i, '=', 1) AS name, count(*) AS n, count(DISTINCT page_id) AS pages, max(split_part(i, '=', 2)) AS greatest FROM i GROUP BY ALL")
def query_strings(spark, d):
    """Names of query-string fields with how often they occur, on how many pages, and their greatest value."""
    i = table(spark, d, "pages").select("page_id", F.explode(F.split(F.nullif(payload.url_parts(F.col("url"))["query"], F.lit("")), "&")).alias("i"))
    return i.groupBy(F.split_part("i", F.lit("="), F.lit(1)).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.max(F.split_part("i", F.lit("="), F.lit(2))).alias("greatest"))


_PROGRAM = r"(?i)\.(exe|dll|msi|bat|scr|ps1)\b"


@query(f"SELECT pkt_no, regexp_matches(text, '{_PROGRAM}') AS by_name, starts_with(text, 'MZ') AS by_mark FROM (SELECT doc_id AS pkt_no, text FROM documents UNION ALL SELECT page_id, url FROM pages) WHERE regexp_matches(text, '{_PROGRAM}') OR starts_with(text, 'MZ')")
def program_downloads(spark, d):
    """Contents and addresses that name a program file or begin with the mark of one."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pkt_no"), "text").unionByName(table(spark, d, "pages").select(F.col("page_id").alias("pkt_no"), F.col("url").alias("text")))
    named, marked = F.col("text").rlike(_PROGRAM), F.col("text").startswith("MZ")
    return rows.where(named | marked).select("pkt_no", named.alias("by_name"), marked.alias("by_mark"))


def _header(name: str) -> str:
    return rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$"


#: Decoders over the messages of the event table, and the same fields by DuckDB: a pattern, and what is made of its group.
_INTEGER = "CAST({} AS INTEGER)"
_DECODED = {
    "http": (decoders.http, {
        "method": (r"^(GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH) ", "{}"), "target": (r"^[A-Z]+ (\S+) HTTP/", "{}"), "status": (r"^HTTP/\d\.\d (\d{3})", _INTEGER),
        "host": (_header("Host"), "{}"), "agent": (_header("User-Agent"), "{}"), "server": (_header("Server"), "{}"), "mime": (r"(?im)^Content-Type:[ \t]*([^;\r\n]*)", "{}"),
    }),
    "mail": (decoders.mail, {
        "command": (r"(?i)^(HELO|EHLO|MAIL|RCPT|DATA|AUTH|STARTTLS|RSET|VRFY|QUIT|USER|PASS|STAT|LIST|RETR|DELE|TOP|UIDL|APOP)\b", "upper({})"), "code": (r"^(\d{3})[ -]", _INTEGER),
        "sender": (r"(?i)^MAIL FROM:\s*<([^>]*)>", "{}"), "recipient": (r"(?i)^RCPT TO:\s*<([^>]*)>", "{}"),
    }),
    "file_transfer": (decoders.file_transfer, {
        "command": (r"^([A-Za-z]{3,4})\b", "upper({})"), "code": (r"^(\d{3})[ -]", _INTEGER), "user": (r"(?i)^USER (\S+)", "{}"), "password": (r"(?i)^PASS (\S+)", "{}"),
        "data_ip": (r"(\d+,\d+,\d+,\d+),\d+,\d+", "replace({}, ',', '.')"), "data_port": (r"\d+,\d+,\d+,\d+,(\d+,\d+)", "CAST(split_part({0}, ',', 1) AS INTEGER) * 256 + CAST(split_part({0}, ',', 2) AS INTEGER)"),
    }),
    "secure_shell": (decoders.secure_shell, {"version": (r"^SSH-(\d\.\d+)-", "{}"), "software": (r"^SSH-\d\.\d+-([^\r\n]*)", "{}")}),
    "chat_relay": (decoders.chat_relay, {"command": (r"^(?::\S+ )?([A-Za-z]+|\d{3})\b", "upper({})"), "nick": (r"(?i)^NICK (\S+)", "{}"), "user": (r"(?i)^USER (\S+)", "{}"), "password": (r"(?i)^PASS (\S+)", "{}")}),
    "system_log": (decoders.system_log, {"severity": (r"^<(\d{1,3})>", "CAST({} AS INTEGER) & 7"), "facility": (r"^<(\d{1,3})>", "CAST({} AS INTEGER) >> 3")}),
    "calls": (decoders.calls, {"method": (r"^([A-Z]+) sip:", "{}"), "status": (r"^SIP/2\.0 (\d{3})", _INTEGER), "call_id": (r"(?im)^Call-ID:\s*(\S+)", "{}")}),
}


def _decode(kind: str) -> None:
    decoder, fields = _DECODED[kind]
    found = lambda pattern: f"nullif(regexp_extract(text, '{pattern}', 1), '')"
    columns = ", ".join(f"{form.format(found(pattern))} AS {name}" for name, (pattern, form) in fields.items())

    def run(spark, d):
        return messages(spark, d).select("pkt_no", *(c.alias(n) for n, c in decoder(F.col("text")).items()))

    run.__doc__ = f"Fields of {kind} messages."
    query(f"WITH m AS ({MESSAGE_SQL}) SELECT pkt_no, {columns} FROM m", f"decode_{kind}")(run)


for _kind in _DECODED:
    _decode(_kind)


@query(f"""WITH {L} SELECT strftime(to_timestamp(flow_ind) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '.000' AS ts, duration AS td, CASE l4_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS pr, src_ip || ':' || src_port AS sap, dst_ip || ':' || dst_port AS dap,
    {" || ".join(f"CASE WHEN (tcp_flags & {b}) <> 0 THEN '{c}' ELSE '.' END" for c, b in (("C", 128), ("E", 64), ("U", 32), ("A", 16), ("P", 8), ("R", 4), ("S", 2), ("F", 1)))} AS flg, pkts_rcvd AS pkt, bytes_rcvd AS byt,
    CASE WHEN duration > 0 THEN pkts_snt / duration ELSE 0.0e0 END AS pps, CASE WHEN duration > 0 THEN 8 * bytes_snt / duration ELSE 0.0e0 END AS bps, CASE WHEN pkts_snt > 0 THEN bytes_snt / pkts_snt ELSE 0.0e0 END AS bpp FROM f""")
def extended_format(spark, d):
    """Flows in the extended output format; their number stands for their second."""
    return q.formatted(flows(spark, d).withColumn("t_first", F.col("flow_ind") * 1_000_000), "extended")
