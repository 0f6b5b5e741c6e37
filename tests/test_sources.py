"""Captures, flow files and decoders on files made here."""

import hashlib
import struct

from pyspark.sql import functions as F

from rillflow.operators import decoders, flows
from rillflow.sources import captures, files


def ipv4(proto, body, src="10.0.0.1", dst="10.0.0.2", frag=0):
    octets = lambda a: bytes(map(int, a.split(".")))
    return struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 7, frag, 64, proto, 0) + octets(src) + octets(dst) + body


def tcp(sp, dp, flags, data=b""):
    return struct.pack("!HHIIBBHHH", sp, dp, 1, 2, 0x50, flags, 512, 0, 0) + data


def ethernet(kind, body, vlan=None):
    tag = struct.pack("!HH", 0x8100, vlan) if vlan is not None else b""
    return bytes(6) + bytes([0, 1, 2, 3, 4, 5]) + tag + struct.pack("!H", kind) + body


def capture(path, frames, cut=0, order="<", magic=0xA1B2C3D4):
    data = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        data += struct.pack(order + "IIII", 1000 + i, 5, len(f), len(f)) + f
    path.write_bytes(data[: len(data) - cut])


def test_captures(spark, tmp_path):
    frames = [
        ethernet(0x0800, ipv4(6, tcp(5000, 80, 2))), ethernet(0x0800, ipv4(17, struct.pack("!HHHH", 53, 5353, 13, 0) + b"hello"), vlan=12),
        ethernet(0x86DD, struct.pack("!IHBB", 6 << 28, 24, 6, 9) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + tcp(1, 2, 16, b"data")),
        ethernet(0x0800, ipv4(47, struct.pack("!HH", 0, 0x0800) + ipv4(1, b"ping"))), ethernet(0x0806, b"arp"), b"\x00", ethernet(0x0800, ipv4(17, b"rest", frag=5)),
    ]
    capture(tmp_path / "a.pcap", frames)
    capture(tmp_path / "b.pcap", frames[:2], cut=3, order=">", magic=0xA1B23C4D)
    (tmp_path / "c.pcap").write_bytes(b"")
    spark.dataSource.register(captures.CaptureSource)
    df = spark.read.format("capture").load(f"{tmp_path}/*.pcap")
    rows = {(r.capture_file[-6], r.pkt_no): r for r in df.collect()}
    assert len(rows) == len(frames) + 1
    a = [rows["a", i + 1] for i in range(len(frames))]
    assert (a[0].src_ip, a[0].dst_port, a[0].tcp_flags, a[0].t_us) == ("10.0.0.1", 80, 2, 1_000_000_005)
    assert (a[1].vlan_id, a[1].len, bytes(a[1].payload), a[1].headers) == (12, 5, b"hello", ["eth", "vlan", "ipv4", "udp"])
    assert (a[2].src_ip, a[2].ip_ttl, bytes(a[2].payload)) == ("::1", 9, b"data")
    assert a[3].headers == ["eth", "ipv4", "gre", "ipv4", "icmp"] and bytes(a[3].payload) == b"ping"
    assert a[4].src_ip is None and a[5].headers == [] and a[6].frag_off == 40
    assert rows["b", 1].t_us == 1_000_000_000
    drop = lambda d: sorted(str(r.asDict() | {"capture_file": ""}) for r in d.collect())
    assert drop(captures.from_store(spark, f"{tmp_path}/*.pcap")) == drop(df)
    assert flows.sessionize(df.where("l4_proto = 6"), ["src_ip"]).count() == 3


def test_flow_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], (1, "x"), ""), (2, [], (2, "y"), "t")], "n long, tags array<string>, pair struct<i:int,s:string>, text string")
    files.write_text(df, str(tmp_path / "t"), rows_per_file=1)
    back = files.read_text(spark, str(tmp_path / "t/flows"))
    assert back.columns == ["n", "tags", "pair", "text"] and {(r.n, r.tags, r.pair) for r in back.collect()} == {("1", "a;b", "1_x"), ("2", None, "2_y")}
    assert spark.read.csv(str(tmp_path / "t/headers"), sep="\t", header=True).count() == 4
    files.write_json(df, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert '"tags"' not in lines[1] and '"text"' not in lines[0]
    files.write_by_day(df.select(F.col("n"), (F.col("n") * 86_400_000_000).alias("t_us")), str(tmp_path / "d"), "t_us")
    assert spark.read.parquet(str(tmp_path / "d")).where("day = '1970-01-02'").count() == 1


def test_packet_selection(spark):
    p = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "pkt_no long, flow_ind long")
    f = spark.createDataFrame([(1,), (1,)], "flow_ind long")
    assert files.select_packets(p, f).count() == 2 and files.select_packets(p, f, inside=False).count() == 1


def first(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(*(e.alias(n) for n, e in f(F.col("t")).items())).first().asDict()


def test_text_protocols(spark):
    r = first(spark, decoders.http, "GET /a?b HTTP/1.1\r\nHost: x.org\r\nUser-Agent: me\r\nContent-Type: text/html; q\r\n\r\n")
    assert (r["method"], r["target"], r["host"], r["agent"], r["mime"], r["status"]) == ("GET", "/a?b", "x.org", "me", "text/html", None)
    assert first(spark, decoders.http, "HTTP/1.0 404 No\r\nServer: s\r\n")["status"] == 404
    assert first(spark, decoders.mail, "mail from:<a@b>") == {"command": "MAIL", "code": None, "sender": "a@b", "recipient": None}
    r = first(spark, decoders.file_transfer, "227 Entering (10,0,0,1,4,1)")
    assert (r["code"], r["data_ip"], r["data_port"]) == (227, "10.0.0.1", 1025)
    assert first(spark, decoders.system_log, "<165>x") == {"severity": 5, "facility": 20}
    assert first(spark, decoders.secure_shell, "SSH-2.0-Open_8\r\n") == {"version": "2.0", "software": "Open_8"}
    assert first(spark, decoders.chat_relay, "NICK joe")["nick"] == "joe"
    assert first(spark, decoders.calls, "INVITE sip:x SIP/2.0\r\nCall-ID: 77\r\n") == {"method": "INVITE", "status": None, "call_id": "77"}
    df = spark.createDataFrame([("Authorization: Basic dTpw",), ("USER a\nPASS b",), ("none",)], "t string")
    assert [r[0] for r in df.select(decoders.credentials(F.col("t"))).collect()] == ["u:p", "a:b", None]


def test_binary_protocols(spark):
    question = b"\x03www\x01x\x00" + struct.pack("!HH", 1, 1)
    answer = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    dns = struct.pack("!HHHHHH", 9, 0x8180, 1, 1, 0, 0) + question + answer
    name = struct.pack("!HBH", 4, 0, 1) + b"z"
    extensions = struct.pack("!HH", 0, len(name)) + name + struct.pack("!HHHH", 10, 4, 2, 29) + struct.pack("!HHBB", 11, 2, 1, 0)
    hello = struct.pack("!H", 0x0303) + bytes(32) + b"\x00" + struct.pack("!HHH", 4, 0x0A0A, 47) + b"\x01\x00" + struct.pack("!H", len(extensions)) + extensions
    tls = b"\x16\x03\x01" + struct.pack("!H", len(hello) + 4) + b"\x01" + struct.pack("!I", len(hello))[1:] + hello
    df = spark.createDataFrame([(1, dns), (2, tls), (3, b"x"), (4, None), (5, dns[:30])], "i long, payload binary")
    rows = {r.i: r for r in decoders.decode(decoders.decode(df, "dns"), "tls").collect()}
    assert (rows[1].dns.names, rows[1].dns.answers, rows[1].dns.reply, rows[1].dns.rcode) == (["www.x"], ["1.2.3.4"], True, 0)
    assert (rows[2].tls.server_name, rows[2].tls.fingerprint) == ("z", hashlib.md5(b"771,47,0-10-11,29,0").hexdigest())
    assert rows[3].dns.id is None and rows[4].tls.version is None
