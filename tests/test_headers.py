"""Binary headers: hand-written messages, cut ones, and none."""

import pytest
from pyspark.sql import functions as F

from rillflow.operators import headers

DECODERS = [headers.time_protocol, headers.group_membership, headers.link_states, headers.spanning_tree, headers.trivial_transfer, headers.management, headers.terminal, headers.access, headers.traversal, headers.neighbours, headers.device_discovery]


def rows(spark, *payloads):
    return spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in enumerate(payloads)], "event_id long, payload binary")


@pytest.mark.parametrize("decoder", DECODERS, ids=lambda d: d.__name__)
def test_cut_and_missing_payloads(spark, decoder):
    """No payload, an empty one and every length up to 40 of zeros and of ones give a row; without a payload all is null."""
    cut = [None, b"", *(bytes([v]) * n for v in (0, 255) for n in range(1, 41))]
    out = headers.fields(rows(spark, *cut), decoder).orderBy("event_id").collect()
    assert len(out) == len(cut)
    assert all(v is None for k, v in out[0].asDict().items() if k != "event_id")


def test_checksum(spark):
    def right(data):
        s = sum(int.from_bytes((data + b"\0")[i : i + 2], "big") for i in range(0, len(data), 2))
        while s > 0xFFFF:
            s = (s & 0xFFFF) + (s >> 16)
        return 0xFFFF - s

    whole = [b"\x16\x00" + right(b"\x16\x00\x00\x00" + tail).to_bytes(2, "big") + tail for tail in (b"\xe0\x00\x00\x05", b"\xff" * 40, b"abc", b"")]
    found = rows(spark, *whole, *(w[:-1] + bytes([w[-1] ^ 1]) for w in whole)).orderBy("event_id").select(headers.checksum_holds(F.col("payload"))).collect()
    assert [r[0] for r in found] == [True] * 4 + [False] * 4


def test_records_end(spark):
    """A size of zero ends the list, a cut record keeps what is there, padding is skipped."""
    p = F.col("payload")
    found = headers.records(p, 1, 2, lambda at: headers.number(p, at, 1), lambda at: headers.number(p, at + 1, 1), 2, 4)
    out = rows(spark, b"x\x01\x03a\x00\x02\x04bc", b"x\x01\x00a", b"x\x01\x09ab", b"x", b"", None).orderBy("event_id").select(found).collect()
    plain = [None if r[0] is None else [(x.kind, bytes(x.body), x.bytes) for x in r[0]] for r in out]
    assert plain == [[(1, b"a", 3), (2, b"bc", 4)], [], [(1, b"ab", 9)], [], [], None]


def test_management_third_version(spark):
    security = b"\x30\x10\x04\x02\x80\x00\x02\x01\x07\x02\x01\x09\x04\x04anna"
    message = b"\x02\x01\x03\x30\x03\x02\x01\x05\x04" + bytes([len(security)]) + security
    long = b"\x30\x81" + bytes([200]) + b"\x02\x01\x01\x04\x06public\xa2\x00"
    first, second = headers.fields(rows(spark, b"\x30" + bytes([len(message)]) + message, long), headers.management).orderBy("event_id").collect()
    assert (first.version, first.user, first.community, first.request) == (3, "anna", None, None)
    assert (second.version, second.community, second.request, second.user) == (1, "public", 2, None)


def test_terminal_marks_in_text(spark):
    """A doubled mark is a byte of text; a mark within a negotiated option isn't a command."""
    out = headers.fields(rows(spark, b"a\xff\xffb\xff\xfb\xff\xff\xf6c", b"plain"), headers.terminal).orderBy("event_id").select("commands", "options").collect()
    assert [tuple(r) for r in out] == [([11, 6], [255]), ([], [])]


def test_stream_transport_without_windows(spark):
    """A flow of a bare header and one of a data chunk only."""
    df = spark.createDataFrame([(1, 1, bytearray(12)), (2, 1, bytearray(12) + bytes.fromhex("00030010000000010005000000000000")), (3, 1, None)], "k int, n int, payload binary")
    out = {r.k: r for r in headers.stream_transport(df, ["k"], "payload", ["n"]).collect()}
    assert (out[1].pkts, out[1].types, out[1].smoothed) == (1, 0, None)
    assert (out[2].data, out[2].types, out[2].flags, out[2].stream, out[2].least) == (1, 1, 3, 5, None)
    assert (out[3].pkts, out[3].types) == (1, 0)


def test_access_addresses_beyond_a_block(spark):
    """The four bytes of a framed address are read as they are: 172.16.0.0 and 65,998 more is 172.17.1.206."""
    message = bytes.fromhex("03DA0000" + "00" * 16 + "0806") + (2886729728 + 65998).to_bytes(4, "big")
    assert headers.fields(rows(spark, message), headers.access, ["framed"]).head().framed == "172.17.1.206"
