"""Hand-made packets for the edges of flow formation, and checks against plain Python."""

import ipaddress
import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.functions import query as q
from rillflow.functions.dialects import column_filter
from rillflow.operators import arrays, flows, lookups, reports, stats, tcp
from rillflow.streaming import sessions


def made(spark, times, key=1):
    return spark.createDataFrame([(key, i, int(t * 1e6), 10 + i) for i, t in enumerate(times)], "k long, pkt_no long, t_us long, len long")


@pytest.mark.parametrize(("gap", "n"), [(181.999999, 1), (182.0, 2), (182.000001, 2)])
def test_session_ends_at_the_timeout(spark, gap, n):
    assert flows.sessionize(made(spark, [0, gap]), ["k"]).select("session").distinct().count() == n


def test_sessions_keep_all_packets(spark):
    df = flows.sessionize(made(spark, [0, 1, 500, 501, 1000]), ["k"])
    got = flows.flow_stats(df, ["k", "session"], "len").orderBy("session").collect()
    assert [(r.pkts, r.bytes) for r in got] == [(2, 21), (2, 25), (1, 14)]
    assert [r.duration for r in got] == [1.0, 1.0, 0.0]


def test_single_packet_has_no_rate(spark):
    df = flows.rates(flows.flow_stats(made(spark, [5]), ["k"], "len")).first()
    assert (df.pktps, df.bytps) == (0.0, 0.0)


def test_lifespan_is_greedy(spark):
    got = flows.lifespan_cut(made(spark, [0, 4, 10, 14, 19, 20]), ["k"], 10).orderBy("pkt_no").collect()
    assert [r.part for r in got] == [0, 0, 1, 1, 1, 2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40))
def test_running_variance_is_the_streaming_rule(spark, xs):
    mean = var = 0.0
    for k, x in enumerate(xs, 1):
        mean = mean * (1 - 1 / k) + x / k
        var = var * (1 - 1 / k) + (x - mean) ** 2 / k
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "k long, i long, x double")
    assert flows.running_variance(df, ["k"], "x", "i").first().run_var == pytest.approx(var, abs=1e-3)


def test_length_stats_of_known_values(spark):
    xs = [1, 2, 2, 3, 10]
    df = spark.createDataFrame([(1, x) for x in xs], "k long, x long")
    r = stats.length_stats(df, ["k"], "x").first()
    assert (r.min, r.max, r.mode, r.med) == (1, 10, 2, 2.0)
    assert r.q1 == pytest.approx(1.75) and r.q3 == pytest.approx(4.75)
    assert r.std == pytest.approx(statistics.pstdev(xs), abs=1e-4)


def test_asymmetry_is_bounded(spark):
    df = spark.createDataFrame([(1, "A", 3), (1, "B", 1), (2, "A", 5), (3, "B", 2), (4, "A", 0)], "k long, way string, n long")
    got = {r.k: r.n_asym for r in flows.pair(df, "k", "way", ["n"]).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: -1.0, 4: 0.0}


C = tcp.Connection
#: flag bytes
F_, S_, R_, A_ = 0x01, 0x02, 0x04, 0x10


def fold(*packets):
    """(state, bits) of A and of B while the connection is open, and their bits at its end."""
    c = tcp.Connection()
    for p in packets:
        c.packet(*p)
    now = [(c.sides[w].state, c.sides[w].anomaly) if w in c.sides else None for w in "AB"]
    last = c.end()
    return *now, [last[w].anomaly if w in last else None for w in "AB"]


SHAKE = [("A", S_, 100, 0), ("B", S_ | A_, 500, 101), ("A", A_, 101, 501)]
CLOSE = [("A", F_ | A_, 110, 501), ("B", F_ | A_, 510, 111), ("A", A_, 111, 511)]
BOTH = C.BAD_OPEN | C.BAD_CLOSE


@pytest.mark.parametrize(
    ("packets", "a", "b", "last"),
    [
        # opening
        ([("A", S_, 1, 0)], ("new", 0), None, [BOTH, None]),
        ([("A", S_ | A_, 1, 9)], ("established", C.BAD_OPEN), None, [BOTH, None]),
        ([("A", S_, 100, 0), ("B", S_ | A_, 500, 999)], ("established", C.BAD_OPEN), ("established", C.BAD_OPEN), [BOTH, BOTH]),
        (SHAKE[:2], ("new", 0), ("new", 0), [BOTH, BOTH]),
        (SHAKE, ("established", 0), ("established", 0), [C.BAD_CLOSE, C.BAD_CLOSE]),
        ([*SHAKE[:2], ("A", A_, 101, 7)], ("established", C.BAD_OPEN), ("established", C.BAD_OPEN), [BOTH, BOTH]),
        ([("A", S_, 100, 0), ("B", R_ | A_, 0, 101)], ("reset", 0), ("reset", C.RESET_SENT), [BOTH, BOTH | C.RESET_SENT]),
        ([("A", S_, 100, 0), ("B", R_, 0, 0)], ("reset", C.BAD_OPEN), ("reset", C.BAD_OPEN | C.RESET_SENT), [BOTH, BOTH | C.RESET_SENT]),
        ([("A", R_ | A_, 0, 0)], ("reset", C.BAD_OPEN | C.RESET_SENT | C.EVIL), None, [BOTH | C.RESET_SENT | C.EVIL, None]),
        ([("A", F_ | A_, 9, 0)], ("closing", C.BAD_OPEN), None, [BOTH | C.EVIL, None]),
        ([("B", S_, 5, 0), ("A", F_ | A_, 9, 0)], ("closing", C.BAD_OPEN), ("new", C.BAD_OPEN), [BOTH, BOTH]),
        ([("A", F_, 9, 0)], ("new", C.EVIL), None, [BOTH | C.EVIL, None]),
        ([("A", A_, 9, 0)], ("established", C.BAD_OPEN), None, [BOTH, None]),
        ([("A", S_ | F_, 9, 0)], ("established", C.BAD_OPEN), None, [BOTH, None]),
        ([("A", 0x00, 9, 0)], ("established", C.EVIL | C.BAD_OPEN), None, [BOTH | C.EVIL, None]),
        ([("A", 0x29, 9, 0)], ("new", C.EVIL), None, [BOTH | C.EVIL, None]),
        # established
        ([*SHAKE, ("B", S_, 1, 1)], ("established", C.BAD_FLAGS), ("established", C.BAD_FLAGS), [C.BAD_FLAGS | C.BAD_CLOSE] * 2),
        ([*SHAKE, ("A", F_, 110, 0)], ("closing", C.BAD_FLAGS), ("established", C.BAD_FLAGS), [C.BAD_FLAGS | C.BAD_CLOSE] * 2),
        ([*SHAKE, ("B", R_ | A_, 1, 1)], ("reset", C.BAD_CLOSE), ("reset", C.BAD_CLOSE | C.RESET_SENT), [C.BAD_CLOSE, C.BAD_CLOSE | C.RESET_SENT]),
        # closing, closed, reset
        ([*SHAKE, *CLOSE[:2]], ("closing", 0), ("closing", 0), [C.BAD_CLOSE] * 2),
        ([*SHAKE, *CLOSE], ("closed", 0), ("closed", 0), [0, 0]),
        ([*SHAKE, *CLOSE[:2], ("A", A_, 111, 7)], ("closing", 0), ("closing", 0), [C.BAD_CLOSE] * 2),
        ([*SHAKE, *CLOSE[:2], ("A", R_, 0, 0)], ("reset", C.BAD_CLOSE | C.RESET_SENT), ("reset", C.BAD_CLOSE), [C.BAD_CLOSE | C.RESET_SENT, C.BAD_CLOSE]),
        ([*SHAKE, *CLOSE, ("B", A_, 1, 1)], ("closed", 0), ("closed", C.AFTER_CLOSE), [0, C.AFTER_CLOSE]),
        ([*SHAKE, *CLOSE, ("B", R_, 1, 1)], ("reset", C.BAD_CLOSE), ("reset", C.AFTER_CLOSE | C.BAD_CLOSE | C.RESET_SENT), [C.BAD_CLOSE, C.AFTER_CLOSE | C.BAD_CLOSE | C.RESET_SENT]),
        ([*SHAKE, ("B", R_ | A_, 1, 1), ("A", A_, 1, 1)], ("reset", C.BAD_CLOSE | C.AFTER_RESET), ("reset", C.BAD_CLOSE | C.RESET_SENT), [C.BAD_CLOSE | C.AFTER_RESET, C.BAD_CLOSE | C.RESET_SENT]),
    ],
)
def test_connection_transitions(packets, a, b, last):
    assert fold(*packets) == (a, b, last)


def test_silence_ends_a_connection(spark):
    s = 1_000_000
    rows = [(1, 0, "A", S_, 100, 0, 0), (1, 1, "B", S_ | A_, 500, 101, s), (1, 2, "A", A_, 101, 501, 2 * s), (1, 3, "A", A_, 101, 501, 611 * s), (1, 4, "B", A_, 1, 1, 1300 * s)]
    df = spark.createDataFrame(rows, "k long, pkt_no long, way string, tcp_flags long, tcp_seq long, tcp_ack long, t_us long")
    got = sorted(tuple(r) for r in tcp.connection_states(df, ["k"]).collect())
    assert got == [(1, 0, "A", 3, "established", C.BAD_CLOSE), (1, 0, "B", 1, "established", C.BAD_CLOSE), (1, 1, "B", 1, "established", BOTH)]


def test_window_moves(spark):
    df = spark.createDataFrame([(k, i, w) for k, ws in ((1, [5, 7, 7, 6, 9]), (2, [5, 4, 3, 3, 4]), (3, [5, 5]), (4, [1])) for i, w in enumerate(ws)], "k long, i long, w long")
    assert {r.k: (r.ups, r.downs, r.turns) for r in tcp.window_moves(df, ["k"], "w", ["i"]).collect()} == {1: (2, 1, 3), 2: (1, 2, 1), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_wavelet_keeps_energy():
    x = [3.0, 1, 4, 1, 5, 9, 2, 6]
    details, approx = arrays.wavelet(x, 1)
    assert sum(v * v for v in details[0] + approx) == pytest.approx(sum(v * v for v in x))


def test_header_chain(spark):
    df = spark.createDataFrame([(["eth", "vlan", "vlan", "ipv4"],), ([],)], "h array<string>")
    assert [r[0] for r in df.select(arrays.header_chain(F.col("h"))).collect()] == ["eth:vlan{2}:ipv4", ""]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100)), min_size=1, max_size=20), st.lists(st.integers(0, 120), min_size=1, max_size=20))
def test_range_join_equals_a_nested_loop(spark, ranges, values):
    ranges = [(min(a, b), max(a, b) + 1) for a, b in ranges]
    left = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
    right = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "j long, low long, high long")
    got = {(r.i, r.j) for r in lookups.range_join(left, "v", right, "low", "high", 7).collect()}
    assert got == {(i, j) for i, v in enumerate(values) for j, (a, b) in enumerate(ranges) if a <= v < b}


def test_longest_prefix_wins(spark):
    nets = spark.createDataFrame([(0x0A000000, 8, "ten"), (0x0A010000, 16, "one")], "net long, bits int, label string")
    ips = spark.createDataFrame([(1, 0x0A010203), (2, 0x0A020203), (3, 0x0B000000)], "i long, ip long")
    got = {r.i: r.label for r in lookups.longest_prefix(ips, "ip", nets, "net", "bits", "label", "--", ["i"]).collect()}
    assert got == {1: "one", 2: "ten", 3: "--"}


def test_as_of_takes_the_last_before(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 10, "y"), (2, 5, "z")], "k long, t long, id string")
    other = spark.createDataFrame([(1, 5, 100), (1, 9, 101), (1, 11, 102)], "k long, t long, v long")
    assert {r.id: r.v for r in lookups.as_of(rows, other, ["k"], "t", "v", ["id"]).collect()} == {"x": 100, "y": 101, "z": None}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(0, 2**128 - 1), st.sampled_from([0, 1, 1 << 64, 0xFFFF << 112, (1 << 112) + 1])), min_size=1, max_size=12))
def test_ip6_forms(spark, numbers):
    ips = [ipaddress.IPv6Address(n) for n in numbers]
    df = spark.createDataFrame([(str(ip),) for ip in ips], "ip string")
    got = df.select(q.ip6_expand("ip").alias("e"), q.ip6_compress(q.ip6_expand("ip")).alias("c")).collect()
    assert [(r.e, r.c) for r in got] == [(ip.exploded, ip.compressed) for ip in ips]


def test_ip4_functions(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("192.168.255.1",), ("224.0.0.5",), ("127.0.0.1",), ("nonsense",), (None,)], "ip string")
    r = df.select(q.ip_number("ip").alias("n"), q.private("ip").alias("p"), q.multicast("ip").alias("m"), q.loopback("ip").alias("l"), q.ip_text(q.ip_number("ip")).alias("t")).collect()
    assert [x.n for x in r][:2] == [0x0A010203, 0xC0A8FF01] and r[4].n is None
    assert [x.p for x in r] == [True, True, False, False, False, False]
    assert r[2].m and r[3].l and r[0].t == "10.1.2.3"


def test_text_functions(spark):
    df = spark.createDataFrame([('"Ab;cD"', " x ", "a%20b+c", 2048)], "s string, w string, u string, n long")
    r = df.select(q.unquote("s").alias("s"), q.value_contains(q.unquote("s"), ";", "CD", True).alias("c"), q.strip("w").alias("w"), q.url_decode("u").alias("u"), q.part(q.unquote("s"), ";", -1).alias("p"), q.human("n").alias("h")).first()
    assert tuple(r) == ("Ab;cD", True, "x", "a b c", "cD", "2.05 K")


def test_filters_combine_from_left_to_right(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (1, 1, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(column_filter("a == 1 || b == 1 && c == 1")).collect()] == [True, True, False]


def test_entropy_of_two_equal_symbols(spark):
    from rillflow.operators.payload import entropy

    df = spark.createDataFrame([(1, c) for c in "abab"] + [(2, "a")], "k long, c string")
    got = {r.k: r.entropy for r in entropy(df, ["k"], "c").collect()}
    assert got[1] == pytest.approx(math.log(2) / math.log(256), abs=1e-6) and got[2] == -1.0


def test_diff_counts_missing_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k long, v string")
    assert [tuple(r) for r in reports.differing_columns(a, b, "k").collect()] == [("v", 2)]


def test_batch_and_stream_agree(spark, tmp_path):
    from rillflow.streaming import sessions

    rows = [(k, t, 1.0) for k in (1, 2) for t in (1000, 1100, 1400, 1500)] + [(9, 10_000, 1.0)]
    df = spark.createDataFrame(rows, "k long, t long, n double").select("k", F.timestamp_seconds("t").alias("ts"), "n")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sessions.run_available(spark, sessions.stateful_flows(stream, "k", "ts", "n"), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted((r.key, r.pkts, r.t_first) for r in got if r.key != 9) == [(k, 2, t) for k in (1, 2) for t in (1_000_000_000, 1_400_000_000)]


def test_stateful_flows_are_whole(spark, small):
    """Every flow of the table, open ones too, equals the batch query that SQL checks."""
    from rillflow.plans import QUERIES

    got = sorted((r.key, r.t_first, r.t_last, r.pkts) for r in QUERIES["stateful_flows_stream"](spark, small).collect())
    assert got == sorted((r.user_id, r.t_first, r.t_last, r.pkts) for r in QUERIES["flow_sessions"](spark, small).collect())


def test_header_runs_count_all_packets(spark):
    rows = [(1, t, "a" if t < 30 else "b") for t in range(45)] + [(2, 1, "a")]
    df = spark.createDataFrame(rows, "k long, t long, h string")
    assert {r.k: r.chain for r in arrays.header_runs(df, ["k"], "h", ["t"]).collect()} == {1: "a{30}:b{15}", 2: "a"}


def test_nearest_labels_of_equal_vectors_by_id(spark):
    from rillflow.operators.learning import nearest_labels

    rows = spark.createDataFrame([(i, [0.0, 1.0], 1 if i <= 3 else 2) for i in range(40, 0, -1)] + [(100, [0.0, 1.0], 9)], "vec_id long, embedding array<double>, label int").coalesce(1)
    assert nearest_labels(rows, rows.where("vec_id = 100"), 5).first().predicted == 1


def test_masks_addresses_and_parts(spark):
    assert q.mask_text(20) == "255.255.240.0" and q.mask6_text(36) == "ffff:ffff:f000:0000:0000:0000:0000:0000" and q.mask6_text(0) == ":".join(["0000"] * 8)
    df = spark.createDataFrame([(["aa:BB", "cc:dd"], ["ee:ff"], "a_b_c", [7, 8], 5), (None, [], "", None, None)], "src_mac array<string>, dst_mac array<string>, v string, mpls array<int>, stat int")
    got = df.select(q.ether("AA:bb").alias("any"), q.ether("ee:ff", side="src").alias("src"), q.ether("ee:ff", side="dst").alias("dst"), q.split_parts("v", "_", -2, -1).alias("p"), q.split_parts("v", "_", 9).alias("none"), q.SHORT_NAMES["mpls2"]().alias("m"), q.has_status("stat", 2).alias("s"), q.has_status("stat", 4).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, False, True, "b_c", "", 8, True, False), (False, False, False, "", "", None, False, False)]
    assert q.numbered(spark.range(10), "id", spark.range(3)).count() == 3
    assert tuple(q.column_summary(spark.range(5), "id").first()) == (0, 4, 2.0)


def test_a_report_reads_its_days_alone(spark, tmp_path):
    from rillflow.sources.files import write_by_day

    write_by_day(spark.range(10).selectExpr("id", "id * 86400000000 AS t_us"), str(tmp_path / "days"), "t_us")
    days = reports.within(spark.read.parquet(str(tmp_path / "days")), "1970-01-03", "1970-01-05", "day", "day")
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert days.count() == 3 and "PartitionFilters: [isnotnull(day" in plan


def test_stateful_flows_grow_from_arrays():
    """Frames of a key in any order, with equal times and gaps just below and at the limit, give the flows of all packets sorted."""
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        packets = [(rng.randrange(0, 400), float(rng.randrange(9))) for _ in range(rng.randrange(1, 40))]
        flows, at = [], 0
        while at < len(packets):
            part = packets[at : at + rng.randrange(1, 9)]
            at += len(part)
            flows = sessions.grown(flows, np.array([t for t, _ in part]), np.array([n for _, n in part]), 10)
        want = []
        for t, n in sorted(packets):
            if want and t - want[-1][1] < 10:
                want[-1] = (want[-1][0], t, want[-1][2] + 1, want[-1][3] + n)
            else:
                want.append((t, t, 1, n))
        assert flows == want
    assert sessions.grown([(1, 2, 3, 4.0)], np.array([], int), np.array([]), 10) == [(1, 2, 3, 4.0)]


def test_address_numbers_of_odd_texts(spark):
    """Only four parts of up to 255 are an address; the last may be followed by a line's end."""
    texts = ["10.1.2.3", "255.255.255.255", "0.0.0.0", "1.2.3", "1.2.3.4.5", "1..3.4", ".1.2.3.4", "1.2.3.256", "+1.2.3.4", " 1.2.3.4", "1.2.3.4\n", "::1", "", None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select(q.ip_number("ip")).collect()]
    assert out == [int(ipaddress.ip_address(t)) for t in texts[:3]] + [None] * 7 + [16909060] + [None] * 3


def test_lines_meet_orders_with_their_customers(spark, small, capsys):
    """Without broadcasts the lines are shuffled for order and supplier, not for customer and nations."""
    from rillflow.sources.tables import flows as flow_view

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        flow_view(spark, small).select("flow_ind", "src_cc", "dst_cc").explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [part for part in capsys.readouterr().out.split("\n\n") if ") Exchange" in part and "l_linenumber" in part]
    assert len(dealt) == 2


def test_blocks_of_vectors_as_they_lie():
    """A slice of a batch gives its own rows by id, in double precision; vectors of several lengths are an error."""
    import pyarrow as pa

    from rillflow.operators.learning import _block

    kind = pa.struct([("i", pa.int64()), ("v", pa.list_(pa.float32())), ("y", pa.int32())])
    whole = pa.array([{"i": 9, "v": [9.0, 9.0], "y": 9}, {"i": 3, "v": [0.5, 1.0], "y": None}, {"i": 1, "v": [2.0, 3.0], "y": 7}, {"i": 0, "v": [1.0], "y": 0}], kind)
    ids, vectors, labels = _block(whole[1:3])
    assert (ids.tolist(), vectors.tolist(), vectors.dtype, labels.to_pylist()) == ([1, 3], [[2.0, 3.0], [0.5, 1.0]], np.float64, [7, None])
    with pytest.raises(ValueError, match="lengths"):
        _block(whole)


def test_nearest_labels_over_many_blocks(spark):
    """Blocks of three rows give the same labels as one block."""
    from rillflow.operators.learning import nearest_labels

    rows = spark.createDataFrame([(i, [float(i * 7 % 31), float(i * 11 % 17)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int").repartition(3)
    asked = rows.where("vec_id % 5 = 0")
    assert sorted(nearest_labels(rows, asked, 4, block=3).collect()) == sorted(nearest_labels(rows, asked, 4).collect())
