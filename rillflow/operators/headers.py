"""Binary headers as expressions over a binary payload column: fixed offsets, and lists of typed records.

Each decoder gives named columns for a payload; a field that lies beyond the payload is null, and so is every field of a null payload.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mark of a STUN message, and bits of its type.
COOKIE, CLASS_BITS = 0x2112A442, 0x0110


def _there(payload: Column, at, size: int) -> Column:
    return F.length(payload) >= F.lit(at) + size


def number(payload: Column, at, size: int) -> Column:
    """An unsigned number of up to seven bytes in network order."""
    return F.when(_there(payload, at, size), F.conv(F.hex(F.substring(payload, F.lit(at) + 1, F.lit(size))), 16, 10).cast("long"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(payload: Column, at, size) -> Column:
    return F.substring(payload, F.lit(at) + 1, F.lit(size)).cast("string")


def address(payload: Column, at) -> Column:
    """An IPv4 address in its usual form."""
    return F.when(_there(payload, at, 4), F.concat_ws(".", *(number(payload, F.lit(at) + i, 1).cast("string") for i in range(4))))


def mac(payload: Column, at) -> Column:
    return F.when(_there(payload, at, 6), F.concat_ws(":", *(F.lower(F.hex(F.substring(payload, F.lit(at) + 1 + i, F.lit(1)))) for i in range(6))))


def checksum_holds(payload: Column) -> Column:
    """Whether the 16-bit words sum up to all ones; an odd last byte counts as a high one."""
    padded = F.when(F.length(payload) % 2 == 1, F.concat(F.hex(payload), F.lit("00"))).otherwise(F.hex(payload))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(payload) / 2).cast("int") - 1, F.lit(0))), lambda i: F.coalesce(F.conv(F.substring(padded, i * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.lit(0)))
    fold = lambda s: s.bitwiseAND(0xFFFF) + F.shiftright(s, 16)
    return F.when(payload.isNotNull(), fold(fold(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x))) == 0xFFFF)


def records(payload: Column, start: int, head: int, kind: Callable[[Column], Column], size: Callable[[Column], Column], least: int, align: int = 1) -> Column:
    """The records of a payload from ``start`` on, in order: array of (kind, body, bytes).

    ``kind`` and ``size`` give type and whole size of the record at a place, head included. A size below ``least`` ends the list; the last
    record may be cut short by the end of the payload. Between records lie as many bytes as ``align`` asks for.
    """
    element = "struct<kind:bigint,body:binary,bytes:bigint>"
    state = F.struct(F.lit(start).cast("long").alias("at"), F.from_json(F.lit("[]"), f"array<{element}>").alias("found"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        n = size(at)
        body = F.substring(payload, (at + head + 1).cast("int"), (n - head).cast("int"))
        item = F.struct(kind(at).alias("kind"), body.alias("body"), n.alias("bytes"))
        padded = n if align == 1 else F.ceil(n / align).cast("long") * align
        return F.when((at + head <= F.length(payload)) & (n >= least), F.struct((at + padded).alias("at"), F.concat(s["found"], F.array(item)).alias("found"))).otherwise(s)

    turns = F.sequence(F.lit(0), F.greatest(F.floor((F.length(payload) - start) / least).cast("int"), F.lit(0)))
    return F.when(payload.isNotNull(), F.aggregate(turns, state, step)["found"])


def body(found: Column, kind: int) -> Column:
    """The body of the first record of a kind."""
    return F.get(F.filter(found, lambda r: r["kind"] == kind), F.lit(0))["body"]


def kind_bits(found: Column, least: int = 0, most: int = 63) -> Column:
    """A bit for each kind that occurs, counted from ``least``."""
    bit = lambda r: F.when(r["kind"].between(least, most), F.call_function("shiftleft", F.lit(1).cast("long"), (r["kind"] - least).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, r: a.bitwiseOR(bit(r)))


def _bit(n: Column) -> Column:
    return F.when(n.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")))


# --- fixed offsets -------------------------------------------------------------------------------------------------------------------------


def time_protocol(p: Column) -> dict[str, Column]:
    """Time synchronisation (NTP): leap, version, mode, stratum, poll, precision, root delay and dispersion (raw), reference, four times in seconds since 1900."""
    n, first = lambda at, size: number(p, at, size), number(p, 0, 1)
    precision = n(3, 1)
    times = {name: n(16 + 8 * i, 4) + n(20 + 8 * i, 4) / F.lit(4294967296.0) for i, name in enumerate(("reference_time", "origin_time", "receive_time", "transmit_time"))}
    return {"leap": F.shiftright(first, 6), "version": F.shiftright(first, 3).bitwiseAND(7), "mode": first.bitwiseAND(7), "stratum": n(1, 1), "poll": n(2, 1), "precision": F.when(precision > 127, precision - 256).otherwise(precision), "root_delay": n(4, 4), "root_dispersion": n(8, 4), "reference": address(p, 12), **times}


def group_membership(p: Column) -> dict[str, Column]:
    """Multicast groups (IGMP): type, code, version, group, number of sources or records, whether the checksum holds."""
    kind, code = number(p, 0, 1), number(p, 1, 1)
    query = F.when(F.length(p) >= 12, 3).when(code == 0, 1).otherwise(2)
    version = F.when(kind == 0x11, query).when(kind == 0x12, 1).when(kind.isin(0x16, 0x17), 2).when(kind == 0x22, 3)
    return {"kind": kind, "code": code, "version": version, "group": F.when(kind != 0x22, address(p, 4)), "entries": F.when(kind == 0x22, number(p, 6, 2)).when((kind == 0x11) & (F.length(p) >= 12), number(p, 10, 2)), "valid": checksum_holds(p)}


def link_states(p: Column) -> dict[str, Column]:
    """Link-state routing (OSPF): version, type, length, router, area, and for version 2 the kind of authentication."""
    version = number(p, 0, 1)
    return {"version": version, "kind": number(p, 1, 1), "length": number(p, 2, 2), "router": address(p, 4), "area": address(p, 8), "auth": F.when(version == 2, number(p, 14, 2))}


def spanning_tree(p: Column) -> dict[str, Column]:
    """Bridges (STP): protocol, version, type, flags, root and bridge with priority, cost, port, and ages in 1/256 s. A topology change has the first three only."""
    config = number(p, 3, 1) != 0x80
    only = lambda c: F.when(config, c)
    return {
        "protocol": number(p, 0, 2), "version": number(p, 2, 1), "kind": number(p, 3, 1), "flags": only(number(p, 4, 1)), "root_priority": only(number(p, 5, 2).bitwiseAND(0xF000)), "root": only(mac(p, 7)), "cost": only(number(p, 13, 4)),
        "bridge_priority": only(number(p, 17, 2).bitwiseAND(0xF000)), "bridge": only(mac(p, 19)), "port": only(number(p, 25, 2)), **{name: only(number(p, 27 + 2 * i, 2)) for i, name in enumerate(("message_age", "max_age", "hello", "forward"))},
    }


def trivial_transfer(p: Column) -> dict[str, Column]:
    """Small file transfer (TFTP): operation, file and mode of a request, block of data or acknowledgement, code and text of an error."""
    op = number(p, 0, 2)
    strings = F.split(F.regexp_replace(F.hex(F.substring(p, F.lit(3), F.length(p))), "(..)", "$1 "), "00 ")
    string = lambda i: F.unhex(F.replace(F.get(strings, F.lit(i)), F.lit(" "), F.lit(""))).cast("string")
    asks, said = op.isin(1, 2), F.substring(p, F.lit(5), F.length(p)).cast("string")
    return {"op": op, "file": F.when(asks, string(0)), "mode": F.when(asks, F.lower(string(1))), "block": F.when(op.isin(3, 4), number(p, 2, 2)), "error": F.when(op == 5, number(p, 2, 2)), "said": F.when(op == 5, F.rtrim(said, F.lit("\x00")))}


def management(p: Column) -> dict[str, Column]:
    """Network management (SNMP): version, community and kind of request of versions 1 and 2, user of version 3."""
    after = lambda at: let(at, lambda v: v + 2 + number(p, v + 1, 1))
    short = lambda at: let(at, lambda v: F.when(number(p, v, 1) == 4, text(p, v + 2, number(p, v + 1, 1).cast("int"))))
    long_form = number(p, 1, 1)
    start = F.when(number(p, 0, 1) == 0x30, F.when(long_form < 0x80, 2).when(long_form.between(0x81, 0x84), long_form - 0x80 + 2)).cast("long")
    version = let(start, lambda v: F.when(number(p, v, 2) == 0x201, number(p, v + 2, 1)))
    name = start + 3
    user = after(after(after(after(name) + 4)))
    return {"version": version, "community": F.when(version < 2, short(name)), "request": F.when(version < 2, number(p, after(name), 1) - 0xA0), "user": F.when(version == 3, short(user))}


def terminal(p: Column) -> dict[str, Column]:
    """Remote terminals (telnet): commands (low four bits) and options of the negotiation, bits of both, and the typed text without them."""
    # One match takes whole bytes only, so that matches stay on byte limits: an option, a sub-negotiation, a command, a byte.
    found = F.regexp_extract_all(F.hex(p), F.lit("FFF[B-E]..|FFFA..(?:(?!FFF0)..)*(?:FFF0)?|FFF[0-9]|FFFF|.."), F.lit(0))
    command = lambda x: (F.length(x) > 2) & (x != "FFFF")
    asked = F.filter(found, command)
    numbers = lambda xs: F.transform(xs, lambda x: F.conv(x, 16, 10).cast("long"))
    commands = numbers(F.transform(asked, lambda x: F.substring(x, 4, 1)))
    options = numbers(F.transform(F.filter(asked, lambda x: F.length(x) > 5), lambda x: F.substring(x, 5, 2)))
    gather = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(_bit(x), F.lit(0).cast("long"))))
    typed = F.transform(F.filter(found, lambda x: ~command(x)), lambda x: F.right(x, F.lit(2)))
    return {"commands": F.array_distinct(commands), "options": F.array_distinct(options), "command_bits": gather(commands), "option_bits": gather(options), "typed": F.unhex(F.array_join(typed, "")).cast("string")}


# --- lists of records ----------------------------------------------------------------------------------------------------------------------


def chunks(p: Column) -> Column:
    """Chunks of a stream transport packet (SCTP): (kind, body from the flags on, bytes). Sizes are rounded up to four bytes, as the standard pads them."""
    return records(p, 12, 1, lambda at: number(p, at, 1).bitwiseAND(0x3F), lambda at: number(p, at + 2, 2), 4, 4)


def stream_transport(packets: DataFrame, key: Sequence[str], payload: str, order: Sequence[str], keep: float = 0.7) -> DataFrame:
    """Chunk features of each flow: types and flags as bits, data, initial and abort counts, largest stream, and the receiver's window: least, largest, and smoothed in order from the last initial value.

    Packets without chunks count as packets only; a flow that never tells a window has nulls there.
    """
    from rillflow.operators.folds import Fold, ordered_fold

    class Window(Fold):
        def __init__(self):
            self.now = None

        def add(self, kind, size):
            self.now = float(size) if kind in (1, 2) or self.now is None else keep * self.now + (1 - keep) * size
            return []

        def end(self):
            return [(round(self.now, 4),)]

    one = packets.select(*key, *order, F.posexplode_outer(chunks(F.col(payload))).alias("place", "c")).select(*key, *order, "place", F.col("c.kind").alias("kind"), F.col("c.body").alias("body"))
    kind, b = F.col("kind"), F.col("body")
    tells = F.when(kind.isin(1, 2, 3), number(b, 7, 4))
    one = one.withColumn("window", tells)
    out = one.groupBy(*key).agg(
        F.count(F.when(F.coalesce("place", F.lit(0)) == 0, 1)).alias("pkts"), F.coalesce(F.bit_or(_bit(kind)), F.lit(0).cast("long")).alias("types"), F.coalesce(F.bit_or(number(b, 0, 1)), F.lit(0).cast("long")).alias("flags"), *(F.count(F.when(kind == k, 1)).alias(n) for n, k in (("data", 0), ("initial", 1), ("aborts", 6))),
        F.max(F.when(kind == 0, number(b, 7, 2))).alias("stream"), F.min("window").alias("least"), F.max("window").alias("largest"),
    )
    smooth = ordered_fold(one.where(F.col("window").isNotNull()), key, [*order, "place"], ["kind", "window"], Window, "smoothed double")
    return out.join(smooth, list(key), "left")


def access_records(p: Column) -> Column:
    return records(p, 20, 2, lambda at: number(p, at, 1), lambda at: number(p, at + 1, 1), 2)


def access(p: Column, found: Column | None = None) -> dict[str, Column]:
    """Access servers (RADIUS): code, user, server and framed address, stations, session, kind of accounting, and counters."""
    found = access_records(p) if found is None else found
    n = lambda kind: number(body(found, kind), 0, 4)
    s = lambda kind: body(found, kind).cast("string")
    return {
        "code": number(p, 0, 1), "ident": number(p, 1, 1), "user": s(1), "server": address(body(found, 4), 0), "framed": address(body(found, 8), 0), "called": s(30), "calling": s(31), "server_name": s(32), "accounting": n(40),
        "bytes_in": n(42), "bytes_out": n(43), "session": s(44), "seconds": n(46), "pkts_in": n(47), "pkts_out": n(48), "cause": n(49),
    }


def traversal_records(p: Column) -> Column:
    return records(p, 20, 4, lambda at: number(p, at, 2), lambda at: number(p, at + 2, 2) + 4, 4, 4)


def traversal(p: Column, found: Column | None = None) -> dict[str, Column]:
    """Address traversal (STUN, TURN): class, method, attributes as bits, mapped address and port (plain or masked), error, user, realm and software; all null without the message's mark."""
    found = traversal_records(p) if found is None else found
    kind = number(p, 0, 2)
    ours = (number(p, 4, 4) == COOKIE) & (kind < 0x4000)
    plain, masked, error = body(found, 1), body(found, 0x20), body(found, 9)
    port = F.coalesce(number(masked, 2, 2).bitwiseXOR(COOKIE >> 16), number(plain, 2, 2))
    word = number(masked, 4, 4).bitwiseXOR(COOKIE)
    unmasked = F.concat_ws(".", *(F.shiftright(word, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    mapped = F.coalesce(F.when((number(masked, 1, 1) == 1) & word.isNotNull(), unmasked), F.when(number(plain, 1, 1) == 1, address(plain, 4)))
    out = {
        "kind": F.shiftright(kind.bitwiseAND(0x100), 7).bitwiseOR(F.shiftright(kind.bitwiseAND(0x10), 4)), "method": kind.bitwiseAND(0x3FFF & ~CLASS_BITS), "attributes": kind_bits(found), "mapped_ip": mapped, "mapped_port": port,
        "error": number(error, 2, 1) * 100 + number(error, 3, 1), "user": body(found, 6).cast("string"), "realm": body(found, 0x14).cast("string"), "software": body(found, 0x8022).cast("string"),
    }
    return {k: F.when(ours, v) for k, v in out.items()}


def neighbour_records(p: Column) -> Column:
    return records(p, 0, 2, lambda at: F.shiftright(number(p, at, 2), 9), lambda at: number(p, at, 2).bitwiseAND(511) + 2, 2)


def neighbours(p: Column, found: Column | None = None) -> dict[str, Column]:
    """Link-layer discovery (LLDP): record types as bits, chassis and port with their kinds, time to live, names, capabilities there and enabled."""
    found = neighbour_records(p) if found is None else found
    label = lambda b, hardware: F.when(number(b, 0, 1) == hardware, mac(b, 1)).otherwise(F.substring(b, F.lit(2), F.length(b)).cast("string"))
    chassis, port, caps = body(found, 1), body(found, 2), body(found, 7)
    return {
        "kinds": kind_bits(found), "chassis_kind": number(chassis, 0, 1), "chassis": label(chassis, 4), "port_kind": number(port, 0, 1), "port": label(port, 3), "ttl": number(body(found, 3), 0, 2),
        "port_text": body(found, 4).cast("string"), "name": body(found, 5).cast("string"), "description": body(found, 6).cast("string"), "capable": number(caps, 0, 2), "enabled": number(caps, 2, 2),
    }


def discovery_records(p: Column) -> Column:
    return records(p, 4, 4, lambda at: number(p, at, 2), lambda at: number(p, at + 2, 2), 4)


def device_discovery(p: Column, found: Column | None = None) -> dict[str, Column]:
    """Device discovery (CDP): version, time to live, record types as bits, device, port, capabilities, software, platform, domain, native network and duplex."""
    found = discovery_records(p) if found is None else found
    s = lambda kind: body(found, kind).cast("string")
    return {"version": number(p, 0, 1), "ttl": number(p, 1, 1), "kinds": kind_bits(found), "device": s(1), "port": s(3), "capable": number(body(found, 4), 0, 4), "software": s(5), "platform": s(6), "domain": s(9), "vlan": number(body(found, 10), 0, 2), "duplex": number(body(found, 11), 0, 1)}


_LISTED = {access: access_records, traversal: traversal_records, neighbours: neighbour_records, device_discovery: discovery_records}


def fields(packets: DataFrame, decoder: Callable[..., dict[str, Column]], names: Sequence[str] | None = None, payload: str = "payload") -> DataFrame:
    """Packets with the fields of a decoder (or the named ones) in place of the payload; its records are listed once for all of them."""
    if decoder in _LISTED:
        packets = packets.withColumn("__found", _LISTED[decoder](F.col(payload)))
        at = decoder(F.col(payload), F.col("__found"))
    else:
        at = decoder(F.col(payload))
    kept = [c for c in packets.columns if c not in (payload, "__found") and c not in (names or at)]
    return packets.select(*kept, *(at[k].alias(k) for k in names or at))


# --- flows ---------------------------------------------------------------------------------------------------------------------------------


def flow_bits(packets: DataFrame, key: Sequence[str], numbers: dict[str, Column], masks: dict[str, Column] | None = None, bounds: dict[str, Column] | None = None) -> DataFrame:
    """Of each flow: a bit for each number that occurs, masks joined by or, and least and largest values. One shuffle, partial sums before it."""
    zero = F.lit(0).cast("long")
    return packets.groupBy(*key).agg(
        F.count("*").alias("pkts"), *(F.coalesce(F.bit_or(_bit(c)), zero).alias(n) for n, c in numbers.items()), *(F.coalesce(F.bit_or(c), zero).alias(n) for n, c in (masks or {}).items()),
        *(f(c).alias(f"{w}_{n}") for n, c in (bounds or {}).items() for w, f in (("min", F.min), ("max", F.max))),
    )


def kind_counts(packets: DataFrame, key: Sequence[str], kind: Column, names: dict[int, str]) -> DataFrame:
    """Packets of each flow by kind, a column for each named kind and one for the others."""
    return packets.groupBy(*key).agg(*(F.count(F.when(kind == k, 1)).alias(n) for k, n in names.items()), F.count(F.when(~kind.isin(*names), 1)).alias("others"))
