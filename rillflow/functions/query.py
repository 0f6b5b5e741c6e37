"""The query functions over flow columns, as Column expressions. Bits, text, numbers and addresses stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.types import FLOW_STATUS, PROTOCOLS, TCP_FLAGS

Value = Column | str


def _c(v: Value) -> Column:
    return F.col(v) if isinstance(v, str) else v


# Text ---------------------------------------------------------------------------------------------------------


def _folded(v: Value, ignore_case: bool) -> Column:
    return F.lower(_c(v)) if ignore_case else _c(v)


def _text(s: str, ignore_case: bool) -> Column:
    return F.lit(s.lower() if ignore_case else s)


def contains(v: Value, s: str, ignore_case: bool = False) -> Column:
    return _folded(v, ignore_case).contains(_text(s, ignore_case))


def has_prefix(v: Value, s: str, ignore_case: bool = False) -> Column:
    return _folded(v, ignore_case).startswith(_text(s, ignore_case))


def has_suffix(v: Value, s: str, ignore_case: bool = False) -> Column:
    return _folded(v, ignore_case).endswith(_text(s, ignore_case))


def unquote(v: Value) -> Column:
    return F.regexp_replace(_c(v), '^"|"$', "")


def str_equal(v: Value, s: str, ignore_case: bool = False) -> Column:
    return _folded(unquote(v), ignore_case) == _text(s, ignore_case)


def is_empty(v: Value) -> Column:
    return F.coalesce(_c(v), F.lit("")) == ""


def strip(v: Value) -> Column:
    return F.regexp_replace(_c(v), r"^\s+|\s+$", "")


def left_strip(v: Value) -> Column:
    return F.regexp_replace(_c(v), r"^\s+", "")


def right_strip(v: Value) -> Column:
    return F.regexp_replace(_c(v), r"\s+$", "")


def value_contains(v: Value, separator: str, item: str, ignore_case: bool = False) -> Column:
    """One of the parts is ``item``; repetitive values are parted by ``;``, compound ones by ``_``."""
    return F.array_contains(F.split(_folded(v, ignore_case), re.escape(separator)), _text(item, ignore_case))


def part(v: Value, separator: str, n: int) -> Column:
    """The n-th part from 1, from the end if negative; null if there is none."""
    return F.try_element_at(F.split(_c(v), re.escape(separator)), F.lit(n))


def joined(v: Value, separator: str) -> Column:
    return F.array_join(_c(v), separator)


def url_decode(v: Value) -> Column:
    return F.try_url_decode(_c(v))


def base64_decode(v: Value) -> Column:
    return F.try_to_binary(_c(v), F.lit("base64")).cast("string")


def tex_escape(v: Value) -> Column:
    out = F.regexp_replace(_c(v), r"\\", r"\\textbackslash ")
    out = F.regexp_replace(out, r"([&%$#_{}])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(out, "~", r"\\textasciitilde "), r"\^", r"\\textasciicircum ")


# Numbers and bits ---------------------------------------------------------------------------------------------


def is_number(v: Value) -> Column:
    return _c(v).try_cast("double").isNotNull()


def hex_number(v: Value) -> Column:
    """``0x1f`` as a number."""
    return F.conv(F.regexp_extract(_c(v), "^0x([0-9a-fA-F]+)$", 1), 16, 10).try_cast("long")


def bits_all(v: Value, mask: int) -> Column:
    return _c(v).bitwiseAND(F.lit(mask)) == F.lit(mask)


def bits_any(v: Value, mask: int) -> Column:
    return _c(v).bitwiseAND(F.lit(mask)) != 0


def bitfield_equal(a: Value, b: Value) -> Column:
    return hex_number(a) == hex_number(b)


def human(v: Value) -> Column:
    """2000 as ``2.00 K``; below 1024 as it is."""
    out, x = None, _c(v)
    for i, unit in ((4, "T"), (3, "G"), (2, "M"), (1, "K")):
        text = F.concat(F.format_number(x / 1000.0**i, 2), F.lit(f" {unit}"))
        out = F.when(F.abs(x) >= 1024**i, text) if out is None else out.when(F.abs(x) >= 1024**i, text)
    return out.otherwise(x.cast("string"))


# Addresses ----------------------------------------------------------------------------------------------------


def ip_number(ip: Value) -> Column:
    """An IPv4 address in dotted form as a number, null for anything else."""
    # Cut at dots as bytes: an array of all parts for each of them would cost several times the rest.
    two, rest = F.substring_index(_c(ip), ".", 2), F.substring_index(_c(ip), ".", -2)
    p = [F.substring_index(v, ".", i).try_cast("long") for v in (two, rest) for i in (1, -1)]
    return F.when(is_ip_text(ip), ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3])


def ip_text(n: Value) -> Column:
    n = _c(n)
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def ip_hex(ip: Value) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(ip_number(ip)), 8, "0")))


def mask_number(bits: int) -> int:
    return 0xFFFFFFFF << (32 - bits) & 0xFFFFFFFF


def mask_bits(ip: Value) -> Column:
    """Length of a network mask given as an address."""
    return F.bit_count(ip_number(ip))


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def in_net(ip: Value, net: str) -> Column:
    """``net`` as ``1.2.3.0/24``; an address alone stands for itself. IPv6 addresses are in no IPv4 network."""
    base, _, bits = net.partition("/")
    mask = mask_number(int(bits or 32))
    return F.coalesce(ip_number(ip).bitwiseAND(F.lit(mask)) == F.lit(_number(base) & mask), F.lit(False))


def in_range(ip: Value, low: str, high: str) -> Column:
    return F.coalesce(ip_number(ip).between(_number(low), _number(high)), F.lit(False))


def is_ip_text(v: Value) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.coalesce(_c(v).rlike(rf"^(?:{octet}\.){{3}}{octet}$"), F.lit(False))


def is_ip_hex(v: Value) -> Column:
    return F.coalesce(_c(v).rlike("^0x[0-9a-fA-F]{8}$"), F.lit(False))


def is_ip_number(v: Value) -> Column:
    return F.coalesce(_c(v).try_cast("long").between(0, 0xFFFFFFFF), F.lit(False))


def is_ip(v: Value) -> Column:
    return is_ip_text(v) | is_ip_hex(v) | is_ip_number(v)


def is_ip6(v: Value) -> Column:
    return F.coalesce(_c(v).rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:.]*$"), F.lit(False))


def private(ip: Value) -> Column:
    return in_net(ip, "10.0.0.0/8") | in_net(ip, "172.16.0.0/12") | in_net(ip, "192.168.0.0/16")


def multicast(ip: Value) -> Column:
    return in_net(ip, "224.0.0.0/4") | F.coalesce(F.lower(_c(ip)).startswith("ff") & is_ip6(ip), F.lit(False))


def loopback(ip: Value) -> Column:
    return in_net(ip, "127.0.0.0/8") | F.coalesce(_c(ip).isin("::1", "0:0:0:0:0:0:0:1"), F.lit(False))


def ip6_expand(ip: Value) -> Column:
    """An IPv6 address in full: eight groups of four digits."""
    sides = F.split(F.lower(_c(ip)), "::", 2)
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    head, tail = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), ":")


def ip6_compress(ip: Value) -> Column:
    """The short form of an IPv6 address: no leading zeros, the longest run of zero groups (of equal ones the first) as ``::``."""
    short = F.array_join(F.transform(F.split(ip6_expand(ip), ":"), lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")
    out = short
    for n in range(2, 9):  # longer runs override shorter ones
        run = rf"(^|:)0(:0){{{n - 1}}}(:|$)"
        out = F.when(short.rlike(run), F.concat(F.regexp_extract(short, rf"^(.*?){run}", 1), F.lit("::"), F.regexp_extract(short, rf"^.*?{run}(.*)$", 4))).otherwise(out)
    return out


# Flows --------------------------------------------------------------------------------------------------------


def any_of(column: Value, wanted: int | str | Iterable) -> Column:
    """Equal to a number, within ``"low-high"``, or any of several of these."""
    if isinstance(wanted, (int, str)):
        wanted = [wanted]
    out = F.lit(False)
    for w in wanted:
        low, dash, high = str(w).partition("-")
        out |= _c(column).between(int(low, 0), int(high, 0)) if dash else _c(column) == int(low, 0)
    return out


def port(wanted, src: str = "src_port", dst: str = "dst_port") -> Column:
    return any_of(src, wanted) | any_of(dst, wanted)


def host(net: str, src: str = "src_ip", dst: str = "dst_ip") -> Column:
    return in_net(src, net) | in_net(dst, net)


def protocol(name: str, column: str = "l4_proto") -> Column:
    return _c(column) == next(n for n, p in PROTOCOLS.items() if p.lower() == name.lower())


def protocol_name(column: str = "l4_proto") -> Column:
    out = F.create_map(*(F.lit(x) for pair in PROTOCOLS.items() for x in pair))
    return F.coalesce(F.try_element_at(out, _c(column).cast("int")), F.lit("unknown"))


def status(name: str, column: str = "flow_stat") -> Column:
    return bits_any(column, FLOW_STATUS[name])


def is_any_ip(column: str = "flow_stat") -> Column:
    return bits_any(column, FLOW_STATUS["ipv4"] | FLOW_STATUS["ipv6"])


def tuple_of(n: int) -> Column:
    """The 2- to 5-tuple of a flow."""
    names = {2: ("src_ip", "dst_ip"), 3: ("src_ip", "dst_ip", "dst_port"), 4: ("src_ip", "src_port", "dst_ip", "dst_port"), 5: ("src_ip", "src_port", "dst_ip", "dst_port", "l4_proto")}
    return F.struct(*names[n])


def utc_text(us: Value) -> Column:
    """Microseconds since 1970 as UTC text, whatever the session's zone."""
    return F.date_format(F.timestamp_micros(_c(us)).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def columns_like(df: DataFrame, pattern: str, negate: bool = False) -> DataFrame:
    """The columns whose names match."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if bool(re.search(pattern, c)) != negate))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("json"))


#: The other dialect's output fields, as expressions over flow columns.
SHORT_NAMES = {
    "sa": lambda: F.col("src_ip"), "da": lambda: F.col("dst_ip"), "sp": lambda: F.col("src_port"), "dp": lambda: F.col("dst_port"),
    "sap": lambda: F.concat_ws(":", "src_ip", "src_port"), "dap": lambda: F.concat_ws(":", "dst_ip", "dst_port"), "pr": protocol_name,
    "ipkt": lambda: F.col("pkts_rcvd"), "opkt": lambda: F.col("pkts_snt"), "ibyt": lambda: F.col("bytes_rcvd"), "obyt": lambda: F.col("bytes_snt"), "td": lambda: F.col("duration"),
    "pps": lambda: F.when(F.col("duration") > 0, F.col("pkts_snt") / F.col("duration")).otherwise(0.0),
    "bps": lambda: F.when(F.col("duration") > 0, 8 * F.col("bytes_snt") / F.col("duration")).otherwise(0.0),
    "bpp": lambda: F.when(F.col("pkts_snt") > 0, F.col("bytes_snt") / F.col("pkts_snt")).otherwise(0.0),
}


def short_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(SHORT_NAMES[n]().alias(n) for n in names))


# Numbers, choice and parts ------------------------------------------------------------------------------------


def largest(*values: Value) -> Column:
    """The greatest of two or more values; nulls don't count."""
    return F.greatest(*map(_c, values))


def smallest(*values: Value) -> Column:
    return F.least(*map(_c, values))


def negated(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """Least, greatest and mean value of a column."""
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("mean"))


def numbered(df: DataFrame, column: str, wanted: Iterable[int | str] | DataFrame) -> DataFrame:
    """The flows or packets of these numbers or ``"low-high"`` ranges, or of those in a table of one column of numbers (a semi-join)."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(f"`{wanted.columns[0]}`").alias(column)), column, "left_semi")
    return df.where(any_of(column, wanted))


def split_parts(v: Value, separator: str, first: int = 1, last: int | None = None, joined_by: str | None = None) -> Column:
    """The parts from ``first`` to ``last`` of a value (from 1; negative: from the end), joined by the same or another separator."""
    parts = F.split(_c(v), re.escape(separator))
    place = lambda n: F.lit(n) if n > 0 else F.size(parts) + n + 1
    a, b = F.greatest(place(first), F.lit(1)), F.least(place(first if last is None else last), F.size(parts))
    return F.array_join(F.slice(parts, a, F.greatest(b - a + 1, F.lit(0))), separator if joined_by is None else joined_by)


def compound(v: Value, n: int) -> Column:
    """The n-th part of a compound value."""
    return split_parts(v, "_", n)


def repetition(v: Value, n: int) -> Column:
    """The n-th item of a repetitive value."""
    return split_parts(v, ";", n)


# Times --------------------------------------------------------------------------------------------------------


def local_text(us: Value, zone: str) -> Column:
    """Microseconds since 1970 as text in ``zone``; the session's own zone must be UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(_c(us)), zone), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def unix_micros(text: Value) -> Column:
    """Microseconds since 1970 of a UTC time text; null where it isn't one."""
    return F.unix_micros(F.try_to_timestamp(_c(text)))


# Masks and hardware addresses ---------------------------------------------------------------------------------


def mask_text(bits: int) -> str:
    """A network mask as an IPv4 address."""
    n = mask_number(bits)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def mask6_text(bits: int) -> str:
    """A network mask as an IPv6 address, all eight groups."""
    n = (1 << 128) - (1 << (128 - bits))
    return ":".join(f"{n >> s & 0xFFFF:04x}" for s in range(112, -1, -16))


def flags_text(flags: Value) -> Column:
    """Letters of the set TCP flags, highest bit first, a dot for each that isn't set."""
    return F.concat(*(F.when(bits_any(flags, bit), F.lit(c)).otherwise(F.lit(".")) for c, bit in reversed(TCP_FLAGS.items())))


def in_net6(expanded: Value, net: str, bits: int) -> Column:
    """Whether an expanded IPv6 address lies in a subnet, by its leading digits; a prefix may end within a digit."""
    import ipaddress

    digits, (whole, rest) = F.replace(F.lower(_c(expanded)), F.lit(":"), F.lit("")), divmod(bits, 4)
    wanted = f"{int(ipaddress.IPv6Address(net)):032x}"
    same = F.substring(digits, 1, whole) == wanted[:whole] if whole else F.lit(True)
    if rest:
        low = int(wanted[whole], 16) >> (4 - rest) << (4 - rest)
        same &= F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int").between(low, low + (1 << (4 - rest)) - 1)
    return same


def ether(mac: str, src: str = "src_mac", dst: str = "dst_mac", side: str = "any") -> Column:
    """Whether a hardware address, in either spelling of case, is among the source, destination or any addresses of a flow (arrays)."""
    held = lambda c: F.exists(F.coalesce(_c(c), F.array()), lambda x: F.lower(x) == mac.lower())
    return {"src": held(src), "dst": held(dst), "any": held(src) | held(dst)}[side]


def has_status(column: str, unless: int = 0) -> Column:
    """Whether a decoder left a status other than 0 (HTTP, DHCP), without any of the bits ``unless`` (DNS without name service)."""
    found = F.coalesce(_c(column), F.lit(0))
    return (found != 0) & (found.bitwiseAND(unless) == 0)


def tuple6(vlan: str = "vlan") -> Column:
    """The 5-tuple with the innermost tag of the flow's network."""
    return F.struct("src_ip", "src_port", "dst_ip", "dst_port", "l4_proto", F.col(vlan))


SHORT_NAMES |= {f"mpls{n}": (lambda n=n: F.try_element_at("mpls", F.lit(n))) for n in range(1, 11)}
_MOMENT = "yyyy-MM-dd HH:mm:ss.SSS"
SHORT_NAMES |= {
    "mpls": lambda: F.array_join("mpls", "-"), "byt": lambda: F.col("bytes_rcvd"), "pkt": lambda: F.col("pkts_rcvd"), "flg": lambda: flags_text(F.col("tcp_flags")),
    "ts": lambda: F.date_format(F.timestamp_micros("t_first"), _MOMENT), "te": lambda: F.date_format(F.timestamp_micros("t_last"), _MOMENT),
}

#: The other dialect's output formats, as lists of its fields.
FORMATS = {
    "line": ("ts", "td", "pr", "sap", "dap", "pkt", "byt"),
    "long": ("ts", "td", "pr", "sap", "dap", "flg", "pkt", "byt"),
    "extended": ("ts", "td", "pr", "sap", "dap", "flg", "pkt", "byt", "pps", "bps", "bpp"),
}


def formatted(df: DataFrame, name: str) -> DataFrame:
    """Flows in one of the output formats; times are UTC texts if the session's zone is UTC."""
    return short_fields(df, *FORMATS[name])
