"""Two small filter dialects over flow columns, read by one pattern each.

Both combine their terms from left to right, ``&&`` and ``||`` having equal rank, as flow tools do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions import query as q
from rillflow.types import TCP_FLAGS

_TERM = re.compile(r"\s*(&&|\|\|)?\s*([\w.]+)\s*((?!&&|\|\|)(?:==|!=|>=|<=|>|<|&|\||\^))?\s*(\"[^\"]*\"|[\w.:/-]+)?")

#: Display-filter fields and the flow columns or tests that they stand for.
FIELDS = {"ip.src": "src_ip", "ip.dst": "dst_ip", "tcp.srcport": "src_port", "tcp.dstport": "dst_port", "udp.srcport": "src_port", "udp.dstport": "dst_port", "ip.proto": "l4_proto", "frame.len": "bytes_snt"}
_FLAG_NAMES = {"fin": "F", "syn": "S", "reset": "R", "push": "P", "ack": "A", "urg": "U", "ecn": "E", "cwr": "C"}


def _compare(left: Column, operator: str, right: Column) -> Column:
    return {
        "==": lambda: left == right, "!=": lambda: left != right, ">=": lambda: left >= right, "<=": lambda: left <= right, ">": lambda: left > right, "<": lambda: left < right,
        "&": lambda: left.bitwiseAND(right) != 0, "|": lambda: left.bitwiseOR(right) != 0, "^": lambda: left.bitwiseXOR(right) != 0,
    }[operator]()


def _literal(text: str) -> Column:
    if text.startswith('"'):
        return F.lit(text[1:-1])
    try:
        return F.lit(int(text, 0))
    except ValueError:
        try:
            return F.lit(float(text))
        except ValueError:
            return F.lit(text)


def _fold(text: str, term) -> Column:
    out, at = None, 0
    while at < len(text.rstrip()):
        m = _TERM.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the filter at {text[at:]!r}")
        at = m.end()
        one = term(m[2], m[3], m[4])
        out = one if out is None else out & one if m[1] == "&&" else out | one
    return F.lit(True) if out is None else out


def column_filter(text: str) -> Column:
    """``bytes >= 100 && dst_port == 443 || flags & 2`` over column names."""
    return _fold(text, lambda name, op, value: _compare(F.col(name), op, _literal(value)) if op else F.col(name) != 0)


def display_filter(text: str) -> Column:
    """``tcp && ip.src == 10.0.0.0/8 && tcp.flags.syn == 1`` over flow columns; a field alone tests presence."""

    def term(name: str, op: str | None, value: str | None) -> Column:
        if name in ("ip", "ipv6", "arp", "vlan"):
            return q.status({"ip": "ipv4"}.get(name, name))
        if "." not in name:
            return q.protocol(name)
        family = q.protocol(name.split(".")[0]) if name.split(".")[0] in ("tcp", "udp") else F.lit(True)
        if name.startswith("tcp.flags."):
            hit = q.bits_any("tcp_flags", TCP_FLAGS[_FLAG_NAMES[name.rsplit(".", 1)[1]]])
            return family & (~hit if value == "0" else hit)
        if name == "ip.addr":
            return ~q.host(value) if op == "!=" else q.host(value)
        if name in ("tcp.port", "udp.port"):
            return family & (q.port(value) if op == "==" else ~q.port(value))
        if name in ("ip.src", "ip.dst") and value and re.match(r"[\d.]+(/\d+)?$", value):
            hit = q.in_net(FIELDS[name], value)
            return ~hit if op == "!=" else hit
        return family & (_compare(F.col(FIELDS[name]), op, _literal(value)) if op else F.col(FIELDS[name]).isNotNull())

    return _fold(text, term)
