"""Application decoders over payload columns. Text protocols are expressions; DNS and TLS are parsed in Arrow batches."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def http(text: Column) -> dict[str, Column]:
    """Method, target, status, host, agent, server and content type of a message, null where absent."""
    head = lambda name: _line(text, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$")
    return {
        "method": _line(text, r"^(GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH) "), "target": _line(text, r"^[A-Z]+ (\S+) HTTP/"), "status": _line(text, r"^HTTP/\d\.\d (\d{3})").cast("int"),
        "host": head("Host"), "agent": head("User-Agent"), "server": head("Server"), "mime": _line(text, r"(?im)^Content-Type:[ \t]*([^;\r\n]*)"),
    }


def mail(text: Column) -> dict[str, Column]:
    """Command, reply code, sender and recipient of a mail line."""
    return {"command": F.upper(_line(text, r"(?i)^(HELO|EHLO|MAIL|RCPT|DATA|AUTH|STARTTLS|RSET|VRFY|QUIT|USER|PASS|STAT|LIST|RETR|DELE|TOP|UIDL|APOP)\b")), "code": _line(text, r"^(\d{3})[ -]").cast("int"), "sender": _line(text, r"(?i)^MAIL FROM:\s*<([^>]*)>"), "recipient": _line(text, r"(?i)^RCPT TO:\s*<([^>]*)>")}


def file_transfer(text: Column) -> dict[str, Column]:
    """Command, reply code, user, password and announced data endpoint of a control line."""
    six = r"(\d+),(\d+),(\d+),(\d+),(\d+),(\d+)"
    n = lambda i: F.regexp_extract(text, six, i)
    at = F.when(text.rlike(six), F.concat_ws(".", n(1), n(2), n(3), n(4)))
    return {"command": F.upper(_line(text, r"^([A-Za-z]{3,4})\b")), "code": _line(text, r"^(\d{3})[ -]").cast("int"), "user": _line(text, r"(?i)^USER (\S+)"), "password": _line(text, r"(?i)^PASS (\S+)"), "data_ip": at, "data_port": F.when(text.rlike(six), n(5).try_cast("int") * 256 + n(6).try_cast("int"))}


def secure_shell(text: Column) -> dict[str, Column]:
    return {"version": _line(text, r"^SSH-(\d\.\d+)-"), "software": _line(text, r"^SSH-\d\.\d+-([^\r\n]*)")}


def chat_relay(text: Column) -> dict[str, Column]:
    return {"command": F.upper(_line(text, r"^(?::\S+ )?([A-Za-z]+|\d{3})\b")), "nick": _line(text, r"(?i)^NICK (\S+)"), "user": _line(text, r"(?i)^USER (\S+)"), "password": _line(text, r"(?i)^PASS (\S+)")}


def system_log(text: Column) -> dict[str, Column]:
    """Severity and facility of a priority."""
    v = _line(text, r"^<(\d{1,3})>").try_cast("int")
    return {"severity": v.bitwiseAND(7), "facility": F.shiftright(v, 3)}


def calls(text: Column) -> dict[str, Column]:
    """Method, status and call id of a session message."""
    return {"method": _line(text, r"^([A-Z]+) sip:"), "status": _line(text, r"^SIP/2\.0 (\d{3})").cast("int"), "call_id": _line(text, r"(?im)^Call-ID:\s*(\S+)")}


def credentials(text: Column) -> Column:
    """``user:password`` of basic authentication, or of plain commands."""
    basic = F.try_to_binary(_line(text, r"(?im)^Authorization: Basic ([A-Za-z0-9+/=]+)"), F.lit("base64")).cast("string")
    plain = F.when(text.rlike(r"(?im)^(USER|LOGIN) \S+") & text.rlike(r"(?im)^PASS \S+"), F.concat_ws(":", _line(text, r"(?im)^(?:USER|LOGIN) (\S+)"), _line(text, r"(?im)^PASS (\S+)")))
    return F.coalesce(basic, plain)


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed domain name and the place after it."""
    labels, after, jumps = [], None, 0
    while at < len(data) and jumps < 32:
        n = data[at]
        if n >= 0xC0 and at + 1 < len(data):
            after = at + 2 if after is None else after
            at, jumps = (n & 0x3F) << 8 | data[at + 1], jumps + 1
        elif n == 0 or n >= 0x40:
            at += 1
            break
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
            at += 1 + n
    return ".".join(labels), at if after is None else after


def dns_message(data: bytes) -> dict | None:
    """Id, flags, reply code, questions, and address and name answers of a message; None if it isn't one."""
    if data is None or len(data) < 12:
        return None
    ident, flags, questions, answers = struct.unpack_from("!HHHH", data)
    out = {"id": ident, "reply": bool(flags & 0x8000), "opcode": flags >> 11 & 15, "rcode": flags & 15, "names": [], "types": [], "answers": []}
    at = 12
    try:
        for _ in range(questions):
            name, at = _name(data, at)
            out["names"].append(name)
            out["types"].append(struct.unpack_from("!H", data, at)[0])
            at += 4
        for _ in range(answers):
            _, at = _name(data, at)
            kind, _, _, size = struct.unpack_from("!HHIH", data, at)
            at += 10
            body = data[at : at + size]
            if kind == 1 and size == 4:
                out["answers"].append(".".join(map(str, body)))
            elif kind == 28 and size == 16:
                out["answers"].append(":".join(f"{a:x}" for a in struct.unpack("!8H", body)))
            elif kind in (2, 5, 12):
                out["answers"].append(_name(data, at)[0])
            at += size
    except struct.error:
        pass
    return out


def _grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


def client_hello(data: bytes) -> dict | None:
    """Version, server name and fingerprint (MD5 of version, ciphers, extensions, groups, point formats) of a client's first message."""
    if data is None or len(data) < 43 or data[0] != 22 or data[5] != 1:
        return None
    try:
        version = struct.unpack_from("!H", data, 9)[0]
        at = 43
        at += 1 + data[at]
        size = struct.unpack_from("!H", data, at)[0]
        ciphers = struct.unpack_from(f"!{size // 2}H", data, at + 2)
        at += 2 + size
        at += 1 + data[at]
        kinds, groups, formats, server = [], [], [], None
        end = at + 2 + struct.unpack_from("!H", data, at)[0] if at + 2 <= len(data) else at
        at += 2
        while at + 4 <= min(end, len(data)):
            kind, n = struct.unpack_from("!HH", data, at)
            body = data[at + 4 : at + 4 + n]
            kinds.append(kind)
            if kind == 0 and len(body) > 5:
                server = body[5 : 5 + struct.unpack_from("!H", body, 3)[0]].decode("ascii", "replace")
            elif kind == 10 and len(body) >= 2:
                groups = struct.unpack_from(f"!{(len(body) - 2) // 2}H", body, 2)
            elif kind == 11:
                formats = list(body[1:])
            at += 4 + n
    except (struct.error, IndexError):
        return None
    text = ",".join([str(version), *("-".join(str(v) for v in vs if not _grease(v)) for vs in (ciphers, kinds, groups)), "-".join(map(str, formats))])
    return {"version": version, "server_name": server, "fingerprint": hashlib.md5(text.encode()).hexdigest()}


_DECODERS = {
    "dns": (dns_message, "id int, reply boolean, opcode int, rcode int, names array<string>, types array<int>, answers array<string>"),
    "tls": (client_hello, "version int, server_name string, fingerprint string"),
}


def decode(packets: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Adds a struct column of what a payload says in ``kind``, null where it says nothing; a map over partitions."""
    parse, schema = _DECODERS[kind]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            yield pd.DataFrame([parse(bytes(x)) or {} if x is not None else {} for x in b], columns=names).astype(object).where(lambda d: d.notna(), None)

    return packets.withColumn(kind, run(F.col(payload)))
