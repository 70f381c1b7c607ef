"""Protocol parsers, bytes to rows in plain Python, and their wrapper for DataFrames. None raises on bad bytes."""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwake.functions.net import DNS_TYPES, ICMP_TYPES

_GROUP = 256  # rows of a batch that are held as Python objects at a time
METHODS = (b"GET", b"POST", b"PUT", b"HEAD", b"DELETE", b"OPTIONS", b"PATCH", b"CONNECT", b"TRACE")


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _dns_name(data: bytes, at: int) -> tuple[str, int]:
    labels, end, hops = [], None, 0
    while True:
        n = data[at]
        if n & 0xC0 == 0xC0:
            end = at + 2 if end is None else end
            at, hops = (n & 0x3F) << 8 | data[at + 1], hops + 1
            if hops > 256:
                raise ValueError("a name points in circles")
        elif n == 0:
            return ".".join(labels), at + 1 if end is None else end
        else:
            labels.append(_text(data[at + 1 : at + 1 + n]))
            at += 1 + n


def dns(data: bytes, tcp: bool = False) -> list[dict]:
    """A row per question (no data) and answer of a message; of all messages of a TCP direction, with each one's offset."""
    if not tcp:
        return [x | {"at": 0} for x in dns_message(data)]
    out, at = [], 0
    while at + 2 <= len(data):
        size = struct.unpack_from(">H", data, at)[0]
        out += [x | {"at": at} for x in dns_message(data[at + 2 : at + 2 + size])]
        at += 2 + size
    return out


def dns_message(data: bytes) -> list[dict]:
    out: list[dict] = []
    try:
        ident, flags, questions, answers = struct.unpack_from(">HHHH", data)
        at = 12
        base = {"id": ident, "is_response": bool(flags & 0x8000), "rcode": flags & 15}
        for _ in range(questions):
            name, at = _dns_name(data, at)
            kind = struct.unpack_from(">H", data, at)[0]
            at += 4
            out.append(base | {"name": name, "type": DNS_TYPES.get(kind, f"TYPE{kind}"), "ttl": None, "data": None})
        for _ in range(answers if flags & 0x8000 else 0):
            name, at = _dns_name(data, at)
            kind, _, ttl, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            raw = data[at : at + size]
            if len(raw) < size:
                break
            if kind in (1, 28) and size in (4, 16):
                value = str(ipaddress.ip_address(raw))
            elif kind in (2, 5, 6, 12):
                value = _dns_name(data, at)[0]
            elif kind == 15:
                value = _dns_name(data, at + 2)[0]
            elif kind == 16 and raw:
                value = _text(raw[1 : 1 + raw[0]])
            else:
                value = raw.hex()
            out.append(base | {"name": name, "type": DNS_TYPES.get(kind, f"TYPE{kind}"), "ttl": ttl, "data": value})
            at += size
    except (IndexError, struct.error, ValueError):
        pass
    return out


def _http_head(block: bytes) -> tuple[bytes, dict[str, str]]:
    lines = block.split(b"\r\n")
    headers = {}
    for x in lines[1:]:
        k, sep, v = x.partition(b":")
        if sep:
            headers[_text(k).strip().lower()] = _text(v).strip()
    return lines[0], headers


def _http_body(data: bytes, at: int, headers: dict[str, str], to_end: bool) -> tuple[bytes, int]:
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = bytearray()
        while (end := data.find(b"\r\n", at)) >= 0:
            try:
                size = int(data[at:end].split(b";")[0], 16)
            except ValueError:
                break
            body += data[end + 2 : end + 2 + size]
            at = min(len(data), end + 2 + size + 2)
            if size == 0:
                break
        return bytes(body), at
    size = headers.get("content-length", "")
    n = int(size) if size.isascii() and size.isdigit() else len(data) - at if to_end else 0
    return data[at : at + n], min(len(data), at + n)


def http(client: bytes, server: bytes, bodies: bool = False) -> list[dict]:
    """Transactions of a connection: the n-th request with the n-th response; with bodies each response's `body`.

    If no request is whole but the first line has a method, that line counts as one.
    """
    requests, responses = [], []
    at = 0
    while (end := client.find(b"\r\n\r\n", at)) >= 0:
        line, headers = _http_head(client[at:end])
        parts = line.split(b" ")
        if parts[0] not in METHODS or len(parts) < 2:
            break
        begin = at
        body, at = _http_body(client, end + 4, headers, False)
        cookies = [x.strip() for x in headers.get("cookie", "").split(";") if x.strip()]
        requests.append({"method": _text(parts[0]), "uri": _text(parts[1]), "host": headers.get("host"), "user_agent": headers.get("user-agent"), "request_headers": headers, "cookies": cookies, "request_size": len(body), "request_at": begin})
    if not requests and (parts := client.split(b"\n", 1)[0].rstrip(b"\r").split(b" "))[0] in METHODS and len(parts) > 1:
        _, headers = _http_head(client)
        requests.append({"method": _text(parts[0]), "uri": _text(parts[1]), "host": headers.get("host"), "user_agent": headers.get("user-agent"), "request_headers": headers, "cookies": [], "request_size": 0, "request_at": 0})
    at = 0
    while (end := server.find(b"\r\n\r\n", at)) >= 0:
        line, headers = _http_head(server[at:end])
        parts = line.split(b" ")
        if not line.startswith(b"HTTP/") or len(parts) < 2 or not parts[1].isdigit():
            break
        begin = at
        body, at = _http_body(server, end + 4, headers, not 100 <= int(parts[1]) < 200 and int(parts[1]) not in (204, 304))
        responses.append({"status": int(parts[1]), "content_type": headers.get("content-type"), "response_headers": headers, "response_size": len(body), "response_at": begin, "body_sha256": hashlib.sha256(body).hexdigest() if body else None} | ({"body": body} if bodies else {}))
    none_q = dict.fromkeys(("method", "uri", "host", "user_agent", "request_headers", "cookies", "request_size", "request_at"))
    none_r = dict.fromkeys(("status", "content_type", "response_headers", "response_size", "response_at", "body_sha256", *(("body",) if bodies else ())))
    n = max(len(requests), len(responses))
    return [{"ordinal": k} | (requests[k] if k < len(requests) else none_q) | (responses[k] if k < len(responses) else none_r) for k in range(n)]


def is_grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A


def ja3(version: int, ciphers: list[int], extensions: list[int], curves: list[int], formats: list[int]) -> tuple[str, str]:
    """The fingerprint's text and its MD5."""
    text = ",".join([str(version), *("-".join(str(v) for v in x if not is_grease(v)) for x in (ciphers, extensions, curves)), "-".join(map(str, formats))])
    return text, hashlib.md5(text.encode()).hexdigest()


def tls_hello(data: bytes) -> dict | None:
    """The first record's ClientHello or ServerHello."""
    try:
        if data[0] != 0x16 or data[1] != 3:
            return None
        kind, at = data[5], 9
        version = struct.unpack_from(">H", data, at)[0]
        at += 34
        at += 1 + data[at]
        out = {"hello": "client" if kind == 1 else "server", "version": version, "sni": None, "alpn": [], "ciphers": [], "extensions": [], "curves": [], "formats": []}
        if kind == 1:
            n = struct.unpack_from(">H", data, at)[0]
            out["ciphers"] = list(struct.unpack_from(f">{n // 2}H", data, at + 2))
            at += 2 + n
            at += 1 + data[at]
        elif kind == 2:
            out["ciphers"] = [struct.unpack_from(">H", data, at)[0]]
            at += 3
        else:
            return None
        end = min(len(data), at + 2 + struct.unpack_from(">H", data, at)[0]) if at + 2 <= len(data) else at
        at += 2
        while at + 4 <= end:
            code, n = struct.unpack_from(">HH", data, at)
            body = data[at + 4 : at + 4 + n]
            out["extensions"].append(code)
            if code == 0 and len(body) > 5 and kind == 1:
                out["sni"] = _text(body[5 : 5 + struct.unpack_from(">H", body, 3)[0]])
            elif code == 10 and len(body) >= 2:
                out["curves"] = [v for (v,) in struct.iter_unpack(">H", body[2 : 2 + (len(body) - 2) // 2 * 2])]
            elif code == 11 and body:
                out["formats"] = list(body[1 : 1 + body[0]])
            elif code == 16:
                p = 2
                while p < len(body):
                    out["alpn"].append(_text(body[p + 1 : p + 1 + body[p]]))
                    p += 1 + body[p]
            at += 4 + n
        if kind == 1:
            out["ja3_text"], out["ja3"] = ja3(version, out["ciphers"], out["extensions"], out["curves"], out["formats"])
        else:
            out["ja3_text"] = f"{version},{out['ciphers'][0]},{'-'.join(str(v) for v in out['extensions'] if not is_grease(v))}"
            out["ja3"] = hashlib.md5(out["ja3_text"].encode()).hexdigest()
        return out
    except (IndexError, struct.error):
        return None


#: TLS versions by number (fixed values).
TLS_VERSIONS = {0x0002: "SSL 2.0", 0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


TELNET = {251: "WILL", 252: "WONT", 253: "DO", 254: "DONT"}


def telnet(data: bytes) -> tuple[bytes, list[str]]:
    """The text without commands, and the options negotiated."""
    out, options, k = bytearray(), [], 0
    while k < len(data):
        if data[k] != 255:
            out.append(data[k])
            k += 1
        elif k + 2 < len(data) and data[k + 1] in TELNET:
            options.append(f"{TELNET[data[k + 1]]} {data[k + 2]}")
            k += 3
        elif k + 1 < len(data) and data[k + 1] == 250:
            end = data.find(b"\xff\xf0", k)
            k = len(data) if end < 0 else end + 2
        elif k + 1 < len(data) and data[k + 1] == 255:
            out.append(255)
            k += 2
        else:
            k += 2
    return bytes(out), options


#: Telnet options by number (fixed values).
TELNET_OPTIONS = {0: "Binary", 1: "Echo", 3: "SuppressGoAhead", 5: "Status", 6: "TimingMark", 24: "TerminalType", 31: "WindowSize", 32: "TerminalSpeed", 33: "RemoteFlowControl", 34: "LineMode", 36: "Environment"}


def telnet_session(parts: list[tuple[bool, bytes]]) -> list[dict]:
    """Text, options and logins of (from the server, bytes) in order; a line of the client answers the last prompt."""
    content, options, logins, prompt, user = "", [], [], None, None
    for server, data in parts:
        clean, some = telnet(data)
        options += [f"{name} {TELNET_OPTIONS.get(int(code), code)}" for name, code in (x.split(" ") for x in some)]
        text = _text(clean)
        content += text
        if server:
            low = text.lower()
            prompt = "user" if "login:" in low or "username:" in low else "password" if "password:" in low else prompt
            continue
        for line in filter(None, map(str.strip, text.splitlines())):
            if prompt == "user":
                user, prompt = line, None
            elif prompt == "password":
                logins.append({"username": user, "password": line})
                user = prompt = None
    return [{"content": content, "options": options, "logins": logins}] if parts else []


SMB2 = ("Negotiate", "SessionSetup", "Logoff", "TreeConnect", "TreeDisconnect", "Create", "Close", "Flush", "Read", "Write", "Lock", "Ioctl", "Cancel", "Echo", "QueryDirectory", "ChangeNotify", "QueryInfo", "SetInfo", "OplockBreak")
SMB1 = {0x72: "Negotiate", 0x73: "SessionSetup", 0x75: "TreeConnect", 0xA2: "Create", 0x2E: "Read", 0x2F: "Write", 0x04: "Close", 0x25: "Transaction", 0x32: "Transaction2"}


def _share(message: bytes) -> str | None:
    """The path that a message names, in two-byte or one-byte characters."""
    for mark, width, kind in ((b"\\\0\\\0", 2, "utf-16-le"), (b"\\\\", 1, "utf-8")):
        if (k := message.find(mark)) >= 0:
            cut = next((e for e in range(k, len(message) - width + 1, width) if not any(message[e : e + width])), len(message))
            path = message[k : k + (cut - k) // width * width].decode(kind, "replace")
            if len(path) > 4:
                return path
    return None


def smb(data: bytes) -> dict | None:
    """Commands in order of first appearance, shares connected to, and the NTLM user of framed SMB messages."""
    commands, user, domain, shares, seen, at = [], None, None, [], False, 0
    while at + 4 <= len(data):
        size = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF
        m = data[at + 4 : at + 4 + size]
        at += 4 + size
        if m[:4] == b"\xfeSMB" and len(m) >= 14:
            n = struct.unpack_from("<H", m, 12)[0]
            name = SMB2[n] if n < len(SMB2) else f"0x{n:04x}"
        elif m[:4] == b"\xffSMB" and len(m) >= 5:
            name = SMB1.get(m[4], f"0x{m[4]:02x}")
        else:
            break
        seen = True
        if name not in commands:
            commands.append(name)
        if name == "TreeConnect" and (share := _share(m)) and share not in shares:
            shares.append(share)
        k = m.find(b"NTLMSSP\0\x03\0\0\0")
        if k >= 0 and len(m) >= k + 44:
            field = lambda o: m[k + struct.unpack_from("<I", m, k + o + 4)[0] :][: struct.unpack_from("<H", m, k + o)[0]].decode("utf-16-le", "replace")  # noqa: B023, E731
            domain, user = field(28), field(36)
    return {"commands": commands, "shares": shares, "ntlm_user": user, "ntlm_domain": domain} if seen else None


def icmp(data: bytes) -> dict | None:
    return {"type": data[0], "code": data[1], "name": ICMP_TYPES.get(data[0], f"Type {data[0]}"), "payload": data[8:] if len(data) > 8 else data[4:]} if len(data) >= 4 else None


DNS_SCHEMA = "flow_id string, id int, is_response boolean, rcode int, name string, type string, ttl long, data string, at long"
HTTP_SCHEMA = "flow_id string, ordinal int, method string, uri string, host string, user_agent string, request_headers map<string,string>, cookies array<string>, request_size long, status int, content_type string, response_headers map<string,string>, response_size long, body_sha256 string, request_at long, response_at long"
TLS_SCHEMA = "flow_id string, hello string, version int, sni string, alpn array<string>, ciphers array<int>, extensions array<int>, curves array<int>, formats array<int>, ja3_text string, ja3 string"


def _rows(df: DataFrame, columns: list[str], schema: str, parse) -> DataFrame:
    """parse (values of columns -> iterable of dicts) over Arrow batches; flow_id, ts and forward are carried along.

    _GROUP rows of a batch are Python objects at a time, and what they hold leaves before the next ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    carried = ["flow_id", *(c for c in ("ts", "forward") if c in df.columns)]
    schema = ", ".join([schema, *(f"{c} {df.schema[c].dataType.simpleString()}" for c in carried[1:])])
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, _GROUP) for whole in batches for lo in range(0, whole.num_rows, _GROUP)):
            own = zip(*(b.column(c).to_pylist() for c in carried), strict=True)
            rows = [dict(zip(carried, x, strict=True)) | r for x, *values in zip(own, *(b.column(c).to_pylist() for c in columns), strict=True) for r in parse(*values)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    return df.select(*carried, *columns).mapInArrow(run, schema)


def dns_records(segments: DataFrame) -> DataFrame:
    """segments: flow_id, data, and tcp (whether the message has a length before it)."""
    return _rows(segments, ["data", "tcp"], DNS_SCHEMA, lambda data, tcp: dns(data or b"", bool(tcp)))


def http_transactions(conversations: DataFrame) -> DataFrame:
    """conversations: flow_id, client and server bytes."""
    return _rows(conversations, ["client", "server"], HTTP_SCHEMA, lambda c, s: http(c or b"", s or b""))


def tls_hellos(streams: DataFrame) -> DataFrame:
    """streams: flow_id and data of either direction."""
    return _rows(streams, ["data"], TLS_SCHEMA, lambda data: [x] if (x := tls_hello(data or b"")) else [])


def conversations(streams: DataFrame, flows: DataFrame) -> DataFrame:
    """flow_id, app, client and server bytes: reassembled directions joined with what flows know of the client."""
    own = streams.join(flows.select("flow_id", "app", "from_lo"), "flow_id")
    mine = F.col("forward") == F.col("from_lo")
    return own.groupBy("flow_id", "app").agg(F.max(F.when(mine, F.col("data"))).alias("client"), F.max(F.when(~mine, F.col("data"))).alias("server"))


def valid_text(data: Column) -> Column:
    """Bytes as text, each part that is no UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("string"))


def stream_text(talk: DataFrame) -> DataFrame:
    """flow_id and text of both directions, the client's first."""
    both = F.concat(F.coalesce("client", F.lit(b"")), F.coalesce("server", F.lit(b"")))
    return talk.select("flow_id", valid_text(both).alias("text"))


def guess_of(data: Column) -> Column:
    """The protocol that a conversation's first bytes tell, in built-in functions; null if none."""
    head = F.substring(data, 1, 128)
    text, code = F.decode(head, "ISO-8859-1"), F.hex(F.substring(data, 1, 260))
    byte = lambda k: F.substring(code, 2 * k + 1, 2)
    number = lambda k, n: F.conv(F.substring(code, 2 * k + 1, 2 * n), 16, 10).cast("int")
    smb_at = lambda k: F.substring(code, 2 * k + 1, 8).isin("FF534D42", "FE534D42")
    greeting = text.startswith("220 ")
    return (
        F.when(byte(0).isin("16", "17") & (byte(1) == "03"), "Tls")
        .when(text.rlike("^(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|CONNECT) ") | text.startswith("HTTP/"), "Http")
        .when(text.startswith("SSH-"), "Ssh")
        .when((greeting & ~F.contains(F.upper(text), F.lit("SMTP"))) | text.startswith("USER ") | text.startswith("230 "), "Ftp")
        .when(greeting | text.startswith("EHLO ") | text.startswith("HELO "), "Smtp")
        .when(smb_at(0) | ((byte(0) == "00") & smb_at(4)), "Smb")
        .when((byte(0) == "FF") & (byte(1) >= "FB") & (byte(1) <= "FE"), "Telnet")
        .when(F.substring(code, 473, 8) == "63825363", "Dhcp")
        .when((F.octet_length(data) >= 12) & (F.floor(number(2, 1) / 8) % 16 <= 2) & number(4, 2).between(1, 10), "Dns")
    )


def routed(talk: DataFrame) -> DataFrame:
    """talk (flow_id, app, client, server) with `spoken`: the application by port, else by the first bytes."""
    first = F.when(F.octet_length("client") > 0, F.col("client")).otherwise(F.col("server"))
    return talk.withColumn("spoken", F.coalesce(F.when(F.col("app") != "Unknown", F.col("app")), guess_of(first)))


TELNET_SCHEMA = "flow_id string, content string, options array<string>, logins array<struct<username string, password string>>"
SMB_SCHEMA = "flow_id string, commands array<string>, shares array<string>, ntlm_user string, ntlm_domain string"
BODY_SCHEMA = "flow_id string, ordinal int, uri string, content_type string, body binary"


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lines(data: Column) -> Column:
    """Lines of bytes as text, without their ends; none of no bytes."""
    text = F.regexp_replace(valid_text(F.coalesce(data, F.lit(b""))), "(\r\n|\n|\r)\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\r\n|\n|\r"))


_BLANK = " \t\r\n\x0b\x0c"


def ftp_sessions(talk: DataFrame) -> DataFrame:
    """flow_id, username, password, files, auth_tls, passive, data_ports, bytes of control connections, in built-in functions.

    talk: flow_id, client and server bytes. The last user and password count.
    """
    parted = lambda t: F.struct(F.upper(F.split_part(t, F.lit(" "), F.lit(1))).alias("word"), F.when(F.contains(t, F.lit(" ")), F.substr(t, F.locate(" ", t) + 1)).otherwise("").alias("rest"))
    lines = F.transform(F.concat(_lines(F.col("client")), _lines(F.col("server"))), lambda x: parted(F.btrim(x, F.lit(_BLANK))))
    size = F.coalesce(F.octet_length("client"), F.lit(0)) + F.coalesce(F.octet_length("server"), F.lit(0))
    rows = talk.where(size > 0).select("flow_id", lines.alias("x"), size.cast("long").alias("bytes"))
    of = lambda *words: F.filter("x", lambda v: v["word"].isin(*words))
    last = lambda word: F.try_element_at(of(word), F.lit(-1))["rest"]
    six = r"(\d+),(\d+),(\d+),(\d+),(\d+),(\d+)"
    pair = lambda t: F.regexp_extract(t, six, 5).try_cast("int") * 256 + F.regexp_extract(t, six, 6).try_cast("int")
    port = lambda v: F.when(v["word"].isin("227", "PORT"), pair(v["rest"])).otherwise(F.regexp_extract(F.btrim(v["rest"], F.lit(_BLANK)), r"\|(\d+)\|\)?$", 1).try_cast("int"))
    return rows.select(
        "flow_id", last("USER").alias("username"), last("PASS").alias("password"), F.transform(of("RETR", "STOR", "STOU", "APPE"), lambda v: v["rest"]).alias("files"), F.exists("x", lambda v: (v["word"] == "AUTH") & F.upper(v["rest"]).isin("TLS", "SSL")).alias("auth_tls"),
        F.exists("x", lambda v: v["word"].isin("PASV", "EPSV")).alias("passive"), F.array_compact(F.transform(of("227", "PORT", "229", "EPRT"), port)).alias("data_ports"), "bytes",
    )


def smtp_sessions(talk: DataFrame) -> DataFrame:
    """flow_id, helo, mail_from, rcpt_to, username, password, subject, body of mail clients, in built-in functions.

    What stands between a DATA line and a line with a dot alone (or the end) is mail, the rest are commands. Of signing
    in by PLAIN and by LOGIN the later one counts.
    """
    mail = r"(?is)(?:^|(?<=\n))DATA\r?\n(.*?)(?:(?:^|(?<=\n))\.\r?(?:\n|\z)|\z)"
    text = valid_text(F.col("client"))
    rows = talk.where(F.octet_length("client") > 0).select("flow_id", F.regexp_extract_all(text, F.lit(mail), F.lit(1)).alias("mails"), _lines(F.regexp_replace(text, mail, "").cast("binary")).alias("lines"))
    body = F.flatten(F.transform("mails", lambda m: _lines(m.cast("binary"))))
    named = lambda start: F.transform(F.filter("lines", lambda x: F.upper(x).startswith(start)), lambda x: F.btrim(F.substr(x, F.lit(len(start) + 1)), F.lit(_BLANK)))
    address = lambda start: F.transform(named(start), lambda x: F.btrim(x, F.lit("<>")))
    last = lambda array: F.try_element_at(array, F.lit(-1))
    greeted = F.transform(F.filter("lines", lambda x: F.upper(x).rlike("^(?:EHLO|HELO) ")), lambda x: F.btrim(F.substr(x, F.lit(6)), F.lit(_BLANK)))
    plain = lambda x: valid_text(F.try_to_binary(F.rpad(F.btrim(x), (F.ceil(F.char_length(F.btrim(x)) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")))
    spots = F.filter(F.transform("lines", lambda x, i: F.when(F.upper(x).startswith("AUTH PLAIN ") | (F.upper(x) == "AUTH LOGIN"), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumns({"body": body, "at": last(spots)})
    line = lambda k: F.try_element_at("lines", F.col("at") + k)
    login, secret = F.upper(line(0)) == "AUTH LOGIN", F.split(plain(F.substr(line(0), F.lit(12))), "\0")
    user = F.when(login, plain(line(1))).otherwise(F.try_element_at(secret, F.lit(2)))
    word = F.when(login, plain(line(2))).otherwise(F.try_element_at(secret, F.lit(3)))
    subject = F.try_element_at(F.filter("body", lambda x: F.upper(x).startswith("SUBJECT:")), F.lit(1))
    return rows.select("flow_id", last(greeted).alias("helo"), last(address("MAIL FROM:")).alias("mail_from"), address("RCPT TO:").alias("rcpt_to"), user.alias("username"), word.alias("password"), F.btrim(F.substr(subject, F.lit(9)), F.lit(_BLANK)).alias("subject"), F.array_join("body", "\n").alias("body"))


def _number(data: Column, at: Column | int, size: int) -> Column:
    """A number of `size` bytes at a place (from 0) of binary data; null beyond its end."""
    part = F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def ssh_sessions(talk: DataFrame) -> DataFrame:
    """flow_id, banners, software, and the name lists of the key exchange (kex, ciphers, macs), in built-in functions."""
    first = lambda side: valid_text(F.encode(F.rtrim(F.substring_index(F.decode(F.coalesce(F.col(side), F.lit(b"")), "ISO-8859-1"), "\n", 1), F.lit("\r")), "ISO-8859-1"))
    banner = lambda side: F.when(first(side).rlike("^SSH-[^-]*-"), first(side))
    software = lambda side: F.regexp_extract(F.col(f"{side}_banner"), r"^SSH-[^-]*-\s*(\S*)", 1)

    def offer(side: str) -> Column:
        data = F.coalesce(F.col(side), F.lit(b""))
        start = F.locate("\n", F.decode(data, "ISO-8859-1"))
        zero = F.struct((start + 22).cast("long").alias("at"), F.array().cast("array<array<string>>").alias("lists"))

        def step(state: Column, _: Column) -> Column:
            size = _number(data, state["at"], 4)
            whole = size.isNotNull() & (state["at"] + 4 + size <= F.octet_length(data))
            names = F.split(valid_text(F.substring(data, (state["at"] + 5).cast("int"), size.cast("int"))), ",")
            names = F.when(size > 0, names).otherwise(F.array().cast("array<string>"))
            return F.when(whole, F.struct((state["at"] + 4 + size).alias("at"), F.concat(state["lists"], F.array(names)).alias("lists"))).otherwise(F.struct(F.lit(1 << 30).cast("long").alias("at"), state["lists"].alias("lists")))

        lists = F.aggregate(F.sequence(F.lit(1), F.lit(10)), zero, step, lambda x: x["lists"])
        return F.when(_number(data, start + 5, 1) == 20, lists).otherwise(F.array().cast("array<array<string>>"))

    rows = talk.select("flow_id", banner("client").alias("client_banner"), banner("server").alias("server_banner"), offer("client").alias("c"), offer("server").alias("s")).where("client_banner is not null or server_banner is not null")
    rows = rows.withColumn("x", F.when(F.size("c") > 0, F.col("c")).otherwise(F.col("s")))
    some = lambda k: F.coalesce(F.try_element_at("x", F.lit(k + 1)), F.array().cast("array<string>"))
    return rows.select("flow_id", "client_banner", "server_banner", software("client").alias("client_software"), software("server").alias("server_software"), some(0).alias("kex"), some(2).alias("ciphers"), some(4).alias("macs"))


def telnet_sessions(segments: DataFrame) -> DataFrame:
    """segments: flow_id and parts, an array of struct(server, data) in order of time."""
    return _rows(segments, ["parts"], TELNET_SCHEMA, lambda parts: telnet_session([(bool(x["server"]), x["data"] or b"") for x in parts or []]))


#: Kinds of DHCP messages by number (fixed values).
DHCP_KINDS = {1: "Discover", 2: "Offer", 3: "Request", 4: "Decline", 5: "Ack", 6: "Nak", 7: "Release", 8: "Inform"}


def dhcp_leases(segments: DataFrame) -> DataFrame:
    """flow_id, message, mac, address, hostname, router, dns, domain, lease, server of DHCP messages, in built-in functions.

    Options are walked by their lengths; of an option that comes again the last one counts that has a fitting length.
    """
    more, data = [c for c in ("ts", "forward") if c in segments.columns], F.col("data")
    rows = segments.where((F.octet_length("data") >= 240) & (F.hex(F.substring("data", 237, 4)) == "63825363"))
    zero = F.struct(F.lit(240).cast("long").alias("at"), F.array().cast("array<struct<code:bigint,body:binary>>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        at, end = state["at"], F.struct(F.lit(1 << 30).cast("long").alias("at"), state["found"].alias("found"))
        one = lambda k: F.substring(data, (at + k).cast("int"), F.lit(1))
        code, size = _number(data, at, 1), _number(data, at + 1, 1)
        body = F.substring(data, (at + 3).cast("int"), size.cast("int"))
        told = F.struct((at + 2 + F.octet_length(body)).alias("at"), F.concat(state["found"], F.array(F.struct(code.alias("code"), body.alias("body")))).alias("found"))
        pad = F.struct((at + 1).alias("at"), state["found"].alias("found"))
        return F.when(at + 1 >= F.octet_length(data), state).when(one(1) == b"\x00", pad).when(one(1) == b"\xff", end).otherwise(told)

    # An option takes two bytes at least; a byte of padding takes a step of its own. Behind the end a step only looks at its place.
    options = F.aggregate(F.sequence(F.lit(1), F.octet_length("data") - 239), zero, step, lambda x: x["found"])
    rows = rows.select("flow_id", *more, "data", options.alias("x"))
    of = lambda code, fits=lambda b: F.lit(True): F.try_element_at(F.filter("x", lambda v: (v["code"] == code) & fits(v["body"])), F.lit(-1))["body"]
    ip = lambda b: F.when(F.octet_length(b) == 4, F.concat_ws(".", *[_number(b, k, 1).cast("string") for k in range(4)]))
    kind = _number(of(53, lambda b: F.octet_length(b) > 0), 0, 1)
    names = F.create_map(*[F.lit(v) for kv in DHCP_KINDS.items() for v in (int(kv[0]), kv[1])])
    message = F.coalesce(F.try_element_at(names, kind.cast("int")), F.concat(F.lit("Type"), kind.cast("string")))
    mac = F.when(_number(data, 2, 1) == 6, F.concat_ws(":", *[F.lower(F.hex(F.substring("data", 29 + k, 1))) for k in range(6)]))
    servers = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(of(6)) / 4) - 1), lambda k: ip(F.substring(of(6), (k * 4 + 1).cast("int"), F.lit(4))))
    servers = F.when(F.octet_length(of(6)) >= 4, servers).otherwise(F.array().cast("array<string>"))
    lease = _number(of(51, lambda b: F.octet_length(b) == 4), 0, 4)
    return rows.select("flow_id", *more, message.alias("message"), mac.alias("mac"), ip(F.substring("data", 17, 4)).alias("address"), valid_text(of(12)).alias("hostname"), ip(F.substring(of(3), 1, 4)).alias("router"), servers.alias("dns"), valid_text(of(15)).alias("domain"), lease.alias("lease"), ip(F.substring(of(54), 1, 4)).alias("server"))


def smb_sessions(talk: DataFrame) -> DataFrame:
    """Both directions, the client's first; commands count once."""
    return _rows(talk, ["client", "server"], SMB_SCHEMA, lambda c, s: [x] if (x := smb((c or b"") + (s or b""))) else [])


def icmp_messages(segments: DataFrame) -> DataFrame:
    """flow_id, type, code, name, payload of ICMP data of at least four bytes (header included), in built-in functions."""
    byte = lambda k: F.conv(F.hex(F.substring("data", k, 1)), 16, 10).cast("int")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ICMP_TYPES.items() for x in kv]), byte(1)), F.concat(F.lit("Type "), byte(1).cast("string")))
    payload = F.when(F.octet_length("data") > 8, F.expr("substring(data, 9)")).otherwise(F.expr("substring(data, 5)"))
    more = ["ts"] if "ts" in segments.columns else []
    return segments.where(F.octet_length("data") >= 4).select("flow_id", byte(1).alias("type"), byte(2).alias("code"), kind.alias("name"), payload.alias("payload"), *more)


def http_bodies(talk: DataFrame) -> DataFrame:
    """The bodies of responses, with their transaction's ordinal, URI and declared type."""
    keep = ("ordinal", "uri", "content_type", "body")
    return _rows(talk, ["client", "server"], BODY_SCHEMA, lambda c, s: [{k: x[k] for k in keep} for x in http(c or b"", s or b"", True) if x["body"]])
