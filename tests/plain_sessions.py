"""FTP, SMTP, SSH and DHCP one line, message and option at a time: what the DataFrame operators are held against."""

import base64
import ipaddress
import re
import struct


def _text(data):
    return data.decode("utf-8", "replace")


def ftp(lines: list[str]) -> dict:
    out = {"username": None, "password": None, "files": [], "auth_tls": False, "passive": False, "data_ports": []}
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        word = word.upper()
        if word == "USER":
            out["username"] = rest
        elif word == "PASS":
            out["password"] = rest
        elif word in ("RETR", "STOR", "STOU", "APPE"):
            out["files"].append(rest)
        elif word == "AUTH" and rest.upper() in ("TLS", "SSL"):
            out["auth_tls"] = True
        elif word in ("PASV", "EPSV"):
            out["passive"] = True
        if (word in ("227", "PORT")) and (m := re.search(r"(\d+),(\d+),(\d+),(\d+),(\d+),(\d+)", rest)):
            out["data_ports"].append(int(m[5]) * 256 + int(m[6]))
        elif word in ("229", "EPRT") and (m := re.search(r"\|(\d+)\|\)?$", rest.strip())):
            out["data_ports"].append(int(m[1]))
    return out


def smtp(lines: list[str]) -> dict:
    out = {"helo": None, "mail_from": None, "rcpt_to": [], "username": None, "password": None, "subject": None, "body": ""}
    body, login, in_data = [], 0, False
    plain = lambda x: _text(base64.b64decode(x + "=" * (-len(x) % 4), validate=False))
    for raw in lines:
        line = raw.rstrip("\r\n")
        up = line.upper()
        try:
            if in_data:
                if line == ".":
                    in_data = False
                else:
                    body.append(line)
                    if up.startswith("SUBJECT:") and out["subject"] is None:
                        out["subject"] = line[8:].strip()
            elif login:
                out["username" if login == 1 else "password"] = plain(line)
                login = (login + 1) % 3
            elif up.startswith(("EHLO ", "HELO ")):
                out["helo"] = line[5:].strip()
            elif up.startswith("MAIL FROM:"):
                out["mail_from"] = line[10:].strip().strip("<>")
            elif up.startswith("RCPT TO:"):
                out["rcpt_to"].append(line[8:].strip().strip("<>"))
            elif up == "AUTH LOGIN":
                login = 1
            elif up.startswith("AUTH PLAIN "):
                _, out["username"], out["password"] = (plain(line[11:].strip()).split("\0") + ["", "", ""])[:3]
            elif up == "DATA":
                in_data = True
        except ValueError:
            login = 0
    return out | {"body": "\n".join(body)}


def ssh_banner(data: bytes) -> dict | None:
    line = data.split(b"\n", 1)[0].rstrip(b"\r")
    parts = _text(line).split("-", 2)
    return {"banner": _text(line), "protocol": parts[1], "software": (parts[2].split() or [""])[0]} if line.startswith(b"SSH-") and len(parts) == 3 else None


def ssh_offer(data: bytes) -> list[list[str]]:
    """The name lists of the key exchange message that follows the banner; none if there is none."""
    at = data.find(b"\n") + 1
    if data[at + 5 : at + 6] != b"\x14":
        return []
    at, out = at + 22, []  # length, padding, kind and cookie
    while len(out) < 10 and at + 4 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            break
        out.append(_text(data[at + 4 : at + 4 + n]).split(",") if n else [])
        at += 4 + n
    return out


def ssh(client: bytes, server: bytes) -> list[dict]:
    a, b = ssh_banner(client), ssh_banner(server)
    if not a and not b:
        return []
    offer = ssh_offer(client) or ssh_offer(server)
    some = lambda k: offer[k] if len(offer) > k else []
    return [{"client_banner": a and a["banner"], "server_banner": b and b["banner"], "client_software": a and a["software"], "server_software": b and b["software"], "kex": some(0), "ciphers": some(2), "macs": some(4)}]


def dhcp(data: bytes) -> dict | None:
    if len(data) < 240 or data[236:240] != b"\x63\x82\x53\x63":
        return None
    kinds = {1: "Discover", 2: "Offer", 3: "Request", 4: "Decline", 5: "Ack", 6: "Nak", 7: "Release", 8: "Inform"}
    ip = lambda x: str(ipaddress.IPv4Address(x)) if len(x) == 4 else None
    out = {"message": None, "mac": ":".join(f"{x:02x}" for x in data[28:34]) if data[2] == 6 else None, "address": ip(data[16:20]), "hostname": None, "router": None, "dns": [], "domain": None, "lease": None, "server": None}
    at = 240
    while at < len(data) and data[at] != 255:
        if data[at] == 0:
            at += 1
            continue
        if at + 1 >= len(data):
            break
        code, body = data[at], data[at + 2 : at + 2 + data[at + 1]]
        if code == 53 and body:
            out["message"] = kinds.get(body[0], f"Type{body[0]}")
        elif code == 3:
            out["router"] = ip(body[:4])
        elif code == 6:
            out["dns"] = [ip(body[k : k + 4]) for k in range(0, len(body) // 4 * 4, 4)]
        elif code in (12, 15):
            out["hostname" if code == 12 else "domain"] = _text(body)
        elif code == 51 and len(body) == 4:
            out["lease"] = struct.unpack(">I", body)[0]
        elif code == 54:
            out["server"] = ip(body[:4])
        at += 2 + len(body)
    return out
