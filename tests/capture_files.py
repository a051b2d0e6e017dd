"""Byte-exact capture files for the decoder tests."""

from __future__ import annotations

import ipaddress
import struct

ETHERNET, RAW, SLL, SLL2, NULL = 1, 101, 113, 276, 0


def tcp(sport, dport, payload=b"", options=b""):
    offset = (20 + len(options)) // 4
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 2, offset << 4, 0x18, 1000, 0, 0) + options + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ipv4(src, dst, proto, body, fragment=0, options=b"", total=None):
    size = 20 + len(options) + len(body) if total is None else total
    head = struct.pack(
        ">BBHHHBBH4s4s",
        0x40 | (5 + len(options) // 4),
        0,
        size,
        7,
        fragment,
        64,
        proto,
        0,
        ipaddress.ip_address(src).packed,
        ipaddress.ip_address(dst).packed,
    )
    return head + options + body


def ipv6(src, dst, proto, body):
    addresses = ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed
    return struct.pack(">IHBB", 6 << 28, len(body), proto, 64) + addresses + body


def link_frame(kind, packet, ethertype=None):
    six = bool(packet) and packet[0] >> 4 == 6
    kind_of = ethertype if ethertype is not None else (0x86DD if six else 0x0800)
    tag = struct.pack(">H", kind_of)
    if kind == ETHERNET:
        return b"\x02" * 12 + tag + packet
    if kind == SLL:
        return b"\x00" * 14 + tag + packet
    if kind == SLL2:
        return tag + b"\x00" * 18 + packet
    if kind == NULL:
        return struct.pack("<I", 30 if six else 2) + packet
    return packet


def vlan_frame(packet):
    return b"\x02" * 12 + b"\x81\x00\x00\x05" + b"\x08\x00" + packet


def pcap(frames, link=ETHERNET, endian="<", nano=False, start=1000, step=0.25):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = [struct.pack(endian + "IHHiIII", magic, 2, 4, 0, 0, 262144, link)]
    scale = 1_000_000_000 if nano else 1_000_000
    for i, frame in enumerate(frames):
        at = start + i * step
        out.append(struct.pack(endian + "IIII", int(at), int((at % 1) * scale), len(frame), len(frame)) + frame)
    return b"".join(out)


def _block(endian, kind, body):
    size = 12 + len(body)
    return struct.pack(endian + "II", kind, size) + body + struct.pack(endian + "I", size)


def pcapng(frames, link=ETHERNET, endian="<", start=1000, step=0.25, nano=False):
    out = [_block(endian, 0x0A0D0D0A, struct.pack(endian + "IHHq", 0x1A2B3C4D, 1, 0, -1))]
    options = struct.pack(endian + "HHBxxx", 9, 1, 9) + struct.pack(endian + "HH", 0, 0) if nano else b""
    out.append(_block(endian, 1, struct.pack(endian + "HHI", link, 0, 262144) + options))
    scale = 1_000_000_000 if nano else 1_000_000
    for i, frame in enumerate(frames):
        ticks = int((start + i * step) * scale)
        pad = b"\x00" * (-len(frame) % 4)
        head = struct.pack(endian + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame))
        out.append(_block(endian, 6, head + frame + pad))
    return b"".join(out)
