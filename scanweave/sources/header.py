"""Header of an image container: a bounds-checked walk over its attributes (a small helper of the source)."""

from __future__ import annotations

import struct

MAGIC = 20000630
MULTIPART = 0x10
#: Flag bits of files that hold tiles or deep data, which are not read: single tile, deep.
TILED, DEEP = 0x02, 0x08


class ExrError(Exception):
    """A typed failure: code, message and details."""

    def __init__(self, code: str, message: str, **details: object):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, {k: str(v) for k, v in details.items()}


class Cursor:
    """Little-endian reads within bounds."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def need(self, n: int, what: str) -> None:
        if self.at + n > len(self.data):
            raise ExrError("TRUNCATED_FILE", f"{what} runs past the end", offset=self.at, bytes=n)

    def read(self, form: str, what: str) -> int | float:
        self.need(struct.calcsize(form), what)
        (value,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def name(self, what: str, end: int | None = None) -> str:
        """Text up to a zero byte; each byte is a character."""
        stop = self.data.find(b"\0", self.at, end)
        if stop < 0:
            raise ExrError("TRUNCATED_FILE" if end is None else "MALFORMED_HEADER", f"{what} is not terminated", offset=self.at)
        out = self.data[self.at : stop].decode("latin-1")
        self.at = stop + 1
        return out


def _channels(c: Cursor, end: int) -> list[dict]:
    out: list[dict] = []
    while c.at < end:
        name = c.name("channel name", end)
        if not name:
            if c.at != end:
                raise ExrError("MALFORMED_HEADER", "bytes after the channel list", offset=c.at)
            return out
        if c.at + 16 > end:
            raise ExrError("MALFORMED_HEADER", f"channel {name} is cut short", channel=name)
        kind, linear, xs, ys = struct.unpack_from("<iB3xii", c.data, c.at)
        c.at += 16
        out.append({"name": name, "pixel_type": kind, "p_linear": linear, "x_sampling": xs, "y_sampling": ys})
    raise ExrError("MALFORMED_HEADER", "the channel list has no end")


_SIZES = {"compression": 1, "box2i": 16, "int": 4, "float": 4}


def _value(kind: str, raw: bytes) -> dict:
    empty = {"type": kind, "i": None, "f": None, "s": None, "box": None}
    if kind == "compression":
        return empty | {"i": raw[0]}
    if kind == "int":
        return empty | {"i": struct.unpack("<i", raw)[0]}
    if kind == "float":
        return empty | {"f": struct.unpack("<f", raw)[0]}
    if kind == "box2i":
        return empty | {"box": dict(zip(("x_min", "y_min", "x_max", "y_max"), struct.unpack("<4i", raw), strict=True))}
    if kind == "string":
        return empty | {"s": raw.split(b"\0", 1)[0].decode("latin-1")}
    return empty | {"s": f"<{kind} data>"}


def _part(c: Cursor, number: int) -> dict:
    attributes: dict[str, dict] = {}
    channels: list[dict] = []
    while c.at < len(c.data):
        name = c.name("attribute name")
        if not name:
            break
        kind, size = c.name("attribute type"), c.read("i", "attribute size")
        if size < 0:
            raise ExrError("MALFORMED_HEADER", f"{name} has a negative size", attribute=name)
        c.need(size, f"attribute {name}")
        if size != _SIZES.get(kind, size):
            raise ExrError("MALFORMED_HEADER", f"{name} of type {kind} must have {_SIZES[kind]} bytes", attribute=name, size=size)
        end = c.at + size
        if kind == "chlist":
            channels += _channels(c, end)
            attributes[name] = _value("string", b"") | {"type": kind, "s": f"({len(channels)} channels)"}
        else:
            attributes[name] = _value(kind, c.data[c.at : end])
        c.at = end
    box = lambda k: attributes.get(k, {}).get("box")
    text = attributes.get("type", {}).get("s")
    return {"part_id": number, "type": text, "compression": attributes.get("compression", {}).get("i"), "data_window": box("dataWindow"), "display_window": box("displayWindow"), "attributes": attributes, "channels": channels}


def parse(data: bytes) -> dict:
    """Version, flags, parts and the end of the header; raises ExrError."""
    if len(data) < 8:
        raise ExrError("BUFFER_TOO_SMALL", "a file has 8 bytes at least", bytes=len(data))
    magic, version = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ExrError("INVALID_MAGIC", "not an image container", magic=magic)
    flags, c, parts = version >> 8, Cursor(data, 8), []
    multipart = bool(flags & MULTIPART)
    while True:
        if multipart:
            c.need(1, "part header")
        if c.at < len(data) and data[c.at] == 0:
            c.at += 1
            break
        parts.append(_part(c, len(parts)))
        if not multipart:
            break
    if not parts or not parts[0]["attributes"]:
        raise ExrError("MALFORMED_HEADER", "no parts")
    return {"magic": magic, "version": version & 0xFF, "flags": flags, "is_multipart": multipart, "header_end": c.at, "parts": parts}
