"""Models in checksummed envelopes: JSON, MessagePack, and a Parquet folder for models that hold tables."""

from __future__ import annotations

import base64
import dataclasses
import importlib
import json
import struct
import zlib
from dataclasses import dataclass
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession

VERSION = "0.1.0"


@dataclass(frozen=True)
class Envelope:
    format: str
    type: str
    version: str
    checksum: int
    data: bytes


class ChecksumError(ValueError):
    """The data are not those that were saved."""


def checksum(data: bytes) -> int:
    return zlib.crc32(data)


def verify(envelope: Envelope) -> None:
    if checksum(envelope.data) != envelope.checksum:
        raise ChecksumError("checksum mismatch")


def _type(model: Any) -> str:
    return f"{type(model).__module__}.{type(model).__qualname__}"


def to_state(value: Any) -> Any:
    """Plain lists, numbers, strings and maps; dataclasses keep their type. NaN and infinities are named."""
    if dataclasses.is_dataclass(value):
        return {"$type": _type(value), "fields": {f.name: to_state(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    if isinstance(value, tuple):
        return {"$tuple": [to_state(v) for v in value]}
    if isinstance(value, list):
        return [to_state(v) for v in value]
    if isinstance(value, dict):
        return {"$map": [[to_state(k), to_state(v)] for k, v in value.items()]}
    if isinstance(value, (bool, int, str, type(None))):
        return value
    if isinstance(value, (bytes, bytearray)):
        return {"$bytes": base64.b64encode(value).decode()}
    value = float(value)
    return value if value - value == 0 else {"$float": repr(value)}


def from_state(state: Any) -> Any:
    if isinstance(state, list):
        return [from_state(v) for v in state]
    if not isinstance(state, dict):
        return state
    if "$tuple" in state:
        return tuple(from_state(v) for v in state["$tuple"])
    if "$map" in state:
        return {from_state(k): from_state(v) for k, v in state["$map"]}
    if "$bytes" in state:
        return base64.b64decode(state["$bytes"])
    if "$float" in state:
        return float(state["$float"])
    module, _, name = state["$type"].rpartition(".")
    kind = getattr(importlib.import_module(module), name)
    if not dataclasses.is_dataclass(kind):
        raise ValueError(f"{state['$type']} is not a model")
    out = object.__new__(kind)
    for k, v in state["fields"].items():
        object.__setattr__(out, k, from_state(v))
    return out


def save_json(out: IO[str], model: Any) -> None:
    data = json.dumps(to_state(model)).encode()
    json.dump({"format": "json", "type": _type(model), "version": VERSION, "checksum": checksum(data), "data": base64.b64encode(data).decode()}, out)


def load_json(source: IO[str]) -> Any:
    e = json.load(source)
    envelope = Envelope(e["format"], e["type"], e["version"], e["checksum"], base64.b64decode(e["data"]))
    verify(envelope)
    return from_state(json.loads(envelope.data))


def save_json_file(path: str, model: Any) -> None:
    with open(path, "w") as f:
        save_json(f, model)


def load_json_file(path: str) -> Any:
    with open(path) as f:
        return load_json(f)


def pack(value: Any) -> bytes:
    """MessagePack of None, booleans, integers, floats, strings, bytes, lists and maps."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        return b"\xcf" + struct.pack(">Q", value) if value >= 0 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\xdb" + struct.pack(">I", len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(value)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return b"\xdd" + struct.pack(">I", len(value)) + b"".join(map(pack, value))
    if isinstance(value, dict):
        return b"\xdf" + struct.pack(">I", len(value)) + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise TypeError(type(value))


#: Fixed values of the format: markers with a length of so many bytes, and numbers by their struct codes.
_SIZED = {0xD9: ("s", 1), 0xDA: ("s", 2), 0xDB: ("s", 4), 0xC4: ("b", 1), 0xC5: ("b", 2), 0xC6: ("b", 4), 0xDC: ("l", 2), 0xDD: ("l", 4), 0xDE: ("m", 2), 0xDF: ("m", 4)}
_NUMBERS = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}


def unpack(raw: bytes) -> Any:
    value, end = _unpack(memoryview(raw), 0)
    if end != len(raw):
        raise ValueError("bytes after the value")
    return value


def _unpack(raw, at: int) -> tuple[Any, int]:
    m = raw[at]
    at += 1
    if m < 0x80:
        return m, at
    if m >= 0xE0:
        return m - 256, at
    if m in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[m], at
    if m in _NUMBERS:
        code = _NUMBERS[m]
        return struct.unpack_from(code, raw, at)[0], at + struct.calcsize(code)
    if m < 0x90:
        kind, n = "m", m & 15
    elif m < 0xA0:
        kind, n = "l", m & 15
    elif m < 0xC0:
        kind, n = "s", m & 31
    elif m in _SIZED:
        kind, size = _SIZED[m]
        n, at = int.from_bytes(raw[at : at + size], "big"), at + size
    else:
        raise ValueError(f"marker {m:#x}")
    if kind in "sb":
        part = bytes(raw[at : at + n])
        return (part.decode() if kind == "s" else part), at + n
    if kind == "l":
        out = []
        for _ in range(n):
            v, at = _unpack(raw, at)
            out.append(v)
        return out, at
    found = {}
    for _ in range(n):
        k, at = _unpack(raw, at)
        found[k], at = _unpack(raw, at)
    return found, at


def save_msgpack(out: IO[bytes], model: Any) -> None:
    data = pack(to_state(model))
    out.write(pack({"format": "msgpack", "type": _type(model), "version": VERSION, "checksum": checksum(data), "data": data}))


def load_msgpack(source: IO[bytes]) -> Any:
    e = unpack(source.read())
    envelope = Envelope(e["format"], e["type"], e["version"], e["checksum"], e["data"])
    verify(envelope)
    return from_state(unpack(envelope.data))


def save_msgpack_file(path: str, model: Any) -> None:
    with open(path, "wb") as f:
        save_msgpack(f, model)


def load_msgpack_file(path: str) -> Any:
    with open(path, "rb") as f:
        return load_msgpack(f)


_ENVELOPE = "format string, type string, version string, checksum bigint, data binary"


def save_native(spark: SparkSession, path: str, model: Any) -> None:
    """The library's binary form: a Parquet folder with the envelope, and one beside it for each table that the model holds."""
    tables = {f.name: getattr(model, f.name) for f in dataclasses.fields(model) if isinstance(getattr(model, f.name), DataFrame)}
    plain = {"type": _type(model), "tables": sorted(tables), "fields": {f.name: to_state(getattr(model, f.name)) for f in dataclasses.fields(model) if f.name not in tables}}
    data = pack(plain)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    spark.createDataFrame([("native", _type(model), VERSION, checksum(data), bytearray(data))], _ENVELOPE).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_native(spark: SparkSession, path: str) -> Any:
    r = spark.read.schema(_ENVELOPE).parquet(f"{path}/model").first()
    envelope = Envelope(r.format, r.type, r.version, r.checksum, bytes(r.data))
    verify(envelope)
    plain = unpack(envelope.data)
    out = from_state({"$type": plain["type"], "fields": plain["fields"]})
    for name in plain["tables"]:
        object.__setattr__(out, name, spark.read.parquet(f"{path}/tables/{name}"))
    return out
