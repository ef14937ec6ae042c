"""ZIP packages as parts: taken apart and put together byte for byte, and patched without touching other entries.

A package is the run of its local records in file order plus the tail (central directory and end record). Each record
is a header, data and a trailer (whatever lies between the data and the next record). Every slice is hashed, so equal
slices of snapshots are stored once. Only the standard library is used.

Defined cases: what is no ZIP, or has records that overlap or leave the file, is one opaque part; empty bytes are one
empty part; duplicate entry names are kept in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"


@dataclass(frozen=True)
class Entry:
    name: str
    offset: int
    header: bytes
    data: bytes
    trailer: bytes
    method: int
    crc32: int
    compressed_size: int
    uncompressed_size: int
    central: bytes

    def content(self) -> bytes:
        if self.method == 0:
            return self.data
        if self.method == 8:
            return zlib.decompress(self.data, -15)
        raise ValueError(f"compression {self.method}")


def _directory(blob: bytes) -> tuple[int, int]:
    """(offset, entries) of the central directory."""
    at = blob.rfind(END, max(0, len(blob) - 65_557))
    if at < 0:
        raise ValueError("no end record")
    count, _, offset = struct.unpack_from("<HII", blob, at + 10)
    if offset == 0xFFFFFFFF or count == 0xFFFF:
        locator = at - 20
        if blob[locator : locator + 4] != b"PK\x06\x07":
            raise ValueError("no 64-bit end record")
        at64 = struct.unpack_from("<Q", blob, locator + 8)[0]
        count, _, offset = struct.unpack_from("<QQQ", blob, at64 + 32)
    return offset, count


def entries(blob: bytes) -> tuple[list[Entry], bytes]:
    """The entries in file order, and the tail."""
    try:
        offset, count = _directory(blob)
        found, pos = [], offset
        for _ in range(count):
            if blob[pos : pos + 4] != CENTRAL:
                raise ValueError("central record")
            flags, method = struct.unpack_from("<HH", blob, pos + 8)
            crc, csize, usize, n, m, k = struct.unpack_from("<IIIHHH", blob, pos + 16)
            local = struct.unpack_from("<I", blob, pos + 42)[0]
            raw = blob[pos + 46 : pos + 46 + n]
            extra = blob[pos + 46 + n : pos + 46 + n + m]
            at = 0
            while at + 4 <= len(extra):
                tag, size = struct.unpack_from("<HH", extra, at)
                if tag == 1:
                    values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                    usize = values.pop(0) if usize == 0xFFFFFFFF else usize
                    csize = values.pop(0) if csize == 0xFFFFFFFF else csize
                    local = values.pop(0) if local == 0xFFFFFFFF else local
                at += 4 + size
            size = 46 + n + m + k
            found.append((local, raw.decode("utf-8" if flags & 0x800 else "cp437"), method, crc, csize, usize, blob[pos : pos + size]))
            pos += size
        found.sort(key=lambda e: e[0])
        out: list[Entry] = []
        bounds = [f[0] for f in found[1:]] + [offset]
        if found and found[0][0] != 0:
            raise ValueError("bytes before the first record")
        for (local, name, method, crc, csize, usize, central), end in zip(found, bounds):
            if blob[local : local + 4] != LOCAL:
                raise ValueError("local record")
            n, m = struct.unpack_from("<HH", blob, local + 26)
            start = local + 30 + n + m
            if start + csize > end:
                raise ValueError("records overlap")
            out.append(Entry(name, local, blob[local:start], blob[start : start + csize], blob[start + csize : end], method, crc, csize, usize, central))
        return out, blob[offset:]
    except (struct.error, IndexError, UnicodeDecodeError) as error:
        raise ValueError("no package") from error


def digest(part: bytes) -> str:
    return hashlib.sha256(part).hexdigest()


def explode(blob: bytes) -> list[tuple[int, str, str, bytes]]:
    """(position, name, slice, bytes) of all slices, in an order that gives the package when joined."""
    try:
        listed, tail = entries(blob)
    except ValueError:
        return [(0, "", "whole", blob)]
    out = []
    for e in listed:
        for kind, part in (("header", e.header), ("data", e.data), ("trailer", e.trailer)):
            out.append((len(out), e.name, kind, part))
    out.append((len(out), "", "tail", tail))
    return out


def implode(parts: list[bytes], expected: str | None = None) -> bytes:
    blob = b"".join(parts)
    if expected is not None and digest(blob) != expected:
        raise ValueError("parts do not give the package they were taken from")
    return blob


def splice(blob: bytes, changes: dict[str, bytes | None]) -> bytes:
    """The package with some entries replaced, added (unknown names) or removed (None); all others are copied as they are."""
    listed, tail = entries(blob)
    offset = _directory(blob)[0]
    end_at = tail.rfind(END)
    comment = tail[end_at + 20 :] if end_at >= 0 else b"\0\0"
    body, directory, count = bytearray(), bytearray(), 0
    todo = dict(changes)
    for e in listed:
        if e.name in todo:
            new = todo.pop(e.name)
            if new is None:
                continue
            local, central = _record(e.name, new, e)
        else:
            local, central = e.header + e.data + e.trailer, e.central
        central = bytearray(central)
        struct.pack_into("<I", central, 42, len(body))
        directory += central
        body += local
        count += 1
    for name, new in todo.items():
        if new is not None:
            local, central = _record(name, new, None)
            central = bytearray(central)
            struct.pack_into("<I", central, 42, len(body))
            directory += central
            body += local
            count += 1
    del offset
    return bytes(body + directory + struct.pack("<4sHHHHII", END, 0, 0, count, count, len(directory), len(body)) + comment)


def _record(name: str, content: bytes, old: Entry | None) -> tuple[bytes, bytes]:
    """A local and a central record for new content; time and attributes are those of the entry it replaces."""
    stored = old is not None and old.method == 0
    squeezed = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = content if stored else squeezed.compress(content) + squeezed.flush()
    raw = name.encode()
    flags = 0 if name.isascii() else 0x800
    clock = struct.unpack_from("<HH", old.central, 12) if old else (0, 0x21)
    inner, outer = struct.unpack_from("<HI", old.central, 36) if old else (0, 0)
    common = struct.pack("<HHHHIIIH", flags, 0 if stored else 8, *clock, zlib.crc32(content), len(data), len(content), len(raw))
    local = LOCAL + struct.pack("<H", 20) + common + struct.pack("<H", 0) + raw + data
    central = CENTRAL + struct.pack("<HH", 20, 20) + common + struct.pack("<HHHHII", 0, 0, 0, inner, outer, 0) + raw
    return local, central


PARTS = "object_path string, package_hash string, pos int, name string, slice string, part_hash string, size bigint, part binary"


def explode_packages(files: DataFrame, path: str, content: str) -> DataFrame:
    """Every slice of every package with its hash; ``dropDuplicates`` on the hash is what has to be stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, blob in frame.itertuples(index=False, name=None):
                whole = digest(bytes(blob))
                yield pd.DataFrame([(p, whole, k, n, s, digest(b), len(b), b) for k, n, s, b in explode(bytes(blob))], columns=[c.split()[0] for c in PARTS.split(", ")])

    return files.where(F.col(content).isNotNull()).select(path, content).mapInPandas(run, PARTS)


def snapshot_tables(slices: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, parts to store): parts are stored once, and not again if they are known."""
    manifest = slices.select("object_path", "package_hash", "pos", "name", "slice", "part_hash", "size")
    parts = slices.select("part_hash", "part").dropDuplicates(["part_hash"])
    return manifest, parts if known is None else parts.join(known.select("part_hash"), "part_hash", "left_anti")


def dedupe_report(parts: DataFrame) -> DataFrame:
    """One row (parts, stored_bytes, full_bytes) over (part_hash, size): what is stored once, and what all copies would take."""
    once = parts.groupBy("part_hash").agg(F.max("size").alias("b"), F.count(F.lit(1)).alias("n"))
    return once.agg(F.count(F.lit(1)).alias("parts"), F.sum("b").alias("stored_bytes"), F.sum(F.col("n") * F.col("b")).alias("full_bytes"))


def implode_packages(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """(object_path, package_hash, content, intact): packages put together from stored parts and verified by their hash."""
    whole = manifest.join(parts, "part_hash").groupBy("object_path", "package_hash").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("part").alias("part")))).alias("p"))
    content = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["part"])), ""))
    return whole.select("object_path", "package_hash", content.alias("content")).withColumn("intact", F.sha2("content", 256) == F.col("package_hash"))
