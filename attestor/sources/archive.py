"""Members of a ZIP archive, read by byte ranges.

The directory at the end of the archive is read first, when the scan is planned.
Partitions are runs of neighbouring members of about ``rangeBytes``; a task reads
its range alone, in one request, and checks each member's size and CRC-32.  The
archive lies wherever pyarrow's file systems reach: a shared folder, HDFS, an
object store.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from attestor.session import ship

#: Requests for a range before a scan fails, the longest wait between two (seconds), and bytes of a range unless an option says otherwise.
ATTEMPTS, LONGEST_WAIT, RANGE = 5, 30.0, 32 << 20
LOCAL_HEADER = struct.Struct("<4s5H3I2H")


@dataclass
class Part(InputPartition):
    start: int
    stop: int
    members: list


def opened(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    return files.open_input_file(at)


def fetched(path: str, start: int, stop: int, read=None, wait=time.sleep) -> bytes:
    """The bytes of a range; requests that fail or fall short are repeated, each after a longer wait."""
    for attempt in range(ATTEMPTS):
        try:
            if read is not None:
                raw = read(start, stop)
            else:
                with opened(path) as f:
                    f.seek(start)
                    raw = f.read(stop - start)
            if len(raw) != stop - start:
                raise OSError(f"{len(raw)} of {stop - start} bytes")
            return bytes(raw)
        except OSError as e:
            if attempt + 1 == ATTEMPTS:
                raise RuntimeError(f"bytes {start} to {stop} of {path}: {e}, after {ATTEMPTS} attempts") from e
            wait(min(2.0**attempt, LONGEST_WAIT))


def unpacked(raw: bytes, method: int, packed: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
    """(content, None) of a member from its local header on, or (None, what is wrong with it)."""
    if len(raw) < LOCAL_HEADER.size:
        return None, "cut off"
    header = LOCAL_HEADER.unpack(raw[: LOCAL_HEADER.size])
    if header[0] != b"PK\x03\x04":
        return None, "no local header"
    at = LOCAL_HEADER.size + header[-2] + header[-1]
    body = raw[at : at + packed]
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, f"compression {method}"
    try:
        content = zlib.decompress(body, -15) if method == zipfile.ZIP_DEFLATED else body
    except zlib.error:
        return None, "cannot be inflated"
    if len(content) != size:
        return None, "wrong size"
    return (content, None) if zlib.crc32(content) == crc else (None, "wrong checksum")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))
        self.prefix, self.suffix = options.get("prefix", ""), options.get("suffix", "")

    def partitions(self):
        with opened(self.path) as f:
            with zipfile.ZipFile(f) as z:
                infos = sorted(z.infolist(), key=lambda i: i.header_offset)
                end = z.start_dir
        stops = [i.header_offset for i in infos[1:]] + [end]
        out: list[Part] = []
        for i, stop in zip(infos, stops):
            if i.is_dir() or not (i.filename.startswith(self.prefix) and i.filename.endswith(self.suffix)):
                continue
            member = (i.filename, i.header_offset, stop, i.compress_type, i.compress_size, i.file_size, i.CRC)
            if out and stop - out[-1].start <= self.range:
                out[-1].stop = stop
                out[-1].members.append(member)
            else:
                out.append(Part(i.header_offset, stop, [member]))
        return out or [Part(0, 0, [])]

    def read(self, part):
        raw = fetched(self.path, part.start, part.stop) if part.members else b""
        for name, start, stop, method, packed, size, crc in part.members:
            content, problem = unpacked(raw[start - part.start : stop - part.start], method, packed, size, crc)
            yield name, size, problem, content


class ZipMembers(DataSource):
    """Source ``zip_members``: options path (a URI), prefix, suffix, rangeBytes."""

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "name string, size long, problem string, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def zip_members(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """name, size, problem and content of each member; a damaged one has a problem and no content, and stops no other."""
    ship(spark)
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("path", path).option("prefix", prefix).option("suffix", suffix).option("rangeBytes", str(range_bytes)).load()
