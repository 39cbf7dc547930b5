"""Tar archives read in parts: a task reads ranges of archives, not an archive.

A first job scans headers alone, seeking over contents, a task an archive, and cuts each archive at member boundaries into
ranges of about `partition_bytes`; the driver sees names and sizes of archives only. The ranges are dealt to the tasks that
read: each opens the archive at a range's first byte and reads on to its last. Members are handed on as they come, so only
a batch of them has to fit into memory. With `content` off, contents are not read at all.

Archives may be compressed (.tar.gz). One is cut where a gzip member begins with a tar member's header, as `write_tars` packs
them; one that is a single gzip member is a single range.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.plans.shared import shipped

PARTITION_BYTES = 64 << 20
SCHEMA = "archive string, member string, offset long, size long"
#: There are as many reading tasks as ranges, but no more than so many a core, unless each has PARTITION_BYTES; a task reads several ranges then.
TASKS_A_CORE = 4
#: Archives are read through a buffer of so many bytes.
BUFFER = 1 << 16
#: A task hands on members in batches of about so many bytes.
BATCH_BYTES = 8 << 20
#: Names of compressed archives end so.
COMPRESSED = (".tar.gz", ".tgz")
#: A compressed archive is written in gzip members of about so many bytes before compression, each of whole tar members.
PACKED_BYTES = 1 << 20
#: Headers and contents take whole blocks of a tar, an archive whole records.
BLOCK, RECORD = tarfile.BLOCKSIZE, tarfile.RECORDSIZE


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def archives_below(path: str) -> list[str]:
    """The archive itself, or all *.tar, *.tar.gz and *.tgz files below a folder, in order."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = path[: len(path) - len(at)] if path.endswith(at) else path.split(":", 1)[0] + "://"
    return sorted(root + f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith((".tar", *COMPRESSED)))


class Unpacked(io.RawIOBase):
    """A compressed archive's content, of the gzip members that lie in [begin, end) of its file. Places are those in the whole content, where these begin at `start`.

    It reads forward only. Where each gzip member begins is noted in starts: its place in the content -> in the file.
    """

    def __init__(self, file, begin: int, end: int | None, start: int, starts: dict[int, int]) -> None:
        self.file, self.at, self.end, self.place, self.starts = file, begin, end, start, starts
        self.data, self.flate = b"", None
        file.seek(begin)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def more(self) -> bool:
        """Whether there are bytes not unpacked yet; reads on if none are held."""
        if not self.data:
            self.data = self.file.read(BUFFER if self.end is None else min(BUFFER, self.end - self.at))
            self.at += len(self.data)
        return bool(self.data)

    def readinto(self, out) -> int:
        while True:
            if self.flate is None:
                while self.more() and self.data[0] == 0:  # gzip members may be padded
                    self.data = self.data.lstrip(b"\0")
                if not self.data:
                    return 0
                self.starts[self.place] = self.at - len(self.data)
                self.flate = zlib.decompressobj(16 + zlib.MAX_WBITS)
            held = self.more()
            got = self.flate.decompress(self.data, len(out))
            self.data = self.flate.unconsumed_tail
            if self.flate.eof:
                self.data, self.flate = self.flate.unused_data, None
            elif not got and not held:
                raise tarfile.ReadError("a compressed archive ends too early")
            if got:
                out[: len(got)] = got
                self.place += len(got)
                return len(got)

    def seek(self, place: int, whence: int = io.SEEK_SET) -> int:
        if whence != io.SEEK_SET or place < self.place:
            raise io.UnsupportedOperation("compressed archives are read forward")
        skipped = memoryview(bytearray(BUFFER))
        while self.place < place and self.readinto(skipped[: place - self.place]):
            pass
        return self.place

    def close(self) -> None:
        self.file.close()
        super().close()


class Again:
    """A file of which `head`, read last, is to be read again, for tarfile."""

    def __init__(self, file) -> None:
        self.file, self.head = file, b""

    def tell(self) -> int:
        return self.file.tell() - len(self.head)

    def read(self, size: int = -1) -> bytes:
        out, self.head = (self.head, b"") if size < 0 else (self.head[:size], self.head[size:])
        return out + self.file.read(size - len(out) if size >= 0 else -1) if not self.head else out

    def seek(self, place: int) -> int:
        self.head = b""
        return self.file.seek(place)


_HEAD = struct.Struct("100s24x12s12x8s1s100x5s83xB166x")
_total = lru_cache(1024)(sum)


def ordinary(head: bytes) -> tuple[str, int] | None:
    """name and size of a regular member whose header says all about it; None if tarfile must tell, as of long names, links, an archive's end and broken headers."""
    if len(head) < BLOCK:
        return None
    name, size, check, kind, magic, prefixed = _HEAD.unpack(head)
    if kind != tarfile.REGTYPE or magic != b"ustar" or prefixed or not name[0]:
        return None
    digits, check = size.split(b"\0", 1)[0].strip(), check.split(b"\0", 1)[0].strip()
    if not digits.isdigit() or not check.isdigit():
        return None
    rest = head[100:124] + head[136:148] + head[156:]  # the same for most members of an archive, so its sum is remembered
    if sum(name.rstrip(b"\0")) + sum(size) + _total(rest) + 8 * 32 != int(check, 8):
        return None
    return name.split(b"\0", 1)[0].decode(tarfile.ENCODING, "surrogateescape"), int(digits, 8)


def members(path: str, begin: int = 0, end: int | None = None, start: int | None = None, content: bool = True, suffixes: tuple[str, ...] = ("",), starts: dict[int, int] | None = None) -> Iterator[tuple[str, int, int, bytes | None]]:
    """name, offset of its header, size and content of the regular members whose headers lie in [begin, end) and whose names end in one of the suffixes.

    Of a compressed archive, begin and end are places in its file, and start is where begin lies in its content, as offsets do; starts: see `Unpacked`.
    Most headers are read here, as tarfile takes some 50 microseconds for one; it reads those that need more than a look at one block.
    """
    system, where = located(path)
    raw, packed = system.open_input_file(where), path.endswith(COMPRESSED)
    at = begin if start is None else start
    if packed:
        raw = Unpacked(raw, begin, end, at, {} if starts is None else starts)
    else:
        raw.seek(begin)
    with io.BufferedReader(raw, BUFFER) as file:  # headers of small members lie close together
        again, tar = Again(file), None
        while packed or end is None or at < end:
            head = file.read(BLOCK)
            if not (tar and tar.pax_headers) and (known := ordinary(head)):
                name, size = known
                room, wanted = -(-size // BLOCK) * BLOCK, name.endswith(suffixes)
                following = at + BLOCK + room
                if content and wanted or room <= BUFFER:
                    held = file.read(room)
                    whole = len(held) == room
                else:
                    file.seek(following - 1)
                    whole = file.read(1)
                if not whole:
                    raise tarfile.ReadError(f"{path} ends inside {name}")
                if wanted:
                    yield name, at, size, held[:size] if content else None
            else:
                again.head = head
                if tar is None:  # it reads a member when it is opened
                    tar = tarfile.open(fileobj=again, mode="r:")
                    member, tar.firstmember = tar.firstmember, None
                else:
                    tar.offset = at
                    member = tar.next()
                if member is None:
                    return
                tar.members = []  # else it keeps all it has seen
                following = tar.offset
                if member.isfile() and member.name.endswith(suffixes):
                    yield member.name, member.offset, member.size, tar.extractfile(member).read() if content else None
                if file.tell() < following:
                    file.seek(following - 1)
                    if not file.read(1):
                        raise tarfile.ReadError(f"{path} ends inside {member.name}")
            at = following


def ranges(path: str, partition_bytes: int) -> list[tuple[str, int, int, int]]:
    """The archive cut at member boundaries, each part as long as it takes to reach partition_bytes: path, begin, end and start, as `members` takes them."""
    out, begin, start, starts = [], 0, 0, {}
    for _, offset, _, _ in members(path, content=False, starts=starts):
        at = starts.pop(offset, None) if path.endswith(COMPRESSED) else offset
        if at is not None and at - begin >= partition_bytes:
            out.append((path, begin, at, start))
            begin, start = at, offset
    return [*out, (path, begin, 1 << 62, start)]


def tar_members(spark: SparkSession, path: str, suffix: str = "", content: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """archive, member, offset (of its header), size and, unless it is off, content of the regular members of an archive, or of all *.tar, *.tar.gz and *.tgz below a folder.

    suffix: only members whose names end so (several with commas between); others' contents are passed over. partition_bytes counts
    bytes of files; an offset in a compressed archive is one in its content. Defined cases: folders and links inside archives are
    left out; an archive without members gives no rows; a path that isn't there, or a file that is no archive, is an error.
    """
    found = archives_below(path)
    suffixes = tuple(s for s in suffix.split(",") if s) or ("",)
    total = sum(located(p)[0].get_file_info(located(p)[1]).size or 0 for p in found)
    most = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, total // PARTITION_BYTES)
    tasks = max(1, min(-(-total // partition_bytes), most))
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), *([("content", pa.binary())] if content else [])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                paths, *places = zip(*ranges(found[i], partition_bytes), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(p, pa.int64()) for p in places)], ["archive", "begin", "end", "start"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for part in (r for b in batches for r in b.to_pylist()):
            for name, offset, size, value in members(part["archive"], part["begin"], part["end"], part["start"], content, suffixes):
                rows.append((part["archive"], name, offset, size, value)[: len(schema)])
                held += len(value or b"") + 256
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    scanned = shipped(spark.range(0, len(found), 1, max(1, len(found)))).mapInArrow(scan, "archive string, begin long, end long, start long")
    return scanned.repartition(tasks).mapInArrow(read, SCHEMA + (", content binary" if content else ""))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files below folder; returns (path, size). A file appears under its name only when it is whole, so a repeated task replaces it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(folder)
        system.create_dir(at)
        for batch in batches:
            names, contents = batch.column("name").to_pylist(), batch.column("content").to_pylist()
            for name, content in zip(names, contents, strict=True):
                put(system, f"{at}/{name}", lambda file, c=content: file.write(c))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array([len(c) for c in contents], pa.int64())], ["path", "size"])

    return shipped(files).select("name", F.col("content").cast("binary")).mapInArrow(write, "path string, size long")


def put(system: fs.FileSystem, path: str, write) -> None:
    """Write under another name first."""
    early = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(early) as file:
        write(file)
    system.move(early, path)


_PLAIN = tarfile.TarInfo("").tobuf(tarfile.GNU_FORMAT)
_PLAIN_SUM = sum(_PLAIN[100:124]) + sum(_PLAIN[136:148]) + sum(_PLAIN[156:]) + 8 * 32


def header(member: str, size: int) -> bytes:
    """A regular member's header, as tarfile makes it in GNU's format; it takes a twentieth of the time where nothing but name and size differ."""
    name, digits = member.encode(tarfile.ENCODING, "surrogateescape"), b"%011o\0" % size
    if len(name) > 100 or len(digits) > 12:
        info = tarfile.TarInfo(member)
        info.size = size
        return info.tobuf(tarfile.GNU_FORMAT)
    return b"%s%s%s%s%06o\0 %s" % (name.ljust(100, b"\0"), _PLAIN[100:124], digits, _PLAIN[136:148], _PLAIN_SUM + sum(name) + sum(digits), _PLAIN[156:])


def dealt_to_archives(rows: DataFrame, *order: str) -> DataFrame:
    """rows dealt to tasks by `archive`, an archive's one after the other in the order given."""
    session = rows.sparkSession
    # said, as tasks would else be merged until they have many megabytes, which are much work here; more than a few archives in one task are waited for
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "archive").sortWithinPartitions("archive", *order)


def write_tars(rows: DataFrame, folder: str, compressed: bool = False, dealt: bool = False) -> DataFrame:
    """Write (archive, member, content) rows as <archive>.tar files below folder, members by name; returns (path, members). Members are streamed, so only one has to fit into memory.

    compressed: as <archive>.tar.gz, in gzip members of PACKED_BYTES, at which they can be cut. dealt: rows come from `dealt_to_archives` and stay in that order;
    so members that are made of rows there need not be shuffled themselves.
    """
    ending = ".tar.gz" if compressed else ".tar"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(folder)
        system.create_dir(at)
        flat = ((a, m, c) for b in batches for a, m, c in zip(*(b.column(k).to_numpy(zero_copy_only=False).tolist() for k in ("archive", "member", "content")), strict=True))
        for archive, group in groupby(flat, key=lambda r: r[0]):
            n = 0

            def fill(file, group=group) -> None:
                nonlocal n
                parts, held, size = [], 0, 0

                def put_out() -> None:
                    file.write(gzip.compress(b"".join(parts), 1, mtime=0) if compressed else b"".join(parts))

                for _, member, content in group:
                    parts += (header(member, len(content)), content, bytes(-len(content) % BLOCK))
                    held += len(parts[-3]) + len(content) + len(parts[-1])
                    n += 1
                    if held >= PACKED_BYTES:
                        put_out()
                        parts, held, size = [], 0, size + held
                parts.append(bytes(2 * BLOCK + -(size + held + 2 * BLOCK) % RECORD))
                put_out()

            put(system, f"{at}/{archive}{ending}", fill)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{archive}{ending}"]), pa.array([n], pa.int64())], ["path", "members"])

    rows = shipped(rows).select("archive", "member", F.col("content").cast("binary"))
    return (rows if dealt else dealt_to_archives(rows, "member")).mapInArrow(write, "path string, members long")
