"""ISO base media files: walking nested boxes, decoding sample tables, and writing plain ones.  Bytes in, arrays out; no Spark.

The reader never looks into media data: it takes a sample's place, size and time from the tables, of
the movie box and of movie fragments.  Every count is held against the bytes that could carry it before arrays
are made, so a broken or hostile file costs no more memory than its length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: boxes that hold boxes and are walked.
INNER = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf"}
#: Deepest nesting that is walked; the format's own is six.
DEEPEST = 16


class Fault(ValueError):
    """What is wrong with a file."""


@dataclass
class Track:
    """One track: what its boxes say, and by sample the place, size, time of decoding and shift to its time of showing, and whether decoding can begin there."""

    id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    channels: int = 0
    rate: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def seconds(self) -> float | None:
        return self.duration / self.timescale if self.timescale else None


@dataclass
class Movie:
    brand: str = ""
    timescale: int = 0
    duration: int = 0
    tracks: list[Track] = field(default_factory=list)


def boxes(data: memoryview, a: int, b: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, byte after it) of the boxes between a and b."""
    while a < b:
        if b - a < 8:
            if not any(data[a:b]):  # padding
                return
            raise Fault(f"{b - a} bytes too few for a box at {a}")
        size, kind, head = int.from_bytes(data[a : a + 4]), bytes(data[a + 4 : a + 8]), 8
        if size == 1:
            if b - a < 16:
                raise Fault(f"no room for a long size at {a}")
            size, head = int.from_bytes(data[a + 8 : a + 16]), 16
        elif size == 0:
            size = b - a
        if kind == b"uuid":
            head += 16
        if size < head or size > b - a:
            raise Fault(f"box {kind.decode('latin-1')!r} at {a} has size {size}")
        yield kind, a + head, a + size
        a += size


def walk(data: memoryview, a: int, b: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box below, in the order of the file: (types from the top, first byte of the content, byte after it)."""
    for kind, x, y in boxes(data, a, b):
        yield (*path, kind), x, y
        if kind in INNER and len(path) < DEEPEST:
            yield from walk(data, x, y, (*path, kind))


def _full(data: memoryview, x: int, y: int, least: int) -> tuple[int, int, memoryview]:
    """Version, flags and content of a full box of at least so many bytes after them."""
    if y - x < 4 + least:
        raise Fault(f"a box at {x} is too short")
    return data[x], int.from_bytes(data[x + 1 : x + 4]), data[x + 4 : y]


def _table(body: memoryview, at: int, columns: int, width: int = 4, count: int | None = None) -> np.ndarray:
    """[row, column] of big-endian numbers, after a count of rows unless it is given."""
    if count is None:
        count, at = int.from_bytes(body[at : at + 4]), at + 4
    if count * columns * width > len(body) - at:
        raise Fault(f"a table of {count} rows in {len(body) - at} bytes")
    return np.frombuffer(body, f">u{width}", count * columns, at).astype(np.int64).reshape(count, columns)


def _clock(data: memoryview, x: int, y: int) -> tuple[int, int]:
    """Timescale and duration of mvhd or mdhd."""
    version, _, body = _full(data, x, y, 16)
    if version == 1 and len(body) >= 28:
        return struct.unpack_from(">IQ", body, 16)
    return struct.unpack_from(">II", body, 8)


def _description(track: Track, data: memoryview, x: int, y: int) -> None:
    _, _, body = _full(data, x, y, 4)
    for kind, a, b in boxes(body, 4, len(body)):
        track.codec = kind.decode("latin-1")
        if track.handler == "vide" and b - a >= 28:
            track.width, track.height = struct.unpack_from(">HH", body, a + 24)
        elif track.handler == "soun" and b - a >= 28:
            track.channels, track.rate = struct.unpack_from(">H", body, a + 16)[0], struct.unpack_from(">I", body, a + 24)[0] >> 16
        return


def _runs(pairs: np.ndarray, n: int, what: str) -> np.ndarray:
    """(count, value) rows -> the value of each of n samples."""
    if int(pairs[:, 0].sum()) != n:
        raise Fault(f"{what} is of {int(pairs[:, 0].sum())} samples, sizes are of {n}")
    return np.repeat(pairs[:, 1], pairs[:, 0])


def _samples(track: Track, data: memoryview, found: dict[bytes, tuple[int, int]], length: int) -> None:
    """Fills in the samples from the boxes of one stbl."""
    if b"stsz" in found:
        _, _, body = _full(data, *found[b"stsz"], 8)
        size, n = struct.unpack_from(">II", body)
        if size and n * size > length:
            raise Fault(f"{n} samples of {size} bytes in a file of {length}")
        track.sizes = np.full(n, size, np.int64) if size else _table(body, 8, 1, 4, n)[:, 0]
    elif b"stz2" in found:
        _, _, body = _full(data, *found[b"stz2"], 8)
        bits, n = body[3], int.from_bytes(body[4:8])
        if bits == 4:
            pairs = _table(body, 8, 1, 1, (n + 1) // 2)[:, 0]
            track.sizes = np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:n]
        elif bits in (8, 16):
            track.sizes = _table(body, 8, 1, bits // 8, n)[:, 0]
        else:
            raise Fault(f"sizes of {bits} bits")
    n = len(track.sizes)
    if not n:
        return
    if b"stco" in found:
        chunks = _table(_full(data, *found[b"stco"], 4)[2], 0, 1)[:, 0]
    elif b"co64" in found:
        chunks = _table(_full(data, *found[b"co64"], 4)[2], 0, 1, 8)[:, 0]
    else:
        raise Fault("samples but no chunks")
    if b"stsc" not in found:
        raise Fault("samples but no map to chunks")
    spans = _table(_full(data, *found[b"stsc"], 4)[2], 0, 3)
    first = spans[:, 0] - 1
    if not len(first) or first[0] or (np.diff(first) <= 0).any() or first[-1] >= len(chunks):
        raise Fault("the map to chunks does not rise from the first")
    in_chunk = np.repeat(spans[:, 1], np.diff(np.r_[first, len(chunks)]))
    if int(in_chunk.sum()) != n:
        raise Fault(f"chunks hold {int(in_chunk.sum())} samples, sizes are of {n}")
    upto = np.r_[0, np.cumsum(track.sizes)]
    begins = np.r_[0, np.cumsum(in_chunk)[:-1]]
    track.offsets = np.repeat(chunks - upto[begins], in_chunk) + upto[:-1]
    if b"stts" not in found:
        raise Fault("samples but no times")
    deltas = _runs(_table(_full(data, *found[b"stts"], 4)[2], 0, 2), n, "the table of times")
    track.times = np.cumsum(deltas) - deltas
    track.shifts = np.zeros(n, np.int64)
    if b"ctts" in found:
        version, _, body = _full(data, *found[b"ctts"], 4)
        shifts = _runs(_table(body, 0, 2), n, "the table of shifts")
        track.shifts = shifts.astype(np.uint32).view(np.int32).astype(np.int64) if version else shifts
    track.sync = np.ones(n, bool)
    if b"stss" in found:
        numbers = _table(_full(data, *found[b"stss"], 4)[2], 0, 1)[:, 0]
        if len(numbers) and (numbers.min() < 1 or numbers.max() > n):
            raise Fault("a keyframe that is no sample")
        track.sync[:] = False
        track.sync[numbers - 1] = True


def _fragment(movie: Movie, data: memoryview, start: int, a: int, b: int, defaults: dict[int, tuple[int, int, int]], length: int) -> None:
    """Appends the samples of one moof, whose box begins at start."""
    for kind, x, y in boxes(data, a, b):
        if kind != b"traf":
            continue
        track, base, here, time, after = None, start, (0, 0, 0), None, None
        for inner, p, q in boxes(data, x, y):
            if inner == b"tfhd":
                _, flags, body = _full(data, p, q, 4)
                number, at = int.from_bytes(body[:4]), 4
                track = next((t for t in movie.tracks if t.id == number), None)
                if track is None:
                    raise Fault(f"a fragment of track {number}, which is not there")
                values = list(defaults.get(number, (0, 0, 0)))
                for bit, width in ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4), (0x20, 4)):
                    if flags & bit:
                        if at + width > len(body):
                            raise Fault("a fragment's header is too short")
                        value, at = int.from_bytes(body[at : at + width]), at + width
                        if bit == 0x1:
                            base = value
                        elif bit != 0x2:
                            values[{0x8: 0, 0x10: 1, 0x20: 2}[bit]] = value
                here, after = tuple(values), base
            elif inner == b"tfdt":
                version, _, body = _full(data, p, q, 4)
                time = int.from_bytes(body[: 8 if version else 4])
            elif inner == b"trun":
                if track is None:
                    raise Fault("samples before the fragment's header")
                version, flags, body = _full(data, p, q, 4)
                n, at = int.from_bytes(body[:4]), 4
                if flags & 0x1:
                    after, at = base + struct.unpack_from(">i", body, at)[0], at + 4
                first_flags = None
                if flags & 0x4:
                    first_flags, at = int.from_bytes(body[at : at + 4]), at + 4
                columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                if not columns and n * max(1, here[1]) > length:
                    raise Fault(f"a run of {n} samples in a file of {length} bytes")
                rows = _table(body, at, len(columns), 4, n)
                column = lambda bit, default: rows[:, columns.index(bit)] if bit in columns else np.full(n, default, np.int64)  # noqa: B023, E731
                deltas, sizes, marks = column(0x100, here[0]), column(0x200, here[1]), column(0x400, here[2]).copy()
                shifts = column(0x800, 0)
                if first_flags is not None and n:
                    marks[0] = first_flags
                if time is None:
                    time = int(track.times[-1]) if len(track.times) else 0
                track.offsets = np.r_[track.offsets, after + np.cumsum(sizes) - sizes]
                track.sizes, track.times = np.r_[track.sizes, sizes], np.r_[track.times, time + np.cumsum(deltas) - deltas]
                track.shifts = np.r_[track.shifts, shifts.astype(np.uint32).view(np.int32).astype(np.int64) if version else shifts]
                track.sync = np.r_[track.sync, (marks & 0x10000) == 0]
                after, time = after + int(sizes.sum()), time + int(deltas.sum())
                track.duration = max(track.duration, time)


def read(data) -> Movie:
    """What a file says of itself.  Raises Fault where it contradicts itself, ends early or names bytes that it does not have."""
    data = memoryview(data).cast("B")
    movie, defaults, track, found, seen = Movie(), {}, None, {}, False
    fragments, trees = [], []
    for path, x, y in walk(data, 0, len(data)):
        kind = path[-1]
        if path == (b"ftyp",):
            movie.brand = bytes(data[x : x + 4]).decode("latin-1")
        elif path == (b"moov",):
            seen = True
        elif kind == b"mvhd":
            movie.timescale, movie.duration = _clock(data, x, y)
        elif path == (b"moov", b"trak"):
            track, found = Track(), {}
            movie.tracks.append(track)
            trees.append((track, found))
        elif path == (b"moof",):
            fragments.append((x, y))
        elif kind == b"trex":
            _, _, body = _full(data, x, y, 20)
            number, _, *rest = struct.unpack_from(">5I", body)
            defaults[number] = tuple(rest)
        elif path[:2] == (b"moov", b"trak") and track is not None:
            if kind == b"tkhd":
                version, _, body = _full(data, x, y, 20)
                track.id = int.from_bytes(body[16:20] if version == 1 else body[8:12])
            elif kind == b"mdhd":
                track.timescale, track.duration = _clock(data, x, y)
            elif kind == b"hdlr":
                track.handler = bytes(_full(data, x, y, 8)[2][4:8]).decode("latin-1")
            elif path[-2] == b"stbl":
                found[kind] = (x, y)
    if not seen:
        raise Fault("no movie box")
    for track, found in trees:
        if b"stsd" in found:
            _description(track, data, *found[b"stsd"])
        _samples(track, data, found, len(data))
    for x, y in fragments:
        _fragment(movie, data, x - 8, x, y, defaults, len(data))
    for track in movie.tracks:
        if len(track.sizes) and (track.offsets.min() < 0 or (track.offsets + track.sizes).max() > len(data)):
            raise Fault(f"track {track.id} has samples beyond the file")
    return movie


def content(data, track: Track) -> bytes:
    """The samples of a track, end to end; neighbours in the file are copied in one piece."""
    data = memoryview(data).cast("B")
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    first = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]])
    last = np.r_[first[1:], len(ends)] - 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[first].tolist(), ends[last].tolist(), strict=True))


def box(kind: bytes, *content: bytes) -> bytes:
    size = 8 + sum(map(len, content))
    if size < 1 << 32:
        return b"".join([size.to_bytes(4), kind, *content])
    return b"".join([(1).to_bytes(4), kind, (size + 8).to_bytes(8), *content])


def full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, bytes([version]), flags.to_bytes(3), *content)


def write(payload: bytes, width: int, height: int, rate: int, chunk: int, key_every: int) -> bytes:
    """A file of one video track: the payload as raw frames of width x height 8-bit grey samples, ``rate`` a second.

    Frames lie in chunks of ``chunk``; decoding is offered a start at each ``key_every``-th frame.  The payload must fill its frames.
    """
    frame = width * height
    n, rest = divmod(len(payload), frame)
    if rest or not n:
        raise ValueError(f"{len(payload)} bytes do not fill frames of {frame}")
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks, tail = -(-n // chunk), n % chunk
    spans = [(1, chunk)] if not tail else [(1, tail)] if chunks == 1 else [(1, chunk), (chunks, tail)]
    keys = np.arange(1, n + 1, key_every, dtype=np.int64)
    head = box(b"ftyp", b"isom", u32(512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), b"\0\1", bytes(16), struct.pack(">HH", width, height), u32(0x480000, 0x480000, 0), b"\0\1", bytes(32), struct.pack(">Hh", 40, -1))

    def movie(begin: int) -> bytes:
        places = begin + np.arange(chunks, dtype=np.int64) * chunk * frame
        wide = bool(places[-1] >= 1 << 32)
        table = full(b"co64" if wide else b"stco", u32(chunks), places.astype(">u8" if wide else ">u4").tobytes())
        samples = box(b"stbl", full(b"stsd", u32(1), entry), full(b"stts", u32(1, n, 1)), full(b"stss", u32(len(keys)), keys.astype(">u4").tobytes()), full(b"stsc", u32(len(spans)), *[u32(a, k, 1) for a, k in spans]), full(b"stsz", u32(frame, n)), table)
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", u32(1), full(b"url ", flags=1))), samples)
        media = box(b"mdia", full(b"mdhd", u32(0, 0, rate, n), b"\x55\xc4\0\0"), full(b"hdlr", u32(0), b"vide", bytes(12), b"frames\0"), info)
        track = box(b"trak", full(b"tkhd", u32(0, 0, 1, 0, n), bytes(8), bytes(8), matrix, u32(width << 16, height << 16), flags=3), media)
        return box(b"moov", full(b"mvhd", u32(0, 0, rate, n, 0x10000), b"\1\0", bytes(10), matrix, bytes(24), u32(2)), track)

    mark = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(movie(0))
    begin = len(head) + size + mark
    if len(movie(begin)) != size:  # chunk places need 64 bits
        begin = len(head) + len(movie(begin)) + mark
    return b"".join([head, movie(begin), box(b"mdat", payload)])
