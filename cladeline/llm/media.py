"""Media columns: a table of ISO media files -> codec, durations and the byte ranges of keyframes, by file.

Sample tables are read, payloads are not decoded.  A reader of the result can fetch any group of frames by its
byte range.  Files are cells, so a file has less than 2 GiB; each is handled in the task that reads it, without any shuffle.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import iso_media
from .common import Scratch, table, trimmed

#: Frames that texts are stored in: 24 x 24 grey samples, 25 a second, 32 to a chunk, every 16th a keyframe.
WIDTH, HEIGHT, RATE, CHUNK, KEY_EVERY = 24, 24, 25, 32, 16
#: Bytes of files that a task hands on at once, about.
HELD = 16 << 20

_KEY = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("time", pa.int64())])
_TRACK = pa.struct([
    ("id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("width", pa.int32()), ("height", pa.int32()),
    ("channels", pa.int32()), ("rate", pa.int32()), ("samples", pa.int64()), ("sample_bytes", pa.int64()), ("keyframes", pa.list_(_KEY)),
])
_INFO = [("brand", pa.string()), ("seconds", pa.float64()), ("tracks", pa.list_(_TRACK)), ("fault", pa.string())]
_DIGESTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
_KEYS_SQL = "array<struct<offset: bigint, size: bigint, time: bigint>>"
_TRACKS_SQL = f"array<struct<id: bigint, handler: string, codec: string, timescale: bigint, duration: bigint, seconds: double, width: int, height: int, channels: int, rate: int, samples: bigint, sample_bytes: bigint, keyframes: {_KEYS_SQL}>>"
_SQL = f"brand string, seconds double, tracks {_TRACKS_SQL}, fault string"
_DIGESTS_SQL = ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"


def _info(movie: iso_media.Movie) -> list:
    def keys(t: iso_media.Track) -> list[dict]:
        pick = t.sync
        return [{"offset": o, "size": s, "time": x} for o, s, x in zip(t.offsets[pick].tolist(), t.sizes[pick].tolist(), (t.times + t.shifts)[pick].tolist(), strict=True)]

    tracks = [{
        "id": t.id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "seconds": t.seconds, "width": t.width, "height": t.height,
        "channels": t.channels, "rate": t.rate, "samples": len(t.sizes), "sample_bytes": int(t.sizes.sum()), "keyframes": keys(t),
    } for t in movie.tracks]
    return [movie.brand, movie.duration / movie.timescale if movie.timescale else None, tracks, None]


def _digests(data: memoryview, movie: iso_media.Movie | None) -> list:
    payload = iso_media.content(data, movie.tracks[0]) if movie is not None and movie.tracks else b""
    return [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()]


def _scan(key: str, column: str, digests: bool):
    kinds = [*_INFO, *_DIGESTS] if digests else _INFO

    def run(batches):
        for batch in batches:
            rows = []
            for cell in batch.column(column):
                if not cell.is_valid:
                    rows.append([None] * len(kinds))
                    continue
                data, movie = memoryview(cell.as_buffer()), None
                try:
                    movie = iso_media.read(data)
                    row = _info(movie)
                except iso_media.Fault as e:
                    row = [None, None, None, str(e)]
                rows.append(row + (_digests(data, movie) if digests else []))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)]], names=[key, *[n for n, _ in kinds]])
        trimmed()

    return run


def media_columns(media: DataFrame, key: str = "doc_id", column: str = "media", digests: bool = False) -> DataFrame:
    """key, brand, seconds, tracks, fault of each row's file; with ``digests`` also of the file and of its first track read back.

    tracks has by track its codec, clock, size, number of samples, and the keyframes with their byte ranges in the file and times of showing (in its
    timescale).  A file that breaks the format has its first fault and no tracks; a null file has nothing.  Rows that
    repeat are kept each; an empty table gives an empty result; other columns are not read.
    """
    clash = {n for n, _ in [*_INFO, *_DIGESTS]} & {key}
    own = "key" if clash else key
    kind = media.schema[key].dataType.simpleString()
    rows = media.select(F.col(f"`{key}`").alias(own), F.col(f"`{column}`").alias("media"))
    return rows.mapInArrow(_scan(own, "media", digests), f"`{own}` {kind}, {_SQL}{_DIGESTS_SQL if digests else ''}")


def _stored(batches):
    names = ["doc_id", "n_bytes", "media"]
    for batch in batches:
        ids, texts, at, held, size = batch.column("doc_id"), batch.column("text"), 0, [], 0
        for k in range(len(batch)):
            text = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            frame = WIDTH * HEIGHT
            payload = text + b"\xff" * (-len(text) % frame or (0 if text else frame))
            held.append((len(text), iso_media.write(payload, WIDTH, HEIGHT, RATE, CHUNK, KEY_EVERY)))
            size += len(payload)
            if size > HELD or k == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array([m for _, m in held], pa.binary())], names=names)
                at, held, size = k + 1, [], 0
    trimmed()


def texts_as_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as raw frames in an ISO media file, filled up with bytes 255; null as empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return docs.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _feature() -> F.Column:
    """The first track in words: brand, codec, frame size, samples, duration, and its keyframes' number, span and digest."""
    t = F.element_at("tracks", 1)
    keys = t.getField("keyframes")
    ranges = F.array_join(F.transform(keys, lambda k: F.concat_ws("+", k["offset"], k["size"])), ",")
    parts = [F.concat(F.trim("brand"), F.lit("/"), t["handler"], F.lit("/"), F.trim(t["codec"])), F.concat_ws("x", t["width"], t["height"]), F.concat(F.lit("samples="), t["samples"]), F.concat(F.lit("duration="), t["duration"], F.lit("/"), t["timescale"])]
    parts += [F.concat(F.lit("keyframes="), F.size(keys)), F.concat(F.lit("first="), keys[0]["offset"]), F.concat(F.lit("last="), F.element_at(keys, -1)["offset"]), F.concat(F.lit("ranges="), F.lower(F.hex(F.crc32(ranges))))]
    return F.concat_ws(" ", *parts)


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "media")
    with store:
        media = store.put(texts_as_media(table(spark, sf_dir, "documents")), "media")
        info = media_columns(media.select(F.struct("doc_id", "n_bytes").alias("doc"), "media"), "doc", digests=True)
        out = store.put(info.select("doc.doc_id", "doc.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", _feature().alias("feature"), "seconds", "fault"), "columns")
        store.drop(media)
        return out
