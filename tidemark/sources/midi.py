"""MIDI files as tables: a scan of typed rows, normalised event tables, and the way back to file contents.

Files are read by Spark (``binaryFile``), so any store that it can open will do;
a file is parsed where it lies, and all that follows is DataFrame operations.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, to_frames
from ..operators.temporal import merge_intervals
from ..schemas import FRAME_RATE, HIGH_KEY, LOW_KEY, NOTE, PEDAL_OFF, PEDAL_ON

#: what: note, pedal, tempo, meter, key, marker, lyric. Times are seconds; stop is null but for notes and pedals.
SCAN = "path string, what string, track int, drum boolean, start double, stop double, a int, b int, text string, error string"
_PEDAL_DOWN = 64
# Fixed values of the format: bytes of data after a channel status, and types of meta events.
_SIZES = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}
_META = {0x05: "lyric", 0x06: "marker", 0x51: "tempo", 0x58: "meter", 0x59: "key"}


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and where it ends."""
    n = 0
    while True:
        n = n << 7 | data[at] & 127
        at += 1
        if data[at - 1] < 128:
            return n, at


def _track(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status or 256 + meta type, data) of a track's messages."""
    at = tick = status = 0
    while at < len(data):
        step, at = _number(data, at)
        tick += step
        if data[at] >= 0x80:
            status, at = data[at], at + 1
        if status == 0xFF:
            kind = data[at]
            size, at = _number(data, at + 1)
            yield tick, 256 + kind, data[at : at + size]
        elif status in (0xF0, 0xF7):
            size, at = _number(data, at)
        else:
            size = _SIZES[status >> 4]
            yield tick, status, data[at : at + size]
        at += size


def parse(content: bytes) -> list[tuple]:
    """Rows (what, track, drum, start, stop, a, b, text) of a file."""
    if content[:4] != b"MThd":
        raise ValueError("no MIDI header")
    head, _, tracks, division = struct.unpack(">IHHH", content[4:14])
    if division & 0x8000:
        raise ValueError("SMPTE time is not supported")
    at, chunks = 8 + head, []
    while len(chunks) < tracks and at + 8 <= len(content):
        kind, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "big")
        if kind == b"MTrk":
            chunks.append(list(_track(content[at + 8 : at + 8 + size])))
        at += 8 + size
    changes = sorted((t, int.from_bytes(d, "big")) for c in chunks for t, s, d in c if s == 256 + 0x51)
    ticks, seconds, rates = [0], [0.0], [0.5 / division]
    for t, micros in changes:
        seconds.append(seconds[-1] + (t - ticks[-1]) * rates[-1])
        ticks.append(t)
        rates.append(micros / 1e6 / division)

    def time(t: int) -> float:
        i = bisect_right(ticks, t) - 1
        return seconds[i] + (t - ticks[i]) * rates[i]

    rows: list[tuple] = []
    for number, chunk in enumerate(chunks):
        open_notes, pedal = defaultdict(list), {}
        end = chunk[-1][0] if chunk else 0
        for tick, status, d in chunk:
            what, channel = status >> 4, status & 15
            if status >= 256:
                if (name := _META.get(status - 256)) == "tempo":
                    rows.append((name, number, False, time(tick), None, int.from_bytes(d, "big"), None, None))
                elif name == "meter":
                    rows.append((name, number, False, time(tick), None, d[0], 2 ** d[1], None))
                elif name == "key":
                    rows.append((name, number, False, time(tick), None, int.from_bytes(d[:1], "big", signed=True), d[1], None))
                elif name:
                    rows.append((name, number, False, time(tick), None, None, None, d.decode("utf-8", "replace").strip()))
            elif what == 0x9 and d[1] > 0:
                open_notes[channel, d[0]].append((tick, d[1]))
            elif what in (0x8, 0x9) and open_notes[channel, d[0]]:
                start, velocity = open_notes[channel, d[0]].pop(0)
                rows.append(("note", number, channel == 9, time(start), time(tick), d[0], velocity, None))
            elif what == 0xB and d[0] == 64:
                if d[1] >= _PEDAL_DOWN:
                    pedal.setdefault(channel, tick)
                elif channel in pedal:
                    rows.append(("pedal", number, channel == 9, time(pedal.pop(channel)), time(tick), None, None, None))
        rows += [("pedal", number, c == 9, time(t), time(end), None, None, None) for c, t in pedal.items()]
    return rows


#: Rows of a batch that leaves the scan, and those of the file at hand.
_ROWS = 20_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    got = pd.DataFrame(rows, columns=["path", "what", "track", "drum", "start", "stop", "a", "b", "text", "error"])
    return got.astype({"track": "Int32", "a": "Int32", "b": "Int32", "drum": "boolean", "start": "Float64", "stop": "Float64"})


def scan(files: DataFrame) -> DataFrame:
    """Typed rows of (path, content); a file that can't be read is one row with its error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(path, *r, None) for r in parse(bytes(content))]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
                if len(rows) >= _ROWS:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return files.select("path", "content").mapInPandas(read, SCAN)


def read_midi(spark: SparkSession, folder: str, pattern: str = "*.mid*") -> DataFrame:
    """The scan of all files below a folder."""
    return scan(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder))


def events_of(rows: DataFrame, trim: bool = True) -> DataFrame:
    """(song_id, onset, kind, pitch, duration, velocity) in frames, from a scan without its drums.

    Of notes equal in onset and pitch the longest stays. Pedals that overlap after rounding are one.
    """
    rows = rows.where("not drum").withColumnRenamed("path", "song_id")
    onset = to_frames(F.col("start"), FRAME_RATE)
    notes = rows.where((F.col("what") == "note") & F.col("a").between(LOW_KEY, HIGH_KEY)).select(
        "song_id", onset.alias("onset"), F.col("a").alias("pitch"), F.greatest(F.lit(1), to_frames(F.col("stop") - F.col("start"), FRAME_RATE)).alias("duration"), clip(F.col("b"), 1, 127).alias("velocity")
    )
    notes = notes.groupBy("song_id", "onset", "pitch").agg(F.max(F.struct("duration", "velocity")).alias("n")).select("song_id", "onset", F.lit(NOTE).alias("kind"), "pitch", "n.*")
    pedals = rows.where("what = 'pedal'").select("song_id", onset.alias("on"), F.greatest(onset + 1, to_frames(F.col("stop"), FRAME_RATE)).alias("off"))
    pedals = merge_intervals(pedals, ["song_id"], "on", "off").select("song_id", F.explode(F.array(F.struct(F.col("on").alias("onset"), F.lit(PEDAL_ON).alias("kind")), F.struct(F.col("off").alias("onset"), F.lit(PEDAL_OFF).alias("kind")))).alias("e"))
    zero = F.lit(0)
    pedals = pedals.select("song_id", "e.onset", "e.kind", zero.alias("pitch"), zero.cast("long").alias("duration"), zero.alias("velocity"))
    events = notes.unionByName(pedals)
    if trim:
        events = events.withColumn("onset", F.col("onset") - F.min("onset").over(Window.partitionBy("song_id")))
    return events.select("song_id", F.col("onset").cast("long").alias("onset"), F.col("kind").cast("int").alias("kind"), F.col("pitch").cast("int").alias("pitch"), F.col("duration").cast("long").alias("duration"), F.col("velocity").cast("int").alias("velocity"))


def song_ends(events: DataFrame) -> DataFrame:
    """(song_id, end_frame): where the last note has ended, and after the last onset."""
    note_end = F.max(F.when(F.col("kind") == NOTE, F.col("onset") + F.col("duration")))
    return events.groupBy("song_id").agg(F.greatest(F.coalesce(note_end, F.lit(0)), F.max("onset") + 1).alias("end_frame"))


def _variable(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def contents(events: DataFrame) -> DataFrame:
    """(song_id, content): a MIDI file of each song, 1000 ticks a second; pedals go down a tick after releases."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        messages: list[tuple[int, int, bytes]] = []
        for onset, kind, pitch, duration, velocity in frame[["onset", "kind", "pitch", "duration", "velocity"]].itertuples(index=False):
            at = int(onset) * 1000 // FRAME_RATE
            if kind == NOTE:
                messages.append((at, 2, bytes([0x90, pitch, velocity])))
                messages.append((at + int(duration) * 1000 // FRAME_RATE, 0, bytes([0x80, pitch, 0])))
            else:
                messages.append((at + 1, 1, bytes([0xB0, 64, 127])) if kind == PEDAL_ON else (at, 1, bytes([0xB0, 64, 0])))
        body, last = bytearray(b"\x00\xff\x51\x03" + (500_000).to_bytes(3, "big")), 0
        for tick, _, message in sorted(messages):
            body += _variable(tick - last) + message
            last = tick
        body += b"\x00\xff\x2f\x00"
        return pd.DataFrame({"song_id": frame["song_id"][:1], "content": [b"MThd" + struct.pack(">IHHH", 6, 0, 1, 500) + b"MTrk" + struct.pack(">I", len(body)) + bytes(body)]})

    kind = dict(events.dtypes)["song_id"]
    return events.groupBy("song_id").applyInPandas(write, f"song_id {kind}, content binary")
