"""Fill-in-middle transformation on texts stored as seekable compressed frames.

A text is stored as independent zstandard frames of ``frame_units`` units each, with the units and code
points up to the end of every frame. A unit is a word with the white space before it, or white space
at the end. To cut a text after a number of units, the frame is found by bisection in the counts and only
this frame is decompressed. The parts of a document in their new order are frames again: whole frames are
taken over as they are, only the cut ones are compressed anew, so the output is a valid zstandard
stream. Digests read its frames one after the other and hold one frame at a time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, functions as F

from verstext.llm.rows import map_keyed
from verstext.runtime import materialise

UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
FRAME = "struct<units: long, chars: long, data: binary>"


@dataclass(frozen=True)
class FimConfig:
    frame_units: int = 1024
    level: int = 3
    percent: int = 50  # of the texts that are transformed
    spm_percent: int = 80  # of these in the order suffix, prefix, middle
    seed: int = 42


def code_points(data: bytes) -> int:
    return len(data.decode())


def to_frames(text: bytes, config: FimConfig, compress: Callable[[bytes], bytes]) -> list[dict]:
    """Frames of a text with the units and code points up to the end of each one."""
    ends = [m.end() for m in UNIT.finditer(text)]
    frames, begin, chars = [], 0, 0
    for first in range(0, len(ends), config.frame_units):
        last = min(first + config.frame_units, len(ends))
        part = text[begin : ends[last - 1]]
        chars += code_points(part)
        frames.append({"units": last, "chars": chars, "data": compress(part)})
        begin = ends[last - 1]
    return frames


def store_frames(docs: DataFrame, config: FimConfig = FimConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, frames, marked`` of every row: the seekable store. A NULL or empty text has no frames.

    ``marked`` says that the text itself contains one of the three marks.
    """

    def start():
        compress = zstandard.ZstdCompressor(level=config.level).compress

        def work(texts):
            return None, [[to_frames(t, config, compress) for t in texts], [any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]]

        return work

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return map_keyed(rows, start, f"frames array<{FRAME}>, marked boolean")


@dataclass(frozen=True)
class Place:
    """A place between two units: ``frame`` whole frames lie before it, and ``head`` of the next one."""

    frame: int
    head: bytes
    tail: bytes
    chars: int


class FrameReader:
    """Places and parts of one stored text; decompresses the frames that are cut and no others."""

    def __init__(self, frames: list[dict], decompress: Callable[[bytes], bytes], compress: Callable[[bytes], bytes]):
        self.frames, self.decompress, self.compress = frames, decompress, compress
        self.units = [f["units"] for f in frames]

    def place(self, unit: int) -> Place:
        """The place behind the first ``unit`` units."""
        at = bisect_right(self.units, unit)
        before = self.units[at - 1] if at else 0
        chars = self.frames[at - 1]["chars"] if at else 0
        if unit == before:
            return Place(at, b"", b"", chars)
        data = self.decompress(self.frames[at]["data"])
        units = UNIT.finditer(data)
        for _ in range(unit - before):
            end = next(units).end()
        return Place(at, data[:end], data[end:], chars + code_points(data[:end]))

    def part(self, start: Place, stop: Place) -> list[bytes]:
        """The frames of the text between two places."""
        if start.frame == stop.frame:
            inside = stop.head[len(start.head) :]
            return [self.compress(inside)] if inside else []
        out = [self.compress(start.tail)] if start.head else []
        out += [f["data"] for f in self.frames[start.frame + bool(start.head) : stop.frame]]
        return out + ([self.compress(stop.head)] if stop.head else [])


def transform_one(frames: list[dict], marked: bool, draw: str, config: FimConfig, reader: Callable[..., FrameReader], mark: dict):
    """(n, form, prefix code points, middle code points, output frames) of one stored text."""
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    n = frames[-1]["units"] if frames else 0
    if not frames or marked or h3 % 100 >= config.percent:
        return n, "plain", None, None, [f["data"] for f in frames]
    text = reader(frames)
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    begin, low, high, end = (text.place(u) for u in (0, *cuts, n))
    form = "spm" if h4 % 100 < config.spm_percent else "psm"
    parts = {PREFIX: (begin, low), MIDDLE: (low, high), SUFFIX: (high, end)}
    output = [f for m in MARKS[form] for f in (mark[m], *text.part(*parts[m]))]
    return n, form, low.chars, high.chars - low.chars, output


def fill_in_middle(stored: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` from the rows of ``store_frames``.

    ``output`` lists zstandard frames, which joined are one stream. The cuts and the form come from the
    SHA-256 of the seed, a colon and the key (a NULL key as nothing). A text without units or with a mark in
    it is plain. Rows with equal keys are cut by the same numbers, each in its own text.
    """

    def start():
        compress, decompress = zstandard.ZstdCompressor(level=config.level).compress, zstandard.ZstdDecompressor().decompress
        mark = {m: compress(m) for m in (PREFIX, SUFFIX, MIDDLE)}

        def work(frames, marked, draws):
            made = [
                transform_one(f, m, d, config, lambda f: FrameReader(f, decompress, compress), mark)
                for f, m, d in zip(frames, marked, draws, strict=True)
            ]
            return None, [list(c) for c in zip(*made, strict=True)]

        return work

    key = stored.columns[0]
    draw = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    fields = "n long, form string, prefix_chars long, middle_chars long, output array<binary>"
    return map_keyed(stored.select(key, "frames", "marked", draw.alias("draw")), start, fields)


def stream(frames: list[bytes], decompress: Callable[[bytes], bytes], start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """The bytes ``start`` to ``stop`` of a stream of frames, one frame at a time; frames outside stay compressed."""
    at = 0
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        if at + size > start and (stop is None or at < stop):
            data = decompress(frame)
            yield data[max(0, start - at) : size if stop is None else min(size, stop - at)]
        at += size


def find_marks(frames: list[bytes], marks: tuple[bytes, ...], decompress: Callable[[bytes], bytes]) -> list[int]:
    """Where the marks begin, each one behind the one before it; they may reach over frames."""
    found, held, base = [], b"", 0
    for data in stream(frames, decompress):
        held += data
        while len(found) < len(marks):
            at = held.find(marks[len(found)])
            if at < 0:
                break
            found.append(base + at)
            base, held = base + at + len(marks[0]), held[at + len(marks[0]) :]
        keep = min(len(held), len(marks[0]) - 1)
        base, held = base + len(held) - keep, held[len(held) - keep :]
    return found


def restore(frames: list[bytes], form: str, decompress: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """The text that an output was made from, piece by piece, from output and form alone."""
    if form == "plain":
        yield from stream(frames, decompress)
        return
    marks = MARKS[form]
    begins = find_marks(frames, marks, decompress)
    size = sum(map(zstandard.frame_content_size, frames))
    parts = {m: (b + len(m), e) for m, b, e in zip(marks, begins, [*begins[1:], size], strict=True)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from stream(frames, decompress, *parts[m])


def digest(pieces: Iterator[bytes]) -> str:
    found = hashlib.sha256()
    for piece in pieces:
        found.update(piece)
    return found.hexdigest()


def digest_outputs(made: DataFrame) -> DataFrame:
    """All columns but ``output``, and ``output_sha256, restored_sha256`` of its stream and of the text rebuilt from it."""

    def start():
        decompress = zstandard.ZstdDecompressor().decompress

        def work(outputs, forms):
            return None, [
                [digest(stream(o, decompress)) for o in outputs],
                [digest(restore(o, f, decompress)) for o, f in zip(outputs, forms, strict=True)],
            ]

        return work

    others = [c for c in made.columns if c != "output"]
    rows = made.select(F.struct(*others).alias("row"), "output", "form")
    return map_keyed(rows, start, "output_sha256 string, restored_sha256 string").select("row.*", "output_sha256", "restored_sha256")


def fim_report(docs: DataFrame, config: FimConfig = FimConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store, transform and digest every row; the store is written once to the shared folder."""
    return digest_outputs(fill_in_middle(materialise(store_frames(docs, config, key, text), "frames"), config))
