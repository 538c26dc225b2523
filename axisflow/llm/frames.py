"""Fill-in-middle texts over seekable compressed frames.

A text is kept as independent zstandard frames with cumulative counts of code points and bytes. A cut opens only the
frame it falls into; frames between cuts move as they are, compressed. Digests stream the frames in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put

UNITS = 65_536    # code points of a frame
LEVEL = 3
MARKERS = ("<P>", "<S>", "<M>")
#: Order of the parts behind their markers.
ORDERS = {"psm": "PSM", "spm": "SPM"}
PLAIN_SHARE, SPM_SHARE = 90, 20  # of a hundred: from where a text stays plain; below which the suffix comes first


class Frames:
    """Compressed frames one after the other, with the code points and bytes up to the end of each."""

    def __init__(self, blob: bytes = b"", unit_ends=(), byte_ends=()):
        self.blob, self.unit_ends, self.byte_ends = blob, [int(x) for x in unit_ends], [int(x) for x in byte_ends]

    @classmethod
    def of(cls, text: str, units: int = UNITS) -> "Frames":
        return cls.joined(cls.packed(text[i:i + units]) for i in range(0, len(text), units))

    @staticmethod
    def packed(text: str) -> tuple[int, bytes]:
        return len(text), zstandard.ZstdCompressor(level=LEVEL).compress(text.encode())

    @classmethod
    def joined(cls, parts) -> "Frames":
        made, n, size, blobs = cls(), 0, 0, []
        for units, blob in parts:
            if units:
                n, size = n + units, size + len(blob)
                made.unit_ends.append(n)
                made.byte_ends.append(size)
                blobs.append(blob)
        made.blob = b"".join(blobs)
        return made

    @property
    def n(self) -> int:
        return self.unit_ends[-1] if self.unit_ends else 0

    def raw(self, i: int) -> bytes:
        return bytes(self.blob[self.byte_ends[i - 1] if i else 0:self.byte_ends[i]])

    def text(self, i: int) -> str:
        return zstandard.ZstdDecompressor().decompress(self.raw(i)).decode()

    def _within(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first and last cut inside it) of the frames that a range touches, found by bisection."""
        from bisect import bisect_right
        i = bisect_right(self.unit_ends, start)
        while i < len(self.unit_ends) and start < end:
            first = self.unit_ends[i - 1] if i else 0
            yield i, max(start - first, 0), min(end, self.unit_ends[i]) - first
            start, i = self.unit_ends[i], i + 1

    def select(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """The range as frames: whole ones as they are, cut ones decompressed, cut and compressed again."""
        for i, a, b in self._within(start, end):
            size = self.unit_ends[i] - (self.unit_ends[i - 1] if i else 0)
            yield (size, self.raw(i)) if (a, b) == (0, size) else self.packed(self.text(i)[a:b])

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[str]:
        """The texts of a range, one frame at a time."""
        for i, a, b in self._within(start, self.n if end is None else end):
            yield self.text(i)[a:b]


def digest(*streams: Iterator[str]) -> str:
    done = hashlib.sha256()
    for stream in streams:
        for part in stream:
            done.update(part.encode())
    return done.hexdigest()


def rearranged(text: Frames, form: str, first: int, second: int) -> Frames:
    """The output of a text that is cut after ``first`` and ``second`` code points."""
    if form == "plain":
        return text
    cuts = {"P": (0, first), "M": (first, second), "S": (second, text.n)}

    def parts():
        for part in ORDERS[form]:
            yield Frames.packed(f"<{part}>")
            yield from text.select(*cuts[part])
    return Frames.joined(parts())


def part_ranges(output: Frames, form: str) -> dict[str, tuple[int, int]]:
    """Where the parts of an output lie, found by reading it for the three markers in the form's order.

    A marker may lie across frames, so the last two code points of a frame are read again with the next one. The text
    itself holds no marker, and none can arise where text and marker meet.
    """
    order, starts, ends = ORDERS[form], [], []
    kept, at, base = "", 0, 0  # what is read again, where to look in it, place of its first code point
    for part in output.stream():
        kept += part
        while len(starts) < 3:
            found = kept.find(f"<{order[len(starts)]}>", at)
            if found < 0:
                break
            if starts:
                ends.append(base + found)
            starts.append(base + found + 3)
            at = found + 3
        cut = max(at, len(kept) - 2)
        base, kept, at = base + cut, kept[cut:], 0
        if len(starts) == 3:
            break
    return dict(zip(order, zip(starts, [*ends, output.n])))


def restored(output: Frames, form: str) -> str:
    """Digest of the text rebuilt from an output and its form alone."""
    if form == "plain":
        return digest(output.stream())
    where = part_ranges(output, form)
    return digest(*[output.stream(*where[p]) for p in "PMS"])


FRAMES = "n long, marked boolean, unit_ends array<long>, byte_ends array<long>, frames binary"
RESULT = "output_sha256 string, restored_sha256 string, unit_ends array<long>, byte_ends array<long>, frames binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _stored(text: Column, units: int) -> Column:
    @F.pandas_udf(FRAMES)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for x in texts:
                x = x or ""
                f = Frames.of(x, units)
                out.append((f.n, any(m in x for m in MARKERS), f.unit_ends, f.byte_ends, f.blob))
            yield pd.DataFrame(out, columns=_names(FRAMES))
    return run(text)


def frame_store(docs: DataFrame, text_col: str = "text", units: int = UNITS) -> DataFrame:
    """``docs`` with the text replaced by its frames: n, marked (holds a marker), unit_ends, byte_ends and frames.

    The table can be written as it is; ``units`` code points make a frame. A null or empty text has no frames and n 0.
    Columns with the new names give way, an empty table gives an empty table.
    """
    text = next(c for c in docs.columns if c.lower() == text_col.lower())
    names = _names(FRAMES)
    rest = [c for c in docs.columns if c != text and c.lower() not in names]
    made = docs.withColumn("_stored", _stored(F.col(f"`{text}`"), units))
    return made.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"_stored.{n}") for n in names])


def _transformed(*columns: Column) -> Column:
    @F.pandas_udf(RESULT)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            out = []
            for blob, unit_ends, byte_ends, form, first, second in zip(*batch):
                made = rearranged(Frames(blob, unit_ends, byte_ends), form, first, second)
                out.append((digest(made.stream()), restored(made, form), made.unit_ends, made.byte_ends, made.blob))
            yield pd.DataFrame(out, columns=_names(RESULT))
    return run(*columns)


def _group(doc_id: Column, i: int) -> Column:
    """The i-th group of eight digits of the digest of an id, as an unsigned number."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(name, 8 * i - 7, 8), 16, 10).cast("long")


def fill_in_middle(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``frame_store`` gave, with form, prefix_chars, middle_chars, output_sha256, restored_sha256, and the output as frames.

    The id alone decides on form and cuts, so retries and partitions change nothing. A null id counts as an empty one,
    rows that repeat an id are cut at places of their own length. Empty texts and texts with a marker stay plain.
    Columns with the new names give way; an empty table gives an empty table.
    """
    doc_id = F.col(f"`{next(c for c in stored.columns if c.lower() == id_col.lower())}`")
    h = [_group(doc_id, i) for i in range(1, 5)]
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= PLAIN_SHARE), "plain").when(h[3] % 100 < SPM_SHARE, "spm").otherwise("psm")
    cut = put(stored, form=form, _first=F.least(a, b), _second=F.greatest(a, b))
    made = cut.withColumn("_made", _transformed(*[F.col(c) for c in ("frames", "unit_ends", "byte_ends", "form", "_first", "_second")]))
    shown = F.col("form") != "plain"
    added = {"prefix_chars": F.when(shown, F.col("_first")), "middle_chars": F.when(shown, F.col("_second") - F.col("_first")),
             **{n: F.col(f"_made.{n}") for n in _names(RESULT)}}
    rest = [c for c in stored.columns if c.lower() not in (*_names(RESULT), "form", "prefix_chars", "middle_chars")]
    return made.select(*[F.col(f"`{c}`") for c in rest], "form", *[v.alias(k) for k, v in added.items()])
