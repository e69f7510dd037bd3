"""Fill-in-the-middle over seekable compressed frames.

A text is stored as zstandard frames of ``FRAME_CHARS`` code points that decompress on their own, in archives in the shared
folder; its row carries where the frames are, with the line ends and code points up to the end of each. A cut after k lines
lies in the first frame by whose end there are k line ends: only that frame is decompressed to find the place. An output is
the stored frames in another order, with marks between and the cut frames in part, so it is written out, or hashed, by a
stream that holds one frame at a time; to rebuild the text, such a stream is read for its marks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, new_folder, small_batches, written

FRAME_CHARS = 1 << 15
#: The marks of the three sections, and their order in the two forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_MARK = re.compile("<[PSM]>")

_INDEX = "archive string, offset long, lengths array<long>, lines array<long>, chars array<long>, open boolean, marked boolean"


def store(docs: DataFrame, folder: str, frame_chars: int = FRAME_CHARS, archive_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write the frames of ``docs(doc_id, text)`` into archives under ``folder``; a row for each row of ``docs`` tells where.

    ``offset`` is that of the first frame, ``lengths`` are the frames' bytes, which follow one another; ``lines`` and
    ``chars`` count up to each frame's end; ``open`` is whether text follows the last line end, ``marked`` whether the text
    contains a mark. Archives are named by the task's attempt: one that runs again writes others.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = file_system(folder)
        packer = zstandard.ZstdCompressor(level=level)
        sink, name, at, number = None, "", 0, 0
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                if sink is None:
                    name, at, number = f"frames-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number:04d}.zst", 0, number + 1
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                begun, lengths, lines, chars = at, [], [], []
                for a in range(0, len(text), frame_chars):
                    piece = text[a : a + frame_chars]
                    frame = packer.compress(piece.encode("utf-8"))
                    sink.write(frame)
                    at += len(frame)
                    lengths.append(len(frame))
                    lines.append(piece.count("\n") + (lines[-1] if lines else 0))
                    chars.append(a + len(piece))
                rows.append((doc, name, begun, lengths, lines, chars, bool(text) and text[-1] != "\n", bool(_MARK.search(text))))
                if at >= archive_bytes:
                    sink = sink.close()
            yield pd.DataFrame(rows, columns=["doc_id", "archive", "offset", "lengths", "lines", "chars", "open", "marked"])
        if sink is not None:
            sink.close()

    return docs.select("doc_id", "text").mapInPandas(save, f"doc_id {kind}, {_INDEX}")


class Source:
    """Ranges of the archives of a folder, read ahead in one piece of ``ahead`` bytes."""

    def __init__(self, folder: str, ahead: int = 1 << 20):
        self.fs, self.root = file_system(folder)
        self.ahead, self.name, self.file = ahead, None, None
        self.begun, self.held = 0, b""

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file, self.held = name, self.fs.open_input_file(f"{self.root}/{name}"), b""
        if not self.begun <= offset <= offset + length <= self.begun + len(self.held):
            self.begun, self.held = offset, self.file.read_at(max(length, self.ahead), offset)
            if len(self.held) < length:
                raise ValueError(f"{name} ends within the frame at {offset}")
        return self.held[offset - self.begun : offset - self.begun + length]


class Stored:
    """One stored text."""

    def __init__(self, source: Source, archive: str, offset: int, lengths, lines, chars, open_: bool):
        self.source, self.archive = source, archive
        self.lengths, self.lines, self.chars = list(lengths), list(lines), list(chars)
        self.at = [int(offset)]
        for n in self.lengths:
            self.at.append(self.at[-1] + int(n))
        self.size = int(self.chars[-1]) if self.chars else 0
        self.units = (int(self.lines[-1]) if self.lines else 0) + bool(open_)
        self._unpack = zstandard.ZstdDecompressor()
        self._last = (-1, "")

    def frame(self, i: int) -> str:
        if self._last[0] != i:
            self._last = (i, self._unpack.decompress(self.source.read(self.archive, self.at[i], int(self.lengths[i]))).decode("utf-8"))
        return self._last[1]

    def after(self, units: int) -> int:
        """Code points in the first ``units`` units; at most one frame is decompressed."""
        if units <= 0:
            return 0
        if units >= self.units:
            return self.size
        i = bisect_left(self.lines, units)
        before, start = (int(self.lines[i - 1]), int(self.chars[i - 1])) if i else (0, 0)
        end = next(islice(re.finditer("\n", self.frame(i)), units - before - 1, None))
        return start + end.end()

    def piece(self, start: int, end: int) -> Iterator[str]:
        """The text from ``start`` to ``end``, a frame at a time; other frames are not touched."""
        i = bisect_right(self.chars, start)
        while start < end:
            first = int(self.chars[i - 1]) if i else 0
            stop = min(end, int(self.chars[i]))
            yield self.frame(i)[start - first : stop - first]
            start, i = stop, i + 1


def cuts(doc_id, units: int, seed: int = 7) -> tuple[int, int, int, int]:
    """(units before the middle, units before the suffix, draw of the rate, draw of the form) of a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else int(doc_id)}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((h1 % (units + 1), h2 % (units + 1)))
    return low, high, h3 % 100, h4 % 100


def output(text: Stored, form: str, start: int, end: int) -> Iterator[str]:
    """The output in pieces of a frame at most; ``start`` and ``end`` are those of the middle, in code points."""
    if form == "plain":
        yield from text.piece(0, text.size)
        return
    place = {PREFIX: (0, start), MIDDLE: (start, end), SUFFIX: (end, text.size)}
    for mark in ORDERS[form]:
        yield mark
        yield from text.piece(*place[mark])


def sections(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(mark, text) of an output's pieces, told apart by the marks in them; a mark may lie across pieces."""
    mark, held = "", ""
    for piece in pieces:
        held += piece
        while found := _MARK.search(held):
            yield mark, held[: found.start()]
            mark, held = found[0], held[found.end() :]
        keep = min(len(held), len(PREFIX) - 1)
        yield mark, held[: len(held) - keep]
        held = held[len(held) - keep :]
    yield mark, held


def restored(pieces, form: str) -> Iterator[str]:
    """The text, from the output and its form alone; ``pieces()`` starts the output anew.

    The prefix comes before the middle in either form, so that two readings give prefix, middle and suffix in order.
    """
    if form == "plain":
        yield from pieces()
        return
    yield from (text for mark, text in sections(pieces()) if mark != SUFFIX)
    yield from (text for mark, text in sections(pieces()) if mark == SUFFIX)


def _digest(pieces: Iterable[str]) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece.encode("utf-8"))
    return h.hexdigest()


def _made(index: DataFrame, folder: str, columns: str, of, rate: int, spm: int, seed: int) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` of each stored text and ``of(form, pieces)``, the ``columns``."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    kind = index.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = Source(folder)
        for pdf in batches:
            rows = []
            for doc, name, offset, lengths, lines, chars, open_, marked in pdf[["doc_id", "archive", "offset", "lengths", "lines", "chars", "open", "marked"]].itertuples(index=False):
                text = Stored(source, name, offset, lengths, lines, chars, open_)
                low, high, draw, kind_draw = cuts(None if pd.isna(doc) else doc, text.units, seed)
                form, start, end = "plain", 0, 0
                if text.size and not marked and draw < rate:
                    form, start, end = "spm" if kind_draw < spm else "psm", text.after(low), text.after(high)
                places = (None, None) if form == "plain" else (start, end - start)
                rows.append((doc, text.units, form, *places, *of(form, lambda: output(text, form, start, end))))  # noqa: B023
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", *names])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64", "doc_id": pdf["doc_id"].dtype if len(out) else object})

    return index.mapInPandas(made, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {columns}")


def indexed(docs: DataFrame, folder: str, task_bytes: int = 16 << 20) -> DataFrame:
    """Store ``docs`` and return the written index, dealt into ranges of about ``task_bytes`` of frames, in archive order."""
    index = written(store(docs, folder), "frames")
    held = F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)
    tasks = int(index.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]) // task_bytes + 1
    tasks = max(tasks, docs.sparkSession.sparkContext.defaultParallelism)
    return written(index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset"), "index")


def outputs(index: DataFrame, folder: str, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the texts to train on, of frames stored under ``folder``."""
    return _made(index, folder, "output string", lambda form, pieces: ("".join(pieces()),), rate, spm, seed)


def digests(index: DataFrame, folder: str, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """As ``outputs``, but the SHA-256 sums of each output and of the text rebuilt from it, by streams of frames."""
    of = lambda form, pieces: (_digest(pieces()), _digest(restored(pieces, form)))
    return _made(index, folder, "output_sha256 string, restored_sha256 string", of, rate, spm, seed)


def fill_in_middle(docs: DataFrame, folder: str | None = None, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Store ``docs(doc_id, text)`` as frames and return the digests of their outputs, a row for each row of ``docs``.

    ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``. ``rate`` in a hundred texts are cut,
    ``spm`` in a hundred of these with the suffix first. A null text is an empty one; empty texts and those that contain a
    mark stay plain. Rows that repeat come out each; a row without an id draws as the id ''. An empty table gives no rows.
    Other columns play no part.
    """
    folder = folder or new_folder(docs.sparkSession, "frames")
    return digests(indexed(docs, folder), folder, rate, spm, seed)
