"""Sum-of-squares online packing of tokenised documents into windows of fixed size.

Every task packs the documents it reads, in their order, so there is no shuffle and state is one
level array plus the fragments of the windows still open. A document of ``size`` ids or more fills whole
windows by itself; what remains is placed in the fill level whose choice leaves the least sum of squared
counts of partially filled windows. When a task's rows end, its open windows are drained into one another
by cutting, and the last one is cut into power-of-two sequences, which need no padding. So that little is left to that,
input partitions are joined until a task has ``least_docs`` documents or so. At most ``most_open`` windows are open; of lengths that never
fill one another the windows of the level with the most are drained.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, drained boolean, row long"
#: Documents a task, about, where the table has as many; windows open in a task, at most (8 KB each at 2,048 ids).
LEAST_DOCS, MOST_OPEN = 20_000, 8_192
#: Entries of a worker's cache of encoded chunks; beyond it chunks are encoded again. About 100 bytes each.
CACHE = 400_000


class Chunks:
    """Byte-level BPE with a cache of chunks.

    The pattern never joins the two sides of a single space between characters that are not white space, so the ids of a text
    are those of its chunks (each with its leading space) one after another. A text with other uses of the space is encoded
    whole. Texts are split at the tokenizer's added tokens first, as ``tokenizers`` does.
    """

    def __init__(self, path: str):
        import base64
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in json.load(f)["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.core = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        if any(token in text for token in self.added):
            return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.at_added.split(text) if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        chunks = text.split(" ")
        if len(chunks) == 1:
            return self.whole(text)
        cache, found = self.cache, []
        head, *rest = chunks
        if not head or head[-1].isspace():
            return self.whole(text)
        last = len(rest) - 1
        for i, c in enumerate(rest):
            ids = cache.get(c)
            if ids is None:
                if not c or c[0].isspace() or (c[-1].isspace() and i != last):
                    return self.whole(text)
                ids = self.whole(" " + c)
                if len(cache) < CACHE and not c[-1].isspace():
                    cache[c] = ids
            found.append(ids)
        return self.whole(head) + b"".join(found)


class Packer:
    """Windows of one task. ``placed`` holds finished (piece, sequence, offset) rows."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next = size, first_sequence
        self.count = np.zeros(size + 1, np.int64)  # windows open at each fill level; 0 and size stay 0
        self.open: list[list] = [[] for _ in range(size + 1)]  # at each level: lists of fragments
        self.levels = np.zeros(0, np.int64)

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, fragment: tuple, length: int):
        """Put a fragment of below ``size`` ids where the sum of squared counts grows least; yields a window that became full."""
        count, size = self.count, self.size
        levels = np.flatnonzero(count[1 : size - length + 1]) + 1
        best, gain = 0, 2 * count[length] + 1  # a new window
        if len(levels):
            to = levels + length
            delta = np.where(to == size, 1 - 2 * count[levels], 2 + 2 * (count[to] - count[levels]))
            at = len(levels) - 1 - int(np.argmin(delta[::-1]))  # of equals, the fullest
            if delta[at] <= gain:
                best = int(levels[at])
        window = self.open[best].pop() if best else []
        if best:
            count[best] -= 1
        window.append((*fragment, length))
        fill = best + length
        if fill == size:
            return window
        count[fill] += 1
        self.open[fill].append(window)
        return None

    def drain(self, levels=None) -> Iterator[list]:
        """What is open at the levels, joined by cutting: full windows, then at most one that isn't, which stays open; with all levels it is cut into powers of two."""
        queue, fill = [], 0
        for level in range(self.size - 1, 0, -1) if levels is None else levels:
            for window in self.open[level]:
                for key, start, length in window:
                    while fill + length >= self.size:
                        part = self.size - fill
                        queue.append((key, start, part))
                        yield queue
                        queue, fill, start, length = [], 0, start + part, length - part
                    if length:
                        queue.append((key, start, length))
                        fill += length
            self.open[level], self.count[level] = [], 0
        if levels is not None:
            if fill:
                self.count[fill] += 1
                self.open[fill].append(queue)
            return
        while fill:
            part = 1 << (fill.bit_length() - 1)
            took, rest, at = [], [], 0
            for key, start, length in queue:
                here = min(length, part - at)
                if here:
                    took.append((key, start, here))
                if length > here:
                    rest.append((key, start + here, length - here))
                at += here
            yield took
            queue, fill = rest, fill - part


def pack(docs: DataFrame, size: int = 2048, end: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, most_open: int = MOST_OPEN) -> DataFrame:
    """Pack the texts of ``docs`` into sequences of at most ``size`` ids; one row per piece.

    A document is the ids of its text, then ``end``. Pieces of a document have distinct ``start``; the pieces of a sequence are
    gapless from offset 0; ``drained`` pieces were joined by cutting, the others placed by the rule. A null text counts as empty (one id, the end); a null id stays null; repeated rows are packed
    each for itself, told apart by ``row``, a number of the row that is unique over the result; texts of any length are taken whole; an empty table gives an empty result. Of levels that leave equal sums the fullest is taken. Other columns are not read, whatever
    their names. ``sequence_id`` is unique over the result. ``tokenizer``: a file of ``tokenizers`` with the same vocabulary as ranks beside it.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.coalesce(max(1, docs.count() // least_docs))  # joins neighbouring partitions, no shuffle; never more than there are

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = _chunks(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "drained", "row"]
        out: list[tuple] = []
        stop = np.array([end], "<u4").tobytes()
        row = (TaskContext.get().partitionId() << 40) - 1

        def close(window, drained):
            s, at = packer.sequence(), 0
            for (doc, ids, total, before, row), start, length in window:  # of a document only the ids of its last window are held: those from ``before`` on
                x = (start - before) * 4
                out.append((doc, start, length, zlib.crc32(ids[x : x + length * 4]), total, s, at, drained, row))
                at += length

        def flushed():
            cols = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "drained" else pa.int64()) for n, c in zip(names, cols)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row += 1
                ids = encode(text.as_py()) + stop
                total = len(ids) // 4
                at = 0
                while total - at >= size:
                    out.append((doc, at, size, zlib.crc32(ids[at * 4 : (at + size) * 4]), total, packer.sequence(), 0, False, row))
                    at += size
                if at < total:
                    full = packer.place(((doc, ids[at * 4 :], total, at, row), at), total - at)
                    if full:
                        close(full, False)
                    elif packer.count.sum() > most_open:
                        for window in packer.drain([int(np.argmax(packer.count))]):
                            close(window, True)
                if len(out) > 20_000:
                    yield flushed()
        for window in packer.drain():
            close(window, True)
        yield flushed()

    return rows.mapInArrow(run, PIECES)


_CHUNKS: dict[str, Chunks] = {}


def _chunks(path: str) -> Chunks:
    """One encoder, and so one cache, for each Python worker."""
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]
