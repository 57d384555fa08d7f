"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's tokens (plus one end id) are cut into full windows and a remainder. Remainders are
packed online: a level array counts the open windows of each fill level, and an item goes to the
level whose choice makes the sum of squared counts smallest (a new window is level 0; completing a
window removes it). When the stream of a task ends, its open windows are dissolved and their
contents cut to fill windows exactly; what is left (under one window) is cut at powers of two,
which need no padding.

Each input partition is packed on its own in one narrow pass: no shuffle, nothing gathered, and a
lost task is simply rerun. Memory per task: one Arrow batch plus the open windows' ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0


class Encoder:
    """Ids of a ``tokenizers`` byte-level BPE file without added special tokens.

    The file's vocabulary and merges order are loaded into ``tiktoken`` (same ids, five times the
    speed); a special token's string in a text becomes its id, as ``Tokenizer.encode`` does. A text
    on which tiktoken's pattern engine gives up goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        self._plain = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        try:
            if any(s in text for s in self._special):
                return self._fast.encode(text, allowed_special="all", disallowed_special=())
            return self._fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the pattern engine panics (not an Exception) at its limit on one very long run
            return self._plain.encode(text, add_special_tokens=False).ids


def _byte_chars() -> dict[str, int]:
    """Printable stand-in of every byte in byte-level BPE files: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Online sum-of-squares packing. Items are (doc, start, doc_tokens, ids); see the module."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)          # open windows per fill level
        self.open: list[list] = [[] for _ in range(window)]   # their contents, per level
        self.next_id = 0

    def _close(self, items: list) -> Iterator[tuple]:
        at, seq = 0, self.next_id
        self.next_id += 1
        for doc, start, total, ids in items:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, at
            at += len(ids)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of the windows that this document completes."""
        w, n = self.window, len(ids)
        for a in range(0, n - n % w, w):
            yield from self._close([(doc, a, n, ids[a:a + w])])
        size = n % w
        if not size:
            return
        item = (doc, n - size, n, ids[n - size:])
        c = self.count
        # change of the sum of squares, halved and without the constant, per level h the item can join
        cost = c[size:w].astype(np.float64) - c[:w - size]    # h -> h + size, 0 < h < w - size
        cost[0] = c[size] - 0.5                               # a new window
        cost[1:][c[1:w - size] == 0] = np.inf                 # no window at that level
        h = int(cost.argmin())
        if c[w - size] and -c[w - size] - 0.5 <= cost[h]:     # completing a window removes it
            c[w - size] -= 1
            yield from self._close([*self.open[w - size].pop(), item])
            return
        items = []
        if h:
            c[h] -= 1
            items = self.open[h].pop()
        c[h + size] += 1
        self.open[h + size].append([*items, item])

    def flush(self) -> Iterator[tuple]:
        """Dissolve the open windows, fullest first, and cut their contents to whole windows."""
        rest = [x for level in reversed(self.open) for items in level for x in items]
        left = sum(len(x[3]) for x in rest)
        self.open, self.count = [[] for _ in range(self.window)], np.zeros(self.window + 1, np.int64)
        items, need = [], 0
        for doc, start, total, ids in rest:
            while len(ids):
                if not need:
                    need = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(need, len(ids))
                items.append((doc, start, total, ids[:take]))
                start, ids, need, left = start + take, ids[take:], need - take, left - take
                if not need:
                    yield from self._close(items)
                    items = []


_COLUMNS = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()), ("offset", pa.int64()))


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows.

    Only doc_id and text are read. Null or empty text: the end id alone. Null doc_ids and repeated
    rows are packed like any other row. sequence_id = partition * 2**40 + number in the partition.
    ``window`` must be a power of two. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(window), TaskContext.get().partitionId() << 40
        encoder = _encoder(path)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            docs_, *rest = zip(*pieces)
            rest[4] = [s + base for s in rest[4]]
            return pa.RecordBatch.from_arrays(
                [pa.array(docs_, arrow_kind), *[pa.array(v, t) for v, (_, t) in zip(rest, _COLUMNS)]],
                ["doc_id", *[n for n, _ in _COLUMNS]])

        arrow_kind = pa.int64()
        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            ids, texts, pieces = batch.column(0).to_pylist(), batch.column(1), []
            for i, doc in enumerate(ids):
                tokens = encoder.encode(texts[i].as_py() or "")
                tokens.append(END_ID)
                pieces += packer.add(doc, np.array(tokens, "<u4"))
                if len(pieces) >= 10_000:
                    yield table(pieces)
                    pieces = []
            if pieces:
                yield table(pieces)
        if pieces := list(packer.flush()):
            yield table(pieces)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n, _ in _COLUMNS))
