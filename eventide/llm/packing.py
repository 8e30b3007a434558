"""Bounded-space online packing of token streams."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eventide.llm import blocks


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ids of the byte strings of a plain byte-level BPE whose merges stand in the order of their ids; None for any other model."""
    bpe, cut = model["model"], model.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not model.get("normalizer")
    if not plain or bpe["type"] != "BPE" or any(bpe.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the code points from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    added = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): number for token, number in bpe["vocab"].items() if token not in added}
    made = [bpe["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in bpe["merges"]]
    return ranks if made == sorted(made) else None


class Encoder:
    """Token ids of whole texts by the given tokenizer.

    For a byte-level BPE with merges in the order of its ids the ids are computed by a faster encoder from the
    same vocabulary and word pattern. Texts that hold an added token's string, or a thousand characters without a blank, or half as
    many of white space alone, which that encoder merges in quadratic time, go to the tokenizer itself.
    """

    #: The word pattern of byte-level tokenizers with ``use_regex``.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, model: str, run: int = 1000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        told = json.loads(model)
        self.model, self.run, ranks = Tokenizer.from_str(model), run, _byte_ranks(told)
        self.added = [t["content"] for t in told["added_tokens"]]
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _runs_long(self, text: str) -> bool:
        """Whether some ``run`` characters hold no blank, or half as many nothing but white space. (Steps of half a run: a longer run
        without a blank, or of white space, covers one of the windows.)"""
        at = 0
        while len(text) - at >= self.run:
            blank = text.rfind(" ", at, at + self.run)
            if blank < 0 or text[at : at + self.run // 2].isspace():
                return True
            at = max(blank + 1 - self.run // 2, at + 1)
        return False

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has."""
        out = []
        for text in texts:
            if self.fast is None or any(t in text for t in self.added) or self._runs_long(text):
                out.append(np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self.fast.encode_to_numpy(text, disallowed_special=()))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, len(out))


class _Packer:
    """Open windows of one partition. A piece is (key, start, ids, document tokens)."""

    def __init__(self, size: int, open_windows: int, least_cut: int, base: int):
        self.size, self.most, self.least_cut, self.next = size, open_windows, least_cut, base
        self.windows: list[list] = []  # [gap, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), ids.tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, key, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._emit([(key, start, ids[start : start + self.size], total)])
            start += self.size
        while start < total:
            rest = total - start
            fit = min((w for w in self.windows if w[0] >= rest), key=lambda w: w[0], default=None)
            if fit is None and len(self.windows) < self.most:
                fit = [self.size, []]
                self.windows.append(fit)
            if fit is None:
                fit = min(self.windows, key=lambda w: w[0])
                rest = fit[0] if fit[0] >= self.least_cut else 0
                self._close(fit, (key, start, ids[start : start + rest], total) if rest else None)
            else:
                fit[1].append((key, start, ids[start:], total))
                fit[0] -= rest
                if not fit[0]:
                    self._close(fit)
            start += rest

    def _close(self, window: list, last: tuple | None = None) -> None:
        self.windows = [w for w in self.windows if w is not window]
        self._emit(window[1] + [last] if last else window[1])

    def finish(self) -> None:
        """Merges what is left: full windows first, then the rest in powers of two, which need no
        padding."""
        left = [p for w in sorted(self.windows, key=lambda w: w[0]) for p in w[1]]
        self.windows, rest = [], sum(len(p[2]) for p in left)
        at, used = 0, 0
        while rest:
            room = self.size if rest >= self.size else 1 << (rest.bit_length() - 1)
            rest, pieces = rest - room, []
            while room:
                key, start, ids, total = left[at]
                part = ids[used : used + room]
                pieces.append((key, start + used, part, total))
                room, used = room - len(part), used + len(part)
                if used == len(ids):
                    at, used = at + 1, 0
            self._emit(pieces)


def _run(model, size: int, open_windows: int, least_cut: int, end_id: int) -> Callable:
    schema = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        packer = _Packer(size, open_windows, least_cut, TaskContext.get().partitionId() << 33)
        kind = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], schema, strict=True))], ["k", *(n for n, _ in schema)])

        for batch in batches:
            kind = batch.schema.field("k").type
            offs, _ = blocks.buffers(batch.column("t"))
            for lo, hi in blocks.row_blocks(offs):
                ids, lengths = encoder.encode(batch.column("t").slice(lo, hi - lo).to_pylist())
                ends = np.cumsum(lengths)
                for key, a, b in zip(batch.column("k").slice(lo, hi - lo).to_pylist(), ends - lengths, ends, strict=True):
                    packer.add(key, np.append(ids[a:b], np.uint32(end_id)))
                if packer.rows:
                    yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return run


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 1024,
    open_windows: int = 32, least_cut: int = 8, end_id: int = 0,
) -> DataFrame:
    """Packs all rows into sequences of at most ``size`` tokens, in one pass without a shuffle.

    A row is its token ids and ``end_id``. Each partition keeps at most ``open_windows`` windows
    open. Whole windows of a long row go out at once; its tail goes to the open window it fits best.
    If none fits, the fullest is topped up from the tail and goes out (with fewer than ``least_cut``
    places left it goes out as it is). At the end the partition's leftovers are merged into full
    windows and sequences of a power of two.

    One row per piece: ``key``, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A null text is empty and gives the end id alone. Null and repeated keys keep
    their pieces, in one row per piece. An empty table gives no rows. Other columns are ignored. The
    tokenizer's file is read by the driver and broadcast: its size does not depend on the data.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(
        _run(model, size, open_windows, least_cut, end_id),
        f"k {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return out.withColumnRenamed("k", key)
