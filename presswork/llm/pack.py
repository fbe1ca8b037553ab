"""Packing by vector bin packing.

Examples are placed into sequences under simultaneous limits on tokens, segments and loss-bearing tokens. Every task keeps
a bounded pool of open sequences. A piece goes where the dot product of its demands and a sequence's free capacities, each
relative to its limit, is largest; whole sequences are cut off long examples first. If no open sequence can hold the piece and the
pool is full, the fullest one is topped up with a part cut from the piece and closed. At a task's end, what is open is
laid end to end and cut anew, so a task leaves at most one short sequence behind, unless another limit than tokens binds.

Instruction data: with a ``prompt`` column an example is its prompt's ids, then its text's ids and the closing id, and only the latter two bear
loss. ``instruction_examples`` makes such rows from conversations.

No row leaves its task: there is no shuffle, and memory is one batch, about ``SLICE_BYTES`` of text being tokenized, and the pool. Sequence numbers hold the task's number in their
upper bits. A retry repeats them, because a task reads the same rows in the same order.

Nulls and edges: a null text is empty and has just the closing id; null or repeated doc_ids are ordinary rows; an empty
table gives no rows; other columns are ignored. Examples longer than a sequence are cut, never dropped. Of sequences with equal products the
one opened first takes the piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm.common import give_back, slices, table
from presswork.llm.tokens import encode

TOKENS, SEGMENTS, END_ID = 2048, 512, 1
#: Sequences that a task keeps open.
POOL = 64
#: Bytes of text that are tokenized together; a longer text is taken alone.
SLICE_BYTES = 3 << 20
TOKENIZER = "word_bpe_49k.json"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Packer:
    """Places pieces of examples; ``close(sequence)`` gets each finished list of pieces ``(tokens, loss, *payload)``."""

    def __init__(self, close: Callable[[list[tuple]], None], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL):
        self.close, self.limits, self.pool = close, np.array([tokens, segments, tokens if loss is None else loss], dtype=np.float64), pool
        self.free = np.zeros((0, 3))
        self.open: list[list[tuple]] = []

    def _shut(self, k: int) -> None:
        self.close(self.open.pop(k))
        self.free = np.delete(self.free, k, axis=0)

    def _put(self, k: int, piece: tuple) -> None:
        self.open[k].append(piece)
        self.free[k] -= (piece[0], 1, piece[1])
        if (self.free[k] <= 0).any():
            self._shut(k)

    def add(self, piece: tuple, cut: Callable[[tuple, int], tuple[tuple, tuple]]) -> None:
        """Place a piece. ``cut(piece, n)`` gives the longest first part within n tokens and the rest."""
        full = self.limits
        while piece[0] > full[0] or piece[1] > full[2]:
            n = int(full[0])
            head, rest = cut(piece, n)
            while head[1] > full[2]:
                n = max(1, int(n * full[2] / head[1]) if n > 1 else 1)
                head, rest = cut(piece, n) if n < piece[0] else (head, rest)
                if n == 1:
                    break
            self.close([head])
            piece = rest
        while piece[0]:
            need = np.array([piece[0], 1, piece[1]], dtype=np.float64)
            fits = (self.free >= need).all(axis=1) if len(self.open) else np.zeros(0, dtype=bool)
            if fits.any():
                score = np.where(fits, (self.free / full) @ (need / full), -1)
                return self._put(int(score.argmax()), piece)
            if len(self.open) < self.pool:
                self.open.append([])
                self.free = np.vstack([self.free, full])
                return self._put(len(self.open) - 1, piece)
            k = int(self.free[:, 0].argmin())
            head, rest = cut(piece, int(self.free[k, 0]))
            if head[1] <= self.free[k, 2]:
                self._put(k, head)
                piece = rest
            else:
                self._shut(k)

    def flush(self, cut: Callable[[tuple, int], tuple[tuple, tuple]]) -> None:
        """Lay all open pieces end to end and close them."""
        left = [p for s in self.open for p in s]
        self.open, self.free = [], np.zeros((0, 3))
        free, now = self.limits.copy(), []
        while left:
            piece = left.pop()
            head, rest = cut(piece, int(free[0])) if piece[0] > free[0] else (piece, None)
            if head[1] > free[2] and now:
                left.append(piece)
            else:
                now.append(head)
                free -= (head[0], 1, head[1])
                if rest:
                    left.append(rest)
                if (free > 0).all():
                    continue
            self.close(now)
            free, now = self.limits.copy(), []
        if now:
            self.close(now)


def _cut_ids(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """Cut a piece ``(tokens, loss, row, start, ids, doc tokens)``; its first ``tokens - loss`` ids bear no loss."""
    tokens, loss, row, start, ids, total = piece
    bare = min(tokens - loss, n)
    return (n, n - bare, row, start, ids[:n], total), (tokens - n, loss - (n - bare), row, start + n, ids[n:], total)


def packer(path: str, tokens: int, segments: int, loss: int | None, prompts: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, made, out = (context.partitionId() if context else 0) << 32, 0, []

        def close(pieces: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for n, bears, row, start, ids, total in pieces:
                out.append((row, start, n, zlib.crc32(ids.tobytes()), total, base + made, offset, bears))
                offset += n
            made += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(_NAMES)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)

        p = Packer(close, tokens, segments, loss)
        give_back()
        for part in slices(batches, "text", SLICE_BYTES):
            ids, ends = encode(part["text"], path, END_ID)
            bare = np.zeros(len(ends), dtype=np.int64)
            if prompts:
                heads, head_ends = encode(part["prompt"], path)
                bare = np.diff(head_ends, prepend=0)
                ids, ends = np.insert(ids, np.repeat(np.concatenate([[0], ends[:-1]]), bare), heads), ends + head_ends
            ids, start = ids.astype("<u4", copy=False), 0
            for doc, end, without in zip(part["doc_id"].to_pylist(), ends.tolist(), bare.tolist()):
                n = end - start
                # a copy keeps only this piece's ids alive while it waits
                p.add((n, n - without, doc, 0, ids[start:end].copy(), n), _cut_ids)
                start = end
            del ids
            give_back()
            if len(out) > 10_000:
                yield rows()
        p.flush(_cut_ids)
        yield rows()
        give_back()

    return pack_task


def pack(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens``.

    ``prompt`` names a column of text in front of each text that bears no loss; without it all ids bear loss.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompt is not None:
        columns.append(F.col(prompt).cast("string").alias("prompt"))
    schema = ", ".join(f"{name} long" for name in _NAMES)
    return docs.select(*columns).mapInArrow(packer(path or tokenizer_path(), tokens, segments, loss, prompt is not None), schema)


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """``(doc_id, turn, prompt, text)``: each assistant turn with the turn before it.

    An equi-join on (conversation, turn), so a conversation of any length is spread over tasks. Of repeated turns the smallest text is the
    prompt; a turn without a predecessor has a null prompt; turns with a null conversation or number have no prompt either.
    """
    before = conversations.groupBy(F.col("conv_id").alias("_pw_conv"), (F.col("turn") + 1).alias("_pw_turn")).agg(F.min("text").alias("prompt"))
    own = conversations.where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return own.join(before, (F.col("doc_id") == F.col("_pw_conv")) & (F.col("turn") == F.col("_pw_turn")), "left").select("doc_id", "turn", "prompt", "text")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
