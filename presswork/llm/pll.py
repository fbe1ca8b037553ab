"""LM scoring by masked pseudo-likelihood.

Every token is predicted from the two tokens on each side of it by a small window network, and a document's score is the sum
of these conditional log-probabilities. A token is a lower-cased word, hashed into ``BUCKETS``. Its probability has two factors: the network
gives that of its class, and the corpus counts that of the bucket within the class; together they sum to 1 over all buckets. The
most frequent buckets have classes of their own, the others share the rest by hash.

Texts are cut into tokens once, and the checkpointed buckets serve all three passes. Counts cover all documents: each task adds up its buckets, so the
arrays have a fixed size. All windows of all documents train: each task makes one pass of minibatch descent in numpy over the windows of its own texts,
with no shuffle of text or windows, and the copies are averaged, weighted by their windows. Averaging goes by a tree of sums, each of ``GROUPS``
networks or so, so no task adds up more than that and the driver gets ``GROUPS`` sums, of a size that depends on neither rows nor vocabulary.
The networks of other partitions would be other ones: scores repeat for the same files read in the same splits.

Nulls and edges: null texts and texts without words have no tokens and score 0; repeated rows score alike; very long texts are
trained on and scored in pieces with their neighbours; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm.common import give_back, table
from presswork.session import checkpoint

BUCKETS, CLASSES, SHARED = 1 << 18, 128, 16
SIDE, EMBEDDINGS, WIDTH, HIDDEN = 2, 1 << 13, 16, 32
#: Windows of a step, the first rate, after how many windows of a task it is halved, and sums that reach the driver.
BATCH, RATE, HALVED, GROUPS = 1024, 0.4, 2_000_000, 16
#: Windows that are made and mixed together, about.
TOGETHER = 1 << 17
_PIECE, _PAD = 1 << 16, BUCKETS


# --- tokens -------------------------------------------------------------------------------------------------------------


def _bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS


def tokens(texts: pa.Array) -> list[np.ndarray]:
    """Buckets of each text's words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for blank in "\n\t\r\v\f":
        texts = pc.replace_substring(texts, blank, " ")
    lists = pc.split_pattern(pc.utf8_lower(texts), " ")
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    known = np.fromiter((_bucket(w) if w else -1 for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
    ids = known[coded.indices.to_numpy(zero_copy_only=False)]
    offsets = lists.offsets.to_numpy()
    ids_at = [ids[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:])]
    return [x[x >= 0] for x in ids_at]


def contexts(ids: np.ndarray) -> np.ndarray:
    """The neighbours of each token, ``_PAD`` beyond the ends."""
    padded = np.concatenate([np.full(SIDE, _PAD), ids, np.full(SIDE, _PAD)]).astype(np.int64)
    return np.stack([padded[SIDE + d : SIDE + d + len(ids)] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _rows(buckets: np.ndarray) -> np.ndarray:
    """Rows of the embedding: buckets folded, padding last."""
    return np.where(buckets == _PAD, EMBEDDINGS, buckets & (EMBEDDINGS - 1))


# --- the network --------------------------------------------------------------------------------------------------------

_SHAPES = [(EMBEDDINGS + 1, WIDTH), (2 * SIDE, WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]


def initial() -> np.ndarray:
    rng = np.random.default_rng(0)
    scales = (0.3, (2 * SIDE * WIDTH) ** -0.5, 0.0, HIDDEN**-0.5, 0.0)
    return np.concatenate([(rng.standard_normal(s) * k).ravel() for s, k in zip(_SHAPES, scales)]).astype(np.float32)


def _unpacked(weights: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(weights[at : at + n].reshape(shape))
        at += n
    return out


def train_steps(weights: np.ndarray, windows: np.ndarray, classes: np.ndarray, rate: float) -> np.ndarray:
    """One pass of minibatch descent over windows (center, then contexts); returns new weights."""
    weights = weights.astype(np.float32).copy()
    e, w1, b1, w2, b2 = _unpacked(weights)
    flat = w1.reshape(-1, HIDDEN)
    for at in range(0, len(windows), BATCH):
        part = windows[at : at + BATCH]
        n, want, rows = len(part), classes[part[:, 0]], _rows(part[:, 1:])
        x = e[rows].reshape(n, -1)
        h = np.tanh(x @ flat + b1)
        z = h @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), want] -= 1
        z *= rate / n
        back = (z @ w2.T) * (1 - h * h)
        to_x = back @ flat.T * 8
        w2 -= h.T @ z
        b2 -= z.sum(axis=0)
        flat -= x.T @ back
        b1 -= back.sum(axis=0)
        np.subtract.at(e.reshape(-1), (rows[:, :, None] * WIDTH + np.arange(WIDTH)).ravel(), to_x.ravel())  # one dimension, as that is fast
    return weights


class Scorer:
    """Log-probabilities of tokens given both sides, from weights and corpus counts."""

    def __init__(self, weights: np.ndarray, counts: np.ndarray):
        e, w1, self.b1, self.w2, self.b2 = _unpacked(weights.astype(np.float32))
        self.first = np.stack([e @ w1[p] for p in range(2 * SIDE)])  # the first layer per side is a table
        self.classes = classes_of(counts)
        smooth = counts.astype(np.float64) + 1
        self.within = np.log(smooth / np.bincount(self.classes, weights=smooth, minlength=CLASSES)[self.classes])

    def log_probabilities(self, centers: np.ndarray, sides: np.ndarray) -> np.ndarray:
        rows = _rows(sides)
        h = self.first[0][rows[:, 0]] + self.b1
        for p in range(1, 2 * SIDE):
            h += self.first[p][rows[:, p]]
        z = np.tanh(h, out=h) @ self.w2 + self.b2
        top = z.max(axis=1)
        want = self.classes[centers]
        own = z[np.arange(len(z)), want] - top
        z -= top[:, None]
        return own - np.log(np.exp(z, out=z).sum(axis=1)) + self.within[centers]

    def document(self, ids: np.ndarray) -> float:
        total = 0.0
        for at in range(0, len(ids), _PIECE):
            low, high = max(0, at - SIDE), min(len(ids), at + _PIECE + SIDE)
            sides = contexts(ids[low:high])[at - low : at - low + _PIECE]
            total += float(self.log_probabilities(ids[at : at + _PIECE].astype(np.int64), sides).sum(dtype=np.float64))
        return total


def classes_of(counts: np.ndarray) -> np.ndarray:
    """A class of its own for each of the most frequent buckets (ties to the smaller), the others by remainder."""
    own = CLASSES - SHARED
    out = (own + np.arange(len(counts)) % SHARED).astype(np.int64)
    out[np.lexsort((np.arange(len(counts)), -counts))[:own]] = np.arange(own)
    return out


# --- over the corpus ----------------------------------------------------------------------------------------------------


def coded(docs: DataFrame) -> DataFrame:
    """``doc_id, ids`` of every row: the buckets of its words, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(tokens(part["text"]), pa.list_(pa.int32()))], ["doc_id", "ids"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return checkpoint(rows.mapInArrow(run, "doc_id long, ids array<int>"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(batch["ids"].flatten().to_numpy(), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])


def _counts(codes: DataFrame) -> np.ndarray:
    held = codes.select("ids").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[held["bucket"].to_numpy()] = held["n"].to_numpy()
    return out


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    return _counts(coded(docs))


def windows(ids: np.ndarray) -> np.ndarray:
    """Each token with its neighbours: center first, then contexts."""
    return np.concatenate([ids[:, None].astype(np.int64), contexts(ids)], axis=1)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All windows of all texts, about ``TOGETHER`` at a time; a long text is cut into pieces that see their neighbours."""
    held: list[np.ndarray] = []
    seen = 0
    for batch in batches:
        for ids in _lists(batch["ids"]):
            for at in range(0, len(ids), _PIECE):
                low = max(0, at - SIDE)
                held.append(windows(ids[low : at + _PIECE + SIDE])[at - low : at - low + _PIECE])
                seen += len(held[-1])
                if seen >= TOGETHER:
                    yield np.concatenate(held)
                    held, seen = [], 0
    if held:
        yield np.concatenate(held)


def fit(weights: np.ndarray, portions: Iterator[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, int]:
    """One pass over portions of windows, each mixed in an order that reruns repeat; new weights and the number of windows."""
    seen = 0
    for rows in portions:
        rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))]
        weights = train_steps(weights, rows, classes, RATE / (1 + seen / HALVED))
        seen += len(rows)
    return weights, seen


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the networks of a task, each times its windows."""
    total, seen, low = np.zeros(len(initial())), 0, None
    for batch in batches:
        for part, n, w in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), batch["w"]):
            total += np.frombuffer(w.as_py(), dtype=np.float64)
            seen += n
            low = part if low is None else min(low, part)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([seen]), pa.array([total.tobytes()])], ["part", "n", "w"])


def _train(codes: DataFrame, counts: np.ndarray) -> np.ndarray:
    classes, start = codes.sparkSession.sparkContext.broadcast(classes_of(counts)), initial()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        mine, n = fit(start, _portions(batches), classes.value)
        if n:
            sums = n * mine.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId() if context else 0]), pa.array([n]), pa.array([sums.tobytes()])], ["part", "n", "w"])
        give_back()

    schema = "part long, n long, w binary"
    sums, width = codes.select("ids").mapInArrow(run, schema), codes.rdd.getNumPartitions()
    while width > 1:  # a level of the tree
        width = -(-width // GROUPS)
        sums = sums.repartition(max(width, GROUPS), "part").sortWithinPartitions("part").mapInArrow(_add, schema)
        if width <= GROUPS:
            break
    held = sums.toArrow()  # at most GROUPS rows
    seen = sum(held["n"].to_pylist())
    if not seen:
        return start
    # by part, so that the order of arrival doesn't matter
    parts = sorted(zip(held["part"].to_pylist(), held["w"].to_pylist()))
    return (sum(np.frombuffer(w, dtype=np.float64) for _, w in parts) / seen).astype(np.float32)


def train(docs: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Weights of the network, averaged over tasks that together see every window of every document."""
    return _train(coded(docs), counts)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, per_token`` of every row."""
    codes = coded(docs)
    counts = _counts(codes)
    shared = docs.sparkSession.sparkContext.broadcast((_train(codes, counts), counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            all_ids = _lists(batch["ids"])
            sums = [scorer.document(ids) for ids in all_ids]
            n = [len(ids) for ids in all_ids]
            mean = [s / k if k else 0.0 for s, k in zip(sums, n)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "pseudo_log_likelihood", "per_token"])

    return codes.mapInArrow(run, "doc_id long, n_tokens long, pseudo_log_likelihood double, per_token double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
