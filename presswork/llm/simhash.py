"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Two fingerprints that differ in few bits are
found on *views*, subsets of the bits: each fingerprint emits, for every view, all variants of its bits there within half of the
view's radius (2, so 1 flip); rows are shuffled by variant; fingerprints that meet are verified in full; repeated links are
dropped. With radius 3 on 64 bits, three views of two of three 21-bit blocks suffice: of any three differing bits, two of the blocks
hold at most two, so no link is missed. A whole-word ball of radius 2 would take 2081 variants a fingerprint; this takes 132.

Only distinct fingerprints are linked, so copies never meet. In a bucket of many fingerprints links are not found by pairs:
what shares its residual (the bits outside the view) or differs there in one bit is within 3 in any case, as all are within
2 in the view; and what is equal in the view and differs in three residual bits is looked up in a table of the residuals. Each
bucket gives a star for each of its groups, no more rows than it has. Components come from the links (``operators.graph``).

``op4_simhash_dedup`` and ``keep_first``, the pipeline's stage, go by these components. ``near_duplicates``, which no registered query uses, does
without fingerprints: it links texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, exactly. Two such sets share one of the first n - ceil(0.8 n) + 1 shingles of each, in any common order (prefix filter), so
all pairs that share one and pass bounds on sizes and positions are candidates, and each candidate is verified on the whole sets. In that order
shingles that a sample shows to be frequent come last, which makes buckets small; no link depends on the sample. Equal sets are one vertex.
Candidates are verified in two rounds: first at most ``FIRST`` a set, whose links give components; then all candidates between different
components. So a large group of edited copies is not compared pair by pair, and no component is missed. The first round looks only at the ``LEADING``
smallest shingles of each set, frequent or not, which near sets mostly share, so its candidates grow with the sets; the second looks at all buckets in which components meet. Of those with more than
``CELL`` rows the largest component and the rest are dealt in parts, and a task compares two parts, never two of the largest component. Each row there carries a short parity sketch, and pairs that it rejects never leave their bucket.
Each round then compares whole parity sketches: a set of n has at least n bits, the k-th being the parity of how many shingles fall on k. Each shingle that only one of two sets has
flips one bit, so two sketches never differ in more bits than the sets differ in shingles; a pair whose sketches differ in more than similarity
0.8 allows is no link, and only the pairs that remain fetch whole sets.

Nulls and edges: a null text and a text without words have the fingerprint 0, linked like any other; fewer words than a
shingle takes make one shingle; repeated rows share a fingerprint; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm.common import BROADCAST_IDS, broadcast_if_small, give_back, joined_on_hot, numbered, slices, table, without
from presswork.operators.graph import connected_components
from presswork.session import checkpoint

SEED = 42
SHINGLE, RADIUS = 3, 3
SHINGLE_WIDE = 5
#: Rows whose shingles are counted to find frequent ones, the least count there, and how many are kept at most.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 10_000, 4, 100_000
#: Candidates of a set in the first round, and how many of its shingles are looked up there.
FIRST, LEADING = 24, 8
#: Words of the short sketch that goes with a row into its buckets.
SHORT = 4
#: Rows of a bucket that one task compares with each other; larger buckets are dealt in parts of about this size.
CELL = 4096
#: Tasks over which the bucket of a frequent shingle is dealt in the first round.
SALTS = 64
#: Buckets up to this size are compared pair by pair.
SMALL = 16
_ONES = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- fingerprints -------------------------------------------------------------------------------------------------------

#: For each byte, its bits in eight 8-bit lanes, so that up to 255 bytes can be added up in one 64-bit word.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of each run of ``size`` lower-cased words, repeats included; of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and ASCII white space count
    if not words:
        return []
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w) + 1
        ends.append(at - 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])]


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits of the same shingles (the finaliser of splitmix64); word 0 is the hash itself."""
    if not word:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * word) & _ONES)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` hashes, the word of bits set in over half of a run; 0 for empty runs."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    runs = counts[full]
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    pieces = -(-runs // 255)
    owner = np.repeat(np.arange(len(runs)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, first[owner] + 255 * nth, axis=0)
    bits = np.ascontiguousarray(sums).astype("<u8").view(np.uint8).astype(np.int64)
    bits = np.add.reduceat(bits, np.cumsum(pieces) - pieces, axis=0)
    set_ = bits * 2 > runs[:, None]
    out[full] = np.packbits(set_.astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(size: int, words: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *[f"w{k}" for k in range(words)]]
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                lists = [shingle_hashes(t, size) for t in part["text"].to_pylist()]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
                made = [majorities(_mixed(hashes, k), counts).view(np.int64) for k in range(words)]
                yield pa.RecordBatch.from_arrays([part[key], *[pa.array(m) for m in made]], names)
            give_back()

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, words: int = 1, key: str = "doc_id") -> DataFrame:
    """``key`` and the fingerprint's 64-bit words ``w0``, ``w1``, ... as longs."""
    schema = f"{key} long, " + ", ".join(f"w{k} long" for k in range(words))
    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(_fingerprint_batches(size, words, key), schema)


# --- links --------------------------------------------------------------------------------------------------------------


def _variants(views: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """``(view, word, mask, flip)`` of every variant within one flip; a view is a word's number and the mask of its bits."""
    return [
        (v, word, _signed(mask), _signed(flip))
        for v, (word, mask) in enumerate(views)
        for flip in (0, *(1 << b for b in range(64) if mask >> b & 1))
    ]


#: Views of 64 bits for radius 3: two of the three blocks of bits 0-20, 21-41 and 42-63.
_BLOCKS = ((1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42)
EXACT_VIEWS = [(0, _ONES ^ b) for b in _BLOCKS]

def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _distance(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(_pop(fps[i, k] ^ fps[j, k]).astype(np.int64) for k in range(fps.shape[1]))


def _exact_links(fps: np.ndarray, key: int, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one large bucket of the exact views, as stars: indices of members and of what they are linked to."""
    own = fps[:, 0]
    rest_mask = np.uint64(_ONES ^ mask)
    low = (mask ^ _ONES) & -(mask ^ _ONES)
    residual = ((own & rest_mask) // np.uint64(low)).astype(np.int64)
    heads, first, which = np.unique(residual, return_index=True, return_inverse=True)
    yield np.arange(len(own)), first[which]
    width = bin(mask ^ _ONES).count("1")
    at = np.full(1 << width, -1, dtype=np.int32)
    at[heads] = first
    for b in range(width):
        there = at[heads ^ (1 << b)]
        yield first[there >= 0], there[there >= 0]
    centre = np.flatnonzero((own & np.uint64(mask)) == np.uint64(key & _ONES))
    if len(centre) > 1:
        at[:] = -1
        at[residual[centre]] = centre
        for bits in combinations(range(width), 3):
            there = at[residual[centre] ^ sum(1 << b for b in bits)]
            yield centre[there >= 0], there[there >= 0]


def _find_links(n_ids: int, radius: int, views: list[tuple[int, int]]):
    """Reads rows (view, key, id, words) in order of view and key; yields links of ids."""

    def links(view: np.ndarray, key: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], (view[1:] != view[:-1]) | (key[1:] != key[:-1])]))
        length = np.diff(np.append(start, len(key)))
        left, right = [], []
        rank = np.arange(len(key)) - np.repeat(start, length)
        remain = np.repeat(length, length) - rank
        small = np.repeat(length <= SMALL, length)
        for s in range(1, min(SMALL, int(length.max(initial=1)))):
            i = np.flatnonzero(small & (remain > s))
            if not len(i):
                break
            ok = _distance(fps, i, i + s) <= radius
            left.append(i[ok])
            right.append(i[ok] + s)
        for at, n in zip(start[length > SMALL], length[length > SMALL]):
            part = fps[at : at + n]
            for i, j in _exact_links(part, int(key[at]), views[int(view[at])][1]):
                left.append(at + i)
                right.append(at + j)
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
        a, b = ids[i], ids[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [f"w{k}" for k in range(n_ids)]
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            view, key, ids = (rows[c].to_numpy() for c in ("view", "key", "id"))
            fps = np.stack([rows[w].to_numpy().view(np.uint64) for w in words], axis=1)
            a, b = links(view, key, ids, fps)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = (batch["view"][-1].as_py(), batch["key"][-1].as_py())
            # wait until the last bucket of what is held has surely ended
            if sum(x.num_rows for x in held) < 100_000 or (batch["view"][0].as_py(), batch["key"][0].as_py()) == last:
                continue
            rows = pa.Table.from_batches(held)
            view, key = rows["view"].to_numpy(), rows["key"].to_numpy()
            cut = int(np.flatnonzero((view != last[0]) | (key != last[1]))[-1]) + 1
            yield done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))
        give_back()

    return run


def links(fps: DataFrame, words: int, radius: int, views: list[tuple[int, int]]) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints ``(id, w0, ...)`` that differ in at most ``radius`` bits."""
    names = [f"w{k}" for k in range(words)]
    emitted = F.inline(F.array(*[F.struct(F.lit(v).cast("byte").alias("view"), F.lit(w).alias("word"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip")) for v, w, m, f in _variants(views)]))
    word = F.col("w0") if words == 1 else F.element_at(F.array(*names), F.col("word") + 1)
    rows = (
        fps.select("id", *names, emitted)
        .select("view", word.bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), "id", *names)
        .repartition("view", "key")
        .sortWithinPartitions("view", "key", "id")
    )
    return rows.mapInArrow(_find_links(words, radius, views), "src long, dst long")


def components(fps: DataFrame, words: int = 1, radius: int = RADIUS, views: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(doc_id, w0.., component_id)``: the smallest doc_id reachable over links; copies of a fingerprint are linked to one another.

    ``fps`` is read more than once and should be a checkpoint.
    """
    names = [f"w{k}" for k in range(words)]
    each = fps.groupBy(*names).agg(F.min("doc_id").alias("first"))
    if words == 1:
        each = each.withColumn("id", F.col("w0"))
    else:
        each = each.withColumn("id", F.col("first"))
    each = checkpoint(each)
    joined = connected_components(links(each.select("id", *names), words, radius, views or EXACT_VIEWS))
    classes = each.join(joined, each.id == joined.node, "left").select(*names, "first", F.coalesce("component", "id").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = classes.join(lowest, "class").select(*[F.col(n).alias(f"_{n}") for n in names], "component_id")
    return fps.join(named, [F.col(n) == F.col(f"_{n}") for n in names]).select("doc_id", *names, "component_id")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = checkpoint(fingerprints(table(spark, sf_dir, "documents")))
    return components(fps).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by shingle sets ------------------------------------------------------------------------------------


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word shingles, in ascending order."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE_WIDE), dtype=np.uint64).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        sets = pa.array([shingle_set(t) for t in part["text"].to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part["_pw_row"], sets], ["id", "s"])
        give_back()


def parity_sketch(s: np.ndarray) -> bytes:
    """As many bits as the power of two from the set's size on (64 at least), each the parity of the hashes that fall on it."""
    m = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount(s & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def short_sketch(sketch: bytes) -> list[int]:
    """The sketch folded to ``SHORT`` words; shorter ones are filled up with zeros."""
    x, n = int.from_bytes(sketch, "little"), len(sketch)
    while n > 8 * SHORT:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return [_signed(x >> 64 * k & _ONES) for k in range(SHORT)]


def sketch_distance(a: bytes, b: bytes) -> int:
    """Differing bits, after the longer sketch is folded to the size of the shorter: never more than the sets differ in elements."""
    if len(a) < len(b):
        a, b = b, a
    n, x = len(a), int.from_bytes(a, "little")
    while n > len(b):
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n must be looked up, so that no set with a similarity of 0.8 is missed."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _prefixes(frequent: np.ndarray, ranks: np.ndarray):
    """Digest, size, parity sketch and prefix of each row's set, and how many of its shingles are rare; ``frequent`` ones (ascending) come last, by ``ranks``."""

    def one(s: np.ndarray) -> tuple[int, int, int, bytes, np.ndarray, int, np.ndarray, np.ndarray]:
        digest = xxhash.xxh128_intdigest(s.tobytes(), SEED)
        order, rare, hot = s, len(s), np.zeros(len(s), dtype=bool)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            rank = np.where(frequent[at] == s, ranks[at], 0)
            order, rare, hot = s[np.lexsort((s, rank))], int((rank == 0).sum()), rank > 0
        return _signed(digest & _ONES), _signed(digest >> 64), len(s), parity_sketch(s), order[: prefix_length(len(s))], rare, s[:LEADING], hot[:LEADING]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            low, high, n, sketch, prefix, rare, lead, hot = zip(*[one(shingle_set(t)) for t in part["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part["_pw_row"], pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), pa.array([short_sketch(x) for x in sketch], pa.list_(pa.int64())), pa.array(list(prefix), pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(list(lead), pa.list_(pa.int64())), pa.array(list(hot), pa.list_(pa.bool_()))],
                ["id", "low", "high", "n", "sketch", "short", "prefix", "rare", "lead", "hot"],
            )
            give_back()

    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of ``token``, in portions that end where a bucket ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 50_000 or batch["token"][0] == batch["token"][-1]:
            continue
        rows = pa.Table.from_batches(held)
        token = rows["token"].to_numpy()
        cut = int(np.flatnonzero(token != token[-1])[-1]) + 1
        yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _spans(token: np.ndarray) -> Iterator[tuple[int, int]]:
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(start, len(token)))
    yield from zip(start[length > 1].tolist(), (start + length)[length > 1].tolist())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are not alone in their bucket, and those of frequent shingles, whose buckets are dealt over several tasks."""
    for rows in _whole_buckets(batches):
        token, dealt = rows["token"].to_numpy(), rows["salt"].to_numpy() > 0
        same = token[1:] == token[:-1]
        yield from rows.filter(pa.array(np.append(same, False) | np.insert(same, 0, False) | dealt)).drop_columns("salt").to_batches()


def _possible(n: np.ndarray, at: np.ndarray, i, j) -> np.ndarray:
    """Whether sizes and positions of a shared shingle allow a similarity of 0.8: 9 * overlap >= 4 * (sum of sizes)."""
    most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
    return (np.minimum(most, np.minimum(n[i], n[j])) * 9 >= 4 * (n[i] + n[j]))


def _pair_batch(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _short_allow(words: np.ndarray, n: np.ndarray, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the short sketches of rows i and rows j, folded to the shorter of both, allow a similarity of 0.8."""
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    x = words[j] ^ words[i]  # folding commutes with xor
    two = x[:, :2] ^ x[:, 2:]
    size = np.minimum(n[j], n[i])
    bits = np.where(size > 128, count(x), np.where(size > 64, count(two), count(two[:, :1] ^ two[:, 1:])))
    return 9 * bits <= n[j] + n[i]


def _short_words(rows: pa.Table) -> np.ndarray:
    return np.stack([rows[f"k{k}"].to_numpy() for k in range(SHORT)], axis=1).view(np.uint64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First candidates: the next of three in a bucket's own random order that sizes and short sketches allow."""
    give_back()
    for rows in _whole_buckets(batches):
        token, ids, n = (rows[c].to_numpy().astype(np.int64) for c in ("token", "id", "n"))
        words = _short_words(rows)
        left, right = [], []
        for step in (1, 2, 3):
            i = np.flatnonzero(token[step:] == token[:-step])
            i = i[9 * np.minimum(n[i], n[i + step]) >= 4 * (n[i] + n[i + step])]
            i = i[_short_allow(words, n, i, i + step)]
            left.append(ids[i])
            right.append(ids[i + step])
        yield _pair_batch(left, right)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that are not in one component and that sizes, positions and short sketches allow."""
    for rows in _whole_buckets(batches):
        token, ids, n, at, label, side = (rows[c].to_numpy().astype(np.int64) for c in ("token", "id", "n", "at", "label", "side"))
        words = _short_words(rows)
        left, right, made = [], [], 0
        for low, high in _spans(token):
            for i in range(low, high - 1):
                j = np.arange(i + 1, high)
                j = j[(label[i + 1 : high] != label[i]) & ((side[i + 1 : high] != side[i]) | (side[i] == 0))]
                j = j[_possible(n, at, i, j)]
                j = j[_short_allow(words, n, i, j)]
                if len(j):
                    left.append(np.full(len(j), ids[i]))
                    right.append(ids[j])
                    made += len(j)
                if made > 500_000:
                    yield _pair_batch(left, right)
                    left, right, made = [], [], 0
        yield _pair_batch(left, right)
        give_back()


def _cells(met: DataFrame) -> DataFrame:
    """Rows ``(id, n, at, token, label)`` of buckets in which labels meet, as ``(id, n, at, label, token, side)`` with a token for each cell.

    A bucket of up to ``CELL`` rows is one cell of side 0. In a larger one the rows of its largest label are dealt in parts, and so are the others; each
    part of the others meets every part of both. Rows of one side, 0 apart, are not compared.
    """
    each = met.groupBy("token", "label").count()
    buckets = each.groupBy("token").agg(F.max_by("label", "count").alias("main"), F.max("count").alias("most"), F.sum("count").alias("rows"), F.count("*").alias("labels"))
    buckets, _ = broadcast_if_small(checkpoint(buckets.where("labels > 1").drop("labels")))
    parts = lambda x: F.ceil(x / F.lit(CELL)).cast("long")
    mains, others = parts(F.col("most")), parts(F.col("rows") - F.col("most"))
    is_main = F.col("label") == F.col("main")
    part = F.pmod(F.xxhash64("id", "token"), F.when(is_main, mains).otherwise(others))
    over = lambda count, cell: F.transform(F.sequence(F.lit(0).cast("long"), count - 1), cell)
    cell = lambda kind, a, b, side: F.struct(F.xxhash64("token", F.lit(kind), a, b).alias("token"), side.cast("int").alias("side"))
    part_ = F.col("part")
    among = over(others, lambda o: cell(0, F.least(part_, o), F.greatest(part_, o), F.when(part_ == o, 0).when(part_ < o, 1).otherwise(2)))
    cells = (
        F.when(F.col("rows") <= CELL, F.array(F.struct("token", F.lit(0).alias("side"))))
        .when(is_main, over(others, lambda o: cell(1, o, part_, F.lit(2))))
        .otherwise(F.concat(among, over(mains, lambda o: cell(1, part_, o, F.lit(1)))))
    )
    return met.join(buckets, "token").withColumn("part", part).select("id", "n", "at", "label", F.explode(cells).alias("cell")).select("id", "n", "at", "label", "cell.token", "cell.side")


def _sketches_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in no more bits than a similarity of 0.8 allows: 9 * bits <= sum of sizes."""
    for batch in batches:
        a, b, na, nb, ka, kb = (batch[c].to_pylist() for c in ("a", "b", "na", "nb", "ka", "kb"))
        may = [9 * sketch_distance(x, y) <= n + m for x, y, n, m in zip(ka, kb, na, nb)]
        yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))
        give_back()


def _verified(rows: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole shingle sets have a similarity of at least 0.8, as ``(src, dst)``."""
    sketches = signed.select("id", "n", "sketch")
    left, right = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    pairs = checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_sketches_allow, "a long, b long"))
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("_pw_row")).distinct())
    few, _ = broadcast_if_small(ids, BROADCAST_IDS)
    sets = checkpoint(rows.join(few, "_pw_row", "left_semi").select("_pw_row", "text").mapInArrow(_sets, "id long, s array<long>"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    near = F.size(F.array_intersect("sa", "sb")) * 9 >= 4 * (F.size("sa") + F.size("sb"))
    return checkpoint(both.where(near).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_components(rows: DataFrame) -> DataFrame:
    """``(id, component)`` of all rows ``(_pw_row, text)``; a component is named by its smallest id. Rows must come again alike when read again."""
    total = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("_pw_row"), F.lit(max(1, total // SAMPLE_ROWS))) == 0).select("_pw_row", "text")
    counted = sample.mapInArrow(_sets, "id long, s array<long>").select(F.explode("s").alias("token")).groupBy("token").count().where(F.col("count") >= FREQUENT)
    top = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).orderBy("token").toArrow()  # bounded
    frequent, ranks = top["token"].to_numpy(), top["count"].to_numpy()
    signed = rows.select("_pw_row", "text").mapInArrow(_prefixes(frequent, ranks), "id long, low long, high long, n int, sketch binary, short array<long>, prefix array<long>, rare int, lead array<long>, hot array<boolean>")
    signed = checkpoint(signed)
    each = checkpoint(signed.groupBy("low", "high").agg(F.min("id").alias("first")))
    copies = joined_on_hot(signed.select("id", "low", "high"), each, ["low", "high"]).where("id != first").select("id")
    salt = F.when(F.col("at") >= F.col("rare"), 1 + F.pmod(F.xxhash64("id", "token"), F.lit(SALTS))).otherwise(0).cast("int")
    single = checkpoint(without(signed.drop("low", "high", "sketch"), checkpoint(copies), "id"))
    short = [F.col("short")[k].alias(f"k{k}") for k in range(SHORT)]
    met = checkpoint(
        single.select("id", "n", "rare", F.posexplode("prefix").alias("at", "token"))
        .select("id", "n", "at", "token", salt.alias("salt"))
        .repartition("token", "salt").sortWithinPartitions("token", "salt", F.xxhash64("token", "id"))
        .mapInArrow(_met, "id long, n int, at int, token long")
    )
    dealt = F.when(F.col("x.hot"), F.pmod(F.xxhash64("id", "x.lead"), F.lit(SALTS))).otherwise(0)
    some = (
        single.select("id", "n", *short, F.explode(F.arrays_zip("lead", "hot")).alias("x")).select("id", "n", *[f"k{k}" for k in range(SHORT)], F.col("x.lead").alias("token"), dealt.alias("salt"))
        .repartition("token", "salt").sortWithinPartitions("token", F.xxhash64("token", "id")).drop("salt")
        .mapInArrow(_neighbours, "a long, b long").groupBy("a").agg(F.collect_set("b").alias("bs"))
    )
    chosen = F.slice(F.array_sort(F.transform("bs", lambda b: F.struct(F.xxhash64("a", b).alias("h"), b.alias("b")))), 1, FIRST)
    first = _verified(rows, signed, checkpoint(some.select("a", F.explode(chosen).alias("x")).select("a", "x.b")))
    found, _ = broadcast_if_small(checkpoint(connected_components(first).select(F.col("node").alias("id"), "component")))
    labelled = checkpoint(met.join(found, "id", "left").select("id", "n", "at", "token", F.coalesce("component", "id").alias("label")))
    rest = _cells(labelled).join(single.select("id", *short), "id").repartition("token").sortWithinPartitions("token").mapInArrow(_across, "a long, b long").distinct()
    second = _verified(rows, signed, checkpoint(rest))
    joined = connected_components(first.unionByName(second))
    named = checkpoint(each.join(joined, each["first"] == joined.node, "left").select("low", "high", F.coalesce("component", "first").alias("component")))
    return checkpoint(joined_on_hot(signed.select("id", "low", "high"), named, ["low", "high"]).select("id", "component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)``: the smallest doc_id reachable over pairs with a similarity of 0.8 of five-word shingle sets."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    own = near_components(rows).join(rows.select(F.col("_pw_row").alias("id"), "doc_id"), "id")
    lowest = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return own.join(lowest, "component").select("doc_id", "component_id")


def fingerprint_components(rows: DataFrame) -> DataFrame:
    """``(id, component)`` of all rows ``(_pw_row, text)`` over links of fingerprints, as ``op4_simhash_dedup`` has them; named by the smallest id."""
    fps = fingerprints(rows, key="_pw_row").withColumnRenamed("_pw_row", "doc_id")
    return checkpoint(components(checkpoint(fps)).select(F.col("doc_id").alias("id"), F.col("component_id").alias("component")))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, and all rows without doc_id.

    Groups are the components of fingerprints, so of rows with equal text one stays. Decisions are made on narrow rows; then a row finds out
    by its generated id, which is unique, whether it goes.
    """
    rows = numbered(docs)
    ids = rows.where("doc_id is not null").select(F.col("_pw_row").alias("id"), F.col("doc_id").alias("_own"))
    classes = fingerprint_components(rows.where("doc_id is not null").select("_pw_row", "text")).join(ids, "id")
    first = classes.groupBy("component").agg(F.min(F.struct("_own", "id")).alias("first"), F.count("*").alias("rows"))
    first = checkpoint(first.where("rows > 1").select("component", F.col("first.id").alias("stays")))
    gone = checkpoint(joined_on_hot(classes, first, ["component"]).where("id != stays").select(F.col("id").alias("_pw_row")))
    return without(rows, gone).select(*docs.columns)
