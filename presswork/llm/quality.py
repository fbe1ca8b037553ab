"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, as the words of open text are mostly unseen. An n-gram of up to six characters is one long, ten bits a
character, so its context and suffix are bit operations. Counts, continuation counts and context totals are
aggregations sharded by n-gram, and probabilities are built from the lowest order up by equi-joins of counts with context totals
(on the context) and with the next lower order (on the suffix).

Every trusted row counts, whole: those with even hashes fit the model, all others set the thresholds, as a model's own texts would set them too
low. A fitted model of at most ``BROADCAST_GRAMS`` n-grams, by a count, is broadcast for scoring. With a larger one each document's n-grams are joined
to the sharded tables (``score_by_joins``), which gives the same sums, but shuffles several times the text (see README).

A document's score is its mean negative log-probability per character, with ``PRIOR_CHARS`` characters of the held-out mean added, so
that a few words prove little. Thresholds are quantiles of the scores of all trusted rows that are held out, one for each language; languages
with fewer than ``LEAST_TRUSTED`` such rows use the quantile over all languages.

Nulls and edges: null and empty texts have the mean score and are kept; a null language is a language of its own; doc_ids without labels
or repeated ones are scored like others; without any trusted row nothing can be judged and all rows are kept; an empty table
gives no rows; very long texts are scored whole, in pieces; a score equal to its threshold is kept; other columns pass through ``keep_good``
untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.llm.common import BROADCAST_IDS, broadcast_if_small, give_back, numbered, slices, table, without
from presswork.session import checkpoint

ORDER, BITS = 6, 10
LETTER = (1 << BITS) - 1
#: Characters with a code of their own: the most frequent of the texts that fit the model. 0 stands before a text, 1 for all other characters.
ALPHABET = LETTER - 1
#: Characters of a text whose n-grams are counted at a time, and about the bytes of text that are; longer texts come in pieces.
SAMPLE_CHARS = 3_000_000
#: A model of at most so many n-grams is broadcast (about 30 bytes each in every Python worker).
BROADCAST_GRAMS = 4_000_000
PRIOR_CHARS, LEAST_TRUSTED = 100, 50
QUANTILE = 0.995
#: Rows of text that are Python objects at a time, and characters that are scored at a time.
SLICE_ROWS, _PIECE = 200, 1 << 16


# --- the model ----------------------------------------------------------------------------------------------------------


class Alphabet:
    def __init__(self, points: list[int]):
        self.table = np.ones(0x110000, dtype=np.uint16)
        self.table[points] = np.arange(2, 2 + len(points))

    def codes(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)


def grams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each character, padded in front."""
    padded = np.concatenate([np.zeros(order - 1, dtype=np.int64), codes])
    out = np.zeros(len(codes), dtype=np.int64)
    for k in range(order):
        out = (out << BITS) | padded[k : k + len(codes)]
    return out


@functools.lru_cache(maxsize=2)
def _alphabet(points: tuple[int, ...]) -> Alphabet:
    return Alphabet(list(points))


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SAMPLE_CHARS):
        text = "".join(t for t in batch["text"].to_pylist() if t)
        for at in range(0, len(text), SAMPLE_CHARS):
            n = np.bincount(np.frombuffer(text[at : at + SAMPLE_CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4"))
            points = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int32)), pa.array(n[points].astype(np.int64))], ["point", "n"])
        give_back()


def _count_grams(points: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _alphabet(points)

        def counted(made: list[np.ndarray]) -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(made), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "c"])

        for batch in slices(batches, "text", SAMPLE_CHARS):
            made = []
            for text in batch["text"].to_pylist():
                for at in range(0, len(text or ""), SAMPLE_CHARS):
                    before = min(at, ORDER - 1)
                    made.append(grams(letters.codes(text[at - before : at + SAMPLE_CHARS]))[before:])
                    if at:
                        yield counted(made)
                        made = []
            if made:
                yield counted(made)
            give_back()

    return run


def _suffix(g: str, order: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def fit_tables(texts: DataFrame) -> tuple[tuple[int, ...], list[tuple[DataFrame, DataFrame]]]:
    """Fit on all ``text`` rows, which are read twice: the alphabet, and for each order the n-grams ``(g, p)`` with log-probabilities and the contexts ``(h, w)`` with log back-off weights."""
    texts = texts.select("text")
    letters = texts.mapInArrow(_count_letters, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    points = tuple(r.point for r in letters.orderBy(F.desc("n"), "point").limit(ALPHABET).collect())
    counts = {ORDER: checkpoint(texts.mapInArrow(_count_grams(points), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")))}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
        counts[order] = checkpoint(counts[order + 1].groupBy(_suffix("g", order + 1).alias("g")).agg(F.count("*").alias("c")))
    lower: DataFrame | None = None
    tables: list[tuple[DataFrame, DataFrame]] = []
    for order in range(1, ORDER + 1):
        c = counts[order]
        n = c.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 else 0.5
        d = [max(0.0, k - (k + 1) * y * b / a) if a else 0.5 * k for k, a, b in ((1, n.n1, n.n2), (2, n.n2, n.n3), (3, n.n3, n.n4))]
        discount = F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        context = c.groupBy(F.shiftright("g", BITS).alias("h")).agg(F.sum("c").alias("total"), F.sum(discount).alias("held"))
        context = context.select("h", "total", (F.col("held") / F.col("total")).alias("gamma"))
        rows = c.select("g", F.shiftright("g", BITS).alias("h"), _suffix("g", order).alias("s"), (F.col("c") - discount).alias("left")).join(context, "h")
        if lower is None:
            rows = rows.select("g", "h", "gamma", (F.col("left") / F.col("total") + F.col("gamma") / (ALPHABET + 2)).alias("p"))
        else:
            rows = rows.join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s").select(
                "g", "h", "gamma", (F.col("left") / F.col("total") + F.col("gamma") * F.col("q")).alias("p")
            )
        rows = checkpoint(rows)
        lower = rows
        tables.append((rows.select("g", F.log("p").cast("float").alias("p")), rows.groupBy("h").agg(F.log(F.first("gamma")).cast("float").alias("w"))))
    return points, tables


def train(texts: DataFrame) -> dict:
    """The fitted model in memory, for those that a count shows to be small."""
    return gathered(*fit_tables(texts))


def gathered(points: tuple[int, ...], tables: list[tuple[DataFrame, DataFrame]]) -> dict:
    orders = []
    for grams_, contexts in tables:
        seen, weights = grams_.toArrow(), contexts.toArrow()
        orders.append((_Lookup(seen["g"].to_numpy(), seen["p"].to_numpy()), _Lookup(weights["h"].to_numpy(), weights["w"].to_numpy())))
    return {"points": points, "orders": orders}


def _row_grams(points: tuple[int, ...]):
    """Each row's n-grams of full order, with their counts; long texts in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _alphabet(points)
        for batch in batches:
            for row, text in zip(batch["_pw_row"].to_pylist(), batch["text"].to_pylist()):
                for at in range(0, len(text or ""), _PIECE):
                    before = min(at, ORDER - 1)
                    g, n = np.unique(grams(letters.codes(text[at - before : at + _PIECE]))[before:], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), row)), pa.array(g), pa.array(n.astype(np.int64))], ["_pw_row", "g", "n"])

    return run


def score_by_joins(rows: DataFrame, points: tuple[int, ...], tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``(_pw_row, _pw_nll, _pw_n)`` of rows ``(_pw_row, text)`` by joins with the sharded tables, for a model of any size.

    Each distinct n-gram is looked up once, at all orders, by equi-joins; rows then fetch the sums of their own. Rows without text don't appear.
    The classifier scores with the broadcast model where that is small, which shuffles nothing; both give the same sums.
    """
    own = checkpoint(rows.select("_pw_row", "text").mapInArrow(_row_grams(points), "_pw_row long, g long, n long"))
    found = own.select("g").distinct()
    for order in range(ORDER, 0, -1):
        seen, weights = tables[order - 1]
        own_g = F.col("g").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        found = found.join(seen.select(F.col("g").alias(f"g{order}"), F.col("p").alias(f"p{order}")), own_g == F.col(f"g{order}"), "left")
        found = found.join(weights.select(F.col("h").alias(f"h{order}"), F.col("w").alias(f"w{order}")), F.shiftright(own_g, BITS) == F.col(f"h{order}"), "left").drop(f"g{order}", f"h{order}")
    value = F.lit(-float(np.log(ALPHABET + 2)))
    for order in range(1, ORDER + 1):
        value = F.coalesce(F.col(f"p{order}").cast("double"), F.coalesce(F.col(f"w{order}").cast("double"), F.lit(0.0)) + value)
    return own.join(found.select("g", value.alias("v")), "g").groupBy("_pw_row").agg(F.sum(-F.col("n") * F.col("v")).alias("_pw_nll"), F.sum("n").alias("_pw_n"))


class _Lookup:
    """Longs to floats: buckets by a multiplicative hash, laid out one after the other."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], np.float32(np.nan))
        size = np.bincount(bucket, minlength=1 << self.bits)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.deep = int(size.max(initial=0))

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        hit = (at < end) & (self.keys[at] == keys)
        out = np.where(hit, self.values[at], np.float32(np.nan))
        todo = np.flatnonzero(~hit & (at + 1 < end))
        for k in range(1, self.deep):
            if not len(todo):
                break
            here = at[todo] + k
            ok = self.keys[here] == keys[todo]
            out[todo[ok]] = self.values[here[ok]]
            todo = todo[~ok & (here + 1 < end[todo])]
        return out


def log_probabilities(model: dict, g: np.ndarray) -> np.ndarray:
    """Natural log-probability of the last character of each n-gram of full order, by backing off."""
    out = np.zeros(len(g), dtype=np.float64)
    todo = np.arange(len(g))
    for order in range(ORDER, 0, -1):
        seen, weights = model["orders"][order - 1]
        own = g[todo] & ((1 << (BITS * order)) - 1)
        p = seen.get(own)
        hit = ~np.isnan(p)
        out[todo[hit]] += p[hit]
        todo, own = todo[~hit], own[~hit]
        if not len(todo):
            return out
        w = weights.get(own >> BITS)
        out[todo] += np.nan_to_num(w, nan=0.0)
    out[todo] -= np.log(ALPHABET + 2)
    return out


def text_score(model: dict, text: str | None) -> tuple[float, int]:
    """Sum of negative log-probabilities and number of characters of the whole text, in pieces of bounded memory."""
    letters, total, text = _alphabet(model["points"]), 0.0, text or ""
    for at in range(0, len(text), _PIECE):
        before = min(at, ORDER - 1)
        g = grams(letters.codes(text[at - before : at + _PIECE]))[before:]
        total -= float(log_probabilities(model, g).sum())
    return total, len(text)


# --- the classifier -----------------------------------------------------------------------------------------------------


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids labelled good and never bad; other labels, such as toxic, are not this classifier's concern."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("good")).where("doc_id is not null and good = 1").select("doc_id")


def _sample_ids(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The trusted doc_ids whose texts fit the model: all of one half, so that the whole other half is left to set thresholds.

    The half is that of even hashes, or the other one if that has no text.
    """
    narrow = docs.select("doc_id", F.length("text").alias("n")).join(trusted, "doc_id", "left_semi")
    hashed = narrow.where("n > 0").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).distinct()
    half = hashed.agg(F.min("half")).first()[0] or 0
    return checkpoint(hashed.where(F.col("half") == half).select("doc_id"))


class Classifier:
    """A fitted model with thresholds."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE):
        self.spark = docs.sparkSession
        trusted = checkpoint(trusted_ids(labels))
        ids, _ = broadcast_if_small(_sample_ids(docs, trusted), BROADCAST_IDS)
        self.points, self.tables = fit_tables(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
        small = sum(t.count() for t, _ in self.tables) <= BROADCAST_GRAMS
        self.shared = self.spark.sparkContext.broadcast(gathered(self.points, self.tables)) if small else None
        self.mean = 0.0
        self.rows = numbered(docs)
        self.scored = checkpoint(self.score(self.rows.select("_pw_row", "doc_id", "lang", "text"), ["_pw_row", "doc_id", "lang"]))
        held = checkpoint(self.scored.join(trusted, "doc_id", "left_semi").join(ids, "doc_id", "left_anti"))
        self.mean = held.agg(F.sum("_pw_nll") / F.sum("_pw_n")).first()[0] or 0.0
        score = self.shrunk()
        each = held.where("_pw_n > 0").groupBy("lang").agg(F.percentile_approx(score, quantile, 100_000).alias("own"), F.count("*").alias("n"))
        common = held.where("_pw_n > 0").agg(F.percentile_approx(score, quantile, 100_000)).first()[0]
        languages = self.scored.select("lang").distinct().withColumnRenamed("lang", "_pw_lang")
        self.thresholds = checkpoint(
            languages.join(each, F.col("lang").eqNullSafe(F.col("_pw_lang")), "left")
            .select("_pw_lang", F.coalesce(F.when(F.col("n") >= LEAST_TRUSTED, F.col("own")), F.lit(float("inf") if common is None else common)).alias("_pw_threshold"))
        )

    def shrunk(self) -> Column:
        return (F.col("_pw_nll") + F.lit(PRIOR_CHARS * self.mean)) / (F.col("_pw_n") + F.lit(float(PRIOR_CHARS)))

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Add ``_pw_nll`` and ``_pw_n`` to the columns ``keep``, ``_pw_row`` among them, of rows with ``text``."""
        shared = self.shared
        if shared is None:
            sums = score_by_joins(rows, self.points, self.tables)
            own = rows.select(*keep).join(sums, "_pw_row", "left")
            return own.select(*keep, F.coalesce("_pw_nll", F.lit(0.0)).alias("_pw_nll"), F.coalesce("_pw_n", F.lit(0)).alias("_pw_n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    batch = whole.slice(at, SLICE_ROWS)
                    scores = [text_score(model, t) for t in batch["text"].to_pylist()]
                    nll, n = zip(*scores)
                    yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(nll, pa.float64()), pa.array(n, pa.int64())], [*keep, "_pw_nll", "_pw_n"])
                give_back()

        kinds = dict(rows.dtypes)
        read = rows.select(*dict.fromkeys([*keep, "text"]))
        return read.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "_pw_nll double", "_pw_n long"]))

    def judge(self, rows: DataFrame) -> DataFrame:
        """Add ``_pw_score``, ``_pw_threshold`` and ``_pw_keep`` to rows that have been scored."""
        thresholds, _ = broadcast_if_small(self.thresholds)
        judged = rows.withColumn("_pw_score", self.shrunk()).join(thresholds, F.col("lang").eqNullSafe(F.col("_pw_lang")), "left")
        return judged.withColumn("_pw_keep", ~(F.col("_pw_score") > F.col("_pw_threshold")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    c = Classifier(docs, labels)
    gone = checkpoint(c.judge(c.scored).where("not _pw_keep").select("_pw_row"))
    return without(c.rows, gone).select(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return c.judge(c.scored).select(
        "doc_id", "lang", F.col("_pw_n").alias("n_chars"), F.exp("_pw_score").alias("perplexity"), F.exp("_pw_threshold").alias("threshold"), F.col("_pw_keep").alias("keep")
    )
