"""Operator 5: toxicity by class-conditional Kneser-Ney models.

Two interpolated models, of toxic (k = 1) and of ordinary texts (k = 0), are learnt from labelled documents:

    P_k(w|v) = max(c_k(v, w) - ALL_PAIRS, 0) / c_k(v) + L_k(v) * P_k(w)     L_k(v) = 1 - sum over w of the first terms
    P_k(w)   = max(n_k(w) - D_k, 0) / N_k + L_k * P(w)                          L_k = 1 - sum over w of the first terms
    P(w)     = (n_0(w) + n_1(w)) / (N_0 + N_1)

c_k(v, w) is how often w follows v in the texts of class k, c_k(v) its sum over w; the edge of a text is the word before its
first and after its last. n_k(w) is Kneser and Ney's continuation count: the number of different words before w in the texts of class k,
so copies of a text count once; so do words that stutter, as those that repeat the one before are left out. N_k is its sum. P(w), the lower order, is shared: it adds the
counts of both classes, so a rare expression, whose own counts the discounts take up, gets the same probability
in both but for the backoff weights L_k. The discounts are in proportion to the classes' shares of the labelled
documents, D_k = DISCOUNT * share_k: what is as frequent in one class as in the other keeps even odds.

The discount of pairs is the same in both classes. Counts of pairs see copies of texts as often as they occur.

A text's toxic and ordinary log-likelihoods are compared per word (`mean`), and beside that by the order of words alone
over its TELLING words that speak most for the toxic class (`best`), as abuse may be a few words of a long text. A logistic
curve of these two and the log of the text's length, in which such words are chosen from more, turns them into
a score. It is fitted on a fold of labelled rows by models that count the other folds, at most CALIBRATION rows of
it; the models that score count all.

Pairs and words are counted exactly (words by 48-bit hashes) in tables that grow with the corpus. The difference of a word's
log-likelihoods is that by the order of words, plus what the word before it adds by its backoff weights, plus what the pair's counts add.
The HEAVY most frequent words and pairs (a fixed size) are broadcast to the scan; the
others are joined to the texts that may hold them by a shuffle. A pair of a text that the models count is in no need of that if it has no other occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_position, drop_shuffles, frequent, from_texts, held_out, materialise, need

DISCOUNT, PAIR_DISCOUNT, TELLING = 40.0, 160.0, 4
#: The discount of pairs in the registered queries: under 1, so that each pair counts, also one that occurs once. Larger ones, as the functions' default, leave out pairs that occur up to so often.
ALL_PAIRS = 0.75
CALIBRATION, THRESHOLD = 20_000, 0.3
#: Words and pairs that are broadcast (32 and 16 bytes each), and bits of each filter for the others.
HEAVY, FILTER_BITS = 1 << 20, 27
#: Labels up to which they are broadcast to the documents (some 100 bytes each in the JVM); more are joined by a shuffle.
LABELS = 1_000_000
#: Pairs that a task counts before it passes them on.
FLUSH = 500_000
TOKEN = re.compile(r"[^\W_]+")
U = np.uint64
#: Stands before the first word and after the last one.
EDGE = (1 << 48) - 1


def hashed_words(text: str | None) -> np.ndarray:
    """A text's words as 48-bit hashes; one that repeats the word before it is left out."""
    found = TOKEN.findall(text.lower()) if text else []
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), U, len(found)) >> U(16)
    return words[np.concatenate([np.ones(1, bool), words[1:] != words[:-1]])] if len(words) else words


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return before << U(16) ^ words


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (w, v before it) of a task with their numbers in each part."""

    def added(held: list) -> pd.DataFrame:
        part, v, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, where = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
        counts = np.bincount(where * 4 + part, c, 4 * len(first)).astype(np.int64).reshape(-1, 4)
        return pd.DataFrame({"w": w[first].view(np.int64), "v": v[first].view(np.int64)} | {f"c{i}": counts[:, i] for i in range(4)})

    held, n = [], 0
    for batch in batches:
        for part, text in zip(batch["part"], batch["text"], strict=True):
            w = hashed_words(text)
            if not len(w):
                continue
            v, w = np.append(U(EDGE), w), np.append(w, U(EDGE))
            _, once, times = np.unique(pair_key(v, w), return_index=True, return_counts=True)
            held.append((np.full(len(once), part), v[once], w[once], times))
            n += len(once)
            if n >= FLUSH:
                yield added(held)
                held, n = [], 0
    if n:
        yield added(held)


def counted(texts: DataFrame, pair_discount: float) -> tuple[DataFrame, DataFrame]:
    """All pairs (w, v before it) of texts (part, text) with their counts c0 to c3, and their words with what the models need of them.

    0 and 1 count parts 0 and 0 or 1, 2 and 3 parts 2 and 2 or 3: a part is twice the class, and one more in the fold that the first
    models don't count. n0 to n3 are a word's continuation counts, c0 to c3 its occurrences, s0 to s3 what is left above the discount of the pairs that it begins.
    """
    pairs = texts.select("part", "text").mapInPandas(_pairs, "w long, v long, c0 long, c1 long, c2 long, c3 long")
    pairs = pairs.groupBy("w", "v").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])
    pairs = pairs.select("w", "v", "c0", (F.col("c0") + F.col("c1")).alias("c1"), "c2", (F.col("c2") + F.col("c3")).alias("c3"))
    pairs = materialise(pairs.sortWithinPartitions("w"), compression="zstd")  # words in runs take half the space
    drop_shuffles(pairs.sparkSession)
    c, none, names = [F.col(f"c{i}") for i in range(4)], [F.lit(0).cast("long")] * 8, [f"{x}{i}" for x in "ncs" for i in range(4)]

    def row(word: str, values: list[Column]) -> Column:
        return F.struct(F.col(word).alias("word"), *[x.alias(name) for x, name in zip(values, names, strict=True)])

    second = row("w", [*[(x > 0).cast("long") for x in c], *c, *[F.lit(0.0)] * 4])
    first = row("v", [*none, *[F.greatest(x - pair_discount, F.lit(0.0)) for x in c]])  # quarters and whole numbers add up alike in any order
    words = materialise(pairs.select(F.inline(F.array(second, first))).groupBy("word").agg(*[F.sum(x).alias(x) for x in names]))
    drop_shuffles(words.sparkSession)
    return pairs, words


@dataclass
class Models:
    """`words` has each word's difference of the log-likelihoods (`value`) and what it adds to that of the next (`before`), its probabilities p0 and p1, and
    what b0 and b1 its backoff leaves, in occurrences; `pairs` has all pairs' counts above the discount. Words that no model counts have the value `base`."""

    base: float
    words: DataFrame
    pairs: DataFrame
    near: Broadcast  # sorted keys and values of the most frequent words
    heavy: Broadcast  # sorted keys and counts above the discount of the most frequent pairs
    filter: Broadcast | None  # a bitmap that has a bit for each of the others
    repeated: Broadcast | None  # and one with a bit for each other pair that isn't alone
    alone: float  # what a pair that occurs once has above the discount
    marks: DataFrame | None = None  # doc_id and class of the texts that the models count, if these can be broadcast
    curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _entries(pairs: DataFrame, words: DataFrame, discounts: np.ndarray, pair_discount: float, which: int) -> tuple[float, DataFrame, DataFrame] | None:
    """base, words and pairs of the models that count the first folds (which = 0) or all (1)."""
    both = words.select("word", *[F.col(f"{x}{which + 2 * j}").alias(f"{x}{j}") for x in "ncs" for j in (0, 1)]).where("c0 + c1 > 0")
    n, c = (F.col("n0"), F.col("n1")), (F.col("c0"), F.col("c1"))
    own = both.where(F.col("word") != EDGE)  # the edge is no word to score
    # in whole numbers, so that no order of adding up shows: what is above the discounts, and how many words are
    above = [F.sum(F.when(n[j] > float(discounts[j]), n[j])) for j in (0, 1)] + [F.count(F.when(n[j] > float(discounts[j]), 1)) for j in (0, 1)]
    totals = [v or 0 for v in own.agg(F.sum(n[0]), F.sum(n[1]), *above).first()]
    size = totals[:2]
    if not size[0] or not size[1]:
        return None
    back = [1 - (totals[2 + j] - discounts[j] * totals[4 + j]) / size[j] for j in (0, 1)]
    base = float(np.log(back[1]) - np.log(back[0]))
    shared = (n[0] + n[1]) / float(sum(size))
    p = [F.greatest(n[j] - float(discounts[j]), F.lit(0.0)) / float(size[j]) + float(back[j]) * shared for j in (0, 1)]
    times = [F.greatest(c[j], F.lit(1)) for j in (0, 1)]
    left = [times[j] - F.col(f"s{j}") for j in (0, 1)]
    columns = [F.log(p[1] / p[0]).alias("value"), F.log(left[1] / times[1] / (left[0] / times[0])).alias("before")]
    columns += [x.alias(f"{name}{j}") for name, xs in (("p", p), ("b", left)) for j, x in enumerate(xs)]
    over = [F.greatest(F.col(f"c{which + 2 * j}") - pair_discount, F.lit(0.0)).alias(f"over{j}") for j in (0, 1)]
    counts = pairs.select("w", "v", *over, (F.col(f"c{which}") + F.col(f"c{which + 2}")).alias("freq"))
    return base, both.select("word", *columns, (c[0] + c[1]).alias("freq")), counts.where("over0 > 0 or over1 > 0")


def _key(w: str, v: str) -> Column:
    """pair_key"""
    return F.shiftleft(v, 16).bitwiseXOR(F.col(w))


def _sent(spark: SparkSession, *arrays: np.ndarray) -> Broadcast:
    """Arrays as a broadcast, compressed: Spark keeps a file of it for the Python workers of each executor."""
    return spark.sparkContext.broadcast([(x.dtype.str, x.nbytes, pa.compress(x.tobytes(), "zstd", asbytes=True)) for x in arrays])


def _arrays(held: Broadcast) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(x, size, "zstd"), kind) for kind, size, x in held.value]


def _sorted(table: DataFrame) -> Broadcast:
    """The first column as sorted keys, by their differences, and the others beside them."""
    found = table.toArrow()
    keys = found.column(0).to_numpy().view(U)
    order = np.argsort(keys)
    return _sent(table.sparkSession, np.diff(keys[order], prepend=U(0)), *[found.column(i).to_numpy().astype(np.float32)[order] for i in range(1, found.num_columns)])


def _bitmap(keys: DataFrame) -> np.ndarray | None:
    """A bit for each key, in eight to sixteen bits a key but 2 ** FILTER_BITS at most; None without keys."""
    keys = keys.toDF("key")
    size = 1 << min(FILTER_BITS, max(16, (8 * keys.count()).bit_length()))
    # Spark's bitmaps count bits and buckets from 1
    marks = keys.select((F.pmod("key", F.lit(size)) + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()
    if not marks.num_rows:
        return None
    bits = np.zeros(size // 8, np.uint8)
    for bucket, found in zip(marks.column(0), marks.column(1), strict=True):
        at, found = (bucket.as_py() - 1) * 4096, np.frombuffer(found.as_py(), np.uint8)
        bits[at : at + len(found)] = found
    return bits


def _has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys & U(8 * len(bits) - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) == 1


def _models(base: float, words: DataFrame, pairs: DataFrame, pair_discount: float, heavy: int) -> Models:
    spark = words.sparkSession
    near, often = (F.lit(False) if x is None else x for x in (frequent(t, F.col("freq"), heavy) for t in (words, pairs)))
    key = _key("w", "v")
    tables = words.where(near).drop("freq"), pairs.where(often).select(key, "over0", "over1")  # `heavy` rows at most
    rest = pairs.where(~often)
    bits = [_bitmap(words.where(~near).select("word").unionByName(rest.select(key.alias("word")))), _bitmap(rest.where("freq > 1").select(key))]
    return Models(base, words, pairs, *[_sorted(t) for t in tables], *[None if b is None else _sent(spark, b) for b in bits], max(1 - pair_discount, 0.0))


def telling(values: np.ndarray, n: int = TELLING) -> float:
    """The sum of the n largest positive values, divided by n."""
    return float(np.maximum(most(values, n), 0).sum() / n)


def most(values: np.ndarray, n: int = TELLING) -> np.ndarray:
    return np.partition(values, len(values) - n)[len(values) - n :] if len(values) > n else values


FEATURES = "n_words int, mean double, best double"
OPEN = "total double, top array<float>, unseen int, words array<long>, second array<int>, first array<int>, w array<long>, v array<long>, times array<int>, g0 array<float>, g1 array<float>"


def _measured(models: Models):
    """Features of texts; where words or pairs may be missing, what is known (`total`, the largest values) and what to look up.

    Words come with how often they are scored (`second`) and come before (`first`); pairs with how often they occur and, where
    both words are known, what a count above the discount adds to the probability in each class. All that a text of class `own` holds was counted, so
    a pair that no table or bitmap has is alone.
    """
    base, near, heavy, bitmap, repeated, alone = models.base, models.near, models.heavy, models.filter, models.repeated, models.alone

    def start():
        (words, value, before, p0, p1, b0, b1), (pairs, *over) = _arrays(near), _arrays(heavy)
        words, pairs = np.cumsum(words, dtype=U), np.cumsum(pairs, dtype=U)
        bits, more = (None if x is None else _arrays(x)[0] for x in (bitmap, repeated))

        def find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            return at, keys[at] == sought

        def taken(column: np.ndarray, at: np.ndarray, has: np.ndarray, other: float) -> np.ndarray:
            out = np.full(len(at), other)
            out[has] = column[at[has]]
            return out

        def row(read: dict) -> tuple:
            w, own = hashed_words(read["text"]), read["own"]
            n = len(w)
            if not n:
                return (0, 0.0, 0.0, *[None] * 11)
            w = np.append(U(EDGE), w)
            at, has = find(words, w)
            (v, w), (at_v, at_w), (has_v, has_w) = (w[:-1], w[1:]), (at[:-1], at[1:]), (has[:-1], has[1:])
            key = pair_key(v, w)
            at, has = find(pairs, key)
            both = has_v & has_w

            def given(places: np.ndarray) -> list[np.ndarray]:
                """What a count above the discount adds there to the probability in each class, relative to what the backoff gives."""
                return [1 / (b[at_v[places]].astype(float) * p[at_w[places]]) for b, p in ((b0, p0), (b1, p1))]

            values = taken(value, at_w, has_w, base)
            here = np.flatnonzero(has & both)
            gain = [np.log1p(x[at[here]] * g).sum() for x, g in zip(over, given(here), strict=True)]
            total = float(values.sum() + before[at_v[has_v]].sum(dtype=float) + gain[1] - gain[0])
            places, open_w, open_v = np.flatnonzero(has & ~both), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if bits is not None:
                missing = (np.flatnonzero(~h) for h in (has, has_w, has_v))
                late, open_w, open_v = (x[_has_bit(bits, keys[x])] for x, keys in zip(missing, (key, w, v), strict=True))
                if own is not None:
                    single = both[late] if more is None else both[late] & ~_has_bit(more, key[late])
                    total += (1 if own else -1) * float(np.log1p(alone * given(late[single])[own]).sum())
                    late = late[~single]
                places = np.concatenate([places, late])
            if not (len(places) or len(open_w) or len(open_v)):
                return (n, total / n, telling(values), *[None] * 11)
            sought, where = np.unique(np.concatenate([w[open_w], v[open_v]]), return_inverse=True)
            n_w = len(open_w)
            _, once, times = np.unique(key[places], return_index=True, return_counts=True)
            once = places[once]
            g = [np.full(len(once), np.nan, np.float32) for _ in (0, 1)]
            known = both[once]
            for x, y in zip(g, given(once[known]), strict=True):
                x[known] = y
            long = lambda x: x.view(np.int64)
            counts = [np.bincount(x, minlength=len(sought)).astype(np.int32) for x in (where[:n_w], where[n_w:])]
            return (n, None, None, total, most(np.delete(values, open_w)).astype(np.float32), n_w, long(sought), *counts, long(w[once]), long(v[once]), times.astype(np.int32), *g)

        return lambda texts: list(map(row, texts))

    return start


def _finished(base: float):
    """Features of the texts whose words and pairs were looked up by joins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = []
            for top, unseen, found in zip(batch["top"], batch["unseen"], batch["found"], strict=True):
                late = [f["value"] for f in (found if found is not None else ()) for _ in range(f["second"])]
                best.append(telling(np.array([*top, *late, *[base] * (unseen - len(late))], float)))
            yield pd.DataFrame({"rid": batch["rid"], "mean": (batch["total"] + batch["extra"].fillna(0.0)) / batch["n_words"], "best": best})

    return run


def _among(table: DataFrame, bits: np.ndarray) -> DataFrame:
    """The pairs of a table (w, v, ...) whose bit is set."""
    held = _sent(table.sparkSession, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits,) = _arrays(held)
        for batch in batches:
            w, v = (batch.column(i).to_numpy().view(U) for i in (0, 1))
            yield batch.filter(pa.array(_has_bit(bits, pair_key(v, w))))

    return table.mapInArrow(run, table.schema)


def features(rows: DataFrame, models: Models, keep: bool) -> DataFrame:
    """rows (with `text` and `own`, the class of those that the models count; both go unless keep) with n_words, mean and best as further columns."""
    columns = [c for c in rows.columns if keep or c not in ("text", "own")]
    rows = rows.select(*columns, F.struct("own", "text").alias("read"))
    made = from_texts(rows, _measured(models), f"{FEATURES}, {OPEN}", column="read")
    if models.filter is None:
        return made.select(*columns, "n_words", "mean", "best")
    made = materialise(made.withColumn("rid", F.monotonically_increasing_id()))
    late = made.where("total is not null")
    words = models.words
    found = late.select("rid", F.inline(F.arrays_zip("words", "second", "first"))).toDF("rid", "word", "second", "first").join(words.select("word", "value", "before"), "word")
    found = found.select("rid", (F.col("second") * (F.col("value") - models.base) + F.col("first") * F.col("before")).alias("extra"), F.when(F.col("second") > 0, F.struct("second", "value")).alias("found"))
    sought = late.select("rid", F.inline(F.arrays_zip("w", "v", "times", "g0", "g1"))).toDF("rid", "w", "v", "times", "g0", "g1")
    bits = _bitmap(sought.select(_key("w", "v")))
    if bits is not None:
        pairs = sought.join(_among(models.pairs.select("w", "v", "over0", "over1"), bits), ["w", "v"])
        known = pairs.where(~F.isnan("g0"))
        others = pairs.where(F.isnan("g0")).drop("g0", "g1").join(words.select(F.col("word").alias("v"), "b0", "b1"), "v").join(words.select(F.col("word").alias("w"), "p0", "p1"), "w")
        others = others.withColumns({f"g{j}": 1 / (F.col(f"b{j}") * F.col(f"p{j}")) for j in (0, 1)}).select(*known.columns)
        gain = [F.log1p(F.col(f"over{j}") * F.col(f"g{j}")) for j in (0, 1)]
        pairs = known.unionByName(others).select("rid", (F.col("times") * (gain[1] - gain[0])).alias("extra"), F.lit(None).cast(found.schema["found"].dataType).alias("found"))
        found = found.unionByName(pairs)
    more = found.groupBy("rid").agg(F.sum("extra").alias("extra"), F.collect_list("found").alias("found"))
    late = late.select("rid", "n_words", "total", "top", "unseen").join(more, "rid", "left").mapInPandas(_finished(models.base), "rid long, mean double, best double")
    late = late.toDF("rid", "late_mean", "late_best")
    made = made.join(late, "rid", "left").withColumns({"mean": F.coalesce("mean", "late_mean"), "best": F.coalesce("best", "late_best")})
    return made.select(*columns, "n_words", "mean", "best")


def curve_inputs(n_words: np.ndarray, mean: np.ndarray, best: np.ndarray) -> np.ndarray:
    return np.c_[mean, best, np.log(np.maximum(n_words, 1))]


def fit_curve(inputs: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised inputs: their means and spreads, and the weights."""
    mean, spread = inputs.mean(axis=0), inputs.std(axis=0) + 1e-9
    x = np.c_[np.ones(len(inputs)), np.clip((inputs - mean) / spread, -4, 4)]
    weights, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ weights)))
        weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - toxic) + ridge @ weights)
    return mean, spread, weights


def _score(models: Models) -> Column:
    """The curve over the columns of features."""
    if models.curve is None:
        return F.lit(0.0)
    mean, spread, weights = models.curve
    z = F.lit(float(weights[0]))
    for c, m, s, w in zip((F.col("mean"), F.col("best"), F.log(F.greatest("n_words", F.lit(1)))), mean, spread, weights[1:], strict=True):
        z = z + float(w) * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (c - float(m)) / float(s)))
    return 1 / (1 + F.exp(-z))


def marked(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[int, int], DataFrame] | None:
    """toxic, fold and text of the rows that labels mark and no test holds out, the number of labels of each class, and these labels; None without both classes."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    marks = need(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    marks = materialise(marks.withColumn("fold", fold))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    joinable = F.broadcast(marks) if sum(n.values()) <= LABELS else marks
    texts = need(docs, "doc_id", "text").where("text is not null").where(~held_out(F.col("doc_id"))).join(joinable, "doc_id")
    return texts.select("doc_id", "toxic", "fold", "text"), (n[0], n[1]), marks.select("doc_id", "toxic")


def fit(docs: DataFrame, labels: DataFrame, calibration: int = CALIBRATION, heavy: int = HEAVY, discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> Models | None:
    """Models from the rows of docs (doc_id, text) that labels (doc_id, toxic) mark and no test holds out.

    Rows without doc_id or label are not used; a doc_id with several labels is toxic if one of them
    says so. None if either class has no words.
    """
    found = marked(docs, labels)
    if found is None:
        return None
    texts, n, marks = found
    discounts = discount * np.array(n) / sum(n)
    part = (2 * F.col("toxic") + (F.col("fold") == 3).cast("int")).alias("part")
    pairs, words = counted(texts.select(part, "text"), pair_discount)
    both = [_entries(pairs, words, discounts, pair_discount, which) for which in (0, 1)]
    if both[1] is None:
        return None
    curve = None
    if both[0] is not None:
        in_fold = texts.where("fold = 3")
        some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, calibration / max(1, sum(n) / 3)))
        first = _models(*both[0], pair_discount, heavy)
        sample = features(in_fold.where(some).select("toxic", "text", F.lit(None).cast("int").alias("own")), first, keep=False).toPandas()
        for sent in (first.near, first.heavy, first.filter, first.repeated):
            if sent is not None:
                sent.destroy()
        drop_shuffles(docs.sparkSession)
        if sample["toxic"].nunique() == 2:
            curve = fit_curve(curve_inputs(*(sample[c].to_numpy(float) for c in ("n_words", "mean", "best"))), sample["toxic"].to_numpy(float))
    models = _models(*both[1], pair_discount, heavy)
    models.marks, models.curve = marks if sum(n) <= LABELS else None, curve
    return models


def _with_own(rows: DataFrame, doc_id: str, models: Models) -> DataFrame:
    """rows with the class `own` of those that the models count."""
    if models.marks is None:
        return rows.withColumn("own", F.lit(None).cast("int").alias("own"))
    marks = models.marks.toDF("marked", "own")
    return rows.join(F.broadcast(marks), F.col(doc_id) == F.col("marked"), "left").drop("marked")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, heavy: int = HEAVY, pair_discount: float = PAIR_DISCOUNT) -> DataFrame:
    """doc_id, held_out, score, predicted, and the features, of each row of docs (doc_id, text).

    Null and empty texts are scored as texts that tell nothing; a null doc_id stays null and isn't
    held out; each repeated row has its own row in the result; an empty table gives an empty
    result; extra columns, whatever their names, are not read. A very long text is scored whole. Without labels of both
    classes, or a curve, all scores are 0.
    """
    models = fit(docs, labels, heavy=heavy, pair_discount=pair_discount)
    rows = need(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if models is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_words"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("best"))
    out = features(_with_own(rows, "doc_id", models), models, keep=False).withColumn("score", _score(models))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "mean", "best")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, heavy: int = HEAVY, pair_discount: float = PAIR_DISCOUNT) -> DataFrame:
    """docs without the rows whose text scores as toxic.

    All columns stay, whatever their names; rows with null or empty texts stay if such texts score under the
    threshold, null ids too; repeated rows go or stay together; an empty table stays empty. Without labels of
    both classes all rows stay.
    """
    models = fit(docs, labels, heavy=heavy, pair_discount=pair_discount)
    if models is None:
        return docs
    at = docs.columns.index("text")
    plain = by_position(docs).withColumnRenamed(f"c{at}", "text")
    kept = features(_with_own(plain, f"c{docs.columns.index('doc_id')}", models), models, keep=True).where(_score(models) < threshold)
    return kept.select(*plain.columns).toDF(*docs.columns)
