"""Operator 10: near-duplicate groups by MinHash with tensored banding.

A text's set holds its distinct shingles of words. Texts of equal sets become one class. Each class
has two small collections of half keys, of two minhashes each; a table's key is a pair of half keys,
one of either collection, so 2 * M half keys give M * M tables and the minhash work is about the
square root of what as many independent tables would cost. A pair of similarity s shares no key
with probability 2 * (1 - s**2)**M at most: 7e-5 at s = 0.8 with M = 10.

Half keys that no other class has are dropped before pairs are formed. In each bucket all classes
are first compared with one leader, so that a bucket of n classes gives n candidate pairs; buckets
that this leaves in several components get further leaders. Only what is still not connected within
a bucket is compared pair by pair, and there the distances to the leader, which are known exactly,
rule out most pairs by the triangle inequality. Every candidate is confirmed on the full sets.
Components are found by label propagation with shortcuts, on tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, from_texts, materialise, need

HALVES, STARS = 10, 2
#: Rows of small columns up to which they are broadcast to the scan for the texts (some 100 bytes each in the JVM).
NAMES = 1_000_000
#: Half keys that candidates must share: at s = 0.8 a pair has 12.8 of 20, and under 3 with a probability under 1e-6.
LEAST = 3
#: Pairs in a bucket from which it is compared in blocks of about BLOCK sets and BLOCK_BYTES bytes of them at most;
#: a task of a wide group compares GRID blocks with GRID others.
WIDE, BLOCK, BLOCK_BYTES, GRID = 1024, 200, 8 << 20, 4
TESTED = "a long, b long, both long, either long"

U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of texts."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() and split() treat A-Z and the six ASCII separators only
        found = text.encode().lower().split() if text else []
        if not found:
            return np.empty(0, U)
        h = np.fromiter(map(xxhash.xxh64_intdigest, found), U, len(found))
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, U(size))
        for k in range(size):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
        return np.unique(out)


def half_keys(shingles: np.ndarray, m: int) -> np.ndarray:
    """2 * m half keys of two minhashes each."""
    seeds = mixed(np.arange(1, 4 * m + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    least = np.full(4 * m, U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, mixed(shingles[at : at + 1024, None] ^ seeds[None, :]).min(axis=0))
    return mixed(mixed(least[::2] ^ seeds[::2]) + least[1::2] * U(3))


def _sketch(words: int, m: int):
    def start():
        shingler = Shingler(words)

        def row(text: str | None) -> tuple:
            s = shingler(text)
            if not len(s):
                return 0, None, None, None
            return len(s), *np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64).tolist(), half_keys(s, m).view(np.int64)

        return lambda texts: list(map(row, texts))

    return start


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            for node, c1, c2, text in zip(batch["node"], batch["c1"], batch["c2"], batch["text"], strict=True):
                data = shingler(text).tobytes()
                if np.frombuffer(xxhash.xxh128_digest(data), np.int64).tolist() == [c1, c2]:  # an id may have several texts
                    yield pd.DataFrame({"node": [node], "shingles": [data]})

    return run


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for node, data in zip(batch["node"], batch["shingles"], strict=True):
            shingles = np.frombuffer(data, np.int64)
            yield pd.DataFrame({"node": np.full(len(shingles), node), "shingle": shingles})


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)) for x, y in zip(batch["x"], batch["y"], strict=True)]
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "both": both, "either": (batch["x"].str.len() + batch["y"].str.len()) // 8 - both})


def _block_links(percent: int, columns: int = 8192):
    """Pairs of a block of sets and another that link: intersections of all by products of indicator matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for xs, ys in zip(batch["xs"], batch["ys"], strict=True):
                sides = []
                for side in (xs, ys):
                    sets = [np.frombuffer(s["shingles"], U) for s in side]
                    sizes = np.array([len(s) for s in sets])
                    sides.append((np.array([s["node"] for s in side], np.int64), np.array([s["component"] for s in side], np.int64), sizes, np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)))
                (xn, xc, xsize, xrow, xall), (yn, yc, ysize, yrow, yall) = sides
                words = np.intersect1d(xall, yall)  # all others are in no intersection
                both = np.zeros((len(xn), len(yn)))
                for at in range(0, len(words), columns):
                    part = words[at : at + columns]
                    marks = []
                    for n, row, shingles in ((len(xn), xrow, xall), (len(yn), yrow, yall)):
                        where = np.minimum(np.searchsorted(part, shingles), len(part) - 1)
                        hit = part[where] == shingles
                        mark = np.zeros((n, len(part)), np.float32)
                        mark[row[hit], where[hit]] = 1
                        marks.append(mark)
                    both += marks[0] @ marks[1].T
                either = xsize[:, None] + ysize[None, :] - both
                i, j = np.nonzero((both * 100 >= either * percent) & (xc[:, None] != yc[None, :]))
                yield pd.DataFrame({"a": np.minimum(xn[i], yn[j]), "b": np.maximum(xn[i], yn[j]), "both": both[i, j].astype(np.int64), "either": either[i, j].astype(np.int64)})

    return run


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of links (a, b)."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        # each node takes the smallest label around it, then that label's own label
        sent = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("sent"))
        near = labels.join(sent, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("was"), F.least("component", "sent").alias("component"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        now = materialise(near.join(of, "component", "left").select("node", "was", F.least("component", "next").alias("component")))
        labels = now.select("node", "component")
        if not now.where(F.col("was") != F.col("component")).limit(1).count():
            return labels


def few(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has at most NAMES rows."""
    return F.broadcast(table) if table.count() <= NAMES else table


def _similar_sizes(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


class _Groups:
    """The search over classes; each step's table is small beside the documents."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, m: int, least: int):
        self.docs, self.classes, self.words, self.percent, self.m, self.least = docs, classes, words, percent, m, least
        #: the class with most copies leads first: edited copies are nearer to it than to each other
        self.first_priority = F.struct((-F.col("n_docs")).alias("copies"), F.xxhash64("node").alias("rest"))
        self.buckets = materialise(self._buckets())
        self.sets = materialise(self._full_sets())
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def _buckets(self) -> DataFrame:
        """key, node, n_shingles, n_docs for all keys that may have more than one class."""
        halves = self.classes.select("node", "n_shingles", "n_docs", F.posexplode("halves").alias("at", "half"))
        shared = halves.groupBy("at", "half").count().where("count > 1").drop("count")
        side = lambda low: F.collect_list(F.when((F.col("at") < self.m) == low, F.struct("at", "half")))
        kept = halves.join(shared, ["at", "half"]).groupBy("node", "n_shingles", "n_docs").agg(side(F.lit(True)).alias("left"), side(F.lit(False)).alias("right"))
        pairs = kept.withColumn("l", F.explode("left")).withColumn("r", F.explode("right"))
        keys = pairs.select(F.xxhash64("l.at", "l.half", "r.at", "r.half").alias("key"), "node", "n_shingles", "n_docs")
        return keys.join(keys.groupBy("key").count().where("count > 1").drop("count"), "key")

    def _full_sets(self) -> DataFrame:
        names = self.buckets.select("node").distinct().join(self.classes, "node").select("node", "c1", "c2", F.col("doc_id"))
        texts = self.docs.join(few(materialise(names)), "doc_id").select("node", "c1", "c2", "text")
        once = texts.withColumn("which", F.xxhash64("text")).dropDuplicates(["node", "which"])
        return once.select("node", "c1", "c2", "text").mapInPandas(_sets(self.words), "node long, shingles binary")

    def _labelled(self) -> DataFrame:
        if self.labels is None:
            return self.buckets.withColumn("component", F.col("node"))
        return self.buckets.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def _open(self, priority: Column) -> tuple[DataFrame, DataFrame]:
        """The rows of buckets with several components, and such buckets' leaders."""
        rows = self._labelled()
        lead = rows.groupBy("key").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min(F.struct(priority.alias("p"), "node", "n_shingles", "component")).alias("lead"),
        )
        return rows, lead.where("low < high").select("key", "lead")

    def star(self, turn: int) -> DataFrame:
        """Candidates: each open bucket's classes with the bucket's leader of this turn."""
        rows, lead = self._open(F.xxhash64(F.lit(turn), "node") if turn else self.first_priority)
        found = rows.join(lead, "key").where((F.col("component") != F.col("lead.component")) & _similar_sizes(F.col("n_shingles"), F.col("lead.n_shingles"), self.percent))
        return found.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()

    def _own_shingles(self, nodes: DataFrame) -> DataFrame:
        """node, own: how many of its shingles no other of these nodes has."""
        each = self.sets.join(nodes, "node").mapInPandas(_exploded, "node long, shingle long")
        single = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
        return single.groupBy("node").agg(F.count("*").alias("own"))

    def cross(self) -> tuple[DataFrame, DataFrame]:
        """Candidates: the pairs of an open bucket from different components that no bound rules out; rows of wide buckets.

        Shingles that none of the others has can't be in an intersection, and distances to the
        bucket's first leader, where known, differ by the pair's distance at most. One of a pair is
        always outside the leader's component, so only such rows meet the bucket's other rows.
        """
        rows, lead = self._open(self.first_priority)
        rows = materialise(rows.join(lead.select("key", F.col("lead.node").alias("lead"), F.col("lead.component").alias("lead_component")), "key"))
        known = self.tested.select("a", "b", (F.lit(1.0) - F.col("both") / F.col("either")).alias("far"))
        at_lead = (F.least("node", "lead") == F.col("a")) & (F.greatest("node", "lead") == F.col("b"))
        shared = F.col("n_shingles") - F.coalesce("own", F.lit(0))
        far = F.when(F.col("node") == F.col("lead"), 0.0).otherwise(F.col("far"))
        rows = rows.join(self._own_shingles(rows.select("node").distinct()), "node", "left").join(known, at_lead, "left")
        rows = rows.select("key", "node", "n_shingles", "component", "lead_component", shared.alias("shared"), far.alias("far"))
        rows = materialise(rows.where(F.col("shared") * 100 >= F.col("n_shingles") * self.percent))
        outside = F.col("component") != F.col("lead_component")
        work = rows.groupBy("key").agg((F.count("*") * F.sum(outside.cast("long"))).alias("work"))
        wide = rows.join(work.where(F.col("work") > WIDE).select("key"), "key")
        rows = rows.join(work.where(F.col("work").between(1, WIDE)).select("key"), "key")
        x, y = rows.where(outside).alias("x"), rows.alias("y")
        most = F.least("x.shared", "y.shared")
        bound = most * 100 >= (F.col("x.n_shingles") + F.col("y.n_shingles") - most) * self.percent
        near = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 1 - self.percent / 100 + 1e-9, F.lit(True))
        once = (F.col("y.component") == F.col("y.lead_component")) | (F.col("x.node") < F.col("y.node"))
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & bound & near)
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), wide

    def block_links(self, rows: DataFrame) -> DataFrame:
        """Links of wide buckets' rows, found in blocks of full sets: no pair but a link becomes a row.

        The buckets of one leader's component are taken together, so a pair that shares many of them
        is compared once. Sizes fall into bins so wide that linked sets are in the same or the next.
        """
        bin_ = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / self.percent)).cast("int")
        rows = materialise(rows.select(F.col("lead_component").alias("group"), bin_.alias("bin"), "node", "component", (F.col("component") != F.col("lead_component")).alias("outside")).distinct())

        rows = rows.join(self.classes.select("node", "n_shingles"), "node")
        in_blocks = lambda some: F.greatest(F.ceil(F.count(F.when(some, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(some, F.col("n_shingles"))), F.lit(0)) * 8 / BLOCK_BYTES))
        sizes = materialise(rows.groupBy("group", "bin").agg(in_blocks(F.col("outside")).alias("xs"), in_blocks(F.lit(True)).alias("ys")))
        near = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")
        # the pairs of blocks of one group and bin are dealt to a grid of cells, each with about GRID * GRID pairs
        tall = sizes.where("xs > 0").select("group", near, "xs").groupBy("group", "bin").agg(F.ceil(F.max("xs") / GRID).alias("rows"))
        cells = materialise(sizes.join(tall, ["group", "bin"]).select("group", "bin", "rows", F.ceil(F.col("ys") / GRID).alias("cols")))
        # both have a row for each group and bin; where these are many, no group holds a large share of the rows
        sizes, cells = few(sizes), few(cells)

        def blocks(part: DataFrame, slots: str, name: str) -> DataFrame:
            part = part.join(sizes, ["group", "bin"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col(slots)))
            return part.join(self.sets, "node").groupBy("group", "bin", "slot").agg(F.collect_list(F.struct("node", "component", "shingles")).alias(name))

        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        x = blocks(rows.where("outside"), "xs", "x").select("group", near, "slot", F.col("x").alias("xs")).join(cells, ["group", "bin"])
        x = x.select("group", "bin", F.pmod(F.xxhash64("slot"), F.col("rows")).alias("row"), each("cols").alias("col"), "xs")
        y = blocks(rows.drop("outside"), "ys", "y").select("group", "bin", "slot", F.col("y").alias("ys")).join(cells, ["group", "bin"])
        y = y.select("group", "bin", each("rows").alias("row"), F.pmod(F.xxhash64("slot"), F.col("cols")).alias("col"), "ys")
        return x.join(y, ["group", "bin", "row", "col"]).select("xs", "ys").mapInPandas(_block_links(self.percent), TESTED).distinct()

    def confirm(self, pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Test the candidates that are new on their full sets; join the components of those that link, and of more links."""
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        halves = self.classes.select("node", "halves")
        pairs = pairs.join(halves.toDF("a", "ha"), "a").join(halves.toDF("b", "hb"), "b")
        pairs = pairs.where(F.size(F.filter(F.zip_with("ha", "hb", lambda x, y: x == y), lambda same: same)) >= self.least).select("a", "b")
        sets = self.sets
        joined = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
        found = joined.select("a", "b", "x", "y").mapInPandas(_common, TESTED)
        found = materialise(found if more is None else found.unionByName(more))
        self.tested = found if self.tested is None else self.tested.unionByName(found)
        linked = found.where(F.col("both") * 100 >= F.col("either") * self.percent).select("a", "b")
        if linked.limit(1).count():
            if self.labels is not None:  # what is connected so far, as links to each component's first node
                linked = linked.union(self.labels.where("component <> node").select(F.col("component").alias("a"), F.col("node").alias("b")))
            self.labels = connected(linked)

    def run(self) -> DataFrame | None:
        for turn in range(STARS):
            self.confirm(self.star(turn))
        pairs, wide = self.cross()
        self.confirm(pairs, self.block_links(wide))
        return self.labels


def _verdicts(docs: DataFrame, words: int, percent: int, halves: int, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, c1, c2, grp, least of each row: its class, the component's own number (a doc_id may be in several) and its smallest doc_id."""
    texts = need(docs, "doc_id", "text")
    sketches = materialise(from_texts(texts, _sketch(words, halves), "n_shingles long, c1 long, c2 long, halves array<long>"))
    named = sketches.where(F.col("doc_id").isNotNull() & F.col("c1").isNotNull())
    # the smallest doc_id stands for its class; equal sets have equal half keys
    classes = named.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.count("*").alias("n_docs"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    labels = _Groups(texts, classes, words, percent, halves, least).run()
    of_class = classes.select("c1", "c2", "node", F.col("doc_id").alias("least"), F.col("node").alias("grp"))
    if labels is not None:
        smallest = of_class.join(labels, "node").groupBy("component").agg(F.min("least").alias("smallest"))
        of_node = labels.join(smallest, "component").select("node", "component", "smallest")
        of_class = of_class.join(of_node, "node", "left").withColumns({"least": F.coalesce("smallest", "least"), "grp": F.coalesce("component", "grp")})
    rows = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c1")).alias("c1"), "c2")
    return rows.join(of_class.select("c1", "c2", "grp", "least"), ["c1", "c2"], "left")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, halves: int = HALVES, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Sets are linked whose intersection is at least `percent` hundredths of their union;
    component_id is the smallest doc_id that links reach, kept says that it is the row's own. A text
    of fewer than `words` words is one shingle; null and empty texts, and texts of white space, have
    no shingles and are linked with nothing. A null doc_id can't name a component: such rows take no
    part in links, have a null component_id and are kept. Each repeated row has its own row in the
    result; rows that share a doc_id but not their text are linked by their texts, not by the
    doc_id. An empty table gives an empty result; extra columns, whatever their names, are not read. Very long texts
    are compared by their whole sets. Candidates share `least` half keys of 2 * halves; 1 and 1 more halves search further.
    """
    out = _verdicts(docs, words, percent, halves, least)
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _class_of(words: int):
    """The class of a text, c1 and c2, as _sketch gives it; nulls for texts without shingles."""

    def start():
        shingler = Shingler(words)

        def row(text: str | None) -> tuple:
            s = shingler(text)
            return tuple(np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64).tolist()) if len(s) else (None, None)

        return lambda texts: list(map(row, texts))

    return start


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id, and with one row of those that a component has of its smallest.

    Rows that share a doc_id are judged each by its own text; of those that link, the one with the smallest text
    stays. A text without shingles is linked with nothing and stays once for each doc_id. Null doc_ids stay, all their
    rows; an empty table stays empty. All columns stay, whatever their names. Very long texts are compared whole.
    """
    plain = by_position(docs)
    id_, text = f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    verdict = _verdicts(docs, words, percent, HALVES).where("doc_id is not null").withColumn("stays", F.col("doc_id") == F.coalesce("least", "doc_id"))
    ids = materialise(verdict.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("repeats")).where("stays"))
    single, several = ids.where("repeats = 1").select("doc_id"), ids.where("repeats > 1").select("doc_id")
    out = plain.join(few(single.withColumnRenamed("doc_id", "kept_id")), F.col(id_) == F.col("kept_id"), "left_semi").unionByName(plain.where(F.col(id_).isNull()))
    if several.limit(1).count():
        # of ids with several rows each text has its own verdict
        rows = plain.join(few(several.withColumnRenamed("doc_id", "kept_id")), F.col(id_) == F.col("kept_id"), "left_semi")
        rows = from_texts(rows, _class_of(words), "c1_ long, c2_ long", column=text, keep=True)
        stays = verdict.where("stays").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("c1").alias("x"), F.col("c2").alias("y"), "grp").distinct()
        same = (F.col(id_) == F.col("kept_id")) & F.col("c1_").eqNullSafe(F.col("x")) & F.col("c2_").eqNullSafe(F.col("y"))
        # what stays of a component: the row of the smallest text; of texts without shingles each stays once
        own = F.when(F.col("c1_").isNull(), F.col(text))
        whole = F.struct(*[F.col(c) for c in plain.columns])
        kept = rows.join(stays, same).groupBy(id_, "grp", own.alias("own")).agg(F.min_by(whole, F.struct(F.col(text), F.xxhash64(text))).alias("kept"))
        out = out.unionByName(kept.select("kept.*"))
    return out.toDF(*docs.columns)
