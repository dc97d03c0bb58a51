"""Operator 5, n-gram Jaccard self-join by PartEnum signatures.

A document's set is that of its distinct word n-grams, as 64-bit hashes. Sizes fall into bands; a
pair belongs to the band of its smaller set. In a band, linked sets differ in at most k elements
(k follows from the threshold and the band's largest size). The feature domain is cut into n > k
parts; a set's projection on a part is a signature, so two sets that differ in at most k elements
agree on some part. Empty projections are left out: a set with more than k non-empty parts shares
a non-empty one with every partner. A set with k or fewer also emits its first elements in hash
order, as many as make any two such linked sets share one (a prefix filter). No link is lost.

Texts are cut into n-grams once; sets and signatures are written. Equal sets become one node before any
pair is made. Nodes have 64-bit names; the few names that a second hash shows to stand for two sets are
replaced. Sorted signatures stream through tasks which link each group to its least node: candidates
grow with the group, not with its square. The groups of frequent signatures, which a sample of nodes
shows, are dealt to several tasks, whose least nodes are linked in turn. Candidates are verified on the
exact sets. What may still be missed are links between two components inside a group. A node with such a
link shares at least the threshold's part of its own n-grams with other components, so nodes that don't
are dropped, again and again, by counting n-grams alone. The few that remain are compared, block by block,
through an inverted index in each task that counts common n-grams and gives
back links alone. The components are exactly those of all links.

Defined results: a null or empty text, or one without words, has an empty set (0) and is a component
of its own; a very long text is taken whole; ids may repeat (each row gets its set's component) or be
null (a component's id is its least non-null id); an empty table gives an empty result; further columns,
however named, are ignored by ``link`` and kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WordHashes, discard, mixed, row_key, settle, temporary, unused, windows
from tessella.llm.graph import components

#: Rows of a few numbers that may be broadcast beside their texts; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Rounds in which nodes without enough n-grams in common with other components are dropped.
PEELS = 3
#: A cluster of n n-grams is cut into the root of n / ``BLOCK`` blocks, and more where blocks would then have
#: over ``MOST`` n-grams; two blocks at a time are compared in a task.
BLOCK, MOST = 1 << 12, 1 << 22
#: Comparisons of one centre that go to one task.
SALT = 512
#: Nodes are sampled by one in so many to find frequent signatures, of which so many sampled nodes make a
#: group that is dealt on; the most frequent ones are, up to so many. This deals work and changes no result.
SAMPLE, FREQUENT, MOST_FREQUENT = 64, 16, 100_000


class Shingles:
    """Sets of n-gram hashes of texts."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes.of(words)
        return np.unique(windows(h, min(self.size, len(words))))


def fingerprint(shingles: np.ndarray, kind: int = 0) -> int:
    """A set's name: a signed number, 0 for the empty set; ``kind`` gives independent ones."""
    if not len(shingles):
        return 0
    seed = np.uint64(kind * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    total = np.array([mixed(shingles ^ seed).sum(dtype=np.uint64) ^ np.uint64(len(shingles) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)
    return int(total.view(np.int64)[0]) or 1


class Bands:
    """Size bands for a threshold of num/den and what follows for each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(self.lows[-1] * den // num + 1)
        self.lows_array = np.array(self.lows)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.lows_array, size, "right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def errors(self, band: int) -> int:
        """The most elements in which a linked pair of the band can differ."""
        most = self.lows[band + 1] - 1
        return (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> int:
        k = self.errors(band)
        return k + 2 + k // 16

    def prefix(self, size: int) -> int:
        """Elements in hash order of which linked sets share one."""
        return size - (size * self.num + self.den - 1) // self.den + 1

    def instances(self, size: int) -> list[int]:
        own, least = self.of(size), (size * self.num + self.den - 1) // self.den
        return [b for b in (own, self.of(least)) if self.errors(b)][: 2 if self.of(least) != own else 1]


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a sorted set."""
    out, size = [], len(shingles)
    for band in bands.instances(size):
        n = bands.parts(band)
        part = ((shingles >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        seed = np.uint64((band + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        out.append(mixed(np.add.reduceat(mixed(shingles ^ seed), starts) + part[starts]))
        if len(starts) <= bands.errors(band):
            out.append(mixed(shingles[: bands.prefix(size)] + (seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


class NgramJoin:
    """The join over one table; ``num``/``den`` is the least Jaccard similarity of a link."""

    def __init__(self, docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))
        self.size, self.num, self.den = size, num, den

    def hashed(self) -> DataFrame:
        """(doc_id, row, n_shingles, node, second, sigs) per document; sigs is null for a set that the task has met before."""
        size, num, den = self.size, self.num, self.den
        names = ["doc_id", "row", "n_shingles", "node", "second", "sigs"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, bands, seen = Shingles(size), Bands(num, den), set()
            for batch in batches:
                rows, sigs, n, start = [], [], 0, 0
                last = batch.num_rows - 1
                for i, text in enumerate(batch.column("text").to_pylist()):
                    s = shingles.of(text)
                    name = fingerprint(s), fingerprint(s, 1)
                    x = None
                    if len(s) and name not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(name)
                        x = signatures(s, bands)
                    rows.append((len(s), *name))
                    sigs.append(x)
                    n += 0 if x is None else len(x)
                    if n > 500_000 or i == last:
                        lengths = np.array([0, *(0 if x is None else len(x) for x in sigs)])
                        flat = np.concatenate([*(x for x in sigs if x is not None), np.zeros(0, np.uint64)]).view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(flat), mask=pa.array([x is None for x in sigs]))
                        some = batch.slice(start, len(rows))
                        yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("row"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), lists], names=names)
                        rows, sigs, n, start = [], [], 0, i + 1

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        return self.docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row struct<a:long,b:long>, n_shingles long, node long, second long, sigs array<long>")

    def prepare(self) -> tuple[DataFrame, DataFrame]:
        """The table of ``hashed`` with each set's final name, and (node, n, pick) per set: its size and a row that has it."""
        hashed = settle(self.hashed())

        def named(table: DataFrame) -> DataFrame:
            return table.where("node != 0").groupBy("node").agg(F.min("n_shingles").alias("n"), F.min("row").alias("pick"), F.min("second").alias("low"), F.max("second").alias("high"))

        sets = settle(named(hashed))
        # two sets of one 64-bit name: some n * n / 2**65 of them among n sets
        twins = [r.node for r in sets.where("low != high").select("node").collect()]
        if twins:
            hashed = hashed.withColumn("node", F.when(F.col("node").isin(twins), F.col("second")).otherwise(F.col("node")))
            sets = settle(named(hashed))
        return hashed, sets

    def groups(self, hashed: DataFrame) -> DataFrame:
        """(sig, a, b): a is the least node that has the signature, in a task's part of a frequent one, and b
        another one; a itself too, once, where the signature is frequent."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_sig = last_salt = last_node = centre = None  # of the group that may go on in the next batch
            for batch in batches:
                sig, salt, node = (np.asarray(c) for c in batch.columns)
                if not len(sig):
                    continue
                fresh = np.r_[last_sig is None or sig[0] != last_sig or salt[0] != last_salt, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])]
                again = ~fresh & np.r_[last_node is not None and node[0] == last_node, node[1:] == node[:-1]]
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), -1))
                centres = np.where(start >= 0, node[start], centre or 0)
                last_sig, last_salt, last_node, centre = int(sig[-1]), int(salt[-1]), int(node[-1]), int(centres[-1])
                out = np.where(fresh, salt >= 0, ~again)
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, centres, node)], names=["sig", "a", "b"])

        every = hashed.where("sigs is not null").select(F.explode("sigs").alias("sig"), "node")
        sampled = every.where(F.pmod("node", F.lit(SAMPLE)) == 0).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
        frequent = F.broadcast(settle(sampled.orderBy(F.desc("n"), "sig").limit(MOST_FREQUENT)))
        salt = F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / FREQUENT))).cast("int")
        ordered = every.join(frequent, "sig", "left").select("sig", salt.alias("salt"), "node").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "node")
        return ordered.mapInArrow(run, "sig long, a long, b long")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """The settled table ``wanted`` (pick and more) with the text of row ``pick``."""
        table = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return self.docs.select("row", "text").join(table, F.col("row") == F.col("pick")).drop("row", "pick")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b: distinct nodes) whose sets are linked."""
        size, num, den = self.size, self.num, self.den
        # written, so that the join has exchanges of its own and a centre's many rows can be split
        counts = settle(pairs.groupBy("a").agg(F.count("*").alias("n")))
        pairs = settle(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SALT)).alias("salt")))
        # where each node's text must go, so that texts move once
        centres = pairs.select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct()
        wanted = centres.union(pairs.select(F.col("b").alias("node"), "a", "salt", "b"))
        dealt = self.texts(settle(wanted.join(sets.select("node", "pick"), "node").select("a", "salt", "b", "pick")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, centre, own = Shingles(size), None, None
            for batch in batches:
                out = []
                a, b, text = (batch.column(c).to_pylist() for c in ("a", "b", "text"))
                for x, y, t in zip(a, b, text, strict=True):
                    s = shingles.of(t)
                    if y is None:
                        centre, own = x, s
                    elif x == centre and linked(own, s, num, den):
                        out.append((x, y))
                yield _links(out)

        ordered = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return ordered.mapInArrow(run, "u long, v long")

    def roots(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n_shingles, node) per document, and (node, root) for every node with a link."""
        with temporary() as kept:
            with temporary() as passed_on:  # signatures go as soon as they are grouped
                hashed, sets = self.prepare()
                groups, nodes = settle(self.groups(hashed)), settle(hashed.select("doc_id", "n_shingles", "node"))
                passed_on += [sets, groups, nodes]
            # the least nodes of a frequent signature's parts are linked to the least of them
            parts = groups.where("a = b").select("sig", "a")
            least = settle(parts.groupBy("sig").agg(F.min("a").alias("m")))
            heads = parts.join(least, "sig").where("m != a").select(F.col("m").alias("a"), F.col("a").alias("b"))
            stars = settle(groups.where("a != b").select("a", "b").union(heads).distinct())
            edges = settle(self.verified(stars, sets))
            labels = settle(components(edges))
            more = self._across(groups, labels, sets)
            if more is not None and not more.isEmpty():
                labels = settle(components(edges.union(more)))
            kept += [nodes, labels]
        return nodes, labels

    def _across(self, groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame | None:
        """Links (u, v) between components that share a signature."""
        members = groups.select("sig", F.col("b").alias("node")).union(groups.select("sig", "a").distinct())
        members = settle(_open(settle(members.join(labels, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root")))))
        if members.isEmpty():
            return None
        held = self._shared(members.select("node", "root").distinct(), sets)
        if held.isEmpty():
            return None
        members = settle(_open(settle(members.drop("root").join(held, "node"))))
        centres = settle(members.groupBy("sig").agg(F.min("node").alias("u")))
        clusters = settle(components(members.join(centres, "sig").select("u", F.col("node").alias("v")).distinct()).withColumnRenamed("root", "cluster").join(sets, "node"))
        blocks = settle(clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.sqrt(F.sum("n") / BLOCK), F.sum("n") / MOST)).alias("blocks")))
        placed = clusters.join(blocks, "cluster").join(held, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        texts = self.texts(settle(placed.select("cluster", "blocks", "block", "node", "root", "pick"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = texts.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "text")
        return settle(self._compared(dealt))

    def _compared(self, dealt: DataFrame) -> DataFrame:
        """Links (u, v) between components in each (cluster, low, high): of block low with block high, one for two components."""
        size, num, den = self.size, self.num, self.den

        def links(low: int, high: int, rows: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
            held = [r for r in rows if r[0] == low]
            elements = np.concatenate([r[3] for r in held]) if held else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(held)), [len(r[3]) for r in held])
            order = np.argsort(elements, kind="stable")
            elements, owner = elements[order], owner[order]
            lengths, roots, done = np.array([len(r[3]) for r in held]), np.array([r[2] for r in held]), set()
            for _, node, root, s in (r for r in rows if r[0] == high):
                first, last = np.searchsorted(elements, s, "left"), np.searchsorted(elements, s, "right")
                n = last - first
                at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(held))
                for i in np.flatnonzero((den * common >= num * (lengths + len(s) - common)) & (roots != root)).tolist():
                    pair = (min(root, held[i][2]), max(root, held[i][2]))
                    if pair not in done:
                        done.add(pair)
                        yield node, held[i][1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles, key, rows = Shingles(size), None, []
            for batch in batches:
                out = []
                for *now, block, node, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now != key:
                        if rows:
                            out += links(key[1], key[2], rows)
                        key, rows = now, []
                    rows.append((block, node, root, shingles.of(text)))
                if out:
                    yield _links(out)
            if rows:
                yield _links(list(links(key[1], key[2], rows)))

        keys = ["cluster", "low", "high"]
        return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")

    def _shared(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``members`` (node, root) that share enough n-grams with other components to have a link there."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingles = Shingles(size)
            for batch in batches:
                out, rows = [], 0
                for node, root, text in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "text")), strict=True):
                    s = shingles.of(text)
                    out.append(np.stack([np.full(len(s), node), np.full(len(s), root), s.view(np.int64)]))
                    rows += len(s)
                    if rows > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["node", "root", "shingle"])
                        out, rows = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["node", "root", "shingle"])

        members = settle(members.join(sets, "node").select("node", "pick", "root", "n"))
        elements = settle(self.texts(members.drop("n")).mapInArrow(run, "node long, root long, shingle long"))
        whole = elements
        for _ in range(PEELS):
            before, left = members, elements
            foreign = settle(left.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("shingle"))
            common = left.join(foreign, "shingle").groupBy("node").agg(F.count("*").alias("common"))
            members = settle(before.join(common, "node").where(self.den * F.col("common") >= self.num * F.col("n")).select(*before.columns))
            if members.count() == before.count():
                break
            elements = whole.join(members.select("node"), "node", "left_semi")
        discard(whole)
        return members.select("node", "root")

    def link(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) per document."""
        nodes, labels = self.roots()
        joined = nodes.join(labels, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root"))
        least = settle(joined.where("node != 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
        out = joined.join(least, "root", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _open(members: DataFrame) -> DataFrame:
    """The rows (sig, node, root) of the settled table ``members`` whose signature more than one component has."""
    # written, so that the join has exchanges of its own and a frequent signature's rows can be split
    several = settle(members.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("sig"))
    return members.join(several, "sig")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component, the one with the least id; all columns as they were.

    Rows are told apart by id and a 128-bit hash of id and text: an id may stand for several texts, a null id
    comes after all others, and of rows equal in id and text one stays. Documents without words stay.
    """
    key, row = unused(docs.columns, "key", "row")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("key"))
    found = settle(NgramJoin(keyed.withColumn(row, name), id_col=row, text_col=text_col, **how).link())
    key_of, least = F.col("doc_id.key").alias(key), F.col("doc_id") == F.col("component_id")
    gone = found.where(~least).select(key_of).distinct()
    again = settle(found.where(least & (F.col("n_shingles") > 0)).groupBy(key_of).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if again.isEmpty():
        return keyed.join(gone, key, "left_anti").select(*docs.columns)
    once = keyed.join(again, key, "left_semi").dropDuplicates([key])
    return keyed.join(gone.union(again), key, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).link()
