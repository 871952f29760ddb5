"""N-gram Jaccard join: all links between documents whose shingle sets have a Jaccard index of at least p percent.

Universe partition. Sets fall into size bands (powers of two). A band's scheme hashes all shingles into
m segments. Two sets of which the smaller has s members and that are similar differ in at most
H = s (100 - p) / p members, so all but H segments hold the same subset. A set therefore publishes the hashes
of H + 1 of its segment subsets, in the scheme of its own band and of the bands its smaller partners may be in. Which
ones is an allocation by cost, taken in the order of the segments: empty subsets cost most and are
passed over, then subsets that many sets have (``hot``, counted over all documents) are. Since a subset's cost is
the same for all, of two similar sets the one whose choice ends first shares a published subset with
the other. A set with too few non-empty segments publishes all of them and their one-deletion
neighbourhoods; if twice their number is too small as well, a common key of such sets.

Buckets of equal subsets: small ones give all pairs of their sets; large ones (groups of near copies) give
pairs with one pivot, and only what links leave apart is looked at again, with another pivot, at last
in full, block by block. Pairs pass a bound on the difference (counts of shingles by class) and are then verified exactly on whole texts. Equal sets
are one node from the start. Links are joined to components by star contraction.

The hot list (``hot_keys`` most frequent subsets) and the filter of needed texts are of bounded size and
change cost only, never the result; a filter that would be too full is replaced by a join. A subset of more than
``HOT_ROWS`` sets is dealt to several tasks by node. Sets are identified by 64-bit hashes: of n different sets some
n * n / 2**65 pairs are taken for equal (one in a million runs at 10**7 sets, one or two pairs at 10**10).

Defined cases: null texts and texts without words have the empty set, n_shingles 0, and are linked with
nothing; repeated rows and equal sets share a component, and each row is returned; a null doc_id stays null and never
is a component's smallest id, unless all are null; other columns are dropped (``components``) or kept
(``keep_first``); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm import textops as X

U = X.U
FILTER_BITS = 1 << 24
HOT_ROWS = 1 << 16  # of a subset that go to one task; more are dealt by node as well
SMALL = 32  # sets in a bucket that gives all its pairs; subsets that more sets have are hot
MOST_BITS = 14  # of classes of hashes
_PARTNERS = 256  # of a pivot that go to one task
_ROWS_IN_BLOCK = 4096
_SCHEME, _SEGMENT, _NODE = (X.mix(np.array([11, 12, 13], U)) | U(1))
_SEEN = 1 << 20


def node_id(s: np.ndarray) -> int:
    """The 64-bit identity of a set."""
    with np.errstate(over="ignore"):
        return int(X.mix(np.array([X.mix(s ^ _NODE).sum() + U(len(s)) * _NODE], U)).view(np.int64)[0])


def signatures(s: np.ndarray, percent: int, hot: np.ndarray) -> list[np.ndarray]:
    """What a set (sorted hashes) publishes in each scheme it takes part in."""
    n, out = len(s), []
    least = -(-percent * n // 100)
    value = X.mix(s ^ _SEGMENT)
    for band in range(max(1, least.bit_length()), n.bit_length() + 1):
        top = (1 << band) - 1
        need = (100 - percent) * min(n, top) // percent + 1
        if need == 1 and (100 - percent) * n // percent == 0:
            continue  # no other set is similar
        m = 4 * (100 - percent) * top // (3 * percent) + 2
        segment = ((s >> U(32)) * U(m)) >> U(32)  # ascending, as the hashes are
        cut = np.flatnonzero(np.diff(segment.view(np.int64), prepend=-1))
        tag = segment * _SEGMENT + np.array([band], U) * _SCHEME
        total = np.add.reduceat(value, cut)
        sig = X.mix(total + tag[cut])
        if len(sig) >= need:
            if len(hot):
                cheap = hot[np.minimum(np.searchsorted(hot, sig), len(hot) - 1)] != sig
                sig = np.concatenate([sig[cheap][:need], sig[~cheap][: max(0, need - int(cheap.sum()))]])
            out.append(sig[:need])
        else:
            size = np.diff(np.append(cut, n))
            fewer = X.mix(np.repeat(total, size) - value + tag)
            empty = np.setdiff1d(np.arange(m, dtype=U), segment) * _SEGMENT + np.array([band], U) * _SCHEME
            rest = [X.mix(np.array([band], U) * _NODE)] if 2 * len(sig) < need else []
            out.append(np.unique(np.concatenate([sig, fewer, X.mix(empty), *rest])))
    return out


def classes(s: np.ndarray) -> bytes:
    """How many members are in each class of hashes, up to 255: classes by the top bits, half as many as
    members up to as many, so counts of smaller and larger sets can be folded to one resolution."""
    bits = min(MOST_BITS, max(6, len(s).bit_length() - 1))
    return np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of members that only one of two sets has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.size != b.size:
        if max(a.max(), b.max()) == 255:
            return 0
        size = min(a.size, b.size)
        a, b = a.reshape(size, -1).sum(1, dtype=np.int32), b.reshape(size, -1).sum(1, dtype=np.int32)
    return int(np.abs(np.subtract(a, b, dtype=np.int32)).sum())


def _sets(n: int) -> Callable:
    """Batches of texts as their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for block in X.blocks(batch, "text"):
                yield block, X.shingle_sets(block.column("text"), n)

    return run


def _nodes(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sets in _sets(n)(batches):
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([classes(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n", "node", "classes"],
            )

    return run


def bitmap(nodes: DataFrame) -> np.ndarray | None:
    """A bit for each distinct value of the first column, by its low bits; None if ``FILTER_BITS`` (2 MB)
    are not 8 for each value, as a fuller filter would let nearly all pass."""
    col = nodes.columns[0]
    size = 1 << max(12, (16 * nodes.count()).bit_length())
    if size > 2 * FILTER_BITS:
        return None
    size = min(size, FILTER_BITS)
    bits = np.zeros(size // 64, np.int64)
    words = nodes.groupBy(F.shiftright(F.col(col).bitwiseAND(F.lit(size - 1)), 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 63 AS int))")))
    for w, x in words.collect():
        bits[w] = x
    return bits.view(U)


def _bit(bits: np.ndarray, node: int) -> int:
    at = node & (len(bits) * 64 - 1)
    return int(bits[at >> 6]) >> (at & 63) & 1


def _publish(n: int, percent: int, hot: np.ndarray, skip: np.ndarray | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(n)(batches):
            keys, nodes, sizes = [], [], []
            for s in sets:
                if len(s) and (node := node_id(s)) not in seen and not (skip is not None and _bit(skip, node)):
                    seen.add(node)
                    found = signatures(s, percent, hot)
                    keys += found
                    nodes.append((node, sum(map(len, found))))
                    sizes.append(len(s))
            if len(seen) > _SEEN:
                seen.clear()  # copies are published again; that costs, no more
            if keys:
                times = [k for _, k in nodes]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat([i for i, _ in nodes], times)), pa.array(np.repeat(sizes, times))], ["sig", "node", "n"])

    return run


def _similar_bound(percent: int) -> Callable:
    """Drops pairs whose classes differ by more than similar sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
                counts = zip(batch.column("classes_a").to_pylist(), batch.column("classes_b").to_pylist(), strict=True)
                good = [abs(n - m) * (100 + percent) <= (n + m) * (100 - percent) and least_difference(x, y) * (100 + percent) <= (n + m) * (100 - percent) for (n, m), (x, y) in zip(sizes, counts, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _texts(n: int, bits: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block, sets in _sets(n)(batches):
            keep, nodes = [], []
            for i, s in enumerate(sets):
                if len(s):
                    node = node_id(s)
                    if (bits is None or _bit(bits, node)) and node not in seen:
                        seen.add(node)
                        keep.append(i)
                        nodes.append(node)
            if len(seen) > _SEEN:
                seen.clear()
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), block.column("text").take(pa.array(keep))], ["node", "text"])

    return run


def _verify(n: int, percent: int) -> Callable:
    """Rows of a pivot (b null) come before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.zeros(0, U)
        for block, sets in _sets(n)(batches):
            links = []
            for a, b, s in zip(block.column("a").to_pylist(), block.column("b").to_pylist(), sets, strict=True):
                if b is None:
                    pivot, own = a, s
                    continue
                if a != pivot:
                    raise RuntimeError(f"the text of node {a} is missing")
                shared = np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s)
                if 100 * shared >= percent * (len(own) + len(s) - shared):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return run


def _apart(percent: int) -> Callable:
    """Pairs of one key's rows that have different labels and that no cheap bound excludes. Rows come
    sorted by (sig, low, high); a key has two blocks of rows at most, and pairs are taken within the
    one block or between the two."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        node, label, n = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 6))
        block, size = np.array([r[3] for r in rows]), np.array([len(r[7]) for r in rows])
        common = int(size.min())
        fine = [np.frombuffer(r[7], np.uint8).reshape(common, -1) for r in rows]
        exact = np.array([x.shape[1] == 1 or x.max() < 255 for x in fine])
        counts = np.stack([x.sum(1, dtype=np.int32) if x.shape[1] > 1 else x[:, 0].astype(np.int32) for x in fine])
        both, out = rows[0][1] != rows[0][2], []
        for i in range(len(rows)):
            most = (n[i] + n) * (100 - percent)
            ok = (label[i] != label) & (node[i] < node) & (np.abs(n[i] - n) * (100 + percent) <= most)
            if both:
                ok &= block[i] != block
            y = np.flatnonzero(ok)
            if len(y):
                far = np.abs(counts[i] - counts[y]).sum(1, dtype=np.int64) * (100 + percent) > most[y]
                if exact[i]:
                    y = y[~(far & exact[y])]
                # each pair is given by the first bucket that holds both of its sets
                out += [(int(node[i]), int(node[j])) for j in y if min(rows[i][8] & rows[j][8]) == rows[0][0]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != r[:3]:
                    out += pairs(rows)
                    rows = []
                rows.append((*r[:8], set(r[8])))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if rows and (out := pairs(rows)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, percent: int, n: int, hot_keys: int, pivots: int):
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.text = self.rows.select("text").where("text IS NOT NULL")
        self.spark, self.percent, self.n, self.hot_keys, self.pivots = docs.sparkSession, percent, n, hot_keys, pivots
        self.nodes = scratch.table(self.rows.mapInArrow(_nodes(n), "doc_id long, n long, node long, classes binary"), "nodes")
        self.profile = self.nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("classes").alias("classes"))

    def buckets(self) -> DataFrame:
        """sig, node, n, size and pivot of all published subsets that different sets share."""
        kind = "sig long, node long, n long"
        copied = bitmap(self.nodes.where("n > 0").groupBy("node").count().where("count > 1").select("node"))
        counts = self.text.mapInArrow(_publish(self.n, self.percent, np.zeros(0, U), copied), kind).groupBy("sig").agg(F.count("*").alias("c"))
        frequent = scratch.table(counts.where(F.col("c") > SMALL), "frequent")
        top = scratch.most_frequent(frequent, "c", self.hot_keys).select("sig").collect()
        hot = np.sort(np.array([r[0] for r in top], np.int64).view(U))
        published = self.text.mapInArrow(_publish(self.n, self.percent, hot), kind)
        busy = frequent.where(F.col("c") > HOT_ROWS).selectExpr("sig", f"cast(ceil(c / {HOT_ROWS}) AS long) AS salts")
        whole = lambda keys: [f"count(*) OVER (PARTITION BY {keys}) AS size", f"min(node) OVER (PARTITION BY {keys}) AS low", f"max(node) OVER (PARTITION BY {keys}) AS high"]
        if busy.isEmpty():
            found = published.repartition("sig").dropDuplicates(["sig", "node"]).selectExpr("*", *whole("sig"))
            found = scratch.table(found.where("low < high").drop("high"), "buckets")
            scratch.drop(frequent)
            return found
        # busy subsets are 1 in HOT_ROWS rows at most
        published = published.join(F.broadcast(busy) if busy.count() <= HOT_ROWS else busy, "sig", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
        published = published.withColumn("salt", F.pmod("node", "salts")).repartition("sig", "salt").dropDuplicates(["sig", "salt", "node"])
        found = published.selectExpr("sig", "node", "n", "salts > 1 AS dealt", *whole("sig, salt"))
        found = scratch.table(found.where("dealt OR low < high"), "buckets")
        scratch.drop(frequent)
        dealt = found.where("dealt").select("sig", "node", "n")
        sizes = dealt.groupBy("sig").agg(F.count("*").alias("size"), F.min("node").alias("low")).where("size > 1")
        return found.where("NOT dealt").drop("dealt", "high").union(dealt.join(sizes, "sig").select("sig", "node", "n", "size", "low"))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b), a < b, that no cheap bound excludes."""
        side = lambda c: self.profile.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("classes").alias(f"classes_{c}"))
        return pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar_bound(self.percent), "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar, by their whole texts."""
        ends = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).distinct()
        bits = bitmap(ends)
        texts = self.text.mapInArrow(_texts(self.n, bits), "node long, text string")
        if bits is None:
            texts = texts.join(ends.withColumnRenamed("a", "node"), "node", "left_semi")
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
        texts = scratch.table(texts, "texts")
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / _PARTNERS).cast("long").alias("salts"))
        salted = pairs.join(salts, "a").select("a", "b", F.pmod("b", "salts").alias("salt"))
        partner = salted.join(texts.withColumnRenamed("node", "b"), "b", "left").select("a", "salt", "b", "text")
        pivot = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a", "left").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        rows = partner.unionByName(pivot).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        return rows.select("a", "b", "text").mapInArrow(_verify(self.n, self.percent), "a long, b long")

    def labels(self) -> DataFrame:
        """node and label (its component's smallest node) of every node with a link."""
        buckets = self.buckets()
        small, large = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
        fits = f"least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {self.percent}"
        both = small.alias("x").join(small.alias("y"), F.expr(f"x.sig = y.sig AND x.node < y.node AND {fits}")).selectExpr("x.node AS a", "y.node AS b")
        star = large.where("node > low").selectExpr("low AS a", "node AS b")
        pairs = scratch.table(self.plausible(both.union(star)), "pairs")
        links = scratch.table(self.links(pairs), "links")
        labels = scratch.table(components(links), "labels")
        for turn in range(self.pivots + 1):
            now = large.join(labels, "node", "left").select("sig", "node", "n", "size", F.coalesce("label", "node").alias("label"))
            now = scratch.table(now, "large")
            split = now.groupBy("sig").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("p")).where("least < most").select("sig", F.col("p.node").alias("pivot"), F.col("p.label").alias("own"))
            if turn < self.pivots:
                more = now.join(split, "sig").where("label <> own").selectExpr("least(pivot, node) AS a", "greatest(pivot, node) AS b")
                more = self.plausible(more.distinct().join(pairs, ["a", "b"], "left_anti"))
            else:
                more = self.apart(scratch.table(now.join(split.select("sig"), "sig", "left_semi"), "split")).distinct().join(pairs, ["a", "b"], "left_anti")
            more = scratch.table(more, "pairs")
            if more.isEmpty():
                continue
            pairs = pairs.union(more)
            links = scratch.table(links.union(self.links(more)), "links")
            labels = scratch.table(components(links), "labels")
        return labels

    def apart(self, rows: DataFrame) -> DataFrame:
        """Plausible pairs with different labels in buckets. The rows of a bucket's most frequent label are
        dealt to blocks that never meet each other; the other rows' blocks meet all blocks."""
        buckets = rows.groupBy("node").agg(F.collect_list("sig").alias("sigs"))  # no more than the set has published
        most = rows.groupBy("sig", "label").count().groupBy("sig").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("total"))
        blocks = lambda c: F.greatest(F.ceil(c / _ROWS_IN_BLOCK), F.lit(1)).cast("long")
        most = most.select("sig", F.col("top.label").alias("top"), blocks(F.col("top.count")).alias("large"), blocks(F.col("total") - F.col("top.count")).alias("rest"))
        rows = rows.join(most, "sig").join(buckets, "node").join(self.profile.select("node", "classes"), "node")
        top, hashed = F.col("label") == F.col("top"), F.xxhash64("node")
        rows = rows.withColumn("block", F.when(top, F.pmod(hashed, "large")).otherwise(F.col("large") + F.pmod(hashed, "rest")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.when(top, F.col("large")).otherwise(F.lit(0).cast("long")), F.col("large") + F.col("rest") - 1)))
        keyed = rows.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "n", "classes", "sigs")
        return keyed.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(_apart(self.percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of the nodes in ``links`` (a, b), by
    large-star and small-star contraction; a round costs in proportion to the links."""
    edges = links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct()
    edges = scratch.table(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.selectExpr("v AS u", "m AS v").where("u > v").union(pairs.selectExpr("u", "m AS v")).distinct()
        old, edges = edges, scratch.table(small, "edges")
        scratch.drop(old)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if state == before or state[0] == state[2] and edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = state


def components_of(docs: DataFrame, percent: int = 80, n: int = 5, hot_keys: int = 1 << 18, pivots: int = 1) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of all rows of ``docs`` (doc_id, text)."""
    join = Join(docs, percent, n, hot_keys, pivots)
    ids = join.profile.select("node", "doc_id").join(join.labels(), "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = ids.select("node", "label").join(least, "label").select("node", "component_id")
    key = F.coalesce("node", F.xxhash64("doc_id"))  # rows without a set are dealt evenly, and matched by none
    rows = join.nodes.select("doc_id", "n", key.alias("node")).join(of, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = 80, n: int = 5, hot_keys: int = 1 << 18, pivots: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a smaller doc_id in their component.
    Of rows that share the doc_id as well, all stay; rows without a set or an id stay."""
    drop = components_of(docs, percent, n, hot_keys, pivots).where("component_id < doc_id").select(F.col("doc_id").alias("_drop"))
    return docs.join(drop.distinct(), F.col("doc_id").cast("long") == F.col("_drop"), "left_anti")
