"""Near-duplicates by BagMinHash: weighted Jaccard similarity of the texts' multisets of word shingles.

A shingle that stands ``c`` times in a text has the levels 1 to ``c``.  Each level is a Poisson process of rate
one whose points fall on the signature's registers at random; a register keeps its earliest point.  Two texts
agree in a register with the probability of their weighted Jaccard similarity.  Levels are drawn in blocks
[2^k, 2^(k+1)) as one process of rate 2^k whose points pick a level inside, and a process stops at the latest
register of its text, so a text costs little more than its distinct shingles.

Signatures are cut into bands.  Texts that share a band are compared with one of them, the bucket's pivot, by
their whole multisets; where a bucket then holds several classes, with its member of most links too.  What
still stands in one bucket but in two classes is searched by an exact prefix filter, so that no pair that shares
a band and is similar enough is missed, and no group's pairs are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, groups, text_of, written
from .decontaminate import words_of

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^32, about 6 in 100,000.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: A graph of so many edges (a few megabytes) is one task's work.
FINISH_EDGES = 100_000
#: Length classes per factor of e in the prefix filter; results don't depend on it.
SIZES = 32
#: Words whose hash a worker keeps; results don't depend on it.
CACHE_WORDS = 400_000
_GROUP_CHARS = 2_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _salt(i: int) -> np.uint64:
    return np.uint64(int(_GOLDEN) * i % 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a UTF-8 text as sorted 64-bit hashes, and how often each stands in it.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    words = words_of(text)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    if not size:
        return hashes, np.zeros(0, np.int64)
    n = len(words) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = mixed * _FACTOR + hashes[i:i + n]
    mixed = _mix(mixed)
    mixed.sort()
    first = np.flatnonzero(np.concatenate(([True], mixed[1:] != mixed[:-1])))
    return mixed[first], np.diff(np.append(first, n))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures of several multisets at once: a row each, the identity of each register's first point."""
    sizes = [len(keys) for keys, _ in bags]
    keys = np.concatenate([np.empty(0, np.uint64), *(k for k, _ in bags)])
    counts = np.concatenate([np.empty(0, np.int64), *(c for _, c in bags)])
    owner = np.repeat(np.arange(len(bags)), sizes)
    seed, doc, top, low = [], [], [], []
    k = 0
    while len(keys):
        seed.append(_mix(keys + _salt(k + 1)))
        doc.append(owner)
        top.append(counts)
        low.append(np.full(len(keys), 1 << k, np.int64))
        k += 1
        more = counts >= 1 << k
        keys, counts, owner = keys[more], counts[more], owner[more]
    earliest = np.full((len(bags), registers), np.inf)
    identity = np.zeros(len(bags) * registers, np.uint64)
    if not seed:
        return identity.reshape(len(bags), registers)
    at_seed, at_doc, at_top, at_low = map(np.concatenate, (seed, doc, top, low))
    time, flat, step = np.zeros(len(at_seed)), earliest.reshape(-1), 0
    while len(at_seed):
        step += 1
        point = _mix(at_seed + _salt(64 + step))
        time = time - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / at_low
        draw = _mix(point ^ _GOLDEN)
        place = at_doc * registers + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
        inside = at_low + ((draw >> np.uint64(32)).astype(np.int64) & (at_low - 1)) <= at_top  # the point's level
        np.minimum.at(flat, place[inside], time[inside])
        first = inside & (time == flat[place])
        identity[place[first]] = point[first]
        alive = time < earliest.max(1)[at_doc]
        at_seed, at_doc, at_top, at_low, time = at_seed[alive], at_doc[alive], at_top[alive], at_low[alive], time[alive]
    return identity.reshape(len(bags), registers)


def band_keys(identity: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = identity.reshape(len(identity), bands, -1)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(identity), 1))
    for i in range(parts.shape[2]):
        keys = _mix(keys * _GOLDEN + parts[:, :, i])
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; two empty ones are equal."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


def sign(df: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """Per row: key, digest of the text, digest of its multiset (``node``), number of shingles, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups(batch, "text", _GROUP_CHARS):
                bags = [shingles(t, size) for t in own.column("text").to_pylist()]
                nodes = [hashlib.blake2b(k.tobytes() + c.tobytes(), digest_size=16).digest() for k, c in bags]
                keys = band_keys(signatures(bags))
                bands = [keys[i] if len(bags[i][0]) else [] for i in range(len(bags))]
                yield pa.RecordBatch.from_arrays(
                    [own.column("key"), own.column("digest"), pa.array(nodes, pa.binary()),
                     pa.array([int(c.sum()) for _, c in bags], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["key", "digest", "node", "n", "bands"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.unhex(F.md5(text_of(df, text))).alias("digest"), text_of(df, text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, digest binary, node binary, n long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Similarity of each pair (a, b).  The text of ``b`` is shuffled once a pair, that of ``a`` once a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            out = []
            for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if a != last:
                    last, bag = a, shingles(text_a, size)
                out.append(similarity(bag, shingles(text_b, size)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame, name: str = "links", finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(node, class) of the nodes of ``edges`` (a, b): each class is a connected component, named by one of its nodes.

    Each round every node joins the neighbour that a fresh random order puts first, itself included, and the
    edges are drawn between what is left: a constant share of the nodes goes each time, whatever the shape.  Once
    ``finish_edges`` or fewer are left, by count, one task joins the rest.
    """
    edges = written(edges.select("a", "b").where("a != b").distinct(), f"{name}-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = written(nodes.withColumn("class", F.col("node")), f"{name}-classes")
    round_no = 0
    while (left := edges.count()) > finish_edges:
        def order(c: str, seed: int = round_no) -> Column:
            return F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("node"))

        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        first = both.groupBy("v").agg(F.min(order("w")).alias("w")).select("v", F.least(F.col("w"), order("v"))["node"].alias("to"))
        first = written(first, f"{name}-joins-{round_no}")
        a, b = first.select(F.col("v").alias("a"), F.col("to").alias("to_a")), first.select(F.col("v").alias("b"), F.col("to").alias("to_b"))
        edges = written(
            edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-{round_no}")
        found = written(_renamed(found, first.withColumnRenamed("v", "class")), f"{name}-classes-{round_no}")
        round_no += 1
    if left:
        last = edges.coalesce(1).mapInArrow(_union_find, "class binary, to binary")
        found = written(_renamed(found, last), f"{name}-classes-last")
    return found


def _renamed(found: DataFrame, names: DataFrame) -> DataFrame:
    """``found`` with each class replaced by its new name in ``names`` (class, to), if it has one."""
    return found.join(names, "class", "left").select("node", F.coalesce("to", "class").alias("class"))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node of each node's component."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            low, high = sorted((find(a), find(b)))
            root[high] = low
    if root:
        names = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([find(x) for x in names], pa.binary())], names=["class", "to"])


def classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, class_id) of every row: rows of one class are linked by similarities of ``threshold`` or more.

    ``class_id`` is the least key of the class.  Words are normalised as for decontamination; texts without words
    (null, empty) are copies of each other.  A null key stays null and names no class unless all its keys are
    null.  Repeated rows are copies.  An empty table gives no rows.
    """
    with Scratch() as work:
        signed = written(sign(df, key, text, size), "signatures")
        # Copies, and texts of one multiset, are one node from here on.
        nodes = signed.groupBy("node").agg(
            F.min(F.struct("key", "digest")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        banded = nodes.select("node", "n", F.explode("bands").alias("band"))
        pivots = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1").drop("members")
        buckets = written(banded.join(pivots, "band"), "buckets")
        firsts = buckets.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        asked = buckets.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", "rep.key", "rep.digest")
        source = df.select(F.col(f"`{key}`").alias("key"), text_of(df, text).cast("binary").alias("text"))
        source = source.withColumn("digest", F.unhex(F.md5("text")))
        texts = source.join(asked, source["key"].eqNullSafe(asked["key"]) & (source["digest"] == asked["digest"])).select("node", "text")
        texts = written(texts.dropDuplicates(["node"]), "texts")

        linked = written(_verify(firsts, texts, size).where(F.col("similarity") >= threshold), "pivot-links")
        found = components(linked, "pivots")
        members = _open(buckets, found)
        if not members.isEmpty():
            found = _joined(found, _verify(_busiest(members, linked), texts, size), threshold, "busiest")
            members = _open(buckets, found)
            found = _joined(found, _verify(_prefix_pairs(members, texts, size, threshold), texts, size), threshold, "others")
        work.drop(df.sparkSession, signed, found)
    labelled = signed.select("key", "node").join(found, "node", "left").select("key", F.coalesce("class", "node").alias("class"))
    least = labelled.groupBy("class").agg(F.min("key").alias("class_id"))
    return labelled.join(least, "class").select("key", "class_id")


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members (band, node, n, class) of the buckets that hold more than one class."""
    members = buckets.join(found, "node", "left").select("band", "node", "n", F.coalesce("class", "node").alias("class"))
    several = members.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("band")
    return written(members.join(several, "band"), "open-buckets")


def _busiest(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs (a, b) of each open bucket's member with the most links and the members of other classes.

    The member in the middle of a crowd has the most links and joins what the first pivots left apart.
    """
    degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    ranked = members.join(degree, "node", "left")
    middle = ranked.groupBy("band").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "node", "class")).alias("m"))
    pairs = members.join(middle, "band").where(F.col("class") != F.col("m.class"))
    return pairs.select(F.col("m.node").alias("a"), F.col("node").alias("b")).distinct()


def _joined(found: DataFrame, verified: DataFrame, threshold: float, name: str) -> DataFrame:
    """``found`` after the links among ``verified`` join classes; only the classes' graph is searched."""
    links = written(verified.where(F.col("similarity") >= threshold).select("a", "b"), f"{name}-links")
    if links.isEmpty():
        return found
    a, b = (found.select(F.col("node").alias(c), F.col("class").alias(f"class_{c}")) for c in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left")
    # A node that no link had reached is a class of its own.
    edges = between.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    merged = components(edges, name)
    old = found.join(merged.select(F.col("node").alias("class"), F.col("class").alias("into")), "class", "left")
    old = old.select("node", F.coalesce("into", "class").alias("class"))
    new = merged.join(found.select("node"), "node", "left_anti")
    return written(old.unionByName(new.select("node", "class")).dropDuplicates(["node"]), f"{name}-all")


def _prefix_pairs(members: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs of open buckets' members of two classes that may still be linked; no link between two members is lost.

    Elements are a text's shingles, its repeats numbered, ordered by how few members have them.  Two multisets of
    similarity ``t`` share an element among the first ``n - ceil(t n) + 1`` of both, and at their first common
    element enough elements must be left in both.  So a text with many shingles of its own meets nobody, however
    large the crowd that shares its others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in groups(batch, "text", _GROUP_CHARS):
                out = []
                for text in own.column("text").to_pylist():
                    keys, counts = shingles(text, size)
                    again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    out.append(_mix(np.repeat(keys, counts) + again.astype(np.uint64) * _FACTOR).view(np.int64))
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array(out, pa.list_(pa.int64()))], names=["node", "elements"])

    nodes = members.select("node", "n", "class").distinct()
    elements = texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(run, "node binary, elements array<long>")
    elements = elements.select("node", F.explode("elements").alias("element"))
    often = elements.groupBy("element").agg(F.count("*").alias("held")).where("held > 1")
    shared = elements.join(often, "element")
    order = Window.partitionBy("node").orderBy("held", "element")  # the elements of one text
    ranked = shared.withColumn("place", F.row_number().over(order) - 1).withColumn("n_shared", F.count("*").over(Window.partitionBy("node")))
    # Elements nobody else has come first.
    ranked = ranked.join(nodes, "node").withColumn("place", F.col("place") + F.col("n") - F.col("n_shared"))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9)).select("element", "node", "n", "class", "place")
    prefix = written(prefix, "prefixes")
    several = prefix.groupBy("element").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("element")
    # Those of a text's elements that could pair it before this one: a pair counts at its first common element only.
    before = Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    prefix = written(prefix.join(several, "element").withColumn("before", F.collect_list("element").over(before)), "open-prefixes")
    longer, shorter = _sides(prefix, threshold)
    x, y = longer.withColumnsRenamed({c: f"x_{c}" for c in prefix.columns if c != "element"}), shorter.withColumnsRenamed(
        {c: f"y_{c}" for c in prefix.columns if c != "element"})
    # Classes meet first: the members of one class are never compared with each other.
    meet = ["element", "size"]
    met = x.select(*meet, "x_class").distinct().join(y.select(*meet, "y_class").distinct(), meet).where("x_class != y_class")
    pairs = x.join(met, [*meet, "x_class"]).join(y, [*meet, "y_class"])
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    pairs = pairs.where(
        ((F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") > F.col("y_node"))))
        & (F.col("y_n") >= threshold * F.col("x_n") - 1e-9)
        & (left >= threshold / (1 + threshold) * (F.col("x_n") + F.col("y_n")) - 1e-9)
        & ~F.arrays_overlap("x_before", "y_before"))
    return pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def _sides(prefix: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``prefix`` as the longer and as the shorter text of a pair, each with the pair's key ``size``.

    Both texts must have ``t / (1 + t)`` of both lengths left at their first common element.  For the shorter one
    that bounds the place by ``(1 - t) / (1 + t)`` of its own length; for the longer one it bounds the other's
    length from above, as similarity does from below.  Lengths are cut into classes of a few hundredths, and the
    longer text looks only in those between its bounds.  Texts that share one passage of too small a share of
    them therefore don't meet at all, however many they are.
    """
    def size(n: Column) -> Column:
        return F.floor(F.log(n) * SIZES)

    most = F.floor((F.col("n") - F.col("place")) * ((1 + threshold) / threshold) - F.col("n") + 1e-9)
    most, least = F.least(F.col("n"), most), F.greatest(F.ceil(threshold * F.col("n") - 1e-9), F.lit(1))
    longer = prefix.where(most >= least).withColumn("size", F.explode(F.sequence(size(least), size(most))))
    shorter = prefix.where(F.col("n") - F.col("place") >= 2 * threshold / (1 + threshold) * F.col("n") - 1e-9)
    return longer, shorter.withColumn("size", size(F.col("n")))


def deduplicate(df: DataFrame, text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the first in the input's order; the columns stay as they are."""
    row = fresh(df.columns, "row")
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "to-deduplicate")
    kept = classes(rows, row, text, size, threshold).where("key = class_id").select(F.col("key").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
