"""Near-duplicates: BagMinHash signatures in bands, exact weighted Jaccard on what shares a band, and classes.

Texts with equal words (by a 128-bit cryptographic digest of them) are one node from the start, so copies never meet as
pairs. A node is known by its content, whatever ids its rows have. Nodes that agree on all
registers of a band share that band's bucket. Of a bucket's possible pairs, few need a look:

1. every node is held against its bucket's least node (a star), and links of the threshold or more join classes;
2. in buckets that still hold several classes, the nodes outside the bucket's largest class are held against all
   others, in blocks of bounded size: pairs of one class, and pairs that share an earlier band, are left out, the
   signatures' estimate leaves out those far from the threshold, and the rest is verified.

So every pair of different classes that shares a band is decided, and no other is made. Verification is always
on the whole multisets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import bags, shingles, signatures, weighted_jaccard
from .common import release, ship, written
from .components import components
from .textarrays import mix, slices, text_bytes

BANDS, ROWS = 28, 5
#: An estimate this much below the threshold is five standard deviations away, for 140 registers at 0.8. With a margin
#: of 1, every pair that shares a band is verified.
MARGIN = 0.17
BLOCK = 128
_U = np.uint64


def _elements(data: np.ndarray, at: np.ndarray):
    c0, c1, hashes, places = shingles(data, at)
    return c0, c1, *bags(hashes, places)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        for i, j in slices(at):
            c0, c1, owner, element, weight = _elements(data[at[i] : at[j]], at[i : j + 1] - at[i])
            sig = signatures(owner, element, weight, j - i, BANDS * ROWS)
            with np.errstate(over="ignore"):
                band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :] + _U(1), j - i, axis=0)
                for k in range(ROWS):
                    band = mix(band * _U(0x9E3779B97F4A7C15) + sig[:, k::ROWS])
            size = np.bincount(owner, weight, j - i).astype(np.int64)
            small = np.ascontiguousarray(sig.astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(c0.view(np.int64)), pa.array(c1.view(np.int64)), pa.array(size), _fixed(band.view(np.int64)), _binary(small)],
                names=["id", "text_hash", "c0", "c1", "size", "bands", "sig"],
            )


def _fixed(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, text, c0, c1), the sorted elements of those rows whose text is the node's."""
    for batch in batches:
        data, at = text_bytes(batch.column(1))
        wanted = [batch.column(k).to_numpy().view(np.uint64) for k in (2, 3)]
        for i, j in slices(at):
            c0, c1, owner, element, weight = _elements(data[at[i] : at[j]], at[i : j + 1] - at[i])
            flat = np.repeat(element, weight)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, weight, j - i))]).astype(np.int64) * 8
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            own = pa.array((c0 == wanted[0][i:j]) & (c1 == wanted[1][i:j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), held.cast(pa.binary())], names=["node", "elements"]).filter(own)


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [weighted_jaccard(np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)) >= threshold for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Classes:
    """Classes joined within a block."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x


def block_links(rows: dict[str, list], threshold: float, margin: float = MARGIN) -> list[tuple[int, int]]:
    """Links between the residual rows and the members of one block of a bucket, as many as join its classes."""
    residual = np.array(rows["residual"], bool)
    r, m = np.flatnonzero(residual), np.flatnonzero(~residual)
    if not len(r) or not len(m):
        return []
    bands = np.array([b.as_py() for b in rows["bands"]], np.int64)
    sig = np.frombuffer(b"".join(s.as_py() for s in rows["sig"]), np.uint16).reshape(len(residual), -1)
    size, own, node = np.array(rows["size"]), np.array(rows["component"]), np.array(rows["node"])
    near = own[r][:, None] != own[m][None, :]
    near &= np.minimum(size[r][:, None], size[m][None, :]) >= (threshold - 1e-9) * np.maximum(size[r][:, None], size[m][None, :])
    i, j = np.nonzero(near)
    if not len(i):
        return []
    first = (bands[r[i]] == bands[m[j]]).argmax(axis=1) == rows["band"][0]
    i, j = i[first], j[first]
    like = (sig[r[i]] == sig[m[j]]).mean(axis=1)
    order = np.argsort(-like, kind="stable")
    order = order[like[order] >= threshold - margin]
    classes, links = _Classes(), []
    elements = rows["elements"]
    for k in order:
        a, b = r[i[k]], m[j[k]]
        p, q = classes.find(int(own[a])), classes.find(int(own[b]))
        if p != q and weighted_jaccard(np.frombuffer(elements[a].as_buffer(), _U), np.frombuffer(elements[b].as_buffer(), _U)) >= threshold:
            links.append((int(node[a]), int(node[b])))
            classes.above[p] = q
    return links


_BLOCK_COLUMNS = ["node", "component", "residual", "band", "size", "bands", "sig", "elements"]


def _blocks(threshold: float, margin: float):
    """Batches are sorted by block; a block may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {c: [] for c in _BLOCK_COLUMNS}, None

        def ended() -> pa.RecordBatch:
            links = block_links(held, threshold, margin)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "i", "j")], strict=True))
            columns = {c: batch.column(c) if c in ("bands", "sig", "elements") else batch.column(c).to_pylist() for c in _BLOCK_COLUMNS}
            for k, own in enumerate(keys):
                if own != key:
                    if key is not None:
                        yield ended()
                    held, key = {c: [] for c in _BLOCK_COLUMNS}, own
                for c in _BLOCK_COLUMNS:
                    held[c].append(columns[c][k])
        if key is not None:
            yield ended()

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, margin: float = MARGIN, with_text_hash: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of its class), kept (doc_id is class_id). With
    with_text_hash: text_hash, xxhash64 of the text, as well, which tells rows of one id apart.

    Two texts are linked when their multisets of five-word shingles (A-Z in lower case; words end at
    [\\x20\\x09-\\x0D]) have a weighted Jaccard similarity of the threshold or more; classes are the links'
    components. A text of one to four words is one shingle of them all.

    * A null text counts as the empty one; texts without words are copies of each other.
    * Rows that repeat an id with other texts are in the classes of their texts; those that repeat id and text are kept
      together. A null id can't name a class: such a row joins the class of its text, and is kept only if no row of that
      class has an id; one such row of a class is.
    * Very long texts are whole; batches between Spark and Python are bounded in bytes
      (spark.sql.execution.arrow.maxBytesPerBatch), or hold a single longer row.
    * Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    features = texts.mapInArrow(_features, "id long, text_hash long, c0 long, c1 long, size long, bands array<long>, sig binary")
    features = written(features.withColumn("row", F.monotonically_increasing_id()), "near-features")
    copies = written(features.groupBy("c0", "c1").agg(F.min("row").alias("node"), F.min("id").alias("least")), "near-copies")
    # Each distinct text's features, once.
    nodes = features.join(copies.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = nodes.filter("size > 0").withColumnRenamed("row", "node")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket", "least")
    shared = written(shared, "near-buckets")
    in_bucket = written(banded.join(shared, "bucket"), "near-members")
    wanted = in_bucket.select("node").distinct().join(nodes.select("node", "id", "text_hash", "c0", "c1"), "node")
    wanted = written(wanted.withColumnsRenamed({"id": "of_id", "text_hash": "of_text"}), "near-nodes")
    same = texts["id"].eqNullSafe(wanted["of_id"]) & (texts["text_hash"] == wanted["of_text"])
    # wanted grows with the corpus, so it is never broadcast: the texts are shuffled at every size alike.
    held = texts.join(wanted.hint("merge"), same).select("node", "text", "c0", "c1").mapInArrow(_shingle_rows, "node long, elements binary")
    held = written(held.dropDuplicates(["node"]), "near-shingles")

    stars = in_bucket.filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stars.join(held.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    links = written(pairs.mapInArrow(_linked(threshold), "a long, b long"), "near-stars")
    first = components(links)
    release(shared, wanted, links)

    # Buckets of several classes: the rows outside the largest class against all rows, in blocks.
    label = F.coalesce("component", "node").alias("component")
    classed = written(in_bucket.select("bucket", "band", "node").join(first, "node", "left").select("bucket", "band", "node", label), "near-classed")
    by_class = classed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_class.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).filter("n > top.n")
    mixed = mixed.select("bucket", F.col("top.component").alias("largest"), F.ceil(F.col("n") / BLOCK).cast("int").alias("of_all"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("of_residual"))
    rows = classed.join(mixed, "bucket")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("bucket", "band", "node", "component", F.lit(False).alias("residual"), F.pmod(F.xxhash64("node"), "of_all").cast("int").alias("j"), upto("of_residual").alias("i"))
    residual = rows.filter("component <> largest").select("bucket", "band", "node", "component", F.lit(True).alias("residual"), F.pmod(F.xxhash64("node", F.lit(1)), "of_residual").cast("int").alias("i"), upto("of_all").alias("j"))
    described = nodes.select("node", "size", "bands", "sig").join(held, "node")
    described = written(described.join(rows.select("node").distinct(), "node", "left_semi"), "near-described")
    blocks = members.unionByName(residual).join(described, "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = blocks.select("bucket", "i", "j", *_BLOCK_COLUMNS).mapInArrow(_blocks(threshold, margin), "a long, b long")
    more = written(more, "near-blocks")
    release(in_bucket, held, classed, described)

    # The new links join classes; what they join is few.
    class_of = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    contracted = more.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    second = components(contracted)
    one = first.unionByName(contracted.select(F.col("a").alias("node"), F.col("a").alias("component"))).unionByName(contracted.select(F.col("b").alias("node"), F.col("b").alias("component")))
    one = one.groupBy("node").agg(F.min("component").alias("component"))
    final = one.join(second.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))

    # A class is known by its least node, which is its least row, and named by its least id.
    linked = written(copies.join(final, "node").select("node", "least", "component"), "near-linked")
    named = linked.groupBy("component").agg(F.min("least").alias("class_id"))
    of_node = linked.select("node", "component").join(named, "component")
    by_text = copies.join(of_node, "node", "left").select("c0", "c1", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"))
    found = features.select("id", "text_hash", "row", "c0", "c1").join(by_text, ["c0", "c1"])
    kept = F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull() & (F.col("row") == F.col("component"))).alias("kept")
    return found.select(F.col("id").alias("doc_id"), *(["text_hash"] if with_text_hash else []), "class_id", kept)
