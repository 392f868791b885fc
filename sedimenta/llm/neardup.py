"""Near-duplicate documents by chosen-path set similarity join over word shingles.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes), a 128-bit key of that set and its
   minwise tokens under 64 hash functions. Equal keys are one class, so exact copies cost one row from here on.
2. Sixteen independent trees (twenty for targets under .85) branch the classes: the node of a class is named by the tree's first minwise token; a
   node of more than NODE classes is branched again by the tree's next token, up to DEPTH. Small nodes are compared
   exhaustively on 4-bit sketches, with a threshold far below the target; nodes still large at the last depth are
   taken as alike. Both give a spanning forest of possible links only, never all pairs.
3. Components of possible links bound where true links can be. Inside them all pairs are settled on the full sets:
   a component of m classes is dealt in blocks, each pair of blocks to a task, which gives a spanning forest of the
   confirmed links.
4. Components of the confirmed links are the result.

A pair at the target similarity .85 meets in a node of one token with probability .85 in each tree, so it's missed with
probability .15**16; in a node at the last depth, (1 - .85**3)**16 = 3e-7. Its sketch falls below the possible-link
threshold (40 of 64 equal) with probability 1e-6 or less. For a target of .80, twenty trees miss it with (1 - .8**3)**20 =
6e-7, and the threshold is 35 of 64.

Null and empty texts and texts without words have an empty set and link with nothing. Texts under five words are one
shingle. Rows that repeat a document id are each given; equal sets under one id count as that id once. A row
with a null id has the component of its exact copies that have ids; a class of null ids only links with nothing and
has a null component, and those rows count as kept. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.graph import components
from sedimenta.llm.words import hashed_texts, jaccard_at_least, mix, shingle_set
from sedimenta.session import discard, scratch, written

PERCENT = 85
DEPTH, NODE = 3, 512
PERMUTATIONS = 64
BLOCK, MOST_BLOCKS, LARGEST_BLOCK = 128, 32, 4096

_rng = np.random.default_rng(977)
_FACTORS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES = np.uint64(0x1111111111111111)


def trees_for(percent: int) -> int:
    return 16 if percent >= 85 else 20


def possible_for(percent: int) -> int:
    """Equal sketch places, of PERMUTATIONS, from which a pair may link."""
    return 40 if percent >= 85 else 35


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, uint32 by permutation; long sets are taken in pieces."""
    out = np.full(PERMUTATIONS, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[at : at + 4096, None] * _FACTORS) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), key and tokens (64 x uint32 in bytes) of every row; key and tokens are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for _, words, edges in hashed_texts(batch.column(1)):
                for i in range(len(edges) - 1):
                    found = shingle_set(words[edges[i] : edges[i + 1]])
                    sizes.append(len(found))
                    keys.append(set_key(found) if len(found) else None)
                    tokens.append(minwise(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], names=["doc_id", "n", "key", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n int, key binary, tokens binary")


def _nodes(classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """A row for each class and wanted tree: its node at this depth, set size, key and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(n, PERMUTATIONS)
            four = (tokens & 15).astype(np.uint8)
            sketch = (four[:, ::2] | four[:, 1::2] << 4).tobytes()
            sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(sketch)]).cast(pa.binary())
            wanted = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            for tree in range(trees):
                h = np.full(n, tree + 1, np.uint64)
                for level in range(depth):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[:, tree * DEPTH + level])
                out = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1), batch.column(0), sketches], names=["node", "n", "key", "sketch"])
                if wanted is not None:
                    out = out.filter(pa.array([t == tree for t in wanted]))
                if len(out):
                    yield out

    return classes.mapInArrow(run, "node long, n int, key binary, sketch binary")


def _find(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def possible_links(keys: list[bytes], sizes: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs of a node that may link: comparable sizes, enough equal sketch places."""
    up, out, least = np.arange(len(keys)), [], possible_for(percent)
    for i in range(len(keys) - 1):
        x = sketches[i + 1 :] ^ sketches[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = PERMUTATIONS - np.bitwise_count(x & _NIBBLES).sum(1)
        rest = sizes[i + 1 :]
        for j in np.flatnonzero((equal >= least) & (100 * np.minimum(rest, sizes[i]) >= percent * np.maximum(rest, sizes[i]))):
            p, q = _find(up, i), _find(up, i + 1 + int(j))
            if p != q:
                up[q] = p
                out.append((keys[i], keys[i + 1 + int(j)]))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with equal values in column 0 of sorted batches, as tables of two rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        node = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        if held and held[0].column(0)[0].as_py() != int(node[0]):
            if sum(map(len, held)) > 1:
                yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b < len(node):
                if held:
                    yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                    held = []
                elif b - a > 1:
                    yield pa.Table.from_batches([batch.slice(a, b - a)])
            else:
                held.append(batch.slice(a, b - a))
    if held and sum(map(len, held)) > 1:
        yield pa.Table.from_batches(held)


PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], schema=PAIRS)


def _compare_nodes(rows: DataFrame, percent: int) -> DataFrame:
    """Possible links of small nodes; a node's rows are met by one task, NODE at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u8").reshape(-1, 4)
            if links := possible_links(group.column("key").to_pylist(), np.asarray(group.column("n")).astype(np.int64), sketches, percent):
                yield _pairs(links)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a binary, b binary")


def candidate_links(classes: DataFrame, folder: str, percent: int = PERCENT) -> DataFrame:
    """Possible links (a, b) between the classes (key, n, tokens), from all trees and depths."""
    light, last, trees = [], None, trees_for(percent)
    live = classes.select("key", "n", "tokens")
    for depth in range(1, DEPTH + 1):
        rows = _nodes(live, depth, trees)
        if depth > 1:  # these are few, and are read three times
            rows = written(rows, f"{folder}/rows-{depth}")
        large = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(f"size > {NODE}"), f"{folder}/large-{depth}").select("node")
        light.append(rows.join(large, "node", "left_anti"))
        if large.isEmpty():
            break
        heavy = rows.join(large, "node", "left_semi")
        if depth < DEPTH:
            live = written(_trees(heavy, classes, depth, trees), f"{folder}/live-{depth}")
        else:
            heads = heavy.groupBy("node").agg(F.min("key").alias("b"))
            last = heavy.join(heads, "node").where("key != b").select(F.col("key").alias("a"), "b")
    all_light = light[0]
    for more in light[1:]:
        all_light = all_light.unionByName(more)
    out = _compare_nodes(all_light, percent)
    return (out if last is None else out.unionByName(last)).distinct()


def _trees(heavy: DataFrame, classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """(key, n, tokens, tree) for the rows of large nodes: which tree a node belongs to follows from its tokens."""
    return heavy.select("key", "node").join(classes.select("key", "n", "tokens"), "key").mapInArrow(lambda batches: _with_tree(batches, depth, trees), "key binary, n int, tokens binary, tree int")


def _with_tree(batches: Iterator[pa.RecordBatch], depth: int, trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(len(batch), PERMUTATIONS)
        node, tree = np.asarray(batch.column(1)).view(np.uint64), np.zeros(len(batch), np.int32)
        for t in range(trees):
            h = np.full(len(batch), t + 1, np.uint64)
            for level in range(depth):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[:, t * DEPTH + level])
            tree[h == node] = t
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(tree)], names=["key", "n", "tokens", "tree"])


def confirmed_links(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """True links (a, b), a spanning forest for each pair of blocks, between members (key, rep, cluster, size, blocks).

    Sets are made again from the text of each class's first document and checked against the key.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(1).to_pylist(), []
            for row, words, edges in hashed_texts(batch.column(0)):
                for i in range(len(edges) - 1):
                    found = shingle_set(words[edges[i] : edges[i + 1]])
                    data.append(found.tobytes() if set_key(found) == keys[row + i] else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(data, pa.binary())], names=["key", "cluster", "blocks", "data"]).filter(pa.array([d is not None for d in data]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            if len(set(keys := group.column("key").to_pylist())) < len(keys):  # rows that repeat a document
                group = group.take([*{k: i for i, k in enumerate(keys)}.values()])
                keys = group.column("key").to_pylist()
            data = [np.frombuffer(x, "<u8") for x in group.column("data").to_pylist()]
            side = np.asarray(group.column("side"))
            yield _pairs(true_links(keys, data, side, percent))

    first = members.select(F.col("rep").alias("id"), "key", "cluster", "blocks")
    texts = docs.join(first.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("text", "key", "cluster", "blocks").mapInArrow(sets, "key binary, cluster binary, blocks int, data binary")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = texts.withColumn("mine", mine).withColumn("other", other)
    pair = F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = dealt.select(pair.alias("pair"), side.alias("side"), "key", "data")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(settle, "a binary, b binary")


def true_links(keys: list[bytes], data: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the confirmed links of a block (side 2) or between two blocks (sides 0 and 1)."""
    n, out = len(keys), []
    up = np.arange(n)
    sizes = np.array([len(x) for x in data])
    tokens = np.stack([minwise(x) for x in data])
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        fit = (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])) & ((side[rest] != side[i]) | (side[i] == 2))
        fit &= (tokens[rest] == tokens[i]).sum(1) >= possible_for(percent) - 6
        for j in rest[fit].tolist():
            p, q = _find(up, i), _find(up, j)
            if p != q and jaccard_at_least(data[i], data[j], percent):
                up[q] = p
                out.append((keys[i], keys[j]))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least document id reachable) and kept (doc_id is component_id) of every row."""
    return _grouped(docs, id_col, text_col, percent, folder).drop("key")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, folder: str | None = None) -> DataFrame:
    """near_duplicates() with the key of each row's set, null for empty ones."""
    folder = folder or scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(sketch_sets(docs), f"{folder}/sketches")
    full = sketches.where("key is not null")
    least = full.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n", "tokens")).alias("x"), F.min("doc_id").alias("least"))
    classes = written(least.select("key", F.col("x.doc_id").alias("rep"), "least", "x.n", "x.tokens"), f"{folder}/classes")
    candidates = written(candidate_links(classes.where("rep is not null"), folder, percent), f"{folder}/candidates")
    clusters = components(candidates, folder=f"{folder}/possible")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / F.least(F.lit(LARGEST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.col("size") / MOST_BLOCKS)))).cast("int")
    members = clusters.join(sizes, "root").select(F.col("node").alias("key"), F.col("root").alias("cluster"), blocks.alias("blocks")).join(classes.select("key", "rep"), "key")
    linked = components(written(confirmed_links(docs, members, percent), f"{folder}/links"), folder=f"{folder}/linked")
    placed = classes.select("key", "least").join(linked.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    placed = written(placed, f"{folder}/placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(placed.join(named, "root").select("key", "component_id"), f"{folder}/named")
    steps = [f"{x}-{d}" for x in ("rows", "large", "live") for d in range(1, DEPTH + 1)]
    discard(docs.sparkSession, *(f"{folder}/{x}" for x in (*steps, "classes", "candidates", "possible", "links", "linked", "placed")))
    n = F.col("n").cast("long").alias("n_shingles")
    some = full.select("doc_id", n, "key").join(named, "key").select("doc_id", "n_shingles", "component_id", "key")
    none = sketches.where("key is null").select("doc_id", n, F.col("doc_id").alias("component_id"), "key")
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, but for those that aren't kept; rows of null ids stay.

    Ids decide where all rows of an id go or stay together. Where they don't, an id being shared by texts of different
    groups, the rows of these ids get the key of their set and go by id and key.
    """
    folder = scratch(docs.sparkSession, "keep-one")
    found = _grouped(docs, id_col, text_col, percent).where("doc_id is not null").select(F.col("doc_id").alias("__gone"), (~F.col("kept")).alias("goes"), "key")
    ids = written(found.groupBy("__gone").agg(F.max("goes").alias("some"), F.min("goes").alias("every")).where("some"), f"{folder}/ids")
    mine = F.col(id_col).cast("long")
    left = docs.join(ids.where("every"), mine == F.col("__gone"), "left_anti")
    shared = ids.where("not every").select("__gone")
    if shared.isEmpty():
        return left
    keys = found.where("goes").join(shared, "__gone").select("__gone", F.col("key").alias("__gone_key")).distinct()
    mixed = _with_key(left.join(shared, mine == F.col("__gone"), "left_semi"), text_col)
    stay = mixed.join(keys, (mine == F.col("__gone")) & (F.col("__key") == F.col("__gone_key")), "left_anti").drop("__key")
    return left.join(shared, mine == F.col("__gone"), "left_anti").unionByName(stay)


def _with_key(docs: DataFrame, text_col: str) -> DataFrame:
    """docs and the key of each row's set."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, words, edges in hashed_texts(batch.column(at).cast(pa.string())):
                keys += [set_key(shingle_set(words[a:b])) if b > a else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "__key"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__key", T.BinaryType())]))
