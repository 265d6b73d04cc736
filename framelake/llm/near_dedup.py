"""Near-duplicate detection by a chosen-path set similarity join.

A document's set is its distinct word shingles.  Equal sets form one class, and
only a class's representative goes on.  Each tree starts from one minwise token
of every set: sets that share it share a node.  A node with few members is
compared exhaustively; a larger one branches its members again by minwise
tokens chosen by the node itself, to nodes that share a longer path.  Sets of
similarity s share a chosen token with probability s, so a pair at s >= 0.85 is
missed by all TREES trees with probability 0.15**TREES at most where nodes are
small, and about (1 - 0.85 * 0.9775**MAX_LEVEL)**TREES where they are not:
0.00008 and 0.0004.  The pipeline's stage links at s >= 0.80 with STAGE_TREES:
0.2**STAGE_TREES and (1 - 0.8 * 0.96**MAX_LEVEL)**STAGE_TREES, 0.00006 and
0.0006.  The screen by signatures loses another 0.0001 and 0.0003 at most.
Nodes still large after MAX_LEVEL are compared whole, in tiles of two parts.

Comparing: signatures first drop the sets without a likely partner in their
node; then the full sets of the rest meet in the node, and links are confirmed
on them.  A node gives a link to its least member for each linked member, not
all pairs.  Components come from alternating star contractions.

Null and empty texts, and texts without words, have an empty set and are linked
with nothing; very long texts are compared by all their shingles.  Null ids
are no component's id unless it has no other.  Of repeated rows, and rows that
share a component's smallest id, exactly one is kept.  An empty table gives no
rows.  Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import coded_words, gram_hashes, hash_strings, mix64, slices

WORDS, PERCENT = 5, 85
#: The pipeline's stage: similarity in percent, and trees.
STAGE_PERCENT, STAGE_TREES = 80, 6
#: Length of a signature; trees; branches of a node below the root; levels below the root.
TOKENS, TREES, BRANCHES, MAX_LEVEL = 96, 5, 2, 3
#: Most members, and most shingles of all members together, of a node that is compared exhaustively.
NODE_ROWS, NODE_SHINGLES = 3_072, 2_000_000
#: A set goes on if its signature agrees with another's on so much less than the threshold.
SLACK = 0.15


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, hashed, sorted and end to end, and n + 1 offsets."""
    offsets, codes, distinct = coded_words(texts)
    x = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    n_grams = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(n_grams)
    out = np.zeros(int(n_grams.sum()), np.uint64)
    grams = gram_hashes(x, words)
    full = np.flatnonzero(counts >= words)
    at = np.repeat(offsets[:-1][full], n_grams[full]) + common.runs(n_grams[full])
    out[np.repeat(ends[full] - n_grams[full], n_grams[full]) + common.runs(n_grams[full])] = grams[at]
    for n in range(1, words):
        few = np.flatnonzero(counts == n)
        if len(few):
            out[ends[few] - 1] = mix64(gram_hashes(x, n)[offsets[:-1][few]] + np.uint64(n))
    for a, b in zip((ends - n_grams).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[(ends - n_grams)[n_grams > 0]] = True
    return out[first], np.concatenate([[0], np.cumsum(first)])[np.concatenate([[0], ends])]


def _factors(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(0, 2**32, tokens, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, tokens, dtype=np.uint32)


def signatures(shingles: np.ndarray, offsets: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """The minwise tokens of each row, all ones for an empty set."""
    out = np.full((len(offsets) - 1, tokens), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        y, starts = (shingles >> np.uint64(32)).astype(np.uint32), offsets[:-1][full]
        for k, (a, b) in enumerate(zip(*_factors(tokens), strict=True)):
            out[full, k] = np.minimum.reduceat(y * a + b, starts)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, row_key, n_shingles, the set's 128-bit digest, signature."""
    rows = docs.select("doc_id", common.text_hash("text").alias("text_hash"), "text")
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(n, T.LongType()) for n in ("row_key", "n_shingles", "set_a", "set_b")), T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            shingles, offsets = shingle_sets(batch.column(2))
            tokens = signatures(shingles, offsets)
            digest, full = np.zeros((2, batch.num_rows), np.uint64), np.flatnonzero(np.diff(offsets))
            if len(full):
                for i in range(2):
                    digest[i, full] = np.add.reduceat(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D * i)), offsets[:-1][full])
            width = 4 * tokens.shape[1]
            binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(0, width * batch.num_rows + 1, width, dtype=np.int32)), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(key + np.arange(batch.num_rows)), pa.array(np.diff(offsets)), *(pa.array(d.view(np.int64)) for d in digest), binary], names=schema.names)
            key += batch.num_rows

    return rows.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values in the first column, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(0)[0].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def as_matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def likely(tokens: np.ndarray, least: float) -> np.ndarray:
    """Which rows have another that agrees on at least that share of tokens."""
    out = np.zeros(len(tokens), bool)
    need = least * tokens.shape[1]
    step = max(1, 4_000_000 // max(1, tokens.size))
    for i in range(0, len(tokens), step):
        agree = (tokens[i : i + step, None, :] == tokens[None, :, :]).sum(axis=2)
        agree[np.arange(len(agree)), np.arange(i, i + len(agree))] = 0
        out[i : i + step] = agree.max(axis=1) >= need
    return out


def linked(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member of its component) within a node, by intersections counted in an inverted index."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, term = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(term, kind="stable")
    postings = row[order]
    df = np.bincount(term)
    begin = np.cumsum(df) - df
    ends = np.cumsum(sizes)
    label = np.arange(m)
    for i in range(m):
        if (label == label[0]).all():
            break
        own = term[ends[i] - sizes[i] : ends[i]]
        both = np.bincount(postings[np.repeat(begin[own], df[own]) + common.runs(df[own])], minlength=m)
        hit = np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))
        joined = np.unique(label[hit])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys)
    root = least[label]
    return keys[root != keys], root[root != keys]


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (node, key, n) by whether their node, of two members or more, is small; and the rows in large ones."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("mass"), F.count("*").alias("members")).where("m > 1")
    sizes = common.materialize(sizes, "sizes")
    table = common.materialize(common.join_counted(rows, sizes, ["node"], "members", sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]), "nodes")
    small = f"m <= {NODE_ROWS} and mass <= {NODE_SHINGLES}"
    large = table.where(f"not ({small})")
    return table.where(small).select("node", "key"), large, large.count()


def candidate_nodes(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """(node, key): the members of every node that is to be compared exhaustively."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.random.default_rng(11).permutation(TOKENS)[:trees]
        for b in batches:
            if b.num_rows:
                tokens = np.stack(as_matrix(b.column(2), np.uint32))[:, chosen]
                node = mix64(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, trees + 1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(node.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(np.repeat(b.column(1).to_numpy(), trees))], names=["node", "key", "n"])

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy().view(np.uint64)
            tokens = np.stack(as_matrix(b.column(3), np.uint32))
            children = []
            for j in range(BRANCHES):
                draw = mix64(node + np.uint64(j + 1))
                at = (draw % np.uint64(TOKENS)).astype(np.int64)
                children.append(mix64(draw ^ mix64(tokens[np.arange(len(tokens)), at].astype(np.uint64) + np.uint64(1))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children).view(np.int64)), *(pa.concat_arrays([b.column(i)] * BRANCHES) for i in (1, 2))], names=["node", "key", "n"])

    schema = "node long, key long, n long"
    small, large, left = _nodes(reps.select("key", "n", "signature").mapInArrow(roots, schema))
    found, level = [small], 0
    while left and level < MAX_LEVEL:
        level += 1
        rows = large.select("node", "key", "n").join(reps.select("key", "signature"), "key").select("node", "key", "n", "signature")
        small, large, left = _nodes(rows.mapInArrow(branch, schema))
        found.append(small)
    if left:
        parts = F.ceil(F.greatest(F.col("m") * 2 / NODE_ROWS, F.col("mass") * 2 / NODE_SHINGLES)).cast("int")
        cut = large.withColumn("parts", parts).withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found.append(cut.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "key"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def links(docs: DataFrame, rows: DataFrame, reps: DataFrame, percent: int, trees: int = TREES) -> DataFrame:
    """Confirmed links (a, b) between representatives, a forest of each node."""
    members = candidate_nodes(reps, trees)
    least = percent / 100 - SLACK

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            keep = likely(np.stack(as_matrix(g.column("signature"), np.uint32)), least)
            if keep.any():
                yield from g.select(["node", "key"]).filter(pa.array(keep)).combine_chunks().to_batches()

    signed = members.join(reps.select("key", "signature"), "key").select("node", "key", "signature")
    active = common.materialize(signed.repartition("node").sortWithinPartitions("node").mapInArrow(screen, "node long, key long"), "active")
    wanted = active.select("key").distinct().join(rows.select(F.col("row_key").alias("key"), "doc_id", "text_hash"), "key")
    wanted = wanted.select("key", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    texts = docs.select("doc_id", "text").withColumn("text_hash", common.text_hash("text"))
    texts = wanted.join(texts, (F.col("w_hash") == F.col("text_hash")) & F.col("w_id").eqNullSafe(F.col("doc_id"))).select("key", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shingles, offsets = shingle_sets(b.column(1))
            binary = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(shingles)])
            yield pa.RecordBatch.from_arrays([b.column(0), binary], names=["key", "shingles"])

    sets = common.materialize(texts.mapInArrow(full, "key long, shingles binary"), "sets").dropDuplicates(["key"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            a, b = linked(g.column("key").to_numpy(), as_matrix(g.column("shingles"), np.uint64), percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    met = active.join(sets, "key").select("node", "key", "shingles")
    return common.materialize(met.repartition("node").sortWithinPartitions("node").mapInArrow(confirm, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(key, root): root is the least key reachable over edges (a, b), by alternating large and small stars."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = common.materialize(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "key")
        seen = now


def near_dedup(docs: DataFrame, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_shingles, component_id, kept."""
    rows = common.materialize(sketch(docs), "sketch")
    ident = ["n_shingles", "set_a", "set_b"]
    classes = common.materialize(rows.where("n_shingles > 0").groupBy(*ident).agg(F.min("row_key").alias("rep"), F.count("*").alias("copies")), "sets_of")
    total, plain = rows.count(), rows.drop("signature")
    full = common.join_counted(plain.where("n_shingles > 0"), classes, ident, "copies", total)
    classed = common.materialize(full.unionByName(plain.where("n_shingles = 0").withColumn("rep", F.col("row_key"))), "classes")
    chosen = classed.where("rep = row_key and n_shingles > 0").select("row_key")
    reps = common.materialize(rows.join(chosen, "row_key").select(F.col("row_key").alias("key"), F.col("n_shingles").alias("n"), "signature"), "reps")
    roots = components(links(docs, rows, reps, percent, trees))
    named = classed.join(roots, classed["rep"] == roots["key"], "left").withColumn("root", F.coalesce("root", "rep"))
    named = common.materialize(named.select("doc_id", "text_hash", "row_key", "n_shingles", "root"), "roots")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))).alias("best"), F.count("*").alias("members"))
    whole = common.join_counted(named, common.materialize(best, "best"), ["root"], "members", total)
    return whole.select("doc_id", "text_hash", "n_shingles", F.col("best.doc_id").alias("component_id"), (F.col("best.row_key") == F.col("row_key")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at the stages' own threshold."""
    kept = common.materialize(near_dedup(docs, STAGE_PERCENT, STAGE_TREES).where("kept").select("doc_id", "text_hash"), "kept")
    return common.keep_rows(docs, kept)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.documents(spark, sf_dir)).drop("text_hash")
