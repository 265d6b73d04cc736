"""Ranked lexical search: exact inner products by a sparse ball tree.

A document is a sparse vector over terms, with a damped term frequency as its
value; an item's score is the sum of its terms' weights times those values, all
in integers.  Items are searched in blocks of a bounded number of terms and
items.  For each block:

* one pass over the texts writes, for each document, its number of terms and
  the frequencies of the block's terms; lengths, and the documents that hold a
  term, are summed over all documents;
* documents are range-partitioned by the nearest of a few pivots, so that like
  ones meet, and each task builds ball trees over some thousand documents: a
  node has a centroid and a radius, and is halved along the line between two
  far documents;
* the inner product with any document of a node is at most that with the
  centroid plus the query's norm times the radius.  Bounds are floats, raised
  by more than the rounding of their sums can take away.  Each query takes a
  tree's nodes by falling bound until the bound is below its k-th score, which
  starts from a scored sample; leaves are scored in exact integers;
* a query's best of all trees are merged by a window whose limit is applied
  before its shuffle.

A tree holds TREE_ROWS documents and TREE_POSTINGS postings at most, but one
document at least, so a task's memory does not depend on the table.

Null and empty texts have no terms: such documents are not counted, and such
items find nothing.  Rows of items that share an id (null is one) are one item,
with the terms of all.  Repeated documents are ranked one by one; equal scores
go by doc_id, nulls last.  Texts of any length are read whole.  An empty table
gives no rows.  Only doc_id, item_id and text are read, whatever else there is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common

K = 10
#: Terms and items of a block, about; rows and postings of a tree; rows of a leaf; pivots; scored sample rows.
BLOCK_TERMS, BLOCK_ITEMS, TREE_ROWS, TREE_POSTINGS, LEAF_ROWS, PIVOTS, SEEDS = 200_000, 4_096, 16_384, 4_000_000, 64, 64, 2_048

#: Bytes that part terms: ASCII but for digits and letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, words, _, _ = common.split_words(b.column(1), between=_BETWEEN)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(common.segment_ids(offsets))), words.cast(pa.string())], names=["item_id", "term"])

    shape = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("term", T.StringType())])
    return items.select("item_id", "text").mapInArrow(run, shape).distinct()


def in_blocks(terms: DataFrame, most_terms: int = BLOCK_TERMS, most_items: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """Item terms with their block, and the number of blocks; an item lies in one block."""
    each = max(1, most_terms // most_items)
    sizes = terms.groupBy("item_id").agg(F.greatest(F.count("*"), F.lit(each)).alias("cost"))
    placed = common.running(common.in_parts(sizes, [F.col("item_id")], "items"), [F.col("item_id")], F.col("cost"), "before")
    placed = placed.select(F.col("item_id").alias("placed_id"), F.expr(f"cast(before div {most_terms} as int)").alias("block"))
    out = common.materialize(terms.join(placed, F.col("item_id").eqNullSafe(F.col("placed_id"))).drop("placed_id"), "item-terms")
    return out, out.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]


def frequencies(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (all terms of the document), and codes and tf of the vocabulary's terms in it, for documents with a term."""
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for b in common.slices(batches):
            offsets, words, _, _ = common.split_words(b.column(1), between=_BETWEEN)
            coded = words.dictionary_encode()
            code = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = code[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            row = common.segment_ids(offsets)
            pair, tf = np.unique((row * len(vocabulary) + at)[at >= 0], return_counts=True)
            row, at = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
            ends = pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, tf)]
            n = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=["doc_id", "n", "codes", "tf"]).filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def damped(n: np.ndarray, tf: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's value in a document of n terms, each posting by itself."""
    exact = object if 90 * int(n.max(initial=0)) * documents >= 2**63 else np.int64
    m = (100 - 90 + 90 * n.astype(exact) * documents // terms).astype(np.int64)
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


class Vectors:
    """Sparse rows: offsets, codes and integer values, with floats scaled by the terms' weights."""

    def __init__(self, offsets: np.ndarray, codes: np.ndarray, values: np.ndarray, weights: np.ndarray) -> None:
        self.offsets, self.codes, self.values = offsets, codes, values
        self.scaled = (weights[codes] * values).astype(np.float64)
        self.norms = np.add.reduceat(self.scaled**2, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)

    def take(self, rows: np.ndarray, weights: np.ndarray) -> Vectors:
        lengths = np.diff(self.offsets)[rows]
        at = np.repeat(self.offsets[rows], lengths) + common.runs(lengths)
        return Vectors(np.concatenate([[0], np.cumsum(lengths)]), self.codes[at], self.values[at], weights)


class BallTree:
    """Balls over sparse rows, and every query's bound for each of them.

    Rows are put in tree order; node i covers rows first[i] to last[i], and its
    children are 2i + 1 and 2i + 2 where it is no leaf.
    """

    def __init__(self, rows: Vectors, weights: np.ndarray, query_of: np.ndarray, query_codes: np.ndarray, queries: int, leaf_rows: int = LEAF_ROWS) -> None:
        width = len(weights)
        self.order, order = np.zeros(0, np.int64), np.arange(len(rows.offsets) - 1)
        self.span: dict[int, tuple[int, int]] = {0: (0, len(order))}
        self.bounds: dict[int, np.ndarray] = {}
        self.leaf_rows, lengths = leaf_rows, np.diff(rows.offsets)
        terms = np.bincount(query_of, minlength=queries)
        eps = np.finfo(np.float64).eps
        waiting = [0]
        while waiting:
            node = waiting.pop()
            start, stop = self.span[node]
            own = order[start:stop]
            n = lengths[own]
            at = np.repeat(rows.offsets[own], n) + common.runs(n)
            codes, x, ends = rows.codes[at], rows.scaled[at], np.cumsum(n) - n
            centre = np.bincount(codes, weights=x, minlength=width) / len(own)
            c = centre[codes]
            size = float(centre @ centre)
            far = np.add.reduceat((x - c) ** 2 - c**2, ends) + size
            # What the sums above may have lost to rounding: a factor of (terms + rows) eps of their parts.
            lost = 4 * (width + len(own) + 16) * eps * (size + float(rows.norms[own].max()) * 2)
            radius = math.sqrt(max(float(far.max()), 0.0) + lost)
            bound = np.bincount(query_of, weights=centre[query_codes], minlength=queries) + np.sqrt(terms) * radius
            bound *= 1 + 4 * (terms + len(own) + 16) * eps
            self.bounds[node] = np.minimum(bound, self.bounds[(node - 1) // 2]) if node else bound
            if len(own) > leaf_rows:
                a = int(np.argmax(far))

                def along(row: int, own: np.ndarray = own, codes: np.ndarray = codes, x: np.ndarray = x, ends: np.ndarray = ends) -> np.ndarray:
                    line = np.zeros(width)
                    line[rows.codes[rows.offsets[own[row]] : rows.offsets[own[row] + 1]]] = rows.scaled[rows.offsets[own[row]] : rows.offsets[own[row] + 1]]
                    return np.add.reduceat(x * line[codes], ends)

                to_a = along(a)
                to_b = along(int(np.argmax(rows.norms[own] - 2 * to_a)))
                order[start:stop] = own[np.argsort(to_b - to_a, kind="stable")]
                middle = (start + stop) // 2
                self.span[2 * node + 1], self.span[2 * node + 2] = (start, middle), (middle, stop)
                waiting += [2 * node + 1, 2 * node + 2]
        self.order, self.rows = order, rows.take(order, weights)

    def search(self, query: int, weights: np.ndarray, ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Tree rows and scores of the query's best k, of at least floor; weights has the query's terms' alone."""
        rows, found, scores, kth = self.rows, np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        heap = [(-self.bounds[0][query], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if 2 * node + 1 in self.span:
                for child in (2 * node + 1, 2 * node + 2):
                    if self.bounds[child][query] >= kth:
                        heapq.heappush(heap, (-self.bounds[child][query], child))
                continue
            start, stop = self.span[node]
            a, b = rows.offsets[start], rows.offsets[stop]
            score = np.add.reduceat(weights[rows.codes[a:b]] * rows.values[a:b], rows.offsets[start:stop] - a)
            good = np.flatnonzero(score >= kth)
            if len(good):
                found, scores = np.concatenate([found, start + good]), np.concatenate([scores, score[good]])
                best = np.lexsort((ids[self.order[found]], -scores))[:k]
                found, scores = found[best], scores[best]
                if len(scores) == k:
                    kth = max(kth, int(scores[-1]))
        return found, scores


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def search_block(docs: DataFrame, terms: list[tuple[object, str]], k: int, item_type: T.DataType, tree_rows: int, leaf_rows: int) -> DataFrame:
    """item_id, doc_id and score: at least the k best documents of each item of a block."""
    shape = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    arrow_type = to_arrow_type(item_type)
    vocabulary = sorted({t for _, t in terms})
    number, items = {t: i for i, t in enumerate(vocabulary)}, list(dict.fromkeys(i for i, _ in terms))
    place = {item: i for i, item in enumerate(items)}
    query_of = np.array([place[i] for i, _ in terms], np.int64)
    query_codes = np.array([number[t] for _, t in terms], np.int64)
    by_query = np.argsort(query_of, kind="stable")
    of_query = np.split(query_codes[by_query], np.cumsum(np.bincount(query_of, minlength=len(items)))[:-1])
    found = common.materialize(frequencies(docs, vocabulary), "frequencies")
    documents, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # one row for each term of the block
        held[r["code"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    found = found.where(F.size("codes") > 0)

    def vectors(n: pa.Array, codes: pa.Array, tf: pa.Array) -> Vectors:
        offsets, code = flat(codes)
        return Vectors(offsets, code, damped(np.repeat(n.to_numpy(), np.diff(offsets)), flat(tf)[1], documents, length), weights)

    # A bounded sample, by hash of the row, gives the pivots and the first k-th scores.
    sample = found.orderBy(F.xxhash64("doc_id", "n", "codes", "tf")).limit(SEEDS).drop("doc_id").toArrow().combine_chunks()
    floors, pivots = np.ones(len(items), np.int64), np.zeros((0, len(vocabulary)), np.float32)
    if sample.num_rows:
        seeds = vectors(*(sample.column(c).combine_chunks() for c in ("n", "codes", "tf")))
        pivots = np.zeros((min(PIVOTS, sample.num_rows), len(vocabulary)), np.float32)
        for i in range(len(pivots)):
            a, b = seeds.offsets[i : i + 2]
            pivots[i, seeds.codes[a:b]] = seeds.scaled[a:b] / max(math.sqrt(seeds.norms[i]), 1e-9)
        for i, own in enumerate(of_query):
            q = np.zeros(len(vocabulary), np.int64)
            q[own] = weights[own]
            score = np.add.reduceat(q[seeds.codes] * seeds.values, seeds.offsets[:-1])
            if len(score) >= k:
                floors[i] = max(1, int(np.partition(score, len(score) - k)[len(score) - k]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = vectors(*b.columns[1:]), np.zeros(b.num_rows, np.int32)
            best = np.full(b.num_rows, -1.0)
            for i, pivot in enumerate(pivots):
                like = np.add.reduceat(pivot[rows.codes] * rows.scaled, rows.offsets[:-1]) if b.num_rows else best
                at, best = np.where(like > best, i, at).astype(np.int32), np.maximum(best, like)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "pivot"])

    def tree_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        rows = vectors(*(table.column(c).combine_chunks() for c in ("n", "codes", "tf")))
        doc_id = table.column("doc_id").combine_chunks()
        ids = pc.fill_null(doc_id, 2**63 - 1).to_numpy() if pa.types.is_integer(doc_id.type) else np.asarray(pc.rank(doc_id, tiebreaker="dense"))
        tree = BallTree(rows, weights, query_of, query_codes, len(items), leaf_rows)
        item, at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        q = np.zeros(len(vocabulary), np.int64)
        for i, own in enumerate(of_query):
            q[own] = weights[own]
            row, score = tree.search(i, q, ids, k, int(floors[i]))
            q[own] = 0
            item.append(np.full(len(row), i)), at.append(tree.order[row]), scores.append(score)
        item_ids = pa.array(items, arrow_type)
        yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(np.concatenate(item))), doc_id.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], names=["item_id", "doc_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows = postings = 0
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            ends = np.asarray(b.column(2).offsets).astype(np.int64)
            start = 0
            while start < b.num_rows:
                stop = min(b.num_rows, start + tree_rows - held_rows, int(np.searchsorted(ends, ends[start] + TREE_POSTINGS - postings, side="right")) - 1)
                if stop <= start and not waiting:
                    stop = start + 1
                if stop > start:
                    waiting.append(b.slice(start, stop - start))
                    held_rows, postings = held_rows + stop - start, postings + int(ends[stop] - ends[start])
                start = max(start, stop)
                if start < b.num_rows:
                    yield from tree_of(waiting)
                    waiting, held_rows, postings = [], 0, 0
        if waiting:
            yield from tree_of(waiting)

    count = found.count()
    near = found.mapInArrow(nearest, T.StructType([*found.schema.fields, T.StructField("pivot", T.IntegerType())]))
    dealt = near.repartitionByRange(max(1, -(-count // tree_rows)), F.col("pivot"), F.xxhash64("doc_id", "n", "codes"), F.rand(7)).drop("pivot")
    return dealt.mapInArrow(search, shape)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Each item's k best documents with a score above 0: item_id, rank, doc_id, score."""
    item_type = items.schema["item_id"].dataType
    terms, blocks = in_blocks(item_terms(items), block_terms)
    shape = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    found = docs.sparkSession.createDataFrame([], shape)
    for block in range(blocks):
        own = [(r["item_id"], r["term"]) for r in terms.where(F.col("block") == block).orderBy("item_id", "term").collect()]  # bounded by the block's size
        if own:
            found = found.unionByName(search_block(docs, own, k, item_type, tree_rows, leaf_rows))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op13_lexical_search": """
with d as (select doc_id, row_number() over () as rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')) as term from documents),
f as (select rid, doc_id, term, count(*) as tf from d group by all),
l as (select rid, sum(tf)::bigint as n from f group by rid),
c as (select count(*) as n_docs, sum(n)::bigint as n_terms from l),
w as (select term, cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w from f, c group by term, n_docs),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')) as term from benchmark),
s as (select q.item_id, f.rid, f.doc_id, cast(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 90 + (90 * l.n * c.n_docs) // c.n_terms)))) as bigint) as score
      from q join f using (term) join w using (term) join l using (rid), c group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
}
