"""Line de-duplication by a deletion-neighbourhood join.

Two lines are alike when one word inserted, deleted or replaced turns one into
the other and is at most `share` of the words of either, so that with a quarter
lines of four words and more can be alike, and with 1 all can.  Each distinct line emits, as hashed keys, itself
and every way to leave out one of its words.  Lines alike by a replacement share
the variant that lacks the word at the same place; lines alike by an insertion
are a line and a variant of the other.  Both kinds of key are aggregated to
their earliest line, so a hot key is summed up before its shuffle and no pairs
are expanded: all lines of a replacement key are alike to each other, and a
line and those that it is a variant of are alike.  The partner found is then
verified by its edit distance.  Of alike lines the earliest, by doc_id and line
number, is kept: a line is dropped if an earlier one is equal or alike to it.

Before variants are emitted, lines without a chance are put aside: after one
edit, two lines still share their first or their last half, so only lines that
share a hashed half with another distinct line emit variants.

Lines are compared by their words, as they stand; white space between words
does not count.  Blank lines are always kept.  Null texts have no lines, an
empty text has one, which is blank; very long texts and lines are read whole.
Null ids come first; rows of the same id, repeated rows among them, are ordered
by the scan.  An empty table gives no rows.  Columns other than doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import hash_strings, mix64, slices, split_words, text_bytes

#: The most that one word may be of a line for an edit of it to make lines alike.
SHARE = 0.25
_BASE = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF


def powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    np.cumprod(np.full(n, _BASE, np.uint64), out=out[1:])
    return out


def line_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows' lines: the row and number of each line, offsets of the lines into the word hashes, the word hashes."""
    data, rows = text_bytes(column)
    breaks = np.flatnonzero(data == 10)
    firsts = rows[:-1]
    per_row = np.diff(np.searchsorted(breaks, rows)) + (~np.asarray(column.is_null()))
    line_row = np.repeat(np.arange(len(column)), per_row)
    number = common.runs(per_row)
    before = np.searchsorted(breaks, firsts)
    # A row's first line begins with the row, each other after a break.
    place = np.maximum(before[line_row] + number - 1, 0)
    starts = np.where(number == 0, firsts[line_row], (breaks[place] + 1) if len(breaks) else 0)
    _, words, word_starts, _ = split_words(column, lower=False)
    coded = words.dictionary_encode()
    hashes = mix64(hash_strings(coded.dictionary))[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    offsets = np.append(np.searchsorted(word_starts, starts), len(word_starts))
    return line_row, number, offsets, hashes


def prefix_sums(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each line its n + 1 prefix hashes, end to end: of the first i words, sum of word * base**place."""
    n, total = counts, int(counts.sum())
    power = powers(int(n.max(initial=0)) + 1)
    terms = hashes[np.repeat(starts, n) + common.runs(n)] * power[common.runs(n)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    first = np.cumsum(n) - n
    at = np.repeat(first, n + 1) + common.runs(n + 1)
    return sums[at] - np.repeat(sums[first], n + 1) if total or len(n) else np.zeros(0, np.uint64)


def digests(prefix: np.ndarray, counts: np.ndarray) -> np.ndarray:
    whole = prefix[np.cumsum(counts + 1) - 1] if len(counts) else np.zeros(0, np.uint64)
    return mix64(whole + mix64(counts.astype(np.uint64)))


def half_keys(prefix: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): hashes of the first and the last h words of lines of `least` words, for h half of a line and of one a word shorter."""
    first = np.cumsum(counts + 1) - (counts + 1)
    inverse = pow(_BASE, -1, 1 << 64)
    back = np.empty(int(counts.max(initial=0)) + 2, np.uint64)
    back[0] = 1
    np.cumprod(np.full(len(back) - 1, inverse, np.uint64), out=back[1:])
    lines, keys = [], []
    for less in (0, 1):
        at = np.flatnonzero(counts >= least)
        if less:
            at = at[counts[at] % 2 == 0]  # else the same half
        h = (counts[at] - less) // 2
        tag = mix64(h.astype(np.uint64) * np.uint64(2))
        head = prefix[first[at] + h]
        tail = (prefix[first[at] + counts[at]] - prefix[first[at] + counts[at] - h]) * back[counts[at] - h]
        lines += [at, at]
        keys += [mix64(head ^ tag), mix64(tail ^ (tag + np.uint64(1)))]
    return np.concatenate(lines), np.concatenate(keys)


def variant_keys(prefix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, kind): kind 0 lacks the word at a place, kind 1 lacks a word anywhere, kind 2 is the line itself."""
    first = np.cumsum(counts + 1) - (counts + 1)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    line = np.repeat(np.arange(len(counts)), counts)
    i = common.runs(counts)
    base = first[line]
    without = prefix[base + i] + (prefix[base + counts[line]] - prefix[base + i + 1]) * inverse
    shorter = mix64(without + mix64((counts[line] - 1).astype(np.uint64)))
    at_place = mix64(shorter ^ mix64(i.astype(np.uint64) + np.uint64(1)))
    dropped = np.unique(np.stack([line.astype(np.uint64), shorter]), axis=1) if len(line) else np.zeros((2, 0), np.uint64)
    own = digests(prefix, counts)
    kinds = np.concatenate([np.zeros(len(line)), np.ones(dropped.shape[1]), np.full(len(counts), 2)]).astype(np.int32)
    return np.concatenate([line, dropped[0].astype(np.int64), np.arange(len(counts))]), np.concatenate([at_place, dropped[1], own]), kinds


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word's insertion, deletion or replacement at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return True
    i = int(differ[0])
    if len(a) == len(b):
        return len(differ) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return bool((long[i + 1 :] == short[i:]).all())


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """One row for each line: doc_id, text_hash, row_key, line_no, n_words, line (its digest), halves."""
    rows = docs.select("doc_id", common.text_hash("text").alias("text_hash"), "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("row_key", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("line", T.LongType()), T.StructField("halves", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            row, number, offsets, hashes = line_words(b.column(2))
            counts = np.diff(offsets)
            prefix = prefix_sums(hashes, offsets[:-1], counts)
            of, half = half_keys(prefix, counts, least)
            order = np.argsort(of, kind="stable")
            cuts = pa.array(np.searchsorted(of[order], np.arange(len(counts) + 1)).astype(np.int32))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(key + row), pa.array(number.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(digests(prefix, counts).view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(half[order].view(np.int64)))], names=schema.names)
            key += b.num_rows

    return rows.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row for each line: doc_id, line_no (from 0), n_words, kept, keep_doc_id, keep_line_no, edits (0, 1, or null where kept)."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    lines = common.materialize(line_table(docs, math.ceil(1 / share)), "lines")
    order = F.struct("doc_id", "row_key", "line_no", "text_hash")
    distinct = common.materialize(lines.where("n_words > 0").groupBy("line").agg(F.min(order).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("copies")), "distinct")
    halves = distinct.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    chance = halves.join(shared, "half", "left_semi").select("line").distinct()
    wanted = distinct.join(chance, "line").select("line", F.col("first.doc_id").alias("w_id"), F.col("first.text_hash").alias("w_hash"), F.col("first.line_no").alias("w_no"), "first")
    # Each text that holds such lines is read once, with the numbers of the lines.
    named = wanted.groupBy("w_id", "w_hash").agg(F.collect_set("w_no").alias("numbers"))
    texts = docs.select("doc_id", "text").withColumn("text_hash", common.text_hash("text"))
    found = named.join(texts, F.col("w_id").eqNullSafe(F.col("doc_id")) & (F.col("w_hash") == F.col("text_hash"))).select("numbers", "text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, number, offsets, hashes = line_words(b.column(1))
            asked = b.column(0)
            ask_row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(asked.offsets)))
            at = np.searchsorted(row, ask_row) + asked.flatten().to_numpy()
            counts = np.diff(offsets)[at]
            prefix = prefix_sums(hashes, offsets[:-1][at], counts)
            flat = hashes[np.repeat(offsets[:-1][at], counts) + common.runs(counts)]
            cuts = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(digests(prefix, counts).view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(flat.view(np.int64)))], names=["line", "words"])

    words = common.materialize(found.mapInArrow(pick, "line long, words array<long>"), "words").dropDuplicates(["line"])

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                flat = part.column(1).flatten().to_numpy().view(np.uint64)
                counts = np.diff(np.asarray(part.column(1).offsets)).astype(np.int64)
                prefix = prefix_sums(flat, np.cumsum(counts) - counts, counts)
                line, key, kind = variant_keys(prefix, counts)
                at = pa.array(line)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind == 0), pa.array(kind == 2), part.column(0).take(at)], names=["key", "same_place", "itself", "line"])

    keyed = words.mapInArrow(variants, "key long, same_place boolean, itself boolean, line long")
    # One shuffle by key serves both the search for shared keys and the join that takes their lines.
    dealt = keyed.repartition("key", "same_place")
    meets = dealt.groupBy("key", "same_place").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("itself").alias("has_self")).where("low <> high and (same_place or has_self)").select("key", "same_place")
    firsts = wanted.select("line", F.struct("first.doc_id", "first.row_key", "first.line_no", "line").alias("order"))
    met = common.materialize(dealt.join(meets, ["key", "same_place"], "left_semi").join(firsts, "line"), "met")
    least = met.groupBy("key", "same_place").agg(F.min(F.when(F.col("same_place") | ~F.col("itself"), F.col("order"))).alias("others"), F.min(F.when(F.col("itself"), F.col("order"))).alias("own"))
    partner = F.when(F.col("same_place") | F.col("itself"), F.col("others")).otherwise(F.col("own"))
    alike = met.join(least, ["key", "same_place"]).withColumn("partner", partner).where("partner is not null and partner < order").groupBy("line").agg(F.min("partner").alias("partner"))
    both = alike.select("line", "partner").join(words, "line").select("line", "partner", F.col("words").alias("a")).join(words.select(F.col("line").alias("other"), F.col("words").alias("b")), F.col("partner.line") == F.col("other"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["line"])

    sure = both.select("line", "a", "b").mapInArrow(verify, "line long")
    near = common.materialize(alike.join(sure, "line", "left_semi").select("line", F.struct("partner.doc_id", "partner.row_key", "partner.line_no").alias("near")), "near")
    fate = distinct.select("line", "copies", F.struct("first.doc_id", "first.row_key", "first.line_no").alias("first")).join(near, "line", "left")
    worded = lines.where("n_words > 0").drop("halves", "text_hash")
    full = common.join_counted(worded, common.materialize(fate, "fate"), ["line"], "copies", worded.count())
    here = F.struct("doc_id", "row_key", "line_no")
    keep = F.coalesce(F.least("first", "near"), F.col("first"))
    full = full.withColumn("keep", keep).withColumn("kept", F.col("keep") == here)
    edits = F.when(F.col("kept"), F.lit(None)).when(F.col("near").isNotNull(), 1).otherwise(0)
    out = full.select("doc_id", "line_no", "n_words", "kept", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), edits.cast("int").alias("edits"))
    blank = lines.where("n_words = 0").select("doc_id", "line_no", "n_words", F.lit(True).alias("kept"), F.col("doc_id").alias("keep_doc_id"), F.col("line_no").alias("keep_line_no"), F.lit(None).cast("int").alias("edits"))
    return out.unionByName(blank)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.documents(spark, sf_dir))


ORACLE = {
    "op8_line_dedup": """
with raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
l as (select doc_id, cast(line_no as integer) as line_no, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from raw),
d as (select w, len(w) as n, min((doc_id, line_no)) as first from l where len(w) > 0 group by w),
s as (select w, first, [i::varchar] || w[1:i - 1] || w[i + 1:] as k from d, unnest(generate_series(1, n)) as t(i) where n >= 4),
sub as (select s.w, min(o.first) as near from s join (select k, min(first) as first from s group by k) o on s.k = o.k and o.first < s.first group by s.w),
del as (select distinct w, first, w[1:i - 1] || w[i + 1:] as v from d, unnest(generate_series(1, n)) as t(i) where n >= 4),
ins as (select del.w, min(d.first) as near from del join d on del.v = d.w and d.n >= 4 and d.first < del.first group by del.w),
cut as (select d.w, min(del.first) as near from d join del on del.v = d.w and d.n >= 4 and del.first < d.first group by d.w),
best as (select w, min(near) as near from (select * from sub union all select * from ins union all select * from cut) group by w),
f as (select d.w, d.first, b.near, least(d.first, coalesce(b.near, d.first)) as keep from d left join best b on d.w = b.w)
select l.doc_id, l.line_no, cast(len(l.w) as integer) as n_words, f.keep is null or f.keep = (l.doc_id, l.line_no) as kept,
       coalesce(f.keep[1], l.doc_id) as keep_doc_id, coalesce(f.keep[2], l.line_no) as keep_line_no,
       cast(case when f.keep is null or f.keep = (l.doc_id, l.line_no) then null when f.near is not null and f.near < f.first then 1 else 0 end as integer) as edits
from l left join f on l.w = f.w
"""
}
