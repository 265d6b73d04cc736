"""Language-model scores from a lattice over words and subwords.

A token's probability is a mixture: the training share of the whole word, or a
spelling from pieces.  Spellings are all segmentations of the word into pieces
of an existing subword vocabulary (with its byte pieces, so that any word has
one); each counts with the product of its pieces' unigram probabilities and a
stop.  The whole-word edge and the pieces are one lattice, and a forward
recursion in log space sums all its paths.  The mixture's weight for spellings
is the share of training tokens that occur once.  A text's score is the log10
probability of its tokens and its end.

Words are drawn from one of a few classes, which a whole text shares: one for
each language that CLASS_SHARE of the training rows have, and one for all.  A
text's language is not used to score it: the probability is the classes'
mixture.  The end of a text takes a share of every token's probability first,
so that the probabilities of all texts sum to one at most.

Piece probabilities start from the vocabulary's own order and are fitted to all
distinct training words by expectation steps over the same lattice, as a Spark
aggregation of at most one row for each piece.  Word counts cover all training
rows; only the HEAD most frequent words of all rows, held out or not, are
broadcast, so that most tokens are scored where they stand, and the other words
join their counts by shuffle.

Null texts count as empty: such a text is its end alone.  Texts and words of any
length are scored whole.  Null ids belong to the fold of the empty text.
Repeated rows and ids are scored row by row.  With no training rows every count
is 0.  An empty table gives no rows.  Columns but doc_id, text and, for the
training rows' classes, lang are not read; lang may be missing.
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
from .common import coded_words, segment_ids, slices, text_bytes

FOLDS, HELD_OUT = 5, 1
#: Words that are broadcast with their scores; a word and its scores are some 40 bytes.
HEAD = 100_000
#: Expectation steps, words of a batch, bytes of a batch's padded words.
STEPS, BATCH, BLOCK_BYTES = 3, 8_192, 524_288
#: Share of the training rows that gives a language a class, so that there are 50 at most; share of a class's words that is drawn from all classes.
CLASS_SHARE, SHARED = 0.02, 0.03
#: The end of a text, as a word: white space is in no word.
END = "\n"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces by their bytes: those that continue a word, those that begin one, and a stop."""

    def __init__(self, strings: list[bytes], begins: np.ndarray, logp: np.ndarray, stop: float) -> None:
        self.strings, self.begins, self.logp, self.stop = strings, begins, logp, stop
        self.longest = max(map(len, strings))
        keys = np.array([self.key(s, b) for s, b in zip(strings, begins.tolist(), strict=True)], np.uint64)
        bits = 20
        self.mask = np.uint64((1 << bits) - 1)
        self.tables = []
        left = np.arange(len(keys))
        shift = 0
        while len(left):  # each round holds the first piece of every slot
            slot = (keys[left] >> np.uint64(shift)) & self.mask
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append((np.uint64(shift), table))
            left = np.delete(left, first)
            shift = (shift + 13) % 40
        self.keys = keys

    BASE = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def key(cls, piece: bytes, begins: bool) -> int:
        h = 0
        for byte in piece:
            h = (h * int(cls.BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        return int(common.mix64(np.array([h ^ (0xABCDEF if begins else 0)], np.uint64))[0])

    def find(self, hashes: np.ndarray, begins: np.ndarray | bool) -> np.ndarray:
        """The piece of each rolling hash, or -1."""
        k = common.mix64(hashes ^ np.where(begins, np.uint64(0xABCDEF), np.uint64(0)))
        out = np.full(k.shape, -1, np.int32)
        for shift, table in self.tables:
            at = table[((k >> shift) & self.mask).astype(np.int64)]
            hit = (at >= 0) & (self.keys[at] == k)
            out[hit] = at[hit]
        return out


def load_pieces(path: str) -> Pieces:
    """The vocabulary's pieces with probabilities falling by rank; every byte can begin and continue a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings, begins, seen = [], [], set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            options = [(bytes([int(model.id_to_piece(i)[3:-1], 16)]), b) for b in (False, True)]
        else:
            s = model.id_to_piece(i)
            options = [(s.lstrip("▁").encode(), s.startswith("▁"))] + ([(s.encode(), True)] if not s.startswith("▁") else [])
        for s, b in options:
            if s and (s, b) not in seen:
                seen.add((s, b))
                strings.append(s)
                begins.append(b)
    rank = np.arange(1, len(strings) + 1, dtype=np.float64)
    begins_ = np.array(begins)
    counts = 1 / (rank + 2)
    return Pieces(strings, begins_, *normalised(counts, begins_, counts[~begins_].sum() / 2))


def normalised(counts: np.ndarray, begins: np.ndarray, stops: float) -> tuple[np.ndarray, float]:
    """Log probabilities: beginnings sum to 1; continuations and the stop sum to 1."""
    counts = counts + 1e-3 * counts.sum() / len(counts)
    logp = np.empty(len(counts))
    logp[begins] = np.log(counts[begins] / counts[begins].sum())
    rest = counts[~begins].sum() + stops
    logp[~begins] = np.log(counts[~begins] / rest)
    return logp, float(np.log(stops / rest))


def lattice(words: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> np.ndarray:
    """edges[i, e, l]: the piece of l + 1 bytes that ends at byte e of word i, or -1.  words: rows of bytes, padded."""
    n, width = words.shape
    rolled = np.zeros((n, width + 1), np.uint64)
    for j in range(width):
        rolled[:, j + 1] = rolled[:, j] * Pieces.BASE + words[:, j] + np.uint64(1)
    most = min(pieces.longest, width)
    edges = np.full((n, width + 1, most), -1, np.int32)
    power = np.uint64(1)
    for l in range(1, most + 1):
        power = np.uint64(int(power) * int(Pieces.BASE) & 0xFFFFFFFFFFFFFFFF)
        hashes = rolled[:, l:] - rolled[:, : width + 1 - l] * power
        starts_word = np.zeros(hashes.shape, bool)
        starts_word[:, 0] = True
        inside = np.arange(l, width + 1)[None, :] <= lengths[:, None]
        found = np.full(hashes.shape, -1, np.int32)
        found[inside] = pieces.find(hashes[inside], starts_word[inside])
        edges[:, l:, l - 1] = found
    return edges


def forward(edges: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log-space forward recursion: log of the summed paths to each byte."""
    n, ends, most = edges.shape
    padded = np.append(logp, -np.inf)
    alpha = np.full((n, ends), -np.inf)
    alpha[:, 0] = 0
    for e in range(1, ends):
        k = min(e, most)
        terms = alpha[:, e - k : e][:, ::-1] + padded[edges[:, e, :k]]
        top = terms.max(axis=1)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            alpha[:, e] = safe + np.log(np.exp(terms - safe[:, None]).sum(axis=1))
    return alpha


def expected(edges: np.ndarray, lengths: np.ndarray, logp: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, by forward and backward sums."""
    n, ends, most = edges.shape
    padded = np.append(logp, -np.inf)
    alpha = forward(edges, logp)
    total = alpha[np.arange(n), lengths]
    beta = np.full((n, ends), -np.inf)
    beta[np.arange(n), lengths] = 0
    out = np.zeros(len(logp))
    for e in range(ends - 1, 0, -1):
        k = min(e, most)
        score = padded[edges[:, e, :k]]
        through = beta[:, e, None] + score
        beta[:, e - k : e] = np.logaddexp(beta[:, e - k : e], through[:, ::-1])
        share = np.exp(np.minimum(alpha[:, e - k : e][:, ::-1] + through - total[:, None], 0)) * weights[:, None]
        used = edges[:, e, :k]
        ok = (used >= 0) & np.isfinite(score)
        out += np.bincount(used[ok], share[ok], len(logp))
    return out


def long_forward(word: bytes, pieces: Pieces) -> float:
    """The same sum for one long word, with a window of the longest piece only."""
    recent = [0.0]
    table = _by_bytes(pieces)
    for e in range(1, len(word) + 1):
        terms = []
        for l in range(1, min(pieces.longest, e) + 1):
            i = table.get((word[e - l : e], e == l))
            if i is not None:
                terms.append(recent[-l] + pieces.logp[i])
        top = max(terms)
        recent = [*recent[max(0, len(recent) - pieces.longest + 1) :], top + float(np.log(sum(np.exp(t - top) for t in terms)))]
    return recent[-1]


_TABLES: dict[int, dict] = {}


def _by_bytes(pieces: Pieces) -> dict:
    if id(pieces) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(pieces)] = {(s, bool(b)): i for i, (s, b) in enumerate(zip(pieces.strings, pieces.begins, strict=True))}
    return _TABLES[id(pieces)]


def padded_batches(words: pa.Array, most: int | None = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, lengths) of the words up to `most` bytes, or of all words, by like lengths."""
    data, offsets = text_bytes(words)
    lengths = np.diff(offsets)
    low = 0
    widths = [4, 8, 12, 16, 24, 40, most or 64]
    while most is None and widths[-1] < lengths.max(initial=0):
        widths.append(min(2 * widths[-1], int(lengths.max())))
    for width in widths:
        rows = np.flatnonzero((lengths > low) & (lengths <= width))
        step = max(1, min(BATCH, BLOCK_BYTES // width))
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            n = lengths[at]
            block = np.zeros((len(at), width), np.uint64)
            block[np.repeat(np.arange(len(at)), n), common.runs(n)] = data[np.repeat(offsets[at], n) + common.runs(n)]
            yield at, block, n
        low = width


def spelling(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """Natural log of each word's summed spellings, with the stop."""
    out = np.zeros(len(words))
    for at, block, n in padded_batches(words):
        out[at] = forward(lattice(block, n, pieces), pieces.logp)[np.arange(len(at)), n]
    for i in np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > 64):
        out[i] = long_forward(words[int(i)].as_py().encode(), pieces)
    return out + pieces.stop


def classes_of(docs: DataFrame) -> list[str]:
    """The languages of at least CLASS_SHARE of the training rows; none if there is no such column."""
    if "lang" not in docs.columns:
        return []
    train = docs.where(common.fold_of("doc_id", FOLDS) != HELD_OUT)
    counts = common.materialize(train.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")), "languages")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("lang").isNotNull() & (F.col("n") >= CLASS_SHARE * total)).orderBy(F.desc("n"), "lang").collect()
    return [r["lang"] for r in rows]


def word_counts(docs: DataFrame, classes: list[str]) -> DataFrame:
    """(word, seen, c, c_0...): every word with its count in all texts and in training texts, in all and by class; END counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=24_000_000):
            offsets, codes, words = coded_words(b.column(1))
            owner = b.column(0).to_numpy(zero_copy_only=False)
            words = pa.concat_arrays([words.cast(pa.string()), pa.array([END])])
            codes = np.concatenate([codes, np.full(b.num_rows, len(words) - 1)])
            owner = np.concatenate([np.repeat(owner, np.diff(offsets)), owner])
            # -2: held out, counted 0 times; -1: no class of its own.
            pair, times = np.unique(codes * (len(classes) + 2) + owner + 2, return_counts=True)
            k = pair % (len(classes) + 2) - 2
            yield pa.RecordBatch.from_arrays([words.take(pa.array(pair // (len(classes) + 2))), pa.array(k.astype(np.int32)), pa.array(times), pa.array(np.where(k == -2, 0, times))], names=["word", "k", "seen", "c"])

    k = F.lit(-1)
    for i, name in enumerate(classes):
        k = F.when(F.col("lang").cast("string") == name, i).otherwise(k)
    k = F.when(common.fold_of("doc_id", FOLDS) == HELD_OUT, -2).otherwise(k)
    sums = [F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)).alias(f"c_{i}") for i in range(len(classes))]
    return docs.select(k.cast("int").alias("k"), "text").mapInArrow(run, "word string, k int, seen long, c long").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("c").alias("c"), *sums)


def fit_pieces(words: DataFrame, pieces: Pieces, steps: int = STEPS) -> Pieces:
    """Expectation steps over all distinct training words, each counting once."""
    train = words.where((F.col("c") > 0) & (F.col("word") != END)).select("word")
    for _ in range(steps):
        shared = words.sparkSession.sparkContext.broadcast(pieces)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, done = shared.value, 0
            total = np.zeros(len(now.logp))
            for b in batches:
                for at, block, n in padded_batches(b.column(0), None):
                    total += expected(lattice(block, n, now), n, now.logp, np.ones(len(at)))
                    done += len(at)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], done))], names=["piece", "uses"])

        found = train.mapInArrow(step, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # one row for each piece at most
        counts, stops = np.zeros(len(pieces.logp)), 1.0
        for r in found:
            if r["piece"] < 0:
                stops = max(float(r["uses"]), 1.0)
            else:
                counts[r["piece"]] = r["uses"]
        if not counts.any():
            return pieces
        pieces = Pieces(pieces.strings, pieces.begins, *normalised(counts, pieces.begins, stops))
    return pieces


def score(docs: DataFrame, vocabulary: str | None = None, head: int = HEAD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    classes = classes_of(docs)
    words = common.materialize(word_counts(docs, classes), "words")
    of_class = [f"c_{i}" for i in range(len(classes))]
    found = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in of_class], *[F.coalesce(F.max(F.when(F.col("word") == END, F.col(c))), F.lit(0)) for c in of_class]).first()
    total, distinct, once = found[:3]
    sizes, texts = np.array(found[3 : 3 + len(classes)]), np.array(found[3 + len(classes) :])
    used = np.flatnonzero(sizes)
    names_of = ["model_all", *(f"model_{i}" for i in used)]
    prior = np.log10(np.append(1.0, texts[used]) / (1.0 + texts[used].sum()))
    pieces = spark.sparkContext.broadcast(fit_pieces(words, load_pieces(vocabulary or default_vocabulary())))
    spelled = (once + 1) / (total + 2)
    ends = 1 / (total + 2)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(2).to_numpy()
            base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            is_end = pc.equal(b.column(0), END).to_numpy(zero_copy_only=False)
            spell = np.where(is_end, -np.inf, spelling(b.column(0), pieces.value))
            share = c / max(total, 1)
            models = []
            for i in [-1, *used.tolist()]:
                p = share if i < 0 else (1 - SHARED) * b.column(3 + i).to_numpy() / sizes[i] + SHARED * share
                with np.errstate(divide="ignore"):
                    m = np.logaddexp(np.log1p(-spelled) + np.log(p), np.log(spelled) + spell)
                m += np.log1p(-ends)
                m[is_end] = np.logaddexp(m[is_end], np.log(ends))
                models.append(pa.array(m / np.log(10)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array((c > 0).astype(np.int64)), pa.array(base), *models], names=["word", "seen", "c", "known", "base", *names_of])

    doubles = ", ".join(f"{n} double" for n in names_of)
    judged = common.materialize(words.select("word", "seen", "c", *of_class).mapInArrow(judge, f"word string, seen long, c long, known long, base double, {doubles}"), "judged")
    values_of = ["known", "base", *names_of]
    top = judged.where((F.col("seen") > 1) & (F.col("word") != END)).orderBy(F.desc("seen"), "word").limit(head).unionByName(judged.where(F.col("word") == END)).toArrow()
    names = spark.sparkContext.broadcast(top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string()))
    values = spark.sparkContext.broadcast(np.stack([top.column(n).to_numpy().astype(np.float64) for n in values_of]))
    rows = docs.select("doc_id", (common.fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("row_key", T.LongType()), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in values_of), T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        head_words = names.value
        at_end = pc.index_in(pa.array([END]), head_words)[0].as_py()
        for b in slices(batches):
            offsets, codes, distinct_words = coded_words(b.column(2))
            distinct_words, width = distinct_words.cast(pa.string()), max(len(distinct_words), 1)
            at = pc.fill_null(pc.index_in(distinct_words, head_words), -1).to_numpy(zero_copy_only=False)
            row, n = segment_ids(offsets), b.num_rows
            pair, times = np.unique(row * width + codes, return_counts=True)
            row, word = pair // width, pair % width
            each = at[word] if len(word) else np.zeros(0, np.int64)
            hit, miss = each >= 0, each < 0
            sums = [np.bincount(row[hit], v[each[hit]] * times[hit], n) + (v[at_end] if at_end is not None else 0) for v in values.value]
            cuts = pa.array(np.searchsorted(row[miss], np.arange(n + 1)).astype(np.int32))
            rare = distinct_words.take(pa.array(word[miss]))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(key + np.arange(n)), pa.array(np.diff(offsets) + 1), *map(pa.array, sums), pa.ListArray.from_arrays(cuts, rare), pa.ListArray.from_arrays(cuts, pa.array(times[miss].astype(np.int32)))], names=schema.names)
            key += n

    scored = common.materialize(rows.mapInArrow(local, schema), "local")
    rest = scored.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(judged.select("word", *values_of), "word").groupBy("row_key").agg(*[F.sum(F.col(n) * F.col("times")).alias(f"rare_{n}") for n in values_of])
    out = scored.drop("rare", "times").join(rest, "row_key", "left")
    both = lambda n: F.col(n) + F.coalesce(F.col(f"rare_{n}"), F.lit(0))
    terms = F.array(*[both(n) + F.lit(float(p)) for n, p in zip(names_of, prior, strict=True)])
    out = out.withColumn("terms", terms).withColumn("top", F.array_max("terms"))
    mixed = F.col("top") + F.log10(F.aggregate("terms", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("top"))))
    return out.select("doc_id", "held_out", "n_tokens", F.round(both("known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), both("base").alias("base_score"), mixed.alias("score"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
