"""Each operator against a plain brute-force version, on small and awkward documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import common, exact_dedup, language_model, license_scan, line_dedup, mixing, near_dedup, packing, token_files, topk_search, toxicity
from framelake.llm.tokens import Encoder, default_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row_key long, start long, word string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "re", "é", "ß", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, line = prose(120), prose(12)
    texts = [None, "", " ", "\n\n", "one", "One", "two words", "a b c d e", "A b c d e", prose(9000), base, base, base.replace(" ", "  ", 3), base.rsplit(" ", 1)[0], base + " tail", base.upper(), base + "\n" + line, line + "\n" + prose(30), line.replace(" ", " new ", 1) + "\nx", "a   b \n c　 d", "tab\tand\x0bmore", "Licensed under the Apache License, Version 2.0.", "x" * 5000]
    texts += [prose(rng.randint(1, 80)) + "\n" + prose(rng.randint(1, 20)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", None, "c"]), len(t or ""), 7, 7, 7, "w") for i, t in enumerate(texts)]
    rows += [rows[10], rows[0], (None, "no id here at all", "en", "a", 3, 7, 7, 7, "w"), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Encoder.of(default_path()).whole


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \n\t\xa0aB'sé1²<|>　.\x1c")), max_size=30)), max_size=6))
def test_encoder_equals_the_library(tokenizer, texts):
    import pyarrow as pa

    encoder = Encoder.of(default_path())
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, empty, tokenizer):
    got = packing.pack(docs, max_length=64).collect()
    want = Counter()
    for d, t, *_ in awkward():
        want[(d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    pieces = defaultdict(list)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and 2 ** r["bucket"] == r["length"]
        pieces[r["doc_id"]].append((r["start"], tuple(r["ids"]), r["doc_tokens"]))
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r["length"] for r in got) == total
    for (d, ids), n in want.items():
        for start, part, of in pieces[d]:
            if of == len(ids) and n == 1 and sum(1 for (e, _) in want if e == d) == 1:
                assert ids[start : start + len(part)] == part
    assert packing.pack(empty).count() == 0


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 50_000, 2**32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            data, starts = token_files.pack_blocks(ids)
            assert (token_files.unpack_blocks(data, starts) == ids).all()
            if len(starts) > 1:
                assert (token_files.unpack_blocks(data, starts[1:2]) == ids[256:512]).all()


def test_token_files(spark, docs, empty, tokenizer):
    path = common.new_table_path(spark, "t")
    token_files.write_token_files(docs, path)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    rows = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, *_ in awkward()]
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows)
    assert Counter((d, n, c) for d, _, n, c in got) == want
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = [d for d, *_ in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    path = common.new_table_path(spark, "e")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs, counters=4).collect()
    groups = defaultdict(list)
    for d, t, *_ in awkward():
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(d)
    assert len(got) == len(awkward())
    for r in got:
        g = groups[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_misra_gries_finds_the_frequent(spark):
    x = spark.createDataFrame([(bytes([i % 7 if i % 3 else 1]), ) for i in range(999)] + [(i.to_bytes(4, "big"),) for i in range(900)], "digest binary").repartition(5)
    found = {bytes(r["digest"]) for r in exact_dedup.sketch(x, 8).collect()}
    assert bytes([1]) in found and len(found) <= 8


def brute_near(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORDS.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, groups


def test_near_dedup(docs, empty, monkeypatch):
    sets, groups = brute_near(awkward())
    want = Counter()
    for g in groups.values():
        ids = [awkward()[i][0] for i in g]
        low = min((x for x in ids if x is not None), default=None)
        for i in g:
            want[(awkward()[i][0], len(sets[i]), low)] += 1
    for rows in (3_072, 2):  # also with nodes that must branch and be tiled
        monkeypatch.setattr(near_dedup, "NODE_ROWS", rows)
        got = near_dedup.near_dedup(docs).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
    assert near_dedup.near_dedup(empty).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 90), (95, 90), (95, 94), (7, 7)]
    got = {r["key"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 90, 95: 90, 94: 90}


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(t for _, t, *_ in awkward() if t is not None))]
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") for _ in range(9)]
    near = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(9)] + [" ".join(base[:k] + base[k + 1 :]) for k in range(9)] + [" ".join(base)]
    rows += [(100 + i, "\n".join(rng.sample(near, 3))) for i in range(12)] + [(200, None)]
    got = {(r["doc_id"], r["line_no"]): (r["kept"], r["keep_doc_id"], r["keep_line_no"], r["edits"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = [((d, n), WORDS.findall(x)) for d, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    first = {}
    for at, w in lines:
        first.setdefault(tuple(w), at)
    for at, w in lines:
        if not w:
            assert got[at][0]
            continue
        options = [first[tuple(w)]] + [p for v, p in first.items() if len(v) >= 4 and len(w) >= 4 and edit_one(list(v), w)]
        keep = min(options)
        assert got[at][:3] == (keep == at, *keep), at
    assert len(got) == len(lines)
    assert line_dedup.line_dedup(docs).count() == sum(len(t.split("\n")) for _, t, *_ in awkward() if t is not None)
    assert line_dedup.line_dedup(empty).count() == 0


def test_language_model(docs, empty):
    got = language_model.score(docs).collect()
    counts, held = Counter(), lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    for d, t, *_ in awkward():
        if not held(d):
            counts.update(WORDS.findall(lower(t)) + ["\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t, *_ in awkward():
        w = WORDS.findall(lower(t)) + ["\n"]
        want[(d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score(empty).count() == 0


def test_lattice_sums_all_segmentations():
    import pyarrow as pa

    strings, begins = [b"a", b"ab", b"b", b"c", b"bc", b"abc"], np.array([True, True, False, False, False, True])
    p = language_model.Pieces(strings, begins, *language_model.normalised(np.arange(1.0, 7.0), begins, 3.0))
    prob = {(s, bool(b)): math.exp(x) for s, b, x in zip(strings, begins, p.logp, strict=True)}

    def total(word, start=True):
        return 1.0 if not word else sum(prob.get((word[:k], start), 0) * total(word[k:], False) for k in range(1, len(word) + 1))

    words = ["a", "ab", "abc", "abcbc", "a" + "bc" * 40]
    got = language_model.spelling(pa.array(words), p) - p.stop
    for w, g in zip(words[:4], got, strict=False):
        assert math.isclose(math.exp(g), total(w.encode()))
    assert math.isclose(got[4], language_model.long_forward(words[4].encode(), p))
    block = np.zeros((1, 5), np.uint64)
    block[0] = list(b"abcbc")
    used = language_model.expected(language_model.lattice(block, np.array([5]), p), np.array([5]), p.logp, np.ones(1))
    assert math.isclose(sum(used[i] * len(strings[i]) for i in range(6)), 5)


def test_toxicity(spark, empty):
    rng = random.Random(3)
    clean = ["".join(rng.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3)) for _ in range(80)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.2
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vile", "wretch", "scoundrel"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if i % 17 else None))
    rows += [(1000, None), (1001, ""), (None, "vile"), (5, rows[5][1])]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, known).collect()
    truth = {d: any(b in t.split() for b in ("vile", "wretch", "scoundrel")) for d, t in rows if t}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(bool(r["predicted"]) == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert toxicity.score(docs, known.where("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(empty, known).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk_search.top_k(df, 50, block_rows=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in good:
        if q % 50 == 0:
            want = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q))[:5]
            assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got
    assert topk_search.top_k(df.where("vec_id is null"), 50).count() == 0
    assert topk_search.top_k(df.where("vec_id in (0, 3)"), 50).count() == 1


def brute_mix(rows, block, points):
    """The schedule and its takes in plain Python; documents' order within a source is given by their starts."""
    sizes = Counter()
    for r in rows:
        sizes[r["source_index"]] += r["size"]
    names = sorted(sizes)
    goal = {s: next(r["target"] for r in rows if r["source_index"] == s) for s in names}
    total, edges, low = sum(goal.values()), [], 0.0
    for s in names:
        low += goal[s]
        edges.append(low / total)
    slots = defaultdict(list)
    for t in range(max(1, round(total / block))):
        u = points(t)
        slots[next((s for s, e in zip(names, edges, strict=True) if goal[s] and u < e), max(s for s in names if goal[s]))].append(t)
    out = {}
    for r in rows:
        s, taken, first = r["source_index"], 0, None
        given = min(len(slots[s]) * block, math.floor(2 * sizes[s]))
        for word in range(r["size"]):
            for at in range(r["start"] + word, given, sizes[s]):
                taken, first = taken + 1, min(t for t in (first, slots[s][at // block]) if t is not None)
        out[r["row_key"]] = (taken, first)
    return out


GOLDEN = (365_435_296_162, 591_286_729_879)
POINTS = {mixing.golden: lambda t: t * GOLDEN[0] % GOLDEN[1] / GOLDEN[1], mixing.van_der_corput: lambda t: int(format(t, "040b")[::-1], 2) / 2**40}


def test_points_are_spread(spark):
    assert abs(GOLDEN[0] / GOLDEN[1] - (math.sqrt(5) - 1) / 2) < 1e-15
    for points, plain in POINTS.items():
        got = [r[0] for r in spark.range(4000).select(points(F.col("id"))).collect()] + [r[0] for r in spark.range(10**10, 10**10 + 50).select(points(F.col("id"))).collect()]
        assert got == pytest.approx([plain(t) for t in [*range(4000), *range(10**10, 10**10 + 50)]], abs=1e-12)
        ordered = sorted(got[:4000])  # every stretch of the interval has its share, but for a few points
        assert all(abs(np.searchsorted(ordered, e) - 4000 * e) < 8 for e in np.linspace(0, 1, 97))


@pytest.mark.parametrize("points", list(POINTS))
def test_mixing_follows_its_schedule(docs, points):
    placed, met = mixing.takes(docs, block_words=16, points=points)
    want = brute_mix(placed.collect(), 16, POINTS[points])
    got = {r["row_key"]: (r["taken"], r["first"]) for r in met.groupBy("row_key").agg(F.sum("words").alias("taken"), F.min("slot").alias("first")).collect()}
    assert {k: got.get(k, (0, None)) for k in want} == want


def test_mixing(spark, docs, empty):
    how = {"block_words": 16}
    got = mixing.mix(docs, **how).collect()
    again = mixing.mix(docs.repartition(2), **how).collect()
    columns = ("doc_id", "size", "source_size", "target", "taken", "first_slot")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(r[c] for c in columns) for r in again)
    other = mixing.mix(docs, points=mixing.van_der_corput, **how).collect()
    assert Counter((r["doc_id"], r["first_slot"]) for r in got) != Counter((r["doc_id"], r["first_slot"]) for r in other)
    sizes = Counter()
    for _, t, _, s, *_ in awkward():
        sizes[s] += len(WORDS.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = brute_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    assert sorted(Counter((r["source_size"], round(r["target"], 6)) for r in got)) == sorted({(sizes[s], round(g, 6)) for s, g in zip(names, goal, strict=True)})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0)
        taken[r["source_size"]] += r["taken"]
    for s, g in zip(names, goal, strict=True):
        assert abs(taken[sizes[s]] - g) <= 48
    assert mixing.mix(empty).count() == 0
    # The documents themselves: the words taken, in the order of the slots.
    rows = [r for r in mixing.mixed_documents(docs, **how).collect()]
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert +words == +want
    placed, met = mixing.takes(docs, **how)
    slots = placed.join(met, "row_key").select("doc_id", "slot").collect()
    assert [d for _, d in sorted((r["slot"], r["doc_id"] or 0) for r in slots)] != sorted(r["doc_id"] or 0 for r in rows)
    of = defaultdict(list)
    for r in slots:
        of[r["doc_id"]].append(r["slot"])
    at = [min(of[r["doc_id"]]) for r in rows if len(of[r["doc_id"]]) == 1]
    assert at == sorted(at)


def test_many_sources(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 900:04d}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=1).collect()
    total = defaultdict(int)
    for r in got:
        total[rows[r["doc_id"]][2]] += r["taken"]
    goal = {rows[r["doc_id"]][2]: r["target"] for r in got}
    assert all(abs(total[s] - g) <= 4 for s, g in goal.items()) and abs(sum(total.values()) - 1.5 * sum(r["size"] for r in got)) <= 300


def brute_targets(sizes, weights, pool, repeat=2.0):
    out, free, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i]], pool
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > repeat * sizes[i]]
        for i in over or free:
            out[i] = repeat * sizes[i] if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


@pytest.mark.parametrize("sizes, weights, pool", [([10, 100, 100], [5, 2, 1], 120), ([0, 5], [5, 2], 50), ([7, 3, 900, 40, 2], [5, 2, 1, 5, 2], 1428)])
def test_water_level(spark, sizes, weights, pool):
    table = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source_index int, source_size long, weight double")
    level = mixing.water_level(table, pool, 2.0)
    assert [min(w * level, 2.0 * s) if s else 0.0 for s, w in zip(sizes, weights, strict=True)] == pytest.approx(brute_targets(sizes, weights, pool))


def full_align(text, template):
    """Smith-Waterman over the whole table: the first best end, and its trace back with the module's order of steps."""
    table = np.zeros((len(template) + 1, len(text) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if text[j - 1] == template[i - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    if not table.max():
        return 0, 0, 0, 0, 0, 0
    i, j = (int(x) for x in np.unravel_index(np.argmax(table), table.shape))
    end, matches = (j, i), 0
    while True:
        gain = 2 if text[j - 1] == template[i - 1] else -1
        if table[i - 1, j - 1] + gain == table[i, j]:
            matches += gain == 2
            if not table[i - 1, j - 1]:
                return int(table.max()), matches, j - 1, end[0], i - 1, end[1]
            i, j = i - 1, j - 1
        elif table[i - 1, j] - 1 == table[i, j]:
            i -= 1
        else:
            j -= 1


def brute_scan(words, index):
    """All templates by whole tables: the best alignment that counts, then what is left and right of it."""
    found = []
    for t, template in enumerate(index.words):
        todo = [(0, len(words))]
        while todo:
            start, end = todo.pop()
            if end - start >= index.least(t):
                _, m, a, b, c, d = full_align(words[start:end], template)
                if index.enough(t, m, c, d):
                    found.append((t, m, start + a, start + b, c, d))
                    todo += [(start, start + a), (start + b, end)]
    return license_scan.best_of(found)


def test_license_scan_equals_whole_tables():
    rng = random.Random(12)
    chosen = {
        "a": license_scan.Template(" ".join(f"a{rng.randrange(30)}" for _ in range(40))),
        "b": license_scan.Template(" ".join(f"b{i}" for i in range(30)), grant=18),
        "line": license_scan.line_of("x1 x2 x3 x4 x5 x6"),
    }
    index = license_scan.Index(chosen)
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = chosen[rng.choice(["a", "b", "line"])].text.split()
            if len(words) > 10:
                for _ in range(rng.randint(0, 3)):
                    at = rng.randrange(len(words))
                    words[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(9)}"] * rng.randint(0, 1)
                words = words[: rng.choice([len(words), 25])]
            parts += words + [f"f{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 12]))]
        hashes = license_scan.template_words(" ".join(parts))
        places = []
        for gram in sorted(index.postings):
            at, grams = index.hits(hashes, gram)
            places += [(t, int(j), i) for j, g in zip(at, grams, strict=True) for t, i in index.postings[gram][int(g)]]
        assert license_scan.scan_text(hashes, places, index) == brute_scan(hashes, index), parts


def test_license_scan(spark, empty):
    rng = random.Random(6)
    filler = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    mit = license_scan.TEMPLATES["MIT"].text.split()
    edited = mit[:20] + ["extra"] + mit[22:60]
    texts = [" ".join(filler), " ".join(filler[:50] + mit + filler[50:]), " ".join(filler[:7] + edited), "é " + license_scan.TEMPLATES["MIT-line"].text, None, "", license_scan.TEMPLATES["Apache-2.0"].text.upper()]
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    by = {(r[0], r[1]): r for r in got}
    full = by[(1, "MIT")]
    assert full[2] == 1.0 and (full[4], full[5]) == (50, 50 + len(mit)) and texts[1][full[6] : full[7]] == full[8]
    part = by[(2, "MIT")]
    assert part[4] == 7 and abs(part[3] - 58) <= 1
    assert by[(3, "MIT-line")][8] == license_scan.TEMPLATES["MIT-line"].text
    assert (6, "Apache-2.0") in by and {r[0] for r in got} == {1, 2, 3, 6}
    assert license_scan.scan(empty).count() == 0


def test_license_scan_on_repeated_rows_and_other_columns(spark):
    line = license_scan.TEMPLATES["MIT-line"].text
    rows = [(1, line, "x", 5), (1, line, "y", 6), (None, line, None, None), (2, None, "z", 7), (None, "", "z", 7)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, license_id string, start_word long")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["license_id"], r["start_word"]) for r in got) == [(False, 1, "MIT-line", 0), (False, 1, "MIT-line", 0), (True, 0, "MIT-line", 0)]


def test_alignment_equals_full_dynamic_programming():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 9))
        assert license_scan.align(a, b, np.array([[0, len(a)]]), np.zeros((1, len(b)), int))[0] == full_align(a, b)
    # A band along a diagonal that moves is a table of its own, whose cells outside count nothing.
    a = np.concatenate([np.arange(6), np.full(30, 99), np.arange(6, 12)])
    along = np.array([[0] * 6 + [30] * 6])
    assert license_scan.align(a, np.arange(12), np.array([[0, len(a)]]), along)[0][:2] == (12, 6)


def test_risk_is_non_negative_and_its_gradient_true():
    rng = np.random.default_rng(3)
    positive = rng.random(60) < 0.3
    seen = set()
    for scale in (0.1, 1.0, 6.0):
        z = rng.normal(size=60) * scale + positive * scale * 2 - (~positive) * scale * 3
        for prior in (0.1, 0.6):
            value, grad, own = toxicity.risk(z, positive, prior)
            seen.add(own)
            plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
            rest = minus[~positive].mean() - prior * minus[positive].mean()
            assert math.isclose(value, prior * plus[positive].mean() + max(0.0, rest)) and own == (rest >= 0)
            target = (lambda y: prior * np.logaddexp(0, -y[positive]).mean() + np.logaddexp(0, y)[~positive].mean() - prior * np.logaddexp(0, y)[positive].mean()) if own else (lambda y: prior * np.logaddexp(0, y)[positive].mean() - np.logaddexp(0, y)[~positive].mean())
            for i in range(60):
                step = np.zeros(60)
                step[i] = 1e-5
                assert math.isclose(grad[i], (target(z + step) - target(z - step)) / 2e-5, abs_tol=1e-6)
    assert seen == {True, False}


def test_toxicity_learns_from_text_without_labels(spark):
    rows = [(i, "vile " + " ".join(f"w{(i * 7 + k) % 40}" for k in range(30)) if i < 60 else " ".join(f"w{(i * 7 + k) % 40}" for k in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows + [(7, rows[7][1])] * 50, "doc_id long, text string")
    only_toxic_known = spark.createDataFrame([(i, 1) for i in range(60)] + [(399, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, only_toxic_known).collect()}
    assert min(got[i] for i in range(60)) > max(got[i] for i in range(60, 400))


def test_top_k_prunes_ranges_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "RANGE_ROWS", 64)
    monkeypatch.setattr(topk_search, "RANGES_AT_ONCE", 3)
    monkeypatch.setattr(topk_search, "SET_QUERIES", 16)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=8) * 0.2], "x", 1, 1) for i in range(900)]
    got = defaultdict(list)
    for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, part int, q int"), 10, block_rows=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    scores = whole @ whole.T
    for q in range(0, 900, 10):
        order = np.lexsort((np.arange(900), -scores[q]))
        want = [(int(i), int(scores[q, i])) for i in order if i != q][:5]
        assert got.pop(q) == want
    assert not got


def test_top_k_beyond_64_bits_is_an_error(spark):
    for big in (1e17, 1e300):
        rows = spark.createDataFrame([(50, [big, 1.0]), (1, [big, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits|too large|int"):
            topk_search.top_k(rows, 50).collect()
    fits = spark.createDataFrame([(50, [2.0**20, 1.0]), (1, [2.0**20, 2.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk_search.top_k(fits, 50).collect()] == [2**56 + 2 * 2**16]


def test_line_share_takes_short_lines_in(spark):
    rows = [(1, "a b\nc d e"), (2, "a x\nq"), (3, "c d\nz\nlong line of words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [((d, n), tuple(x.split())) for d, t in rows for n, x in enumerate(t.split("\n"))]
    for share in (1.0, 0.5, 0.25):
        got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.line_dedup(docs, share).collect()}
        for at, w in lines:
            alike = [p for p, v in lines if v == w or (min(len(v), len(w)) >= 1 / share and edit_one(list(v), list(w)))]
            assert got[at] == min(alike), (share, at)


def test_buckets_are_folders(spark, docs, tmp_path):
    pieces = packing.pack(docs, max_length=64)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    assert read.count() == pieces.count()
    assert all(r["length"] == 2 ** r["bucket"] for r in read.select("length", "bucket").distinct().collect())


def test_near_dedup_finds_every_link_of_a_whole_table(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets, postings = [], defaultdict(list)
    for n, (_, t) in enumerate(rows):
        w = WORDS.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for g in sets[-1]:
            postings[g].append(n)
    both = Counter((a, b) for p in postings.values() for i, a in enumerate(p) for b in p[i + 1 :])
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {d: (len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_final_language_model_score(spark):
    """The mixture by hand: whole words, spellings, classes and the end."""
    import pyarrow as pa

    rows = [(i, t, l) for i, (t, l) in enumerate([("red green red", "a"), ("blue sky", "b"), ("red sky zzq", "a"), ("green blue blue", "b"), ("red unseen", "b"), ("Sky green red", None), (None, "a"), ("blue", "a"), ("red red", "b"), ("newword sky", "a")])]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    assert held and len(held) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tokens = {i: WORDS.findall(lower(t)) + ["\n"] for i, t, _ in rows}
    langs = Counter(l for i, _, l in rows if i not in held and l)
    classes = [l for l, _ in sorted(langs.items(), key=lambda x: (-x[1], x[0]))]
    everywhere, own = Counter(), {c: Counter() for c in classes}
    for i, _, l in rows:
        if i not in held:
            everywhere.update(tokens[i])
            if l:
                own[l].update(tokens[i])
    total, once = sum(everywhere.values()), sum(n == 1 for n in everywhere.values())
    words = language_model.word_counts(docs, classes)
    pieces = language_model.fit_pieces(words, language_model.load_pieces(language_model.default_vocabulary()))
    spelled, ends = (once + 1) / (total + 2), 1 / (total + 2)
    texts = [own[c]["\n"] for c in classes]

    def log_p(word, c):
        share = everywhere[word] / total
        if c is not None:
            share = (1 - language_model.SHARED) * own[c][word] / sum(own[c].values()) + language_model.SHARED * share
        spell = 0.0 if word == "\n" else math.exp(language_model.spelling(pa.array([word]), pieces)[0])
        return math.log10((1 - ends) * ((1 - spelled) * share + spelled * spell) + (ends if word == "\n" else 0))

    for head in (100, 1):
        for r in language_model.score(docs, head=head).collect():
            options = [(1 / (1 + sum(texts)), None)] + [(n / (1 + sum(texts)), c) for n, c in zip(texts, classes, strict=True)]
            want = math.log10(sum(p * 10 ** sum(log_p(w, c) for w in tokens[r["doc_id"]]) for p, c in options))
            assert math.isclose(r["score"], want, rel_tol=1e-9), r
