"""Best-fit packing, conversation repair and ranked lexical search against plain versions, with hot and awkward rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import best_fit, common, conversation_repair, lexical_search
from framelake.llm.tokens import Encoder, default_path

from .test_operators import SCHEMA, awkward

DATA = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def long_text():
    return "".join(f"word{i % 977} and some more, " for i in range(300_000))


# Packing


def naive_best_fit(lengths, capacity):
    rests = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rests if r >= n]
        rest = min(fit) if fit else capacity
        if fit:
            rests.remove(rest)
        rests.append(rest - n)
    return len(rests)


def least_bins(lengths, capacity):
    """The optimum, by trying all ways for a few pieces."""
    best = [len(lengths)]

    def place(i, rests):
        if len(rests) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rests)
            return
        for r in {r for r in rests if r >= lengths[i]}:
            left = list(rests)
            left.remove(r)
            place(i + 1, [*left, r - lengths[i]])
        place(i + 1, [*rests, capacity - lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=40))
def test_best_fit_decreasing(lengths):
    lengths = np.sort(np.array(lengths))[::-1]
    bins, offsets, fills = best_fit.best_fit_decreasing(lengths, 64)
    assert len(fills) == naive_best_fit(lengths.tolist(), 64) and fills.max() <= 64
    for b in range(len(fills)):
        own = np.argsort(offsets[bins == b])
        assert offsets[bins == b][own].tolist() == np.concatenate([[0], np.cumsum(lengths[bins == b][own])[:-1]]).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bounds_are_below_the_optimum(lengths):
    bound = best_fit.lower_bound(np.bincount(lengths, minlength=21), 20)
    assert math.ceil(sum(lengths) / 20) <= bound <= least_bins(sorted(lengths, reverse=True), 20)


def test_bounds_see_more_than_the_volume():
    assert best_fit.lower_bound(np.bincount([1025] * 50, minlength=2049), 2048) == 50
    assert best_fit.lower_bound(np.bincount([700] * 30, minlength=2049), 2048) == 15


def held(got, want, most):
    """Each document's pieces are its ids, and each sequence is gapless."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], tuple(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) <= most and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= most
    cut = Counter()
    for (doc, ids), n in want.items():
        first = len(ids) - (-(-len(ids) // most) - 1) * most
        starts = [0, *range(first, len(ids), most)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            cut[doc, i, a, ids[a:b]] += n
    assert cut == Counter((d, *p) for d, own in pieces.items() for p in own)
    return len(sequences)


@pytest.mark.parametrize("part_pieces", [10, 100_000])
def test_packing(spark, docs, part_pieces):
    tokenizer = Encoder.of(default_path()).whole
    want = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, *_ in awkward())
    pieces = common.materialize(best_fit.cut_documents(docs, 256), "pieces")
    got = best_fit.pack(pieces, 256, part_pieces).collect()
    # Parts of ten pieces each round their bound up.
    assert held(got, want, 256) <= best_fit.bound_of(pieces, 256) + (1 if part_pieces > 10 else 5)
    assert sorted(map(str, best_fit.pack(pieces, 256, part_pieces).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("sizes,rounds", [([620, 700, 683, 900, 410], 3), ([1025, 1023, 1500, 548, 5, 9, 40], 5)])
def test_packing_of_parts_with_gaps(spark, sizes, rounds):
    """The first sizes leave gaps that no exchange fills, so it ends soon; the second ones fill each other's."""
    rng = random.Random(2)
    rows = [(i, i, 0, 0, rng.choice(sizes), 0) for i in range(6000)]
    pieces = spark.createDataFrame(rows, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    alone, parted = (best_fit.pack(pieces, 2048, n).select("sequence_id", "round").toPandas() for n in (100_000, 200))
    assert len(parted) == 6000 and parted["round"].max() <= rounds
    assert best_fit.bound_of(pieces) <= alone["sequence_id"].nunique() <= parted["sequence_id"].nunique() <= alone["sequence_id"].nunique() * 1.02


def test_packing_meets_the_bound_on_a_given_table(spark):
    pieces = common.materialize(best_fit.cut_documents(common.documents(spark, DATA), with_ids=False), "pieces")
    got = best_fit.pack(pieces).select("sequence_id").distinct().count()
    assert got == best_fit.bound_of(pieces)


def test_packing_very_long_text_and_empty_table(spark, long_text):
    assert best_fit.best_fit(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = best_fit.best_fit(spark.createDataFrame([(1, long_text, None, None, 1, 1, 1, 1, "w"), (2, None, None, None, 1, 1, 1, 1, "w")], SCHEMA), with_ids=False).toPandas()
    own = rows[rows.doc_id == 1].sort_values("piece")
    assert own.length[1:].eq(2048).all() and (own.start.to_numpy()[1:] == own.length.cumsum().to_numpy()[:-1]).all()
    assert rows[rows.doc_id == 2].length.tolist() == [1] and rows.sequence_id.nunique() == len(own)


# Conversations


def cheapest(codes):
    """Least cost, then ASCII-least audit, by a queue of prefixes in that order."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, row, state = heapq.heappop(heap)
        if (row, state) in done:
            continue
        done.add((row, state))
        if row == len(codes) and state in (0, 3):
            return cost, audit
        following = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(heap, (cost + 5, audit + "I", row, following))
        if row < len(codes):
            heapq.heappush(heap, (cost + 2, audit + "D", row + 1, state))
            if not codes[row] & 4:
                more, role = 5 if codes[row] & 8 else 0, codes[row] & 3
                heapq.heappush(heap, (cost + 1 + more, audit + "R", row + 1, following))
                if role and (role == following or (role, state) == (1, 0)):
                    heapq.heappush(heap, (cost + more, audit + "K", row + 1, role))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([a | b for a in range(4) for b in (0, 4, 8)]), max_size=12))
def test_repair(codes):
    assert conversation_repair.repair(bytes(codes)) == cheapest(bytes(codes))


def test_repair_of_many_rows():
    rng = random.Random(4)
    codes = bytes(rng.randrange(4) | rng.choice([0, 0, 4, 8]) for _ in range(3000))
    assert conversation_repair.repair(codes) == cheapest(codes)


def plain_repair(rows):
    groups, out = defaultdict(list), {}
    for conv, *row in rows:
        groups[conv].append(row)
    for conv, own in groups.items():
        kept = []
        for turn, role, text in own:
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        codes, seen, count = [], set(), Counter()
        for _, role, text in kept:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | {"truncated": 8, None: 0}.get(fault, 4))
        cost, audit = cheapest(bytes(codes))
        lines, row = [], 0
        for e in audit:
            following = "assistant" if lines and lines[-1].startswith("u") else "user"
            if e == "I":
                lines.append(f"{following}:")
                continue
            if e != "D":
                lines.append(f"{kept[row][1] if e == 'K' else following}:{kept[row][2]}")
            row += 1
        turns = {r[0] for r in kept if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, at long, code string, cost long"


def same_as_plain(spark, rows, parts):
    df = spark.createDataFrame([(*r, 1, 1, "x", 1) for r in rows], CONVERSATIONS).repartition(parts)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = conversation_repair.repaired(df).collect()
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in got} == plain_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_conversations_with_a_hot_one_over_many_tasks(spark):
    rng = random.Random(6)
    texts = [None, "", " \n", "so.", "why?", "no end", "end! \t", "ß.", "。"]
    rows = [(rng.choice([5] * 6 + [*range(40), None]), rng.choice([None, *range(-3, 900)]), rng.choice(["user", "assistant", "system", "tool", "", None, "superb"]), rng.choice([*texts, f"number {rng.randrange(200)}."])) for _ in range(5000)]
    rows += [(9, None, None, None)] * 300 + [(77, 3, "user", "same.")] * 400 + [(78, 0, "user", "gone"), (None, None, None, None)]
    same_as_plain(spark, rows, 5)


def test_conversations_above_what_a_task_holds(spark, monkeypatch, long_text):
    monkeypatch.setattr(conversation_repair, "HELD_ROWS", 20)
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", 7)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(30)}{rng.choice(['.', ''])}") for c in range(30) for t in range(rng.choice([3, 3, 90]))]
    same_as_plain(spark, [*rows, (50, 0, "user", long_text), (50, 1, "assistant", "yes.")], 3)


def test_no_conversations(spark):
    assert conversation_repair.repaired(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def duck(sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c.execute(sql)


@pytest.mark.parametrize("name,query,oracle,tables", [("op12", conversation_repair.op12_conversation_repair, conversation_repair.ORACLE, ["conversations"]), ("op13", lexical_search.op13_lexical_search, lexical_search.ORACLE, ["documents", "benchmark"])])
def test_queries_equal_their_sql(spark, name, query, oracle, tables):
    df = query(spark, DATA)
    found = duck(next(iter(oracle.values())), *tables)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


# Ranked search


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plain_ranks(rows, items, k=10):
    held = [(d, Counter(terms_of(t))) for d, t, *_ in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t, *_ in items:
        asked[i] |= set(terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms,tree_rows,leaf_rows", [(200_000, 16_384, 64), (40, 13, 2), (10**9, 5, 1)])
def test_ranked_search(spark, docs, block_terms, tree_rows, leaf_rows):
    rng = random.Random(3)
    texts = [t for _, t, *_ in awkward() if t and len(t) < 2000]
    items = [(i, " ".join(rng.choice(texts).split()[:1] * 2 + rng.choice(texts).split()[:9])) for i in range(30)]
    items += [(100, None), (101, ""), (102, "!!!"), (103, "no such term zzzz"), (104, "A b"), (104, "one"), (None, "tab the words"), (None, "tab the words")]
    table = spark.createDataFrame([(*x, 1, "x", 1) for x in items], "item_id long, text string, score long, term string, n long")
    got = sorted((tuple(r) for r in lexical_search.ranked(docs, table, block_terms=block_terms, tree_rows=tree_rows, leaf_rows=leaf_rows).collect()), key=str)
    assert got == plain_ranks(awkward(), items)


def test_ranked_search_with_hot_copies_and_a_very_long_text(spark, long_text):
    rng = random.Random(9)
    rows = [(i, "common words of a copy") for i in range(400)] + [(1000 + i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 30)))) for i in range(400)] + [(5000, long_text), (5001, None), (None, "common words"), (7, "common words of a copy")]
    items = [(1, "a common copy"), (2, "w1 w2 w3 W3"), (3, "word5 and more"), (4, "copy w7")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id int, text string")
    got = sorted((tuple(r) for r in lexical_search.ranked(docs, table, tree_rows=50, leaf_rows=4).collect()), key=str)
    assert got == plain_ranks(rows, items)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical_search.ranked(docs, items).collect() == []
    assert lexical_search.ranked(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), items.where("false")).collect() == []


def test_bounds_hold_for_every_document():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 12, 500)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.concatenate([rng.choice(80, n, replace=False) for n in lengths])
    weights, values = rng.integers(0, 60_000, 80), rng.integers(1, 1_000_000, offsets[-1])
    query_of, query_codes = np.repeat(np.arange(20), 6), np.concatenate([rng.choice(80, 6, replace=False) for _ in range(20)])
    rows = lexical_search.Vectors(offsets, codes, values, weights)
    tree = lexical_search.BallTree(rows, weights, query_of, query_codes, 20, leaf_rows=1)
    for q in range(20):
        own = np.zeros(80, np.int64)
        own[query_codes[query_of == q]] = weights[query_codes[query_of == q]]
        score = np.add.reduceat(own[tree.rows.codes] * tree.rows.values, tree.rows.offsets[:-1])
        assert all(score[a:b].max() <= tree.bounds[node][q] for node, (a, b) in tree.span.items())


# Licence scans of many notices


def test_many_adjacent_notices_take_time_in_proportion(spark):
    import time

    from framelake.llm import license_scan

    line = "Released under the MIT License."
    took = []
    for n in (10_000, 100_000):
        text = "é\n" + "\n".join([line] * n)
        docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
        began = time.time()
        rows = license_scan.scan(docs).select("start_char", "end_char", "matched_text").orderBy("start_char").collect()
        took.append(time.time() - began)
        assert len(rows) == n and all((r["start_char"], r["end_char"]) == (2 + i * (len(line) + 1), 1 + (i + 1) * (len(line) + 1)) for i, r in enumerate(rows))
    assert took[1] < 60


def test_best_regions_do_not_overlap():
    from framelake.llm import license_scan

    rng = random.Random(1)
    found = []
    for _ in range(400):
        a = rng.randrange(1000)
        found.append((rng.randrange(3), rng.randrange(1, 40), a, a + rng.randrange(1, 60), 0, 1))
    kept = []
    for x in sorted(found, key=lambda x: (-x[1], x[2], x[0])):
        if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
            kept.append(x)
    assert license_scan.best_of(found) == sorted(kept, key=lambda x: x[2])
