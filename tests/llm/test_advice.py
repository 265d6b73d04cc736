"""What the review of the first round found missing, on literal rows."""

import cProfile
import math
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from framelake.llm import language_model, license_scan, near_dedup, packing, token_files
from framelake.llm.common import text_bytes
from framelake.llm.tokens import Encoder, default_path

from .test_operators import WORDS, lower


def test_near_stage_links_from_four_fifths_on(spark):
    rng = random.Random(9)
    texts = []
    for k in range(40):  # from 3 to 6 edits of 200 words: similarities on both sides of 0.80 and 0.85
        words = [f"d{k}w{i}" for i in range(200)]
        texts.append(" ".join(words))
        for i in range(3 + k % 4):
            words[10 + 30 * i + rng.randrange(20)] = f"e{i}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (WORDS.findall(lower(t)) for t in texts)]
    shares = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.80 <= s < 0.85 for s in shares) >= 8 and sum(s < 0.80 for s in shares) >= 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in near_dedup.stage(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(40)} | {2 * k + 1 for k, s in enumerate(shares) if s < 0.80}
    at_85 = {r["doc_id"] for r in near_dedup.near_dedup(docs).where("kept").collect()}
    assert at_85 == {2 * k for k in range(40)} | {2 * k + 1 for k, s in enumerate(shares) if s < 0.85}


SPECIAL = ["<|endoftext|>", " a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n\n", None, "", "plain text", "x  <|endoftext|>  y <|endoftext|", "<|ENDOFTEXT|>", "é　<|endoftext|>　 \xa0z"]


def test_encoder_knows_added_tokens():
    whole, encoder = Tokenizer.from_file(default_path()), Encoder.of(default_path())
    for texts in (SPECIAL, SPECIAL[::-1], SPECIAL[3:6], SPECIAL[:1]):
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        assert len(offsets) == len(texts) + 1 and offsets[-1] == len(ids)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids
    ids, _ = encoder.encode(pa.array(["<|endoftext|>"]))
    assert ids.tolist() == [50256]
    assert encoder.whole.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]


def test_packed_and_filed_ids_know_added_tokens(spark, tmp_path):
    whole = Tokenizer.from_file(default_path())
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    want = {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(SPECIAL)}
    got = {}
    for r in packing.pack(docs, max_length=64).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: [*ids, 1] for i, ids in want.items()}
    token_files.write_token_files(docs, str(tmp_path / "t"))
    filed = {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    assert filed == {i: len(ids) + 1 for i, ids in want.items()}


def licenses(spark, texts):
    found = {}
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["license_id"], r["coverage"]))
    return [sorted(found.get(i, [])) for i in range(len(texts))]


def test_license_notices_are_whole(spark):
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0"]
    whole = [license_scan.TEMPLATES[n].text for n in names]
    ends = ["DEALINGS IN THE SOFTWARE.", "PERFORMANCE OF THIS SOFTWARE.", "POSSIBILITY OF SUCH DAMAGE.", "POSSIBILITY OF SUCH DAMAGE.", "<https://unlicense.org>", "under the License."]
    assert all(t.endswith(e) for t, e in zip(whole, ends, strict=True))
    got = licenses(spark, [f"some words before {t} and after" for t in whole])
    assert got == [[(3, 3 + len(t.split()), n, 1.0)] for n, t in zip(names, whole, strict=True)]
    cut, liability = whole[0].split(" IN NO EVENT ")
    assert [(n, c < 0.8) for _, _, n, c in licenses(spark, [cut])[0]] == [("MIT", True)]
    assert licenses(spark, [f"IN NO EVENT {liability}"]) == [[]]


def test_repeated_notices_are_each_reported(spark):
    names = ["MIT-line", "CC-BY-NC-4.0-line", "Apache-2.0-line", "GPL-3.0-line"]
    texts, want = [], []
    for name in names:
        for times, between in ((2, "\n"), (7, " "), (60, "\n"), (3, " or ")):
            notice, gap = license_scan.TEMPLATES[name].text, len(between.split())
            n = len(notice.split())
            texts.append(between.join([notice] * times))
            want.append([(i * (n + gap), i * (n + gap) + n, name, 1.0) for i in range(times)])
    assert licenses(spark, texts) == want


def test_pieces_are_fitted_on_long_words_and_long_pieces(spark):
    pieces = language_model.load_pieces(language_model.default_vocabulary())
    assert {b"international", b"configuration"} <= set(pieces.strings) and pieces.longest == max(map(len, pieces.strings))
    strings, begins = [b"a", b"b", b"bbbbbbbbbbbbbbb", b"a"], np.array([True, False, False, False])
    p = language_model.Pieces(strings, begins, *language_model.normalised(np.arange(1.0, 5.0), begins, 3.0))
    words = ["a" + "b" * 20, "a" + "b" * 70, "abab" * 50, "a"]
    want = np.zeros(4)
    for w in (x.encode() for x in words):  # plain recursion over all segmentations
        at = [[(i, len(w) - len(w[e:]), e + len(s)) for i, s in enumerate(strings) if w.startswith(s, e) and begins[i] == (e == 0)] for e in range(len(w))]
        left, right = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        for e in range(len(w)):
            for i, _, f in at[e]:
                left[f] += left[e] * math.exp(p.logp[i])
        for e in reversed(range(len(w))):
            right[e] = sum(math.exp(p.logp[i]) * right[f] for i, _, f in at[e])
        for e in range(len(w)):
            for i, _, f in at[e]:
                want[i] += left[e] * math.exp(p.logp[i]) * right[f] / right[0]
    fitted = language_model.fit_pieces(spark.createDataFrame([(w, 1) for w in words], "word string, c long"), p, 1)
    logp, stop = language_model.normalised(want, begins, 4.0)
    assert np.allclose(fitted.logp, logp) and math.isclose(fitted.stop, stop)
    got = language_model.spelling(pa.array(words), p) - p.stop
    assert math.isclose(got[1], language_model.long_forward(words[1].encode(), p))
    assert np.allclose(got[0], language_model.long_forward(words[0].encode(), p))


def test_encoder_cuts_where_the_library_cuts():
    whole, encoder = Tokenizer.from_file(default_path()), Encoder.of(default_path())
    # Characters that later Unicode versions class otherwise; contractions at borders; white space of all widths.
    texts = ["a\u0558b 1\u058b", "x\u0c5cy \u208f2", "\ua7ce\ua7cfz \U000107bbq", "''s 's  's\n'll'rex'S'v", "'", "a'", "'s", "l'l", "a \u3000b\u2003 c\xa0\n", " ", "x \t"]
    for some in (texts, texts[::-1], *([t] for t in texts)):
        data, rows = text_bytes(pa.array(some, pa.string()))
        cut = np.append(encoder._borders(data, rows), len(data))
        ids, offsets = encoder.encode(pa.array(some, pa.string()))
        for i, t in enumerate(some):
            inside = cut[(cut > rows[i]) & (cut <= rows[i + 1])] - rows[i]
            assert inside.tolist() == [len(t[:end].encode()) for _, (_, end) in whole.pre_tokenizer.pre_tokenize_str(t)]
            assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_makes_no_call_for_each_word():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(8)) for _ in range(20_000)]
    texts = pa.array([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
    encoder, profile = Encoder(default_path()), cProfile.Profile()
    profile.runcall(encoder.encode, texts)
    assert sum(entry.callcount for entry in profile.getstats()) < len(words) / 2
