"""The text operators against brute force on small and awkward tables."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlane.llm import text as tx
from voltlane.llm.chat import COSTS, ENDINGS, INSERTS, ROLES, format_chats, steps
from voltlane.llm.decontaminate import contamination
from voltlane.llm.html_extract import extract, main_text
from voltlane.llm.language import LanguageModels
from voltlane.llm.near_duplicates import components, near_duplicates
from voltlane.llm.packing import _encoder, default_vocabulary, first_fit_decreasing, pack
from voltlane.llm.quality import quality_rules
from voltlane.llm.sharding import communication_matrix, shard_rows
from voltlane.llm.substrings import substring_dedup
from voltlane.llm.toxicity import POWERS, ToxicityModel, learning_rows

rng = random.Random(5)
WORDS = ["the", "of", "Straße", "été", "x1", "And", "blue", "run", "over", "hill", "ñu", "a", "b", "c", "d"]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))


BASE = prose(120, 1)
LONG = prose(30_000, 2)
TEXTS = [None, "", " \t\n", "one", "one two three", "One  two\nthree", BASE, BASE, BASE.replace("the", "thy", 1), BASE.upper(),
         prose(60, 3) + " " + BASE + "\n" + prose(40, 4), LONG, LONG[:90_000], prose(25, 6) * 4, "line a\nline a\n\nline b\nline a",
         "#*$ %&|<>\x0b é ü", prose(19, 7), prose(20, 8), prose(20, 8) + " tail", "a " * 70] + [prose(50, s) for s in range(20, 40)]


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def marks(s):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns have the operators' own names; one row is repeated, one has no id.
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 7, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, BASE, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, places int, doc string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_word_hashes_tell_words_apart():
    batch = tx.pa.RecordBatch.from_pydict({"t": [t or "" for t in TEXTS]})
    for rows, data, offsets in tx.text_pieces(batch, "t", 1000):
        w = tx.split_words(data, offsets)
        want = [words(TEXTS[i]) for i in range(rows.start, rows.stop)]
        assert w.counts().tolist() == [len(x) for x in want]
        flat = list(itertools.chain(*want))
        assert len(set(w.hashes().tolist())) == len(set(flat))


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in itertools.combinations(sets, 2):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[i] = label[j] = min(label[i], label[j])
    got = near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert near_duplicates(empty).collect() == []


def test_near_duplicates_in_a_crowd_of_edited_copies(spark):
    r = random.Random(3)
    base = prose(80, 50).split()
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(r.randrange(9)):
            t[r.randrange(len(t))] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(t))
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [{tuple(t.split()[j:j + 5]) for j in range(len(base) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert got == dict(enumerate(label))


def test_components_of_a_chain(spark):
    got = {r.id: r.label for r in components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(80, 70)], "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {80: 70} or got == {i: 0 for i in range(1, 61)} | {80: 70}


def test_substring_dedup(docs, empty):
    seen, want = {}, {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if seen.setdefault(tuple(w[j:j + 20]), (i, j)) < (i, j):
                gone[j:j + 20] = [True] * 20
        want[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    got = substring_dedup(docs, carry=("places", "doc")).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept_text == BASE
        else:
            assert (r.n_words, r.n_removed, words(r.kept_text)) == want[r.doc_id]
            assert sum(s.stop - s.start for s in r.removed) == r.n_removed
    assert substring_dedup(empty).collect() == []


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination(spark, docs, empty, block_bytes):
    items = [(1, " ".join(words(BASE)[30:45])), (2, "one two three"), (10, None), (3, ""), (None, "Line B"), (4, " ".join(words(TEXTS[11])[700:740])), (1, " ".join(words(BASE)[30:45]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = {}
    for i, t in items:
        w = marks(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            table.setdefault(tuple(w[j:j + k]), set()).add(i)
    got = contamination(docs, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        w = marks(BASE if r.doc_id is None else TEXTS[r.doc_id])
        hit, ids = set(), set()
        for k, own in table.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j:j + len(k)]) == k:
                    hit.update(range(j, j + len(k)))
                    ids |= own
        assert sum(s.stop - s.start for s in r.spans) == len(hit) and r["items"] == sorted(str(x) for x in ids - {None}) and r.n_words == len(w)
    assert contamination(empty, bench).collect() == []
    assert {len(r.spans) for r in contamination(docs, bench.limit(0)).collect()} == {0}


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        times = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        inside = {x for j in range(len(w) - 7) if times[tuple(w[j:j + 8])] > 1 for x in range(j, j + 8)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
    assert quality_rules(empty).collect() == []


def test_quality_measures_against_brute_force(spark):
    from voltlane.llm import quality as ql

    r = random.Random(31)
    texts = [t or "" for t in TEXTS if t is None or len(t) < 20_000]
    texts += [" ".join([f"w{i}x" for i in range(41)][:20] + ["ha"] * 9 + [f"v{i}" for i in range(21)])]
    texts += [" ".join(f"longer word u{i}" for i in range(30))]
    for i in range(60):
        own = [r.choice(["aé", "b", "ccc", "d9"]) for _ in range(r.randrange(5, 15))]
        body = [r.choice(own) if r.random() < r.choice([0.1, 0.9]) else f"u{r.randrange(10**6)}" for _ in range(r.randrange(130))]
        texts.append("".join(w + r.choice([" ", " ", "  ", "\n"]) for w in body))
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    seen = set()
    for i, t in enumerate(texts):
        w, x = words(t), got[i]
        chars, failed = max(sum(map(len, w)), 1), []

        def cover(size, at, w=w):
            return sum(len(w[j]) for j in {j + k for j in at for k in range(size)})

        places = {n: {} for n in range(2, 11)}
        for n, own in places.items():
            for j in range(len(w) - n + 1):
                own.setdefault(tuple(w[j:j + n]), []).append(j)
        for n, most in ql.TOP_GRAM.items():
            value = max([cover(n, at) for at in places[n].values() if len(at) > 1], default=0)
            assert x[f"top_{n}gram_chars"] == value
            failed += [f"top_{n}gram"] * (len(w) >= ql.MIN_WORDS and value / chars > most)
        for n, most in ql.ALL_GRAMS.items():
            value = cover(n, [j for at in places[n].values() if len(at) > 1 for j in at])
            assert x[f"dup_{n}gram_chars"] == value
            failed += [f"dup_{n}gram"] * (len(w) >= ql.MIN_WORDS and value / chars > most)
        lines, dup, dup_chars, n_lines = set(), 0, 0, 0
        for line in t.split("\n"):
            if words(line):
                n_lines += 1
                if line in lines:
                    dup, dup_chars = dup + 1, dup_chars + sum(map(len, words(line)))
                lines.add(line)
        assert (x.n_lines, x.n_dup_lines, x.dup_line_chars) == (n_lines, dup, dup_chars)
        failed += ["line_chars"] * (dup_chars / chars > ql.LINE_CHARS) + ["line_count"] * (dup / max(n_lines, 1) > ql.LINE_COUNT)
        assert x.failed == failed and x.kept == (not x.base_failed and not failed)
        seen |= {(x.kept, bool(failed), x.base_failed)}
    ha = next(i for i, t in enumerate(texts) if "ha ha" in t)
    assert (got[ha].top_2gram_chars, got[ha].top_3gram_chars, got[ha].top_4gram_chars, got[ha].kept) == (18, 18, 18, True)
    assert {(True, False, False), (False, True, False), (False, False, True)} <= seen


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    pieces = pack(docs, with_ids=True).collect()
    for key in range(len(TEXTS)):
        own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        ids = tokenizer.encode(TEXTS[key] or "", add_special_tokens=False).ids + [1]
        copies = 2 if key == 6 else 1
        assert sum(p.length for p in own) == copies * len(ids) and {p.doc_tokens for p in own} == {len(ids)}
        for p in own:
            assert p["ids"] == ids[p.start:p.start + p.length] and p.ids_crc32 == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for _, own in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        end = 0
        for p in own:
            assert p.offset == end
            end += p.length
        assert end <= 2048
    assert pack(empty).collect() == []


def test_words_encoded_together_have_their_own_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    odd = ["\x01", "a\x01b", "\x01\x01", "<|endoftext|>", "x<|startoftext|>y", "\u0301e", "e\u0301", "\u00a0", "don't,", "DON'T", "'S", "it's's", "'", "''ll", "A-b_c:9%", "<", "|>", "\x02", "12ab", "\u4f60\u597d", "\U0001f600"]
    r = random.Random(11)
    letters = list("abAB'st09 _-&|<>\t\n\x01\x00\x1c\u0107\u00e9\u00c9\u00d7\u00f7\u00df\u00ff\u2003\u00aa\u00b5\u03a3\u0130\u0436\u4f60\u00b2\u2167\u0661\u0085") + odd
    mixed = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts = [*odd, " ".join(odd), *[t or "" for t in TEXTS], *mixed]
    got = list(_encoder(open(default_vocabulary(), encoding="utf-8").read()).encode([t.encode() for t in texts]))
    for t, ids in zip(texts, got, strict=True):
        assert ids == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_a_tokenizer_without_word_ends_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for t in TEXTS]
    got = list(_encoder(open(path, encoding="utf-8").read()).encode([t.encode() for t in texts]))
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in expected]


def test_first_fit_decreasing_is_first_fit():
    sizes = np.array([rng.randrange(1, 101) for _ in range(300)])
    bins, _ = first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[i]
        assert bins[i] == b


def test_sharding(docs, empty):
    got = shard_rows(docs, ["doc_id", "places"]).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == len(TEXTS) + 2 and max(count.values()) - min(count[s] for s in range(16)) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert shard_rows(empty, ["doc_id"]).collect() == []
    m = np.mean([communication_matrix([10, 30, 0, 60], 4, seed) for seed in range(400)], axis=0)
    assert np.allclose(m, np.array([10, 30, 0, 60])[:, None] / 4, atol=0.6)


def test_draws_beyond_numpys_limit_follow_the_exact_law():
    import math

    from voltlane.llm.sharding import _hypergeometric

    r = np.random.Generator(np.random.PCG64(3))
    for good, bad, sample in ((30, 70, 40), (5, 3, 6), (1, 40, 20), (200, 200, 13)):
        times = Counter(_hypergeometric(r, good, bad, sample, drawn=0) for _ in range(20_000))
        p = {x: math.comb(good, x) * math.comb(bad, sample - x) / math.comb(good + bad, sample) for x in range(max(0, sample - bad), min(good, sample) + 1)}
        likely = {x for x in p if p[x] * 20_000 >= 5}
        chi = sum((times[x] - 20_000 * p[x]) ** 2 / (20_000 * p[x]) for x in likely)
        assert set(times) <= set(p) and chi < len(likely) + 5 * math.sqrt(2 * len(likely)) + 5
    # At 40 billion rows: mean and variance of the law, and whole margins.
    good, bad, sample = 2_500_000_000, 37_500_000_000, 9_000_000_000
    x = np.array([_hypergeometric(r, good, bad, sample) for _ in range(300)], dtype=float)
    n = good + bad
    sd = math.sqrt(sample * (good / n) * (bad / n) * ((n - sample) / (n - 1)))
    assert abs(x.mean() - sample * good / n) < 5 * sd / math.sqrt(300) and 0.8 < x.std() / sd < 1.2
    rows = [3_000_000_000, 0, 17, 999_999_999, 2_000_000_001]
    m = communication_matrix(rows, 4, 5)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()
    halves = np.mean([communication_matrix([10, 30, 0, 60, 3], 4, seed, drawn=20) for seed in range(400)], axis=0)
    assert np.allclose(halves, np.array([10, 30, 0, 60, 3])[:, None] / 4, atol=0.6)


def test_every_place_is_as_likely_for_every_row(spark):
    docs = spark.createDataFrame([(i,) for i in range(8)], "doc_id bigint").repartition(3)
    places = np.zeros((8, 8))
    for seed in range(16):
        for x in shard_rows(docs, ["doc_id"], shards=2, seed=seed).collect():
            places[x.doc_id, x.shard * 4 + x.slot] += 1
    assert places.sum(axis=0).tolist() == [16] * 8 and ((places - 2) ** 2 / 2).sum() < 49 + 5 * np.sqrt(98)


def test_toxicity(spark, docs, empty):
    bad = ["trashy", "vile", "scummy"]
    r = random.Random(9)
    rows = [(i, prose(40, i) + (" " + r.choice(bad) + " " + r.choice(bad) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(800)]
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = ToxicityModel(learning_rows(learn.drop("toxic"), learn.select("doc_id", "toxic")))
    got = {x.doc_id: x for x in model.score(learn).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows) >= 0.97 * len(rows)
    assert all(0 <= x.score <= 1 for x in model.score(docs).collect()) and model.score(empty).collect() == []
    exact = model.index
    q = np.abs(np.random.default_rng(1).normal(size=(50, exact.weights.shape[0]))).astype(np.float32)
    score, _ = exact.nearest(q, 15)
    assert np.allclose(score, -np.sort(-(q @ exact.weights), axis=1)[:, :15], atol=1e-5)
    # As a column, without evidence, the scores are the same.
    alone = {x.doc_id: x.score for x in learn.select("doc_id", model.rating().alias("score")).collect()}
    assert all(np.isclose(alone[i], got[i].score, atol=1e-5) for i in alone) and len(alone) == len(rows)
    assert model.losses[POWERS.index(model.power)] == min(model.losses) and len(model.losses) == len(POWERS)
    none = ToxicityModel(learning_rows(empty, learn.select("doc_id", "toxic")))
    assert {(x.predicted, x.score) for x in none.score(docs).collect()} == {(0, 0.0)}


@pytest.mark.parametrize("often", [1, 16, 10**9])
def test_block_max_index_skips_blocks_and_stays_exact(monkeypatch, often):
    from voltlane.llm import toxicity

    monkeypatch.setattr(toxicity, "OFTEN", often)
    r = np.random.default_rng(8)
    m, v = 1000, 60
    # Twenty topics with words of their own and a few that all share, so most blocks cannot hold a near example.
    full = np.where(r.random((m, v)) < 0.02, 0.05, 0) + np.where(np.arange(v)[None, :] // 3 == (np.arange(m) % 20)[:, None], r.random((m, v)) + 0.2, 0)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    doc, term = np.nonzero(full)
    vectors = toxicity._Vectors(np.arange(v, dtype=np.uint64), np.ones(v))
    index = toxicity._Index(vectors, (m, doc, term, full[doc, term].astype(np.float32)), np.arange(m) % 2, np.arange(m))
    q = full[r.permutation(m)[:200]].astype(np.float32)
    score, which = index.nearest(q, 15)
    want = q @ full.T
    assert np.allclose(score, -np.sort(-want, axis=1)[:, :15], atol=1e-5)
    assert np.allclose(np.take_along_axis(want, index.ids[which], 1), score, atol=1e-5)
    assert all(len(set(w)) == 15 for w in which.tolist())
    if often == 10**9:
        assert index.skipped > 0.6 * index.blocks_asked
    same = toxicity._Index(vectors, (m, doc, term, np.ones(len(doc), np.float32)), np.arange(m) % 2, np.arange(m))
    tied = same.nearest(np.ones((3, v), np.float32), 15)[1]
    assert (tied == tied[0]).all()


def test_labels_of_copies_and_bound_of_the_examples(spark):
    # Labels 0 and 1 of one text in equal numbers: toxic. A text beyond the bound is no example; ids may repeat.
    rows = [(i, prose(30, i) + (" vile" if i % 2 else ""), i % 2) for i in range(400)] + [(1000 + i, "equal copy of one text", i % 2) for i in range(8)]
    learn = spark.createDataFrame([*rows, rows[3], (5000, prose(4000, 77) + " vile", 1)], "doc_id bigint, text string, toxic int")
    found = learning_rows(learn.drop("toxic"), learn.select("doc_id", "toxic"))
    own = [(i, y) for i, x, y in rows[400:] if zlib.crc32(str(i).encode()) % 4 != 2]
    want = int(sum(y for _, y in own) * 2 >= len(own))
    copies = [r for r in found.known.collect() if r.doc >= 1000 and r.doc < 2000]
    assert [(r.doc, r.label) for r in copies] == [(min(i for i, _ in own), want)]
    model = ToxicityModel(found, example_bytes=12_000)
    assert 5000 not in set(model.index.ids.tolist()) and 20 < len(model.index.ids) < 400 and len(set(model.index.ids.tolist())) == len(model.index.ids)


def test_toxicity_knows_more_words_than_one_matrix_had(spark):
    # 700 toxic words, each in two learning texts: more than the 512 words that were looked at before.
    r = random.Random(12)
    bad = [f"q{i}x" for i in range(700)]
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(20)) + (f" {bad[i // 4 % 700]} {bad[(i // 4 + 1) % 700]}" * 3 if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(2800)]
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    extra = learn.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, "the q5x") for i in range(50)], "a bigint, b string"))
    model = ToxicityModel(learning_rows(learn.drop("toxic"), learn.select("doc_id", "toxic")), docs=extra)
    index, used = model.index, {w for i, x, _ in rows if i % 4 == 0 and zlib.crc32(str(i).encode()) % 4 != 2 for w in x.split() if w.startswith("q")}
    assert len(used) > 512 and (index.vectors.weight > 0).sum() >= len(used)
    # Frequencies are counted over all documents: q5x has more of them than q6x, so less weight in the same learning texts.
    hashed = {w: tx.split_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), tx.MARKS, tx.LOWER).hashes()[0] for w in ("q5x", "q6x")}
    df, n = {w: sum(w in x.split() for _, x, _ in rows) + 50 * (w == "q5x") for w in hashed}, len(rows) + 50
    held = {r.doc_id for r in learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).collect()}
    known = [(i, x, y) for i, x, y in rows if zlib.crc32(str(i).encode()) % 4 != 2 and i not in held]
    n1, n0 = sum(y for *_, y in known), sum(1 - y for *_, y in known)
    for w, h in hashed.items():
        a = sum(w in x.split() for _, x, _ in known)
        g = 2 * (a * np.log((n1 + n0) / n1) + (n1 - a) * np.log((n1 - a) / ((n1 + n0 - a) * n1 / (n1 + n0))) + n0 * np.log((n1 + n0) / (n1 + n0 - a)))
        want = (np.log((n + 1) / (df[w] + 1)) + 1) * g ** model.power
        assert np.isclose(index.vectors.weight[np.searchsorted(index.vectors.terms, h)], want, rtol=1e-4)
    q = np.abs(np.random.default_rng(1).normal(size=(20, len(index.vectors.terms)))).astype(np.float32)
    assert np.allclose(index.nearest(q, 15)[0], -np.sort(-(q @ index.weights), axis=1)[:, :15], rtol=1e-3)


def test_language(spark, docs, empty):
    letters = {"aa": "abcde", "bb": "cdefg"}
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(30)), lang) for i in range(60) for lang in letters]
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = LanguageModels(learn).identify(learn.select("doc_id", "text", "lang").withColumnRenamed("lang", "doc")).collect()
    assert Counter(x.lang_pred for x in found) == {"aa": 60, "bb": 60}
    got = {x.doc_id: x for x in LanguageModels(learn).identify(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[6].lang_pred in letters
    assert {x.lang_pred for x in LanguageModels(empty).identify(docs).collect()} == {"und"}


def test_language_models_keep_all_grams_in_slices(spark):
    r = random.Random(6)
    letters = {"aa": "abcde", "bb": "cdefg"}
    rows = [(i, " ".join("".join(r.choice(letters[x]) for _ in range(5)) for _ in range(30)), x) for i in range(60) for x in letters]
    rows += [(500, "vwxyz zyxwv", "cc"), (500, "vwxyz zyxwv", "cc")]
    learn = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole, cut = LanguageModels(learn), LanguageModels(learn, slice_grams=300)
    assert len(whole.slices) == 1 and len(cut.slices) > 2 and whole.languages == cut.languages == ["aa", "bb", "cc"]
    asked = learn.unionByName(learn.limit(3)).select("doc_id", "text").union(spark.createDataFrame([(900, "vwx abq"), (901, None)], "a bigint, b string"))
    want, got = (sorted(m.identify(asked).collect(), key=str) for m in (whole, cut))
    assert len(want) == len(got) == len(rows) + 5
    for a, b in zip(want, got, strict=True):
        assert (a.doc_id, a.lang_pred, a.accepted) == (b.doc_id, b.lang_pred, b.accepted)
        assert np.isclose(a.score, b.score) and (a.bits is None or np.isclose(a.bits, b.bits))
    assert {x.lang_pred for x in got if x.doc_id == 500} == {"cc"}
    # Against Kneser-Ney by dictionaries.
    levels = [Counter(), None, None, None]
    for text in (x for _, x, lang in rows if lang == "aa"):
        padded = "   " + text
        levels[0].update(padded[i:i + 4] for i in range(len(text)))
    for k in (1, 2, 3):
        levels[k] = Counter(g[1:] for g in levels[k - 1])
    def discount(n):
        once, twice = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        return once / (once + 2 * twice) if once and twice else 0.75
    def p(g):
        n = levels[4 - len(g)]
        own = {k: v for k, v in n.items() if k[:-1] == g[:-1]}
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(n) + 1)
        return (max(n[g] - discount(n), 0) + discount(n) * len(own) * lower) / sum(own.values()) if own else lower
    text = rows[0][1]
    bits = -np.mean([np.log2(p(("   " + text)[i:i + 4])) for i in range(len(text))])
    assert all(np.isclose(x.bits, bits) for x in got if x.doc_id == 0 and x.lang_pred == "aa")


def test_language_beyond_the_basic_plane(spark):
    def text(first, seed):
        r = random.Random(seed)
        return " ".join("".join(chr(first + r.randrange(12)) for _ in range(5)) for _ in range(12))
    # Adlam and Gothic share no letter; emoji and private characters are not letters.
    rows = [(i, text(first, i), lang) for i in range(20) for first, lang in ((0x1E900, "adl"), (0x10330, "got"))]
    model = LanguageModels(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = [(1, text(0x1E922, 99)), (2, text(0x10330, 98)), (3, "\U0001f600\U0001f680 \U000f0000\U0010ffff"), (4, "\U00020000\U00020001")]
    got = {x.doc_id: x for x in model.identify(spark.createDataFrame(asked, "doc_id bigint, text string")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["adl", "got", "und"] and got[3].score == 0 and not got[3].accepted
    assert got[2].bits < 6 and got[4].lang_pred in ("adl", "got")


def test_html(spark):
    page = ("<html><head><title>t</title></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1>"
            "<p>One  <b>two</b>\n three<p>four<aside>no</aside><div class=comments><p>me</div><form>f</form></article><footer>&copy;</footer>")
    rows = [(1, "http://a/x", page), (1, "http://a/x", page), (2, None, None), (3, "", ""), (4, "http://b", "<p>plain<br>text &lt;"), (None, "odd", "<article><p>x")]
    rows += [(10 + i, "http://c", f"<div class=n>same on all</div><section><p>own text {i}</section>") for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "T & U\nOne two three\nfour" and got[2] == got[3] == "" and got[4] == "plain\ntext <" and got[None] == "x"
    assert got[12] == "own text 2"
    assert main_text("a" * 10**6, None) == "a" * 10**6


def _article(i, body, strip="Sold as is. No warranty of any kind is given here."):
    return f"<nav>menu</nav><div>beside</div><article><h1>Title {i}</h1><p>{body}</p><div class='legal-strip'><p>{strip}</p></div></article>"


def _extracted(spark, pages, host="http://h/"):
    rows = [(i, host, p) for i, p in enumerate(pages)]
    return {r.page_id: r.text.split("\n") for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_html_notice_in_the_articles_of_a_host(spark):
    def story(i):
        return " ".join(f"w{i}x{j}" for j in range(30))
    strip = "Sold as is. No warranty of any kind is given here."
    got = _extracted(spark, [_article(i, story(i)) for i in range(8)])
    assert all(got[i] == [f"Title {i}", story(i)] for i in range(8))
    # Parts that differ stay, and so does what stands in less than half of the articles.
    got = _extracted(spark, [_article(i, story(i), strip if i < 3 else f"Own words of {i}.") for i in range(8)])
    assert all(got[i] == [f"Title {i}", story(i), strip if i < 3 else f"Own words of {i}."] for i in range(8))
    # With its article, whole or edited, a part may repeat; three articles say nothing.
    assert all(len(t) == 3 for t in _extracted(spark, [_article(1, story(1))] * 8).values())
    copies = _extracted(spark, [_article(1, story(1) + f" end{i}") for i in range(8)])
    assert all(copies[i] == ["Title 1", story(1) + f" end{i}", strip] for i in range(8))
    assert all(len(t) == 3 for t in _extracted(spark, [_article(i, story(i)) for i in range(3)]).values())
    # The same story under its own title on each page is the article, not a notice.
    same = _extracted(spark, [f"<article><h1>Title {i}</h1><div class=body><p>{story(0)}</div></article>" for i in range(8)])
    assert all(same[i] == [f"Title {i}", story(0)] for i in range(8))


def test_html_text_is_what_the_tree_keeps(spark, monkeypatch):
    import voltlane.llm.html_extract as module

    page = _article(0, "one two three")
    assert [b.kind for b in module.branches(page)] == ["chrome", "beside", "article", "part"]
    assert _extracted(spark, [page])[0][:2] == ["Title 0", "one two three"]
    judge = module.importance
    monkeypatch.setattr(module, "importance", lambda nodes: judge(nodes).withColumn("importance", F.lit(1.0)))
    assert _extracted(spark, [page])[0][:2] == ["menu", "beside"]


def _least_cost(roles):
    best = {0: 0}
    for r in roles:
        new = {}
        for s, t, c, _ in steps(ROLES.index(r) + 1 if r in ROLES else 0, COSTS):
            if s in best:
                new[t] = min(new.get(t, 10**9), best[s] + c)
        best = new
    return min(c + COSTS["insert"] * len(ENDINGS[s]) for s, c in best.items())


def test_chat_repair(spark):
    r = random.Random(2)
    chats = {i: [r.choice([*ROLES, None, "bot"]) for _ in range(r.randrange(1, 7))] for i in range(40)}
    rows = [(c, t, x, f"m{t}") for c, own in chats.items() for t, x in enumerate(own)] + [(99, 0, "user", None)]
    got = format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert len(got) == len(rows)
    for c, own in chats.items():
        pieces = sorted((x for x in got if x.conv_id == c), key=lambda x: x.piece)
        assert [x.piece for x in pieces] == list(range(len(own)))
        cost, messages = 0, []
        for x in pieces:
            known = x.role in ROLES
            cost += 0 if x.role == x.final_role else COSTS["relabel"] if known else COSTS["name"]
            cost += COSTS["insert"] * (len(x.inserted) + len(x.ending)) + COSTS["merge"] * ("merge" in x.action)
            messages += list(x.inserted) + ([x.final_role] if "merge" not in x.action else []) + list(x.ending)
        assert cost == _least_cost(own)
        body = messages[1:] if messages[0] == "system" else messages
        assert body == ["user", "assistant"] * (len(body) // 2)
        text = "".join(x.rendered for x in pieces)
        assert re.findall(r"<\|(user|assistant|system)\|>", text) == messages and text.count("<|end|>") == len(messages)
    assert INSERTS


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    docs.drop("places", "doc").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words(TEXTS[25])[5:30]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in near_duplicates(docs).collect() if r.kept}
    left = pipeline.decontamination(spark, pipeline.substrings(spark, pipeline.near_dedup(spark, docs, str(tmp_path)), str(tmp_path)), str(tmp_path))
    assert left.columns == list(pipeline.COLUMNS) and {r.doc_id for r in left.collect()} == kept - {25}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    assert hashlib and html
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} in (kept - {25}, set())


def test_pipeline_keeps_documents_without_labels_of_both_classes(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    table = docs.drop("places", "doc")
    for i, labels in enumerate(([], [(6, 1, 0)], [(j, 1, 0) for j in range(40)], [(10**6, 1, 1)], [(j, 1, 1) for j in range(40)])):
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert pipeline.toxicity(spark, table, f"{tmp_path}/{i}").count() == len(TEXTS) + 2


def test_pipeline_run_against_plain_python(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    bad, r = ["trashy", "vile", "scummy"], random.Random(21)
    passage, leak = prose(25, 900), prose(30, 901)
    texts = {i: prose(40, 1000 + i) + (f" {r.choice(bad)} {r.choice(bad)}" * 2 if i % 4 == 0 else "") for i in range(400)}
    labels = [(i, 1, int(i % 4 == 0)) for i in range(320)]
    texts |= {500: None, 501: "", 502: BASE, 503: BASE, 504: BASE.replace("the", "thy", 1), 505: prose(40, 902) + " " + passage,
              506: prose(40, 903) + " " + passage, 507: prose(20, 904) + " " + leak + " " + prose(20, 905), 508: prose(5000, 906)}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Toxicity: the planted words are the rule.
    left = {i: t for i, t in texts.items() if not set(words(t)) & set(bad)}
    # Near-duplicates: shingles of 5 words, similarity 0.75, least id of a component.
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, t in left.items() for w in [words((t or "").lower())]}
    label = {i: i for i in left}
    for _ in range(3):
        for i, j in itertools.combinations(left, 2):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[i] = label[j] = min(label[i], label[j])
    left = {i: t for i, t in left.items() if label[i] == i}
    # Passages of 20 words that an earlier text has; here they end their text.
    seen = set()
    for i in sorted(left):
        w = words(left[i])
        own = [tuple(w[j:j + 20]) for j in range(len(w) - 19)]
        gone = {x for j, k in enumerate(own) if k in seen for x in range(j, j + 20)}
        seen |= set(own)
        if gone:
            assert gone == set(range(min(gone), len(w)))
            left[i] = " ".join(w[:min(gone)])
    # Windows of 10 words of the benchmark.
    b = marks(leak)
    windows = {tuple(b[j:j + 10]) for j in range(len(b) - 9)}
    left = {i: t for i, t in left.items() if not windows & {tuple(w[j:j + 10]) for w in [marks(t)] for j in range(len(w) - 9)}}
    assert 503 not in left and 504 not in left and 507 not in left and 506 in left and len(left) == 306
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = []
    for i, t in left.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, s, len(c), zlib.crc32(np.array(c, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048) for c in [ids[s:s + 2048]]]
    got = pipeline.run(spark, str(tmp_path)).collect()
    odd = {x[0] for x in set(want) ^ {(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got}}
    assert not odd and len(got) == len(want), [(i, texts[i] and texts[i][-60:]) for i in sorted(odd)[:5]]
    room = []
    for size in sorted((x[2] for x in want), reverse=True):
        k = next((k for k, free in enumerate(room) if free >= size), len(room))
        room[k:k + 1] = [(room[k] if k < len(room) else 2048) - size]
    sequences = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert sorted(sequences.values()) == sorted(2048 - free for free in room)
