"""Fill-in-the-middle, phrase collocations and line dedup against brute force and SQL on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlane.llm import phrases
from voltlane.llm.fill_middle import SkipList, cut, fill_in_middle, restored, unit_lengths
from voltlane.llm.lines import SALTS, drop_lines, line_dedup
from voltlane.llm.phrases import collocations
from voltlane.llm.queries import QUERIES
from voltlane.llm.sql import SQL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos int, key string, h string"


def table(spark, rows):
    """Documents with columns that have the operators' own names."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "k", "h") for i, t, lang in rows], SCHEMA).repartition(3)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- fill in the middle ------------------------------------------------------------------------------------

TEXTS = [None, "", "a", "日本語テキスト", "naïve 🙂 text\nwith lines", "has <S> mark", "<P", "x" * 5000, "é🙂" * 40_000, "tail <", "<M> "] + [f"text number {i} of some" for i in range(200)]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 5000])
def test_skip_list_reaches_every_rank(n):
    lengths = np.random.default_rng(n).integers(1, 9, n)
    lanes = SkipList(lengths)
    want = np.concatenate([[0], np.cumsum(lengths)])
    assert [lanes.point(k) for k in range(n + 1)] == want.tolist()
    assert lanes.total == want[-1]
    for k in range(1, len(lanes.units)):
        assert lanes.units[k].sum() == n and lanes.points[k].sum() == want[-1]
    if n == 5000:
        assert 3 <= len(lanes.units) <= 8 and len(lanes.units[1]) < n / 5


def test_units_of_a_pattern_add_up_to_the_text():
    word = re.compile(r"\w+", re.DOTALL)
    for t in ("", "one", " one  two. ", "..", "a b"):
        assert unit_lengths(t, word).sum() == len(t)
    assert unit_lengths("one  two.", word).tolist() == [3, 5, 1]
    n, form, a, b, output = cut("alpha beta gamma delta", "1:0", word, plain=0, spm=0)
    assert (n, form) == (4, "psm") and {a, a + b} <= {0, 5, 10, 16, 22} and output.startswith("<P>")


def test_fill_in_middle_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en"), (None, "no id here", None)]
    done = fill_in_middle(table(spark, rows), carry=("n_chars", "pos", "key"))
    done = done.withColumn("again", restored(F.col("output"), F.col("form")))
    got = done.collect()
    assert len(got) == len(rows) and done.columns[:4] == ["doc_id", "n_chars", "pos", "key"]
    forms = Counter()
    for r in got:
        t = "no id here" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        h = hashlib.sha256(f"1:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
            want = ("plain", None, None, t)
        elif h4 % 100 < 20:
            want = ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
        else:
            want = ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")
        assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["n"] == len(t) and r["again"] == t
        forms[r["form"]] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 5
    assert fill_in_middle(table(spark, [])).count() == 0


def test_text_that_is_no_utf8_is_cut_too(spark):
    """Such a byte counts as one code point. Spark itself replaces it on its way to Python."""
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF62C3A9FE') as string)").alias("text"))
    done = fill_in_middle(docs, plain=0).select("n", F.char_length(restored(F.col("output"), F.col("form"))).alias("m"))
    assert {tuple(r) for r in done.collect()} == {(5, 5)}


# --- line dedup --------------------------------------------------------------------------------------------

def dedup(rows, least=20, docs=3):
    """{row number: (n_lines, n_dropped, kept text)} in plain Python."""
    held = {}
    def key(line):
        k = lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= least else None
    for i, t, _ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if key(line):
                    held.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i >= last.get(key(x), i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(spark):
    r = random.Random(8)
    common = "This very line stands in every text of all"
    pool = [f"shared line number {i} with words" for i in range(30)] + ["ÄÖÜ straße größer als zwanzig", "short", "", "   ", common.upper(), f"\t{common} \r", "x" * 19, "x" * 20]
    rows = [(i * 3, "\n".join(r.choice([*pool, common, f"only here {i} {r.random()}"]) for _ in range(r.randrange(1, 200))), "en") for i in range(150)]
    rows += [(900, None, "en"), (901, "", None), (902, "\n", "en"), (903, "\n\n" + common + "\n", "en"), (None, common + "\n" + common, "en")]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], "en")]     # repeated rows, and one id with two texts
    docs = table(spark, rows)
    got = sorted((tuple(x) for x in drop_lines(docs, line_dedup(docs)).collect()), key=str)
    assert got == dedup(rows)
    assert sum(x[2] for x in got) > 1000


def test_two_documents_are_not_enough_however_often_they_repeat(spark):
    line = "a line of more than twenty letters"
    rows = [(1, "\n".join([line] * 5), "en"), (2, line, "en"), (2, line, "en"), (3, line[:-1], "en")]
    docs = table(spark, rows)
    assert line_dedup(docs).count() == 0
    assert sorted((tuple(x) for x in drop_lines(docs, line_dedup(docs, min_docs=2)).collect()), key=str) == dedup(rows, docs=2)
    assert line_dedup(table(spark, [])).count() == 0 and drop_lines(docs.limit(0), line_dedup(docs)).count() == 0


def test_bitmaps_are_words_of_bits(spark):
    line = "a line of more than twenty letters"
    body = "\n".join([str(i) for i in range(129)] + [line, "end"])
    docs = table(spark, [(i, body, "en") for i in range(3)])
    got = {b["doc"]: (b["n_dropped"], b["keep"]) for b in line_dedup(docs).collect()}
    assert got == {0: (1, [-1, -1, ~2]), 1: (1, [-1, -1, ~2])}


def test_line_dedup_stays_in_the_jvm_and_spreads_one_line(spark):
    """No Python in the plan, and one line of all documents is sorted in many groups."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same line in every document").alias("text"))
    done = drop_lines(docs, line_dedup(docs))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning(h1" in plan and "salt" in plan
    assert docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("s")).distinct().count() > 2500
    assert done.agg(F.sum("n_dropped")).first()[0] == 4999


# --- phrases -----------------------------------------------------------------------------------------------

def phrase_table(rows, least=100, top=2000, cover=100):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i:i + k])] += 1
    kept = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    gone = set()
    for (lang, *w), a in kept.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                q = (lang, *w[i:j])
                if j - i < len(w) and 100 * a >= cover * f[q]:
                    gone.add(q)
    out = []
    for (lang, *w), a in kept.items():
        if (lang, *w) in gone:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    final = []
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            final.append((x[0], rank[x[0]], *x[1:]))
    return final


def prose(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["The", "straße", "été", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return " ".join(r.choices(words, weights)[0] + r.choice(["", "", "", "", ",", ".", "\n", "\t", "!?"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(i, 400), ("en", "de", None, "und")[i % 4]) for i in range(60)]
    rows += [(i, "same same same same same same", "en") for i in range(60, 90)] + [(90, None, "en"), (91, "", "fr"), (92, ".,;", "fr"), (92, ".,;", "fr"), (None, "w0 w1 w2", "en")]
    rows += [(100 + i, f"zzz yyy xxx{i % 2} www vvv\x0buuu", "en") for i in range(12)]
    return rows


@pytest.mark.parametrize("least, top, cover, budget", [(10, 50, 100, 1 << 19), (10, 2000, 60, 40), (25, 3, 100, 300)])
def test_collocations_against_brute_force(spark, corpus, least, top, cover, budget):
    got = sorted(tuple(r) for r in collocations(table(spark, corpus), least=least, top=top, cover=cover, budget=budget).collect())
    want = phrase_table(corpus, least, top, cover)
    assert got == sorted(want) and len(want) > 8


def test_prefixes_are_extended_until_they_fit(spark, corpus, monkeypatch):
    """With a small budget hot prefixes go down to full depth, and lists that go to tasks stay within their bound."""
    seen = []
    original = phrases._extensions
    monkeypatch.setattr(phrases, "_extensions", lambda d, b, p, e: seen.append([len(x) for x in e]) or original(d, b, p, e))
    collocations(table(spark, corpus), least=10, budget=20).count()
    assert len(seen) == 3 and all(n > 0 for n in seen[-1])
    seen.clear()
    monkeypatch.setattr(phrases, "MOST_PREFIXES", 5)
    got = sorted(tuple(r) for r in collocations(table(spark, corpus), least=10, budget=20).collect())
    assert all(n <= 5 for level in seen for n in level)
    assert got == sorted(phrase_table(corpus, 10))


def test_no_words_no_phrases(spark):
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [(1, None, None), (2, "", "en")])).count() == 0
    assert collocations(table(spark, [(1, "a b " * 50, "en")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(i, " ".join(["p q"] * 2000), "en") for i in range(30)]
    got = [tuple(r) for r in collocations(table(spark, rows), least=100).collect()]
    assert sorted(got) == sorted(phrase_table(rows))
    big = spark.sql("select 3000000000001L a, 9000000000000001L n, 3000000000002L l, 3000000000003L r")
    exact = "cast(cast(1000 * cast(a as decimal(18,0)) as decimal(20,0)) * cast(n as decimal(18,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"
    assert big.select(F.expr(exact)).first()[0] == 1000 * 3000000000001 * 9000000000000001 // (3000000000002 * 3000000000003)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert set(names) == set(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, result.fetchall()))
