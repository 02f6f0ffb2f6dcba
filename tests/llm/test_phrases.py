import collections
import random
import re

import pytest

from memengine.llm import phrases

SF = "/root/testdata/sf0.001"


def slow(docs, longest, least, limit, share):
    """Every phrase counted, every candidate looked at."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    able = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = collections.Counter()
    for (lang, *w), a in able.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, *w[i : i + m]] = max(inside[lang, *w[i : i + m]], a)
    rows = collections.defaultdict(list)
    for (lang, *w), a in able.items():
        cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        if 100 * inside[lang, *w] < share * a:
            score, _, l, r = min(cuts)
            rows[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:limit], 1)}


def texts():
    rng = random.Random(3)
    known = [" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 2) for _ in range(rng.randint(2, 6))) for _ in range(12)]
    out = []
    for i in range(300):
        parts = [rng.choice(known) if rng.random() < 0.5 else " ".join(rng.choice("aabbccdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(8)]
        out.append((rng.choice(["en", "fr", None]), "".join(p + rng.choice([" ", ". ", "\n", "\t", ",", "  "]) for p in parts)))
    return [*out, ("en", None), ("fr", ""), ("zz", "?!"), ("en", "Ä É a\x00b \x1c A\x0bB " * 40), ("en", "the end " * 50_000)] + out[:40]


@pytest.mark.parametrize(("longest", "least", "limit", "share", "first"), [(4, 5, 2000, 80, 2), (4, 3, 6, 80, 1), (4, 2, 25, 50, 1), (5, 3, 40, 100, 1), (3, 2, 1, 101, 1), (2, 2, 10, 80, 1)])
def test_same_as_counting_everything(spark, longest, least, limit, share, first):
    docs = texts()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, n int, phrase string").repartition(3)
    got = phrases.collocations(frame, longest, least, limit, share, first).collect()
    want = slow(docs, longest, least, limit, share)
    assert len(got) == len(want) and {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want


def test_growth_skips_prefixes_that_cannot_matter(spark, monkeypatch):
    rows, asked = spark.createDataFrame(texts(), "lang string, text string"), []
    for name in ("_all", "_some"):
        monkeypatch.setattr(phrases, name, lambda docs, n, *how, f=getattr(phrases, name), **more: asked.append((n, f(docs, n, *how, **more))) or asked[-1][1])
    phrases.collocations(rows, 4, 2, 3, 80, 1)
    grown = {n: df.count() for n, df in asked[:4]}
    every = slow(texts(), 4, 2, 10**6, 10**6)
    assert set(grown) == {1, 2, 3, 4} and grown[3] < sum(len(r[2].split(" ")) == 3 for r in every) / 2


def test_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    docs = texts()[:80]
    got = phrases.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(2), 4, 3, 50, 80, 2).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == slow(docs, 4, 3, 50, 80)


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", "a b", 10**17)], "lang string, phrase string, n long")
    parts = spark.createDataFrame([("en", "a", 2 * 10**17), ("en", "b", 3 * 10**17 + 7)], "lang string, phrase string, n long")
    assert phrases._scored(grams, 2, parts).collect()[0].score == 2_000_000 * 10**17 // (5 * 10**17 + 7)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
