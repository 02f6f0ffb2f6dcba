"""Operators that SQL can't express, held against plain loops that share no code with them."""

import math
import random

import numpy as np

from memengine.llm import langid, packing, quality

SF = "/root/testdata/sf0.01"


def slow_statistics(text):
    b = (text or "").encode()
    words, lines = b.split(), b.split(b"\n")
    of = lambda chars: sum(c in chars for c in b)
    lower, upper, digit, other = of(range(97, 123)), of(range(65, 91)), of(range(48, 58)), of(range(128, 256))
    per = lambda x, y: x / max(y, 1)
    kinds = set(words)
    return {
        "size": math.log1p(len(b)), "n_words": math.log1p(len(words)), "word_bytes": per(lower + upper + other, len(words)), "upper": per(upper, lower + upper), "digits": per(digit, len(b)),
        "marks": per(of(b"!#$%&*@+"), len(b)), "stops": per(of(b".,;:?'\"()-"), len(b)), "bars": per(of(b"|<>{}[]\\/_=^~`"), len(b)), "other_bytes": per(other, len(b)), "line_words": math.log1p(per(len(words), len(lines))),
        "distinct_words": per(len(kinds), len(words)), "distinct_lines": per(len(set(lines)), len(lines)), "marked_words": per(sum(w[-1:] in b"!#$%&*@+|" for w in kinds), len(kinds)),
    }


def test_compiled_rules_are_the_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(rules.rules) > 5
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "Word! " * 120_000}
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(i, texts[i]) for i in (-1, -2, -3)], "doc_id long, text string"))
    for r in quality.score_quality(odd, rules).collect():
        said = slow_statistics(texts[r.doc_id])
        assert all(abs(r[s] - x) < 1e-9 for s, x in said.items())
        total = rules.constant + sum(w for rule, w in zip(rules.rules, rules.weights, strict=True) if all((r[s] > t) == above for s, above, t in rule))
        score = 1 / (1 + math.exp(-total))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.3)


def grams(text):
    plain = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text.lower())
    return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def test_kernel_and_ridge_are_those_of_sets(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text rlike '[a-z]'").limit(120).collect()
    texts, labels = [r.text.lower() for r in rows], [r.lang for r in rows]
    sets = [grams(t) for t in texts]
    has = langid.presence(texts)
    # hashed places: a few n-grams may share one
    assert all(0 <= len(s) - int(h.sum()) <= 0.1 * len(s) + 2 for s, h in zip(sets, has, strict=True))
    dense = has.astype(float)
    shared = dense @ dense.T
    kernel = np.array([[shared[i, j] / math.sqrt(shared[i, i] * shared[j, j]) for j in range(len(rows))] for i in range(len(rows))])
    exact = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.abs(kernel - exact).max() < 0.08 and np.abs(kernel - exact).mean() < 0.03
    # all rows are landmarks: Nystroem features span the kernel, so that the fit is kernel ridge regression with a constant
    model = langid.fit(has, labels, landmarks=len(rows), ridge=1e-2)
    assert model.langs == sorted(set(labels))
    n, target = len(rows), np.array([[1.0 if a == b else -1.0 for b in model.langs] for a in labels])
    both = kernel + 1.0  # the constant is one more feature
    want = both @ np.linalg.solve(both + 1e-2 * n * np.eye(n), target)
    assert np.abs(model.outputs(has) - want).max() < 0.02
    long = " ".join(texts)[: 1 << 20]
    assert (langid.presence([long])[0].sum()) >= has.any(0).sum() * 0.9


def slow_best_fit(sizes, capacity, limit):
    """(bin, offset) of each size: scans all open bins for the one with least room that is enough."""
    open_bins, made, out = [], 0, []
    for size in sizes:
        fits = [b for b in open_bins if b[1] >= size]
        if fits:
            least = min(b[1] for b in fits)
            chosen = [b for b in fits if b[1] == least][-1]
            open_bins.remove(chosen)
        else:
            if len(open_bins) == limit:
                full = min(b[1] for b in open_bins)
                open_bins.remove([b for b in open_bins if b[1] == full][-1])
            chosen = [made, capacity]
            made += 1
        out.append((chosen[0], capacity - chosen[1]))
        if chosen[1] > size:
            open_bins.append([chosen[0], chosen[1] - size])
    return out


def test_placement_is_best_fit():
    rng = random.Random(3)
    for capacity, limit in ((16, 3), (64, 8), (1024, 40)):
        sizes = [min(capacity, max(1, int(rng.paretovariate(0.7)))) for _ in range(1500)]
        bins = packing.OpenBins(capacity, limit)
        assert [bins.place(n) for n in sizes] == slow_best_fit(sizes, capacity, limit)


def test_packed_rows_are_whole_and_gapless(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 1024, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = packing.pack(pieces, per_task=1000).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(i, 1 + i * 37 % 1024) for i in range(3000)]
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024 and len(filled) <= 1.05 * sum(r.length for r in got) / 1024 + 3
