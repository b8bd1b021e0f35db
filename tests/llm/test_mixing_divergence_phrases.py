"""Mixing, divergence and phrases against brute force, on odd rows and with small blocks."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import collocations, divergence, mixing

DOCS = "doc_id long, text string, lang string, source string"


def corpus(seed, n=300, langs=("en", "de", None, ""), sources=("a", "b", "c", "é", None), words=60):
    """Documents of a skewed vocabulary, with capitals, breaks, odd characters, nulls and repeated rows; a source holds a third."""
    rng = random.Random(seed)
    names = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(words)] + ["Über", "été", "x1y", "don't", "\x1f", "naïve"]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 30, 120])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in (rng.choice(names[: rng.choice([4, 12, len(names)])]) for _ in range(size)))
        rows.append((i if rng.random() > 0.02 else None, text.title() if rng.random() < 0.3 else text, rng.choice(langs), "a" if rng.random() < 0.33 else rng.choice(sources)))
    rows += [(n, None, "en", "b"), (n, None, "en", "b"), (n + 1, "", None, None)]
    return rows + rows[:20]


def cluttered(df):
    return df.withColumns({c: F.lit("x") for c in ("size", "rank", "place", "copy", "term", "word", "value", "part", "_part", "_row")})


# 11


def brute_targets(sizes):
    """Each source's target as a fraction, by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_against_brute_force(spark, seed):
    rows = corpus(seed)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    docs = cluttered(spark.createDataFrame(rows, DOCS))
    got = mixing.taken(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _, _ in rows)
    by_target = defaultdict(lambda: [0, 0])
    for r in got:
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        e = by_target[round(r["target"], 6), r["source_size"]]
        e[0], e[1] = e[0] + r["taken"], max(e[1], r["size"])
        # Every document is taken as often as expected, or as the whole numbers around it.
        if r["size"]:
            assert abs(r["taken"] / r["size"] - r["target"] / r["source_size"]) < 1
    assert {k for k in by_target} == {(round(float(target[s]), 6), sizes[s]) for s in sizes}
    for (wanted, _), (taken, largest) in by_target.items():
        assert abs(taken - wanted) <= largest
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())
    again = mixing.taken(docs.repartition(7)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # The mix itself has as many copies of each text.
    copies = Counter(r["text"] for r in mixing.mixed(docs).collect())
    of = {i: t for i, t, _, _ in rows}
    expected = Counter()
    for r in got:
        if r["doc_id"] is not None and r["size"]:
            expected[of[r["doc_id"]]] += r["taken"] // r["size"]
    known = {t for i, t, _, _ in rows if i is not None and size(t)} - {t for i, t, _, _ in rows if i is None}
    assert {t: copies[t] for t in known} == {t: expected[t] for t in known}


def test_mix_of_one_hot_document(spark):
    rows = [(7, "one two", "en", "a")] * 900 + [(k, "x " * (k % 9), "en", "b") for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(docs).where("doc_id = 7 and source_size = 1800").collect()
    assert len(got) == 900 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 2
    assert abs(mixing.mixed(docs).where("source = 'a'").count() * 2 - got[0]["target"]) <= 2


# 12


def brute_divergence(rows, least, top):
    docs = [(l or "", s or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for _, t, l, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, c in of for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        count = {s: Counter() for _, s, _ in of}
        for _, s, c in of:
            count[s].update({t: c[t] for t in kept if c[t]})
        share = lambda c: [1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept]
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in count if o != s]
            words = [(a - b, t) for t, a, b in zip(kept, p[s], q) if count[s][t] and a > b]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", words, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize(("least", "slice_terms", "term_block", "source_block"), [(30, 1_000_000, 1024, 128), (5, 20, 7, 2), (10_000, 100, 8, 8)])
def test_divergence_against_brute_force(spark, least, slice_terms, term_block, source_block):
    rows = corpus(3)
    got = divergence.divergence(cluttered(spark.createDataFrame(rows, DOCS)), least, 50, slice_terms=slice_terms, term_block=term_block, source_block=source_block).collect()
    assert {tuple(r) for r in got} == brute_divergence(rows, least, 50) and len(got) == len({tuple(r) for r in got})


# 13


def brute_phrases(rows, least=30, top=2000):
    out = []
    texts = defaultdict(list)
    for _, t, lang, _ in rows:
        texts["und" if lang is None else lang].append(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for lang, of in texts.items():
        f = [Counter() for _ in range(5)]
        for t in of:
            for piece in re.split("[.,;:!?\x0a-\x0d]", t):
                w = re.findall("[^\x20\x09]+", piece)
                for m in range(1, 5):
                    f[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
        candidates = {g: a for m in (2, 3, 4) for g, a in f[m].items() if a >= least}
        found = []
        for g, a in candidates.items():
            inside = [b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            cut = min((2_000_000 * a // (f[k][g[:k]] + f[len(g) - k][g[k:]]), k) for k in range(1, len(g)))
            found.append((-cut[0], -a, " ".join(g).encode(), a, f[cut[1]][g[: cut[1]]], f[len(g) - cut[1]][g[cut[1] :]]))
        for rank, (s, _, g, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), a, left, right, sum(f[1].values()), -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "small"), [(30, 2000, False), (3, 25, True)])
def test_phrases_against_brute_force(spark, monkeypatch, least, top, small):
    if small:  # several passes for the words, filters of few phrases, and more shards
        monkeypatch.setattr(collocations, "DICTIONARY_BYTES", 300)
        monkeypatch.setattr(collocations, "HELD", 500)
        monkeypatch.setattr(collocations, "SHARD", 20)
    rows = corpus(4) + [(0, "alpha beta gamma delta. " * 40, "fr", "a"), (1, "x " * 3000, "fr", "b")]
    got = sorted(tuple(r) for r in collocations.phrases(cluttered(spark.createDataFrame(rows, DOCS)), least, top).collect())
    assert got == brute_phrases(rows, least, top)


@pytest.mark.parametrize("bits", [16, 34, 68, 96, 128])
def test_filters_lose_nothing(bits):
    rng, half = np.random.default_rng(bits), bits // 2
    left, right = (rng.integers(0, 1 << min(half, 63), 5_000, dtype=np.uint64) & np.uint64((1 << half) - 1) for _ in "lr")
    left[::3], right[::3] = left[0], right[0]
    permutation = collocations.Permutation(bits)
    there = permutation.forward(left, right)
    assert all((a == b).all() for a, b in zip(permutation.back(*there), (left, right)))
    assert len(set(zip(*(x.tolist() for x in there)))) == len(set(zip(left.tolist(), right.tolist())))
    one, two, counts = collocations.counted(*there, half)
    shard_bits, found = min(half, 3), []
    shard = (one >> np.uint64(half - shard_bits)).astype(np.int64)
    for s in np.unique(shard):
        at = shard == s
        found.append(collocations.entries(collocations.filter_of(one[at], two[at], counts[at], half, int(s), shard_bits)))
    assert all((np.concatenate([f[k] for f in found]) == x).all() for k, x in enumerate((one, two, counts)))
    # Merging two filters adds up what both have.
    twice = collocations.counted(np.concatenate([one, one]), np.concatenate([two, two]), half, np.concatenate([counts, counts]))
    assert (twice[0] == one).all() and (twice[2] == 2 * counts).all()


@pytest.mark.parametrize("m", [2, 3, 4])
@pytest.mark.parametrize("bits", [8, 18, 32])
def test_packing_is_invertible(m, bits):
    parts = [np.random.default_rng(k).integers(0, 1 << bits, 100, dtype=np.int64) for k in range(m)]
    left, right = collocations.packed(parts, bits)
    assert max(int(left.max()), int(right.max())) < 1 << (m * bits // 2)
    assert all((a == b.astype(np.int64)).all() for a, b in zip(parts, collocations.unpacked(left, right, m, bits)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.taken(docs).count() == mixing.mixed(docs).count() == 0
    assert divergence.divergence(docs).count() == 0
    assert collocations.phrases(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], DOCS)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.taken(nothing).collect()] == [(0, 0.0, 0)] * 2
    assert divergence.divergence(nothing).count() == collocations.phrases(nothing).count() == 0
