"""Collocations against counting, with shards of all sizes, odd rows and very frequent words."""

import random
import re
from collections import Counter

import pytest

from riftline.llm import phrases


def brute(rows, most):
    out, counts, n = [], {}, Counter()
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        found = []
        for p, a in cand.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 50 * a and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)] for q, b in cand.items()):
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "The", "a", "of", "new", "york", "city", "é\U0001f600", "x\x00y", *(f"w{i}" for i in range(30))]
    weight = [9, 4, 6, 5, 2, 2, 2, 1, 1, *[0.5] * 30]
    text = lambda n: "".join(rng.choices(words, weight)[0] + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\v", "!?"]) for _ in range(n))
    out = [(rng.choice(["en", "en", "en", None, "und", "fr"]), text(rng.randrange(60))) for _ in range(150)]
    return [*out, ("en", None), ("en", ""), ("en", " ,. "), ("xx", "rare"), ("en", "new york city " * 3000), ("de", "to be or not, " * 12), out[5], out[5], ("en", text(5000))]


@pytest.mark.parametrize("sizes", [{}, {"shard": 100, "dense": 4}, {"shard": 1000, "dense": 16, "most": 7}, {"shard": 64, "dense": 64}])
def test_phrases(spark, rows, sizes):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "lang string, text string, phrase string, a int").repartition(3)
    got = phrases.collocations(docs, **sizes)
    assert sorted(map(tuple, got.collect())) == brute(rows, sizes.get("most", phrases.MOST))
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_full_maps_let_through_but_do_not_lose(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", (64, 64))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(rows, phrases.MOST)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    a, l, r = 10**14 + 7, 10**14 + 9, 3 * 10**14 + 11  # noqa: E741
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases.score().alias("score")).first().score
    assert got == 1000000 * a * a // (l * r)
