"""Winnowing against every window of every text, on odd rows."""

import hashlib
import random
import re

import pytest

from riftline.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, run int, print string, prints_10 long"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    known = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if n else ():
            known.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit |= set(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((str(doc), len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    text = lambda n, v=40: " ".join(rng.choice("étude Ä wort_9 naïve x".split()) + str(rng.randrange(v)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((0, 1, 2, 3, 5, 9, 10, 11, 14, 30))]
    items += [(20, "the the the the the the the the the the the"), (21, items[9][1]), (3, text(12)), (None, text(10)), (30, None), (31, "?!")]
    docs = [(0, None), (1, ""), (2, "..."), (3, text(60, 9)), (4, "the " * 40), (5, text(20_000, 3)), (5, text(5)), (None, text(4))]
    for i, (_, t) in enumerate(items):
        t = t or ""
        docs += [(100 + i, f"{text(7)}; {t.upper() if i % 2 else t}! {text(7)}"), (200 + i, text(3) + " " + " ".join(t.split()[1:9])), (300 + i, t + " " + t)]
    docs += [docs[-1], docs[-2]]
    return docs, items


def test_every_shared_window_is_found(spark, tables):
    docs, items = tables
    rows = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate.checked(rows, bench)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(docs, items)


def test_long_items_alone_and_without_broadcast(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_PRINTS", 0)
    items = [i for i in items if len(words(i[1])) >= 10]
    got = decontaminate.checked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = (spark.createDataFrame(t, f"{n} long, text string") for t, n in zip(tables, ("doc_id", "item_id"), strict=True))
    assert decontaminate.checked(docs.limit(0), items).count() == 0
    assert not any(r.contaminated or r.n_hit or r.n_items for r in decontaminate.checked(docs, items.limit(0)).collect())
