"""Fill-in-middle against a plain version, and its list of token ends against the numbers in it."""

import hashlib
import random
import re

import numpy as np

from riftline.llm import fill_middle


def plain(doc, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(w)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_lists_of_ascending_numbers():
    rng = np.random.default_rng(3)
    for x in ([], [0], [1], [7], range(1, 300), [1, 10**9], np.cumsum(rng.integers(1, 40, 5000)), np.unique(rng.integers(0, 10**6, 900))):
        x = np.array(x, np.int64)
        packed = fill_middle.packed_list(x)
        assert [fill_middle.listed(packed, i) for i in range(len(x))] == x.tolist()
    assert len(fill_middle.packed_list(np.cumsum(rng.integers(1, 6, 10_000)))) < 10_000 * 4.2 / 8


def test_ends_are_those_of_the_tokens():
    for t in ("", "a", " ", "ab1c", "é́x\U0001f600yz\r\n\x00", "Zz{[@`", "ſK abc"):
        want = np.cumsum([len(x) for x in re.findall(r"[A-Za-z]+|[^A-Za-z]", t)]).astype(int).tolist()
        assert fill_middle.token_ends(t).tolist() == want


def test_cuts(spark, monkeypatch):
    rng = random.Random(2)
    pool = ["", "<", "a<P", "one two  three", "é\U0001f600 x\ny\x00", "has <M> in it", "word " * 30_000, "<<S", "P>"]
    rows = [(i, rng.choice(pool), 1, "k", 2) for i in range(150)] + [(i, "hot copy, many times", 1, "k", 2) for i in range(150, 400)]
    rows += [(None, "no id", 1, "k", 2), (900, None, 1, "k", 2), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, key string, n long")
    want = sorted((str(r[0]), *map(str, plain(r[0], r[1]))) for r in rows)
    for copies in (fill_middle.COPIES, 3):
        monkeypatch.setattr(fill_middle, "COPIES", copies)
        got = fill_middle.transformed(df)
        assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got.collect()) == want
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = fill_middle.digests(df).collect()
    assert sorted((str(r.doc_id), r.restored_sha256) for r in got) == sorted((str(r[0]), sha(r[1])) for r in rows)
    assert fill_middle.digests(df.limit(0)).count() == 0


def test_index_has_each_text_once(spark):
    df = spark.createDataFrame([(i, bytes([i % 2]), 0, f"text {i % 3}") for i in range(30)], "doc_id long, key binary, part int, text string")
    got = fill_middle.index(df).collect()  # keys that meet by chance don't join texts
    assert sorted((r.text, bytes(r.key), r.n, sorted(d.doc_id for d in r.docs), [fill_middle.listed(bytes(r.ends), i) for i in range(r.n)]) for r in got) == sorted(
        (f"text {i}", bytes([k]), 3, [d for d in range(30) if d % 3 == i and d % 2 == k], [4, 5, 6]) for i in range(3) for k in range(2))
