"""Surrogates for personal data.

Entities are found by pattern: mail addresses, IPv4 addresses, payment-card and phone
numbers, IBANs, social security numbers, MAC addresses, secrets after a telling word, and
names after a title (up to three words, with hyphens, particles and initials, which stay) and
other mentions of these names in the same document. Each gets a keyed replacement of its own type and format: digits for
digits, letters for letters of the same case and script, valid octets, a card's check digit,
names of the title's gender and the name's script, composed of syllables. Given names and
surnames are replaced each by itself, so that 'Dr Anna Fischer' and 'Frau Fischer' share one.

The same entity gets the same replacement everywhere, and different ones never share one:
over the table of distinct entities, replacements that another entity has, or that are
entities themselves, are drawn again until none is left. Few need that, so the second pass
over the texts computes replacements from the key, and knows the redrawn ones by broadcast
if they are few, else by a join on doc_id.

Defined results: a null text stays null, an empty one empty; repeated rows are treated
alike; other columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

KEY = "surrogates-1"

# fixed values: titles by gender, and what names are composed of by script
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Г-н"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"), "n": ("Dr", "Prof", "Mx")}
SYLLABLES = {
    "LATIN": [x + y for x in ("b", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "br", "dr", "kr", "st") for y in ("a", "e", "i", "o", "u", "al", "en", "ir", "or", "un")],
    "CYRILLIC": [x + y for x in "бвгдзклмнпрстф" for y in ("а", "е", "и", "о", "у", "ал", "ен", "ир", "ор", "ун")],
}
#: Endings of given names by gender, and of surnames, which have none.
ENDINGS = {
    ("LATIN", "m"): ("bert", "dus", "los", "ron"), ("LATIN", "f"): ("bella", "dina", "lia", "rina"), ("LATIN", "n"): ("bey", "dy", "ley", "ry"), ("LATIN", "last"): ("berg", "ders", "lund", "mont"),
    ("CYRILLIC", "m"): ("дий", "слав", "мир", "тин"), ("CYRILLIC", "f"): ("дина", "лия", "мила", "рина"), ("CYRILLIC", "n"): ("ня", "ша", "ля", "ся"), ("CYRILLIC", "last"): ("енко", "чук", "ших", "дзе"),
}
_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+"  # a name, or one part of a hyphenated one
_PARTICLES = r"(?:(?:van|von|der|den|de|del|la|le|du|da|di|dos|zu|ter|al)[ ])*"

_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
# in order: what an earlier pattern has found, a later one leaves alone
PATTERNS = (
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)\K[A-Za-z0-9_/+.-]{8,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
)
_FIND = [(kind, regex.compile(p)) for kind, p in PATTERNS]
_TITLE = r"(?:" + "|".join(sorted(_GENDER, key=len, reverse=True)) + r")"
_FULL = rf"{_WORD}(?:-{_WORD})*"
# up to three names after one or more titles; initials and particles between them
_NAMED = regex.compile(rf"(?<![\p{{L}}\p{{M}}-])(?P<titles>(?:{_TITLE}\b\.?[ ])+)(?P<name>(?:\p{{Lu}}\.[ ]?)*{_PARTICLES}(?!{_TITLE}\b){_FULL}(?:[ ](?:\p{{Lu}}\.[ ]?)*{_PARTICLES}(?!{_TITLE}\b){_FULL}){{0,2}})")
_PART = regex.compile(rf"(?<![\p{{L}}\p{{M}}]){_WORD}")
_GAP = regex.compile(rf"-|[ ](?:\p{{Lu}}\.[ ]?)*{_PARTICLES}")
_HINT = regex.compile(r"[@\d]|(?i:token|secret|password|passwd|key)|\b(?:" + "|".join(_GENDER) + r")\b")


def _plain(name: str) -> str:
    """A name's form for keys: first letter upper, others lower, so that 'JONES' is 'Jones'."""
    return name[:1].upper() + name[1:].lower()


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names after titles, by part, and every other mention of these parts in the text, with a genitive s too."""
    known: dict[str, str] = {}
    titled: dict[int, tuple[int, str]] = {}
    for m in _NAMED.finditer(text):
        genders = [_GENDER[t] for t in regex.findall(_TITLE, m["titles"])]
        given = f"given_{next((g for g in genders if g != 'n'), 'n')}"
        words = list(regex.finditer(_FULL, text, pos=m.start("name"), endpos=m.end("name")))
        for i, w in enumerate(words):
            kind = "last" if i == len(words) - 1 else given
            for part in regex.finditer(_WORD, text, pos=w.start(), endpos=w.end()):
                titled[part.start()] = (part.end(), kind)
                name = _plain(part[0])
                if name not in known or known[name] == "given_n":
                    known[name] = kind
    for m in _PART.finditer(text) if known else ():
        a, b = m.span()
        name = _plain(m[0])
        if a in titled:
            b, kind = titled[a]
            yield a, b, kind, _plain(text[a:b])
        elif name in known:
            yield a, b, known[name], name
        elif name.endswith("s") and name[:-1] in known:
            yield a, b - 1, known[name[:-1]], name[:-1]


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order, without overlaps; of names, each part is an entity, and its kind tells its gender."""
    if not _HINT.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    for kind, find in _FIND:
        for m in find.finditer(text):
            a, b = m.span()
            if all(b <= x or a >= y for x, y, *_ in out):
                out.append((a, b, kind, m[0]))
    taken = list(out)
    out += [n for n in _names(text) if all(n[1] <= x or n[0] >= y for x, y, *_ in taken)]
    return sorted(out)


def _mentions(text: str, hits: list[tuple[int, int, str, str]]) -> int:
    """Number of entities in the text; adjoining parts of names are one."""
    name = lambda h: h[2] == "last" or h[2].startswith("given")
    return len(hits) - sum(name(x) and name(y) and x[2] != "last" and bool(_GAP.fullmatch(text, x[1], y[0])) or (name(x) and name(y) and text[x[1] : y[0]] == "-") for x, y in zip(hits, hits[1:], strict=False))


def _draws(key: str, kind: str, entity: str, attempt: int) -> Callable[[int], int]:
    """Numbers below n, from the key, type, entity and attempt."""
    state = {"block": b"", "count": 0}

    def below(n: int) -> int:
        if len(state["block"]) < 4:
            text = f"{kind}|{entity}|{attempt}|{state['count']}"
            state["block"] = hmac.new(key.encode(), text.encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
            state["count"] += 1
        value, state["block"] = int.from_bytes(state["block"][:4]), state["block"][4:]
        return value % n

    return below


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    double = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits))]
    return -sum(d - 9 * (d > 9) for d in double) % 10


def _like(text: str, below: Callable[[int], int]) -> str:
    """Digits for digits and letters for letters of the same case and script; the rest as it is."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append(str(below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + below(26)))
        elif c.isalpha():
            script = unicodedata.name(c, "").split(" ")[0]
            near = [d for d in map(chr, range(max(0x80, ord(c) - 24), min(0x10FFFF, ord(c) + 25))) if d.isalpha() and d.isupper() == c.isupper() and unicodedata.name(d, "").split(" ")[0] == script]
            out.append(near[below(len(near))] if near else c)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, entity: str, attempt: int = 0, key: str = KEY) -> str:
    """The keyed replacement of an entity; never the entity itself where the format leaves a choice."""
    below = _draws(key, kind, entity, attempt)
    for _ in range(20):
        out = _one(kind, entity, below, attempt)
        if out != entity:
            break
    return out


def _one(kind: str, entity: str, below: Callable[[int], int], attempt: int) -> str:
    if kind == "ip":
        return ".".join(str(1 + below(254)) for _ in range(4))
    if kind == "mac":
        return "".join(c if c == ":" else ("0123456789ABCDEF" if entity.upper() == entity else "0123456789abcdef")[below(16)] for c in entity)
    if kind == "secret" and regex.fullmatch(r"[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[below(16)] for _ in entity)
    if kind == "email":
        name, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(name, below)}@{_like(host, below)}.{top}"
    if kind == "iban":
        return entity[:2] + _like(entity[2:], below)
    if kind == "card":
        digits = regex.sub(r"\D", "", entity)
        new = str(1 + below(9)) + "".join(str(below(10)) for _ in digits[1:])
        if _luhn(digits[:-1]) == int(digits[-1]):
            new = new[:-1] + str(_luhn(new[:-1]))
        left = iter(new)
        return "".join(next(left) if c.isdigit() else c for c in entity)
    if kind == "phone":
        country = regex.match(r"\+\d{1,3}(?=[ .(-])", entity)
        keep = country.end() if country else 0
        return entity[:keep] + _like(entity[keep:], below)
    if kind == "last" or kind.startswith("given"):
        script = unicodedata.name(entity[0], "").split(" ")[0]
        if script not in SYLLABLES:  # letters for letters, and more of them where a short form's are used up
            return _plain(_like(entity + entity[-1] * (attempt // 8), below))
        # two or three syllables before the ending: millions of names; more where they are taken
        parts, ends = SYLLABLES[script], ENDINGS[script, kind.removeprefix("given_")]
        return _plain("".join(parts[below(len(parts))] for _ in range(2 + below(2) + attempt // 4)) + ends[below(len(ends))])
    return _like(entity, below)


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, entity, times) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [(d, k, e) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for *_, k, e in found(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "kind", "entity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, entity string").groupBy("doc_id", "kind", "entity").agg(F.count("*").alias("times"))


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    """Rows (kind, entity, attempt) with their surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, e, n, key) for k, e, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    return rows.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, surrogate string")


def resolved(known: DataFrame) -> DataFrame:
    """(kind, entity, own): the kind that a name's surrogate is drawn for, so that 'Dr Anna' and 'Frau Anna' get the same.

    A given name that is met with titles of one gender, and perhaps neutral ones, has that
    gender; one that is met with both is neutral.
    """
    names = known.select("kind", "entity").distinct()
    has = lambda g: F.coalesce(F.bool_or(F.col("kind") == f"given_{g}"), F.lit(False))
    genders = names.where("kind like 'given%'").groupBy("entity").agg(has("m").alias("m"), has("f").alias("f"))
    genders = genders.select("entity", F.when(F.expr("m and not f"), "given_m").when(F.expr("f and not m"), "given_f").otherwise("given_n").alias("gendered"))
    return names.join(genders, "entity", "left").select("kind", "entity", F.when(F.col("kind").startswith("given"), F.col("gendered")).otherwise(F.col("kind")).alias("own"))


def assigned(known: DataFrame, key: str = KEY) -> DataFrame:
    """Surrogates (kind, entity, attempt, surrogate) of distinct entities, no two alike and none an entity."""
    names = stored(known.select("kind", "entity").distinct())
    held = stored(_drawn(names.withColumn("attempt", F.lit(0)), key))
    while True:
        turn = Window.partitionBy("surrogate").orderBy("attempt", "kind", "entity")
        ranked = held.withColumn("turn", F.row_number().over(turn)).join(names.select(F.col("entity").alias("surrogate"), F.lit(True).alias("taken")).distinct(), "surrogate", "left")
        bad = F.coalesce(F.col("taken"), F.lit(False)) | (F.col("turn") > 1)
        ranked = stored(ranked.select("kind", "entity", "attempt", "surrogate", bad.alias("bad")))
        again = ranked.where("bad")
        if again.isEmpty():
            return held
        held = stored(ranked.where("not bad").drop("bad").unionByName(_drawn(again.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), key)))


def _replaced(docs: DataFrame, key: str, redrawn: dict[tuple[str, str], tuple[str, int]] | None) -> DataFrame:
    """``docs`` with entities replaced, and their number as pii_entities; other kinds and attempts come by broadcast or in column pii_redrawn."""
    fields = [f for f in docs.schema if f.name != "pii_redrawn"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", pii_entities long"
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                own = part.column("pii_redrawn").to_pylist() if redrawn is None else None
                texts, counts = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    hits = found(text) if text else []
                    attempts = redrawn if own is None else {(r["kind"], r["entity"]): (r["own"], r["attempt"]) for r in own[i] or ()}
                    at, out = 0, []
                    for x, y, kind, entity in hits:
                        as_kind, attempt = attempts.get((kind, entity), (kind, 0))
                        new = surrogate(as_kind, entity, attempt, key)
                        named = kind == "last" or kind.startswith("given")
                        out += [text[at:x], new.upper() if named and text[x:y].isupper() else new]
                        at = y
                    texts.append("".join([*out, text[at:]]) if hits else text)
                    counts.append(_mentions(text, hits) if hits else 0)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names] + [pa.array(counts, pa.int64())], names=[*names, "pii_entities"])

    return docs.mapInArrow(run, schema)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with every entity replaced by its surrogate, and pii_entities, their number in the text."""
    docs = docs.select(*[c for c in docs.columns if not c.startswith("pii_")])
    known = stored(entities(docs))
    kinds = stored(resolved(known))
    drawn = assigned(kinds.select(F.col("own").alias("kind"), "entity"), key).select(F.col("kind").alias("own"), "entity", "attempt")
    redrawn = kinds.join(drawn, ["own", "entity"]).where("attempt > 0 or own <> kind").select("kind", "entity", "own", "attempt")
    few = redrawn.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        return _replaced(docs, key, {(r["kind"], r["entity"]): (r["own"], r["attempt"]) for r in few})
    own = known.join(redrawn, ["kind", "entity"]).groupBy(F.col("doc_id").alias("pii_doc")).agg(F.collect_list(F.struct("kind", "entity", "own", "attempt")).alias("pii_redrawn"))
    return _replaced(docs.join(own, docs["doc_id"].eqNullSafe(own["pii_doc"]), "left").drop("pii_doc"), key, None)
