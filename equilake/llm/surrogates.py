"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Detected: e-mail addresses, IBANs (valid check digits), payment cards (13 to 19 digits, valid check digit), IPv4 addresses, telephone
numbers (with a country code, or with separators), social security numbers, and names after a title. An entity is its kind and its
canonical form (case, separators and layout taken away), so every mention of it in the corpus gets the same surrogate, poured into the
layout of the mention.

A surrogate is a keyed permutation of the numbers or letters the entity is made of: a Feistel network over the mixed-radix number
of its free characters, walked until the result is in range. Letters keep their case and alphabet, digits stay digits; a card keeps its
first digit and its check stays valid, an IBAN its country and valid check digits, an address its class, a telephone number its country code. A given name begins with a stem by
gender and alphabet (from the title), on later attempts lengthened by syllables; a family name is made of syllables of its alphabet.
A family name that follows a title is found in the rest of its text without one too.

Collision check: all distinct entities of the corpus get a surrogate by (key, kind, canonical, attempt 0). Of the entities of a kind that share one the least keeps it,
unless it is an entity that occurs or is kept already; the others, and only they, go on to the next attempt. So distinct entities stay distinct.

Only rows with an entity are stored, joined and rewritten; other rows pass through the scan unchanged.

Defined cases: null and empty texts pass unchanged. Repeated rows are kept. If a column n_chars exists it is set to the new length of
changed rows. Rows are told apart by their stored position, so null or repeated ids do no harm. Overlapping finds: the kind listed first wins.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from equilake.llm import text as T
from equilake.session import store

KEY = b"equilake surrogates"
MOST_ATTEMPTS = 200
#: Characters of a family name that is looked for without its title.
LEAST_NAME = 3

# Titles by gender, given names by gender and alphabet, syllables by alphabet.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа"],
    "n": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("n", "latin"): ["Alex", "Andrea", "Charlie", "Dominique", "Eden", "Jamie", "Kim", "Kerry", "Lee", "Luca", "Morgan", "Noel", "Robin", "Sam", "Sasha", "Toni"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша", "Тоня", "Юля"],
}
SYLLABLES = {"latin": ["ba", "be", "do", "fa", "ga", "ha", "jo", "ka", "la", "li", "ma", "mo", "na", "ra", "so", "ta"], "cyrillic": ["ба", "ве", "го", "да", "же", "за", "ки", "ла", "ми", "но", "па", "ро", "са", "та", "фи", "ха"]}

_NAME = r"[^\W\d_a-zà-öø-ÿа-я][^\W\d_]*(?:['’-][^\W\d_]+)*"
_PATTERNS = [
    ("email", re.compile(r"[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")),
    ("card", re.compile(r"(?<![\w+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
    ("name", re.compile(rf"(?<!\w)({'|'.join(t for v in TITLES.values() for t in v)})\.? ({_NAME}(?: {_NAME})?)")),
]
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_TITLE_PARTS = sorted({t for v in TITLES.values() for t in v}, key=len)
_TITLE_BYTES = [t.encode() for t in _TITLE_PARTS]
_FLAG = np.zeros(256, dtype=bool)
_FLAG[48:58] = True
_FLAG[ord("@")] = True


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of the entities of a text, in order and without overlap."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    digits = any(c in text for c in "0123456789")
    for kind, pattern in _PATTERNS:
        if kind == "email":
            if "@" not in text:
                continue
        elif kind == "name":
            if not any(t in text for t in _TITLE_PARTS):
                continue
        elif not digits:
            continue
        for m in pattern.finditer(text):
            for start, end, name, canonical in _entities(kind, m):
                if all(end <= s or e <= start for s, e, *_ in found):
                    found.append((start, end, name, canonical))
    # The same family names without a title, in the spelling seen after one.
    for name in sorted({text[s:e] for s, e, kind, _ in found if kind == "family" and e - s >= LEAST_NAME}):
        for m in re.finditer(rf"(?<![\w'’-]){re.escape(name)}(?![\w’-])", text):
            if all(m.end() <= s or e <= m.start() for s, e, *_ in found):
                found.append((m.start(), m.end(), "family", name.lower()))
    return sorted(found)


def _entities(kind: str, m: re.Match) -> Iterator[tuple[int, int, str, str]]:
    start, end, whole = m.start(), m.end(), m.group()
    if kind == "email":
        lead = len(whole) - len(whole.lstrip(".-%+"))
        yield start + lead, end, kind, whole[lead:].lower()
    elif kind == "iban":
        plain = whole.replace(" ", "")
        if 15 <= len(plain) <= 34 and int(plain[2:4]) == 98 - _iban_rest(plain[:2], plain[4:]):
            yield start, end, kind, plain
    elif kind == "ip":
        if all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in whole.split(".")):
            yield start, end, kind, whole
    elif kind == "card":
        plain = re.sub(r"\D", "", whole)
        if luhn(plain[:-1]) == int(plain[-1]) and len(set(plain)) > 1:
            yield start, end, kind, plain
    elif kind == "ssn":
        yield start, end, kind, whole.replace("-", "")
    elif kind == "phone":
        plain = re.sub(r"\D", "", whole)
        if 8 <= len(plain) <= 15:
            yield start, end, kind, ("+" if whole[0] == "+" else "") + plain
    else:
        at, parts = m.start(2), m.group(2).split(" ")
        for i, part in enumerate(parts):
            given = i == 0 and len(parts) > 1
            yield at, at + len(part), f"given_{_GENDER[m.group(1)]}" if given else "family", part.lower()
            at += len(part) + 1


# -- keyed permutations ----------------------------------------------------------------------------------------------

def permute(x: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    low = (1 << half) - 1
    while True:
        left, right = x >> half, x & low
        for i in range(8):
            word = hmac.new(key, f"{label}|{size}|{i}|{right}".encode(), hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(word, "big") & low)
        x = left << half | right
        if x < size:
            return x


# Runs of code points that are permuted among themselves.
_ALPHABETS = [(48, 57), (97, 122), (65, 90), (0xE0, 0xF6), (0xC0, 0xD6), (0xF8, 0xFF), (0xD8, 0xDE), (0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x627, 0x64A), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def permute_text(text: str, key: bytes, label: str) -> str:
    """Permute the letters and digits of a text jointly, each inside its own alphabet; others stay."""
    runs = [next(((a, b) for a, b in _ALPHABETS if a <= ord(c) <= b), None) for c in text]
    x, size = 0, 1
    for c, run in zip(text, runs, strict=True):
        if run:
            x, size = x * (run[1] - run[0] + 1) + ord(c) - run[0], size * (run[1] - run[0] + 1)
    x = permute(x, size, key, label + "|" + "".join("." if r is None else chr(65 + _ALPHABETS.index(r)) for r in runs))
    out = []
    for c, run in zip(reversed(text), reversed(runs), strict=True):
        if run:
            x, d = divmod(x, run[1] - run[0] + 1)
            c = chr(run[0] + d)
        out.append(c)
    return "".join(reversed(out))


def _script(text: str) -> str:
    return "cyrillic" if any(0x400 <= ord(c) <= 0x4FF for c in text) else "latin"


def _pick(key: bytes, label: str, n: int) -> list[int]:
    word = hmac.new(key, label.encode(), hashlib.sha256).digest()
    return [b % n for b in word]


# Ranges of special addresses by class; all other addresses are public. No class is so small that its surrogates run out.
_SPECIAL = {
    "this": ["0.0.0.0-0.255.255.255"], "loopback": ["127.0.0.0-127.255.255.255"], "multicast": ["224.0.0.0-239.255.255.255"],
    "reserved": ["169.254.0.0-169.254.255.255", "240.0.0.0-255.255.255.255"],
    "private": ["10.0.0.0-10.255.255.255", "172.16.0.0-172.31.255.255", "192.0.0.0-192.0.0.8", "192.0.0.11-192.0.0.255", "192.0.2.0-192.0.2.255", "192.168.0.0-192.168.255.255", "198.18.0.0-198.19.255.255",
                "198.51.100.0-198.51.100.255", "203.0.113.0-203.0.113.255"],
}


def _address_ranges() -> dict[str, list[tuple[int, int]]]:
    """First and last address of the ranges of each class; together they are all of IPv4."""
    out = {c: [tuple(int(ipaddress.IPv4Address(x)) for x in r.split("-")) for r in ranges] for c, ranges in _SPECIAL.items()}
    edges = [(-1, -1), *sorted(r for ranges in out.values() for r in ranges), (1 << 32, 1 << 32)]
    out["public"] = [(a[1] + 1, b[0] - 1) for a, b in zip(edges, edges[1:], strict=False) if a[1] + 1 < b[0]]
    return out


_ADDRESSES = _address_ranges()


def _address_class(x: int) -> str:
    return next(c for c, ranges in _ADDRESSES.items() if any(a <= x <= b for a, b in ranges))


def _permute_address(x: int, key: bytes, label: str) -> int:
    """A keyed permutation of the addresses of x's class, drawn among the class's own addresses."""
    name = _address_class(x)
    at, size = 0, 0
    for a, b in _ADDRESSES[name]:
        at += min(max(x - a, 0), b - a + 1)
        size += b - a + 1
    at = permute(at, size, key, f"{label}|{name}")
    for a, b in _ADDRESSES[name]:
        if at <= b - a:
            return a + at
        at -= b - a + 1
    raise AssertionError("outside the class")


def surrogate(kind: str, canonical: str, attempt: int, key: bytes = KEY) -> str:
    """The replacement of an entity, in canonical form."""
    label = f"{kind}|{attempt}"
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        host = "".join(chr(97 + k) for k in _pick(key, f"domain|{attempt}|{domain}", 26)[:6])
        return f"{permute_text(local, key, label + domain)}@{host}.example.{domain.rsplit('.', 1)[1] if domain.rsplit('.', 1)[1] in ('com', 'net', 'org') else 'com'}"
    if kind == "iban":
        body = permute_text(canonical[4:], key, label + canonical[:2])
        return f"{canonical[:2]}{98 - _iban_rest(canonical[:2], body):02d}{body}"
    if kind == "ip":
        return str(ipaddress.IPv4Address(_permute_address(int(ipaddress.IPv4Address(canonical)), key, label)))
    if kind == "card":
        body = canonical[0] + permute_text(canonical[1:-1], key, label + canonical[0])
        return body + str(luhn(body))
    if kind in ("ssn", "phone"):
        keep = (2 if canonical[1] in "17" else 3) if canonical[0] == "+" else 0
        body = canonical[keep:]
        out = permute_text(body, key, label + canonical[:keep])
        while (out[0] == "0") != (body[0] == "0"):
            out = permute_text(out, key, label + canonical[:keep])
        return canonical[:keep] + out
    script = _script(canonical)
    if kind.startswith("given_"):
        names = GIVEN[kind[-1], script]
        picks = _pick(key, f"{label}|{canonical}", len(names))
        ends = _pick(key, f"{label}|{canonical}|end", len(SYLLABLES[script]))
        return names[picks[0]].lower() + "".join(SYLLABLES[script][k] for k in ends[: min((attempt + 1) // 2, 20)])
    n = SYLLABLES[script]
    return "".join(n[k] for k in _pick(key, f"{label}|{canonical}", len(n))[: 4 + min(attempt, 20)])


def pour(kind: str, mention: str, canonical: str) -> str:
    """A canonical surrogate in the layout of a mention."""
    if kind in ("ssn", "phone", "card", "iban"):
        chars = iter(canonical.lstrip("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in mention)
    if kind == "email":
        return canonical.upper() if mention.isupper() else canonical
    if kind.startswith("given_") or kind == "family":
        if mention.isupper() and len(mention) > 1:
            return canonical.upper()
        return "-".join(p.capitalize() for p in canonical.split("-"))
    return canonical


# -- Spark -------------------------------------------------------------------------------------------------------------

_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string())]))
_SPAN_FIELD = "array<struct<start:int,end:int,kind:string,canonical:string>>"


def _finds(column: pa.Array) -> list[list[tuple[int, int, str, str]]]:
    """Finds for each text of a slice; texts without a digit, an at sign or a title are passed over by their bytes."""
    raw, offsets = T.byte_view(column)
    upto = np.concatenate(([0], np.cumsum(_FLAG[raw])))
    marked = upto[offsets[1:]] > upto[offsets[:-1]]
    data = raw.tobytes()
    titled = np.zeros(len(marked), dtype=bool)
    for title in _TITLE_BYTES:
        at = data.find(title)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            titled[row] = True
            at = data.find(title, max(at + 1, int(offsets[row + 1]) - len(title) + 1))
    return [find(column[i].as_py()) if m else [] for i, m in enumerate(marked | titled)]


def _with_entities(batches: Iterator[pa.RecordBatch], text: str, wanted: bool) -> Iterator[pa.RecordBatch]:
    """wanted: the rows that hold an entity, with their spans; else the other rows as they are."""
    for batch in batches:
        for first, last in T.slices(batch.column(text)):
            part = batch.slice(first, last - first)
            spans = _finds(part.column(text))
            keep = np.flatnonzero([bool(s) == wanted for s in spans])
            out = part.take(pa.array(keep))
            if wanted:
                lists = pa.array([[dict(zip(("start", "end", "kind", "canonical"), s, strict=True)) for s in spans[i]] for i in keep], type=_SPAN_TYPE)
                out = pa.RecordBatch.from_arrays([*out.columns, lists], names=[*out.schema.names, "__spans"])
            yield out


@F.pandas_udf(StringType())
def rewrite(text: pd.Series, edits: pd.Series) -> pd.Series:
    """Texts with their spans replaced; edits are (start, end, kind, surrogate)."""
    out = []
    for x, spans in zip(text, edits, strict=True):
        parts, at = [], 0
        for s in sorted(spans, key=lambda e: e["start"]):
            parts += [x[at : s["start"]], pour(s["kind"], x[s["start"] : s["end"]], s["surrogate"])]
            at = s["end"]
        out.append("".join([*parts, x[at:]]))
    return pd.Series(out, dtype=object)


def distinct_surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical) rows, without collisions inside a kind."""

    @F.pandas_udf("string")
    def draw(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, int(a), key) for k, c, a in zip(kind, canonical, attempt, strict=True)], dtype=object)

    # All kinds of given names share one space, so that two people's names stay apart.
    space = F.regexp_replace("kind", "^given_.$", "given")
    real = store(entities.select(space.alias("space"), F.col("canonical").alias("surrogate")).distinct(), "real_entities")
    moving, kept = entities.select("kind", "canonical"), []
    for attempt in range(MOST_ATTEMPTS):
        drawn = store(moving.withColumn("space", space).withColumn("surrogate", draw("kind", "canonical", F.lit(attempt))), "surrogates")
        # Only what could meet the newly drawn ones is compared with them.
        asked = drawn.select("space", "surrogate").distinct()
        taken = real.join(asked, ["space", "surrogate"], "left_semi")
        for part in kept:
            taken = taken.unionByName(part.select("space", "surrogate").join(asked, ["space", "surrogate"], "left_semi"))
        free = drawn.join(taken, ["space", "surrogate"], "left_anti")
        first = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canonical")).alias("first"))
        judged = drawn.join(first, ["space", "surrogate"], "left")
        judged = store(judged.select("space", "surrogate", "kind", "canonical", F.coalesce(F.col("first") == F.struct("kind", "canonical"), F.lit(False)).alias("keeps")), "surrogates")
        kept.append(judged.where("keeps"))
        moving = judged.where("not keeps").select("kind", "canonical")
        if moving.isEmpty():
            out = kept[0]
            for part in kept[1:]:
                out = out.unionByName(part)
            return out.select("kind", "canonical", "surrogate")
    raise RuntimeError("surrogates still collide; a kind has too few of them for its entities")


def replace_entities(docs: DataFrame, text: str = "text", key: bytes = KEY, count: str | None = None) -> DataFrame:
    """docs with surrogates in the text column. count: add the number of replaced mentions under this name."""
    columns = [c for c in docs.columns if c not in (count, "__spans", "__row", "__edits")]
    docs = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in columns])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found = docs.mapInArrow(lambda batches: _with_entities(batches, text, True), f"{fields}, __spans {_SPAN_FIELD}")
    found = store(found.withColumn("__row", F.monotonically_increasing_id()), "entity_rows")
    mentions = found.select("__row", F.explode("__spans").alias("s")).select("__row", "s.start", "s.end", "s.kind", "s.canonical")
    chosen = distinct_surrogates(mentions.select("kind", "canonical").distinct(), key)
    # A row's list is as long as its own mentions.
    edits = mentions.join(chosen, ["kind", "canonical"]).groupBy("__row").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("__edits"))
    changed = found.join(edits, "__row").withColumn(text, rewrite(F.col(f"`{text}`"), "__edits"))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.char_length(f"`{text}`").cast(docs.schema["n_chars"].dataType))
    numbers = [F.size("__edits").cast("bigint").alias(count)] if count else []
    untouched = docs.mapInArrow(lambda batches: _with_entities(batches, text, False), fields).select(*[F.col(f"`{c}`") for c in columns], *([F.lit(0).cast("bigint").alias(count)] if count else []))
    return untouched.union(changed.select(*[F.col(f"`{c}`") for c in columns], *numbers))
