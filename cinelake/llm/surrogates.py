"""Surrogates for personal data: keyed, type-consistent replacements.

A detected value is replaced by a value of its own format under a keyed cipher: letters and digits are
enciphered among the letters and digits of their class (digits, vowels and consonants of three scripts;
all other letters and marks within their Unicode script, category and case), separators stay, case is put back, and
what a type checks (an octet of an address, the check digit of a card, the check digits of an account number) holds
after as before.  Given names are replaced within the list of their gender and script, by another one; titles stay.

Mentions of one value corefer: a number is enciphered by its digits alone, whatever parts them, an account number
without its blanks, a mailbox in small letters, and each word of a name by itself, in small letters and whatever its
title, so that "Mrs Anna Smith", "Anna Smith" and "DR SMITH" share their words.  A cipher is a bijection, so
different values of a format stay different and equal ones stay equal, in every document and task, without a table
of values.

Collisions are checked all the same, over the distinct values of the whole corpus: a surrogate may be
another value of the corpus, or meet one that was drawn again.  Such values are drawn again under the
next tweak until none is left; only they travel to their texts in a join.  A format may have too few
free values, so mailboxes and words of names grow by a letter with every draw after the first, and the
other kinds by digits after ``NARROW_DRAWS`` draws (an address then becomes one of the range that is
reserved for documentation): a free value always exists.

Names are found behind a title (in title case or capitals), or as a listed given name before a capitalised word, with
apostrophes, hyphens and small words within (a possessive is no part of a name); other names are not found.  Given names
move along their list in an order of the key.

Defined results: null and empty texts stay as they are; very long texts are searched whole; an empty table gives no
rows; rows without an id are replaced like any other; repeated rows get equal surrogates; of values whose surrogates
tie, the one of the earlier draw, then the smaller, keeps it; columns whose names begin with two underscores are
renamed.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import plain_columns, table, written

#: The key of the query over test data; ``replace`` has no key of its own.
TEST_KEY = b"a key for tests only"
ROUNDS = 8
#: Draws within the format of a kind of fixed width, before the format is widened.
NARROW_DRAWS = 16

# Given names by script and gender, and the words that announce a name and its gender.
NAMES = {
    ("latin", "female"): "Mary Anna Emma Julia Laura Sofia Clara Alice Helen Maria Lucia Elena Marie Camille Ingrid Greta Carmen Nora Rosa Eva".split(),
    ("latin", "male"): "John Paul Peter Thomas David Lucas Martin Daniel Simon Carlos Miguel Jean Pierre Louis Hans Karl Jorge Pablo Oscar Adam".split(),
    ("cyrillic", "female"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Юлия Дарья Вера".split(),
    ("cyrillic", "male"): "Иван Пётр Сергей Андрей Михаил Николай Павел Дмитрий Олег Юрий".split(),
}
TITLES = "Mrs Ms Miss Mme Frau Sra Señora Madame Г-жа Mr M Herr Sr Señor Monsieur Г-н Dr Prof".split()
VOWELS = {"latin": "aeiou", "cyrillic": "аеёиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзйклмнпрстфхцчшщъь", "greek": "βγδζθκλμνξπρστφχψ"}

#: Marks and joiners that go on with a word (accents, vowel signs), as a set of a regex.
MARKS = "\u200c\u200d" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c) in ("Mn", "Mc"))
LETTER = rf"(?:[^\W\d_]|[{MARKS}])"

def any_of(words: Iterable[str]) -> str:
    """A regex of some words, longer ones first."""
    return "(?:" + "|".join(sorted(words, key=lambda t: (-len(t), t))) + ")"


#: Titles, titles in capitals, listed given names in either form, a capitalised word and a word in capitals, as regexes.
TITLE, LOUD_TITLE = any_of(TITLES), any_of(t.upper() for t in TITLES if len(t) > 1)
GIVEN = any_of(f(n) for names in NAMES.values() for n in names for f in (str, str.upper))
#: What goes on with a word of a name: letters, and apostrophes and hyphens before a letter, but for a possessive.
INNER = rf"(?:{LETTER}|['’](?!s(?!{LETTER}))(?={LETTER})|-(?={LETTER}))"
CAPITAL = rf"[^\W\d_a-zа-яё]{INNER}+"
LOUD_LETTER = r"[^\W\d_a-zà-öø-ÿа-яёα-ω]"
LOUD = rf"{LOUD_LETTER}(?:{LOUD_LETTER}|['’-](?={LOUD_LETTER}))+"
#: Small words within surnames; they tell no one apart and stay.
PARTICLES = "van von der den dem de del della di da do dos das du la le las los ten ter te zu zur zum af av bin ibn al el y".split()
SMALL = rf"(?:{any_of(PARTICLES)} )*"

KINDS = ("email", "iban", "ssn", "card", "ip", "phone", "name")
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<=SSN )\d{9}(?!\w)|(?<=SSN: )\d{9}(?!\w))"
    r"|(?P<card>(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w))"
    rf"|(?P<name>(?<!\w)(?:(?:{TITLE}\.? )+(?:{SMALL}{CAPITAL}|[^\W\d_]{INNER}*)(?:[ -]{SMALL}{CAPITAL}){{0,2}}"
    rf"|(?:{LOUD_TITLE}\.? )+{LOUD}(?:[ -]{LOUD}){{0,2}}|{GIVEN}(?:[ -]{SMALL}{CAPITAL}){{1,2}})(?!{LETTER}))"
)
HINT = re.compile(rf"[0-9@]|(?<!\w)(?:(?:{TITLE}|{LOUD_TITLE})\.? |{GIVEN}[ -])")
TITLED = re.compile(rf"(?:(?:{TITLE}|{LOUD_TITLE})\.? )*")


def script_of(letter: str) -> str:
    return "cyrillic" if "Ѐ" <= letter <= "ӿ" else "greek" if "Ͱ" <= letter <= "Ͽ" else "latin"


def cased(c: str) -> bool:
    """Whether a letter comes back when its case is changed twice."""
    low, up = c.lower(), c.upper()
    return low != up and len(low) == len(up) == 1 and low.upper() == up and up.lower() == low


@lru_cache(1)
def classes() -> tuple[dict[str, tuple[str, int]], list[str]]:
    """The class and place of every letter, mark and digit, and the classes.

    A class has one script (the first word of the character's Unicode name), category and kind of case, and
    letters with accents apart from others.  Latin letters of common use (up to U+017F) are classes of their own.
    Classes of few characters are merged over their scripts.
    """
    basic = [*VOWELS.values(), *CONSONANTS.values(), "0123456789"]
    done = set("".join(basic))
    groups: dict[tuple, list[str]] = defaultdict(list)
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        category = unicodedata.category(c)
        if category[0] not in "LMN" or category in ("Nl", "No", "Me") or c in done:
            continue
        pair = category[0] == "L" and cased(c)
        if pair and c != c.lower():  # stands in the class of its small letter
            continue
        composed = bool(unicodedata.decomposition(c)) and category[0] == "L"
        script = unicodedata.name(c, "?").split()[0]
        usual = script == "LATIN" and c < "\u0180" and category in ("Ll", "Lu")
        groups["usual" if usual else script, category, pair, composed and not usual].append(c)
    merged: dict[tuple, list[str]] = defaultdict(list)
    for key, members in groups.items():
        merged[key if len(members) >= 8 or key[0] == "usual" else key[1:3]] += members
    every = basic + ["".join(x) for x in merged.values()]
    return {c: (a, i) for a in every for i, c in enumerate(a)}, every


def stream(key: bytes, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=key[:64], digest_size=32).digest(), "big")


def permuted(digits: list[int], radices: list[int], key: bytes, *tweak: object) -> list[int]:
    """A keyed bijection of mixed-radix numbers: halves take turns in adding a keyed function of the other."""
    half = len(digits) // 2
    out = list(digits)
    sides = (range(half), range(half, len(digits)))
    for r in range(ROUNDS):
        mine, other = sides[r % 2], sides[1 - r % 2]
        added = stream(key, tweak, radices, r, [out[i] for i in other])
        for i in mine:
            added, part = divmod(added, radices[i])
            out[i] = (out[i] + part) % radices[i]
            added = stream(key, added) if added < radices[i] else added
    return out


def enciphered(text: str, key: bytes, *tweak: object) -> str:
    """``text`` with its letters and digits enciphered within their classes; the rest stays as it is."""
    of = classes()[0]
    placed = [of.get(c.lower() if cased(c) else c) for c in text]
    places = [i for i, x in enumerate(placed) if x]
    digits = [placed[i][1] for i in places]
    # Classes of one size are told apart by their first characters.
    shape = "".join(c if not x else f"{x[0][0]}{len(x[0])}," for c, x in zip(text, placed))
    new = permuted(digits, [len(placed[i][0]) for i in places], key, shape, *tweak)
    out = list(text)
    for i, d in zip(places, new):
        c = placed[i][0][d]
        out[i] = c.upper() if text[i].isupper() and cased(c) else c
    return "".join(out)


def luhn(digits: list[int]) -> int:
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10


def listed(token: str) -> tuple[str, str] | None:
    """The list of given names that holds a word of a name."""
    return next((k for k, names in NAMES.items() if token.capitalize() in names), None)


def name_token(token: str, key: bytes, draw: int) -> str:
    """The replacement of a word of a name; no given name of a list comes from a word outside it."""
    own = listed(token)
    if own:
        # One round trip through the list in an order of the key: none stays, and a known pair tells of no other.
        names = sorted(NAMES[own], key=lambda n: stream(key, own, n))
        new = names[(names.index(token.capitalize()) + 1) % len(names)]
        return new.lower() if token.islower() else new
    out = enciphered(widened(token, draw), key, "name", draw)
    for _ in range(8):
        if not listed(out):
            break
        out = enciphered(out, key, "name", draw)
    return out


def mentions(value: str) -> list[tuple[str, str]]:
    """The parts of a name with its titles: (text, "") of what stays, (word, "token") of what is replaced."""
    title = TITLED.match(value)[0]
    parts = re.split(r"([ -])", value[len(title) :])
    stays = lambda i, p: i % 2 or p in PARTICLES and i + 1 < len(parts)
    return [(title, ""), *((p, "" if stays(i, p) else "token") for i, p in enumerate(parts) if p)]


def residue(iban: str) -> int:
    """What an account number leaves modulo 97; 1 if it is valid."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def widened(text: str, draw: int) -> str:
    """``text`` and ``draw`` more letters or digits of the class of its last one (of no such one: vowels)."""
    last = next((c for c in reversed(text) if c.isalnum() and c.lower() in classes()[0]), "a")
    return text + last.lower() * draw


def surrogate(kind: str, value: str, key: bytes, draw: int = 0) -> str:
    """The replacement of a mention under the ``draw``-th tweak."""
    parts = mentions(value) if kind == "name" else [(value, kind)]
    return "".join(formatted(k, v, ciphered(k, normal(k, v), key, draw)) if k else v for v, k in parts)


def ciphered(kind: str, value: str, key: bytes, draw: int) -> str:
    """The replacement of a value in its normal form."""
    tweak = (kind, draw)
    wide = max(0, draw - NARROW_DRAWS + 1)
    if wide and kind == "ip":
        octets = [int(x) for x in value.split(".")]
        groups = permuted([*octets, *[0] * 8], [256] * 4 + [256] * 8, key, *tweak)
        return "2001:db8:" + ":".join(f"{a:02x}{b:02x}" for a, b in zip(groups[::2], groups[1::2]))
    if wide and kind in ("card", "iban", "ssn", "phone"):
        value += "0" * wide
    if kind == "card":
        digits = [int(c) for c in value if c.isdigit()]
        body = permuted(digits[:-1], [10] * (len(digits) - 1), key, len(digits), *tweak)
        # The last digit keeps the remainder of the check sum, so valid numbers stay valid.
        last = (luhn(digits) - luhn([*body, 0])) % 10
        return "".join(map(str, [*body, last]))
    if kind == "ip":
        octets = permuted([int(x) for x in value.split(".")], [256] * 4, key, *tweak)
        return ".".join(map(str, octets))
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=\D)", value)
        at = head.end() if head else 0
        return value[:at] + enciphered(value[at:], key, value[:at], *tweak)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, dot, rest = domain.partition(".")
        # The registered domain stays; mailbox and host are enciphered together.
        if dot and "." in rest:
            return enciphered(f"{widened(local, draw)}@{host}", key, rest.lower(), *tweak) + dot + rest
        return enciphered(widened(local, draw), key, domain.lower(), *tweak) + "@" + domain
    if kind == "iban":
        new = enciphered(value[4:], key, value[:2], *tweak)
        # Check digits that leave the remainder as it was, from 02 to 98.
        check = (residue(value) - residue(f"{value[:2]}00{new}")) % 97
        return f"{value[:2]}{check + 97 * (check < 2):02d}{new}"
    if kind == "token":
        return name_token(value, key, draw)
    return enciphered(value, key, *tweak)


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same value: without separators and case."""
    if kind in ("email", "token"):
        return unicodedata.normalize("NFC", value).lower()
    if kind in ("card", "ssn"):
        return "".join(c for c in value if c.isdigit())
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=\D)", value)
        digits = "".join(c for c in value[head.end() if head else 0 :] if c.isdigit())
        return f"{head[0]} {digits}" if head else digits
    return value.replace(" ", "") if kind == "iban" else value


def recased(value: str, new: str) -> str:
    """``new`` with the capitals of ``value``, from the start of the mailbox and of the domain, which may be longer."""
    sides = zip(value.split("@"), new.split("@"))
    return "@".join("".join(b.upper() if a.isupper() else b for a, b in zip_longest(x, y, fillvalue="")) for x, y in sides)


def formatted(kind: str, value: str, new: str) -> str:
    """A surrogate of the normal form, in the form of the mention: case and separators put back, and the rest at the end."""
    if kind == "email":
        return recased(value, new)
    if kind == "token":
        if len(value) > 1 and value.isupper():
            return new.upper()
        return "".join(b.upper() if a.isupper() and cased(b) else b for a, b in zip_longest(value, new, fillvalue=""))
    if kind not in ("card", "ssn", "phone", "iban"):
        return new
    it = iter(new.replace(" ", "").replace("+", ""))
    return "".join(next(it) if c.isalnum() else c for c in value) + "".join(it)


def checked(kind: str, value: str) -> list[tuple[str, str]]:
    """(kind, normal form) of what a mention is looked up by: itself, or the words of a name."""
    if kind == "name":
        return [(k, normal(k, v)) for v, k in mentions(value) if k]
    return [(kind, normal(kind, value))]


def found(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the personal data of a text, leftmost first."""
    if HINT.search(text):
        for m in PATTERN.finditer(text):
            if m.lastgroup == "card" and not 12 <= sum(c.isdigit() for c in m[0]) <= 19:
                continue
            yield m.start(), m.end(), m.lastgroup, m[0]


def values(docs: DataFrame) -> DataFrame:
    """(tie, kind, value): the distinct values of each text, by its hash; the words of names are of kind ``token``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = set()
                for tie, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        rows |= {(tie, *x) for _, _, kind, value in found(text) for x in checked(kind, value)}
                columns = list(zip(*rows)) or [(), (), ()]
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tie", "kind", "value"])

    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, "tie long, kind string, value string")


def drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, draw) with the surrogate of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out = [ciphered(k, v, key, d) for k, v, d in zip(rows["kind"], rows["value"], rows["draw"])]
            names = ["kind", "value", "draw", "surrogate"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return entities.select("kind", "value", "draw").mapInArrow(
        run, "kind string, value string, draw int, surrogate string"
    )


def redrawn(seen: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, value, draw) of the values whose first surrogate collides, with the draw that does not.

    A surrogate must be no value of the corpus of its kind, its own value included (listed given names are
    exempt: a list is replaced within itself), and no two values may share one; of those that would, the smallest keeps it.
    """
    originals = written(seen.select("kind", "value").distinct())
    current = written(drawn(originals.withColumn("draw", F.lit(0)), key))
    moved = False
    given = [name.lower() for names in NAMES.values() for name in names]
    for draw in count(1):
        real = originals.where((F.col("kind") != "token") | ~F.col("value").isin(given)).select("kind", F.col("value").alias("surrogate"))
        taken = current.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value")
        shared = (
            current.groupBy("kind", "surrogate")
            .agg(F.min(F.struct("draw", "value")).alias("keeps"), F.count("*").alias("n"))
            .where(F.col("n") > 1)
        )
        twice = (
            current.join(shared, ["kind", "surrogate"])
            .where(F.struct("draw", "value") != F.col("keeps"))
            .select("kind", "value")
        )
        again = written(taken.union(twice).distinct())
        if again.isEmpty():
            return current.where(F.col("draw") > 0).select("kind", "value", "draw") if moved else None
        moved = True
        current = written(
            current.join(again, ["kind", "value"], "left_anti").unionByName(
                drawn(again.withColumn("draw", F.lit(draw)), key)
            )
        )


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in the texts, and ``__found`` (kind, and start and end in the old text)."""
    docs = plain_columns(docs)
    seen = written(values(docs))
    moved = redrawn(seen, key)
    source = docs.withColumn("__draws", F.lit(None).cast("array<struct<kind:string,value:string,draw:int>>"))
    if moved is not None:
        of = (
            seen.join(moved, ["kind", "value"])
            .groupBy("tie")
            .agg(F.collect_set(F.struct("kind", "value", "draw")).alias("__draws"))
            .withColumnRenamed("tie", "__tie")
        )
        source = docs.join(of, F.xxhash64(F.col("text").cast("string")) == F.col("__tie"), "left").drop("__tie")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(100_000)(lambda kind, value, draw: ciphered(kind, value, key, draw))
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts, spans = [], []
                for text, draws in zip(part.column("text").to_pylist(), part.column("__draws").to_pylist()):
                    draw = {(x["kind"], x["value"]): x["draw"] for x in draws or ()}
                    out, at, spans_of = [], 0, []
                    for start, end, kind, value in found(text) if text else ():
                        new = ""
                        for word, what in mentions(value) if kind == "name" else [(value, kind)]:
                            own = normal(what, word)
                            new += formatted(what, word, cached(what, own, draw.get((what, own), 0))) if what else word
                        out += [text[at:start], new]
                        at = end
                        spans_of.append({"kind": kind, "start": start, "end": end})
                    texts.append("".join([*out, text[at:]]) if spans_of else text)
                    spans.append(spans_of)
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(span))], [*names, "__found"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return source.mapInArrow(run, f"{schema}, `__found` array<struct<kind:string,start:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)

    def of(kind: str):
        return F.size(F.filter("__found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return replaced.select("doc_id", *map(of, KINDS), "text")
