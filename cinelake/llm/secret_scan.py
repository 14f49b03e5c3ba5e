"""Secret scans over a trigram inverted index, in DataFrame functions alone.

A Boolean query over folded trigrams is derived from each rule's regular expression: an alternation
gives OR, a sequence gives AND, and what has no mandatory trigram is left out.  The index has one row
for each (trigram, document); a rule's candidates are the documents whose postings satisfy its query.
Only candidates are verified with the regular expression itself; rules without mandatory trigrams
scan every document.

The index is restricted to the trigrams that the rules mention, so it holds a few rows a document.
``doc_id`` identifies a document in the postings; repeated rows share their postings and are verified
each, and rows without an id meet by null-safe comparison.

Defined results: a null or empty text has no spans; a very long text is searched whole; an empty table
gives an empty result; columns of ``docs`` whose names begin with two underscores are renamed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import let, plain_columns, table

#: At most so many alternatives are spelled out for one piece of a pattern.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; one counts if its ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules, in the order in which their kinds are listed.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")


# A query is None (any text), or a frozenset of alternatives, each a frozenset of trigrams that must all occur.
def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _spelled(nodes) -> list[set[str] | None]:
    """The pieces of a sequence: the strings that a piece can be, or None where they are too many or unbounded."""
    out: list[set[str] | None] = []
    for op, arg in nodes:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN and not any(o is sre.NEGATE or o is sre.CATEGORY for o, _ in arg):
            chars = set()
            for o, a in arg:
                chars |= {chr(a).lower()} if o is sre.LITERAL else {chr(c).lower() for c in range(a[0], a[1] + 1)}
            out.append(chars if len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            out += _spelled(arg[-1])
        elif op is sre.BRANCH:
            strings: set[str] | None = set()
            for branch in arg[1]:
                whole = _joined(_spelled(branch))
                strings = None if strings is None or whole is None else strings | whole
            out.append(strings)
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            once = _joined(_spelled(arg[2]))
            out.append(None if once is None else once | ({""} if arg[0] == 0 else set()))
        else:
            out.append(None)
    return out


def _joined(pieces: list[set[str] | None]) -> set[str] | None:
    if any(p is None for p in pieces):
        return None
    strings = {"".join(x) for x in product(*pieces)}
    return strings if len(strings) <= MAX_STRINGS else None


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Alternatives of mandatory folded trigrams, or None if the pattern has none.

    The pieces of the pattern are joined while what they spell stays small; each stretch of known
    pieces must occur, so its alternatives are combined with those of the other stretches.
    """
    stretches: list[set[str]] = []
    run: list[set[str]] = []
    for piece in [*_spelled(_parser.parse(pattern)), None]:
        strings = None if piece is None else _joined([*run, piece])
        if strings is not None:
            run = [strings]
            continue
        stretches += run
        run = [piece] if piece is not None else []
    query: set[frozenset[str]] | None = None
    for strings in stretches:
        alternatives = {_grams(s) for s in strings}
        if frozenset() in alternatives:
            continue
        query = alternatives if query is None else {a | b for a in query for b in alternatives}
    return None if query is None else frozenset(a for a in query if not any(b < a for b in query))


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings: one row (trigram, doc_id) for each of ``grams`` that the folded text holds."""
    folded = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = let(folded, lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules whose query a document's postings satisfy.

    The postings of a document meet as bits (62 trigrams a long, combined before the shuffle), so an
    intersection is one comparison.
    """
    grams = sorted({g for q in queries.values() for a in q for g in a})
    place = {g: divmod(k, 62) for k, g in enumerate(grams)}
    longs = range(-(-len(grams) // 62))

    def bits(some: list[str], long: int) -> int:
        return sum(1 << place[g][1] for g in some if place[g][0] == long)

    own = [
        F.coalesce(*(F.when(F.col("trigram") == g, F.lit(bits([g], n))) for g in grams if place[g][0] == n), F.lit(0))
        for n in longs
    ]
    met = postings.groupBy("doc_id").agg(*(F.bit_or(own[n]).alias(f"m{n}") for n in longs))

    def holds(query: frozenset[frozenset[str]]) -> Column:
        def every(some: frozenset[str]) -> Column:
            tests = [
                F.col(f"m{n}").bitwiseAND(F.lit(need)) == need for n in longs if (need := bits(sorted(some), n))
            ]
            return reduce(Column.__and__, tests)

        return reduce(Column.__or__, [every(a) for a in sorted(query, key=sorted)])

    kinds = F.filter(F.array(*(F.when(holds(q), F.lit(k)) for k, q in queries.items())), lambda k: k.isNotNull())
    return met.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """Spans (start, end) of a rule's matches, leftmost first and not overlapping, in code points.

    Each step of the extraction takes the gap before a match with it, so the lengths add up to places.
    """
    step = rf"\G((?s:.*?))({rule.pattern})"
    inner = F.lit(rule.group + 2)

    def places(gaps: Column, found: Column, counted: Column) -> Column:
        ends = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), found.alias("match"), counted.alias("counted")),
            F.struct(
                F.lit(0).alias("at"),
                F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
            ),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("at"),
                F.when(
                    F.length(x["counted"]) >= rule.least,
                    F.array_append(
                        a["spans"],
                        F.struct(
                            (a["at"] + F.length(x["gap"])).alias("start"),
                            (a["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("end"),
                        ),
                    ),
                )
                .otherwise(a["spans"])
                .alias("spans"),
            ),
        )
        return ends["spans"]

    extract = lambda k: F.regexp_extract_all(text, F.lit(step), k)
    return places(extract(F.lit(1)), extract(F.lit(2)), extract(inner))


def may_match(text: Column, rule: Rule) -> Column:
    """Cheap test that skips texts without a match long enough (only for rules that are one repeated class)."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        head = rule.pattern[:-1]
        fixed = len(rule.pattern) - len(rule.pattern[rule.pattern.index("[") :])
        return text.rlike(f"{head}{{{rule.least - fixed}}}")
    return F.lit(True)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``__spans``: array of (start, kind number, kind, end) in that order."""
    docs = plain_columns(docs)
    derived = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in derived.items() if q is not None}
    grams = sorted({g for q in indexed.values() for a in q for g in a})
    found = candidates(index(docs, grams), indexed)
    own = F.col("__docs.doc_id").eqNullSafe(F.col("__found.doc_id"))
    joined = docs.alias("__docs").join(found.alias("__found"), own, "left")
    text = F.coalesce(F.col("__docs.text"), F.lit(""))

    def spans(number: int, rule: Rule) -> Column:
        wanted = may_match(text, rule)
        if rule.kind in indexed:
            wanted = F.array_contains(F.col("__found.kinds"), rule.kind) & wanted
        found = F.when(wanted, matches(text, rule)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(
            found,
            lambda s: F.struct(s["start"], F.lit(number).alias("n"), F.lit(rule.kind).alias("kind"), s["end"]),
        )

    every = F.concat(*(spans(k, r) for k, r in enumerate(rules)))
    return joined.select(
        *(F.col(f"__docs.`{c}`") for c in docs.columns), F.sort_array(every).alias("__spans")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[secret]`` (overlapping spans by one)."""
    found = scan(docs, rules)
    columns = plain_columns(docs).columns
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[secret]")))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    out = found.withColumn("text", F.when(F.size("__spans") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        changed = F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed.otherwise(F.col("n_chars")))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("__spans")

    def joined(kept: Column) -> Column:
        return F.array_join(
            F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    return scan(docs).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.encode(joined(of(*BASE)), "UTF-8"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def _sql() -> str:
    """The query in DuckDB's SQL: each rule's gaps and matches, whose lengths add up to places."""
    parts = []
    for number, rule in enumerate(RULES):
        step = f"((?s:.*?))({rule.pattern})".replace("'", "''")
        parts.append(
            f"SELECT doc_id, {number} AS n, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"regexp_extract_all(t, '{step}', 1) AS gap, regexp_extract_all(t, '{step}', 2) AS hit, "
            f"regexp_extract_all(t, '{step}', {rule.group + 2}) AS counted FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT doc_id, n, kind, least, unnest(gap) AS gap, unnest(hit) AS hit, unnest(counted) AS counted,
  unnest(range(len(hit))) AS k FROM m WHERE len(hit) > 0),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, n ORDER BY k)::BIGINT AS e FROM u),
s AS (SELECT doc_id, n, kind, e - length(hit) AS b, e FROM p WHERE length(counted) >= least),
a AS (SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
  string_agg(kind || ':' || b::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY b, n) FILTER (n < 3) AS base,
  string_agg(kind || ':' || b::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY b, n) AS every FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


SQL = _sql()
