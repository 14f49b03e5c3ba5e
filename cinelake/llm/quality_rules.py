"""Quality rules: base heuristics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams are estimated, one from trusted documents and one from
the whole corpus.  A document's score is the mean log ratio of the two over its n-grams, so length
does not matter, and a fixed threshold decides.  A mean hides a few words of a long text, so a second
threshold bounds the share of words whose own ratio says that the trusted documents avoid them, though the
corpus has them often.  Everything is DataFrame expressions: no Python runs on the executors.

Defined results: a null or empty text has no words and fails the base rules; a document without
n-grams scores 0; very long texts are judged whole; a figure equal to a threshold keeps the document; repeated
rows are judged alike; an empty corpus gives an empty result; without trusted documents every ratio is 0 and no
word is avoided, so the base rules decide alone; columns of ``docs`` whose names begin with two underscores are
renamed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import let, plain_columns, table, words_of, written

#: Number of hash buckets of the n-gram multinomials: it bounds the model, and what reaches the driver.
BUCKETS = 1 << 16
#: Pseudo-count of each bucket: a share of the buckets' mean count, and a number that damps chance in small corpora.
SMOOTHING, PSEUDO = 0.05, 10.0
#: Documents whose mean log ratio is lower are rejected.
THRESHOLD = -0.18
#: Buckets of the words' own ratios, a multiple of ``BUCKETS``: finer, so that a word is seldom hidden by others.
FINE = 1 << 18
#: A word is avoided if its ratio is lower, with so many counts added to what the target has and should have.
AVOIDED, AVOIDED_PSEUDO = -1.5, 3.0
#: Documents are rejected with more avoided words than this share, and with so many at least.
MAX_AVOIDED_SHARE, MIN_AVOIDED = 0.012, 2
#: At most so many labelled documents (the lowest hashes of their ids) make up the trusted target.
MAX_TRUSTED = 50_000
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]+"
#: Bits for a word's place beside its window's hash.
PLACE_BITS = 21
#: Longest n-gram: 1 for words, 2 for words and word pairs.
LONGEST = 2


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Each window becomes one long: 43 bits of its hash, then its place.  Sorting brings equal hashes
    together, and a covered stretch adds the distance to the one before it, at most 3.  Where neighbours of one
    hash are different words, or places do not fit, the windows themselves are sorted instead: the same figure.
    """
    count = F.greatest(F.size(words) - 2, F.lit(0))
    starts = F.slice(words, 1, count)
    packed = F.transform(
        starts,
        lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS) + i,
    )
    windows = F.transform(
        starts,
        lambda w, i: F.struct(F.array(w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def alike(x: Column, y: Column) -> Column:
        return F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)

    def differ(x: Column, y: Column) -> Column:
        i, j = place(x), place(y)
        one, two, three = (F.get(words, i + k) != F.get(words, j + k) for k in range(3))
        return alike(x, y) & (one | two | three)

    def by_hash(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1)))
        return let(
            twice,
            lambda t: F.when(
                F.size(F.filter(t, lambda x, k: differ(x, F.get(t, k - 1)))) == 0, F.transform(t, lambda x: place(x))
            ).otherwise(let(F.sort_array(windows), by_words)),
        )

    def by_words(s: Column) -> Column:
        return F.transform(
            F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"])),
            lambda x: x["i"],
        )

    places = F.when(F.size(words) < (1 << PLACE_BITS), let(F.sort_array(packed), by_hash)).otherwise(
        let(F.sort_array(windows), by_words)
    )
    total = F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(total["n"]).cast("long")


def fine_bucket(word: Column) -> Column:
    """Bucket of a word among the fine ones."""
    return F.pmod(F.hash(word), F.lit(FINE))


def word_bucket(word: Column, buckets: int, longest: int) -> Column:
    """Bucket of a word: one of the first half if pairs have the other."""
    return F.pmod(F.hash(word), F.lit(buckets // longest))


def pair_bucket(word: Column, following: Column, buckets: int) -> Column:
    """Bucket of a word and the one that follows (the empty word after the last): one of the second half."""
    own = F.pmod(F.hash(word, F.coalesce(following, F.lit(""))), F.lit(buckets - buckets // 2))
    return own + F.lit(buckets // 2)


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """Ids of labelled good documents, at most ``limit``: those with the lowest hashes."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    return (
        good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def counted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Counts of the n-grams by bucket, ``raw`` over all documents and ``target`` over the trusted.

    Words are counted in the fine buckets, pairs in those of the second half with ``FINE`` added.  ``trusted``
    has at most ``MAX_TRUSTED`` ids, so it may be broadcast.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("__trusted"))), "doc_id", "left"
    )
    if longest == 1:
        grams = marked.select("__trusted", F.explode(words_of(F.col("text"))).alias("w")).select(
            "__trusted", fine_bucket(F.col("w")).alias("b")
        )
    else:
        pairs = let(
            words_of(F.col("text")),
            lambda w: F.transform(w, lambda x, i: F.struct(x.alias("w"), F.get(w, i + 1).alias("v"))),
        )
        pair = pair_bucket(F.col("w"), F.col("v"), buckets) + F.lit(FINE)
        grams = marked.select("__trusted", F.inline(pairs)).select(
            "__trusted", F.explode(F.array(fine_bucket(F.col("w")), pair)).alias("b")
        )
    return grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("__trusted").alias("target"))


def avoided(counts: DataFrame) -> list[int]:
    """A bit for each fine bucket, 64 a number: set if the target has much fewer of its words than its share.

    The driver gets ``FINE / 64`` numbers at most.
    """
    words = counts.where(F.col("b") < FINE)
    total = words.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    bits = [0] * (FINE // 64)
    if total["target"]:
        due = F.col("raw") * (total["target"] / total["raw"])
        own = F.log((F.col("target") + AVOIDED_PSEUDO) / (due + AVOIDED_PSEUDO))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))
        slots = words.where(own < AVOIDED).groupBy((F.col("b") / 64).cast("int").alias("slot"))
        for row in slots.agg(F.bit_or(bit).alias("bits")).collect():
            bits[row["slot"]] = row["bits"]
    return bits


def fit(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    longest: int = LONGEST,
) -> DataFrame:
    """One row: ``ratio``, the log ratio of each bucket, trusted over raw; the raw counts cover all documents."""
    return ratios(counted(docs, trusted, buckets, longest), buckets, smoothing, longest)


def ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, longest: int = LONGEST) -> DataFrame:
    """``fit`` from the counts.  The one task that lines the buckets up gets ``buckets`` rows at most."""
    half = F.when(F.col("b") < FINE, F.col("b") % (buckets // longest)).otherwise(F.col("b") - FINE)
    counts = counts.groupBy(half.alias("b")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = F.col("raw_total"), F.col("target_total")
    # Both get the same share of pseudo-counts, so a bucket that neither has seen stays at 0.
    added = raw * smoothing / buckets + PSEUDO
    log = F.log((F.col("x.target") + added * target / raw) / target) - F.log((F.col("x.raw") + added) / raw)
    lined = counts.agg(
        F.sum("raw").alias("raw_total"), F.sum("target").alias("target_total"), F.collect_list(F.struct("b", "raw", "target")).alias("seen")
    )
    every = lined.select(
        "raw_total",
        "target_total",
        F.explode(
            F.concat(
                F.col("seen"),
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.lit(buckets - 1)), F.transform("seen", lambda x: x["b"])),
                    lambda b: F.struct(b.alias("b"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target")),
                ),
            )
        ).alias("x"),
    )
    weighed = every.select(F.col("x.b").alias("b"), F.when(target > 0, log).otherwise(0.0).alias("log"))
    by_bucket = F.sort_array(F.collect_list(F.struct("b", "log")))
    return weighed.agg(F.transform(by_bucket, lambda x: x["log"]).alias("ratio"))


def judge(
    docs: DataFrame,
    ratio: list[float],
    threshold: float = THRESHOLD,
    longest: int = LONGEST,
    bits: list[int] | None = None,
) -> DataFrame:
    """All documents, with the figures of the base rules, ``llr``, the avoided words and the verdict.

    The ratios become one literal of the plan, in thousandths, so that the plan stays small; so do the bits of
    the avoided words (none: no word is avoided).
    """
    docs = plain_columns(docs)
    buckets = len(ratio)
    weights = F.from_json(F.lit(json.dumps([round(x, 3) + 0.0 for x in ratio], separators=(",", ":"))), "array<double>")
    marks = F.from_json(F.lit(json.dumps(bits or [], separators=(",", ":"))), "array<bigint>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def log_ratio(words: Column) -> Column:
        one = lambda w: F.get(weights, word_bucket(w, buckets, longest))
        if longest == 1:
            total = F.aggregate(words, F.lit(0.0), lambda a, w: a + one(w))
        else:
            each = F.transform(
                words, lambda w, i: one(w) + F.get(weights, pair_bucket(w, F.get(words, i + 1), buckets))
            )
            total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(words) > 0, total / (longest * F.size(words))).otherwise(0.0)

    def marked(word: Column) -> Column:
        b = fine_bucket(word)
        return F.call_function("getbit", F.get(marks, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1

    def figures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            log_ratio(words).alias("llr"),
            (F.size(F.filter(words, marked)) if bits else F.lit(0)).cast("long").alias("n_avoided"),
        )

    judged = docs.withColumn("__q", let(words_of(F.col("text")), figures))
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    shunned = (q["n_avoided"] >= MIN_AVOIDED) & (q["n_avoided"] > MAX_AVOIDED_SHARE * q["n_words"])
    return judged.select(
        *(F.col(c) for c in docs.columns),
        q.alias("__q"),
        failed.alias("__base_failed"),
        (~failed & (q["llr"] >= threshold) & ~shunned).alias("__kept"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the struct ``__q`` (figures and ``llr``), ``__base_failed`` and ``__kept``."""
    counts = written(counted(docs, trusted_ids(labels)))
    return judge(docs, ratios(counts).first()["ratio"], threshold, bits=avoided(counts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules(docs, table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id",
        *(F.col("__q")[n].alias(n) for n in names),
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
        F.col("__q")["llr"].alias("llr"),
        F.col("__q")["n_avoided"].alias("n_avoided"),
    )
