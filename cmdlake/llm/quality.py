"""Operator 7: quality rules as a short-circuit cascade.

Each rule is a Boolean column. One sample, taken by a hash of the text over the whole table
and written once, tells how long a rule takes (the median of some runs, above a run that
only reads the sample) and how many documents it rejects; the rules then run in the order of rejections per second, as
one CASE that stops at the first rule that rejects. The order changes no verdict.
Measures are made where a rule asks for them, and words once a row. Only DataFrame
operations: counts of repeated windows come from sorted arrays of the row, so nothing is
shuffled and a long text is the work of its own row.

Defined cases: null or empty text has no words, so it fails the base rules; an empty
table gives an empty result; repeated rows are judged alike; rules that tie go by their
names; further columns stay, whatever their names (but one named like a result gives way to it).
"""

from __future__ import annotations

import statistics
import string
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, forget, let, words, written

#: Fixed values of the contract.
SYMBOLS, LEAST_WORDS, REPEATED_PERCENT = "#*$%&|<>", 50, 50
#: ASCII digits and punctuation: what the rules on letters leave out.
NOT_LETTERS = string.digits + string.punctuation
#: Rows (about) of the sample from which cost and selectivity are estimated, and runs of each rule; they bear on speed only.
SAMPLE_ROWS, RUNS = 400, 3


def _joined(get) -> Column:
    """The text without what separates words."""
    return F.translate(F.coalesce(get("text"), F.lit("")), SPACES, "")


def word_chars(get) -> Column:
    return F.length(_joined(get)).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def duplicate_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more; w: the array of words.

    Windows are told apart by 64-bit hashes; where two are equal, (hash, place) pairs
    are sorted and equal neighbours mark the places."""

    def covered(h: Column) -> Column:
        def of(s: Column) -> Column:
            twin = lambda x, k: (F.try_element_at(s, k.cast("int")).h.eqNullSafe(x.h) & (k > 0)) | F.try_element_at(s, (k + 2).cast("int")).h.eqNullSafe(x.h)
            zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            step = lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
            # try_element_at counts from 1, so k is the neighbour before; at k = 0 it has none
            marked = F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x.i.alias("i"), F.when(k == 0, F.try_element_at(s, F.lit(2)).h.eqNullSafe(x.h)).otherwise(twin(x, k)).alias("t"))), lambda x: x.t), lambda x: x.i))
            return F.aggregate(marked, zero, step, lambda a: a.n)

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of))

    def of_words(v: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(v[i], v[i + 1], v[i + 2]))
        return F.when(F.size(v) < 4, F.lit(0)).otherwise(let(windows, covered))

    return let(w, of_words).cast("long")


def base_failed(n: Column, repeated: Column) -> Column:
    return (n < LEAST_WORDS) | (100 * repeated > REPEATED_PERCENT * n)


MEASURES: dict[str, Callable] = {
    "n_words": lambda get: F.size(get("words")).cast("long"),
    "word_chars": word_chars,
    "n_symbols": lambda get: symbols(get("text")),
    "n_lines": lambda get: F.size(_lines(get("text"))).cast("long"),
    "n_dup_lines": lambda get: duplicate_lines(get("text")),
    "n_repeat_words": lambda get: repeated_words(get("words")),
}


def getter(known: dict[str, Column]) -> Callable[[str], Column]:
    """Measures of a document by name: the columns given, the rest as expressions, which
    cost nothing where a rule before rejects."""

    def get(name: str) -> Column:
        return known[name] if name in known else MEASURES[name](get)

    return get


def metrics(docs: DataFrame) -> DataFrame:
    """docs with words and the base measures: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed."""
    rows = docs.withColumn("words", words(F.col("text")))
    get = getter({"text": F.col("text"), "words": F.col("words")})
    rows = rows.withColumns({name: get(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    return rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def _few_letters(get) -> Column:
    return let(_joined(get), lambda x: 2 * F.length(F.translate(x, NOT_LETTERS, "")) < F.length(x))


def _shouting(get) -> Column:
    return let(F.translate(_joined(get), NOT_LETTERS, ""), lambda x: 2 * F.length(F.translate(x, string.ascii_uppercase, "")) < F.length(x))


def _duplicate_lines(get) -> Column:
    return let(_lines(get("text")), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x))


#: The method's rules: name to a Boolean column that is true if the document is rejected.
#: Each takes a getter() of measures.
RULES: dict[str, Callable] = {
    "symbols": lambda get: 10 * get("n_symbols") > get("n_words"),
    "word_length": lambda get: (get("word_chars") < 2 * get("n_words")) | (get("word_chars") > 14 * get("n_words")),
    "duplicate_lines": _duplicate_lines,
    "few_letters": _few_letters,
    "shouting": _shouting,
}
BASE: dict[str, Callable] = {
    "base_short": lambda get: get("n_words") < LEAST_WORDS,
    "base_repeated": lambda get: 100 * get("n_repeat_words") > REPEATED_PERCENT * get("n_words"),
}


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many texts of docs, chosen by hashes, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = max(1, docs.count() // sample_rows)
    return written(docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(every)) == 0).coalesce(4), "quality-sample")


def of_text(rule: Callable) -> Column:
    """A rule over the column text alone, with the words made once a row."""
    return let(F.struct(F.col("text").alias("text"), words(F.col("text")).alias("words")), lambda d: rule(getter({"text": d.text, "words": d.words})))


def ordered_rules(sample: DataFrame, rules: dict, over: Callable = of_text) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule on a sample, most rejections per second first. over: makes a
    rule's column over the sample. A biased sample costs time, never a verdict."""

    def run(rule) -> tuple[float, float]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            seen, no = sample.agg(F.count(F.lit(1)), F.sum(F.coalesce(over(rule), F.lit(False)).cast("int"))).first()
            took.append(time.perf_counter() - began)
        return statistics.median(took), (no or 0) / max(seen, 1)

    plain = run(lambda get: F.size(get("words")) < 0)[0]
    found = [(name, max(took - plain, 1e-3), share) for name, (took, share) in ((n, run(r)) for n, r in rules.items())]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def cascade(get, order: list[str], rules=None) -> Column:
    """The first rule in the given order that rejects, or null."""
    rules = rules if rules is not None else BASE | RULES
    out = None
    for name in order:
        said = F.coalesce(rules[name](get), F.lit(False))
        out = F.when(said, F.lit(name)) if out is None else out.when(said, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def rejection(docs: DataFrame, rules=None) -> Column:
    """Over docs: a rule that rejects the document, null if it is kept."""
    rules = rules if rules is not None else BASE | RULES
    sample = sampled(docs)
    order = [name for name, *_ in ordered_rules(sample, rules)]
    forget(sample)
    return of_text(lambda get: cascade(get, order, rules))


def rejected_by(docs: DataFrame, rules=None) -> DataFrame:
    """docs with rejected_by: a rule that rejects the document, null if it is kept."""
    return docs.withColumn("rejected_by", rejection(docs, rules))


def query(spark, sf_dir: str) -> DataFrame:
    """All measures are results here, so rules read them ready made, and their costs are those of reading them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sample = sampled(docs)
    measured = written(metrics(sample), "quality-measured")
    get = getter({name: F.col(name) for name in ("text", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    order = [name for name, *_ in ordered_rules(measured, RULES, lambda rule: rule(get))]
    forget(sample, measured)
    rows = metrics(docs)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(get, order, RULES).isNull())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT k, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY k ORDER BY i)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, x, y, z) AS c FROM p WHERE z IS NOT NULL),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY k),
m AS (SELECT d.*, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             regexp_replace(text, '[\x20\x09-\x0D0-9!-/:-@\[-`{-~]+', '', 'g') AS plain FROM d LEFT JOIN r USING (k)),
b AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 10 * n_dup_lines > 3 * len(l) OR 2 * length(plain) < word_chars OR 2 * length(regexp_replace(plain, '[A-Z]+', '', 'g')) < length(plain)) AS kept FROM b
"""
