"""Operator 8: secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over lower-case trigrams is
derived: any text that the rule matches satisfies it. The index lists, for every
trigram of any query, the documents that hold it (postings). A rule's candidates are
the documents in the intersections of its query's posting lists; only they are read
with the rule's expression. A rule whose expression has no mandatory trigram (hex
digits) reads every document.

Postings hold a hash of the row and a trigram, no text; texts are shuffled once, when the
candidates of a row join it. No key is hotter than a row and its copies, and Spark may
split those. Only DataFrame operations; everything about a row stays in its row.

Defined cases: null text is the empty text; rows with the same id and text are
scanned as one key and each returned; a long text is one row, with as many spans as it
has; spans that begin together are told apart by the rules' order; further columns stay,
whatever their names (but one named found gives way to the spans); an empty table gives an
empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let


@dataclass(frozen=True)
class Rule:
    """kind; regex (Java and Python syntax); of the match, or of group, at least so many characters."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0


#: Fixed values of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: The method's own kinds: well-known public token formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

#: Alternatives that a run of literals may have before the run is cut, and the largest character class that counts as literals.
MOST_ALTERNATIVES, MOST_CLASS = 32, 8


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """A disjunction of conjunctions of lower-case trigrams that every match satisfies;
    None if the expression has no mandatory trigram."""

    def either(a, b):
        return None if a is None or b is None else _least([*a, *b])

    def both(a, b):
        if a is None or b is None:
            return a if b is None else b
        return _least([x | y for x in a for y in b])

    def of_strings(strings):
        """The query of 'one of these strings occurs'."""
        found = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        return None if not all(found) else _least(found)

    def walk(nodes):
        """(the strings that the nodes can be, or None if they are too many; the query)."""
        exact, query, run = {""}, None, {""}
        for op, arg in nodes:
            strings, inner = piece(op, arg)
            if strings is not None and len(run) * len(strings) <= MOST_ALTERNATIVES:
                run = {a + b for a, b in itertools.product(run, strings)}
                exact = None if exact is None else {a + b for a, b in itertools.product(exact, strings)} if len(exact) * len(strings) <= MOST_ALTERNATIVES else None
            else:
                query, exact = both(both(query, of_strings(run)), inner), None
                run = strings if strings is not None and len(strings) <= MOST_ALTERNATIVES else {""}
        return exact, both(query, of_strings(run))

    def piece(op, arg):
        if op is C.LITERAL:
            return {chr(arg).lower()}, None
        if op is C.IN:
            out = set()
            for what, x in arg:
                if what is C.LITERAL:
                    out.add(chr(x).lower())
                elif what is C.RANGE and x[1] - x[0] < MOST_CLASS:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (out, None) if len(out) <= MOST_CLASS else (None, None)
        if op is C.SUBPATTERN:
            return walk(arg[-1])
        if op is C.BRANCH:
            every, query = set(), []
            for x in arg[1]:
                strings, inner = walk(x)
                every = None if every is None or strings is None else every | strings
                query = either(query, inner if strings is None else of_strings(strings))
            return every, query or None
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            strings, query = walk(inner)
            if low == 0:
                return ({""} | strings, None) if high == 1 and strings is not None else (None, None)
            return (strings, None) if low == high == 1 else (None, of_strings(strings) if strings is not None else query)
        return (None, None) if op is not C.AT else ({""}, None)

    exact, query = walk(_parser.parse(regex))
    return of_strings(exact) if exact is not None else query


def _least(conjunctions: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without the conjunctions that another one implies, in a fixed order."""
    each = sorted(set(conjunctions), key=lambda x: (len(x), sorted(x)))
    return [x for i, x in enumerate(each) if not any(y <= x for y in each[:i])]


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text, key (a hash of id and text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: trigram, key for each of the trigrams in each document of keyed()."""
    held = let(F.lower("text"), lambda text: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(text, t)))
    return rows.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """key, kinds: the rules whose query the document's postings satisfy."""
    wants: dict[str, list] = {}
    for kind, query in queries.items():
        for i, trigrams in enumerate(query):
            for t in trigrams:
                wants.setdefault(t, []).append(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("conjunction"), F.lit(len(trigrams)).alias("need")))
    table = F.create_map(*itertools.chain.from_iterable((F.lit(t), F.array(*x)) for t, x in wants.items()))
    rows = index.select("key", "trigram", F.explode(table[F.col("trigram")]).alias("x")).select("key", "trigram", "x.*")
    met = rows.distinct().groupBy("key", "kind", "conjunction", "need").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


#: Lengths summed at one level of running sums.
STEP = 128


def _running(lengths: Column) -> Column:
    """Sums of lengths up to each element, by blocks, so that the work is not the square of the matches."""

    def over(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda b: F.slice(x, b * STEP + 1, STEP))
        add = lambda y: F.aggregate(y, F.lit(0), lambda a, v: a + v)

        def inside(y: Column, before: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(y)), lambda k: before + add(F.slice(y, 1, k)))

        def of(parts: Column) -> Column:
            return let(F.transform(parts, add), lambda sums: F.flatten(F.transform(parts, lambda y, b: inside(y, F.when(b == 0, F.lit(0)).otherwise(add(F.slice(sums, 1, b)))))))

        return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(blocks, of))

    return let(lengths, over)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of the rule's matches; a match that is too short
    is dropped, but no other one begins inside it."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    gaps = F.split(text, rule.regex, -1)

    def of(all_: Column) -> Column:
        m, g, t = all_["m"], all_["g"], all_["t"]
        lengths = F.transform(m, lambda x, i: F.length(g[i]) + F.when(i > 0, F.length(m[F.greatest(i - 1, F.lit(0))])).otherwise(0))
        row = lambda s, i: F.struct(s.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (s + F.length(m[i])).alias("end"), F.length(t[i]).alias("tested"))
        each = F.filter(F.transform(_running(lengths), row), lambda x: x.tested >= rule.least)
        return F.transform(each, lambda x: F.struct(x.start.alias("start"), x.order.alias("order"), x.kind.alias("kind"), x.end.alias("end")))

    return let(F.struct(found.alias("m"), gaps.alias("g"), tested.alias("t")), of)


NO_SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """row, text, found of each document."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    rows = keyed(docs)
    index = postings(rows, sorted({t for q in queries.values() for x in q for t in x}))
    rows = rows.join(candidates(index, queries), "key", "left")

    def of(i: int, rule: Rule) -> Column:
        # Of hex digits only long runs count, and those are whole matches: the shorter ones need not be listed.
        full = rule if rule.kind in queries or rule.group else Rule(rule.kind, rule.regex[:-1] + f"{{{rule.least},}}+" if rule.regex.endswith("]+") else rule.regex, rule.least)
        reads = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.col("text").rlike(full.regex)
        return F.when(F.coalesce(reads, F.lit(False)), spans(F.col("text"), full, i)).otherwise(F.array().cast(NO_SPANS))

    return rows.select("row", "text", F.array_sort(F.concat(*(of(i, r) for i, r in enumerate(rules)))).alias("found"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with found: array of (start, order, kind, end), by start, then the rules' order."""
    return _scanned(docs, rules).select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "found"), "found")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by mark; overlapping spans by one mark."""
    rows, text = _scanned(docs, rules), F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.concat(F.substring(text, a["at"] + 1, x.start - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], x.end).alias("at"), F.when(x.start >= a["at"], F.concat(a["out"], F.array(gap))).otherwise(a["out"]).alias("out"))

    done = F.aggregate("found", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    rows = rows.select("row", F.when(F.size("found") > 0, done).alias("text"))  # null where there is nothing to hide
    new = {"text": F.coalesce(text, F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("text").cast("long"), F.col("row")["n_chars"])
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    rows = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("found", lambda x: x.order < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x.order == k)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def _sql(rules: tuple[Rule, ...]) -> str:
    """The scan without an index, in DuckDB's SQL."""
    parts = []
    for i, r in enumerate(rules):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT k, {i} AS o, '{r.kind}' AS kind, unnest(regexp_extract_all(text, '{regex}')) AS m, unnest(regexp_extract_all(text, '{regex}', {r.group})) AS t, "
            f"unnest(regexp_split_to_array(text, '{regex}')[1:len(regexp_extract_all(text, '{regex}'))]) AS g, unnest(range(len(regexp_extract_all(text, '{regex}')))) AS i, {r.least} AS least FROM d WHERE regexp_matches(text, '{regex}')"
        )
    listed = lambda on: f"coalesce(string_agg(CASE WHEN {on} THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, o), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({' UNION ALL '.join(parts)}),
b AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY k, o ORDER BY i))::BIGINT AS e FROM a),
c AS (SELECT k, o, kind, e - length(m) AS s, e FROM b WHERE length(t) >= least),
f AS (SELECT k, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
             {listed(f'o < {len(BASE)}')} AS base, {listed('true')} AS spans FROM c GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (k)
"""


SQL = _sql(RULES)
