"""Policies: tables of patterns, what they match, and their algebra.

A policy is a set of at most MOST_PATTERNS patterns, so its side of a join may be
broadcast: parse() checks that bound. Commands are matched by an equi-join on length
and literal head (patterns with a wildcard head: on length), then position by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.classify import token_type
from ..functions.lattice import METADATA, SYMBOLS, TYPES, above, immediate_covers, matches
from ..functions.normalize import typed, typed_tokens

MOST_PATTERNS = 65_535


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _pair_in(a: Column, b: Column, table: dict[str, list[str]]) -> Column:
    """Whether (a, b) is in a constant relation; as one membership test of a|b."""
    return F.concat_ws("|", a, b).isin(*(f"{x}|{y}" for x, ys in table.items() for y in ys))


RUNTIME = {a: [b for b in TYPES if matches(a, b)] for a in TYPES if a != "LITERAL"}
ORDER = {a: list(above(a)) for a in TYPES if a != "LITERAL"}


def metadata_met(text: Column, kind: Column, meta: Column) -> Column:
    """Whether a token of a type has a pattern's metadata (null: none wanted)."""
    clock, date = r"\A[0-9]{2}:[0-9]{2}:[0-9]{2}\z", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
    return (
        F.when(meta.isNull(), True)
        .when(kind == "SIZE", F.when(meta == "B", text.rlike(r"\A[0-9.]+[bB]\z")).otherwise(F.regexp_extract(text, r"\A[0-9.]+(.*)\z", 1) == meta))
        .when(kind == "DURATION", F.lower(F.regexp_extract(text, r"\A-?[0-9.]+(.*)\z", 1)) == meta)
        .when(kind == "UUID", F.substring(text, 15, 1) == F.substring(meta, 2, 1))
        .when(kind == "TIMESTAMP", F.when(meta == "date", text.rlike(date)).when(meta == "time", text.rlike(clock)).otherwise(text.rlike(r"\A.{10}[T ].+")))
        .when(kind.isin("SHA", "HEXHASH"), F.length(text) == F.when(meta == "short", 7).otherwise(F.expr("try_cast('0' as int)") + F.when(meta == "40", 40).otherwise(64)))
        .when(kind == "FINGERPRINT", text.startswith("SHA256:") == (meta == "sha256"))
        .otherwise(kind.isin("SEMVER", "RANGE", "PERM_OCTAL"))
    )


def parse(patterns: DataFrame) -> DataFrame:
    """pattern (canonical), n, tokens (text, type, meta, own): one row for each valid pattern.

    own is the type of a literal's text. Invalid: empty, control bytes, a leading *, a known symbol with unknown
    metadata, too many or too long tokens."""
    symbols = _map({s: t for t, s in SYMBOLS.items() if s})
    names = _map({f"{SYMBOLS[t]}.{n.lower()}": k for t, ks in METADATA.items() for k, alias in ks.items() for n in (k, alias or k)})

    def token(x: Column) -> Column:
        base = F.regexp_extract(x, r"\A(#[a-z0-9_]+)\.", 1)
        plain, kind = F.try_element_at(symbols, x), F.try_element_at(symbols, base)
        meta = F.try_element_at(names, F.lower(x))
        literal = F.struct(x.alias("text"), F.lit("LITERAL").alias("type"), F.lit(None).cast("string").alias("meta"), F.lit(True).alias("valid"))
        wild = lambda k, m, ok, t: F.struct(t.alias("text"), k.alias("type"), m.alias("meta"), ok.alias("valid"))
        return F.when(plain.isNotNull(), wild(plain, F.lit(None).cast("string"), F.lit(True), x)).when(kind.isNotNull(), wild(kind, meta, meta.isNotNull(), F.concat(base, F.lit("."), F.coalesce(meta, F.lit("?"))))).otherwise(literal)

    rows = patterns.select(F.filter(F.split("pattern", " +"), lambda x: x != "").alias("parts"), (F.col("pattern").rlike(r"[\x00-\x1F\x7F]") | (F.octet_length("pattern") > 1023)).alias("bad"))
    rows = rows.withColumn("tokens", F.transform("parts", token))
    ok = ~F.col("bad") & (F.size("tokens") > 0) & (F.size("tokens") <= 128) & F.forall("tokens", lambda t: t.valid & (F.octet_length(t.text) < 256)) & (F.col("tokens")[0].text != "*")
    rows = rows.filter(F.when(F.size("tokens") > 0, ok).otherwise(False))
    with_own = F.transform("tokens", lambda t: F.struct(t.text.alias("text"), t.type.alias("type"), t.meta.alias("meta"), F.when(t.type == "LITERAL", token_type(t.text)).alias("own")))
    return rows.select(F.array_join(F.transform("tokens", lambda t: t.text), " ").alias("pattern"), F.size("tokens").alias("n"), with_own.alias("tokens")).dropDuplicates(["pattern"])


def _checked(parsed: DataFrame) -> DataFrame:
    if parsed.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"a policy holds at most {MOST_PATTERNS} patterns")
    return parsed


def _sized(parsed: DataFrame) -> DataFrame:
    return F.broadcast(_checked(parsed))


def _token_met(c: Column, p: Column) -> Column:
    wild = _pair_in(c.type, p.type, RUNTIME) | ((c.type == "LITERAL") & (p.type == "ANY"))
    return F.when(p.type == "LITERAL", c.text == p.text).otherwise(wild & metadata_met(c.text, c.type, p.meta))


def _matched(commands: DataFrame, checked: DataFrame) -> DataFrame:
    """cmd_id and the row of the pattern for every pattern that each command matches. A command is typed once and meets
    the patterns of its own head's text and those of a wildcard head (an empty key) in one join."""
    own = lambda head: F.concat(F.lit("t"), head)
    rows = typed(commands).filter(F.size("c") > 0).withColumn("n", F.size("c"))
    rows = rows.withColumn("key", F.explode(F.array(own(F.col("c")[0].text), F.lit(""))))
    met = F.forall(F.zip_with("c", "tokens", _token_met), lambda x: x)
    head = F.col("tokens")[0]
    table = checked.withColumn("key", F.when(head.type == "LITERAL", own(head.text)).otherwise(""))
    return rows.join(F.broadcast(table), ["n", "key"]).filter(met).drop("c", "n", "key", "tokens")


def match_all(commands: DataFrame, parsed: DataFrame) -> DataFrame:
    """cmd_id, pattern: every pattern that each command (cmd_id, command) matches."""
    return _matched(commands, _checked(parsed)).select("cmd_id", "pattern")


def match_best(commands: DataFrame, parsed: DataFrame) -> DataFrame:
    """cmd_id, command, pattern: the preferred match of each command or null. Of patterns none of
    which subsumes another, that is the smallest in byte order."""
    best = match_all(commands, antichain(parsed)).groupBy("cmd_id").agg(F.min("pattern").alias("pattern"))
    return commands.select("cmd_id", "command").join(best, "cmd_id", "left")


def _subsumes(a: Column, b: Column) -> Column:
    both = _pair_in(b.type, a.type, ORDER) & (a.meta.isNull() | a.meta.eqNullSafe(b.meta))
    of_text = (_pair_in(b.own, a.type, RUNTIME) | (a.type == "ANY")) & metadata_met(b.text, b.own, a.meta)
    return F.when(a.type == "LITERAL", (b.type == "LITERAL") & (a.text == b.text)).when(b.type == "LITERAL", of_text).otherwise(both)


def subsumptions(a: DataFrame, b: DataFrame) -> DataFrame:
    """pattern, by: patterns of b that another pattern of a subsumes. Patterns by patterns, both within the bound."""
    left = _sized(a.select(F.col("pattern").alias("by"), "n", F.col("tokens").alias("wide")))
    met = F.forall(F.zip_with("wide", "tokens", _subsumes), lambda x: x)
    return b.join(left, "n").filter((F.col("pattern") != F.col("by")) & met).select("pattern", "by")


def antichain(parsed: DataFrame) -> DataFrame:
    """The patterns that no other pattern of the table subsumes."""
    return parsed.join(subsumptions(parsed, parsed).select("pattern").distinct(), "pattern", "left_anti")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return antichain(a.union(b).dropDuplicates(["pattern"]))


def diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) patterns from a to b, by text."""
    return b.select("pattern").subtract(a.select("pattern")), a.select("pattern").subtract(b.select("pattern"))


def remove(parsed: DataFrame, texts: DataFrame) -> DataFrame:
    return parsed.join(texts.select("pattern").distinct(), "pattern", "left_anti")


def simulate_add(parsed: DataFrame, more: DataFrame) -> DataFrame:
    """pattern, redundant, by: what adding each pattern would meet."""
    same = more.select("pattern").join(parsed.select("pattern"), "pattern").withColumn("by", F.col("pattern"))
    by = subsumptions(parsed, more).union(same).groupBy("pattern").agg(F.min("by").alias("by"))
    return more.select("pattern").join(by, "pattern", "left").select("pattern", F.col("by").isNotNull().alias("redundant"), "by")


def verdicts(commands: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    """cmd_id, verdict: DENY before ALLOW, else UNDETERMINED."""
    both = _checked(deny).withColumn("deny", F.lit(True)).unionByName(_checked(allow).withColumn("deny", F.lit(False)))
    said = _matched(commands, both).groupBy("cmd_id").agg(F.max("deny").alias("denied"))
    verdict = F.when(F.col("denied"), "DENY").when(~F.col("denied"), "ALLOW").otherwise("UNDETERMINED")
    return commands.select("cmd_id").join(said, "cmd_id", "left").select("cmd_id", verdict.alias("verdict"))


def evaluated(sub_verdicts: DataFrame, mode: str = "ALL") -> DataFrame:
    """Rows (cmd_id, idx, verdict) that are looked at before the mode stops: after the first that is not ALLOW
    (FIRST_FAIL), is ALLOW or DENY (FIRST_PASS), is ALLOW (FIRST_ALLOW), is DENY (FIRST_DENY)."""
    stops = {"ALL": F.lit(False), "FIRST_FAIL": F.col("verdict") != "ALLOW", "FIRST_PASS": F.col("verdict").isin("ALLOW", "DENY"), "FIRST_ALLOW": F.col("verdict") == "ALLOW", "FIRST_DENY": F.col("verdict") == "DENY"}
    before = W.partitionBy("cmd_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return sub_verdicts.withColumn("_stop", F.coalesce(F.max(stops[mode].cast("int")).over(before), F.lit(0))).filter("_stop = 0").drop("_stop")


def expansions(commands: DataFrame) -> DataFrame:
    """cmd_id, pattern: each command's literal form, then its tokens one at a time widened to their type's next wider
    type (never *): at most three."""
    wider = _map({t: SYMBOLS[w] for t, w in immediate_covers().items() if w != "ANY"})
    symbol = _map(SYMBOLS)

    def of(c: Column) -> Column:
        show = lambda t: F.when(t.type == "LITERAL", t.text).otherwise(symbol[t.type])
        plain = F.array_join(F.transform(c, lambda t: t.text), " ")
        one = lambda t, i: F.when(F.try_element_at(wider, t.type).isNotNull(), F.array_join(F.transform(c, lambda u, j: F.when(i == j, wider[u.type]).otherwise(show(u))), " "))
        return F.slice(F.concat(F.array(plain), F.array_compact(F.transform(c, one))), 1, 3)

    return commands.select("cmd_id", F.posexplode(F.transform(F.array(typed_tokens(F.col("command"))), of)[0]).alias("i", "pattern"))
