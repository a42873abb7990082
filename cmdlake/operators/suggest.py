"""Patterns to offer: for commands that a policy leaves unmatched, and for one token of a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import token_type
from ..functions.lattice import METADATA, SYMBOLS, TYPES, above, immediate_covers, join
from ..functions.normalize import typed
from .policy import RUNTIME, _map, _sized, _token_met


def _shown(t: Column) -> Column:
    """A token as a pattern shows it: a text with a dot stays where its type can have metadata."""
    own = (t["type"] == "LITERAL") | (F.contains(t["text"], F.lit(".")) & t["type"].isin(*METADATA))
    return F.when(own, t["text"]).otherwise(F.try_element_at(_map(SYMBOLS), t["type"]))


def unmatched(commands: DataFrame, parsed: DataFrame) -> DataFrame:
    """cmd_id, idx, pattern, based_on, confidence: at most two patterns for each command that no pattern matches.

    The first keeps the longest prefix that some pattern accepts and takes the rest literally; the second widens
    the token where patterns part from the command, or shows all tokens by type. A command meets the patterns
    whose head accepts its own by an equi-join on that head's text or type; what they say is then one
    aggregate with partial sums, which also says whether some pattern matches as a whole."""
    rows = typed(commands).filter(F.size("c") > 0)
    first = F.col("c")[0]
    # An empty key meets no pattern: its row stands for the command.
    keyed = rows.withColumn("key", F.explode(F.array(F.lit(""), F.concat(F.lit("t"), first["text"]), F.concat(F.lit("k"), first["type"]))))
    head = F.col("tokens")[0]
    accepts = F.create_map(*[x for p in TYPES if p != "LITERAL" for x in (F.lit(p), F.array(*(F.lit("k" + c) for c in TYPES if p in RUNTIME.get(c, ()) or (c == "LITERAL" and p == "ANY"))).cast("array<string>"))])
    keys = F.when(head["type"] == "LITERAL", F.array(F.concat(F.lit("t"), head["text"]))).otherwise(F.try_element_at(accepts, head["type"]))
    table = _sized(parsed.select("pattern", F.col("n").alias("size"), "tokens", F.explode(keys).alias("key")))

    met = F.zip_with("c", "tokens", lambda a, b: F.coalesce(_token_met(a, b), F.lit(False)))
    found = keyed.join(table, "key", "left").withColumn("_met", F.explode(F.array(F.when(F.col("pattern").isNotNull(), met))))
    found = found.withColumn("depth", F.when(F.array_position("_met", False) > 0, F.array_position("_met", False) - 1).otherwise(F.size("_met")).cast("int"))
    here, there = F.get("c", F.col("depth"))["type"], F.get("tokens", F.col("depth"))["type"]
    joins = {f"{c}|{p}": join(c, p) for c in RUNTIME for p in RUNTIME[c] if p != "LITERAL"}
    wide = F.try_element_at(_map(joins), F.concat_ws("|", here, there))
    rank = _map({t: str(1000 - len(list(above(t)))) for t in TYPES})
    some = F.col("pattern").isNotNull() & F.col("cmd_id").isNotNull()
    near = found.groupBy("cmd_id").agg(
        F.min(F.when(some, F.struct((-F.col("depth")).alias("d"), "size", "pattern"))).alias("near"),
        F.min(F.when(some & wide.isNotNull(), F.struct((-F.col("depth")).alias("d"), F.try_element_at(rank, wide).alias("r"), wide.alias("type")))).alias("wide"),
        F.max(some & (F.col("depth") == F.size("_met"))).alias("matched"),
        F.collect_list(F.when(F.col("key") == "", F.col("c"))).alias("cs"),
    )
    out = near.filter(~F.coalesce("matched", F.lit(False))).select("cmd_id", "near", "wide", F.explode("cs").alias("c")).withColumn("depth", F.coalesce(-F.col("near.d"), F.lit(0)))
    shown = F.transform("c", _shown)
    plain = F.transform("c", lambda t: t["text"])
    kept = F.slice(shown, F.lit(1), F.col("depth"))
    text = lambda x: F.array_join(x, " ")
    based = F.when(F.col("depth") > 0, F.col("near.pattern"))
    a = text(F.concat(kept, F.slice(plain, F.col("depth") + 1, F.size("c"))))
    widened = (F.col("wide.d") == -F.col("depth")) & (F.col("wide.type") != "ANY")
    b = F.when(widened, text(F.concat(kept, F.array(F.try_element_at(_map(SYMBOLS), F.col("wide.type")))))).otherwise(F.nullif(text(shown), a))
    offers = F.array(F.struct(a.alias("pattern"), based.alias("based_on")), F.struct(b.alias("pattern"), F.when(widened, based).alias("based_on")))
    out = out.select("cmd_id", (F.col("depth") / F.size("c")).alias("confidence"), F.posexplode(offers).alias("idx", "o")).filter("o.pattern is not null")
    return out.select("cmd_id", "idx", "o.pattern", "o.based_on", "confidence")


def chain(kind: str) -> list[str]:
    """A type and the types wider than it, each the narrowest one wider than the one before, up to any."""
    up, out = immediate_covers(), [kind]
    while out[-1] != "ANY":
        out.append(up.get(out[-1]) or "ANY")
    return out


def token_variants(patterns: DataFrame, pos: int, most: int = 8) -> DataFrame:
    """pattern, idx, type, symbol: what may stand at a place of each pattern: its text, then its type and wider ones."""
    token = F.get(F.filter(F.split("pattern", " +"), lambda x: x != ""), F.lit(pos))
    base = F.regexp_extract(token, r"\A(#[a-z0-9_]+)(?:\..*)?\z", 1)
    symbol = _map({s: t for t, s in SYMBOLS.items() if s})
    kind = F.coalesce(F.try_element_at(symbol, token), F.try_element_at(symbol, base), token_type(token))
    chains = F.create_map(*[x for t in TYPES if t != "LITERAL" for x in (F.lit(t), F.array(*map(F.lit, chain(t))))])
    wider = F.coalesce(F.try_element_at(chains, kind), F.array(F.lit("ANY")))
    rows = patterns.select("pattern", token.alias("token"), F.slice(F.concat(F.array(F.lit("LITERAL")), wider), 1, most).alias("types")).filter("token is not null")
    rows = rows.select("pattern", "token", F.posexplode("types").alias("idx", "type"))
    return rows.select("pattern", "idx", "type", F.when(F.col("type") == "LITERAL", F.col("token")).otherwise(F.try_element_at(_map(SYMBOLS), F.col("type"))).alias("symbol"))
