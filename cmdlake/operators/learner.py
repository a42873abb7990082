"""Learning patterns from observed commands: counts of prefixes, then suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import NUMBER_OF, SYMBOLS, join
from ..functions.normalize import typed

#: Defaults of suggestions.
SUPPORT, CONFIDENCE, MOST = 5, 0.0, 20


def learned(commands: DataFrame) -> DataFrame:
    """cmd_id, keys: per token its text if it is literal, else "\\u0001" and its type; commands with an empty token are left out."""
    keys = F.transform("c", lambda t: F.when(t.type == "LITERAL", t.text).otherwise(F.concat(F.lit("\x01"), t.type)))
    rows = typed(commands).select("cmd_id", F.explode(F.array(keys)).alias("keys"))
    return rows.filter((F.size("keys") > 0) & ~F.array_contains("keys", ""))


def prefix_counts(commands: DataFrame) -> DataFrame:
    """prefix, depth, n, ends (commands that end there): one row for each different prefix. Commands are
    counted whole first, so a frequent one is exploded once."""
    whole = learned(commands).groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    rows = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.struct(F.slice("keys", F.lit(1), i).alias("prefix"), (i == F.size("keys")).alias("last")))).alias("x"), "n")
    return rows.groupBy(F.col("x.prefix").alias("prefix")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x.last"), F.col("n")).otherwise(0)).alias("ends")).withColumn("depth", F.size("prefix"))


def _representable(text: str) -> bool:
    return bool(text) and not any(c.isspace() for c in text) and text != "*" and text.split(".")[0] not in SYMBOLS.values()


def _mine(node: dict, root: bool) -> list[tuple[tuple, int, float]]:
    """(pattern tokens, count, confidence) below a node, children grouped by equal suffixes."""
    out = [((), node["ends"], 1.0)] if node["ends"] else []
    groups: dict[tuple, list] = {}
    for key, child in node["next"].items():
        for suffix, n, sure in _mine(child, False):
            groups.setdefault(suffix, []).append((key, n, sure))
    for suffix, items in groups.items():
        sure_of = lambda n, sure: n / node["n"] if not suffix else sure  # noqa: B023, E731
        literal, typed = [x for x in items if x[0][0] != "\x01"], [x for x in items if x[0][0] == "\x01"]
        if len(literal) >= 2 and not root:
            n = sum(x[1] for x in items)
            out.append((("*", *suffix), n, n / node["n"]))
            continue
        out += [((key, *suffix), n, sure_of(n, sure)) for key, n, sure in literal if _representable(key)]
        if len(typed) == 1:
            key, n, sure = typed[0]
            out.append(((SYMBOLS[key[1:]], *suffix), n, sure_of(n, sure)))
        elif typed:
            total = sum(x[1] for x in typed)
            key, n, _ = min(typed, key=lambda x: (-x[1], NUMBER_OF[x[0][1:]]))
            kind = key[1:]
            if 10 * n < 7 * total:
                n = total
                for other, *_ in typed:
                    kind = join(kind, other[1:])
            out.append(((SYMBOLS[kind], *suffix), n, n / node["n"]))
    return out


def _of_head(rows: pd.DataFrame) -> pd.DataFrame:
    """One head's prefixes as a tree below the root; the root's own count is `total`."""
    root = {"n": int(rows["total"].iloc[0]), "ends": 0, "next": {}}
    for r in rows.sort_values("depth").itertuples(index=False):
        node = root
        for key in r.prefix[:-1]:
            node = node["next"][key]
        node["next"][r.prefix[-1]] = {"n": int(r.n), "ends": int(r.ends), "next": {}}
    got = [(" ".join(p), n, sure) for p, n, sure in _mine(root, True) if p and p[0] != "*"]
    return pd.DataFrame(got, columns=["pattern", "n", "confidence"])


def suggestions(commands: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST, blacklist: DataFrame | None = None) -> DataFrame:
    """pattern, n, confidence: mined patterns, best first. Literal heads are mined apart (the root joins none
    of them); what a task holds are a head's different prefixes, not its commands."""
    prefixes = prefix_counts(commands)
    total = prefixes.filter("depth = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = F.when(F.col("prefix")[0].startswith("\x01"), "\x01").otherwise(F.col("prefix")[0])
    rows = prefixes.select(head.alias("head"), F.lit(total).alias("total"), "prefix", "depth", "n", "ends")
    found = rows.groupBy("head").applyInPandas(_of_head, "pattern string, n long, confidence double")
    found = found.filter((F.col("n") >= support) & (F.col("confidence") >= confidence))
    if blacklist is not None:
        found = found.join(blacklist.select("pattern").distinct(), "pattern", "left_anti")
    best = found.groupBy("pattern").agg(F.max(F.struct("confidence", "n")).alias("x"))
    return best.select("pattern", F.col("x.n").alias("n"), F.col("x.confidence").alias("confidence")).orderBy(F.desc("confidence"), F.desc("n"), "pattern").limit(most)
