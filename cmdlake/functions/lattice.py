"""The lattice of 45 token types: order, joins, and what matches what.

Only the covering chains are stated; order and least upper bounds follow from them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Token types in the order of their numbers, each with its pattern symbol.
SYMBOLS = {
    "LITERAL": "", "HEXHASH": "#h", "NUMBER": "#n", "IPV4": "#i", "IPV6": "#ipv6", "IPADDR": "#ipaddr", "WORD": "#w", "QUOTED": "#q",
    "QUOTED_SPACE": "#qs", "FILENAME": "#f", "REL_PATH": "#r", "ABS_PATH": "#p", "PATH": "#path", "URL": "#u", "VALUE": "#val",
    "SHORTOPT": "#sopt", "LONGOPT": "#lopt", "OPT": "#opt", "UUID": "#uuid", "EMAIL": "#email", "HOSTNAME": "#host", "PORT": "#port",
    "SIZE": "#size", "SEMVER": "#semver", "TIMESTAMP": "#ts", "HASH_ALGO": "#hash", "ENV_VAR": "#env", "HYPHENATED": "#hyp",
    "BRANCH": "#branch", "SHA": "#sha", "IMAGE": "#image", "PKG": "#pkg", "USER": "#user", "FINGERPRINT": "#fp", "MAC": "#mac",
    "METHOD": "#method", "CRON": "#cron", "DURATION": "#duration", "REGEX": "#regex", "GLOB": "#glob", "RANGE": "#range",
    "SIGNAL": "#signal", "USER_GROUP": "#user_group", "PERM_OCTAL": "#perm", "ANY": "*",
}
TYPES = list(SYMBOLS)
NUMBER_OF = {t: i for i, t in enumerate(TYPES)}
#: Types that lie directly below another type than VALUE.
BELOW = {
    "SHA": "HEXHASH", "IPV4": "IPADDR", "IPV6": "IPADDR", "QUOTED": "QUOTED_SPACE", "FILENAME": "REL_PATH", "REL_PATH": "PATH",
    "ABS_PATH": "PATH", "SHORTOPT": "OPT", "LONGOPT": "OPT", "PORT": "NUMBER", "PERM_OCTAL": "NUMBER", "HASH_ALGO": "WORD",
    "HYPHENATED": "WORD", "METHOD": "WORD", "PATH": "ANY", "URL": "ANY", "VALUE": "ANY",
}
#: Pattern types that a command's token of a type matches beyond the order.
MATCHES_TOO = {"HEXHASH": ["NUMBER"], "IPADDR": ["IPV4", "IPV6"], "OPT": ["SHORTOPT", "LONGOPT"]}
#: Closed vocabulary of metadata, per type: canonical name to alias.
METADATA = {
    "SIZE": {k: None for k in "K M G T Ki Mi Gi Ti KB MB GB TB".split()} | {"B": "b", "bytes": None} | {k: None for k in "KiB MiB GiB TiB".split()},
    "UUID": {"v4": "4", "v5": "5"},
    "SEMVER": {"major": None, "minor": None, "patch": None, "*": None},
    "TIMESTAMP": {"date": None, "time": None, "datetime": None},
    "SHA": {"short": None, "40": None, "64": None},
    "FINGERPRINT": {"sha256": None, "md5": None},
    "DURATION": {k: None for k in "ns us ms s m h d w".split()},
    "RANGE": {"step": None},
    "PERM_OCTAL": {"bits": None},
}


def covers() -> list[tuple[str, str]]:
    """(narrow, wide) pairs that generate the order."""
    return [(t, BELOW.get(t, "VALUE")) for t in TYPES if t not in ("LITERAL", "ANY")] + [("LITERAL", t) for t in TYPES if t not in ("LITERAL", *BELOW.values())]


@cache
def above(t: str) -> tuple[str, ...]:
    """t and every wider type, narrowest first."""
    if t == "LITERAL":
        return tuple(TYPES)
    out = [t]
    while out[-1] != "ANY":
        out.append(BELOW.get(out[-1], "VALUE"))
    return tuple(out)


def compatible(a: str, b: str) -> bool:
    return b in above(a)


def join(a: str, b: str) -> str:
    """Least upper bound; the bottom is LITERAL."""
    if a == "LITERAL" or b == "LITERAL":
        return b if a == "LITERAL" else a
    return next(x for x in above(a) if x in above(b))


def matches(command: str, pattern: str) -> bool:
    """Whether a command's token of one type meets a pattern's type; a literal only itself and ANY."""
    if command == "LITERAL":
        return pattern in ("LITERAL", "ANY")
    return pattern in above(command) or pattern in MATCHES_TOO.get(command, ())


def canonical_metadata(t: str, name: str) -> str | None:
    """The vocabulary's spelling of a metadata name or alias, whatever its case."""
    for k, alias in METADATA.get(t, {}).items():
        if name.lower() in (k.lower(), (alias or k).lower()):
            return k
    return None


def immediate_covers() -> dict[str, str]:
    """The next wider type, of all types that have one."""
    return {t: above(t)[1] for t in TYPES if t not in ("LITERAL", "ANY")}


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, SYMBOLS[t]) for t, i in NUMBER_OF.items()], "number int, type string, symbol string")


def closure(spark: SparkSession) -> DataFrame:
    """sub, sup: the order, derived by a recursive query from the covering pairs."""
    spark.createDataFrame(covers(), "a string, b string").createOrReplaceTempView("cmdlake_covers")
    spark.createDataFrame([(t,) for t in TYPES], "t string").createOrReplaceTempView("cmdlake_types")
    return spark.sql("""
        WITH RECURSIVE up(sub, sup, depth) AS (
            SELECT t, t, 0 FROM cmdlake_types UNION ALL
            SELECT up.sub, c.b, up.depth + 1 FROM up JOIN cmdlake_covers c ON up.sup = c.a WHERE up.depth < 6)
        SELECT DISTINCT sub, sup FROM up""")


def join_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, join(a, b)) for a in TYPES for b in TYPES], "a string, b string, j string")


def match_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in TYPES for b in TYPES if matches(a, b)], "command_type string, pattern_type string")
