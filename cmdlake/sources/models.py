"""Text and model files: command lists, policies with a checksum, n-gram models."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_commands(spark: SparkSession, path: str, most: int = 8192) -> DataFrame:
    """command: one a line, trimmed; blank, overlong and NUL-bearing lines are left out."""
    text = F.btrim("value")
    return spark.read.text(path).select(text.alias("command")).filter((F.length("command") > 0) & (F.octet_length("command") <= most) & ~F.contains("command", F.lit("\x00")))


def policy_text(patterns: list[str]) -> str:
    """The `# CPL v1` form: header, patterns in order, and the checksum of their lines."""
    lines = [("# pattern: " if p.startswith("#") else "") + p for p in sorted(patterns)]
    return "\n".join(["# CPL v1", f"# patterns: {len(lines)}", *lines, f"# CRC32: {zlib.crc32(''.join(p + chr(10) for p in sorted(patterns)).encode()):08x}", ""])


def policy_patterns(text: str) -> list[str]:
    """Patterns of that form; ValueError if header, number or checksum don't agree."""
    lines = text.splitlines()
    if lines[:1] != ["# CPL v1"] or not lines[-1].startswith("# CRC32: "):
        raise ValueError("not a policy file")
    out = [x.removeprefix("# pattern: ") for x in lines[2:-1]]
    if lines[1] != f"# patterns: {len(out)}" or int(lines[-1].split()[-1], 16) != zlib.crc32("".join(p + "\n" for p in out).encode()):
        raise ValueError("policy file is damaged")
    return out


def save_policy(parsed: DataFrame, path: str) -> None:
    """One text file by Spark's committer, so it is there whole or not at all. A policy is bounded (operators.policy)."""
    spark = parsed.sparkSession
    text = policy_text([r["pattern"] for r in parsed.select("pattern").collect()])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """pattern: the rows of a saved policy, checked before any is returned."""
    rows = spark.read.text(path, wholetext=True).filter(F.length("value") > 0).collect()
    return spark.createDataFrame([(p,) for p in policy_patterns(rows[0]["value"].rstrip("\n") + "\n")], "pattern string")


def save_ngrams(of: dict[int, DataFrame], path: str) -> None:
    for order, counts in of.items():
        counts.write.mode("overwrite").parquet(f"{path}/order={order}")


def load_ngrams(spark: SparkSession, path: str) -> dict[int, DataFrame]:
    """The four tables; ValueError for a count that is not positive."""
    of = {k: spark.read.parquet(f"{path}/order={k}") for k in (1, 2, 3, 4)}
    for counts in of.values():
        if counts.filter("n is null or n <= 0").limit(1).count():
            raise ValueError("a count is not positive")
    return of


def policy_dot(patterns: list[str]) -> str:
    """The patterns' prefix tree as a GraphViz graph."""
    nodes, edges = {(): 0}, []
    for p in sorted(patterns):
        parts = tuple(p.split())
        for i in range(1, len(parts) + 1):
            if parts[:i] not in nodes:
                nodes[parts[:i]] = len(nodes)
                label = parts[i - 1].replace("\\", "\\\\").replace('"', '\\"')
                edges.append(f'  n{nodes[parts[: i - 1]]} -> n{nodes[parts[:i]]} [label="{label}"];')
    ends = [f"  n{nodes[tuple(p.split())]} [shape=doublecircle];" for p in sorted(patterns)]
    return "\n".join(["digraph policy {", *ends, *edges, "}", ""])


def save_learner(prefixes: DataFrame, path: str) -> None:
    """The table of operators.learner.prefix_counts."""
    prefixes.select("prefix", "depth", "n", "ends").write.mode("overwrite").parquet(path)


def load_learner(spark: SparkSession, path: str) -> DataFrame:
    """That table; ValueError unless every prefix has as many commands as end there and go on from it."""
    rows = spark.read.parquet(path)
    below = rows.filter("depth > 1").groupBy(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("prefix")).agg(F.sum("n").alias("below"))
    both = rows.join(below, "prefix", "full")
    wrong = F.col("n").isNull() | (F.col("n") <= 0) | (F.col("ends") < 0) | (F.col("depth") != F.size("prefix")) | (F.col("n") != F.col("ends") + F.coalesce("below", F.lit(0)))
    if both.filter(wrong).limit(1).count() or rows.groupBy("prefix").count().filter("count > 1").limit(1).count():
        raise ValueError("counts of prefixes don't add up")
    return rows


def _seal(counts: DataFrame) -> tuple[int, int]:
    """Rows of a table and the sum of their hashes, whatever their order."""
    row = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64(*sorted(counts.columns)), F.lit(1 << 31))), F.lit(0))).first()
    return row[0], row[1]


def save_bundle(raw: dict[int, DataFrame], typed: dict[int, DataFrame], path: str) -> None:
    """Both models of a gate, and last a manifest of what they hold."""
    spark, seals = raw[1].sparkSession, []
    for name, of in (("raw", raw), ("typed", typed)):
        save_ngrams(of, f"{path}/{name}")
        seals += [(name, k, *_seal(spark.read.parquet(f"{path}/{name}/order={k}"))) for k in of]
    spark.createDataFrame(seals, "model string, k int, n long, hash long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """(raw, typed); ValueError if a table is not what the manifest says."""
    both = load_ngrams(spark, f"{path}/raw"), load_ngrams(spark, f"{path}/typed")
    for r in spark.read.parquet(f"{path}/manifest").collect():
        if _seal(both[r["model"] == "typed"][r["k"]]) != (r["n"], r["hash"]):
            raise ValueError("a model is not what the bundle's manifest says")
    return both


def graph_text(graphs: DataFrame) -> DataFrame:
    """cmd_id, text: a dependency graph as lines, nodes then edges."""
    node = lambda n: F.concat_ws(" ", F.concat(F.lit("node "), n["node_id"]), F.coalesce(n["doc_kind"], n["kind"]), F.coalesce(F.array_join(n["tokens"], " "), n["path"], n["name"], n["value"]))
    edge = lambda e: F.concat(F.lit("edge "), e["src"], F.lit(" -> "), e["dst"], F.lit(" "), e["type"])
    return graphs.select("cmd_id", F.array_join(F.concat(F.transform("nodes", node), F.transform("edges", edge)), "\n").alias("text"))
