"""The gate: verdicts on commands from features, graph, deny and allow patterns and risk rules.

Advisory only, not a security boundary. Unless parity is asked for, cd and the substitutions of
assignments are evaluated like everything else; parity leaves them out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shell import FEATURE_BITS, REJECTED, feature_names, graph_edges, graph_nodes, graphs, subcommands
from ..functions.tokens import tokenized, type_sequence
from ..llm._shared import written
from . import anomaly, policy
from .violations import found


def rejected(commands: DataFrame, mask: tuple[str, ...] = REJECTED) -> DataFrame:
    """cmd_id, reason: parse errors and features of the mask, of the first sub-command that has one."""
    subs = subcommands(commands)
    bits = F.col("features").bitwiseAND(sum(FEATURE_BITS[n] for n in mask))
    first = F.min(F.when(bits != 0, F.struct("idx", bits.alias("bits"))))
    rows = subs.groupBy("cmd_id").agg(F.max(F.when(F.col("error") == "EPARSE", True)).alias("bad"), first.alias("x"))
    reason = F.when(F.col("bad"), "parse error").when(F.col("x").isNotNull(), F.concat(F.lower(F.split_part(feature_names(F.col("x.bits")), F.lit(" "), F.lit(1))), F.lit(" not allowed")))
    return rows.select("cmd_id", reason.alias("reason")).filter("reason is not null")


def evaluate(commands: DataFrame, allow: DataFrame, deny: DataFrame, *, mask=REJECTED, mode: str = "ALL", parity: bool = False) -> DataFrame:
    """cmd_id, verdict, reason, flags, evaluated (sub-commands looked at)."""
    # Several steps read each: what Python parses is written once.
    no = written(rejected(commands, mask), "rejected")
    g = written(graphs(commands.join(no, "cmd_id", "left_anti"), parity), "graphs")
    nodes = graph_nodes(g).filter((F.col("kind") == "CMD") & (F.size("tokens") > 0))
    subs = nodes.select("cmd_id", F.col("node_id").alias("idx"), F.array_join("tokens", " ").alias("command"))
    # The same sub-command is matched once, however often it occurs.
    texts = subs.select("command").distinct().select(F.col("command").alias("cmd_id"), "command")
    said = policy.verdicts(texts, allow, deny).withColumnRenamed("cmd_id", "command")
    each = policy.evaluated(subs.join(said, "command"), mode)
    subst = graph_edges(g).filter(F.col("type") == "SUBST").select("cmd_id").distinct().withColumn("subst", F.lit(True))
    fold = each.groupBy("cmd_id").agg(F.count(F.lit(1)).alias("evaluated"), F.bool_or(F.col("verdict") == "DENY").alias("denied"), F.bool_and(F.col("verdict") == "ALLOW").alias("allowed"))
    rows = found(g).select("cmd_id", "error", "flags").join(fold, "cmd_id", "left").join(subst, "cmd_id", "left")
    verdict = F.when(F.col("error") == "ETRUNC", "UNDETERMINED").when(F.col("error").isNotNull(), "REJECT").when(F.col("denied"), "DENY").when(F.coalesce("allowed", F.lit(True)), F.when(F.col("subst"), "ALLOW_CONDITIONAL").otherwise("ALLOW")).otherwise("UNDETERMINED")
    done = rows.select("cmd_id", verdict.alias("verdict"), F.when(F.col("error").isNotNull() & (F.col("error") != "ETRUNC"), "depgraph error").alias("reason"), F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("evaluated", F.lit(0)).alias("evaluated"))
    return done.unionByName(no.select("cmd_id", F.lit("REJECT").alias("verdict"), "reason", F.lit(0).alias("flags"), F.lit(0).cast("long").alias("evaluated")))


def sequences(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, typed), each seq, pos, w: the names of a command's sub-commands, and the words of its type sequence. They
    are written, as models and scores read them many times."""
    nodes = graph_nodes(graphs(commands)).filter((F.col("kind") == "CMD") & (F.size("tokens") > 0))
    raw = written(nodes.select(F.col("cmd_id").alias("seq"), F.col("node_id").alias("pos"), F.col("tokens")[0].alias("w")), "raw")
    shown = type_sequence(tokenized(commands)).select(F.col("cmd_id").alias("seq"), F.posexplode(F.filter(F.split("sequence", " "), lambda x: x != "")).alias("pos", "w"))
    return raw, written(shown.join(raw.select("seq").distinct(), "seq", "left_semi"), "typed")


def anomaly_scores(commands: DataFrame, raw: dict[int, DataFrame], typed: dict[int, DataFrame], *, w_raw: float = 0.5, w_type: float = 0.5, threshold: float = 10.0, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """cmd_id, raw, typed, score, anomalous: mean bits of both sequences under given models and their weighted sum;
    null stands for infinity, which is anomalous. A command without sub-commands has no row. read: the commands'
    sequences(), where they are there."""
    one, two = read or sequences(commands)
    rows = anomaly.scores(one, raw).withColumnRenamed("score", "raw").join(anomaly.scores(two, typed).withColumnRenamed("score", "typed"), "seq", "left")
    score = anomaly.combine(F.col("raw"), F.col("typed"), w_raw, w_type)
    return rows.select(F.col("seq").alias("cmd_id"), "raw", "typed", score.alias("score"), F.coalesce(score > threshold, F.lit(True)).alias("anomalous"))
