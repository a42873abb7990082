"""Offers for unmatched commands, variants of a token, model files and graph checks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cmdlake.functions import classify, entropy, lattice, shell
from cmdlake.operators import anomaly, gate, learner, policy, suggest
from cmdlake.sources import models


def commands(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "cmd_id long, command string")


def offers(spark, rules, *texts):
    parsed = policy.parse(spark.createDataFrame([(p,) for p in rules], "pattern string"))
    return [tuple(r)[:5] for r in suggest.unmatched(commands(spark, *texts), parsed).orderBy("cmd_id", "idx").collect()]


def test_unmatched(spark):
    docker = ["docker run -d nginx", "docker run -it ubuntu", "docker run --rm alpine"]
    got = offers(spark, docker, "docker exec -it container", "docker run -d nginx", "ls -l", "pwd", "", None)
    assert got == [
        (0, 0, "docker exec -it container", "docker run --rm alpine", 0.25), (0, 1, "docker exec #sopt container", None, 0.25),
        (2, 0, "ls -l", None, 0.0), (2, 1, "ls #sopt", None, 0.0), (3, 0, "pwd", None, 0.0),
    ]
    # A wildcard of the right type but other metadata: the second offer widens that token.
    assert offers(spark, ["dd #size.MiB of"], "dd 10KiB of") == [(0, 0, "dd 10KiB of", "dd #size.MiB of", 1 / 3), (0, 1, "dd #size", "dd #size.MiB of", 1 / 3)]
    assert offers(spark, [], "ls") == [(0, 0, "ls", None, 0.0)]


def test_token_variants(spark):
    rows = spark.createDataFrame([("git log", ), ("cat /etc/passwd",), ("cat #path",)], "pattern string")
    got = {}
    for r in suggest.token_variants(rows, 1).orderBy("pattern", "idx").collect():
        got.setdefault(r.pattern, []).append(r.symbol)
    assert got["git log"] == ["log", "*"]
    assert got["cat /etc/passwd"][:2] == ["/etc/passwd", lattice.SYMBOLS["ABS_PATH"]] and got["cat /etc/passwd"][-1] == "*"
    assert got["cat #path"][:2] == ["#path", lattice.SYMBOLS["PATH"]]
    assert suggest.token_variants(rows, 7).count() == 0
    for t in lattice.TYPES:
        steps = suggest.chain(t)
        assert steps[-1] == "ANY" and all(lattice.compatible(a, b) for a, b in zip(steps, steps[1:]))


def test_learner_file(spark, tmp_path):
    counts = learner.prefix_counts(commands(spark, "git log", "git log", "git status", "ls"))
    models.save_learner(counts, f"{tmp_path}/a")
    assert sorted(map(str, models.load_learner(spark, f"{tmp_path}/a").collect())) == sorted(map(str, counts.select("prefix", "depth", "n", "ends").collect()))
    models.save_learner(counts.withColumn("n", F.col("n") + (F.col("depth") == 2).cast("int")), f"{tmp_path}/b")
    with pytest.raises(ValueError):
        models.load_learner(spark, f"{tmp_path}/b")


def test_bundle(spark, tmp_path):
    events = spark.createDataFrame([(1, i, w) for i, w in enumerate("abcdabcd")], "seq long, pos int, w string")
    of = anomaly.model(events)
    models.save_bundle(of, of, str(tmp_path))
    raw, typed = models.load_bundle(spark, str(tmp_path))
    assert raw[2].count() == of[2].count() == typed[2].count()
    of[1].limit(1).write.mode("overwrite").parquet(f"{tmp_path}/typed/order=1")
    with pytest.raises(ValueError):
        models.load_bundle(spark, str(tmp_path))


def test_graphs(spark):
    g = shell.graphs(commands(spark, "A=1 cat < in | sort > out && echo $(date) x/y", "cd /tmp ; ls"))
    assert all(r.problems == [] for r in shell.graph_problems(g).collect())
    bad = g.withColumn("edges", F.transform("edges", lambda e: F.struct(e["edge_id"].alias("edge_id"), e["src"].alias("src"), F.lit(99).alias("dst"), e["type"].alias("type"))))
    assert all(len(r.problems) == r.n for r in shell.graph_problems(bad).join(bad.select("cmd_id", F.size("edges").alias("n")), "cmd_id").collect())
    text = models.graph_text(g).filter("cmd_id = 1").first().text
    assert "CMD ls" in text and "edge" in text


def times_typed(df):
    """How often the plan cuts commands into tokens."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_a_command_is_typed_once(spark):
    cmds, parsed = commands(spark, "git log", "ls -l"), policy.parse(spark.createDataFrame([("git *",), ("* -l",)], "pattern string"))
    tables = {
        "match_all": policy.match_all(cmds, parsed), "match_best": policy.match_best(cmds, parsed), "verdicts": policy.verdicts(cmds, parsed, parsed),
        "unmatched": suggest.unmatched(cmds, parsed), "learned": learner.learned(cmds),
    }
    assert {k: times_typed(v) for k, v in tables.items()} == dict.fromkeys(tables, 1)


def test_unmatched_of_repeated_and_null_ids(spark):
    rules = policy.parse(spark.createDataFrame([("git log",), ("ls #sopt",)], "pattern string"))
    rows = [(1, "git show"), (1, "git show"), (2, "git log"), (2, "git show"), (None, "ls -l"), (None, "git x"), (3, "")]
    got = sorted(map(str, (tuple(r) for r in suggest.unmatched(spark.createDataFrame(rows, "cmd_id long, command string"), rules).filter("idx = 0").collect())))
    assert got == sorted(map(str, [(1, 0, "git show", "git log", 0.5)] * 2 + [(None, 0, "ls -l", None, 0.0), (None, 0, "git x", None, 0.0)]))


def test_types_by_shape(spark):
    """The recognisers left out for a shape of token know none of that shape."""
    r = random.Random(5)
    tokens = {"".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for letters in ("-a1", "0123456789-", "0123456789abcdefx", "abcdefABCDEF_", "019KMGTiBbsmhdnu", "-aZ9_") for _ in range(300)}
    tokens |= {w for x in (classify.SIGNALS, classify.METHODS, classify.REFS, classify.USERS, classify.ALGORITHMS) for w in x} | {"SIGTERM", "_", "-", "--", "--0", "a\n", "-a\n", "é", "2024"}
    rows = spark.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    plain = classify.cascade(F.col("t"), F.when(F.col("t").isNull(), F.lit(None).cast("string")))
    assert rows.select("t", classify.token_type(F.col("t")).alias("a"), plain.alias("b")).filter("a <> b").collect() == []


def test_entropies_of_the_screen_are_computed_once(spark):
    env = spark.createDataFrame([("API_KEY", "sk-abcdef1234567890abcdef"), ("A", None), ("B", "é日本語パスワード"), ("C", "")], "name string, value string")
    plan = entropy.screen(env)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 2  # without the prefix, and whole


def test_ratios_of_one_length_are_measured_together():
    texts = [None, "", "x", "é", "a" * 20, "ab" * 8] + ["".join(random.Random(i).choice("abcXYZ019-") for _ in range(i % 40)) for i in range(200)]
    many = entropy.permutation_ratios.func(pd.Series(texts, dtype=object))
    one = pd.concat([entropy.permutation_ratios.func(pd.Series([t], dtype=object)) for t in texts], ignore_index=True)
    pd.testing.assert_frame_equal(many, one)
    assert many.isna().all(axis=1).tolist() == [t is None for t in texts]
    assert len(entropy._entropies(np.zeros((3, 5), int))) == 3 and entropy._entropies(np.arange(8)[None])[0] == 3.0


def test_the_gate_parses_once(spark, monkeypatch):
    """Models and scores read written sequences, and verdicts written graphs."""
    seen, many = [], commands(spark, "ls | sort", "cd /tmp ; ls", "cat a")
    monkeypatch.setattr(gate, "graphs", lambda *x: seen.append("graph") or shell.graphs(*x))
    raw, typed = gate.sequences(many)
    scored = gate.anomaly_scores(many, anomaly.model(raw), anomaly.model(typed), read=(raw, typed))
    assert seen == ["graph"] and scored.count() == 3
    rules = policy.parse(spark.createDataFrame([("ls",), ("cat *",)], "pattern string"))
    for df in (scored, gate.evaluate(many, rules, rules)):
        assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert shell.graphs(many).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
