"""Full shell tokens of a command and what follows from them: clean text, type sequence,
abstraction, placeholders.

Only the scan is a Python table function over Arrow batches (it needs state); it gives one
row a command with its tokens as an array, and all else is expressions over that array, so
nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import spread
from .shell import paired_end, quoted_end

#: The token types, and the placeholders of a transformed command.
TYPES = (
    "COMMAND", "ARGUMENT", "PIPE", "REDIRECT_IN", "REDIRECT_OUT", "REDIRECT_ERR", "REDIRECT_APPEND", "SEMICOLON", "AND", "OR", "SUBSHELL_START", "SUBSHELL_END", "END",
    "VARIABLE", "VARIABLE_QUOTED", "SPECIAL_VAR", "GLOB", "SUBSHELL", "ARITHMETIC", "PROCESS_SUB", "HEREDOC", "HERESTRING",
)
VARIABLE_TEXT, PATTERN_TEXT, SUBSHELL_TEXT = "VAR_VALUE", "FILE_PATTERN", "TEMP_FILE"
SEPARATORS = ("PIPE", "SEMICOLON", "AND", "OR")
REDIRECTS = ("REDIRECT_IN", "REDIRECT_OUT", "REDIRECT_ERR", "REDIRECT_APPEND", "HEREDOC", "HERESTRING")
GROUPS = ("SUBSHELL_START", "SUBSHELL_END")
#: Kinds of abstractions.
KINDS = ("EV", "PV", "SV", "AP", "RP", "HP", "GB", "CS", "AR", "STR", "RD")
KEYWORD_FLAGS = {"loop": {"for", "while", "until", "do", "done"}, "conditional": {"if", "then", "elif", "else", "fi"}, "case": {"case", "esac"}}

_TARGET = r"(?:&(?:\d+|-)?)?"
#: Tokens that a pattern can say, tried in this order at each place.
_RULES = tuple(
    (kind, re.compile(rule, re.S))
    for kind, rule in (
        ("ARGUMENT", r"'[^']*'?"),
        ("VARIABLE", r"\$\{[^{}]+\}|\$[A-Za-z_][A-Za-z0-9_]*"),
        ("SPECIAL_VAR", r"\$[0-9#?$!@*-]"),
        ("SUBSHELL", r"`[^`]*`?"),
        ("HERESTRING", r"<<<"),
        ("HEREDOC", r"<<-?[ \t]*([\"']?)(\w+)\1(?:[^\n]*?\n(?:[^\n]*\n)*?\t*\2(?=\n|\Z))?"),
        ("REDIRECT_APPEND", rf"(?:\d+\s*|&)?>>{_TARGET}"),
        ("REDIRECT_ERR", rf"\d+\s*>{_TARGET}"),
        ("REDIRECT_OUT", rf"&?>{_TARGET}"),
        ("REDIRECT_IN", rf"(?:\d+\s*)?<{_TARGET}"),
        ("OR", r"\|\|"), ("PIPE", r"\|"), ("AND", r"&&?"), ("SEMICOLON", r";"),
        ("SUBSHELL_START", r"\("), ("SUBSHELL_END", r"\)"),
        ("GLOB", r"\[[!^]?(?:\\.|[^\]\s|;&<>()])*\]"),
        ("ARGUMENT", r"\[(?:\\.|[^\s|;&<>()\]])*"),
        ("WORD", r"(?:\\.|[^\s|;&<>()\[$\"'`\\])+|[$\\]"),
    )
)
_EXPANSION = re.compile(r"(?<!\\)(?:\\\\)*(?:\$[A-Za-z0-9_{(#?$!@*-]|`)")


def scan(s: str) -> list[tuple[str, str, int]] | None:
    """(type, text, start) of every token; None if the text is not printable or a brace is not closed."""
    if re.search(r"[^\t\n\x0b\x0c\r\x20-\x7e]", s):
        return None
    out, i, first = [], 0, True
    while i < len(s):
        if s[i].isspace():
            i += 1
            continue
        if s[i] == '"':
            end = quoted_end(s, i)
            kind = "VARIABLE_QUOTED" if _EXPANSION.search(s, i + 1, end) else "ARGUMENT"
        elif s.startswith(("$(", "<(", ">("), i):
            end = paired_end(s, i + 1)
            kind = "PROCESS_SUB" if s[i] != "$" else "ARITHMETIC" if s.startswith("$((", i) and s[:end].endswith("))") else "SUBSHELL"
        else:
            if s.startswith("${", i) and not _RULES[1][1].match(s, i):
                return None
            kind, m = next((k, m) for k, rule in _RULES if (m := rule.match(s, i)))
            end = m.end()
        text = s[i:end]
        if kind == "WORD":
            kind = "GLOB" if re.search(r"(?<!\\)[*?]", text) else "COMMAND" if first else "ARGUMENT"
        first = kind in SEPARATORS or (first and (kind in REDIRECTS or kind in GROUPS))
        out.append((kind, text, i))
        i = end
    return out


def _rows(s: str) -> tuple[str | None, list[dict]]:
    """(error, tokens). A token's stage counts the commands before it; its role is shell, operand or command."""
    found = scan(s)
    out, stage, wanted = [], 0, False
    for kind, text, start in found or []:
        shell = kind in SEPARATORS or kind in REDIRECTS or kind in GROUPS
        role = "shell" if shell else "operand" if wanted else "command"
        wanted = kind in REDIRECTS and kind != "HEREDOC" and text[-1] in "<>"
        out.append({"stage": stage, "type": kind, "text": text, "start": start, "role": role})
        stage += kind in SEPARATORS
    return ("EPARSE" if found is None else None), out


TOKEN = "struct<stage int, type string, text string, start int, role string>"


def tokenized(commands: DataFrame) -> DataFrame:
    """cmd_id, command, error, tokens (stage, type, text, start, role) of each command; a null one has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_rows(s) if isinstance(s, str) else (None, []) for s in b["command"]]
            yield pd.DataFrame({"cmd_id": b["cmd_id"], "command": b["command"], "error": [e for e, _ in got], "tokens": [t for _, t in got]})

    return spread(commands.select(F.col("cmd_id").cast("long").alias("cmd_id"), "command")).mapInPandas(run, f"cmd_id long, command string, error string, tokens array<{TOKEN}>")


def tokens(rows: DataFrame) -> DataFrame:
    """One row for each token of tokenized()."""
    return rows.select("cmd_id", F.posexplode("tokens").alias("idx", "t")).select("cmd_id", "idx", "t.*")


def kind_of(t: Column) -> Column:
    """The abstraction of a token (null: it stays as it is)."""
    text, kind = t["text"], t["type"]
    word = (
        F.when(text.rlike(r"(?s)\A(?:\".*\"|'.*')\z"), "STR").when(text.rlike(r"[*?]|\[.*[^\[]\z"), "GB").when(text.startswith("/"), "AP")
        .when(text.rlike(r"\A~(?:\z|/|[A-Za-z])"), "HP").when(text.rlike(r"\A\.\.?\z") | (F.contains(text, F.lit("/")) & ~text.startswith("~")), "RP")
    )
    return (
        F.when(t["role"] == "operand", "RD")
        .when(kind.isin("VARIABLE", "VARIABLE_QUOTED", "SPECIAL_VAR") & text.rlike(r"\A\$(?:[0-9]|\{[0-9]+\})"), "PV")
        .when(kind.isin("VARIABLE", "VARIABLE_QUOTED"), "EV").when(kind == "SPECIAL_VAR", "SV").when(kind == "GLOB", "GB")
        .when(kind.isin("SUBSHELL", "PROCESS_SUB"), "CS").when(kind == "ARITHMETIC", "AR").when(kind.isin("COMMAND", "ARGUMENT"), word)
    )


def _stages(of) -> Column:
    """of(tokens of a stage), for each stage in order."""
    last = F.coalesce(F.element_at(F.transform("tokens", lambda t: t["stage"]), -1), F.lit(-1))
    each = F.transform(F.sequence(F.lit(0), last), lambda k: F.filter("tokens", lambda t: t["stage"] == k))
    return F.when(F.size("tokens") > 0, F.filter(F.transform(each, of), lambda x: x.isNotNull()))


def _clean(stage: Column) -> Column:
    return F.filter(stage, lambda t: t["role"] == "command")


def type_sequence(rows: DataFrame) -> DataFrame:
    """cmd_id, sequence: each stage's literal name and its arguments' kinds; stages joined by a bar whatever
    the operator between them. Null where there is no stage."""

    def shown(t: Column, i: Column) -> Column:
        name = (i == 0) & t["type"].isin("COMMAND", "ARGUMENT")
        return F.when(name, t["text"]).when(t["text"].rlike(r"\A-."), "OPT").otherwise(F.coalesce(kind_of(t), F.lit("STR")))

    stages = _stages(lambda s: F.when(F.exists(s, lambda t: ~t["type"].isin(*SEPARATORS)), F.array_join(F.transform(_clean(s), shown), " ")))
    return rows.select("cmd_id", F.when(F.size(stages) > 0, F.array_join(stages, " | ")).alias("sequence"))


def processed(rows: DataFrame) -> DataFrame:
    """cmd_id, stage, clean, shell_tokens, pipe_in, pipe_out, redirects, error_redirect, variables, globs, subshells,
    arithmetic, loop, conditional, case, dangerous: one row a stage. The keyword flags are the whole command's."""
    has = lambda s, *kinds: F.exists(s, lambda t: t["type"].isin(*kinds))
    one = lambda s: F.struct(
        F.array_join(F.transform(_clean(s), lambda t: t["text"]), " ").alias("clean"),
        F.filter(s, lambda t: t["role"] == "shell").alias("shell_tokens"),
        has(s, "PIPE").alias("pipe_out"), has(s, *REDIRECTS).alias("redirects"), has(s, "REDIRECT_ERR").alias("error_redirect"),
        has(s, "VARIABLE", "VARIABLE_QUOTED", "SPECIAL_VAR").alias("variables"), has(s, "GLOB").alias("globs"), has(s, "SUBSHELL", "PROCESS_SUB").alias("subshells"), has(s, "ARITHMETIC").alias("arithmetic"),
    )
    plain = F.transform(F.filter("tokens", lambda t: t["type"].isin("COMMAND", "ARGUMENT")), lambda t: t["text"])
    flags = [F.arrays_overlap(plain, F.array(*map(F.lit, sorted(w)))).alias(k) for k, w in KEYWORD_FLAGS.items()]
    kept = _stages(lambda s: F.when(F.exists(s, lambda t: ~t["type"].isin(*SEPARATORS)), one(s)))
    out = rows.withColumn("_all", kept).select("cmd_id", *flags, "_all", F.posexplode("_all").alias("stage", "s"))
    out = out.select("cmd_id", "stage", "s.*", *KEYWORD_FLAGS, F.coalesce(F.get("_all", F.col("stage") - 1)["pipe_out"], F.lit(False)).alias("pipe_in"))
    return out.withColumn("dangerous", (F.size("shell_tokens") > 0) | F.col("pipe_in") | F.col("subshells"))


def transformed(rows: DataFrame) -> DataFrame:
    """cmd_id, stage, transformed, changed: each stage with placeholders for what the shell would fill in."""
    filled = lambda t: (
        F.when(t["type"].isin("VARIABLE", "VARIABLE_QUOTED", "SPECIAL_VAR", "ARITHMETIC"), VARIABLE_TEXT).when(t["type"] == "GLOB", PATTERN_TEXT).when(t["type"].isin("SUBSHELL", "PROCESS_SUB"), SUBSHELL_TEXT)
    )
    body = lambda s: F.filter(s, lambda t: ~t["type"].isin(*SEPARATORS))
    one = lambda s: F.when(
        F.size(body(s)) > 0,
        F.struct(F.array_join(F.transform(body(s), lambda t: F.coalesce(filled(t), t["text"])), " ").alias("transformed"), F.exists(body(s), lambda t: filled(t).isNotNull()).alias("changed")),
    )
    return rows.select("cmd_id", F.posexplode(_stages(one)).alias("stage", "s")).select("cmd_id", "stage", "s.*")


def abstracted(rows: DataFrame) -> DataFrame:
    """cmd_id, command, abstracted, elements (kind, name, original, start, end), kinds, redirects."""
    items = F.transform("tokens", lambda t: F.struct(F.when(t["role"] != "shell", kind_of(t)).alias("kind"), t["text"].alias("original"), t["start"].alias("start"), (t["start"] + F.length(t["text"])).alias("end")))
    out = rows.withColumn("_e", F.filter(items, lambda e: e["kind"].isNotNull()))
    nth = lambda e, i: F.size(F.filter(F.slice("_e", 1, i + 1), lambda x: x["kind"] == e["kind"]))
    out = out.withColumn("elements", F.transform("_e", lambda e, i: F.struct(e["kind"].alias("kind"), F.concat(F.lit("$"), e["kind"], F.lit("_"), nth(e, i)).alias("name"), e["original"].alias("original"), e["start"].alias("start"), e["end"].alias("end"))))
    rest = lambda e, i: F.coalesce(F.get("elements", i + 1)["start"], F.length("command")) - e["end"]
    parts = F.transform("elements", lambda e, i: F.concat(e["name"], F.substring(F.col("command"), e["end"] + 1, rest(e, i))))
    head = F.substring(F.col("command"), F.lit(1), F.coalesce(F.get("elements", F.lit(0))["start"], F.length("command")))
    return out.select(
        "cmd_id", "command", F.concat(head, F.array_join(parts, "")).alias("abstracted"), "elements", F.array_distinct(F.transform("elements", lambda e: e["kind"])).alias("kinds"),
        F.exists("tokens", lambda t: t["type"].isin(*REDIRECTS)).alias("redirects"),
    )


def flags(rows: DataFrame) -> DataFrame:
    """cmd_id and twelve booleans of abstracted()."""
    has = lambda *kinds: F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))
    named = {
        "variables": ("EV", "PV", "SV"), "positional": ("PV",), "special": ("SV",), "paths": ("AP", "RP", "HP"), "absolute": ("AP",), "relative": ("RP",), "home": ("HP",),
        "globs": ("GB",), "substitutions": ("CS",), "arithmetic": ("AR",), "strings": ("STR",),
    }
    return rows.select("cmd_id", *(has(*v).alias(k) for k, v in named.items()), "redirects")


def expanded(rows: DataFrame, env: Column, cwd: Column, home: Column) -> DataFrame:
    """cmd_id, name, original, expanded: elements of abstracted() with variables from a map, ~ as home and relative
    paths behind cwd (not normalised); null where nothing is known."""
    one = rows.select("cmd_id", env.alias("_env"), cwd.alias("_cwd"), home.alias("_home"), F.explode("elements").alias("e")).select("*", "e.*")
    variable = F.regexp_extract("original", r"\A\"?\$\{?([A-Za-z0-9_]+)\}?\"?\z", 1)
    tail = F.substring(F.col("original"), F.lit(2), F.length("original"))
    own = F.col("original").rlike(r"\A~(?:/|\z)")
    value = (
        F.when(F.col("kind").isin("EV", "PV", "SV"), F.try_element_at("_env", variable)).when(F.col("kind") == "AP", F.col("original"))
        .when((F.col("kind") == "HP") & own, F.concat("_home", tail)).when(F.col("kind") == "RP", F.concat("_cwd", F.lit("/"), "original"))
    )
    return one.select("cmd_id", "name", "original", value.alias("expanded"))
