"""Shell text: sub-command ranges, tokens, abstraction and the dependency graph.

Lexing needs a scan with state, so these are Python table functions over Arrow batches;
what follows from their rows is done with built-in functions and joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import spread

#: Bits of what precedes a sub-command and of what is in it.
TYPE_BITS = {"PIPELINE": 1 << 8, "AND": 1 << 9, "OR": 1 << 10, "SEMICOLON": 1 << 11, "HEREDOC": 1 << 12, "HERESTRING": 1 << 13, "SUBSTITUTION": 1 << 14}
FEATURE_BITS = {"VARS": 1, "GLOBS": 2, "SUBSHELL": 4, "ARITH": 8, "HEREDOC": 16, "HERESTRING": 32, "PROCESS_SUB": 64, "LOOPS": 128, "CONDITIONALS": 256, "CASE": 512, "SUBSHELL_FILE": 1024, "PIPELINE": 2048}
#: Limits that change results, and the features that a gate rejects unless told otherwise.
MOST_SUBCOMMANDS, MOST_NODES, MOST_EDGES, MOST_TOKENS, MOST_DEPTH = 64, 128, 256, 32, 16
REJECTED = ("ARITH", "HEREDOC", "HERESTRING", "LOOPS", "CONDITIONALS", "CASE")
KEYWORDS = {"LOOPS": {"while", "until", "for"}, "CONDITIONALS": {"if", "then", "elif", "else", "fi"}, "CASE": {"case", "in", "esac"}}
_SEPARATORS = (("&&", "AND"), ("||", "OR"), ("|", "PIPELINE"), (";", "SEMICOLON"), ("\n", "SEMICOLON"), ("\r", "SEMICOLON"))


class ParseError(ValueError):
    pass


def quoted_end(s: str, i: int) -> int:
    """The place after the quoted text, escape or single character at i; an open quote runs to the end."""
    if s[i] == "\\":
        return min(i + 2, len(s))
    if s[i] == "'":
        j = s.find("'", i + 1)
        return len(s) if j < 0 else j + 1
    if s[i] == '"':
        j = i + 1
        while j < len(s) and s[j] != '"':
            j += 2 if s[j] == "\\" else 1
        return min(j + 1, len(s))
    return i + 1


def paired_end(s: str, i: int) -> int:
    """The place after the parenthesis that closes the one at i, quotes skipped."""
    depth, j = 0, i
    while j < len(s):
        if s[j] in "\"'\\":
            j = quoted_end(s, j)
            continue
        depth += (s[j] == "(") - (s[j] == ")")
        j += 1
        if not depth:
            return j
    return len(s)


def features_of(text: str) -> int:
    """Bits of what stands in a sub-command; single quotes and escapes hide everything, double quotes globs and keywords."""
    bits, i, plain, double = 0, 0, [], False
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if c == "\\" or (c == "'" and not double):
            i = quoted_end(text, i)
            plain.append(" ")
            continue
        if c == '"':
            double = not double
        elif text.startswith("$((", i) or (two == "((" and not double):
            bits |= FEATURE_BITS["ARITH"] | (FEATURE_BITS["VARS"] if re.match(r"\$\(\([A-Za-z_]", text[i:]) else 0)
        elif two == "$(":
            bits |= FEATURE_BITS["SUBSHELL"] | (FEATURE_BITS["SUBSHELL_FILE"] if re.match(r"\$\(\s*<", text[i:]) else 0)
        elif c == "`":
            bits |= FEATURE_BITS["SUBSHELL"]
        elif c == "$" and re.match(r"\$[A-Za-z0-9_{#?$!@*-]", text[i:]):
            bits |= FEATURE_BITS["VARS"]
        elif not double and two in ("<(", ">("):
            bits |= FEATURE_BITS["PROCESS_SUB"]
        elif not double and (c in "*?" or (c == "[" and "]" in text[i + 1 :])):
            bits |= FEATURE_BITS["GLOBS"]
        plain.append(" " if double or c == '"' else c)
        i += 3 if text.startswith("$((", i) else 2 if two in ("$(", "((", "<(", ">(") else 1
    words = set(re.findall(r"[A-Za-z0-9_]+", "".join(plain)))
    return bits | sum(FEATURE_BITS[k] for k, names in KEYWORDS.items() if words & names)


def parse_fast(s: str, strict: bool = True, most: int = MOST_SUBCOMMANDS) -> tuple[str | None, list[tuple[int, int, int, int]]]:
    """(error, [(start, length, type bits, feature bits)]). Parentheses do not protect separators; process substitutions do."""
    if re.search(r"[^\t\n\x0b\x0c\r\x20-\x7e]", s):
        return "EPARSE", []
    ranges, start, kind, i, arithmetic, tail, last = [], 0, 0, 0, 0, "", ""

    def close(end: int) -> None:
        text = s[start:end]
        lead = len(text) - len(text.lstrip())
        if text.strip():
            ranges.append((start + lead, len(text.strip()), kind, features_of(text.strip())))

    while i < len(s):
        c = s[i]
        if c in "\"'\\":
            end = quoted_end(s, i)
            if strict and c != "\\" and (end == len(s) and (s[-1] != c or end - i < 2)):
                return "EPARSE", []
            i, last = end, "w"
        elif s.startswith("${}", i):
            return "EPARSE", []
        elif s.startswith("$((", i) or s.startswith("((", i):
            arithmetic, i, last = arithmetic + 1, i + (3 if c == "$" else 2), "w"
        elif arithmetic and s.startswith("))", i):
            arithmetic, i = arithmetic - 1, i + 2
        elif s[i : i + 2] in ("<(", ">(") and not arithmetic:
            if ranges:  # the range before it is marked as well
                ranges[-1] = (*ranges[-1][:3], ranges[-1][3] | FEATURE_BITS["PROCESS_SUB"])
            kind = kind or TYPE_BITS["SUBSTITUTION"]
            i, last = paired_end(s, i + 1), "w"
        elif not arithmetic and s.startswith("<<", i):
            here = s.startswith("<<<", i)
            # A here-document's range is its operator and delimiter; the lines below are ranges of their own.
            m = re.match(r"<<<\s*[^\s|;&<>]+" if here else r"<<\s*[^\s;]+", s[i:])
            if not m:
                return "EPARSE", []
            close(i)
            end = i + m.end()
            ranges.append((i, end - i, TYPE_BITS["HERESTRING" if here else "HEREDOC"], FEATURE_BITS["HERESTRING" if here else "HEREDOC"]))
            start, kind, i, last = end, 0, end, "w"
        elif not arithmetic and c in "<>":
            i += len(re.match(r"[<>]{1,2}[&|]?", s[i:])[0])
            if not re.match(r"[ \t]*[^\s|;&<>]", s[i:]):
                return "EPARSE", []
        elif not arithmetic and (found := next(((op, name) for op, name in _SEPARATORS if s.startswith(op, i)), None)):
            close(i)
            kind, tail = TYPE_BITS[found[1]], found[0]
            i += len(found[0])
            start, last = i, ""
        else:
            last = last if c.isspace() else "&" if c == "&" and not s[:i].rstrip().endswith((">", "<")) else "w"
            i += 1
    before = len(ranges)
    close(len(s))
    if s.strip() and (not ranges or (len(ranges) == before and tail in ("|", "&&", "||")) or last == "&"):
        return "EPARSE", []
    if strict and (arithmetic or s.count("`") % 2 or re.search(r"\$\{[^}]*\Z", s)):
        return "EPARSE", []
    words = re.findall(r"[A-Za-z0-9_]+", re.sub(r"'[^']*'|\"[^\"]*\"", " ", s))
    for first, then, end in (("case", "in", "esac"), ("for", "do", "done"), ("while", "do", "done"), ("until", "do", "done"), ("if", "then", "fi")):
        if words[:1] == [first] and then in words and end not in words:
            return "EPARSE", []
    ranges = [(a, n, TYPE_BITS["SUBSTITUTION"] if k == 0 and f & FEATURE_BITS["SUBSHELL"] else k, f) for a, n, k, f in ranges]
    piped = [i for i, r in enumerate(ranges) if r[2] == TYPE_BITS["PIPELINE"]]
    for i in {*piped, *(j - 1 for j in piped)} - {-1}:
        a, n, k, f = ranges[i]
        ranges[i] = (a, n, k, f | FEATURE_BITS["PIPELINE"])
    return ("ETRUNC", ranges[:most]) if len(ranges) > most else (None, ranges)


def shell_words(text: str) -> list[str]:
    """Words and redirects of one sub-command; quotes and substitutions stay in their word."""
    out, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        if m := re.match(r"(?:\d+)?(?:&>>|&>|>>|>&|<&|>\||>|<)(?:&?-|&?\d+(?=\s|\Z))?|\d+(?=[<>])(?:>>|>|<)", text[i:]):
            if not re.match(r"[<>]\(", text[i:]):
                out.append(m[0])
                i += m.end()
                continue
        j = i
        while j < len(text) and not text[j].isspace() and (text[j] not in "<>" or text[j : j + 2] in ("<(", ">(")):
            if text[j : j + 2] in ("$(", "<(", ">("):
                j = paired_end(text, j + 1)
            elif text[j] == "`":
                k = text.find("`", j + 1)
                j = len(text) if k < 0 else k + 1
            else:
                j = quoted_end(text, j)
        out.append(text[i : max(j, i + 1)])
        i = max(j, i + 1)
    return out


def resolve(cwd: str, path: str) -> str:
    """A path from a directory, with ., .. and // resolved."""
    out: list[str] = []
    for part in (path if path.startswith("/") else f"{cwd}/{path}").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


_ASSIGN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")
_REDIRECT = re.compile(r"(\d*)(&>>|&>|>>|>&|<&|>\||>|<)(.*)\Z", re.S)


def here_bodies(s: str, ranges: list[tuple[int, int, int, int]]) -> tuple[dict[int, str], set[int]]:
    """Per here-document's range the text of its body, and the ranges that are bodies or ends. The end is the last range
    below the operator's line that is the delimiter (without its quotes; after <<- tabs before the end do not count)."""
    bodies: dict[int, str] = {}
    gone: set[int] = set()
    for i, (start, length, kind, _) in enumerate(ranges):
        if kind != TYPE_BITS["HEREDOC"]:
            continue
        dash, quote, delimiter = re.fullmatch(r"<<(-?)(['\"]?)(.*)", re.sub(r"^<<\s+", "<<", s[start : start + length]), re.DOTALL).groups()
        delimiter, line = delimiter[:-1] if quote else delimiter, s.find("\n", start + length)
        below = [j for j in range(i + 1, len(ranges)) if j not in gone and ranges[j][0] > line >= 0]
        said = {j: s[ranges[j][0] : sum(ranges[j][:2])] for j in below}
        end = next((j for j in reversed(below) if (said[j].lstrip("\t") if dash else said[j]) == delimiter), None)
        if end is not None:
            bodies[i] = s[min(ranges[j][0] for j in below) : ranges[end][0]]
            gone |= {j for j in below if j <= end}
    return bodies, gone


def depgraph(s: str, cwd: str = "/", depth: int = 0, parity: bool = False) -> tuple[str | None, list[dict], list[tuple[int, int, str]]]:
    """(error, nodes, edges (from, to, type)). A command has tokens and cwd; a document has kind, path or name and value.

    With parity, cd makes no node and an assignment's substitution is not entered; without it both are evaluated."""
    nodes: list[dict] = []
    edges: list[tuple[int, int, str]] = []
    if depth > MOST_DEPTH:
        return "EDEPTH", nodes, edges
    error, ranges = parse_fast(_masked(s), strict=False)
    if error == "EPARSE":
        return error, nodes, edges
    previous = None

    def doc(kind: str, **more) -> int:
        nodes.append({"kind": "DOC", "doc_kind": kind, **more})
        return len(nodes) - 1

    bodies, gone = here_bodies(s, ranges)
    for at, (start, length, kind, _) in enumerate(ranges):
        text = s[start : start + length]
        if at in gone:
            continue
        if kind in (TYPE_BITS["HEREDOC"], TYPE_BITS["HERESTRING"]):
            if previous is not None:
                edges.append((doc("HEREDOC" if kind == TYPE_BITS["HEREDOC"] else "HERESTRING", value=bodies.get(at, text)), previous, "READ"))
            continue
        words, tokens, env, redirects, i = shell_words(text), [], [], [], 0
        while i < len(words):
            m = _REDIRECT.match(words[i]) if words[i][:1] not in "\"'" else None
            if m and not re.match(r"[<>]\(", words[i]):
                dup = m[2] in (">&", "<&") or re.fullmatch(r"&?(?:\d+|-)", m[3])
                if not dup and i + 1 < len(words):
                    redirects.append(("READ" if m[2] == "<" else "APPEND" if ">>" in m[2] else "WRITE", words[i + 1]))
                    i += 1
            elif not tokens and _ASSIGN.match(words[i]) and len(words[i]) >= 3:
                env.append(words[i])
            else:
                tokens.append(words[i])
            i += 1
        tokens = tokens[:MOST_TOKENS]
        if tokens[:1] == ["cd"]:
            cwd = resolve(cwd, tokens[1]) if len(tokens) > 1 else "$HOME"
            if parity and not redirects:
                continue
        if not tokens and not env and redirects and previous is not None:
            at = previous
        else:
            nodes.append({"kind": "CMD", "tokens": tokens, "cwd": cwd})
            at = len(nodes) - 1
            if previous is not None:
                name = {TYPE_BITS["PIPELINE"]: "PIPE", TYPE_BITS["AND"]: "AND", TYPE_BITS["OR"]: "OR"}.get(kind, "SEQ")
                edges.append((previous, at, name))
            previous = at
        for x in env + [t for t in tokens[1:] if tokens[:1] == ["export"] and _ASSIGN.match(t)]:
            name, _, value = x.partition("=")
            edges.append((doc("ENVVAR", name=name, value=value), at, "ENV"))
        for how, path in redirects:
            d = doc("FILE", path=path)
            edges.append((d, at, how) if how == "READ" else (at, d, how))
        for t in tokens + ([] if parity else env):
            for body in substitutions(t):
                _, inner, links = depgraph(body, cwd, depth + 1, parity)
                base = len(nodes)
                nodes += inner
                edges += [(a + base, b + base, k) for a, b, k in links]
                if last := [j for j, x in enumerate(inner) if x["kind"] == "CMD"]:
                    edges.append((base + last[-1], at, "SUBST"))
        for t in tokens[1:]:
            if re.search(r"[/.]", t) and not substitutions(t):
                edges.append((at, doc("FILE", path=t), "ARG"))
    if len(nodes) > MOST_NODES or len(edges) > MOST_EDGES:
        return "ETRUNC", nodes[:MOST_NODES], [e for e in edges if max(e[:2]) < MOST_NODES][:MOST_EDGES]
    return error, nodes, edges


def _masked(s: str) -> str:
    """Substitutions with their bodies blanked, so that the level around them can be cut at its own separators."""
    out, i = list(s), 0
    while i < len(s):
        if s[i] in "'\\":
            i = quoted_end(s, i)
        elif s[i : i + 2] == "$(" and s[i : i + 3] != "$((":
            end = paired_end(s, i + 1)
            out[i + 2 : end - 1] = "x" * max(0, end - i - 3)
            i = end
        else:
            i += 1
    return "".join(out)


def substitutions(token: str) -> list[str]:
    """Bodies of the substitutions in a token, outside single quotes."""
    out, i = [], 0
    while i < len(token):
        if token[i] in "'\\":
            i = quoted_end(token, i)
        elif token[i : i + 2] in ("$(", "<(", ">(") and token[i : i + 3] != "$((":
            end = paired_end(token, i + 1)
            out.append(token[i + 2 : end - 1])
            i = end
        elif token[i] == "`":
            end = token.find("`", i + 1)
            end = len(token) if end < 0 else end
            out.append(token[i + 1 : end])
            i = end + 1
        else:
            i += 1
    return out


def _table(df: DataFrame, of, schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *row) for i, s in zip(b["cmd_id"], b["command"]) if isinstance(s, str) for row in of(s)], columns=["cmd_id", *names])

    return spread(df.select(F.col("cmd_id").cast("long").alias("cmd_id"), "command")).mapInPandas(run, f"cmd_id long, {schema}")


def subcommands(commands: DataFrame, strict: bool = True) -> DataFrame:
    """cmd_id, idx, start, len, type, features, error: one row for each sub-command; one with idx -1 for an error or no sub-command."""

    def of(s: str):
        error, ranges = parse_fast(s, strict)
        return [(i, *r, error) for i, r in enumerate(ranges)] or [(-1, 0, 0, 0, 0, error)]

    return _table(commands, of, "idx int, start int, len int, type int, features int, error string", ["idx", "start", "len", "type", "features", "error"])


def graphs(commands: DataFrame, parity: bool = False) -> DataFrame:
    """cmd_id, error, nodes, edges: the dependency graph of each command."""

    def of(s: str):
        error, nodes, edges = depgraph(s, parity=parity)
        rows = [(i, n["kind"], n.get("doc_kind"), n.get("tokens"), n.get("path"), n.get("name"), n.get("value"), n.get("cwd")) for i, n in enumerate(nodes)]
        return [(error, rows, [(i, *e) for i, e in enumerate(edges)])]

    node = "struct<node_id int, kind string, doc_kind string, tokens array<string>, path string, name string, value string, cwd string>"
    keys = ["node_id", "kind", "doc_kind", "tokens", "path", "name", "value", "cwd"]
    named = lambda s: [(e, [dict(zip(keys, n)) for n in ns], [dict(zip(["edge_id", "src", "dst", "type"], x)) for x in es]) for e, ns, es in of(s)]
    return _table(commands, named, f"error string, nodes array<{node}>, edges array<struct<edge_id int, src int, dst int, type string>>", ["error", "nodes", "edges"])


def graph_nodes(g: DataFrame) -> DataFrame:
    return g.select("cmd_id", F.explode("nodes").alias("n")).select("cmd_id", "n.*")


def graph_edges(g: DataFrame) -> DataFrame:
    return g.select("cmd_id", F.explode("edges").alias("e")).select("cmd_id", "e.*")


def has_bits(bits: Column, names: tuple[str, ...]) -> Column:
    return bits.bitwiseAND(sum(FEATURE_BITS[n] for n in names)) != 0


def feature_names(bits: Column) -> Column:
    """Names of the bits in order, or none."""
    found = F.array_join(F.array_compact(F.array(*(F.when(bits.bitwiseAND(b) != 0, n) for n, b in FEATURE_BITS.items()))), " ")
    return F.when(bits == 0, "none").otherwise(found)


#: What kinds of nodes an edge may join, as from>to.
ENDS = {
    **dict.fromkeys(("PIPE", "SEQ", "AND", "OR", "SUBST", "CWD"), ("CMD>CMD",)), **dict.fromkeys(("READ", "ENV"), ("DOC>CMD",)), **dict.fromkeys(("WRITE", "APPEND"), ("CMD>DOC",)),
    "ARG": ("CMD>DOC", "DOC>CMD"),
}
MOST_PROBLEMS = 16


def graph_problems(g: DataFrame) -> DataFrame:
    """cmd_id, problems: nodes without a directory and edges that end nowhere or join the wrong kinds; at most 16 of a graph."""
    ends = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in ENDS.items() for x in kv])
    kind = lambda i: F.get("nodes", i)["kind"]
    node = lambda n: F.when((n["kind"] == "CMD") & n["cwd"].isNull(), F.concat(F.lit("node "), n["node_id"], F.lit(" has no directory")))

    def edge(e: Column) -> Column:
        name = F.concat(F.lit("edge "), e["edge_id"])
        pair = F.concat(kind(e["src"]), F.lit(">"), kind(e["dst"]))
        return F.when(pair.isNull(), F.concat(name, F.lit(" ends nowhere"))).when(~F.coalesce(F.array_contains(F.try_element_at(ends, e["type"]), pair), F.lit(False)), F.concat(name, F.lit(" joins "), pair, F.lit(" by "), e["type"]))

    found = F.concat(F.array_compact(F.transform("nodes", node)), F.array_compact(F.transform("edges", edge)))
    return g.select("cmd_id", F.slice(found, 1, MOST_PROBLEMS).alias("problems"))
