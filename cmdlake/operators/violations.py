"""Risk rules over dependency graphs. Graphs never cross commands, so each rule is an expression
over the arrays of one row: no join of edges moves any row, and no command is hotter than itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default lists of the rules.
WRITE_PATHS = "/bin/ /boot/ /etc/ /lib/ /proc/ /root/ /sbin/ /sys/ /usr/lib/ /var/lib/".split()
SYSTEM_DIRS = "/bin /boot /etc /lib /opt /proc /root /sbin /sys /usr /usr/lib /var /var/lib".split()
ENV_NAMES = "BASH_ENV ENV IFS LD_DEBUG LD_LIBRARY_PATH LD_PRELOAD PATH".split()
PRIVILEGED = "crontab passwd scp ssh su sudo".split()
READ_PATHS = "/etc/ca-certificates /etc/gshadow /etc/shadow /etc/ssh/ /root/.ssh/".split()
DOWNLOADS, SPAWNS, PERMISSIONS = "curl wget".split(), "sh bash env perl python ruby node".split(), "chmod chown chgrp".split()
SECRET_PARTS = "/.ssh/ .env /.aws/ /.kube/ /.npmrc /.netrc /.pgpass /.gitconfig /.git-credentials /.docker/ /.vault-token /.gnupg/".split()
READERS = "cat head tail less more base64 xxd od strings hexdump".split()
UPLOADS, LISTENERS = "curl wget scp rsync".split(), "nc ncat netcat socat ngrok cloudflared".split()
PROFILES = "/.bashrc /.profile /.zshrc /.bash_profile /.ssh/authorized_keys /.ssh/config".split()
SUDO_VALUES = "-C -D -g -h -p -R -T -u -U --chdir --close-from --command-timeout --group --host --other-user --prompt --role --type --user".split()
FANOUT, MOST = 3, 16
#: Rule to (bit, severity).
RULES = {
    "WRITE_SENSITIVE": (0, 85), "REMOVE_SYSTEM": (1, 95), "PERM_SYSTEM": (2, 85), "GIT_DESTRUCTIVE": (3, 70), "ENV_PRIVILEGED": (4, 95), "SHELL_ESCALATION": (5, 95),
    "SUDO_REDIRECT": (6, 85), "PERSISTENCE": (7, 70), "WRITE_THEN_READ": (8, 70), "SUBST_SENSITIVE": (9, 85), "REDIRECT_FANOUT": (10, 50), "READ_SECRETS": (11, 70),
    "SHELL_OBFUSCATION": (12, 95), "NET_DOWNLOAD_EXEC": (13, 95), "NET_UPLOAD": (14, 85), "NET_LISTENER": (15, 85),
}


def _under(path: Column, prefixes: list[str]) -> Column:
    """Equal to a prefix, or below it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p if p.endswith("/") else p + "/")
    return F.coalesce(out, F.lit(False))


def _holds(path: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | path.contains(p)
    return F.coalesce(out, F.lit(False))


def _cmd(n: Column) -> Column:
    return F.try_element_at(n.tokens, F.lit(1))


def _rest(n: Column) -> Column:
    return F.slice(n.tokens, 2, 1 << 16)


def _is(x: Column, names: list[str]) -> Column:
    return F.coalesce(x.isin(*names), F.lit(False))


def _escalates(n: Column) -> Column:
    """sudo: the first token after its options is a shell; su: a command or a shell is given."""
    base = lambda t: F.element_at(F.split(t, "/"), -1)
    zero = F.struct(F.lit(False).alias("skip"), F.lit("").alias("cmd"), F.lit(False).alias("done"))

    def step(a: Column, t: Column) -> Column:
        option = t.startswith("-") & ~a["done"]
        return (
            F.when(a["done"] & (a["cmd"] != ""), a)
            .when(a["skip"], F.struct(F.lit(False).alias("skip"), a["cmd"].alias("cmd"), a["done"].alias("done")))
            .when(option & (t == "--"), F.struct(F.lit(False).alias("skip"), F.lit("").alias("cmd"), F.lit(True).alias("done")))
            .when(option, F.struct(t.isin(*SUDO_VALUES).alias("skip"), F.lit("").alias("cmd"), F.lit(False).alias("done")))
            .otherwise(F.struct(F.lit(False).alias("skip"), t.alias("cmd"), F.lit(True).alias("done")))
        )

    sudo = F.aggregate(_rest(n), zero, step, lambda a: base(a["cmd"]).isin(*SPAWNS))
    shell = lambda t, i: F.when(t.startswith("--shell="), F.substring(t, 9, 255)).when(t.rlike(r"\A-s."), F.substring(t, 3, 255)).when(t.isin("-s", "--shell"), F.get(_rest(n), i + 1))
    su = F.exists(_rest(n), lambda t: t.isin("-c", "--command") | t.rlike(r"\A--command=.")) | F.exists(F.transform(_rest(n), lambda t, i: F.coalesce(base(shell(t, i)).isin(*SPAWNS), F.lit(False))), lambda x: x)
    return F.when(_cmd(n) == "sudo", sudo).when(_cmd(n) == "su", su).otherwise(False)


def _uploads(n: Column) -> Column:
    option = lambda t, names: t.isin(*names) | F.coalesce(F.split_part(t, F.lit("="), F.lit(1)).isin(*names), F.lit(False))
    curl = F.exists(_rest(n), lambda t: option(t, ["--data", "--data-binary", "--data-raw", "--data-urlencode", "--form", "--upload-file"]) | t.rlike(r"\A-[dFT]"))
    wget = F.exists(_rest(n), lambda t: option(t, ["--post-file", "--post-data"]))
    last = F.when(F.size(n.tokens) > 1, F.element_at(n.tokens, -1).contains(":")).otherwise(False)
    return F.when(_cmd(n) == "curl", curl).when(_cmd(n) == "wget", wget).when(_cmd(n).isin("scp", "rsync"), last).otherwise(False)


def _listens(n: Column) -> Column:
    return (
        F.when(_cmd(n).isin("nc", "ncat", "netcat"), F.exists(_rest(n), lambda t: t.isin("-l", "--listen")))
        .when(_cmd(n) == "socat", F.exists(_rest(n), lambda t: t.rlike("LISTEN|listen")))
        .when(_cmd(n).isin("ngrok", "cloudflared"), F.size(n.tokens) >= 2)
        .otherwise(False)
    )


def _destroys(n: Column) -> Column:
    sub, rest = F.try_element_at(n.tokens, F.lit(2)), F.slice(n.tokens, 3, 1 << 16)
    bad = F.when(sub == "push", F.exists(rest, lambda t: t.isin("--force", "-f"))).when(sub == "clean", F.exists(rest, lambda t: t.isin("-x", "-fdx", "-fx"))).otherwise(sub == "filter-branch")
    return F.coalesce((_cmd(n) == "git") & bad, F.lit(False))


def found(graphs: DataFrame) -> DataFrame:
    """graphs with found: array of (rule, severity, node, detail), by rule in the order of RULES' evaluation, at most
    MOST; and flags: bits of all that were found."""
    nodes, edges = F.col("nodes"), F.col("edges")
    node = lambda i: F.get(nodes, i)
    row = lambda rule, at, detail, severity=None: F.struct(F.lit(rule).alias("rule"), F.lit(severity or RULES[rule][1]).alias("severity"), at.alias("node"), detail.alias("detail"))
    writes = lambda e: e.type.isin("WRITE", "APPEND")

    def of_edges(rule: str, on: Callable, at: Callable, detail: Callable) -> Column:
        return F.transform(F.filter(edges, lambda e: F.coalesce(on(e), F.lit(False))), lambda e: row(rule, at(e), detail(e)))

    def of_nodes(rule: str, on: Callable, detail: Callable = _cmd, severity=None) -> Column:
        some = F.filter(nodes, lambda n: (n.kind == "CMD") & (F.size(n.tokens) > 0) & F.coalesce(on(n), F.lit(False)))
        return F.transform(some, lambda n: row(rule, n.node_id, detail(n), severity))

    def has_edge(n: Column, on: Callable) -> Column:
        return F.exists(edges, lambda e: (e.src == n.node_id) & F.coalesce(on(e), F.lit(False)))

    def arg_path(n: Column, on: Callable) -> Column:
        return F.try_element_at(F.transform(F.filter(edges, lambda e: (e.src == n.node_id) & on(e)), lambda e: node(e.dst).path), F.lit(1))

    system_arg = lambda e: (e.type == "ARG") & _under(node(e.dst).path, SYSTEM_DIRS)
    reads = lambda w: F.exists(edges, lambda e: (((e.type == "READ") & (node(e.src).path == node(w.dst).path) & (e.dst >= w.src)) | ((e.type == "ARG") & (node(e.dst).path == node(w.dst).path) & (e.src >= w.src))))
    decodes = lambda n: ((_cmd(n) == "base64") & F.exists(_rest(n), lambda t: t.isin("-d", "--decode"))) | ((_cmd(n) == "openssl") & F.array_contains(_rest(n), "enc") & F.exists(_rest(n), lambda t: t.isin("-d", "--decode")))
    parts = [
        of_edges("WRITE_SENSITIVE", lambda e: writes(e) & _under(node(e.dst).path, WRITE_PATHS), lambda e: e.src, lambda e: node(e.dst).path),
        of_edges("ENV_PRIVILEGED", lambda e: (e.type == "ENV") & _is(node(e.src)["name"], ENV_NAMES) & _is(_cmd(node(e.dst)), PRIVILEGED), lambda e: e.dst, lambda e: node(e.src)["name"]),
        of_edges(
            "SUBST_SENSITIVE", lambda e: (e.type == "SUBST") & F.exists(edges, lambda r: ((r.type == "READ") & (r.dst == e.src) & _under(node(r.src).path, READ_PATHS)) | ((r.type == "ARG") & (r.src == e.src) & _under(node(r.dst).path, READ_PATHS))),
            lambda e: e.dst, lambda e: _cmd(node(e.src)),
        ),
        of_nodes("REMOVE_SYSTEM", lambda n: _cmd(n).isin("rm", "rmdir") & has_edge(n, system_arg), lambda n: arg_path(n, system_arg)),
        of_edges("WRITE_THEN_READ", lambda w: writes(w) & (node(w.dst).doc_kind == "FILE") & reads(w), lambda w: w.src, lambda w: node(w.dst).path),
        of_nodes("REDIRECT_FANOUT", lambda n: F.size(F.filter(edges, lambda e: (e.src == n.node_id) & writes(e))) > FANOUT),
        of_edges("NET_DOWNLOAD_EXEC", lambda e: (e.type == "PIPE") & _is(_cmd(node(e.src)), DOWNLOADS) & _is(_cmd(node(e.dst)), SPAWNS), lambda e: e.dst, lambda e: _cmd(node(e.dst))),
        of_nodes("PERM_SYSTEM", lambda n: _cmd(n).isin(*PERMISSIONS) & F.array_contains(_rest(n), "-R") & has_edge(n, system_arg), lambda n: arg_path(n, system_arg)),
        of_nodes("SHELL_ESCALATION", _escalates),
        of_nodes("SUDO_REDIRECT", lambda n: _cmd(n).isin("sudo", "su") & has_edge(n, writes), lambda n: F.coalesce(arg_path(n, writes), _cmd(n))),
        of_edges("READ_SECRETS", lambda e: (e.type == "ARG") & _is(_cmd(node(e.src)), READERS) & _holds(node(e.dst).path, SECRET_PARTS), lambda e: e.src, lambda e: node(e.dst).path),
        of_nodes("NET_UPLOAD", _uploads),
        of_nodes("NET_LISTENER", _listens),
        of_edges("SHELL_OBFUSCATION", lambda e: (e.type == "PIPE") & decodes(node(e.src)) & _is(_cmd(node(e.dst)), SPAWNS), lambda e: e.dst, lambda e: F.concat(_cmd(node(e.src)), F.lit(" | "), _cmd(node(e.dst)))),
        of_nodes("GIT_DESTRUCTIVE", _destroys, lambda n: F.concat(F.lit("git "), F.coalesce(F.try_element_at(n.tokens, F.lit(2)), F.lit("")))),
        of_nodes("PERSISTENCE", lambda n: (_cmd(n) == "crontab") & ~F.array_contains(_rest(n), "-l")),
        F.transform(F.filter(edges, lambda e: writes(e) & _holds(node(e.dst).path, PROFILES)), lambda e: row("PERSISTENCE", e.src, node(e.dst).path, 85)),
    ]
    rows = graphs.withColumn("_all", F.concat(*parts))
    bit = F.create_map(*[x for k, (b, _) in RULES.items() for x in (F.lit(k), F.lit(1 << b))])
    flags = F.aggregate("_all", F.lit(0), lambda a, x: a.bitwiseOR(bit[x.rule]))
    return rows.withColumns({"found": F.slice("_all", 1, MOST), "flags": flags}).drop("_all")


def violations(graphs: DataFrame) -> DataFrame:
    """cmd_id, rule, severity, node, detail: one row each."""
    return found(graphs).select("cmd_id", F.explode("found").alias("x")).select("cmd_id", "x.*")
