"""Entropy of values and how likely a value is a secret."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import spread

#: Prefixes of secrets, in order; name patterns; names that are never screened.
PREFIXES = "sk- sk_live_ sk_test_ pk_live_ pk_test_ AKIA api_ apikey ghp_ glpat- xoxb- xoxa- EAACEdE AIza AIzaSy sq0csp- sq0a- ya29. github_pat_".split()
NAME_PATTERNS = "KEY SECRET TOKEN PASSWORD CREDENTIAL API AUTH PRIVATE".split()
WHITELIST = (
    "DISPLAY WAYLAND_DISPLAY XAUTHORITY XDG_RUNTIME_DIR XDG_SESSION_ID XDG_CURRENT_DESKTOP XDG_SESSION_TYPE XDG_VTNR XDG_SEAT GNOME_DESKTOP_SESSION_ID "
    "GNOME_TERMINAL_SCREEN GNOME_TERMINAL_SERVICE GNOME_TERMINAL_VERSION KDE_FULL_SESSION KDE_SESSION_VERSION KDE_MULTIHEAD QT_QPA_PLATFORM QT_STYLE_OVERRIDE "
    "TMUX TMUX_PANE TERM TERM_PROGRAM COLORTERM LS_COLORS LESSCLOSE LESSOPEN SHELL PWD HOME USER LOGNAME PATH LANG LANGUAGE LC_ALL LC_CTYPE LC_MESSAGES "
    "HOSTNAME HOST MACHTYPE ARCH SSH_AUTH_SOCK SSH_CLIENT SSH_CONNECTION SSH_TTY PS1 PS2 PS3 PS4 PROMPT_COMMAND HISTCONTROL HISTFILESIZE HISTSIZE "
    "HISTTIMEFORMAT GLOBIGNORE BASHOPTS BASH_VERSION BASH_VERSINFO GROUPS UID EUID GID EGID MEMORY_PRESSURE_WATCH INVOCATION_ID JOURNAL_STREAM WAYLAND_DISLOCK"
).split()
#: Prior and likelihoods of the evidence.
PRIOR, PREFIX, NAME, PATH = 0.10, ((0.98, 0.02), (0.12, 0.88)), ((0.90, 0.10), (0.15, 0.85)), ((0.01, 0.99), (0.95, 0.05))


def _byte_grams(text: Column, n: int) -> Column:
    """The n-grams of the text's bytes (UTF-8), two hex digits a byte; none if there are fewer bytes."""
    return F.transform(F.array(F.hex(text.cast("binary"))), lambda h: F.when(F.length(h) < 2 * n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - n), lambda i: F.substring(h, 2 * i + 1, F.lit(2 * n)))))[0]


def ngram_entropy(text: Column, n: int) -> Column:
    """Bits of entropy of a text's n-grams of bytes (0 if it has none): they are sorted once, and the lengths of the
    runs of equal ones are summed in one pass."""

    def of(g: Column) -> Column:
        total = F.size(g).cast("double")
        bits = lambda run: F.when(run > 0, run / total * F.log2(run / total)).otherwise(F.lit(0.0))

        def step(a: Column, x: Column) -> Column:
            same = a["last"] == x
            return F.struct(x.alias("last"), F.when(same, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, a["sum"]).otherwise(a["sum"] - bits(a["run"])).alias("sum"))

        zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.array_sort(g), zero, step, lambda a: a["sum"] - bits(a["run"]))

    return F.when(F.octet_length(text) < n, F.lit(0.0)).otherwise(F.transform(F.array(_byte_grams(text, n)), of)[0])


def shannon_entropy(text: Column) -> Column:
    return ngram_entropy(text, 1)


def conditional_entropy(text: Column) -> Column:
    """Entropy of a byte given the one before: of pairs, less that of first bytes."""

    def first(g: Column) -> Column:
        return F.array_join(F.transform(g, lambda x: F.substring(x, 1, 2)), "")

    # The first bytes of all pairs, as a text of their own; unhex gives bytes, whose n-grams are read again.
    firsts = _entropy_of_hex(F.transform(F.array(_byte_grams(text, 2)), first)[0])
    return F.when(F.octet_length(text) < 2, F.lit(0.0)).when(text.isNotNull(), F.greatest(ngram_entropy(text, 2) - firsts, F.lit(0.0)))


def _entropy_of_hex(h: Column) -> Column:
    return ngram_entropy(F.unhex(h), 1)


def _entropies(codes: np.ndarray) -> np.ndarray:
    """Bits of entropy of each row's numbers: the runs of all rows' sorted numbers are found at once."""
    ordered = np.sort(codes, axis=1)
    n = codes.shape[1]
    turn = np.ones(codes.shape, bool)
    turn[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.flatnonzero(turn)
    runs = np.diff(at, append=codes.size) / n
    return np.maximum(0.0, np.bincount(at // n, weights=-(runs * np.log2(runs)), minlength=len(codes)))


def _measures(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy of pairs, and conditional entropy, of each row of bytes (equal lengths, two or more)."""
    first = rows[:, :-1].astype(np.int32)
    pairs = _entropies(first * 256 + rows[:, 1:])
    return pairs, np.maximum(0.0, pairs - _entropies(first))


#: A linear congruential generator, and how many shuffled copies a value is compared with.
LCG, SHUFFLES = (1103515245, 12345, 0x7FFFFFFF), 5


@lru_cache(64)
def _places(n: int) -> np.ndarray:
    """Where each of SHUFFLES Fisher-Yates shuffles takes the bytes of a text of n from: they depend on n alone."""
    out = np.tile(np.arange(n), (SHUFFLES, 1))
    for seed in range(SHUFFLES):
        state, row = seed, out[seed]
        for i in range(n - 1, 0, -1):
            state = (state * LCG[0] + LCG[1]) & LCG[2]
            j = state % (i + 1)
            row[i], row[j] = row[j], row[i]
    return out


#: Bytes of shuffled texts that are measured together.
AT_ONCE = 1 << 20


def _ratios(rows: np.ndarray) -> np.ndarray:
    """Each measure of texts of one length over the upper median of the shuffled texts' (over the text's own, if it is short)."""
    n = rows.shape[1]
    if n < 2:
        return np.full((len(rows), 2), 2.0)
    own = np.stack(_measures(rows), axis=1)
    if n < 12:
        return np.where(own != 0, 1.0, 2.0)
    base = np.stack([np.sort(m.reshape(len(rows), SHUFFLES), axis=1)[:, SHUFFLES // 2] for m in _measures(rows[:, _places(n)].reshape(-1, n))], axis=1)
    return np.where(base != 0, own / np.where(base != 0, base, 1.0), 2.0)


@F.pandas_udf(T.StructType([T.StructField("pair", T.DoubleType()), T.StructField("given", T.DoubleType())]))
def permutation_ratios(value: pd.Series) -> pd.DataFrame:
    """Pair and conditional entropy relative to shuffled copies: only this part of the screen is Python. A shuffle depends
    on the length alone, so the texts of one length are measured together."""
    out = np.full((len(value), 2), np.nan)
    data = [None if v is None else v.encode() for v in value]
    sizes = np.array([-1 if x is None else len(x) for x in data], np.int64)
    for n in np.unique(sizes[sizes >= 0]):
        where = np.flatnonzero(sizes == n)
        step = max(1, AT_ONCE // (SHUFFLES * max(1, int(n))))
        for lo in range(0, len(where), step):
            some = where[lo : lo + step]
            out[some] = _ratios(np.frombuffer(b"".join(data[i] for i in some), np.uint8).reshape(len(some), n))
    return pd.DataFrame(out, columns=["pair", "given"])


def secret_prefix(value: Column) -> Column:
    """The first known prefix that a longer value begins with, or null."""
    return F.coalesce(*(F.when(value.startswith(p) & (F.length(value) > len(p)), F.lit(p)) for p in PREFIXES))


#: Directories that make a value a path wherever they stand in it.
PATH_PARTS = "/tmp/ /var/ /home/ /usr/ /etc/ /run/ /.local/ /.cache/".split()


def path_like(value: Column) -> Column:
    parts = "|".join(p.replace(".", r"\.") for p in PATH_PARTS)
    return (F.length(value) >= 2) & value.rlike(rf"\A[/~]|{parts}")


def base64_like(value: Column) -> Column:
    """Whole groups of four from the alphabet, padded, or unpadded and of 16 or more."""
    return (F.length(value) % 4 == 0) & value.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & (value.endswith("=") | (F.length(value) >= 16)) & (F.length(value) >= 4)


def update(posterior: Column, for_: Column, against: Column) -> Column:
    """Bayes' rule for one piece of evidence."""
    total = posterior * for_ + (F.lit(1.0) - posterior) * against
    return F.when(total > 0, posterior * for_ / total).otherwise(posterior)


def ratio_likelihoods(ratio: Column) -> tuple[Column, Column]:
    off = F.abs(ratio - 1.0)
    near = 0.1 + 0.85 * F.exp(-0.5 * F.pow((ratio - 1.0) / 0.15, F.lit(2.0)))
    far = F.when(off < 0.3, F.lit(0.1)).otherwise(0.5 + 0.45 * F.exp(-0.5 * F.pow((off - 0.3) / 0.2, F.lit(2.0))))
    return near, far


def posterior_of(shannon: Column, given: Column, pair: Column, prefixed: Column, named: Column, path: Column) -> Column:
    """Evidence in order: both ratios, Shannon entropy, prefix, name, path."""
    level = shannon / 8.0
    evidence = [ratio_likelihoods(given), ratio_likelihoods(pair), (1.0 / (1.0 + F.exp(-10.0 * (level - 0.6))), 1.0 / (1.0 + F.exp(-10.0 * (0.6 - level))))]
    for on, ((a, b), (c, d)) in ((prefixed, PREFIX), (named, NAME), (path, PATH)):
        evidence.append((F.when(on, a).otherwise(c), F.when(on, b).otherwise(d)))
    out = F.lit(PRIOR)
    for for_, against in evidence:  # each step is let-bound, else the expression would double with every piece
        out = F.transform(F.array(F.struct(out.alias("p"), for_.alias("f"), against.alias("a"))), lambda x: update(x.p, x.f, x.a))[0]
    return out


def secret_scores(env: DataFrame) -> DataFrame:
    """env (name, value) with shannon, ratios, evidence flags and posterior; values under 8 bytes score 0."""
    value = F.col("value")
    # Values too short to be scored are not sent to Python.
    rows = spread(env).withColumn("prefix", secret_prefix(value)).withColumn("ratios", permutation_ratios(F.when(F.octet_length(value) >= 8, value)))
    own = F.when(F.col("prefix").isNotNull(), shannon_entropy(F.substring(value, F.length("prefix") + 1, F.length(value))))
    # Both are the output of a generator: a projection's would be computed again wherever they are read.
    once = lambda x: F.explode(F.array(x))
    rows = rows.withColumn("shannon", once(F.transform(F.array(own), lambda x: F.when(x > 0, x).otherwise(shannon_entropy(value)))[0]))
    named = F.coalesce(F.col("name").rlike("|".join(NAME_PATTERNS)), F.lit(False))
    post = posterior_of(F.col("shannon"), F.col("ratios.given"), F.col("ratios.pair"), F.col("prefix").isNotNull(), named, path_like(value))
    return rows.withColumn("posterior", once(F.when(F.coalesce(F.octet_length(value), F.lit(0)) < 8, F.lit(0.0)).otherwise(post)))


def screen(env: DataFrame, threshold: float = 0.5, least: int = 8) -> DataFrame:
    """Entries that are long enough, not whitelisted, and above the threshold."""
    some = env.filter((F.octet_length("value") >= least) & ~F.coalesce(F.col("name").isin(*WHITELIST), F.lit(False)))
    return secret_scores(some).filter(F.col("posterior") > threshold)
