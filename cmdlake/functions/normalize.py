"""Normalisation of commands into typed tokens, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import REGEX_AFTER, REGEX_CHARACTERS, token_type
from .lattice import SYMBOLS

#: More tokens than this make a command invalid (null tokens).
MOST_TOKENS = 128
_RAW = r"""\|\||\||&&|;|&>>|&>|2>>|2>|>>|>|<|"(?:\\[\s\S]|[^"\\])*"?|'(?:\\[\s\S]|[^'\\])*'?|&|(?:\\[\s\S]|[^\s|><&;])+"""
OPERATORS = ["||", "|", "&&", ";", "&>>", "&>", "2>>", "2>", ">>", ">", "<", "&"]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def raw_tokens(command: Column) -> Column:
    """Tokens as written: operators, quoted strings without their quotes, words.

    Quotes count at a token's start only; a backslash keeps the next character."""
    bare = lambda t: F.when(t.rlike(r"""\A["']"""), F.regexp_replace(F.substring(t, 2, 1 << 30), F.when(t.startswith('"'), F.lit(r'(?<!\\)"\z')).otherwise(F.lit(r"(?<!\\)'\z")), F.lit(""))).otherwise(t)
    return F.transform(F.regexp_extract_all(command, F.lit(_RAW), F.lit(0)), lambda t: F.struct(bare(t).alias("text"), t.rlike(r"""\A["']""").alias("quoted")))


def typed_tokens(command: Column) -> Column:
    """array<struct<text, type>>: options and assignments split at '=', numbers after kill
    or -s as signals, regular expressions by what stands before, everything else by its
    own form. Null for more than MOST_TOKENS tokens."""

    def split(x: Column) -> Column:
        t = x.text
        flag = t.rlike(r"\A--[A-Za-z0-9\-]+=.") & ~x.quoted
        assign = t.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*=.") & ~x.quoted
        at = F.instr(t, "=")
        part = lambda text, fixed: F.struct(text.alias("text"), fixed.alias("fixed"))
        value = part(F.substring(t, at + 1, F.length(t)), F.lit(False))
        return F.when(flag, F.array(part(F.substring(t, F.lit(1), at - 1), F.lit(False)), value)).when(assign, F.array(part(F.substring(t, F.lit(1), at), F.lit(True)), value)).otherwise(F.array(part(t, t.isin(*OPERATORS) & ~x.quoted)))

    def of(raw: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            before = F.when(i > 0, raw[F.greatest(i - 1, F.lit(0))].text)
            signal = before.isin("kill", "-s") & x.text.rlike(r"\A(?:[1-9]|[12][0-9]|3[01])\z")
            regex = before.isin(*REGEX_AFTER) & x.text.rlike(REGEX_CHARACTERS)
            kind = lambda p: F.when(p.fixed, "LITERAL").when(F.coalesce(signal, F.lit(False)), "SIGNAL").when(F.coalesce(regex, F.lit(False)), "REGEX").otherwise(token_type(p.text))
            return F.transform(split(x), lambda p: F.struct(p.text.alias("text"), kind(p).alias("type")))

        return F.flatten(F.transform(raw, each))

    done = _let(raw_tokens(command), lambda raw: F.when(F.size(raw) <= MOST_TOKENS, of(raw)))
    return _let(done, lambda x: F.when(F.size(x) <= MOST_TOKENS, x))


def typed(commands: DataFrame) -> DataFrame:
    """cmd_id, c: the typed tokens of each command. They are the output of a generator, as an expression in a projection
    is computed again for every filter and join key that reads it."""
    return commands.select("cmd_id", F.explode(F.array(typed_tokens(F.col("command")))).alias("c"))


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to all cores: short rows lie in few parts of a file, however long each takes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def shown(tokens: Column) -> Column:
    """The legacy form: symbols instead of texts, except for literals."""
    symbol = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    return F.transform(tokens, lambda t: F.when(t.type == "LITERAL", t.text).otherwise(symbol[t.type]))
