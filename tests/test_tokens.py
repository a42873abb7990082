"""Fixtures of the full tokenizer and what follows from its tokens."""

import pytest
from pyspark.sql import functions as F

from cmdlake.functions import tokens

SCANS = {
    "": [], "  \t ": [],
    'echo "$VAR" | cat 2>&1': [("COMMAND", "echo"), ("VARIABLE_QUOTED", '"$VAR"'), ("PIPE", "|"), ("COMMAND", "cat"), ("REDIRECT_ERR", "2>&1")],
    'diff <(left "(x)") >(right)': [("COMMAND", "diff"), ("PROCESS_SUB", '<(left "(x)")'), ("PROCESS_SUB", ">(right)")],
    "echo $1 $10 ${10}": [("COMMAND", "echo"), ("SPECIAL_VAR", "$1"), ("SPECIAL_VAR", "$1"), ("ARGUMENT", "0"), ("VARIABLE", "${10}")],
    "cmd >>&9 >&10 <&0 3>&- 4<&- 12>>log": [("COMMAND", "cmd"), ("REDIRECT_APPEND", ">>&9"), ("REDIRECT_OUT", ">&10"), ("REDIRECT_IN", "<&0"), ("REDIRECT_ERR", "3>&-"), ("REDIRECT_IN", "4<&-"), ("REDIRECT_APPEND", "12>>"), ("ARGUMENT", "log")],
    "echo 2 > out": [("COMMAND", "echo"), ("REDIRECT_ERR", "2 >"), ("ARGUMENT", "out")],
    "ls file[!12].txt": [("COMMAND", "ls"), ("ARGUMENT", "file"), ("GLOB", "[!12]"), ("ARGUMENT", ".txt")],
    "echo $(echo $(echo hi))": [("COMMAND", "echo"), ("SUBSHELL", "$(echo $(echo hi))")],
}
SEQUENCES = {
    "": None, "cat /etc/passwd": "cat AP", "grep -i root /etc/shadow": "grep OPT STR AP", "cat /etc/passwd | grep root": "cat AP | grep STR", "ls ; cd /tmp && pwd || echo done": "ls | cd AP | pwd | echo STR",
    "echo $HOME": "echo EV", "$COMMAND argument": "EV STR", "echo $1 $? *.c $((1+2))": "echo PV SV GB AR", "cat ./file.txt ~/file.txt": "cat RP HP", "echo hi > out": "echo STR", "> out echo hi": "echo STR",
    "cat <<EOF\npayload\nEOF": "cat", "diff <(left) >(right)": "diff CS CS", "echo" + " x" * 300: "echo" + " STR" * 300,
}
ABSTRACTIONS = {
    "ls -la": ("ls -la", 0), "cat ../foo.txt": ("cat $RP_1", 1), "ls ~/documents": ("ls $HP_1", 1), "ls *.txt": ("ls $GB_1", 1), "echo $1 $10 ${10}": ("echo $PV_1 $PV_20 $PV_3", 3),
    "echo $? $$ $# $! $@ $* $-": ("echo $SV_1 $SV_2 $SV_3 $SV_4 $SV_5 $SV_6 $SV_7", 7), "echo `date`": ("echo $CS_1", 1), "echo $((x+1))": ("echo $AR_1", 1), 'echo "hello world"': ("echo $STR_1", 1),
    'echo "prefix ${NAME} suffix"': ("echo $EV_1", 1), "grep $USER $HOME/file $PATH": ("grep $EV_1 $EV_2$AP_1 $EV_3", 4), "grep -i $PATTERN /etc/*.conf ~user/*.txt": ("grep -i $EV_1 $GB_1 $GB_2", 3),
    "tail -f /var/log/$APP.log | grep -i error": ("tail -f $AP_1$EV_1.log | grep -i error", 2), "echo ok && cat /etc/$FILE || diff <(left) >(right)": ("echo ok && cat $AP_1$EV_1 || diff $CS_1 $CS_2", 4),
    "cat < /tmp/in >out 2>> err 2>&1": ("cat < $RD_1 >$RD_2 2>> $RD_3 2>&1", 3), 'cat <<< "$VALUE"': ("cat <<< $RD_1", 1), "cat <<EOF\npayload\nEOF": ("cat <<EOF\npayload\nEOF", 0), "find /var -name *.log -mtime +7": ("find $AP_1 -name $GB_1 -mtime +7", 2),
}


def rows(spark, texts):
    return tokens.tokenized(spark.createDataFrame(list(enumerate(texts)), "cmd_id long, command string"))


@pytest.mark.parametrize("text", SCANS)
def test_scan(text):
    assert [x[:2] for x in tokens.scan(text)] == SCANS[text]
    assert all(text[at : at + len(t)] == t for _, t, at in tokens.scan(text))


def test_scan_rejects():
    assert tokens.scan("echo ${VAR${SUFFIX}}") is None and tokens.scan("echo ${VAR") is None and tokens.scan("a\x00b") is None


def test_type_sequence(spark):
    got = {r.cmd_id: r.sequence for r in tokens.type_sequence(rows(spark, list(SEQUENCES))).collect()}
    assert [got[i] for i in range(len(SEQUENCES))] == list(SEQUENCES.values())


def test_abstraction(spark):
    found = tokens.abstracted(rows(spark, list(ABSTRACTIONS)))
    got = {r.cmd_id: (r.abstracted, len(r.elements)) for r in found.collect()}
    assert [got[i] for i in range(len(ABSTRACTIONS))] == list(ABSTRACTIONS.values())


def test_flags_and_expansion(spark):
    found = tokens.abstracted(rows(spark, ["cat $HOME/x ~/y z/w > out", None]))
    first, none = sorted(tokens.flags(found).collect(), key=lambda r: r.cmd_id)
    assert {k for k, v in first.asDict().items() if v is True} == {"variables", "paths", "absolute", "relative", "home", "redirects"} and not any(none[1:])
    got = tokens.expanded(found, F.create_map(F.lit("HOME"), F.lit("/h")), F.lit("/w"), F.lit("/h")).collect()
    assert {r.original: r.expanded for r in got} == {"$HOME": "/h", "/x": "/x", "~/y": "/h/y", "z/w": "/w/z/w", "out": None}


def test_processed_and_transformed(spark):
    t = rows(spark, ["echo $NAME *.txt $(date) $((1+2)) | wc -l > out", "a"])
    a, b, c = sorted(tokens.processed(t).collect(), key=lambda r: (r.cmd_id, r.stage))
    assert (a.clean, b.clean, c.clean) == ("echo $NAME *.txt $(date) $((1+2))", "wc -l", "a")
    assert a.pipe_out and b.pipe_in and b.redirects and not a.redirects and a.arithmetic and not c.dangerous and a.dangerous
    got = sorted((r.cmd_id, r.stage, r.transformed, r.changed) for r in tokens.transformed(t).collect())
    assert got == [(0, 0, "echo VAR_VALUE FILE_PATTERN TEMP_FILE VAR_VALUE", True), (0, 1, "wc -l > out", False), (1, 0, "a", False)]
