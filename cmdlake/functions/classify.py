"""Classification of tokens: an ordered cascade of recognisers, as one CASE of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists of the recognisers.
SIGNALS = "HUP INT QUIT ILL TRAP ABRT BUS FPE KILL USR1 SEGV USR2 PIPE ALRM TERM STKFLT CHLD CONT STOP TSTP TTIN TTOU URG XCPU XFSZ VTALRM PROF WINCH POLL PWR SYS".split()
ALGORITHMS = "md5 sha1 sha224 sha256 sha384 sha512 blake2b blake2s ripemd160 whirlpool".split()
METHODS = "GET POST PUT DELETE PATCH HEAD OPTIONS TRACE CONNECT COPY LOCK MKCOL MOVE PROPFIND PROPPATCH UNLOCK REPORT MKACTIVITY CHECKOUT MERGE M-SEARCH NOTIFY SUBSCRIBE UNSUBSCRIBE PURGE".split()
REFS = "HEAD main master develop trunk mainline default gh-pages source sandbox staging production next feature release hotfix fix bugfix wip maint".split()
SYSTEM_USERS = (
    "root nobody daemon bin sys adm tty disk lp mail news uucp man proxy www-data backup list irc gnats systemd systemd-network systemd-resolve "
    "systemd-timesync _apt messagebus systemd-coredump rpc rpcuser nfsnobody saslauth ldap postfix dovecot clamav amavis spamassassin tcpdump avahi "
    "bluetooth audio video games cdrom floppy tape dialout fax voice cdwriter scanner kmem wheel users input kvm render sgx dip"
).split()
USERS = SYSTEM_USERS + "wwwrun qemu libvirt svn ntp chrony polkitd cockpit-ws cockpit-wsinstance numad sssd unbound tss gdm snapd lxd rngd irqbalance oprofile oprofile-agent".split()
GROUP_USERS = SYSTEM_USERS + "postgres mysql redis apache vagrant guest ubuntu deploy jenkins builder runner alice bob charlie dave eve frank".split()
TLDS = "com org net edu gov mil io co dev app cloud local int biz info".split()
#: Commands and options after which a token with one of the characters is a regular expression.
REGEX_AFTER = "sed awk perl grep egrep fgrep rg ag -e -E -P -pe -ne -pie -nle -F".split()
REGEX_CHARACTERS = r"[\[\]*+?{}|\\^$()/]"


def _any(words: list[str]) -> str:
    return "|".join(w.replace("-", r"\-").replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


def _ipv6() -> str:
    """Full, compressed, and ending in a dotted quad without leading zeros."""
    h, octet = "[0-9A-Fa-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    quad = rf"(?:{octet}\.){{3}}{octet}"
    forms = [rf"(?:{h}:){{7}}{h}", rf"(?:{h}:){{6}}{quad}"]
    for left in range(8):  # groups before the gap; after it as many as leave one group out at least
        head = f"(?:{h}:){{{left - 1}}}{h}::" if left else "::"
        right = 7 - left
        forms.append(head + (f"(?:{h}(?::{h}){{0,{right - 1}}})?" if right else ""))
        if right >= 2:
            forms.append(head + f"(?:{h}:){{0,{right - 2}}}{quad}")
    return f"(?:{'|'.join(forms)})" + r"(?:%[A-Za-z0-9_.\-]+)?"


def _timestamp() -> str:
    clock = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
    months = "(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8])"
    leap = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29"
    zone = "(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9])?"
    return f"(?!0000)(?:[0-9]{{4}}-(?:{months})|{leap})(?:[Tt ]{clock}{zone})?|{clock}"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: (type, Java expression that the whole token must match); the first that does wins.
CASCADE: list[tuple[str, str]] = [
    ("ABS_PATH", "/.+"),
    ("URL", r"[A-Za-z][A-Za-z0-9+.\-]*://.*"),
    ("IPV4", rf"(?:{_OCTET}\.){{3}}{_OCTET}"),
    ("IPV6", _ipv6()),
    ("MAC", r"[0-9A-Fa-f]{2}([:\-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}"),
    ("NUMBER", "0[xX][0-9A-Fa-f]+"),
    ("UUID", "[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"),
    ("PKG", r"@[A-Za-z0-9_\-]*/(?:[A-Za-z0-9._\-]+|(?=@))(?:@[A-Za-z0-9.\-^~<>=]+)?|(?![-@])[A-Za-z0-9._\-]+@(?=[^@]*[0-9.\-])[A-Za-z0-9.\-^~<>=]+"),
    ("EMAIL", r"[A-Za-z0-9._\-+]+@(?=[^.]*\.)[A-Za-z0-9.\-]+"),
    ("HOSTNAME", rf"(?=[A-Za-z0-9])(?!.*(?:\.\.|--))(?=.*\.)(?=.*-\.|.*\.(?i:{'|'.join(TLDS)})\z)[A-Za-z0-9.\-]*[A-Za-z0-9]"),
    ("SIZE", r"(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[KMGT]i?B?|bytes|b|B)"),
    ("SEMVER", r"(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){2}(?:-(?!0[0-9]+(?:[.+]|\z))[0-9A-Za-z\-]+(?:\.(?!0[0-9]+(?:[.+]|\z))[0-9A-Za-z\-]+)*)?(?:\+[0-9A-Za-z\-]+(?:\.[0-9A-Za-z\-]+)*)?"),
    ("PERM_OCTAL", "[0-7][4-7][0-7]|[03-7][0-7]{3}|[12][4-7][0-7]{2}"),
    ("SIGNAL", f"(?:SIG)?(?:{_any(SIGNALS)})"),
    ("NUMBER", "-?[0-9]+"),
    ("TIMESTAMP", _timestamp()),
    ("DURATION", r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?i:ns|us|ms|s|m|h|d|w)"),
    ("HASH_ALGO", _any(ALGORITHMS)),
    ("FINGERPRINT", "SHA256:[A-Za-z0-9+/=]{43}|(?:[0-9A-Fa-f]{2}:){15}[0-9A-Fa-f]{2}"),
    ("ENV_VAR", r"\$(?:\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)"),
    ("USER", _any(USERS)),
    ("RANGE", "(?=..)[0-9]*-[0-9]*"),
    ("CRON", r"(?=.*[0-9*])[0-9*\-,/]+"),
    ("HYPHENATED", r"[A-Za-z_](?=[^-]*-)[A-Za-z0-9_\-]*"),
    ("BRANCH", rf"(?:{_any(REFS)})|(?!-)[A-Za-z0-9_\-]+(?:/[A-Za-z0-9_\-]+)+(?<=[A-Za-z0-9])"),
    ("METHOD", _any(METHODS)),
    ("SHORTOPT", "-[A-Za-z0-9]+"),
    ("LONGOPT", r"--[A-Za-z0-9\-=]+"),
    ("SHA", "[0-9a-f]{7}|[0-9a-f]{9,64}"),
    ("HEXHASH", "(?=.*[A-Fa-f])[0-9A-Fa-f]{8,}"),
    ("USER_GROUP", rf"(?=[a-z_])(?=[^:]*[a-z])(?=.*:.*[a-z])(?:(?=.*-)[A-Za-z0-9_\-]+|(?:{_any(GROUP_USERS)})):[A-Za-z0-9_\-]+"),
    ("IMAGE", r"(?![A-Z][a-z]*(?:[/:@]|\z))(?!.*::)(?:[A-Za-z0-9.\-_/:]*@sha256:[0-9A-Fa-f]{64}|(?![-.])(?=.*:)[A-Za-z0-9.\-_/:]{2,})"),
    ("GLOB", r"(?![-/])(?=.*[*?\[])(?!.*\[[^\]]*\z)[^|&;<>()]*"),
    ("REL_PATH", r"(?!/).*(?:\.\.|/).*"),
    ("FILENAME", r"(?=.*\.)[^/\-]*"),
    ("QUOTED_SPACE", r".*[ \t\n\x0B\f\r].*"),
]


#: Shapes of most tokens, each with the types whose recognisers can match it (the others need a character that it lacks).
SHAPES = {
    r"\w+": "NUMBER SIZE PERM_OCTAL SIGNAL DURATION HASH_ALGO USER CRON BRANCH METHOD SHA HEXHASH".split(),
    r"--?[A-Za-z0-9]+": "NUMBER DURATION RANGE CRON SHORTOPT LONGOPT".split(),
}


def cascade(token: Column, out: Column, types: list[str] | None = None) -> Column:
    """The cases of out, then the recognisers in order (of some types only)."""
    for name, regex in CASCADE:
        if types is None or name in types:
            out = out.when(token.rlike(rf"(?s)\A(?:{regex})\z"), name)
    return out.otherwise("LITERAL")


def token_type(token: Column) -> Column:
    """The type of a token (LITERAL if no recogniser knows it; null for null)."""
    out = F.when(token.isNull(), F.lit(None).cast("string"))
    for shape, types in SHAPES.items():
        out = out.when(token.rlike(rf"\A{shape}\z"), cascade(token, F.when(F.lit(False), ""), types))
    return cascade(token, out)


#: The first component of an absolute path to its category; any other is OTHER.
PATH_CATEGORIES = {"etc": "ETC", "var": "VAR", "usr": "USR", "home": "HOME", "root": "HOME", "tmp": "TMP", "proc": "PROC", "sys": "SYS", "dev": "DEV", "opt": "OPT", "srv": "SRV", "run": "RUN", "sysroot": "SYSROOT", "boot": "BOOT", "mnt": "MNT", "media": "MEDIA", ".snapshots": "SNAPSHOT"}


def path_category(path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(2))
    out = F.when(path.isNull() | ~path.startswith("/"), "OTHER").when(path == "/", "ROOT")
    for name, category in PATH_CATEGORIES.items():
        out = out.when(first == name, category)
    return out.otherwise("OTHER")
