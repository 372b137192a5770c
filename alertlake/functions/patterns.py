"""Patterns given in the configuration: RE2 regular expressions and file globs.

Both become Java regular expressions, the dialect of ``rlike`` and ``regexp_extract``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# RE2 knows only ASCII word characters; Java 17 counts CJK and accented letters too.
WORD_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
NO_WORD_EDGE = "(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# Where one side is known to be a word character, half of the test is enough.
WORD_STARTS = "(?<![0-9A-Za-z_])"
WORD_ENDS = "(?![0-9A-Za-z_])"
WORDS_AHEAD = re.compile(r"[0-9A-Za-z_]|\((?:\?:)?\w+(?:\|\w+)*\)(?![?*{])", re.ASCII)
WORDS_BEFORE = re.compile(r"(?:(?<!\\)[0-9A-Za-z_]|(?<!\\)\((?:\?:)?\w+(?:\|\w+)*\))\Z", re.ASCII)
OPTIONAL_AHEAD = re.compile(r"[0-9A-Za-z_][?*{]")
# What Java reads and RE2 refuses: back references and a few escapes, lookaround, atomic groups, possessive repetition.
FOREIGN_ESCAPES = re.compile(r"\\[1-9kZGRXhHceNV]")
FOREIGN_GROUPS = re.compile(r"\(\?(?:[=!>]|<[=!])")
QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})(\??)(\+?)")
FLAGS = re.compile(r"[ims]*(?:-[ims]+)?")
SPACE = r"\t\n\f\r "


class PatternError(ValueError):
    """A pattern that the engine refuses, raised when the query is built."""


@dataclass(frozen=True)
class Pattern:
    source: str
    java: str
    groups: int

    def matches(self, text: Column) -> Column:
        return text.rlike(self.java)

    def group(self, text: Column, index: int) -> Column:
        return F.regexp_extract(text, self.java, index)


def to_java(source: str) -> str:
    """Spell an RE2 expression so that Java reads it with RE2's meaning."""
    out, i, in_class, multiline = ["(?d)"], 0, False, False
    outer: list[bool] = []  # whether $ ends lines around each open group
    while i < len(source):
        two = source[i : i + 2]
        if two[:1] == "\\":
            if FOREIGN_ESCAPES.match(two):
                raise PatternError(f"escape {two} is not supported: {source!r}")
            if in_class:
                out.append(SPACE if two == r"\s" else two)
            else:
                out.append(
                    {
                        r"\b": _word_edge(source[:i], source[i + 2 :]),
                        r"\B": NO_WORD_EDGE,
                        r"\s": f"[{SPACE}]",
                        r"\S": f"[^{SPACE}]",
                        r"\z": r"\z",
                    }.get(two, two)
                )
            i += 2
            continue
        char = source[i]
        if in_class:
            # '[' and '&&' are operators inside a Java class but literals in RE2.
            if source.startswith("[:", i) and ":]" in source[i:]:
                end = source.index(":]", i) + 2
                out.append(_posix_class(source[i:end]))
                i = end
                continue
            in_class = char != "]"
            out.append("\\" + char if char in "[&" else char)
        elif char == "[":
            in_class = True
            out.append(char)
            for lead in "^]":
                if source.startswith(lead, i + 1):
                    out.append(lead if lead == "^" else r"\]")
                    i += 1
        elif FOREIGN_GROUPS.match(source, i):
            raise PatternError(f"lookaround and atomic groups are not supported: {source!r}")
        elif quantifier := QUANTIFIER.match(source, i):
            if quantifier[2]:
                raise PatternError(f"possessive repetition is not supported: {source!r}")
            out.append(quantifier[0])
            i = quantifier.end() - 1
        elif source.startswith("(?P<", i):
            outer.append(multiline)
            out.append("(?<")
            i += 3
        elif source.startswith("(?", i) and source[i + 2 : i + 3] not in ("", ":", "<"):
            end = min((p for p in (source.find(")", i), source.find(":", i)) if p > 0), default=len(source))
            flags = source[i + 2 : end]
            on, _, off = flags.partition("-")
            if not FLAGS.fullmatch(flags):
                raise PatternError(f"flags {flags} are not supported: {source!r}")
            if source[end : end + 1] == ":":
                outer.append(multiline)
            multiline = ("m" in on) or (multiline and "m" not in off)
            # RE2 folds all letters, Java without its flag u only ASCII.
            out.append("(?" + on + ("u" if "i" in on else "") + flags[len(on) :] + source[end : end + 1])
            i = end
        elif char == "(":
            outer.append(multiline)
            out.append(char)
        elif char == ")":
            multiline = outer.pop() if outer else multiline
            out.append(char)
        elif char == "$":
            out.append("$" if multiline else r"\z")
        else:
            out.append(char)
        i += 1
    return "".join(out)


def _word_edge(before: str, ahead: str) -> str:
    if WORDS_AHEAD.match(ahead) and not OPTIONAL_AHEAD.match(ahead) and "|" not in _top_level(ahead):
        return WORD_STARTS
    if WORDS_BEFORE.search(before) and "|" not in _top_level(before):
        return WORD_ENDS
    return WORD_EDGE


def _top_level(text: str) -> str:
    """The text without its closed groups and classes; a bar left over may put an alternative next to the edge."""
    previous = None
    while previous != text:
        previous = text
        text = re.sub(r"\\.|\[[^\]]*\]|\([^()|]*(?:\|[^()]*)?\)", "", text)
    return text


def _posix_class(text: str) -> str:
    negated, name = text.startswith("[:^"), text.strip("[:^]")
    names = {
        "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
        "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
        "space": "Space", "upper": "Upper", "xdigit": "XDigit", "word": "w",
    }
    if name not in names:
        raise PatternError(f"unknown character class {text}")
    if name == "word":
        return r"\W" if negated else r"\w"
    return (r"\P{%s}" if negated else r"\p{%s}") % names[name]


def compile_pattern(source: str) -> Pattern:
    """Translate, check with the Java engine, and count the capture groups."""
    java = to_java(source)
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are checked by the JVM: start a SparkSession first")
    try:
        compiled = spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise PatternError(f"cannot compile pattern {source!r}") from error
    return Pattern(source, java, compiled.matcher("").groupCount())


def compile_patterns(sources) -> list[Pattern]:
    return [compile_pattern(source) for source in sources]


def any_match(text: Column, patterns: list[Pattern]) -> Column:
    """True when one of the patterns is found in the text."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.coalesce(pattern.matches(text), F.lit(False))
    return out


def glob_to_java(glob: str) -> str | None:
    """Anchored regex of a file glob, or None for a malformed one.

    ``*`` and ``?`` stop at a slash, classes are ``[a-z]`` or ``[^a-z]``, a backslash escapes.
    """
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        if char == "*":
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(_literal(glob[i]))
        elif char == "[":
            read = _glob_class(glob, i + 1)
            if read is None:
                return None
            text, i = read
            out.append(text)
        else:
            out.append(_literal(char))
        i += 1
    return r"\A(?s:%s)\z" % "".join(out)


def _glob_class(glob: str, i: int):
    negated = glob.startswith("^", i)
    i += negated
    ranges = []
    while not (ranges and glob.startswith("]", i)):
        bounds = []
        while True:
            if i < len(glob) and glob[i] == "\\":
                i += 1
            elif i < len(glob) and glob[i] in "]-":
                return None
            if i >= len(glob):
                return None
            bounds.append(_literal(glob[i]))
            i += 1
            if len(bounds) == 2 or not glob.startswith("-", i):
                break
            i += 1
        ranges.append("-".join(bounds))
        if i >= len(glob):
            return None
    return "[" + ("^" if negated else "") + "".join(ranges) + "]", i


def _literal(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def matches_globs(name: Column, globs) -> Column:
    """True when the name matches one of the globs; empty and malformed globs match nothing."""
    regexes = [glob_to_java(glob) for glob in globs if glob]
    usable = [regex for regex in regexes if regex is not None]
    if not usable:
        return F.lit(False)
    return F.coalesce(name.rlike("|".join(usable)), F.lit(False))
