"""Question sets: QS (binary, any of several patterns) and CQS (numeric, one pattern with a group)."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Groups that stay regular expressions when a pattern is escaped, as question files write them.
NUMBER_GROUPS = {r"(\d+)": r"(\d+)", r"([-\d]+)": r"([-\d]+)", r"([\d\.]+)": r"([\d\.]+)"}
SINGING_GROUPS = {r"([A-Z][b]?[0-9]+)": r"([A-Z][b]?[0-9]+)", r"(\NOTE)": r"([A-Z][b]?[0-9]+)", r"([pm]\d+)": r"([pm]\d+)"}


@dataclass(frozen=True)
class Pattern:
    """What a context must hold: parts one after the other, each a literal text, "*" (anything) or a regular expression of one group; at the context's start or end where these hold an anchor."""

    parts: tuple[tuple[str, str], ...]
    start: str = ""
    end: str = ""

    def regex(self) -> str:
        """The same as a Java regular expression to be found in a context."""
        text = "".join({"*": ".*", "text": re.escape(x)}.get(kind, x) for kind, x in self.parts)
        return self.start + text + self.end


@dataclass(frozen=True)
class Question:
    kind: str
    name: str
    wanted: tuple[Pattern, ...]
    signed: bool = False

    @property
    def patterns(self) -> tuple[str, ...]:
        return tuple(p.regex() for p in self.wanted)


def wanted(wildcards: str, numbers: bool = False, singing: bool = True) -> Pattern:
    """Of a question file's item. Ends are anchored only if there is a * elsewhere; ? is literal."""
    body = wildcards.strip("*")
    keep = {**(NUMBER_GROUPS if numbers else {}), **(SINGING_GROUPS if singing else {})}
    parts = re.split("(" + "|".join(map(re.escape, [*keep, "*"])) + ")", body)
    kinds = tuple(("*", "*") if p == "*" else ("group", keep[p]) if p in keep else ("text", p) for p in parts if p)
    starred = "*" in wildcards
    return Pattern(kinds, r"\A" if starred and wildcards[0] != "*" else "", r"\z" if starred and wildcards[-1] != "*" else "")


def pattern(wildcards: str, numbers: bool = False, singing: bool = True) -> str:
    """A Java regular expression to be found in a context."""
    return wanted(wildcards, numbers, singing).regex()


def parse(text: str, hat_for_ll: bool = True, singing: bool = True) -> tuple[list[Question], list[Question]]:
    """(binary, numeric) questions of a file's text; blank lines and # are skipped, other keywords are errors."""
    binary, numeric = [], []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        m = re.match(r'(\S+)\s+"?([^"\s]+)"?\s*\{(.*)\}', line)
        if not m or m[1] not in ("QS", "CQS"):
            raise ValueError(f"not a question: {line}")
        kind, name, items = m[1], m[2], [x.strip().strip('"') for x in m[3].split(",")]
        patterns = tuple(wanted(x, kind == "CQS", singing) for x in items)
        if kind == "CQS":
            if len(patterns) != 1:
                raise ValueError(f"{name} has {len(patterns)} patterns")
            numeric.append(Question(kind, name, patterns, any(x == r"([-\d]+)" for _, x in patterns[0].parts)))
        else:
            ll = hat_for_ll and "LL-" in name
            binary.append(Question(kind, name, tuple(replace(p, start=p.start or "^") if ll else p for p in patterns)))
    return binary, numeric


def load(spark, path: str, **how) -> tuple[list[Question], list[Question]]:
    """Of a file in any store that Spark reads. A question set is small and stays with the driver."""
    return parse(spark.read.text(path, wholetext=True).first()[0], **how)
