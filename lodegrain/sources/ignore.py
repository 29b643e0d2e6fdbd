"""Ignore files: ordered rules with negation, as one pattern for a folder's walk and as an expression over tables of paths.

A rule without a slash inside is for names at any depth, others for paths from the ignore file's folder; a slash at the end asks for folders. The last rule that
fits decides, and nothing below an ignored folder comes back. Case plays no part unless asked for. White space at the end of a rule is cut unless it is escaped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = ".gitignore"


@dataclass(frozen=True)
class Rule:
    """A regular expression for whole paths below the ignore file's folder, in the part that Python and Java share."""

    pattern: str
    negated: bool
    folders_only: bool


def _translated(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at) and (not at or glob[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif glob[at:] == "**" and (not at or glob[at - 1] == "/"):
            out, at = out + ".+", at + 2
        elif c == "*":
            while at < len(glob) and glob[at] == "*":
                at += 1
            out += "[^/]*"
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]").match(glob, at)):
            inner = re.sub(r"[\[&~|]|^\]", lambda x: "\\" + x.group(), m[2])
            out, at = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", m.end()
        elif c == "\\" and at + 1 < len(glob):
            out, at = out + re.escape(glob[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    return out


def rules_of(text: str) -> list[Rule]:
    """The rules of an ignore file, in order. Lines that make no pattern are left out."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        glob = line[negated:]
        folders_only = glob.endswith("/")
        glob = glob.rstrip("/") if folders_only else glob
        anchored = "/" in glob
        glob = glob.removeprefix("/")
        if not glob:
            continue
        pattern = ("" if anchored else "(?:[^/]+/)*") + _translated(glob)
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append(Rule(pattern, negated, folders_only))
    return out


class Matcher:
    """The rules of one folder's ignore file as one pattern each for files and folders: the first alternative that fits is the last rule that does."""

    def __init__(self, rules: list[Rule], case: bool = False):
        self.rules = rules
        self.patterns = [self._joined([(i, r) for i, r in enumerate(rules) if folder or not r.folders_only], case) for folder in (False, True)]

    @staticmethod
    def _joined(rules: list[tuple[int, Rule]], case: bool) -> re.Pattern | None:
        return re.compile("|".join(f"(?P<r{i}>{r.pattern})$(?!\\n)" for i, r in reversed(rules)), 0 if case else re.IGNORECASE) if rules else None

    def verdict(self, path: str, folder: bool) -> bool | None:
        """Whether a path below the folder is ignored; None if no rule fits."""
        pattern = self.patterns[folder]
        m = pattern.match(path) if pattern else None
        return None if m is None else not self.rules[int(m.lastgroup[1:])].negated


def ignored(path: Column, rules: list[Rule], case: bool = False) -> Column:
    """Whether the rules of an ignore file at the root leave out a relative path, or a folder above it."""
    flags = "(?s)" if case else "(?is)"
    fits = lambda p, r: p.rlike(f"{flags}^(?:{r.pattern})\\z")
    last = lambda p, folder: F.coalesce(*(F.when(fits(p, r), F.lit(not r.negated)) for r in reversed(rules) if folder or not r.folders_only), F.lit(False))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return last(path, False) | F.exists(F.slice(above, F.lit(1), F.size(parts) - 1), lambda p: last(p, True)) if rules else F.lit(False)
