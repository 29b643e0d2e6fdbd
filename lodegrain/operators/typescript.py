"""What files of the TypeScript family define and name, read by tokens and bracket scopes.

A file becomes tokens: words, punctuation, literals; comments, strings, regular expressions, template parts and the text between JSX tags are told from code by the
lexer's states, so words in them are no names. Brackets are matched once, so the end of a statement is found by stepping over what they enclose, and a file costs
time in proportion to its length. Declarations count at any depth where a statement may begin; methods count directly inside the body of a declared class.
"""

from __future__ import annotations

import re
from bisect import bisect_right

EXTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Fixed values of the languages: words that name nothing, words after which an expression follows, modifiers of declarations and members.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default export".split())
MODIFIERS = frozenset("public private protected static async override abstract declare readonly accessor".split())
JSX_EXTS = (".tsx", ".jsx", ".js", ".mjs", ".cjs")
TOKEN = re.compile(
    r"(?P<skip>[^\S\n]+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<line>\n)|(?P<word>(?:[^\W\d]|\$)(?:\w|\$)*)|(?P<number>\d(?:\w|\.)*)"
    r"|(?P<string>'(?:[^'\\\n]|\\(?s:.))*'?|\"(?:[^\"\\\n]|\\(?s:.))*\"?)|(?P<mark>=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*%&|^]=|(?s:.))"
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*")
TEXT = re.compile(r"[^<{]*")
#: Marks after or before which a statement goes on over a line break.
OPEN_MARKS = frozenset("= => + - * / % & | ^ ? : , . ?. ( [ { < && || ?? == === != !== <= >= += -= *= %= &= |= ^= ! ~".split())
GOES_ON = frozenset("= => + * / % & | ^ ? : , . ?. ( [ && || ?? == === != !== <= >= += -= *= %= &= |= ^= < > ) ] } ` ;".split())
PAIRS = {")": "(", "]": "[", "}": "{"}


def tokens_of(text: str, jsx: bool) -> tuple[list[str], list[str], list[int]]:
    """Kinds (w word, m mark, l literal), texts and places of the tokens. A literal's text is empty."""
    kinds: list[str] = []
    texts: list[str] = []
    places: list[int] = []
    states, at, size = ["code"], 0, len(text)

    def put(kind: str, value: str) -> None:
        kinds.append(kind)
        texts.append(value)
        places.append(at)

    def value_follows() -> bool:
        """Whether an expression may begin here."""
        if not kinds:
            return True
        if kinds[-1] == "w":
            return texts[-1] in BEFORE_VALUE
        return kinds[-1] == "m" and texts[-1] not in (")", "]", "}", "++", "--")

    while at < size:
        state = states[-1]
        if state == "template":
            at = TEMPLATE.match(text, at).end()
            if at < size and text[at] == "`":
                states.pop()
                at += 1
            elif at < size:
                put("m", "{")
                states.append("code")
                at += 2
            continue
        if state == "children":
            at = TEXT.match(text, at).end()
            if at < size and text[at] == "{":
                put("m", "{")
                states.append("code")
                at += 1
            elif at < size:
                closing = text.startswith("</", at)
                states[-1:] = ["closing"] if closing else ["children", "tag"]
                at += 2 if closing else 1
            continue
        if state in ("tag", "closing") and text[at] in "/>":
            if text.startswith("/>", at):
                states.pop()
                put("l", "")
                at += 2
            elif text[at] == ">":
                states.pop()
                if state == "tag":
                    states.append("children")
                else:
                    put("l", "")
                at += 1
            else:
                at += 1
            continue
        if state in ("tag", "closing") and text[at] in "'\"":
            end = text.find(text[at], at + 1)  # such strings may hold line breaks
            at = size if end < 0 else end + 1
            continue
        if state in ("tag", "closing") and text[at] == "-":
            at += 1
            continue
        if text[at] == "/" and state == "code" and (value_follows() or (kinds and texts[-1] == "}" and kinds[-1] == "m")) and (m := REGEX.match(text, at)):
            put("l", "")
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "word":
            put("w", value)
        elif kind in ("number", "string"):
            put("l", "")
        elif kind == "mark":
            if value == "`":
                put("l", "")
                states.append("template")
            elif value == "<" and jsx and state == "code" and value_follows() and re.match(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*,|\s+extends\b|[\w$.:-]))", text[at : at + 200]):
                states.append("tag")
            else:
                put("m", value)
                if value == "{":
                    states.append("code")
                elif value == "}" and len(states) > 1 and state == "code":
                    states.pop()
        at = m.end()
    return kinds, texts, places


class Reader:
    """The declarations and names of one file."""

    def __init__(self, text: str, jsx: bool):
        self.kinds, self.texts, self.places = tokens_of(text, jsx)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.rows = [bisect_right(self.breaks, p - 1) if p else 0 for p in self.places]
        self.size = len(self.texts)
        self.match = self._matched()
        #: name, kind, line, column, end line, exported, and the row (from 0) where the statement begins.
        self.defined: list[tuple[str, str, int, int, int, bool, int]] = []
        #: Tokens that name what they declare.
        self.own: set[int] = set()
        self._read()

    def _matched(self) -> list[int]:
        """For each bracket the place of its partner; the end where it has none."""
        out, open_ = [self.size] * self.size, []
        for i, (kind, text) in enumerate(zip(self.kinds, self.texts, strict=True)):
            if kind != "m":
                continue
            if text in "([{":
                open_.append(i)
            elif text in PAIRS:
                for depth in range(len(open_) - 1, max(-1, len(open_) - 4), -1):  # a stray bracket spoils little
                    if self.texts[open_[depth]] == PAIRS[text]:
                        out[open_[depth]], out[i] = i, open_[depth]
                        del open_[depth:]
                        break
        return out

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.size and self.kinds[i] != "l" and self.texts[i] in texts

    def _named(self, i: int) -> bool:
        return i < self.size and self.kinds[i] == "w" and self.texts[i] not in RESERVED

    def _new_line(self, i: int) -> bool:
        return 0 < i < self.size and self.rows[i] > self.rows[i - 1]

    def _begins(self, i: int) -> bool:
        """Whether a statement may begin at a token: what comes before ends one, or stands on a line before and asks for nothing more."""
        p = i - 1
        if p < 0 or self._is(p, ";", "{", "}", "else", "do"):
            return True
        if self._is(p, ")"):
            o = self.match[p]
            return self._new_line(i) or 0 < o < self.size and self._is(o - 1, "if", "for", "while", "with")
        return self._new_line(i) and (self.kinds[p] == "l" or self._is(p, "]") or self.kinds[p] == "w" and self.texts[p] not in BEFORE_VALUE)

    def _begin_of(self, i: int) -> tuple[int, bool] | None:
        """Where the statement whose keyword stands at i begins, with its modifiers, and whether it is exported; None if it's no statement."""
        exported, begin = False, i
        while self._is(begin - 1, "export", "default", "declare", "abstract", "async") and not (self._is(begin - 1, "abstract", "async", "declare") and self._new_line(begin)):
            begin -= 1
            exported |= self._is(begin, "export")
        while self._is(begin - 1, ")") and 0 <= self.match[begin - 1] < begin and self._decorated(self.match[begin - 1] - 1) is not None:
            begin = self._decorated(self.match[begin - 1] - 1)
        while (plain := self._decorated(begin - 1)) is not None:
            begin = plain
        return (begin, exported) if self._begins(begin) or self._is(begin, "@") else None

    def _decorated(self, i: int) -> int | None:
        """Where @a.b, whose last word stands at i, begins."""
        while i > 0 and self.kinds[i] == "w":
            if self._is(i - 1, "@"):
                return i - 1
            if not self._is(i - 1, "."):
                return None
            i -= 2
        return None

    def _angles(self, i: int) -> int:
        """Past <...> at i, or i."""
        if not self._is(i, "<"):
            return i
        depth = 0
        while i < self.size:
            if self._is(i, "<"):
                depth += 1
            elif self._is(i, ">"):
                depth -= 1
                if not depth:
                    return i + 1
            elif self._is(i, "(", "[", "{"):
                i = self.match[i]
            elif self._is(i, ";", ")", "]", "}"):
                break
            i += 1
        return i

    def _end(self, i: int) -> int:
        """The last token of a statement that goes on at i: a semicolon, or what comes before a line break that ends it, or before its block's end."""
        begin = i
        while i < self.size:
            if self._is(i, ";"):
                return i
            if self._is(i, ")", "]", "}"):
                return i - 1
            if i > begin and self._new_line(i):
                p = i - 1
                asks = self.kinds[p] == "m" and self.texts[p] in OPEN_MARKS or self.kinds[p] == "w" and self.texts[p] in BEFORE_VALUE
                goes_on = self.kinds[i] == "m" and self.texts[i] in GOES_ON or self._is(i, "in", "instanceof", "as", "satisfies")
                if not asks and not goes_on:
                    return p
            if self._is(i, "(", "[", "{"):
                i = self.match[i]
            i += 1
        return self.size - 1

    def _body_end(self, i: int) -> int:
        """The end of a declaration with a block, which may begin at i or later: the block's end; without one the statement's end."""
        while i < self.size and not self._is(i, ";", "}"):
            if self._is(i, "(", "["):
                i = self.match[i]
            elif self._is(i, "<"):
                i = max(self._angles(i) - 1, i)
            elif self._is(i, "{"):
                close = self.match[i]
                if self._is(close + 1, "{") or self._is(close + 1, "|", "&", "[") and not self._new_line(close + 1):
                    i = close  # a type in braces goes before the block
                else:
                    return min(close, self.size - 1)
            elif self._new_line(i + 1) and not self._is(i + 1, "{", "(", "|", "&", ":", "=>", "extends", "implements", ",", ".") and not self._is(i, ",", "|", "&", ":", "=>", "(", "extends", "implements", "."):
                return i
            i += 1
        return min(i, self.size - 1) if self._is(i, ";") else min(i, self.size) - 1

    def _define(self, name: int, kind: str, end: int, begin: int, exported: bool, owner: str = "") -> None:
        self.own.add(name)
        row, place = self.rows[name], self.places[name]
        column = place - (self.breaks[row - 1] + 1 if row else 0)
        self.defined.append((owner + self.texts[name], kind, row + 1, column, self.rows[max(0, min(end, self.size - 1))] + 1, exported, self.rows[begin]))

    def _read(self) -> None:
        for i in range(self.size):
            if self.kinds[i] != "w" or self._is(i - 1, ".", "?."):
                continue
            word = self.texts[i]
            if word in ("const", "let", "var"):
                self._variables(i)
            elif word == "catch" and self._is(i + 1, "(") and self._named(i + 2):
                self.own.add(i + 2)
            elif word == "function":
                name = i + 2 if self._is(i + 1, "*") else i + 1
                if self._named(name) and (begin := self._begin_of(i)):
                    at = self._angles(name + 1)
                    self._define(name, "function", self._body_end(at), *begin)
            elif word == "class" and self._named(i + 1) and not self._is(i + 1, "implements"):
                if begin := self._begin_of(i):
                    self._class(i, *begin)
            elif word == "interface" and self._named(i + 1) and not self._new_line(i + 1) and (begin := self._begin_of(i)):
                at = i + 1
                while at < self.size and not self._is(at, "{"):
                    at = max(self._angles(at), at + 1) if self._is(at, "<") else at + 1
                self._define(i + 1, "interface", self.match[at] if at < self.size else at, *begin)
            elif word == "type" and self._named(i + 1) and not self._new_line(i + 1) and self._is(self._angles(i + 2), "=") and (begin := self._begin_of(i)):
                self._define(i + 1, "type", self._end(self._angles(i + 2)), *begin)
            elif word == "enum" and self._named(i + 1) and self._is(i + 2, "{") and (begin := self._begin_of(i - 1 if self._is(i - 1, "const") else i)):
                self._define(i + 1, "enum", self.match[i + 2], *begin)

    def _function_at(self, i: int) -> bool:
        """Whether an arrow function or a function expression begins at i."""
        if self._is(i, "async") and not self._new_line(i + 1):
            i += 1
        if self._is(i, "function"):
            at = i
            while at < self.size and not self._is(at, "("):
                at += 1
            after = self._body_end(at) + 1
            return not self._is(after, "(", ".", "[", "?.") or self._new_line(after) and not self._is(after, "(", ".", "[")
        if self._named(i) and self._is(i + 1, "=>"):
            return True
        i = self._angles(i)
        if not self._is(i, "("):
            return False
        i = self.match[i] + 1
        if self._is(i, ":"):  # the type of what it returns
            while i < self.size and not self._is(i, "=>", ";", ",", ")", "]", "}", "="):
                i = max(self._angles(i), i + 1) if self._is(i, "<") else self.match[i] + 1 if self._is(i, "(", "[", "{") else i + 1
        return self._is(i, "=>")

    def _variables(self, i: int) -> None:
        """Names of const, let and var: statements define them, loops only own them."""
        if self._is(i - 1, "("):
            if self._named(i + 1):
                self.own.add(i + 1)
            return
        begin = self._begin_of(i)
        if begin is None or self._is(i + 1, "enum"):
            return
        end, at = self._end(i + 1), i + 1
        while at <= end:
            name, value = at, None
            depth_end = at
            while depth_end <= end and not self._is(depth_end, ",", ";"):
                if self._is(depth_end, "=") and value is None:
                    value = depth_end + 1
                if self._is(depth_end, "<") and value is None:
                    depth_end = max(self._angles(depth_end), depth_end + 1)
                else:
                    depth_end = self.match[depth_end] + 1 if self._is(depth_end, "(", "[", "{") else depth_end + 1
            if self._named(name):
                self._define(name, "function" if value is not None and self._function_at(value) else "variable", end, *begin)
            at = depth_end + 1

    def _class(self, i: int, begin: int, exported: bool) -> None:
        at = i + 2
        while at < self.size and not self._is(at, "{"):
            at = max(self._angles(at), at + 1) if self._is(at, "<") else self.match[at] + 1 if self._is(at, "(", "[") else at + 1
        close = self.match[at] if at < self.size else self.size
        self._define(i + 1, "class", close, begin, exported)
        owner, at = self.texts[i + 1] + ".", at + 1
        while at < min(close, self.size):
            at = self._member(at, close, owner, exported)

    def _member(self, at: int, close: int, owner: str, exported: bool) -> int:
        """Read the member of a class that begins at a token; where the next one begins."""
        begin = at
        while self._is(at, "@"):
            at += 2
            while self._is(at, "."):
                at += 2
            at = self.match[at] + 1 if self._is(at, "(") else at
        accessor = False
        while at < close and self.kinds[at] == "w" and self.texts[at] in MODIFIERS | {"get", "set"} and not self._is(at + 1, "(", "=", ":", ";", "?", "!", "<", "}", ","):
            if self.texts[at] in ("get", "set"):
                if self._new_line(at + 1):
                    break
                accessor = True
            at += 1
        at += self._is(at, "*")
        if self._is(at, "{"):  # a static block
            return self.match[at] + 1
        if at >= close or self._is(at, ";"):
            return at + 1
        name, plain = at, self.kinds[at] == "w" and not self._is(at - 1, "#")
        at = self.match[at] + 1 if self._is(at, "[") else at + 2 if self._is(at, "#") else at + 1
        at += self._is(at, "?", "!")
        past = self._angles(at)
        if self._is(past, "("):
            end = self._body_end(past)
            if plain and not accessor and self.texts[name] != "constructor":
                self._define(name, "method", end, begin, exported, owner)
            return min(end, close) + 1
        if plain:
            self.own.add(name)
        end = self._end(at)
        if self._is(end + 1, "}") and end + 1 < close:  # a stray bracket
            end += 1
        return max(end, name) + 1

    def names(self) -> list[str]:
        """Names in the file, but for those at the places that declare them."""
        return sorted({t for i, (k, t) in enumerate(zip(self.kinds, self.texts, strict=True)) if k == "w" and t not in RESERVED and i not in self.own})


def read(text: str, ext: str) -> tuple[list[tuple], list[str]]:
    """Definitions (name, kind, line, column, end line, exported, row where the statement begins) and names of one file."""
    file = Reader(text, ext in JSX_EXTS)
    return file.defined, file.names()
