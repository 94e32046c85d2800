"""Patterns of finite automata, as users of grep write them, put into Java's syntax.

A pattern is read into a small tree and printed again, with everything spelled out that the
two dialects see differently: classes of letters, digits and spaces are those of Unicode,
``$`` is the end of the text, ``.`` is anything but a line feed, ``x++`` repeats a
repetition, and flags hold from where they stand to the end of their group. Look-around,
back-references and atomic groups are no part of the dialect and are refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import regex

# What the classes hold, in Java's syntax for the inside of brackets.
WORD, WORD_ASCII = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}", "0-9A-Z_a-z"
DIGIT, DIGIT_ASCII = r"\p{Nd}", "0-9"
SPACE, SPACE_ASCII = r"\p{IsWhite_Space}", r"\x{9}-\x{D}\x{20}"
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x{0}-\x{7F}", "blank": r"\x{9}\x{20}", "cntrl": r"\x{0}-\x{1F}\x{7F}", "digit": "0-9", "graph": r"\x{21}-\x{7E}", "lower": "a-z",
    "print": r"\x{20}-\x{7E}", "punct": r"\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}", "space": SPACE_ASCII, "upper": "A-Z", "word": WORD_ASCII, "xdigit": "0-9A-Fa-f",
}
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "combiningmark": "M",
    "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "digit": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "punct": "P",
    "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "cntrl": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
PROPERTIES = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "whitespace": "White_Space", "space": "White_Space", "uppercase": "Uppercase", "upper": "Uppercase", "lowercase": "Lowercase", "lower": "Lowercase", "ideographic": "Ideographic", "joincontrol": "Join_Control"}
ESCAPED = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}


class PatternError(ValueError):
    """A pattern that the dialect does not have."""


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    R: bool = False
    U: bool = False
    u: bool = True
    x: bool = False


@dataclass
class Node:
    """``kind`` is one of: char (a class for brackets), at (an assertion), cat, or, group, times."""

    kind: str
    text: str = ""
    parts: list[Node] = field(default_factory=list)
    flags: Flags = Flags()


def java_pattern(pattern: str) -> str:
    """The pattern in Java's syntax, which needs no further flags."""
    return _Reader(pattern).whole()


def _code(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else f"\\x{{{code:X}}}"


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.flags, self.names = pattern, 0, Flags(), set()

    def whole(self) -> str:
        found = self.either()
        if self.at < len(self.pattern):
            raise self.wrong("unopened group")
        return _printed(found)

    def wrong(self, why: str) -> PatternError:
        return PatternError(f"invalid regex: {why} at {self.at}: {self.pattern}")

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        found = self.peek(n)
        if len(found) < n:
            raise self.wrong("unexpected end")
        self.at += n
        return found

    def had(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def until(self, end: str, why: str) -> str:
        stop = self.pattern.find(end, self.at)
        if stop < 0:
            raise self.wrong(why)
        found, self.at = self.pattern[self.at : stop], stop + len(end)
        return found

    def blank(self) -> None:
        """With the flag x, white space and comments between things mean nothing."""
        while self.flags.x and self.at < len(self.pattern):
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.pattern.find("\n", self.at)
                self.at = len(self.pattern) if end < 0 else end
            else:
                return

    def either(self) -> Node:
        before, choices = self.flags, [self.row()]
        while self.had("|"):
            choices.append(self.row())
        self.flags = before
        return choices[0] if len(choices) == 1 else Node("or", parts=choices)

    def row(self) -> Node:
        parts: list[Node] = []
        while True:
            self.blank()
            c = self.peek()
            if c in ("", "|", ")"):
                return Node("cat", parts=parts)
            if c in ("*", "+", "?", "{"):
                if not parts or parts[-1].kind == "flags":
                    raise self.wrong("nothing to repeat")
                parts.append(self.times(parts.pop()))
            else:
                parts.append(self.one())

    def times(self, part: Node) -> Node:
        c = self.take()
        if c == "{":
            self.blank()
            bounds = self.until("}", "unclosed repetition").strip()
            least, comma, most = (x.strip() for x in bounds.partition(","))
            if not (least or comma and most) or not (least + most).isdecimal() or most and int(most) < int(least or 0):
                raise self.wrong(f"invalid repetition {{{bounds}}}")
            shown = f"{{{int(least or 0)}{comma}{most}}}"
        else:
            shown = c
        self.blank()
        lazy = self.had("?") != self.flags.U
        return Node("times", shown + ("?" if lazy else ""), [part])

    def one(self) -> Node:
        c, flags = self.take(), self.flags
        if c == "(":
            return self.group()
        if c == "[":
            return Node("char", self.bracket(), flags=flags)
        if c == ".":
            none = "" if flags.s else r"\x{A}\x{D}" if flags.R else r"\x{A}"
            return Node("char", f"[^{none}]" if none else r"[\x{0}-\x{10FFFF}]", flags=flags)
        if c == "^":
            lines = r"(?:\A|(?<=\n)|(?<=\r)(?!\n))" if flags.R else r"(?:\A|(?<=\n))"
            return Node("at", lines if flags.m else r"\A")
        if c == "$":
            lines = r"(?:\z|(?=\r)|(?<!\r)(?=\n))" if flags.R else r"(?:\z|(?=\n))"
            return Node("at", lines if flags.m else r"\z")
        if c == "\\":
            return self.escaped()
        return Node("char", _code(ord(c)), flags=flags)

    def group(self) -> Node:
        before = self.flags
        if not self.had("?"):
            pass
        elif self.had("P<") or self.peek() == "<" and self.peek(2) not in ("<=", "<!") and self.had("<"):
            name = self.until(">", "unclosed group name")
            if not regex.fullmatch(r"[\p{Alphabetic}_][\p{Alphabetic}\p{N}_.\[\]]*", name) or name in self.names:
                raise self.wrong(f"invalid group name {name!r}")
            self.names.add(name)
        elif self.peek() in ("=", "!", ">") or self.peek(2) in ("<=", "<!"):
            raise self.wrong("look-around and atomic groups are not supported")
        else:
            self.flags = self.switched()
            if self.had(")"):
                return Node("flags")  # these hold until the group that they stand in ends
            self.take()  # the colon
        found = self.either()
        self.flags = before
        if not self.had(")"):
            raise self.wrong("unclosed group")
        return Node("group", parts=[found])

    def switched(self) -> Flags:
        """The flags named up to a colon or the end of the group."""
        found, on, seen = self.flags, True, ""
        while self.peek() not in (":", ")"):
            c = self.take()
            if c == "-" and on:
                on = False
            elif c in "imsRUux" and c not in seen:
                found, seen = replace(found, **{c: on}), seen + c
            else:
                raise self.wrong(f"invalid flag {c!r}")
        if not on and not seen or self.pattern[self.at - 1] == "-":
            raise self.wrong("missing flag")
        if self.peek() == ")" and not seen:
            raise self.wrong("missing flag")
        return found

    def escaped(self) -> Node:
        """What follows a backslash outside brackets."""
        c, flags = self.peek(), self.flags
        word = WORD if flags.u else WORD_ASCII
        starts, ends = f"(?<![{word}])(?=[{word}])", f"(?<=[{word}])(?![{word}])"
        if c in ("A", "z"):
            self.take()
            return Node("at", "\\" + c)
        if c == "B":
            self.take()
            return Node("at", f"(?!{starts}|{ends})")
        if c in ("<", ">"):
            return Node("at", starts if self.take() == "<" else ends)
        if c == "b":
            self.take()
            halves = {"start": starts, "end": ends, "start-half": f"(?<![{word}])", "end-half": f"(?![{word}])"}
            for name, shown in halves.items():
                if self.had(f"{{{name}}}"):
                    return Node("at", shown)
            return Node("at", f"(?:{starts}|{ends})")
        found = self.klass()
        return Node("char", found if found is not None else _code(self.escaped_code()), flags=flags)

    def klass(self) -> str | None:
        """A class named by a letter after a backslash, in brackets."""
        c, u = self.peek(), self.flags.u
        inside = {"w": WORD if u else WORD_ASCII, "d": DIGIT if u else DIGIT_ASCII, "s": SPACE if u else SPACE_ASCII}.get(c.lower())
        if c in ("p", "P"):
            self.take()
            name = self.until("}", "unclosed property") if self.had("{") else self.take()
            negated = (c == "P") != name.startswith("^")
            return f"[{'^' if negated else ''}{self.property(name.removeprefix('^'))}]"
        if inside is None:
            return None
        self.take()
        return f"[{'^' if c.isupper() else ''}{inside}]"

    def property(self, name: str) -> str:
        """A property's characters; names are read without regard to case, spaces, dashes and underscores."""
        key, equals, value = name.replace(":", "=").partition("=")
        loose = regex.sub(r"[\s_-]", "", value if equals else key).lower().removeprefix("is")
        kind = regex.sub(r"[\s_-]", "", key).lower() if equals else ""
        if not loose or not self.flags.u or kind not in ("", "gc", "generalcategory", "sc", "script", "scx", "scriptextensions"):
            raise self.wrong(f"unknown property {name!r}")
        if kind in ("", "gc", "generalcategory"):
            short = CATEGORIES.get(loose) or next((x for x in CATEGORIES.values() if x.lower() == loose), None)
            if short:
                return r"\p{Lu}\p{Ll}\p{Lt}" if short == "LC" else f"\\p{{{short}}}"
        if not kind and loose in ("any", "ascii", "assigned"):
            return {"any": r"\x{0}-\x{10FFFF}", "ascii": r"\x{0}-\x{7F}", "assigned": r"\P{Cn}"}[loose]
        if not kind and loose in PROPERTIES:
            return f"\\p{{Is{PROPERTIES[loose]}}}"
        if kind.startswith("g"):
            raise self.wrong(f"unknown property {name!r}")
        try:
            regex.compile(rf"\p{{Script={loose}}}")
        except regex.error:
            raise self.wrong(f"unknown property {name!r}") from None
        words = regex.split(r"[\s_-]+", (value if equals else key).strip())
        return f"\\p{{Is{'_'.join(x.capitalize() for x in words)}}}"

    def escaped_code(self) -> int:
        """The character that an escape stands for."""
        c = self.take()
        if c in ESCAPED:
            return ESCAPED[c]
        if c in ("x", "u", "U"):
            digits = self.until("}", "unclosed hexadecimal") if self.had("{") else self.take({"x": 2, "u": 4, "U": 8}[c])
            if not regex.fullmatch("[0-9A-Fa-f]+", digits) or int(digits, 16) > 0x10FFFF or 0xD800 <= int(digits, 16) < 0xE000:
                raise self.wrong(f"invalid hexadecimal {digits!r}")
            return int(digits, 16)
        if c.isdigit():
            raise self.wrong("back-references are not supported")
        if c.isascii() and not c.isalnum() and c not in "<>" and (c.isprintable() or self.flags.x):
            return ord(c)
        raise self.wrong(f"unknown escape \\{c}")

    def bracket(self) -> str:
        """A class in brackets, after its opening one."""
        negated = self.had("^")
        found = self.operand(True)
        while True:
            if self.had("&&"):
                found = f"[{found}&&{self.operand(False)}]"
            elif self.had("--"):
                found = f"[{found}&&[^{self.operand(False)}]]"
            elif self.had("~~"):
                other = self.operand(False)
                found = f"[[{found}&&[^{other}]][{other}&&[^{found}]]]"
            else:
                break
        self.take()  # the closing bracket
        return f"[^{found}]" if negated else found

    def operand(self, first: bool) -> str:
        """What stands between operators, as a class of its own."""
        parts: list[str] = []
        while True:
            self.blank()
            c = self.peek()
            if c == "":
                raise self.wrong("unclosed class")
            if c == "]" and not (first and not parts) or self.peek(2) in ("&&", "--", "~~"):
                return f"[{''.join(parts)}]" if parts else r"[^\x{0}-\x{10FFFF}]"
            if c == "[":
                parts.append(self.posix() or self.nested())
                continue
            low = self.member()
            if isinstance(low, str):
                parts.append(low)
                continue
            after = self.peek(2)
            if after[:1] == "-" and after not in ("-]", "--", "-"):
                self.take()
                high = self.member()
                if isinstance(high, str) or high < low:
                    raise self.wrong("invalid range")
                parts.append(f"{_code(low)}-{_code(high)}")
            else:
                parts.append(_code(low))

    def posix(self) -> str | None:
        found = regex.compile(r"\[:(\^?)(\w+):\]").match(self.pattern, self.at)
        if not found or found[2] not in POSIX:
            return None
        self.at = found.end()
        return f"[{found[1]}{POSIX[found[2]]}]"

    def nested(self) -> str:
        self.take()
        return self.bracket()

    def member(self) -> str | int:
        """A character, or the class that an escape names."""
        if not self.had("\\"):
            return ord(self.take())
        return found if (found := self.klass()) is not None else self.escaped_code()


def _printed(node: Node) -> str:
    if node.kind == "char":
        return f"(?{'iu' if node.flags.u else 'i'}:{node.text})" if node.flags.i else node.text
    if node.kind == "at":
        return node.text
    if node.kind == "or":
        return "|".join(map(_printed, node.parts))
    if node.kind == "group":
        return f"({_printed(node.parts[0])})"
    if node.kind == "times":
        part, once = node.parts[0], _printed(node.parts[0])
        if part.kind == "times":
            pair = part.text + node.text
            if pair in ("++", "??"):  # the same once
                return once
            if len(pair) == 2:
                return _printed(Node("times", "*", part.parts))
        return (once if part.kind in ("char", "group") else f"(?:{once})") + node.text
    # A row: neighbours that ignore case share one switch.
    shown, run, switch = [], [], ""
    for part in [*node.parts, Node("end")]:
        own = ("(?iu:" if part.flags.u else "(?i:") if part.kind == "char" and part.flags.i else ""
        if run and own != switch:
            shown.append(f"{switch}{''.join(run)})")
            run = []
        switch = own
        if own:
            run.append(part.text)
        elif part.kind not in ("flags", "end"):
            shown.append(_printed(part))
    return "".join(shown)
