"""The regular-expression dialect of log patterns, parsed and written for Java's engine.

The dialect is the linear-time family's: Unicode classes by default, named groups as ``(?P<name>..)``
or ``(?<name>..)``, ``\\p{..}`` properties, POSIX classes in brackets, bracket operators ``&&``,
``--`` and ``~~``, the flags ``i m s x U u`` anywhere (``(?i)`` holds to the end of its group), ``$``
as the very end of the text, no look-around and no back-references. Java reads the same characters
otherwise in a number of places, so a pattern is parsed into a small tree first and every node is
written in a form that means the same there. The tree also tells what a matcher can use: the number
of groups, literal text that every match contains, whether group 1 takes part in every match.

Whether Java knows a script or property name is for Java to say: patterns are compiled by the JVM
before a job starts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache


class PatternError(ValueError):
    """A pattern that is not valid in the dialect, or uses what cannot be carried over."""

    def __init__(self, pattern: str, place: int, problem: str):
        super().__init__(f"{problem} at character {place} of pattern {pattern!r}")


# Tree -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    char: str
    fold: bool = False


@dataclass(frozen=True)
class OneOf:
    """Exactly one character, as Java text."""

    java: str
    fold: bool = False


@dataclass(frozen=True)
class Anchor:
    """Matches no text itself, as Java text."""

    java: str


@dataclass(frozen=True)
class Group:
    """``index`` 0: groups without capturing."""

    index: int
    item: object


@dataclass(frozen=True)
class Repeat:
    item: object
    low: int
    high: int | None
    lazy: bool


@dataclass(frozen=True)
class Sequence:
    items: tuple


@dataclass(frozen=True)
class Choice:
    items: tuple


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    x: bool = False
    U: bool = False
    u: bool = True


# Characters and classes -----------------------------------------------------------------------

_META = set("\\.+*?()|[]{}^$#&-~")
# Escapes that stand for one character.
_CONTROL = {"a": "\x07", "f": "\x0c", "t": "\t", "n": "\n", "r": "\r", "v": "\x0b"}
# The ASCII classes that brackets know by name, as ranges.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t\\x20", "cntrl": "\\x00-\\x1F\\x7F",
    "digit": "0-9", "graph": "\\x21-\\x7E", "lower": "a-z", "print": "\\x20-\\x7E", "punct": "\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E",
    "space": "\\t-\\r\\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
# Long names of general categories.
_CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt",
    "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "combiningmark": "M", "nonspacingmark": "Mn",
    "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl",
    "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd",
    "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf",
    "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk",
    "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
_SHORT = {short.lower(): short for short in _CATEGORIES.values()}
# Properties that a character has or has not, by the names that Java gives them.
_BINARY = {
    "alphabetic": "Alphabetic", "alpha": "Alphabetic", "ideographic": "Ideographic", "lowercase": "Lowercase",
    "lower": "Lowercase", "uppercase": "Uppercase", "upper": "Uppercase", "whitespace": "White_Space",
    "space": "White_Space", "hexdigit": "Hex_Digit", "joincontrol": "Join_Control", "emoji": "Emoji",
    "noncharactercodepoint": "Noncharacter_Code_Point", "extendedpictographic": "Extended_Pictographic",
}
_ASCII_CLASSES = {"d": "0-9", "s": "\\t-\\r\\x20", "w": "0-9A-Za-z_"}
_UNICODE_CLASSES = {
    "d": "\\p{Nd}", "s": "\\p{IsWhite_Space}", "w": "\\p{IsAlphabetic}\\p{M}\\p{Nd}\\p{Pc}\\p{IsJoin_Control}",
}


def _char(c: str) -> str:
    """A character as Java text that means itself, also in brackets."""
    if c.isalnum() or c in " _\"'!%,/:;<=>@`":
        return c
    return f"\\x{{{ord(c):X}}}" if not c.isprintable() or c.isspace() else f"\\{c}" if ord(c) < 128 else c


def escape(text: str) -> str:
    """A pattern of the dialect that matches this text."""
    return "".join(f"\\{c}" if c in _META else c for c in text)


def _bracket(inner: str, negated: bool = False) -> str:
    return f"[{'^' if negated else ''}{inner}]"


@dataclass(frozen=True)
class _Set:
    """A set of characters: the inside of Java brackets, or (``whole``) Java text matching one of it.

    Sets that brackets cannot hold without doubt (operators, nested negations) are written as
    one-character look-aheads.
    """

    text: str
    whole: bool = False

    @property
    def one(self) -> str:
        return self.text if self.whole else _bracket(self.text) if self.text else "(?!)"

    def negated(self) -> _Set:
        if not self.whole and self.text:
            return _Set(_bracket(self.text, True), True)
        return _Set(f"(?:(?!{self.one})[\\x{{0}}-\\x{{10FFFF}}])", True)

    def union(self, other: _Set) -> _Set:
        if not self.text:
            return other
        if self.whole or other.whole:
            return _Set(f"(?:{self.one}|{other.one})", True)
        return _Set(self.text + other.text)

    def without(self, other: _Set) -> _Set:
        return _Set(f"(?:(?!{other.one}){self.one})", True)

    def also(self, other: _Set) -> _Set:
        return _Set(f"(?:(?={other.one}){self.one})", True)


# Parser ---------------------------------------------------------------------------------------


class _Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.groups, self.names = pattern, 0, 0, set()

    def fail(self, problem: str, place: int | None = None):
        raise PatternError(self.pattern, self.at if place is None else place, problem)

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def skip_space(self, flags: Flags) -> None:
        while flags.x and self.peek():
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.pattern.find("\n", self.at)
                self.at = len(self.pattern) if end < 0 else end + 1
            else:
                break

    def whole(self):
        tree = self.choice(Flags())
        if self.at < len(self.pattern):
            self.fail("unopened group")
        return tree

    def choice(self, flags: Flags):
        """Alternatives up to the end of the group. A flag set in one holds in those after it."""
        branches, items = [], []
        while True:
            self.skip_space(flags)
            c = self.peek()
            if c in ("", ")"):
                break
            if c == "|":
                self.at += 1
                branches.append(Sequence(tuple(items)))
                items = []
                continue
            start = self.at
            atom = self.atom(flags)
            if isinstance(atom, Flags):
                flags = atom
                self.skip_space(flags)
                if self.peek() in ("*", "+", "?", "{") and self.peek():
                    self.fail("nothing to repeat")
                continue
            items.append(self.repeated(atom, flags, start))
        branches.append(Sequence(tuple(items)))
        return branches[0] if len(branches) == 1 else Choice(tuple(branches))

    def repeated(self, atom, flags: Flags, start: int):
        while True:
            self.skip_space(flags)
            c = self.peek()
            if c and c in "*+?":
                self.at += 1
                low, high = (1 if c == "+" else 0), (1 if c == "?" else None)
            elif c == "{":
                low, high = self.bounds(flags)
            else:
                return atom
            lazy = self.take("?") != flags.U
            atom = Repeat(atom, low, high, lazy)

    def bounds(self, flags: Flags) -> tuple[int, int | None]:
        start = self.at
        end = self.pattern.find("}", start)
        if end < 0:
            self.fail("unclosed counted repetition")
        parts = [p.strip() for p in self.pattern[start + 1 : end].split(",")]
        if len(parts) > 2 or not parts[0] or not all(p.isascii() and p.isdigit() for p in parts if p):
            self.fail("invalid counted repetition")
        low = int(parts[0])
        high = low if len(parts) == 1 else int(parts[1]) if parts[1] else None
        if high is not None and high < low:
            self.fail("invalid counted repetition")
        self.at = end + 1
        return low, high

    def atom(self, flags: Flags):
        c = self.peek()
        if c == "(":
            return self.group(flags)
        if c == "[":
            return OneOf(self.bracket(flags).one, flags.i)
        if c in "*+?{":
            self.fail("nothing to repeat")
        self.at += 1
        if c == ".":
            return OneOf("[\\x{0}-\\x{10FFFF}]" if flags.s else "[^\\n]")
        if c == "^":
            return Anchor("(?:\\A|(?<=\\n))" if flags.m else "\\A")
        if c == "$":
            return Anchor("(?=\\n|\\z)" if flags.m else "\\z")
        if c == "\\":
            return self.escaped(flags)
        return self.literal(c, flags)

    def literal(self, c: str, flags: Flags) -> Literal:
        return Literal(c, flags.i and c.lower() != c.upper())

    def group(self, flags: Flags):
        start = self.at
        self.at += 1
        index, inside = 0, flags
        if self.take("?"):
            if self.take("P<") or self.peek(1) == "<" and self.peek(2) not in ("<=", "<!") and self.take("<"):
                end = self.pattern.find(">", self.at)
                name = self.pattern[self.at : end] if end >= 0 else ""
                if not name or not (name[0] == "_" or name[0].isalpha()) or not all(x.isalnum() or x in "_.[]" for x in name):
                    self.fail("invalid group name")
                if name in self.names:
                    self.fail(f"group name {name!r} is used twice")
                self.names.add(name)
                self.at = end + 1
                self.groups += 1
                index = self.groups
            elif self.peek() in ("=", "!") or self.peek(2) in ("<=", "<!"):
                self.fail("look-around is not supported", start)
            else:
                inside = self.flags(flags)
                if self.take(")"):
                    return inside
                if not self.take(":"):
                    self.fail("unclosed group", start)
        else:
            self.groups += 1
            index = self.groups
        item = self.choice(inside)
        if not self.take(")"):
            self.fail("unclosed group", start)
        return Group(index, item)

    def flags(self, flags: Flags) -> Flags:
        value, seen = True, set()
        while self.peek() not in (":", ")", ""):
            c = self.peek()
            if c == "-" and value:
                value = False
            elif c == "R":
                self.fail("flag R (line ends of two characters) is not supported")
            elif c in "imsxUu" and c not in seen:
                seen.add(c)
                flags = replace(flags, **{c: value})
            else:
                self.fail("unknown or repeated flag")
            self.at += 1
        if not value and self.pattern[self.at - 1] == "-" or not seen and self.peek() == ")":
            self.fail("missing flag")
        return flags

    def escaped(self, flags: Flags):
        """What follows a backslash outside brackets."""
        c = self.peek()
        if c in ("A", "z"):
            self.at += 1
            return Anchor(f"\\{c}")
        if c in ("b", "B", "<", ">"):
            self.at += 1
            return Anchor(self.boundary(c, flags))
        if c.isdigit():
            self.fail("back-references are not supported")
        found = self.class_escape(flags)
        return OneOf(found.one, flags.i) if isinstance(found, _Set) else self.literal(found, flags)

    def boundary(self, kind: str, flags: Flags) -> str:
        word = _bracket((_UNICODE_CLASSES if flags.u else _ASCII_CLASSES)["w"])
        starts, ends = f"(?<!{word})(?={word})", f"(?<={word})(?!{word})"
        if kind == "<" or kind == "b" and self.take("{start}"):
            return starts
        if kind == ">" or kind == "b" and self.take("{end}"):
            return ends
        if kind == "b" and self.take("{start-half}"):
            return f"(?<!{word})"
        if kind == "b" and self.take("{end-half}"):
            return f"(?!{word})"
        if kind == "b":
            return f"(?:{starts}|{ends})"
        return f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"

    def class_escape(self, flags: Flags) -> _Set | str:
        """A class or a character that means the same inside and outside brackets."""
        start, c = self.at - 1, self.peek()
        self.at += 1
        if c and c in "dswDSW":
            known = _Set((_UNICODE_CLASSES if flags.u else _ASCII_CLASSES)[c.lower()])
            return known if c.islower() else known.negated()
        if c in ("p", "P"):
            return self.property(c == "P", start)
        if c in _CONTROL:
            return _CONTROL[c]
        if c and c in "xuU":
            return self.hexadecimal({"x": 2, "u": 4, "U": 8}[c], start)
        if c and c.isascii() and not c.isalnum() and c.isprintable() and c not in "<>":
            return c
        self.fail("unknown escape" if c else "incomplete escape", start)

    def hexadecimal(self, digits: int, start: int) -> str:
        if self.take("{"):
            end = self.pattern.find("}", self.at)
            text, self.at = (self.pattern[self.at : end], end + 1) if end >= 0 else ("", self.at)
        else:
            text, self.at = self.peek(digits), self.at + digits
            text = text if len(text) == digits else ""
        try:
            code = int(text, 16) if text.isalnum() else -1
        except ValueError:
            code = -1
        if not 0 <= code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            self.fail("invalid hexadecimal character", start)
        return chr(code)

    def property(self, negated: bool, start: int) -> _Set:
        if self.take("{"):
            end = self.pattern.find("}", self.at)
            if end < 0:
                self.fail("unclosed property", start)
            name, self.at = self.pattern[self.at : end], end + 1
        else:
            name, self.at = self.peek(), self.at + 1
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        kind, separator, value = name.partition("!=") if "!=" in name else name.partition(":") if ":" in name else name.partition("=")
        negated ^= separator == "!="
        plain = lambda text: text.lower().replace("_", "").replace("-", "").replace(" ", "")
        kind, loose = (plain(kind), plain(value)) if separator else ("", plain(name))
        value = value if separator else name
        category = _CATEGORIES.get(loose) or _SHORT.get(loose)
        if not loose.isalnum() or not loose.isascii():
            self.fail("invalid property name", start)
        if kind in ("", "gc", "generalcategory") and loose in ("any", "assigned"):
            found = _Set("\\x{0}-\\x{10FFFF}") if loose == "any" else _Set("\\P{Cn}")
        elif kind == "" and loose == "ascii":
            found = _Set("\\x00-\\x7F")
        elif kind in ("", "gc", "generalcategory") and category:
            found = _Set(f"\\p{{{category}}}")
        elif kind == "" and loose in _BINARY:
            found = _Set(f"\\p{{Is{_BINARY[loose]}}}")
        elif kind in ("", "sc", "script"):
            found = _Set(f"\\p{{Is{value.strip().replace(' ', '_').replace('-', '_')}}}")
        else:
            self.fail(f"property {name!r} is not supported", start)
        return found.negated() if negated else found

    def bracket(self, flags: Flags) -> _Set:
        start = self.at
        self.at += 1
        negated = self.take("^")
        left: _Set | None = None
        operator, current, first = "", _Set(""), True
        while True:
            if flags.x:
                self.skip_space(flags)
            c = self.peek()
            if not c:
                self.fail("unclosed character class", start)
            if c == "]" and not first:
                self.at += 1
                break
            if self.peek(2) in ("&&", "--", "~~") and not (first and c == "-"):
                left = self.combined(left, operator, current)
                operator, current = self.peek(2), _Set("")
                self.at += 2
                first = False
                continue
            current = current.union(self.class_item(flags))
            first = False
        found = self.combined(left, operator, current)
        return found.negated() if negated else found

    def combined(self, left: _Set | None, operator: str, right: _Set) -> _Set:
        if left is None:
            return right
        if operator == "&&":
            return left.also(right)
        if operator == "--":
            return left.without(right)
        return left.without(right).union(right.without(left))

    def class_item(self, flags: Flags) -> _Set:
        start = self.at
        if self.peek() == "[":
            if self.peek(2) == "[:":
                end = self.pattern.find(":]", self.at + 2)
                name = self.pattern[self.at + 2 : end] if end >= 0 else ""
                if name.removeprefix("^") in _POSIX:
                    self.at = end + 2
                    known = _Set(_POSIX[name.removeprefix("^")])
                    return known.negated() if name.startswith("^") else known
            return self.bracket(flags)
        low = self.class_char(flags)
        self.skip_space(flags)
        if self.peek() != "-" or self.peek(2) in ("--", "-]", "-"):
            return low if isinstance(low, _Set) else _Set(_char(low))
        self.at += 1
        self.skip_space(flags)
        high = self.class_char(flags)
        if isinstance(low, _Set) or isinstance(high, _Set) or high < low:
            self.fail("invalid range", start)
        return _Set(f"{_char(low)}-{_char(high)}")

    def class_char(self, flags: Flags) -> _Set | str:
        c = self.peek()
        if not c:
            self.fail("unclosed character class")
        self.at += 1
        return self.class_escape(flags) if c == "\\" else c


# Writing and reading off ----------------------------------------------------------------------


def _java(node) -> str:
    match node:
        case Literal(char, fold):
            return f"(?iu:{_char(char)})" if fold else _char(char)
        case OneOf(java, fold):
            return f"(?iu:{java})" if fold else java
        case Anchor(java):
            return java
        case Group(index, item):
            return f"({'' if index else '?:'}{_java(item)})"
        case Sequence(items):
            return "".join(map(_java, items))
        case Choice(items):
            return "|".join(map(_java, items))
        case Repeat(item, low, high, lazy):
            inner = _java(item)
            if isinstance(item, (Repeat, Anchor)):
                inner = f"(?:{inner})"
            bounds = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high))
            bounds = bounds or (f"{{{low}}}" if low == high else f"{{{low},{'' if high is None else high}}}")
            return inner + bounds + ("?" if lazy else "")
    raise TypeError(node)


def _least_width(node) -> int:
    match node:
        case Literal() | OneOf():
            return 1
        case Group(_, item):
            return _least_width(item)
        case Sequence(items):
            return sum(map(_least_width, items))
        case Choice(items):
            return min(map(_least_width, items))
        case Repeat(item, low, _, _):
            return low * _least_width(item)
    return 0


def _literal_runs(node) -> list[str]:
    """Texts that every match contains; the first and the last one touch their neighbours."""
    match node:
        case Literal(char, False):
            return [char]
        case Anchor():
            return [""]
        case Group(_, item):
            return _literal_runs(item)
        case Sequence(items):
            runs = [""]
            for item in items:
                first, *rest = _literal_runs(item)
                runs[-1] += first
                runs += rest
            return runs
        case Repeat(item, low, _, _) if low:
            return ["", *_literal_runs(item), ""]
    return ["", ""]


def _find_group(node, index: int, optional: bool):
    """The group of this number and whether a match may leave it out."""
    match node:
        case Group(own, item):
            return (node, optional) if own == index else _find_group(item, index, optional)
        case Sequence(items):
            return next(filter(None, (_find_group(x, index, optional) for x in items)), None)
        case Choice(items):
            return next(filter(None, (_find_group(x, index, True) for x in items)), None)
        case Repeat(item, low, _, _):
            return _find_group(item, index, optional or low == 0)
    return None


@dataclass(frozen=True)
class Parsed:
    """A pattern of the dialect: Java's text for it and what is known about its matches."""

    java: str
    groups: int
    required: str
    first_group_optional: bool
    first_group_tells_match: bool


@lru_cache(maxsize=4096)
def parse(pattern: str) -> Parsed:
    """The pattern; raises :class:`PatternError` for what is invalid or cannot be carried over."""
    parser = _Parser(pattern)
    tree = parser.whole()
    first = _find_group(tree, 1, False)
    return Parsed(
        _java(tree),
        parser.groups,
        max(_literal_runs(tree), key=len),
        bool(first and first[1]),
        bool(first and not first[1] and _least_width(first[0].item) > 0),
    )
