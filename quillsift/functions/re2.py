"""RE2 patterns as Java patterns.

Rules are written in RE2's dialect and Spark matches with ``java.util.regex``. The two differ in
``\\b``, ``\\s``, ``$``, ``.``, case folding, named groups and classes, and Java takes constructs that
RE2 rejects. ``to_java`` reads a pattern once from left to right and emits what matches the same strings.
"""

from __future__ import annotations

WORD = "0-9A-Za-z_"
BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
NOT_BOUNDARY = f"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))"
SPACE = r"\t\n\f\r "
MOST_REPEATS = 1000

#: The names of bracket classes.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": WORD, "xdigit": "0-9A-Fa-f",
}
#: General categories.
CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
_LITERAL_ESCAPES = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}


class PatternError(ValueError):
    """The pattern isn't valid RE2."""


class _Reader:
    def __init__(self, source: str):
        self.s, self.i, self.out = source, 0, []
        self.flags = {"i": False, "m": False, "s": False, "U": False}
        self.stack: list[dict] = []

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        self.i += n
        return got

    def run(self) -> str:
        can_repeat = False
        while self.i < len(self.s):
            c = self.peek()
            if c in "*+?" or c == "{" and self._counted():
                if not can_repeat:
                    raise PatternError(f"missing argument to repetition operator: {c}")
                self._repeat()
                can_repeat = False
                continue
            can_repeat = True
            if c == "(":
                can_repeat = self._open()
            elif c == ")":
                self.take()
                if not self.stack:
                    raise PatternError("unexpected )")
                self.flags = self.stack.pop()
                self.out.append(")")
            elif c == "|":
                self.out.append(self.take())
                can_repeat = False
            elif c == "[":
                self.out.append(self._set())
            elif c == "\\":
                self.out.append(self._escape(False))
            elif c == "^":
                self.take()
                self.out.append(r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A")
            elif c == "$":
                self.take()
                self.out.append(r"(?=\n|\z)" if self.flags["m"] else r"\z")
            elif c == ".":
                self.take()
                self.out.append(r"[\s\S]" if self.flags["s"] else r"[^\n]")
            else:
                self.out.append(_quoted(self.take()))
        if self.stack:
            raise PatternError("missing closing )")
        return "".join(self.out)

    def _counted(self) -> tuple[int, int | None, int] | None:
        """The bounds and length of a {n}, {n,} or {n,m} that starts here; else the brace is literal."""
        end = self.s.find("}", self.i)
        body = self.s[self.i + 1 : end] if end > 0 else ""
        low, comma, high = body.partition(",")
        if not (low.isascii() and low.isdigit()) or high and not (high.isascii() and high.isdigit()):
            return None
        return int(low), (int(high) if high else None) if comma else int(low), end + 1 - self.i

    def _repeat(self) -> None:
        if self.peek() == "{":
            low, high, n = self._counted()
            if max(low, high or 0) > MOST_REPEATS or high is not None and high < low:
                raise PatternError("invalid repeat count")
            op = self.take(n)
        else:
            op = self.take()
        lazy = self.peek() == "?"
        if lazy:
            self.take()
        if self.peek() and self.peek() in "*+?" or self.peek() == "{" and self._counted():
            raise PatternError("invalid nested repetition operator")
        self.out.append(op + ("?" if lazy != self.flags["U"] else ""))

    def _open(self) -> bool:
        self.take()
        if self.peek() != "?":
            self.stack.append(dict(self.flags))
            self.out.append("(")
            return False
        self.take()
        if self.peek(2) == "P<" or self.peek() == "<" and self.peek(2) not in ("<=", "<!"):
            end = self.s.find(">", self.i)
            name = self.s[self.s.find("<", self.i) + 1 : end] if end > 0 else ""
            if not name.isascii() or not name.replace("_", "a").isalnum():
                raise PatternError("invalid named capture")
            self.i = end + 1
            self.stack.append(dict(self.flags))
            self.out.append("(")
            return False
        before, value, some = dict(self.flags), True, False
        while True:
            c = self.take()
            if c and c in "imsU":
                self.flags[c], some = value, True
            elif c == "-" and value:
                value, some = False, False
            elif c in (":", ")") and (value or some):
                break
            else:
                raise PatternError("invalid or unsupported Perl syntax")
        fold = "(?iu" if self.flags["i"] else "(?-iu"
        if c == ":":
            self.stack.append(before)
            self.out.append(fold + ":")
        else:
            self.out.append(fold + ")")
        return False

    def _escape(self, in_set: bool) -> str:
        self.take()
        c = self.take()
        if not c:
            raise PatternError("trailing backslash")
        if c in _LITERAL_ESCAPES:
            return _LITERAL_ESCAPES[c]
        if c in "dDwW":
            return {"d": "[0-9]", "D": "[^0-9]", "w": f"[{WORD}]", "W": f"[^{WORD}]"}[c]
        if c in "sS":
            return f"[{'^' * (c == 'S')}{SPACE}]"
        if c == "x":
            if self.peek() == "{":
                end = self.s.find("}", self.i)
                digits, self.i = self.s[self.i + 1 : end], end + 1
            else:
                digits = self.take(2)
            try:
                code = int(digits, 16)
            except ValueError:
                raise PatternError("invalid escape sequence") from None
            if code > 0x10FFFF:
                raise PatternError("invalid escape sequence")
            return f"\\x{{{code:X}}}"
        if c == "0" or c in "1234567" and self.peek() and self.peek() in "01234567":
            digits = c
            while len(digits) < 3 and self.peek() and self.peek() in "01234567":
                digits += self.take()
            return f"\\x{{{int(digits, 8):X}}}"
        if c in "pP":
            if self.peek() == "{":
                end = self.s.find("}", self.i)
                if end < 0:
                    raise PatternError("invalid character class range")
                name, self.i = self.s[self.i + 1 : end], end + 1
            else:
                name = self.take()
            negated, name = (c == "P") != name.startswith("^"), name.lstrip("^")
            if name == "Any":
                return "[^\\x{0}-\\x{10FFFF}]" if negated else "[\\x{0}-\\x{10FFFF}]"
            if not _known_class(name):
                raise PatternError("invalid character class range")
            return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if not in_set:
            if c in "bB":
                return BOUNDARY if c == "b" else NOT_BOUNDARY
            if c in "Az":
                return f"\\{c}"
            if c == "Q":
                end = self.s.find("\\E", self.i)
                body = self.s[self.i :] if end < 0 else self.s[self.i : end]
                self.i = len(self.s) if end < 0 else end + 2
                return "".join(map(_quoted, body))
        if c.isalnum() or ord(c) > 127:
            raise PatternError(f"invalid escape sequence: \\{c}")
        return "\\" + c

    def _set(self) -> str:
        self.take()
        negated = self.peek() == "^"
        if negated:
            self.take()
        parts, first = [], True
        while True:
            c = self.peek()
            if not c:
                raise PatternError("missing closing ]")
            if c == "]" and not first:
                self.take()
                break
            first = False
            if self.peek(2) == "[:" and (end := self.s.find(":]", self.i)) > 0:
                name = self.s[self.i + 2 : end]
                inverse, name = name.startswith("^"), name.lstrip("^")
                if name not in POSIX:
                    raise PatternError("invalid character class range")
                self.i = end + 2
                parts.append(f"[^{POSIX[name]}]" if inverse else POSIX[name])
                continue
            low = self._member()
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", "") and not low.startswith("[") and not low.startswith(("\\p", "\\P")):
                self.take()
                high = self._member()
                if high.startswith("[") or high.startswith(("\\p", "\\P")):
                    raise PatternError("invalid character class range")
                if _code(high) < _code(low):
                    raise PatternError("invalid character class range")
                parts.append(f"{low}-{high}")
            else:
                parts.append(low)
        body = "".join(p[1:-1] if p.startswith("[") and not p.startswith("[^") else p for p in parts)
        if negated and "[^" in body:  # Java negates only the part before a nested class
            return f"(?:(?![{body}])[\\s\\S])"
        return f"[{'^' * negated}{body}]"

    def _member(self) -> str:
        if self.peek() == "\\":
            return self._escape(True)
        c = self.take()
        return "\\" + c if c in "[]&^-~#\\" else c


def _code(member: str) -> int:
    """The code point of a member of a set, as it was emitted."""
    if member.startswith("\\x"):
        return int(member[2:].strip("{}"), 16)
    return ord({"n": "\n", "r": "\r", "t": "\t", "f": "\f"}.get(member[1:], member[1:]) if member.startswith("\\") and len(member) > 1 else member)


def _known_class(name: str) -> bool:
    """A general category, by its one or two letters, or a script that Unicode names."""
    if name in CATEGORIES:
        return True
    if not name.isascii() or not all(part.istitle() for part in name.split("_")):
        return False
    import regex

    try:
        return bool(regex.compile(rf"\p{{Script={name}}}"))
    except regex.error:
        return False


def _quoted(c: str) -> str:
    return "\\" + c if c in r"\.[]{}()<>*+-=!?^$|#&~" else c


def to_java(pattern: str) -> str:
    """The Java pattern for an RE2 pattern; ``PatternError`` where RE2 would refuse it."""
    return _Reader(pattern).run()
