"""Go, by recursive descent over a list of tokens. Expressions are checked without precedence, which validity doesn't depend on."""

from __future__ import annotations

import re

#: The keywords and operators of the language.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
BINARY = frozenset("+ - * / % & | ^ << >> &^ == != < <= > >= && || ".split())
UNARY = frozenset("+ - ! ^ * & <- ~".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())

_TOKEN = re.compile(
    r"""[ \t\r]*+(?: (?P<nl>\n | //[^\n]*(?:\n|\Z) | /\*.*?\*/)
    | (?P<name>[^\W\d]\w*)
    | (?P<num>0[xX](?:_?[0-9a-fA-F])*\.?(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?(?:[pP][+-]?[0-9](?:_?[0-9])*)?i?
        | 0[bB](?:_?[01])+i?(?![0-9]) | 0[oO](?:_?[0-7])+i?(?![0-9])
        | (?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?i?)
    | (?P<str>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*" | `[^`]*`
        | '(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    | (?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]) | \Z)""",
    re.X | re.S,
)
_KINDS = ("", "nl", "name", "num", "str", "op")
_ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
N, L = "\x01name", "\x01lit"  # kinds of names and literals; all other tokens stand for themselves


class _Bad(Exception):
    pass


def _tokens(text: str) -> list[str]:
    out: list[str] = []
    add = out.append
    match, pos, end, last = _TOKEN.match, 0, len(text), ""
    while pos < end:
        m = match(text, pos)
        if m is None:
            raise _Bad
        i = m.lastindex
        pos = m.end()
        if i is None:
            continue
        kind = _KINDS[i]
        if kind == "name":
            v = m[i]
            last = v if v in KEYWORDS else N
            add(last)
        elif kind == "nl":
            if (last is N or last is L or last in _ENDS) and ("\n" in m[i] or pos == end):
                add(";")
                last = ";"
        elif kind == "op":
            last = m[i]
            add(last)
        else:
            last = L
            add(L)
    if last is N or last is L or last in _ENDS:
        add(";")
    out.extend(("\x00",) * 4)
    return out


class _Go:
    def __init__(self, toks: list[str]):
        self.t, self.i = toks, 0
        self.level = 0  # below 0: in a control clause, where a brace opens the block

    def need(self, tok: str) -> None:
        if self.t[self.i] != tok:
            raise _Bad
        self.i += 1

    def end(self) -> None:
        """The end of a statement; it may be left out before a closing brace or parenthesis."""
        tok = self.t[self.i]
        if tok == ";":
            self.i += 1
        elif tok != "}" and tok != ")":
            raise _Bad

    def file(self) -> None:
        self.need("package")
        self.need(N)
        self.end()
        imports = True
        while (tok := self.t[self.i]) != "\x00":
            if tok == "import" and imports:
                self.i += 1
                self.group(self.import_spec)
            elif tok == "func":
                imports = False
                self.func_decl()
            elif tok in ("var", "const", "type"):
                imports = False
                self.decl()
            else:
                raise _Bad
            if self.t[self.i] != "\x00":
                self.need(";")

    def group(self, spec) -> None:
        if self.t[self.i] == "(":
            self.i += 1
            while self.t[self.i] != ")":
                spec()
                if self.t[self.i] != ")":
                    self.need(";")
            self.i += 1
        else:
            spec()

    def import_spec(self) -> None:
        if self.t[self.i] in (N, "."):
            self.i += 1
        self.need(L)

    def decl(self) -> None:
        kind = self.t[self.i]
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[kind])

    def names(self) -> None:
        self.need(N)
        while self.t[self.i] == ",":
            self.i += 1
            self.need(N)

    def var_spec(self) -> None:
        self.names()
        if self.t[self.i] != "=":
            self.type()
        if self.t[self.i] == "=":
            self.i += 1
            self.exprs()

    def const_spec(self) -> None:
        self.names()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
            if self.t[self.i] != "=":
                raise _Bad
        if self.t[self.i] == "=":
            self.i += 1
            self.exprs()

    def type_spec(self) -> None:
        self.need(N)
        if self.t[self.i] == "[" and self.t[self.i + 1] is N:
            at = self.i
            try:
                self.type_params()
                if self.t[self.i] == "=":
                    self.i += 1
                self.type()
                return
            except _Bad:
                self.i = at
        if self.t[self.i] == "=":
            self.i += 1
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while self.t[self.i] != "]":
            self.names()
            self.constraint()
            if self.t[self.i] != "]":
                self.need(",")
        self.i += 1

    def constraint(self) -> None:
        while True:
            if self.t[self.i] == "~":
                self.i += 1
            self.type()
            if self.t[self.i] != "|":
                return
            self.i += 1

    def func_decl(self) -> None:
        self.i += 1
        if self.t[self.i] == "(":
            self.params()
        self.need(N)
        if self.t[self.i] == "[":
            self.type_params()
        self.signature()
        if self.t[self.i] == "{":
            self.body()

    def signature(self) -> None:
        self.params()
        tok = self.t[self.i]
        if tok == "(":
            self.params()
        elif tok is N or tok in ("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def params(self) -> None:
        """Each entry is a type, a name and a type, or a name and ``...`` and a type; all must have names or none (lists of names aside)."""
        self.need("(")
        level, self.level = self.level, 0
        named = bare = False
        while self.t[self.i] != ")":
            if self.t[self.i] == "...":
                self.i += 1
                self.type()
                bare = True
            else:
                one_name = self.t[self.i] is N
                at = self.i
                self.type()
                if one_name and self.i == at + 1 and self.t[self.i] not in (",", ")"):
                    if self.t[self.i] == "...":
                        self.i += 1
                    self.type()
                    named = True
                elif one_name and self.t[at + 1] == "[" and self.t[self.i] not in (",", ")"):  # name []T was read as an index
                    self.i = at + 1
                    self.type()
                    named = True
                else:
                    bare = bare or not (one_name and self.i == at + 1)
            if self.t[self.i] != ")":
                self.need(",")
        self.i += 1
        self.level = level
        if named and bare:
            raise _Bad

    def type(self) -> None:
        tok = self.t[self.i]
        self.i += 1
        if tok is N:
            if self.t[self.i] == ".":
                self.i += 1
                self.need(N)
            if self.t[self.i] == "[" and self.t[self.i + 1] != "]":
                at = self.i
                try:
                    self.i += 1
                    self.type()
                    while self.t[self.i] == ",":
                        self.i += 1
                        if self.t[self.i] == "]":
                            break
                        self.type()
                    self.need("]")
                except _Bad:
                    self.i = at
        elif tok == "*":
            self.type()
        elif tok == "(":
            self.type()
            self.need(")")
        elif tok == "[":
            if self.t[self.i] == "]":
                self.i += 1
            elif self.t[self.i] == "..." and self.t[self.i + 1] == "]":
                self.i += 2
            else:
                level, self.level = self.level, 0
                self.expr()
                self.level = level
                self.need("]")
            self.type()
        elif tok == "map":
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif tok == "chan":
            if self.t[self.i] == "<-":
                self.i += 1
            self.type()
        elif tok == "<-":
            self.need("chan")
            self.type()
        elif tok == "func":
            self.signature()
        elif tok == "struct":
            self.struct()
        elif tok == "interface":
            self.interface()
        else:
            raise _Bad

    def struct(self) -> None:
        self.need("{")
        while self.t[self.i] != "}":
            tok = self.t[self.i]
            if tok == "*":
                self.type()
            else:
                if tok is not N:
                    raise _Bad
                after = self.t[self.i + 1]
                if after in (";", "}", ".", L):
                    self.type()
                elif after == "[" and not self._field_of_list():
                    self.type()
                else:
                    self.names()
                    self.type()
            if self.t[self.i] is L:
                self.i += 1
            if self.t[self.i] != "}":
                self.need(";")
        self.i += 1

    def _field_of_list(self) -> bool:
        """At ``name [``: whether the bracket begins the field's type (else it holds the arguments of an embedded type)."""
        at = self.i
        try:
            self.i += 1
            self.type()
            return self.t[self.i] in (";", "}", L)
        except _Bad:
            return False
        finally:
            self.i = at

    def interface(self) -> None:
        self.need("{")
        while self.t[self.i] != "}":
            if self.t[self.i] is N and self.t[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            if self.t[self.i] != "}":
                self.need(";")
        self.i += 1

    def exprs(self) -> int:
        self.expr()
        n = 1
        while self.t[self.i] == ",":
            self.i += 1
            self.expr()
            n += 1
        return n

    def expr(self) -> str:
        """Gives what the expression is: "name", "call" or "other"."""
        kind = self.unary()
        t = self.t
        while t[self.i] in BINARY:
            self.i += 1
            self.unary()
            kind = "other"
        return kind

    def unary(self) -> str:
        t = self.t
        kind = ""
        while t[self.i] in UNARY:
            if t[self.i] == "<-" and t[self.i + 1] == "chan":
                break
            self.i += 1
            kind = "other"
        return self.primary() if not kind else (self.primary(), kind)[1]

    def primary(self) -> str:
        t = self.t
        tok = t[self.i]
        typed = False  # a brace may follow as a composite literal, whatever the context
        named = False  # the same, but not in a control clause
        kind = "other"
        if tok is N:
            self.i += 1
            named, kind = True, "name"
        elif tok is L:
            self.i += 1
        elif tok == "(":
            self.i += 1
            level, self.level = self.level, 0
            self.expr()
            self.level = level
            self.need(")")
        elif tok == "func":
            self.i += 1
            self.signature()
            if t[self.i] == "{":
                level, self.level = self.level, 0
                self.body()
                self.level = level
        elif tok in ("[", "map", "struct"):
            self.type()
            typed = True
        elif tok in ("chan", "interface", "<-"):
            self.type()
        else:
            raise _Bad
        while True:
            tok = t[self.i]
            if tok == ".":
                self.i += 1
                if t[self.i] == "(":
                    self.i += 1
                    if t[self.i] == "type":
                        self.i += 1
                    else:
                        self.type()
                    self.need(")")
                    named = False
                else:
                    self.need(N)
                kind = "other"
            elif tok == "(":
                self.i += 1
                level, self.level = self.level, 0
                while t[self.i] != ")":
                    self.expr()
                    if t[self.i] == "...":
                        self.i += 1
                    if t[self.i] != ")":
                        self.need(",")
                self.i += 1
                self.level = level
                named = typed = False
                kind = "call"
            elif tok == "[":
                self.i += 1
                level, self.level = self.level, 0
                colons = 0
                if t[self.i] != ":":
                    self.expr()
                    while t[self.i] == ",":
                        self.i += 1
                        if t[self.i] == "]":
                            break
                        self.expr()
                while t[self.i] == ":" and colons < 2:
                    colons += 1
                    self.i += 1
                    if t[self.i] not in (":", "]"):
                        self.expr()
                    elif colons == 2 or t[self.i] == ":":
                        raise _Bad
                self.level = level
                self.need("]")
                kind = "other"
            elif tok == "{" and (typed or (named and self.level >= 0)):
                self.literal()
                named = typed = False
                kind = "other"
            else:
                return kind

    def literal(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        t = self.t
        while t[self.i] != "}":
            self.element()
            if t[self.i] == ":":
                self.i += 1
                self.element()
            if t[self.i] != "}":
                self.need(",")
        self.i += 1
        self.level = level

    def element(self) -> None:
        if self.t[self.i] == "{":
            self.literal()
        else:
            self.expr()

    def body(self) -> None:
        self.need("{")
        level, self.level = self.level, 0
        self.statements()
        self.need("}")
        self.level = level

    def statements(self) -> None:
        t = self.t
        while t[self.i] not in ("}", "case", "default", "\x00"):
            self.statement()
            if t[self.i] == "}":
                return
            self.need(";")

    def statement(self) -> None:
        t = self.t
        tok = t[self.i]
        if tok is N and t[self.i + 1] == ":" :
            self.i += 2
            if t[self.i] != "}":
                self.statement()
        elif tok == ";":
            pass
        elif tok in ("var", "const", "type"):
            self.decl()
        elif tok == "return":
            self.i += 1
            if t[self.i] not in (";", "}"):
                self.exprs()
        elif tok == "if":
            self.if_()
        elif tok == "for":
            self.for_()
        elif tok == "switch":
            self.switch()
        elif tok == "select":
            self.i += 1
            self.clauses(True)
        elif tok == "{":
            self.body()
        elif tok in ("go", "defer"):
            self.i += 1
            if self.expr() != "call":
                raise _Bad
        elif tok in ("break", "continue"):
            self.i += 1
            if t[self.i] is N:
                self.i += 1
        elif tok == "goto":
            self.i += 1
            self.need(N)
        elif tok == "fallthrough":
            self.i += 1
        else:
            self.simple()

    def simple(self, ranges: bool = False) -> bool:
        """A simple statement; True if it is a range clause."""
        t = self.t
        if ranges and t[self.i] == "range":
            self.i += 1
            self.expr()
            return True
        names, n = True, 0
        while True:
            names = (self.expr() == "name") and names
            n += 1
            if t[self.i] != ",":
                break
            self.i += 1
        tok = t[self.i]
        if tok == ":=" or tok in ASSIGN:
            if tok == ":=" and not names or tok not in (":=", "=") and n > 1:
                raise _Bad
            self.i += 1
            if ranges and t[self.i] == "range" and tok in (":=", "="):
                self.i += 1
                self.expr()
                return True
            self.exprs()
        elif n > 1:
            raise _Bad
        elif tok == "++" or tok == "--":
            self.i += 1
        elif tok == "<-":
            self.i += 1
            self.expr()
        return False

    def header(self) -> None:
        """[simple ;] [simple] before a brace."""
        t = self.t
        level, self.level = self.level, -1
        if t[self.i] not in ("{", ";"):
            self.simple()
        if t[self.i] == ";":
            self.i += 1
            if t[self.i] != "{":
                self.simple()
        self.level = level

    def if_(self) -> None:
        t = self.t
        self.i += 1
        if t[self.i] == "{":
            raise _Bad
        self.header()
        if t[self.i - 1] == ";":
            raise _Bad
        self.body()
        if t[self.i] == "else":
            self.i += 1
            if t[self.i] == "if":
                self.if_()
            else:
                self.body()

    def for_(self) -> None:
        t = self.t
        self.i += 1
        level, self.level = self.level, -1
        ranged = False
        if t[self.i] not in ("{", ";"):
            ranged = self.simple(True)
        if t[self.i] == ";" and not ranged:
            self.i += 1
            if t[self.i] != ";":
                if t[self.i] == "{":
                    raise _Bad
                self.simple()
            self.need(";")
            if t[self.i] != "{":
                self.simple()
        self.level = level
        self.body()

    def switch(self) -> None:
        self.i += 1
        self.header()
        self.clauses(False)

    def clauses(self, select: bool) -> None:
        t = self.t
        self.need("{")
        level, self.level = self.level, 0
        while t[self.i] != "}":
            if t[self.i] == "case":
                self.i += 1
                if select:
                    self.simple()
                else:
                    self.exprs()
            else:
                self.need("default")
            self.need(":")
            self.statements()
        self.i += 1
        self.level = level


_PACKAGE = re.compile(r"(?>(?:[ \t\r\n]+|//[^\n]*|/\*.*?\*/)*)package\b", re.S)


def valid_go(text: str) -> bool | None:
    """Whether ``text`` parses as a Go source file; None if it is nested too deeply to tell."""
    src = text.removeprefix("\ufeff")
    if not _PACKAGE.match(src):
        return False
    try:
        _Go(_tokens(src)).file()
    except (_Bad, IndexError):
        return False
    except (RecursionError, MemoryError):
        return None
    return True
