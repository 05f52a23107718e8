"""JavaScript modules and TypeScript, with or without JSX, by recursive descent over tokens that are scanned on demand.

Expressions are checked without precedence. Judged is the grammar with what it says about contexts (return, await, yield,
super-free), not scopes: a name declared twice passes.
"""

from __future__ import annotations

import re

#: Reserved words of modules, operators.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield".split())
BINARY = frozenset("+ - * / % ** & | ^ << >> >>> == != === !== < > <= >= && || ?? in instanceof".split())
PREFIX = frozenset("+ - ! ~ typeof void delete".split())
ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected readonly abstract declare override static accessor".split())

_SKIP = re.compile(r"(?:[ \t\r\n\v\f\xa0﻿  -     　]+|//[^\n\r  ]*|/\*.*?\*/)*", re.S)
_TOKEN = re.compile(
    r"""(?P<name>(?:[A-Za-z_$]|[^\x00-\x7F\W]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    | (?P<sign>[()\[\]{},;:~`@]|\.(?![0-9])(?:\.\.)?)
    | (?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?[0-9])*)n
        |(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w$\\]))
    | (?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[^xu0-9]|0(?![0-9])|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}))*"
        |'(?:[^'\\\n\r]|\\(?:\r\n|[^xu0-9]|0(?![0-9])|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}))*')
    | (?P<priv>\#[A-Za-z_$][\w$]*)
    | (?P<op>>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^<>=!?])""",
    re.X | re.S,
)
_KINDS = ("", "name", "op", "num", "str", "priv", "op")
#: White space and comments, then a token; the former are never given back for the latter.
_NEXT = re.compile(f"(?-x:(?>{_SKIP.pattern}))(?:{_TOKEN.pattern})", re.X | re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r  ]|\\[^\n\r  ]|\[(?:[^\]\\\n\r  ]|\\[^\n\r  ])*\])+/([a-zA-Z0-9_$]*)")
_FLAGS = re.compile(r"(?!.*(.).*\1)[dgimsuvy]*\Z")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?:[^xu0-9]|0(?![0-9])|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\})|\$(?!\{))*(`|\$\{)", re.S)
_TAGGED = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_JSX_TEXT = re.compile(r"[^<{>}]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*|(?:\.[A-Za-z_$][\w$-]*)*)")
_JSX_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_NO_ARROW = re.compile(r"\(\s*[\d\"'`!(+\-~/<]")
_LINES = re.compile(r"[\n\r  ]")


class _Bad(Exception):
    pass


class _Ecma:
    def __init__(self, src: str, ts: bool, jsx: bool, scanned: dict[int, tuple[int, str, str, int]]):
        self.s, self.ts, self._jsx, self.looked = src, ts, jsx, False
        self.scanned = scanned  # position -> token there; the parsers of all languages share it
        self.in_fn = self.gen = False
        self.asyn = True  # await is a keyword at the top of a module
        self.ambient = self.cover = self.no_in = self.in_cond = self.no_cond_type = False
        self.arrows: dict[int, bool] = {}
        self.end = 0
        self.goto(0)

    # --- tokens

    @property
    def jsx(self) -> bool:
        """Whether an angle bracket may open an element; ``looked`` tells afterwards whether this mattered."""
        self.looked = True
        return self._jsx

    def goto(self, pos: int) -> None:
        """Scans the token at or after ``pos``. tok: its text; kind: name, num, str, priv, op or ""; end: where it ends."""
        self.before, self.nl = pos, None
        found = self.scanned.get(pos)
        if found is None:
            m = _NEXT.match(self.s, pos)
            if m is not None:
                i = m.lastindex
                found = m.start(i), m[i], _KINDS[i], m.end()
            else:
                at = _SKIP.match(self.s, pos).end()
                found = at, "\x01" if at < len(self.s) else "", "", at
            self.scanned[pos] = found
        self.at, self.tok, self.kind, self.end = found

    def next(self) -> None:
        self.goto(self.end)

    def newline(self) -> bool:
        """Whether a line ends before the token."""
        if self.nl is None:
            self.nl = _LINES.search(self.s, self.before, self.at) is not None
        return self.nl

    def save(self) -> tuple:
        return self.before, self.at, self.nl, self.tok, self.kind, self.end

    def load(self, state: tuple) -> None:
        self.before, self.at, self.nl, self.tok, self.kind, self.end = state

    def op(self, tok: str) -> bool:
        return self.tok == tok and self.kind != "str"

    def take(self, tok: str) -> bool:
        if self.tok == tok and self.kind != "str":
            self.goto(self.end)
            return True
        return False

    def need(self, tok: str) -> None:
        if self.tok != tok or self.kind == "str":
            raise _Bad
        self.goto(self.end)

    def semicolon(self) -> None:
        if self.tok == ";":
            self.goto(self.end)
        elif self.tok != "}" and self.tok != "" and not self.newline():
            raise _Bad

    def name(self) -> None:
        """A name that may be bound or referred to."""
        if self.kind != "name" or self.tok in RESERVED or self.bad_name(self.tok):
            raise _Bad
        self.goto(self.end)

    def bad_name(self, tok: str) -> bool:
        if tok == "await":
            return self.asyn or not self.ts
        if tok == "yield":
            return True
        return tok in STRICT and not self.ts

    def any_name(self) -> None:
        if self.kind != "name":
            raise _Bad
        self.goto(self.end)

    def attempt(self, f, *args) -> bool:
        """Runs ``f``; if it fails or gives False, everything is as before."""
        state, flags = self.save(), (self.in_fn, self.gen, self.asyn, self.no_in, self.in_cond, self.no_cond_type, self.cover)
        try:
            if f(*args) is not False:
                return True
        except _Bad:
            pass
        self.load(state)
        self.in_fn, self.gen, self.asyn, self.no_in, self.in_cond, self.no_cond_type, self.cover = flags
        return False

    # --- statements

    def module(self) -> None:
        if self.s.startswith("#!"):
            m = _LINES.search(self.s)
            self.goto(m.start() if m else len(self.s))
        while self.tok != "":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while self.tok != "}":
            if self.tok == "":
                raise _Bad
            self.statement()
        self.goto(self.end)

    def statement(self, top: bool = False) -> None:
        tok, kind = self.tok, self.kind
        if kind == "name":
            f = _STATEMENTS.get(tok)
            if f is not None and f(self, top) is not False:
                return
            if self.ts and tok in _TS_STATEMENTS and self.attempt(_TS_STATEMENTS[tok], self, top):
                return
            if tok == "async" and self.attempt(self.async_function):
                return
        elif tok == "{":
            return self.block()
        elif tok == ";":
            return self.goto(self.end)
        elif tok == "@" and self.ts:
            self.decorators()
            self.take("export") and self.take("default")
            self.take("abstract")
            return self.class_(True)
        elif tok == "":
            raise _Bad
        if kind == "name" and tok not in RESERVED:
            state = self.save()
            self.goto(self.end)
            if self.tok == ":" and not self.bad_name(tok):
                self.goto(self.end)
                if self.tok == "function":
                    raise _Bad
                return self.sub_statement()
            self.load(state)
        self.expression()
        self.semicolon()

    def sub_statement(self) -> None:
        """The body of a loop, branch or label, where declarations may not stand."""
        if self.kind == "name" and self.tok in ("const", "class", "function", "import", "export"):
            raise _Bad
        if self.tok == "let":
            state = self.save()
            self.goto(self.end)
            declares = self.kind == "name" or self.tok in ("[", "{")
            self.load(state)
            if declares:
                raise _Bad
        self.statement()

    def async_function(self) -> None:
        self.goto(self.end)
        if self.tok != "function" or self.newline():
            raise _Bad
        self.function(True, True)

    def s_var(self, top: bool) -> bool | None:
        if self.tok == "let" and self.ts or self.tok == "let":
            state = self.save()
            self.goto(self.end)
            if self.kind != "name" and self.tok not in ("[", "{"):
                self.load(state)
                if not self.ts:
                    raise _Bad
                return False
            self.load(state)
        const = self.tok == "const"
        self.goto(self.end)
        if const and self.ts and self.tok == "enum":
            return self.enum()
        self.declarations(const)
        self.semicolon()

    def declarations(self, const: bool, in_for: bool = False) -> bool:
        """True if it is a single binding without initialiser, as before ``of`` or ``in``."""
        n, bare = 0, False
        while True:
            n += 1
            pattern = self.tok in ("[", "{")
            self.binding()
            if self.ts:
                if self.tok == "!":
                    self.goto(self.end)
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assign()
            elif in_for and n == 1 and (self.op("of") or self.op("in")):
                bare = True
            elif (pattern or const) and not self.ambient:
                raise _Bad
            if not self.take(","):
                return bare and n == 1

    def binding(self) -> None:
        if self.tok == "[":
            self.goto(self.end)
            while not self.op("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.with_in(self.assign)
                if not self.op("]"):
                    if rest:
                        raise _Bad
                    self.need(",")
            self.goto(self.end)
        elif self.tok == "{":
            self.goto(self.end)
            while not self.op("}"):
                if self.take("..."):
                    self.name()
                    if not self.op("}"):
                        raise _Bad
                    break
                if self.kind == "name":
                    tok = self.tok
                    self.goto(self.end)
                    if not self.op(":") and (tok in RESERVED or self.bad_name(tok)):
                        raise _Bad
                    if self.take(":"):
                        self.binding()
                else:
                    self.key()
                    self.need(":")
                    self.binding()
                if self.take("="):
                    self.with_in(self.assign)
                if not self.op("}"):
                    self.need(",")
            self.goto(self.end)
        else:
            self.name()

    def with_in(self, f) -> None:
        no_in, self.no_in = self.no_in, False
        cond, self.in_cond = self.in_cond, False
        f()
        self.no_in, self.in_cond = no_in, cond

    def s_function(self, top: bool) -> None:
        self.function(False, True)

    def function(self, asyn: bool, named: bool) -> None:
        self.need("function")
        gen = self.take("*")
        if named:
            self.name()
        elif self.kind == "name" and self.tok != "(":
            if self.tok in RESERVED:
                raise _Bad
            self.goto(self.end)
        self.callable(asyn, gen)

    def callable(self, asyn: bool, gen: bool, ctor: bool = False) -> None:
        """Type parameters, parameters, return type and body; in TypeScript the body may be missing."""
        flags = self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond
        self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond = True, asyn, gen, False, False
        if self.ts and self.op("<"):
            self.type_parameters()
        self.parameters(ctor)
        if self.ts and self.take(":"):
            self.return_type()
        if self.op("{"):
            self.block()
        elif self.ts:
            self.semicolon()
        else:
            raise _Bad
        self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond = flags

    def parameters(self, ctor: bool = False) -> None:
        self.need("(")
        while not self.op(")"):
            if self.ts:
                self.decorators()
                if ctor:
                    while self.tok in MODIFIERS:
                        state = self.save()
                        self.goto(self.end)
                        if self.kind != "name" and self.tok not in ("{", "["):
                            self.load(state)
                            break
            rest = self.take("...")
            if self.ts and self.tok == "this":
                self.goto(self.end)
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if not rest and self.take("="):
                self.assign()
            if not self.op(")"):
                if rest:
                    raise _Bad
                self.need(",")
        self.goto(self.end)

    def s_class(self, top: bool) -> None:
        self.class_(True)

    def decorators(self) -> None:
        while self.op("@"):
            self.goto(self.end)
            if self.take("("):
                self.expression()
                self.need(")")
            else:
                self.any_name()
                while self.take("."):
                    self.any_name()
            if self.op("("):
                self.arguments()

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.kind == "name" and self.tok not in ("extends", "implements"):
            self.name()
        elif named:
            raise _Bad
        if self.ts and self.op("<"):
            self.type_parameters()
        if self.take("extends"):
            self.unary(True)
            if self.ts and self.op("<"):
                self.type_arguments()
        if self.ts and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        flags = self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond
        while not self.op("}"):
            if self.take(";"):
                continue
            self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond = True, False, False, False, False
            self.member()
            self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond = flags
        self.goto(self.end)

    def member(self) -> None:
        if self.ts:
            self.decorators()
        allowed = MODIFIERS if self.ts else ("static",)
        asyn = gen = accessor = False
        while self.kind == "name":
            tok, state = self.tok, self.save()
            if tok not in allowed and tok not in ("async", "get", "set"):
                break
            self.goto(self.end)
            follows = self.kind in ("name", "str", "num", "priv") or self.tok in ("[", "*") or (tok == "static" and self.op("{"))
            if not follows or (tok == "async" and self.newline()) or (tok in ("get", "set") and self.op("*")):
                self.load(state)
                break
            if tok == "static" and self.op("{"):
                return self.block()
            asyn = asyn or tok == "async"
            accessor = accessor or tok in ("get", "set")
            if tok in ("get", "set", "async"):
                break
        if self.take("*"):
            gen = True
        if self.ts and self.op("[") and self.attempt(self.index_signature):
            return
        ctor = self.tok == "constructor"
        self.key(True)
        if self.ts:
            self.take("?") or self.take("!")
        if self.op("(") or (self.ts and self.op("<")):
            return self.callable(asyn, gen, ctor)
        if asyn or gen or accessor:
            raise _Bad
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.assign()
        self.semicolon()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        if self.take(":"):
            self.type()
        self.semicolon() if not self.take(",") else None

    def key(self, private: bool = False) -> None:
        if self.kind in ("name", "str", "num") or (private and self.kind == "priv"):
            self.goto(self.end)
        elif self.op("["):
            self.goto(self.end)
            self.with_in(self.assign)
            self.need("]")
        else:
            raise _Bad

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self, top: bool) -> None:
        self.goto(self.end)
        self.paren()
        self.sub_statement()
        if self.tok == "else" and self.kind == "name":
            self.goto(self.end)
            self.sub_statement()

    def s_while(self, top: bool) -> None:
        self.goto(self.end)
        self.paren()
        self.sub_statement()

    def s_do(self, top: bool) -> None:
        self.goto(self.end)
        self.sub_statement()
        self.need("while")
        self.paren()
        self.take(";")

    def s_for(self, top: bool) -> None:
        self.goto(self.end)
        if self.tok == "await":
            if not self.asyn:
                raise _Bad
            self.goto(self.end)
        self.need("(")
        each = False
        if self.tok != ";":
            self.no_in = True
            if self.kind == "name" and self.tok in ("var", "let", "const"):
                const = self.tok == "const"
                self.goto(self.end)
                each = self.declarations(const, True)
            else:
                target = self.expression()
                each = (self.op("of") or self.op("in")) and self.kind == "name"
                if each and not target:
                    raise _Bad
            self.no_in = False
        if each:
            of = self.tok == "of"
            self.goto(self.end)
            self.assign() if of else self.expression()
        else:
            self.need(";")
            if not self.op(";"):
                self.expression()
            self.need(";")
            if not self.op(")"):
                self.expression()
        self.need(")")
        self.sub_statement()

    def s_switch(self, top: bool) -> None:
        self.goto(self.end)
        self.paren()
        self.need("{")
        default = False
        while not self.op("}"):
            if self.take("default"):
                if default:
                    raise _Bad
                default = True
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while not (self.kind == "name" and self.tok in ("case", "default")) and not self.op("}"):
                self.statement()
        self.goto(self.end)

    def s_try(self, top: bool) -> None:
        self.goto(self.end)
        self.block()
        ended = False
        if self.take("catch"):
            ended = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            ended = True
            self.block()
        if not ended:
            raise _Bad

    def s_throw(self, top: bool) -> None:
        self.goto(self.end)
        if self.newline():
            raise _Bad
        self.expression()
        self.semicolon()

    def s_return(self, top: bool) -> None:
        if not self.in_fn:
            raise _Bad
        self.goto(self.end)
        if self.tok not in (";", "}", "") and not self.newline():
            self.expression()
        self.semicolon()

    def s_break(self, top: bool) -> None:
        self.goto(self.end)
        if self.kind == "name" and not self.newline():
            self.name()
        self.semicolon()

    def s_debugger(self, top: bool) -> None:
        self.goto(self.end)
        self.semicolon()

    def s_wrong(self, top: bool) -> None:
        raise _Bad

    def s_enum(self, top: bool) -> None:
        if not self.ts:
            raise _Bad
        self.enum()

    def s_import(self, top: bool) -> bool | None:
        state = self.save()
        self.goto(self.end)
        if self.tok in ("(", "."):
            self.load(state)
            return False
        if not (top or self.ambient):
            raise _Bad
        if self.kind == "str":
            self.goto(self.end)
            return self.attributes()
        if self.ts and self.tok == "type":
            s = self.save()
            self.goto(self.end)
            if not (self.kind == "name" and self.tok != "from" or self.tok in ("{", "*")):
                self.load(s)
        if self.kind == "name":
            self.name()
            if self.ts and self.take("="):
                if self.take("require"):
                    self.need("(")
                    if self.kind != "str":
                        raise _Bad
                    self.goto(self.end)
                    self.need(")")
                else:
                    self.any_name()
                    while self.take("."):
                        self.any_name()
                return self.semicolon()
            if not self.take(","):
                return self.source()
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers(True)
        self.source()

    def source(self) -> None:
        self.need("from")
        if self.kind != "str":
            raise _Bad
        self.goto(self.end)
        self.attributes()

    def attributes(self) -> None:
        if self.kind == "name" and self.tok in ("with", "assert") and not self.newline():
            self.goto(self.end)
            self.need("{")
            while not self.op("}"):
                self.key()
                self.need(":")
                if self.kind != "str":
                    raise _Bad
                self.goto(self.end)
                if not self.op("}"):
                    self.need(",")
            self.goto(self.end)
        self.semicolon()

    def specifiers(self, binds: bool) -> None:
        self.need("{")
        while not self.op("}"):
            if self.ts and self.tok == "type":
                s = self.save()
                self.goto(self.end)
                if self.kind not in ("name", "str") or self.tok == "as":
                    self.load(s)
            tok, kind = self.tok, self.kind
            if kind not in ("name", "str"):
                raise _Bad
            self.goto(self.end)
            if self.tok == "as" and self.kind == "name":
                self.goto(self.end)
                if binds:
                    self.name()
                elif self.kind in ("name", "str"):
                    self.goto(self.end)
                else:
                    raise _Bad
            elif binds and (kind == "str" or tok in RESERVED or self.bad_name(tok)):
                raise _Bad
            if not self.op("}"):
                self.need(",")
        self.goto(self.end)

    def s_export(self, top: bool) -> None:
        if not (top or self.ambient):
            raise _Bad
        self.goto(self.end)
        if self.take("default"):
            if self.tok == "function":
                return self.function(False, False)
            if self.tok == "async" and self.attempt(self.default_async):
                return None
            if self.ts:
                self.decorators()
                if self.tok == "interface" and self.attempt(self.interface):
                    return None
                if self.tok == "abstract":
                    self.goto(self.end)
            if self.tok == "class":
                return self.class_(False)
            self.assign()
            return self.semicolon()
        if self.take("*"):
            if self.take("as"):
                if self.kind not in ("name", "str"):
                    raise _Bad
                self.goto(self.end)
            return self.source()
        if self.ts:
            if self.take("="):
                self.expression()
                return self.semicolon()
            if self.take("as"):
                self.need("namespace")
                self.name()
                return self.semicolon()
            if self.tok == "type":
                s = self.save()
                self.goto(self.end)
                if self.op("*"):
                    self.goto(self.end)
                    if self.take("as"):
                        self.any_name()
                    return self.source()
                if not self.op("{"):
                    self.load(s)
            if self.tok == "import":
                return self.s_import(True)
            if self.tok in _TS_STATEMENTS:
                return _TS_STATEMENTS[self.tok](self, top)
            if self.op("@"):
                self.decorators()
        if self.op("{"):
            self.specifiers(False)
            if self.tok == "from":
                return self.source()
            return self.semicolon()
        if self.tok in ("var", "let", "const"):
            return self.s_var(top)
        if self.tok == "function":
            return self.function(False, True)
        if self.tok == "class":
            return self.class_(True)
        if self.tok == "async":
            return self.async_function()
        if self.ts and self.tok == "enum":
            return self.enum()
        raise _Bad

    def default_async(self) -> None:
        self.goto(self.end)
        if self.tok != "function" or self.newline():
            raise _Bad
        self.function(True, False)

    # --- statements of TypeScript

    def interface(self, top: bool = True) -> None:
        self.goto(self.end)
        if self.newline():
            raise _Bad
        self.name()
        if self.op("<"):
            self.type_parameters()
        if self.take("extends"):
            self.type()
            while self.take(","):
                self.type()
        self.members()

    def alias(self, top: bool = True) -> None:
        self.goto(self.end)
        if self.newline():
            raise _Bad
        self.name()
        if self.op("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.semicolon()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.op("}"):
            if self.kind not in ("name", "str"):
                raise _Bad
            self.goto(self.end)
            if self.take("="):
                self.assign()
            if not self.op("}"):
                self.need(",")
        self.goto(self.end)

    def namespace(self, top: bool = True) -> None:
        self.goto(self.end)
        if self.newline():
            raise _Bad
        if self.kind == "str":
            self.goto(self.end)
        else:
            self.any_name()
            while self.take("."):
                self.any_name()
        if not self.op("{"):
            return self.semicolon()
        self.goto(self.end)
        while not self.op("}"):
            if self.tok == "":
                raise _Bad
            self.statement(True)
        self.goto(self.end)

    def declare(self, top: bool = True) -> None:
        self.goto(self.end)
        if self.newline() or self.kind != "name":
            raise _Bad
        ambient, self.ambient = self.ambient, True
        try:
            if self.tok == "global":
                self.goto(self.end)
                self.block()
            elif self.tok in ("var", "let", "const", "function", "class", "enum", "async", "import") or self.tok in _TS_STATEMENTS:
                self.statement(True)
            else:
                raise _Bad
        finally:
            self.ambient = ambient

    def abstract(self, top: bool = True) -> None:
        self.goto(self.end)
        if self.newline():
            raise _Bad
        self.class_(True)

    # --- types

    def type(self) -> None:
        no, self.no_cond_type = self.no_cond_type, False
        self.type_()
        self.no_cond_type = no

    def return_type(self) -> None:
        if self.tok == "asserts" and self.attempt(self.predicate, True):
            return
        if self.kind == "name" and self.attempt(self.predicate, False):
            return
        self.type()

    def predicate(self, asserts: bool) -> None:
        if asserts:
            self.goto(self.end)
        if self.newline() and asserts:
            raise _Bad
        self.any_name()
        if self.tok == "is" and self.kind == "name" and not self.newline():
            self.goto(self.end)
            self.type()
        elif not asserts:
            raise _Bad

    def type_(self) -> None:
        if self.op("(") and self.attempt(self.function_type) or self.op("<"):
            if self.op("<"):
                self.type_parameters()
                self.function_type()
            return
        if self.tok in ("new", "abstract") and self.kind == "name" and self.attempt(self.constructor_type):
            return
        self.union()
        if self.tok == "extends" and not self.no_cond_type and not self.newline():
            self.goto(self.end)
            no, self.no_cond_type = self.no_cond_type, True
            self.type_()
            self.no_cond_type = no
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type(self) -> None:
        self.parameters()
        self.need("=>")
        self.return_type()

    def constructor_type(self) -> None:
        self.take("abstract")
        self.need("new")
        if self.op("<"):
            self.type_parameters()
        self.function_type()

    def union(self) -> None:
        self.take("|") or self.take("&")
        self.type_operand()
        while self.op("|") or self.op("&"):
            self.goto(self.end)
            self.type_operand()

    def type_operand(self) -> None:
        while self.kind == "name" and self.tok in ("keyof", "unique", "readonly", "infer"):
            tok, state = self.tok, self.save()
            self.goto(self.end)
            if not (self.kind in ("name", "str", "num") or self.tok in ("(", "[", "{", "`")) or self.tok in ("extends", "is") and tok != "infer":
                self.load(state)
                break
            if tok == "infer":
                self.any_name()
                if self.tok == "extends" and not self.no_cond_type:
                    self.attempt(self.infer_bound)
                return
        if self.op("(") and self.attempt(self.function_type):
            return
        self.type_primary()
        while not self.newline():
            if self.op("["):
                self.goto(self.end)
                if not self.op("]"):
                    self.type()
                self.need("]")
            elif self.op("!") or self.op("?") and self.s[self.end : self.end + 1] in (",", "]"):
                self.goto(self.end)
            else:
                break

    def infer_bound(self) -> bool:
        self.goto(self.end)
        no, self.no_cond_type = self.no_cond_type, True
        self.type_()
        self.no_cond_type = no
        return not self.op("?")

    def type_primary(self) -> None:
        tok, kind = self.tok, self.kind
        if kind in ("str", "num"):
            self.goto(self.end)
        elif kind == "name":
            if tok == "typeof":
                self.goto(self.end)
                if self.tok == "import":
                    return self.type_primary()
                self.any_name()
                while self.take("."):
                    if self.kind not in ("name", "priv"):
                        raise _Bad
                    self.goto(self.end)
                if self.op("<") and not self.newline():
                    self.type_arguments()
            elif tok == "import":
                self.goto(self.end)
                self.need("(")
                self.type()
                if self.take(","):
                    self.assign()
                self.need(")")
                while self.take("."):
                    self.any_name()
                if self.op("<"):
                    self.type_arguments()
            elif tok in RESERVED and tok not in ("void", "null", "this", "true", "false"):
                raise _Bad
            else:
                self.goto(self.end)
                while self.op(".") :
                    self.goto(self.end)
                    self.any_name()
                if self.op("<") and not self.newline():
                    self.type_arguments()
        elif tok == "{":
            self.attempt(self.mapped) or self.members()
        elif tok == "[":
            self.goto(self.end)
            while not self.op("]"):
                self.take("...")
                if self.kind == "name" and self.attempt(self.tuple_label):
                    pass
                self.type()
                self.take("?")
                if not self.op("]"):
                    self.need(",")
            self.goto(self.end)
        elif tok == "(":
            self.goto(self.end)
            self.type()
            self.need(")")
        elif tok == "-":
            self.goto(self.end)
            if self.kind != "num":
                raise _Bad
            self.goto(self.end)
        elif tok == "`":
            self.template(self.type)
        else:
            raise _Bad

    def tuple_label(self) -> None:
        self.any_name()
        self.take("?")
        self.need(":")

    def mapped(self) -> None:
        self.need("{")
        if self.tok in ("+", "-"):
            self.goto(self.end)
        self.take("readonly")
        self.need("[")
        self.any_name()
        self.need("in")
        self.type()
        if self.take("as"):
            self.type()
        self.need("]")
        if self.tok in ("+", "-"):
            self.goto(self.end)
        self.take("?")
        if self.take(":"):
            self.type()
        self.take(";") or self.take(",")
        self.need("}")

    def members(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.type_member()
            if not (self.take(";") or self.take(",")) and not self.op("}") and not self.newline():
                raise _Bad
        self.goto(self.end)

    def type_member(self) -> None:
        if self.op("(") or self.op("<"):
            return self.call_signature()
        if self.tok == "new" and self.kind == "name":
            state = self.save()
            self.goto(self.end)
            if self.op("(") or self.op("<"):
                return self.call_signature()
            self.load(state)
        while self.kind == "name" and self.tok in ("readonly", "get", "set"):
            state = self.save()
            self.goto(self.end)
            if not (self.kind in ("name", "str", "num") or self.op("[")):
                self.load(state)
                break
        if self.op("[") and self.attempt(self.bare_index):
            return
        self.key()
        self.take("?")
        if self.op("(") or self.op("<"):
            return self.call_signature()
        if self.take(":"):
            self.type()

    def bare_index(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        if self.take(":"):
            self.type()

    def call_signature(self) -> None:
        if self.op("<"):
            self.type_parameters()
        self.parameters()
        if self.take(":"):
            self.return_type()

    def close(self) -> None:
        """A closing angle bracket, which may be the beginning of a longer operator."""
        if not self.tok.startswith(">") or self.kind == "str":
            raise _Bad
        self.goto(self.at + 1)

    def type_parameters(self) -> None:
        self.need("<")
        n = 0
        while not self.tok.startswith(">"):
            n += 1
            while self.kind == "name" and self.tok in ("const", "in", "out"):
                state = self.save()
                self.goto(self.end)
                if self.kind != "name" or self.tok == "extends":
                    self.load(state)
                    break
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.tok.startswith(">"):
                self.need(",")
        if not n:
            raise _Bad
        self.close()

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.close()

    # --- expressions

    def expression(self) -> bool:
        target = self.assign()
        while self.tok == ",":
            self.goto(self.end)
            self.assign()
            target = False
        return target

    def assign(self) -> bool:
        """True if the expression may stand on the left of an assignment. Names with a default must have become part of a pattern."""
        outer, self.cover = self.cover, False
        target = self.part()
        if self.cover and not (target and self.tok in ("of", "in")):
            raise _Bad
        self.cover = outer
        return target

    def part(self) -> bool:
        """The same inside of an array or object literal, which may become a pattern as a whole."""
        if self.kind == "name":
            if self.tok == "yield" and self.gen:
                self.goto(self.end)
                if not self.newline():
                    if self.take("*"):
                        self.assign()
                    elif self.tok not in (")", "]", "}", ",", ";", ":", "", "in", "of"):
                        self.assign()
                return False
            if self.tok == "async" and self.attempt(self.async_arrow):
                return False
        elif self.tok == "(":
            if self.arrow_here():
                return False
        elif self.tok == "<" and self.ts and self.attempt(self.generic_arrow, False):
            return False
        target = self.unary()
        if target == 2:  # a lone name
            if self.tok == "=>" and not self.newline():
                self.goto(self.end)
                self.arrow_body(False)
                return False
        while True:
            tok = self.tok
            if tok in BINARY and self.kind != "str":
                if tok == "in" and self.no_in:
                    break
                self.goto(self.end)
                self.unary()
                target = 0
            elif self.ts and self.kind == "name" and tok in ("as", "satisfies") and not self.newline():
                self.goto(self.end)
                if self.tok == "const":
                    self.goto(self.end)
                else:
                    self.type()
            else:
                break
        if tok == "?":
            self.goto(self.end)
            no_in, self.no_in = self.no_in, False
            cond, self.in_cond = self.in_cond, True
            self.assign()
            self.no_in, self.in_cond = no_in, cond
            self.need(":")
            self.assign()
            return False
        if tok in ASSIGN and self.kind == "op":
            if not target or target == 3 and tok != "=":
                raise _Bad
            self.cover = self.cover and target != 3
            self.goto(self.end)
            self.assign()
            return False
        return bool(target)


    def arrow_here(self) -> bool:
        at = self.at
        known = self.arrows.get(at)
        if known is None:
            if _NO_ARROW.match(self.s, at):
                return False
            known = self.attempt(self.arrow, False)
            if not known:
                self.arrows[at] = False
            return known
        return known and self.attempt(self.arrow, False)

    def arrow(self, asyn: bool) -> None:
        flags = self.asyn
        self.asyn = asyn or self.asyn
        self.parameters()
        if self.ts and self.op(":"):
            if self.in_cond:
                if not self.attempt(self.arrow_type):
                    raise _Bad
            else:
                self.goto(self.end)
                self.return_type()
        if self.tok != "=>" or self.newline():
            raise _Bad
        self.asyn = flags
        self.goto(self.end)
        self.arrow_body(asyn)

    def arrow_type(self) -> None:
        """In the middle of a conditional a colon begins a return type only if a whole arrow function and another colon follow."""
        state = self.save()
        self.goto(self.end)
        self.return_type()
        if self.tok != "=>":
            raise _Bad
        after = self.save()
        self.goto(self.end)
        self.arrow_body(False)
        if self.tok != ":":
            self.load(state)
            raise _Bad
        self.load(after)

    def arrow_body(self, asyn: bool) -> None:
        flags = self.in_fn, self.asyn, self.gen
        if self.op("{"):
            no_in, cond = self.no_in, self.in_cond
            self.in_fn, self.asyn, self.gen, self.no_in, self.in_cond = True, asyn, False, False, False
            self.block()
            self.no_in, self.in_cond = no_in, cond
        else:
            self.asyn, self.gen = asyn or (self.asyn and not self.in_fn), False
            if not asyn and self.in_fn:
                self.asyn = False
            self.assign()
        self.in_fn, self.asyn, self.gen = flags

    def async_arrow(self) -> None:
        self.goto(self.end)
        if self.newline():
            raise _Bad
        if self.kind == "name" and self.tok != "function":
            self.name()
            if self.tok != "=>":
                raise _Bad
            self.goto(self.end)
            self.arrow_body(True)
        elif self.ts and self.op("<"):
            self.generic_arrow(True)
        else:
            if not self.op("("):
                raise _Bad
            self.arrow(True)

    def generic_arrow(self, asyn: bool) -> None:
        at = self.at
        self.type_parameters()
        if self.jsx and not re.match(r"<\s*(const\s+)?[\w$]+\s*(,|extends\b)", self.s[at:]):
            raise _Bad
        if not self.op("("):
            raise _Bad
        self.arrow(asyn)

    def unary(self, heritage: bool = False) -> int:
        """0: not assignable; 1: assignable; 2: a lone name; 3: an array or object literal."""
        while True:
            tok = self.tok
            if self.kind == "op":
                if tok in PREFIX:
                    self.goto(self.end)
                    self.unary()
                    return 0
                if tok in ("++", "--"):
                    self.goto(self.end)
                    if self.unary() not in (1, 2):
                        raise _Bad
                    return 0
                if tok == "<" and self.ts and not self.jsx:
                    self.type_arguments() if self.s[self.end : self.end + 6] != "const>" else self.goto(self.end + 6)
                    self.unary()
                    return 0
            elif self.kind == "name":
                if tok in PREFIX:
                    self.goto(self.end)
                    self.unary()
                    return 0
                if tok == "await" and self.asyn:
                    self.goto(self.end)
                    self.unary()
                    return 0
            elif self.kind == "priv":
                self.goto(self.end)
                if self.tok != "in":
                    raise _Bad
                return 0
            break
        target = self.postfix(heritage)
        if self.tok in ("++", "--") and self.kind == "op" and not self.newline():
            if target not in (1, 2):
                raise _Bad
            self.goto(self.end)
            return 0
        return target

    def postfix(self, heritage: bool, new: bool = False) -> int:
        tok, kind = self.tok, self.kind
        if kind == "name":
            if tok not in RESERVED:
                if self.bad_name(tok):
                    raise _Bad
                if tok == "async":
                    state = self.save()
                    self.goto(self.end)
                    if self.tok == "function" and not self.newline():
                        self.function(True, False)
                        target = 0
                    else:
                        self.load(state)
                        self.goto(self.end)
                        target = 2
                else:
                    self.goto(self.end)
                    target = 2
            else:
                target = 0
                if tok in ("this", "null", "true", "false"):
                    self.goto(self.end)
                elif tok == "function":
                    self.function(False, False)
                elif tok == "class":
                    self.class_(False)
                elif tok == "new":
                    self.new()
                elif tok == "super":
                    self.goto(self.end)
                    if self.tok not in ("(", ".", "["):
                        raise _Bad
                elif tok == "import":
                    self.goto(self.end)
                    if self.take("."):
                        if self.tok != "meta":
                            raise _Bad
                        self.goto(self.end)
                    elif self.op("("):
                        if new:
                            raise _Bad
                        self.arguments()
                    else:
                        raise _Bad
                else:
                    raise _Bad
        elif kind in ("num", "str"):
            self.goto(self.end)
            target = 0
        elif tok == "(":
            self.goto(self.end)
            no_in, self.no_in, cond, self.in_cond = self.no_in, False, self.in_cond, False
            target = 1 if self.expression() else 0
            self.no_in, self.in_cond = no_in, cond
            self.need(")")
        elif tok == "[":
            self.array()
            target = 3
        elif tok == "{":
            self.object()
            target = 3
        elif tok in ("/", "/="):
            m = _REGEX.match(self.s, self.at)
            if not m or not _FLAGS.match(m[1]):
                raise _Bad
            self.goto(m.end())
            target = 0
        elif tok == "`":
            self.template(self.expression)
            target = 0
        elif tok == "<" and self.jsx:
            self.element()
            self.goto(self.end)
            target = 0
        elif tok == "@" and self.ts:
            self.decorators()
            self.class_(False)
            target = 0
        else:
            raise _Bad
        chained = False
        while True:
            tok = self.tok
            if self.kind == "op":
                if tok == "." or tok == "?.":
                    self.goto(self.end)
                    if tok == "?.":
                        if new:
                            raise _Bad
                        chained = True
                        if self.op("("):
                            self.arguments()
                            target = 0
                            continue
                        if self.op("["):
                            self.subscript()
                            target = 0
                            continue
                        if self.ts and self.op("<"):
                            self.type_arguments()
                            continue
                    if self.kind not in ("name", "priv"):
                        raise _Bad
                    self.goto(self.end)
                    target = 0 if chained else 1
                    continue
                if tok == "[":
                    self.subscript()
                    target = 0 if chained else 1
                    continue
                if tok == "(" and not new:
                    self.arguments()
                    target = 0
                    continue
                if tok == "`":
                    if chained:
                        raise _Bad
                    self.template(self.expression, _TAGGED)
                    target = 0
                    continue
                if self.ts:
                    if tok == "!" and not self.newline():
                        self.goto(self.end)
                        target = 1 if target else 0
                        continue
                    if tok in ("<", "<<") and not heritage and self.attempt(self.instantiation):
                        target = 0
                        continue
            return target

    def instantiation(self) -> bool:
        self.type_arguments()
        return self.tok in ("(", "`", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "^", "&", "|", "}", "") or self.newline()

    def new(self) -> None:
        self.goto(self.end)
        if self.take("."):
            if self.tok != "target":
                raise _Bad
            return self.goto(self.end)
        if self.tok == "new" and self.kind == "name":
            self.new()
        else:
            self.postfix(False, True)
        if self.op("("):
            self.arguments()

    def subscript(self) -> None:
        self.goto(self.end)
        no_in, self.no_in, cond, self.in_cond = self.no_in, False, self.in_cond, False
        self.expression()
        self.no_in, self.in_cond = no_in, cond
        self.need("]")

    def arguments(self) -> None:
        self.goto(self.end)
        no_in, self.no_in, cond, self.in_cond = self.no_in, False, self.in_cond, False
        while self.tok != ")" or self.kind == "str":
            if self.tok == "...":
                self.goto(self.end)
            self.assign()
            if self.tok == ",":
                self.goto(self.end)
            elif self.tok != ")":
                raise _Bad
        self.no_in, self.in_cond = no_in, cond
        self.goto(self.end)

    def array(self) -> None:
        self.goto(self.end)
        no_in, self.no_in, cond, self.in_cond = self.no_in, False, self.in_cond, False
        while not self.op("]"):
            if self.tok == ",":
                self.goto(self.end)
                continue
            self.take("...")
            self.part()
            if not self.op("]"):
                self.need(",")
        self.no_in, self.in_cond = no_in, cond
        self.goto(self.end)

    def object(self) -> None:
        self.goto(self.end)
        no_in, self.no_in, cond, self.in_cond = self.no_in, False, self.in_cond, False
        while not self.op("}"):
            if self.tok == "..." and self.kind == "op":
                self.goto(self.end)
                self.part()
            else:
                self.property()
            if not self.op("}"):
                self.need(",")
        self.no_in, self.in_cond = no_in, cond
        self.goto(self.end)

    def property(self) -> None:
        asyn = gen = accessor = False
        if self.kind == "name" and self.tok in ("async", "get", "set"):
            tok, state = self.tok, self.save()
            self.goto(self.end)
            if (self.kind in ("name", "str", "num") or self.op("[") or (tok == "async" and self.op("*"))) and not (tok == "async" and self.newline()):
                asyn, accessor = tok == "async", tok != "async"
            else:
                self.load(state)
        if self.op("*"):
            self.goto(self.end)
            gen = True
        plain, tok = self.kind == "name", self.tok
        self.key()
        if self.op("(") or (self.ts and self.op("<")):
            return self.callable_in_object(asyn, gen)
        if asyn or gen or accessor:
            raise _Bad
        if self.op(":"):
            self.goto(self.end)
            self.part()
            return
        if not plain or tok in RESERVED or self.bad_name(tok):
            raise _Bad
        if self.op("="):  # allowed in a pattern only
            self.goto(self.end)
            self.assign()
            self.cover = True

    def callable_in_object(self, asyn: bool, gen: bool) -> None:
        self.callable(asyn, gen)
        if self.s[self.before - 1 : self.before] != "}":
            raise _Bad

    def template(self, inner, pattern=_TEMPLATE) -> None:
        pos = self.end
        no_in, self.no_in, cond, self.in_cond = self.no_in, False, self.in_cond, False
        while True:
            m = pattern.match(self.s, pos)
            if m is None:
                raise _Bad
            if m[1] == "`":
                break
            self.goto(m.end())
            inner()
            if not self.op("}"):
                raise _Bad
            pos = self.end
        self.no_in, self.in_cond = no_in, cond
        self.goto(m.end())

    # --- JSX

    def element(self) -> None:
        """At ``<``; afterwards ``end`` is behind the element and no token is scanned."""
        s = self.s
        name = self.jsx_name(self.at + 1)
        if name:
            pos = self.end
            if self.ts and s[pos : pos + 1] == "<":
                self.goto(pos)
                self.type_arguments()
                pos = self.before
            while True:
                pos = _SKIP.match(s, pos).end()
                c = s[pos : pos + 1]
                if c == "/":
                    pos = _SKIP.match(s, pos + 1).end()
                    if s[pos : pos + 1] != ">":
                        raise _Bad
                    self.end = pos + 1
                    return
                if c == ">":
                    pos += 1
                    break
                if c == "{":
                    self.goto(pos + 1)
                    self.need("...")
                    self.with_in(self.assign)
                    if not self.op("}"):
                        raise _Bad
                    pos = self.end
                    continue
                m = _JSX_ATTRIBUTE.match(s, pos)
                if not m:
                    raise _Bad
                pos = _SKIP.match(s, m.end()).end()
                if s[pos : pos + 1] == "=":
                    pos = _SKIP.match(s, pos + 1).end()
                    c = s[pos : pos + 1]
                    if c == "{":
                        self.goto(pos + 1)
                        self.with_in(self.assign)
                        if not self.op("}"):
                            raise _Bad
                        pos = self.end
                    elif c == "<":
                        self.at = pos
                        self.element()
                        pos = self.end
                    else:
                        m = _JSX_STRING.match(s, pos)
                        if not m:
                            raise _Bad
                        pos = m.end()
        else:
            pos = _SKIP.match(s, self.at + 1).end()
            if s[pos : pos + 1] != ">":
                raise _Bad
            pos += 1
        while True:
            pos = _JSX_TEXT.match(s, pos).end()
            c = s[pos : pos + 1]
            if c == "{":
                self.goto(pos + 1)
                if not self.op("}"):
                    self.take("...")
                    self.with_in(self.expression)
                    if not self.op("}"):
                        raise _Bad
                pos = self.end
            elif c == "<":
                after = _SKIP.match(s, pos + 1).end()
                if s[after : after + 1] == "/":
                    closing = self.jsx_name(after + 1)
                    if closing != name:
                        raise _Bad
                    pos = _SKIP.match(s, self.end if closing else after + 1).end()
                    if s[pos : pos + 1] != ">":
                        raise _Bad
                    self.end = pos + 1
                    return
                self.at = pos
                self.element()
                pos = self.end
            else:
                raise _Bad

    def jsx_name(self, pos: int) -> str:
        pos = _SKIP.match(self.s, pos).end()
        m = _JSX_NAME.match(self.s, pos)
        if not m:
            return ""
        self.end = m.end()
        return m[0]


_STATEMENTS = {
    "var": _Ecma.s_var, "let": _Ecma.s_var, "const": _Ecma.s_var, "function": _Ecma.s_function, "class": _Ecma.s_class, "if": _Ecma.s_if,
    "for": _Ecma.s_for, "while": _Ecma.s_while, "do": _Ecma.s_do, "switch": _Ecma.s_switch, "try": _Ecma.s_try, "throw": _Ecma.s_throw,
    "return": _Ecma.s_return, "break": _Ecma.s_break, "continue": _Ecma.s_break, "debugger": _Ecma.s_debugger, "with": _Ecma.s_wrong,
    "import": _Ecma.s_import, "export": _Ecma.s_export, "enum": _Ecma.s_enum,
}
_TS_STATEMENTS = {"interface": _Ecma.interface, "type": _Ecma.alias, "namespace": _Ecma.namespace, "module": _Ecma.namespace, "declare": _Ecma.declare, "abstract": _Ecma.abstract}


def _parses(parser: _Ecma) -> bool | None:
    try:
        parser.module()
    except _Bad:
        return False
    except (RecursionError, MemoryError):
        return None
    return True


def valid_ecma(text: str, ts: bool = False, jsx: bool = False) -> bool | None:
    """Whether ``text`` parses as a JavaScript module, or as TypeScript, with JSX if ``jsx``; None if it is nested too deeply to tell."""
    return _parses(_Ecma(text.removeprefix("\ufeff"), ts, jsx, {}))


def all_ecma(text: str) -> dict[str, bool | None]:
    """``valid_ecma`` for the four languages; the tokens are scanned once, and a text in which no element may begin is parsed once for both forms."""
    src, scanned, out = text.removeprefix("\ufeff"), {}, {}
    for ts, plain, with_elements in ((False, "javascript", "jsx"), (True, "typescript", "tsx")):
        parser = _Ecma(src, ts, True, scanned)
        out[plain] = out[with_elements] = _parses(parser)
        if parser.looked:
            out[plain] = _parses(_Ecma(src, ts, False, scanned))
    return out
