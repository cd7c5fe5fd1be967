"""Token kinds and productions of eight languages, each token kind being one character.

A file becomes a string of kinds. Brackets nest; everything between brackets is regular once inner groups have been
replaced by one character (G for ``( )``, A for ``[ ]``, B for ``{ }``), so productions are regular expressions over
kinds: what may stand in round, square and curly brackets and at the top. The permissible neighbours of a token are
derived from the same expressions (``permissible_pairs``).
"""

from __future__ import annotations

import re
from functools import cache

from codeloom.llm.automaton import Automaton

try:
    from re import _constants as _c, _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

_STR = r'"(?:[^"\\\n]|\\[\s\S])*"'
_CHR = r"'(?:[^'\\\n]|\\[\s\S])*'"
_COM = r"//[^\n]*|/\*[\s\S]*?\*/"
_NUM = r"\.?\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d+)?"
_ID = r"[^\W\d]\w*"


def _map(text: str) -> dict[str, str]:
    """``kind: word word`` lines as word → kind."""
    return {w: line.split(":", 1)[0].strip() for line in text.strip().split("\n") for w in line.split(":", 1)[1].split()}


class Language:
    """lex: an expression for findall; words, ops: kind by text; first: kind by what a token begins with; then the productions."""

    def __init__(self, name: str, lex: str, words: dict, ops: dict, special: list, inside: dict[str, str], top: str, generics: str | None = None, newline=None, folds: tuple = ()):
        self.name = name
        self.lex = re.compile(lex)
        self.words, self.ops, self.special = words, ops, [(re.compile(a, re.S), b) for a, b in special]
        self.sources = {**inside, "top": top}
        self._automata: dict[str, Automaton] = {}
        self.generics = re.compile(generics) if generics else None
        self.newline = newline
        self.folds = [(re.compile(a), b) for a, b in folds]  # compound forms that become one character before the productions apply

    def fits(self, where: str, kinds: str) -> bool:
        """Whether the kinds are what may stand there."""
        a = self._automata.get(where)
        if a is None:
            a = self._automata[where] = Automaton(self.sources[where])
        return a.full(kinds)

    def kind(self, t: str) -> str:
        for r, k in self.special:
            if r.match(t):
                return k
        if t in self.words:
            return self.words[t]
        c = t[0]
        if c.isalpha() or c == "_" or c in "$#@" and len(t) > 1:
            return "i"
        if c.isdigit() or c == "." and t[1:2].isdigit():
            return "n"
        return self.ops.get(t, "!")


class Kinds(dict):
    """Remembers the kind of each token text."""

    def __init__(self, lang: Language):
        self.lang = lang

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        k = self[t] = self.lang.kind(t)
        return k


def _ops(text: str) -> dict[str, str]:
    return _map(text) | {c: c for c in "()[]{},;:"}


def _ternary(e0: str) -> str:
    return f"{e0}(?:(?:\\?{e0})+(?::{e0})+)*"


def _list(x: str) -> str:
    return f"{x}(?:,{x})*"


# --- JavaScript and TypeScript

_JS_WORDS = """
I: if
E: else
F: for
W: while with
D: do
S: switch
C: case
U: default
R: return throw
K: break continue debugger
T: try
H: catch
Y: finally
f: function
c: class
x: extends
M: import
X: export
u: new typeof void delete await yield
y: async
v: var let const
J: in of
o: instanceof
!: enum
"""
_JS_OPS = """
=: = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=
o: == != === !== <= >= && || ?? << >>> | ^ / % ** & >>
<: <
>: >
-: + -
*: *
u: ! ~
p: ++ --
a: =>
d: ...
?: ?
@: @
"""
_JS_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[+\-*%<>~^\n])|(?<=[=(,:;!&|?{}\[+\-*%<>~^] )|(?<=return )|\A)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"


def _js(ts: bool) -> Language:
    word = "[iIEFWDSCURKTHYfcxMXuyvJqoNPV]"
    tp = "(?:q?(?:u?[iGABnst]|u)m*[Ap]*(?:a(?:[iGABnst]|u)m*A*)?)"
    typ = f"(?:[|&]?{tp}(?:[|&]{tp})*)"
    ann = f"(?::{typ})?" if ts else ""
    opt = "[?p]?" if ts else ""
    bin_ = r"[o\-*<>J=|&]" if ts else r"[o\-*<>J=]"
    fn = rf"y?f\*?i?G{ann}B"
    heritage = "(?:xi[mG]*(?:,i[mG]*)*)*" if ts else "(?:x[iG][mG]*)?"
    cl = f"ci?{heritage}B"
    arrow = f"y?(?:i|G{ann})a"
    un = rf"(?:[u\-p]|{arrow})*(?:{fn}|{cl}|[inGABst])" + ("(?:[mGAtp]|u(?=[mGA;,)]))*+" if ts else "[mGAtp]*+") + (f"(?:V{typ})*" if ts else "")
    e0 = f"{un}(?:{bin_}{un})*"
    ex = f"(?:{_ternary(e0)})"
    ls = _list(f"d?{ex}")
    end = r"(?:;|\Z)"
    key = f"(?:{word}|s|n|A)"
    par = rf"(?:@i[mG]*)*q*d?(?:i|A|B)\??{ann}(?:={ex})?"
    paren = f"(?:(?:{ls},?)?|(?:v?{ls})?;(?:{ls})?;(?:{ls})?|v?(?:i|A|B)J{ls}" + (f"|{_list(par)},?|v(?:i|A|B){ann}={ex}(?:,(?:i|A|B){ann}={ex})*;(?:{ls})?;(?:{ls})?|{typ}" if ts else "") + ")"
    brack = f"(?:,*(?:d?{ex},+)*(?:d?{ex})?" + (f"|i:{typ}|iJ{typ}|{_list(typ)}" if ts else "") + ")"
    mem = rf"(?:y?\*?q?{key}G{ann}B|{key}:{ex}|d{ex}|i(?:={ex})?|s(?:={ex}))" if ts else rf"(?:y?\*?q?{key}GB|{key}:{ex}|d{ex}|i(?:={ex})?)"
    obj = f"{_list(mem)},?"
    imp = f"{_list(f'{word}(?:ii)?')},?"
    sep = r"(?:[;,]|\Z)" if ts else end
    field = rf"(?:@i[mG]*)*q*y?\*?{key}{opt}(?:G{ann}(?:B|{sep})|{ann}(?:={ex})?{sep})" if ts else rf"q*y?\*?{key}(?:GB|(?:={ex})?{end})"
    cls = f"(?:;|qB|{field})*"
    bind = _list(f"(?:i|A|B){'p?' if ts else ''}{ann}(?:={ex})?")
    dec = rf"y?f\*?i?G{ann}B|" + (rf"y?fiG{ann}{end}|" if ts else "") + f"ci?{heritage}B|v{bind}{end}"
    if ts:
        dec = rf"(?:@i[mG]*;?)*q*(?:{dec}|v?Nim*{heritage}B|Ns B|Pi={typ}{end}|X?)".replace(" ", "").replace("|X?)", ")")
    simple = (
        rf"(?:;|{dec}|TB(?:HG?B(?:YB)?|YB)|SGB|D(?:B|{ex};?)WG;?|R(?:{ls})?{end}|Ki?{end}"
        rf"|Mi?s{end}|Mi?(?:i|B|\*ii)(?:,(?:B|\*ii))?is{end}|X(?:U(?:{dec}|{ex}{end})|{dec}|i?B(?:is)?{end}|\*(?:ii)?is{end}|={ex}{end})|B|{ls}{end})"
    )
    pfx = "(?:IG|E|Fu?G|WG|i:)*"
    stmt = f"(?:{pfx}{simple})"
    block = f"{stmt}*+"
    switch = f"(?:(?:C{ls}|U):{stmt}*+)*"
    words = _map(_JS_WORDS)
    lex = rf"{_COM}|/\*|{_TEMPLATE}|{_STR}|{_CHR}|{_REGEX}|\n|(?<!\d)\??\.\s*[#A-Za-z_$][\w$]*|"
    special = [(r"//|/\*[\s\S]*\*/\Z", ""), (r"\n", "L"), (r"`.", "t"), (r"[\"'].", "s"), (r"\??\.\s*[#A-Za-z_$]", "m"), (r"/[^=/*].*/[a-z]*\Z|/=.+/[a-z]*\Z", "n"), (r"(?:static|get|set|public|private|protected|readonly|abstract|override|declare)\s", "q"), (r"import\s*[(.]", "i"), (r"\?\.\Z", "")]
    if ts:
        lex += r"(?:static|get|set|public|private|protected|readonly|abstract|override|declare)\s(?=\s*[\w$\[#*{])|(?<=[\w)\]])!(?=[.,;)\]\[])|type\s(?=\s*[A-Za-z_]\w*\s*[=<])|(?:interface|enum|namespace|module)\s(?=\s*[\w\"'])|(?:keyof|typeof|infer|unique)\s|"
        words = words | {"implements": "x", "as": "V", "satisfies": "V"}
        words.pop("enum")
        special = [(r"type\s", "P"), (r"(?:interface|enum|namespace|module)\s", "N"), (r"(?:keyof|typeof|infer|unique)\s", "u")] + special
    else:
        lex += r"(?:static|get|set)\s(?=\s*[\w$\[#*])|"
    lex += rf"import(?=\s*[(.])|\?\.(?=[(\[])|#?[^\W\d][\w$]*|\$[\w$]*|{_NUM}|{_JS_PUNCT}|\S"
    ops = _ops(_JS_OPS)
    if ts:
        ops = ops | {"|": "|", "&": "&", ">>": ">>"}
        ops[">>"] = ">" * 2
    special = [(r"import\Z", "M")] + special

    def newline(k: str) -> str:
        k = re.sub(r"(?<=[imnsGABtp)\]}KR])L+(?=[instfcvIFWDSRKTXMuypCUqNP@])", ";", k)
        k = re.sub(r"(?<=[KR])L+|(?<=[imnsGABtp)\]])L+(?=E)", ";", k)
        return k.replace("L", "")

    return Language("typescript" if ts else "javascript", lex, words, ops, special, {"(": paren, "[": brack, "{": f"(?:{block}|{obj}|{cls}|{switch}|{imp})"}, block, r"(?<=[ifcN])<[iInstmGABu,|&=xaqdJV]*>(?!i\b)" if ts else None, newline, ((r"(?<=[=(,:?aRy])<[iux,=|&A]*>(?=G)", ""),) if ts else ())


# --- C and C++

_C_WORDS = """
I: if
E: else
F: for
W: while
D: do
S: switch
C: case
U: default
R: return
K: break continue goto
t: void int char short long float double signed unsigned const static extern inline register volatile restrict auto _Bool _Noreturn _Static_assert
z: struct union enum
y: typedef
u: sizeof
"""
_CPP_WORDS = """
R: throw co_return co_yield
T: try
H: catch
t: bool virtual explicit constexpr friend mutable noexcept override final thread_local consteval constinit wchar_t typename
z: class
e: template concept
N: namespace
j: using
l: public private protected
O: operator
u: new delete co_await not alignof typeid
i: decltype
"""
_C_OPS = """
=: = += -= *= /= %= <<= >>= &= |= ^=
o: == != <= >= && || << >> | ^ / %
<: <
>: >
-: + -
*: *
&: &
u: ! ~
p: ++ --
d: ...
?: ?
"""


def _c_like(cpp: bool) -> Language:
    spec = "(?:t*(?:zi?B?|z?i)t*|t+)"
    ptr = "[*&wt]*" if cpp else "[*t]*"
    cast = r"G(?=[insGtu&*\-A])"
    lam = "|AG?t*(?:mi|m)?B|iB|tG|tB" if cpp else "|GB|tG"
    un = rf"(?:[u\-&*p]|{cast})*(?:{lam[1:]}|s+|i(?:qi)*|[nG])(?:m|G|A|p)*+"
    e0 = rf"{un}(?:[o\-&*<>=w]{un})*" if cpp else rf"{un}(?:[o\-&*<>=]{un})*"
    ex = f"(?:{_ternary(e0)})"
    ls = _list(f"{ex}d?")
    iv = f"(?:{ex}|B)"
    di = f"{ptr}(?:iA*|GG|A)(?::{ex})?(?:={iv}|B|G)?" if cpp else f"{ptr}(?:iA*|GG)(?::{ex})?(?:={iv})?"
    decl = f"{spec}{_list(di)}"
    par = f"(?:{spec}d?{ptr}d?i?A*(?:={iv})?|{spec}{ptr}GG|d)"
    paren = f"(?:(?:{ls})?|(?:{decl}|{ls})?;(?:{ls})?;(?:{ls})?|{_list(par)}" + (f"|{spec}{ptr}(?:i|A):{iv}|{decl};{ls}|{_list(iv)}" if cpp else "") + ")"
    brack = f"(?:{ls}|[=&]|[=&](?:,&?i)*|&?i(?:,&?i)*)?" if cpp else f"(?:{ls}|t+)?"
    item = f"(?:(?:m|A)+=)?{iv}"
    init = f"{_list(item)},?"
    bases = "(?::(?:[lt])*i(?:,[lt]*i)*|:t+)?" if cpp else ""
    tail = f"(?:t|G)*(?:mi[*&]*|m)?(?::i[GB](?:,i[GB])*)?(?:B|;|=[nUu];)" if cpp else "(?:B|;)"
    func = f"(?:{spec}{ptr})?u?iG{tail}" if cpp else f"{spec}{ptr}iG{tail}|{spec}{ptr}iGG?B"
    comp = f"t*z+t*i?{bases}B(?:{_list(f'{ptr}iA*(?:={iv})?')})?;"
    simple = f"(?:;|{comp}|t*z+i(?::[ti]+)?;|SGB|DBWG;|R(?:{ls}|B)?;|K(?:i)?;|y{spec}{ptr}(?:iA*|GG)(?:,{ptr}iA*)*;|{func}|{decl};|tsB|B|{ls};"
    if cpp:
        simple += f"|TB(?:HGB)+|t*N[it]*B|Ni=i;|jN?i;|ji={spec}{ptr};|jt?i;|{spec}?{ptr}O[^GB;]{{0,3}}G?G{tail}|i:|tG(?:,s)?;|tz.*?;"
    simple += ")"
    pfx = f"(?:It?G|E|FG|WG|i:|C{ex}:|U:" + ("|l:|e" if cpp else "") + ")*"
    block = f"(?:{pfx}{simple})*+" + f"(?:i:|C{ex}:|U:" + ("|l:" if cpp else "") + ")*"
    words = _map(_C_WORDS)
    ops = _ops(_C_OPS)
    lex = rf"{_COM}|/\*|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*|"
    special = [(r"//|/\*[\s\S]*\*/\Z|[ \t]*#", ""), (r"(?:u8|[uUL])?[\"'].", "s"), (r"->\s*[A-Za-z_~]|\.\*?\s*[A-Za-z_~]", "m")]
    if cpp:
        words = words | _map(_CPP_WORDS)
        ops |= {"::": "q", "&&": "w", ">>": ">>", "->": "m"}
        lex += r'(?:u8|[uUL])?R"\((?:(?!\)")[\s\S])*\)"|(?:u8|[uUL])?R"[a-zA-Z_]{1,16}\([\s\S]*?\)[a-zA-Z_]{1,16}"|'
        special = [(r'(?:u8|[uUL])?R"', "s"), (r"(?:::)?\w+::", "i")] + special
        lex += rf"(?:u8|[uUL])?(?:{_STR}|{_CHR})|(?:->|\.)\s*~?[A-Za-z_]\w*|(?:::)?(?:{_ID}::)+~?{_ID}|{_ID}|\d[\w']*(?:\.\d*\w*)?(?:(?<=[eE])[+-]\d+)?|\.\d\w*|"
        ops[">>"] = ">>"
        lex += r"\.\.\.|<<=|>>=|->\*?|::|==|!=|<=|>=|&&|\|\||<<|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
        return Language("cpp", "(?m)" + lex, words, ops, special, {"(": paren, "[": brack, "{": f"(?:{block}|{init})"}, block, r"(?<=[ie])<[itmGABnz,*&wd=qs]*>")
    lex += rf"(?:u8|[uUL])?(?:{_STR}|{_CHR})|(?:->|\.)\s*[A-Za-z_]\w*|{_ID}|{_NUM}|\.\.\.|<<=|>>=|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
    return Language("c", "(?m)" + lex, words, ops, special, {"(": paren, "[": brack, "{": f"(?:{block}|{init})"}, block)


# --- C#

_CS_WORDS = """
I: if
E: else
F: for foreach
W: while lock fixed
D: do
S: switch
C: case
U: default
R: return throw
K: break continue goto
T: try
H: catch
Y: finally
c: class struct interface enum record
N: namespace
j: using
t: public private protected internal static readonly override virtual abstract sealed partial const extern volatile unsafe event delegate required implicit explicit async
e: new
u: await
V: is as
J: in
r: ref out params
h: where when
O: operator
"""
_CS_OPS = """
=: = += -= *= /= %= <<= >>= &= |= ^= ??=
o: == != <= >= && || ?? << | ^ / % & *
<: <
>: >
-: + -
u: ! ~
p: ++ --
a: =>
d: ..
?: ?
q: ::
"""


def _csharp() -> Language:
    ty = r"(?:(?:im*|G)\??(?:A\??)*)"
    new = r"(?>e(?:im*\??)?A*G?A?B?)"
    lam = "t?[insG]m*a"
    un = rf"(?:[u\-p]|{lam}|G(?=[insGe]))*(?:t?[iG]aB|{new}|[inGsU])(?:\?(?=[mA]))?(?:m|G|A|p|u(?=m)|SB|\?(?=[mA]))*+(?:Vu?(?:{ty}i?|n|s))*"
    e0 = rf"{un}(?:[o\-<>=d]{un})*"
    ex = f"(?:{_ternary(e0)})"
    arg = f"(?:i:)?(?:r{ty}i|r?{ex})"
    ls = _list(arg)
    iv = f"(?:{ex}|B)"
    var = f"{ty}{_list(f'i(?:={iv})?')}"
    par = f"(?:A*[rtJ]*{ty}i(?:={ex})?)"
    paren = f"(?:(?:{ls})?|{_list(par)}|(?:{var}|{ls})?;(?:{ls})?;(?:{ls})?|{ty}iJ{ex}|GJ{ex}|{ty}i?|{_list(f'{ty}i?')}|{var}|r{ty})"
    brack = f"(?:,*|{ls}|i:{ls}|u?n?d?u?n?|{_list('im*G?')})"
    item = f"(?:A={iv}|i=B|{iv})"
    init = f"{_list(item)},?"
    where = f"(?:hi:[^B;]*)*"
    bases = f"(?:G)?(?::{ty}G?(?:,{ty})*)?{where}"
    body = f"(?:B|a{ex};|;)"
    member = f"A*t*(?:{ty}i(?:m)*(?:A?G{where}{body}|A?B(?:={iv};)?|a{ex};)|{_list(f'{ty}i(?:={iv})?')}(?:,i(?:={iv})?)*;|u?iG(?::iG)?{body}|{ty}?O{ty}?[^GB]{{0,2}}G{body}|i(?:B|;|a{ex};)|{ty}iA{body})"
    simple = (
        f"(?:;|A*t*c+i{bases}(?:B|;);?|N(?:im*)(?:B|;)|TB(?:HG?(?:hG)?B)*(?:YB)?|SGB|DBWG;|R(?:{ls})?;|K(?:i|C{ex}|U)?;|j t*im*;|j i=im*;|j {var};|{ls};|{member}|A*t*{var};|t*B|t*c?{ty}iG;)"
    ).replace(" ", "")
    pfx = f"(?:IG|E|u?FG|WG|jG|C(?:{ex}|{ty}i|{ty}B)(?:h{ex})?:|U:)*"
    block = f"(?:{pfx}{simple})*+"
    lex = (
        rf"{_COM}|/\*|^[ \t]*\#[^\n]*|\"\"\"[\s\S]*?\"\"\"|\$?@\$?\"(?:[^\"]|\"\")*\"|\$\"(?:[^\"\\\n{{]|\\.|\{{\{{|\{{[^}}\n]*\}})*\"|{_STR}|{_CHR}|\??\.\s*@?[A-Za-z_]\w*|async\s(?=\s*[\w(])|this\s+(?=\w)|@?{_ID}|{_NUM}|"
        r"\.\.|<<=|>>=|\?\?=|::|=>|==|!=|<=|>=|&&|\|\||\?\?|<<|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
    )
    special = [(r"//|/\*[\s\S]*\*/\Z|[ \t]*#", ""), (r"\$?@?\$?[\"'].", "s"), (r"\??\.\s*@?[A-Za-z_]", "m"), (r"async\s", "t"), (r"this\s+", "r")]
    return Language("csharp", "(?m)" + lex, _map(_CS_WORDS), _ops(_CS_OPS), special, {"(": paren, "[": brack, "{": f"(?:{block}|{init})"}, f"(?:A*){block}", r"(?<=[im])<[im,?AGr]*>")


# --- Go

_GO_WORDS = """
f: func
v: var const
y: type
z: struct
Z: interface
M: map
h: chan
P: package
j: import
g: go defer
r: range
I: if
F: for
S: switch select
C: case
U: default
R: return
K: break continue goto fallthrough
E: else
"""
_GO_OPS = """
=: = := += -= *= /= %= <<= >>= &= |= ^= &^=
o: == != <= >= && || << >> | / % &^ < >
-: + -
*: *
&: &
u: ! ^ ~
p: ++ --
d: ...
w: <-
.: .
"""


def _go() -> Language:
    base = "(?:im?A?|zB|ZB|G)"
    t = f"(?:(?:[*]|A|MA|hw?|wh)*(?:{base}|fG(?:(?:[*]|A|MA|h)*{base})?))"
    res = f"(?:{t})?"
    comp = f"(?:(?:A|MA)*im?A?B|(?:A|MA|[*])+{base}B|zBB)"
    un = rf"(?:[u\-&*w])*(?:{comp}|fG{res}B|(?:A|MA)+{base}G|MA{t}|h{t}|A{t}|[ins]|G|zB)(?:m|G|A|\.G)*+"
    ex = rf"(?:{un}(?:[o\-&*]{un})*)"
    ls = f"{_list(ex)}"
    simple = f"(?:{ls}(?:={ls}|p|w{ex})?)"
    item = f"(?:(?:{ex}|B)(?::(?:{ex}|B))?)"
    par = f"(?:(?:i)?d?{t})"
    paren = f"(?:(?:{ls}d?,?)?|{_list(par)},?|{_list(t)}(?:,{ls})*,?|y|(?:[im.]?s;)*(?:[im.]?s)?|(?:i(?:,i)*{res}(?:={ls})?;)*(?:i(?:,i)*{res}(?:={ls})?)?|(?:i=?{t};)*(?:i=?{t})?)"
    brack = f"(?:{ex}?(?::{ex}?){{0,2}}|d|{_list(t)}|{_list(f'i(?:,i)*{t}')})"
    end = r"(?:;|\Z)"
    iff = f"I(?:{simple}?;)?{ex}B"
    stmt = (
        f"(?:i:)?(?:;|{iff}(?:E{iff})*(?:EB)?|F(?:{simple}?;{ex}?;{simple}?|(?:{ls}=)?r{ex}|{ex})?B|S(?:{simple}?;)?(?:{simple})?B|fG?iA?G{res}B|R(?:{ls})?{end}|Ki?{end}|g{ex}{end}"
        f"|v(?:i(?:,i)*{res}(?:={ls})?|G){end}|y(?:iA?=?{t}|G){end}|j(?:[im.]?s|G){end}|Pi{end}|B|{simple}{end})"
    )
    block = f"(?:{stmt};?)*+"
    switch = f"(?:(?:C(?:{simple}|{_list(t)})|U):{block})*"
    fields = f"(?:(?:(?:i(?:,i)*)?{t}s?|iG{res}|[*]?im?s?|u?{t}(?:o{t})*);)*(?:(?:i(?:,i)*)?{t}s?|iG{res}|[*]?im?s?)?"
    init = f"{_list(item)},?"
    lex = rf"{_COM}|/\*|`[^`]*`|{_STR}|{_CHR}|\n|\.\s*[^\W\d]\w*|{_ID}|{_NUM}|\.\.\.|&\^=?|<<=|>>=|:=|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<-|\S"
    special = [(r"//|/\*[\s\S]*\*/\Z", ""), (r"\n", "L"), (r"[\"'`].|``", "s"), (r"\.\s*[^\W\d]", "m")]

    def newline(k: str) -> str:
        return re.sub(r"(?<=[insm)\]}pRK])L+", ";", k).replace("L", "")

    return Language("go", lex, _map(_GO_WORDS), _ops(_GO_OPS), special, {"(": f"(?:{paren});?", "[": brack, "{": f"(?:{block}|{init}|{fields}|{switch})"}, f";*Pi;{block}", None, newline)


# --- Rust

_RUST_WORDS = """
f: fn
l: let
q: mut ref move
k: pub unsafe async extern const static dyn default
z: struct enum union trait
M: impl
j: use
N: mod
S: match
I: if
E: else
W: while
D: loop
F: for
J: in
R: return
K: break continue
V: as
h: where
y: type
"""
_RUST_OPS = """
=: = += -= *= /= %= <<= >>= &= |= ^=
o: == != <= >= && << / % ^
<: <
>: >
-: + -
*: *
&: &
u: !
w: ->
a: =>
d: .. ..= ...
|: |
O: ||
?: ?
@: @
#: #
$: $
Q: ::
"""


def _rust() -> Language:
    prim_t = "(?:im*|A|G|u|fG(?:wi)?)"
    t = rf"(?:(?:[&*xqk]|o(?=[xqki&]))*(?:k?M?F?{prim_t})(?:wA?[&xq]*i)?(?:-(?:[&xqk?]*{prim_t}))*)"
    bl = "(?:B)"
    lab = "(?:x:)?"
    clo_par = rf"(?:[&q]*(?:i|G|A)(?::{t})?(?:,[&q]*(?:i|G|A)(?::{t})?)*,?)?"
    clo = rf"(?:kq?|q)?(?:O|\|{clo_par}\|)(?:w{t}(?=B))?"
    pat0 = r"(?:[&q]*-?(?:i(?:[GB])?|n|s|G|A|d)(?:@-?[insGA])?(?:d-?[ins]?)?)"
    pat = rf"(?:\|?{pat0}(?:\|{pat0})*)"
    cond = rf"(?:l{pat}=)?"
    un0 = rf"(?:[u\-*&]|&q|&kq|o(?=[insGAu&*])|{clo}|d|R(?=[insGA&*uSI]))*"
    ifx = "I(?:{c}){b}(?:EI(?:{c}){b})*(?:E{b})?"
    post = r"(?:m|G|A|\?)*+"
    # operands without and with struct literals and blocks
    flat = rf"{un0}(?:i|n|s+|G|A){post}(?:V{t})*"
    bin_ = r"[o\-*&<>=|Od]"
    e_flat = rf"(?:{flat}(?:{bin_}{flat})*d?)"
    cnd = rf"{cond}{e_flat}(?:ol{pat}={e_flat})*"
    ifs = ifx.format(c=cnd, b=bl)
    mat = rf"S{e_flat}B"
    loops = rf"{lab}(?:DB|W{cnd}B|F{pat}J{e_flat}B)"
    blk = "(?:k?q?B)"
    un = rf"{un0}(?:iB|{blk}|i|n|s+|G|A){post}(?:V{t})*"
    ex = rf"(?:{un}(?:{bin_}{un})*d?|R(?:{un}(?:{bin_}{un})*)?|Kx?|d)"
    ls = f"{_list(ex)}"
    attr = "(?:#u?A)*"
    par = rf"{attr}(?:(?:&x?)?q?i|{pat}:{t}|{pat})"
    paren = rf"(?:(?:{ls},?)?|{_list(par)},?|{_list(f'{attr}k?G?{t}')},?|{t}|k|i[=:].*)"
    brack = rf"(?:{ls},?|{ex};{ex}|{t};{ex}|{t}|{_list(pat)},?|i(?:G|=s)?(?:,i(?:G|=s)?)*,?)?"
    end = r"(?:;|\Z)"
    use = r"(?:i|\*|B|Q|Vi)*"
    fnd = rf"k*s?k*fiG(?:w{t})?(?:h[^B;]*)?(?:B|;)"
    item = (
        rf"(?:k?G?(?:{fnd}|k*zi(?::[^B;]*)?(?:h[^B;]*)?(?:B|G?(?:h[^B;]*)?;|;)|kk?q?i:{t}={ex};|k*jQ?{use};|k?N i(?:B|;)|yi(?::[^;=]*)?(?:={t})?;)|k?M u?{t}(?:F{t})?(?:h[^B;]*)?B|k s?B|kii;)"
    ).replace(" ", "")
    stmt = rf"{attr}(?:;|{item}|l{pat}(?::{t})?(?:={ex}(?:EB)?)?;|{blk}(?![m?]);?|i[GAB];?(?=.)(?<=B)|{ex}{end})"
    block = rf"(?:{stmt})*+"
    arm = rf"{attr}{pat}(?:I{cond}{ex})?a"
    match = rf"(?:{arm}(?:B,?|{ex}(?:,|\Z)))*"
    fields = rf"{_list(rf'{attr}k?G?i:{t}')},?"
    lit = rf"{_list(rf'(?:i(?::{ex})?|n:{ex}|d{ex}?)')},?"
    variants = rf"{_list(rf'{attr}i[GB]?(?:={ex})?')},?"
    uses = rf"{_list(use)},?"
    brace = rf"(?:{block}|{match}|{fields}|{lit}|{variants}|{uses})"
    lex = (
        rf"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/|/\*|b?r(#+)\"[\s\S]*?\"\1|b?r\"[^\"]*\"|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))'|'[A-Za-z_]\w*|(?<!\d)\.\s*(?:[^\W\d]\w*|\d+)|"
        rf"(?:::)?(?:{_ID}::)+(?=[{{*<])|(?:::)?(?:{_ID}::)*(?:r\#)?{_ID}(?:!(?=\s*[(\[{{]))?|\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d+)?|"
        r"\.\.=|\.\.\.|<<=|>>=|->|=>|==|!=|<=|>=|&&|\|\||<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|::|\S"
    )
    lex = lex.replace('b?r(#+)\\"[\\s\\S]*?\\"\\1', '|'.join(rf'b?r{"#" * n}\"[\s\S]*?\"{"#" * n}(?!\#)' for n in (1, 2, 3)))
    special = [(r"//|/\*[\s\S]*\*/\Z", ""), (r"[bc]?r?#*\".", "s"), (r"[bc]?\"", "s"), (r"b?'(?:[^\\]|\\.+)'\Z", "s"), (r"'", "x"), (r"\.\s*[\w]", "m"), (r"(?:::)?\w+::", "i")]
    return Language("rust", lex, _map(_RUST_WORDS), _ops(_RUST_OPS), special, {"(": paren, "[": brack, "{": brace}, block, r"(?<=[iMfQ])<[ixmGA,&qk=*n:\-w?u]*>", folds=(("Q(?=G)", ""), (f"{ifs}|{mat}|{loops}", "B")))


# --- Python: the productions of logical lines; indentation is checked apart

_PY_WORDS = """
I: if
e: elif
E: else
F: for
W: while
T: try
H: except
Y: finally
w: with
f: def
c: class
R: return raise
K: pass break continue
M: import
N: from
V: as
l: lambda
u: not await
o: and or is
J: in
y: async
z: yield
d: del global nonlocal assert
"""
_PY_OPS = """
=: =
q: += -= *= /= //= %= **= <<= >>= &= |= ^= @=
Q: :=
a: ->
o: == != <= >= << >> | ^ / // % & < >
-: + -
*: *
P: **
u: ~
@: @
.: .
"""


def _python() -> Language:
    arg_l = r"(?:[*P]?i?(?:={0})?)"
    prim = "(?:[inGAB]|s+)"
    un = rf"(?:[u\-]|l(?:[*P]?i(?:={prim}[mGA]*)?(?:,[*P]?i(?:={prim}[mGA]*)?)*,?)?:)*{prim}[mGA]*"
    e0 = rf"{un}(?:(?:o|\-|[*P@QJ]|uJ|ou){un})*"
    ex = f"(?:{e0}(?:I{e0}E{e0})*)"
    star = rf"\*?{ex}"
    ls = f"{_list(star)},?"
    tg = rf"\*?{prim}[mGA]*(?:,\*?{prim}[mGA]*)*,?"
    comp = f"(?:y?F{tg}J{e0}(?:I{ex})*)+"
    yld = f"(?:zN{ex}|z(?:{ls})?)"
    par = rf"(?:[*P]?i(?::{ex})?(?:={ex})?|\*|o)"
    arg = rf"(?:[*P]{ex}|i={ex}|{ex}(?:{comp})?)"
    imp = "i(?:Vi)?"
    paren = f"(?:(?:{_list(arg)},?)?|{_list(par)},?|{yld}|{_list(imp)},?|{_list(f'{ex}(?:V{prim}[mGA]*)?')},?)"
    sl = rf"(?:\*?{ex}|{ex}?:{ex}?(?::{ex}?)?)"
    brack = f"(?:(?:{_list(sl)},?)?|{ex}{comp})"
    brace = f"(?:(?:{_list(f'(?:{ex}:{ex}|P{ex})')},?)?|{ls}|{ex}(?::{ex})?{comp})"
    ss = (
        rf"(?:K|R(?:{ls}(?:N{ex})?)?|M{_list('im*(?:Vi)?')}|N(?:[.im]+)M(?:\*|G|{_list(imp)})|d{ls}"
        rf"|{ls}(?::{ex})?(?:=(?:{ls}|{yld}))*|{ls}q(?:{ls}|{yld})|{yld})"
    )
    line = f"{ss}(?:;{ss})*;?"
    item = f"{ex}(?:V{prim}[mGA]*)?"
    head = {
        "I": f"I{ex}:", "e": f"e{ex}:", "E": "E:", "F": f"y?F{tg}J{ls}:", "W": f"W{ex}:", "T": "T:", "H": rf"H\*?(?:{ex}(?:,{ex})*(?:Vi)?)?:", "Y": "Y:",
        "w": f"y?w(?:{_list(item)}):", "f": f"y?fiA?G(?:a{ex})?:", "c": "ciA?G?:", "C": f"C{ls}:", "j": f"j{ls}(?:I{ex})?:",
    }
    lex = (
        r"\#[^\n]*|\\\n|\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t\f]*|[rbfuRBFU]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + _STR.replace(r"[^\"", r"[^\"") + "|" + _CHR + ")|"
        rf"\.[ \t]*(?!import\b)[^\W\d]\w*|(?:match|case)[ \t]+(?=[^\s=.,:)\]}}+*/%-][^\n]*:[ \t]*(?:\#[^\n]*)?$)|{_ID}|(?:0[xX][\da-fA-F_]+|0[bBoO][\d_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[jJ]?|\.\d[\d_]*(?:[eE][+-]?\d+)?[jJ]?)(?!\w)|"
        r"\.\.\.|\*\*=|//=|>>=|<<=|:=|->|==|!=|<=|>=|<<|>>|\*\*|//|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\S"
    )
    special = [(r"#|\\\n", ""), (r"[rbfuRBFU]{0,2}[\"'].", "s"), (r"\.\s*[^\W\d]", "m"), (r"\.\.\.", "i"), (r"match[ \t]", "C"), (r"case[ \t]", "j"), (r"\n", "L")]
    inside = {"(": paren, "[": brack, "{": brace}
    lang = Language("python", "(?m)" + lex, _map(_PY_WORDS), _ops(_PY_OPS), special, inside, line)
    lang.heads = tuple(head)
    lang.sources |= {f"head {k}": v for k, v in head.items()} | {"decorator": f"@{ex}"}
    return lang


_BUILD = {"javascript": lambda: _js(False), "typescript": lambda: _js(True), "c": lambda: _c_like(False), "cpp": lambda: _c_like(True), "csharp": _csharp, "go": _go, "rust": _rust, "python": _python}
LANGUAGES = tuple(_BUILD)

# fixed values: languages by file extension
EXTENSIONS = {
    ".js": "javascript", ".mjs": "javascript", ".jsx": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".hh": "cpp",
    ".c": "c", ".h": "c",
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".cs": "csharp", ".go": "go", ".rs": "rust",
}


@cache
def language(name: str) -> Language:
    return _BUILD[name]()


_GROUPS = {"G": ("(", ")"), "A": ("[", "]"), "B": ("{", "}")}


@cache
def permissible_pairs(name: str) -> frozenset[str]:
    """Two-character strings of kinds that may stand side by side: first, last and follow sets of the productions (Glushkov's construction), a group showing its brackets outside and its content's ends inside."""
    lang = language(name)
    alphabet = {k for k in [*lang.words.values(), *lang.ops.values(), *"insmtLGABCj"] if len(k) == 1} | set("@#")
    pairs: set[tuple[str, str]] = set()
    ends: dict[str, tuple[set, set, bool]] = {}

    def chars(av) -> set[str]:
        neg, out = False, set()
        for op, a in av:
            if op is _c.NEGATE:
                neg = True
            elif op is _c.LITERAL:
                out.add(chr(a))
            elif op is _c.RANGE:
                out |= {x for x in alphabet if a[0] <= ord(x) <= a[1]}
        return alphabet - out if neg else out & (alphabet | out)

    def seq(items) -> tuple[set, set, bool]:
        first, last, empty = set(), set(), True
        for op, av in items:
            f, l, e = node(op, av)
            pairs.update((a, b) for a in last for b in f)
            first |= f if empty else set()
            last = l | (last if e else set())
            empty &= e
        return first, last, empty

    def node(op, av) -> tuple[set, set, bool]:
        if op is _c.LITERAL:
            return {chr(av)}, {chr(av)}, False
        if op is _c.NOT_LITERAL:
            s = alphabet - {chr(av)}
            return s, s, False
        if op is _c.ANY:
            return alphabet, alphabet, False
        if op is _c.IN:
            s = chars(av)
            return s, s, False
        if op is _c.SUBPATTERN:
            return seq(av[3])
        if op is getattr(_c, "ATOMIC_GROUP", None):
            return seq(av)
        if op is _c.BRANCH:
            fs = [seq(x) for x in av[1]]
            return set().union(*(x[0] for x in fs)), set().union(*(x[1] for x in fs)), any(x[2] for x in fs)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
            lo, hi, sub = av
            f, l, e = seq(sub)
            if hi > 1:
                pairs.update((a, b) for a in l for b in f)
            return f, l, e or lo == 0
        return set(), set(), True  # assertions and ends

    for where, source in lang.sources.items():
        ends[where] = seq(_p.parse(source))
    for fold, _ in lang.folds:
        seq(_p.parse(fold.pattern))
    out: set[str] = set()
    show_l = lambda x: _GROUPS.get(x, (x, x))[1]
    show_f = lambda x: _GROUPS.get(x, (x, x))[0]
    out |= {show_l(a) + show_f(b) for a, b in pairs}
    for o, c in _GROUPS.values():
        f, l, e = ends[o] if o in ends else (set(), set(), True)
        out |= {o + show_f(x) for x in f} | {show_l(x) + c for x in l} | {o + c}
    if lang.generics:  # what stands in angle brackets is taken out before the productions apply
        inner = set(re.search(r"<\[(.*?)\]\*>", lang.generics.pattern)[1].replace("\\", "")) | {"<", ">"}
        out |= {show_l(a) + show_f(b) for a in inner for b in inner} | {show_l(a) + ">" for a in inner} | {"<" + show_f(a) for a in inner}
        out |= {">" + show_f(x) for x in alphabet} | {show_l(x) + "<" for x in alphabet}
    if name == "python":
        out |= {":" + show_f(x) for x in ends["top"][0]}
        out |= {x + "L" for x in map(show_l, alphabet)} | {"L" + x for x in map(show_f, alphabet)} | {"(L", "[L", "{L", "L)", "L]", "L}", ",L"}
    return frozenset(out)
