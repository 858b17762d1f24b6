"""Lexers. A lexer never fails: what it cannot read becomes a token of kind ERR, and it goes on behind it.

Tokens that start with ``>`` are single characters, so that nested type arguments close one by one.
"""

from __future__ import annotations

import re

NAME, NUM, STR, OP, KW, ERR, EOF = "NAME", "NUM", "STR", "OP", "KW", "ERR", "EOF"

#: The names languages go by.
ALIASES = {
    "python": "python", "py": "python", "python3": "python",
    "javascript": "javascript", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "node": "javascript",
    "typescript": "typescript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "golang": "go",
    "java": "java",
    "rust": "rust", "rs": "rust",
    "cpp": "cpp", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "c": "cpp",
    "csharp": "csharp", "c#": "csharp", "cs": "csharp",
    "markdown": "markdown", "md": "markdown",
}
EXTENSIONS = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript",
    ".go": "go", ".java": "java", ".rs": "rust", ".cs": "csharp",
    ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp",
    ".md": "markdown", ".markdown": "markdown",
}

#: The reserved words of each language.
RESERVED = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "rust": "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await",
    "cpp": "alignas alignof auto bool break case catch char class const const_cast constexpr continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_cast struct switch template this throw true try typedef typeid typename union unsigned using virtual void volatile while",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
}
RESERVED = {k: frozenset(v.split()) for k, v in RESERVED.items()}
RESERVED["typescript"] = RESERVED["javascript"]

_ID = r"[^\W\d]\w*"
_LINE_C, _BLOCK_C = r"//[^\n]*", r"/\*(?s:.*?)\*/"
_DQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)"


def _master(comment: str, string: str, number: str, name: str, ops: str, extra: str = "") -> re.Pattern:
    line = f"{extra}" if extra.startswith("(?P<P>") else ""  # a directive begins before the blanks of its line
    return re.compile(rf"{line}[ \t]*(?:(?P<C>{comment})|(?P<S>{string})|{'' if line else extra}(?P<F>{number})|(?P<I>{name})|(?P<N>\n)|(?P<W>[ \t\r\f\v\ufeff\xa0]+|\\\r?\n)|(?P<O>{ops})|(?P<E>[\s\S]))")


_OPS = r"<<=|<=>|\*\*=|&&=|\|\|=|\?\?=|\.\.\.|\.\.=|===|!==|<-|::|->|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|:=|\.\.|[-+*/%&|^~!<>=?:;,.(){}\[\]@#]"
_SUFFIX = r"(?![\w.])"
_MASTERS = {
    "python": _master(
        r"\#[^\n]*",
        r'[rRbBuUfFtT]{0,2}(?:"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|' + _DQ + "|" + _SQ + ")",
        r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?[jJ]?)(?!\w)",
        _ID,
        r"\*\*=|//=|<<=|\.\.\.|->|:=|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|<<|\*\*|//|[-+*/%&|^~<>=:;,.(){}\[\]@]",
    ),
    "go": _master(_LINE_C + "|" + _BLOCK_C, _DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))'", _NUM + r"i?(?!\w)", _ID, r"&\^=|&\^|" + _OPS),
    "java": _master(_LINE_C + "|" + _BLOCK_C, r'"""(?:[^\\]|\\[\s\S])*?"""|' + _DQ + r"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'", _NUM + r"[lLfFdD]?(?!\w)", r"(?:[^\W\d]|\$)[\w$]*", _OPS),
    "rust": _master(
        _LINE_C + "|" + r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/",
        r'[bc]?r(?P<rh>\#*)"(?s:.*?)"(?P=rh)(?!\#)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:[nrt0\\\'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))\'',
        r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)",
        r"(?:r\#)?" + _ID,
        _OPS + r"|\$",
        extra=r"(?P<L>'[^\W\d]\w*(?!'))|",
    ),
    "cpp": _master(_LINE_C + "|" + _BLOCK_C, r'(?:u8|[uUL])?R"(?P<rd>[^()\\\s]{0,16})\((?s:.*?)\)(?P=rd)"|(?:u8|[uUL])?' + _DQ + r"|(?:u8|[uUL])?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|[0-7]{1,3}|.))+'", r"(?:0[xX][0-9a-fA-F']+|0[bB][01']+|(?:\d[\d']*)?\.\d[\d']*(?:[eE][+-]?\d+)?|\d[\d']*\.?(?:[eE][+-]?\d+)?)[uUlLfFzZ]*(?!\w)", _ID, r"->\*|" + _OPS, extra=r"(?P<P>(?<![^\n])[ \t]*\#[^\n]*(?:(?<=\\)\n[^\n]*|(?<=\\\r)\n[^\n]*)*)|"),
    "csharp": _master(_LINE_C + "|" + _BLOCK_C, r'\$*(?P<q>"{3,})(?s:.*?)(?P=q)(?!")|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?' + _DQ + r"|'(?:[^'\\\n]|\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{1,4}|.))'", _NUM + r"(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])(?!\w)", r"@?" + _ID, _OPS, extra=r"(?P<P>(?<![^\n])[ \t]*\#(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|error|warning|line)[^\n]*)|"),
}
_JS = re.compile(
    rf"(?P<C>{_LINE_C}|{_BLOCK_C}|\A\#![^\n]*)|(?P<S>{_DQ}|{_SQ})|(?P<F>(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:0|[1-9][\d_]*)n|(?:0|[1-9][\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|(?:0|[1-9][\d_]*)\.?(?:[eE][+-]?\d+)?)(?![\w$]))|(?P<I>\#?(?:[^\W\d]|\$)[\w$]*)|(?P<N>\n)|(?P<W>[ \t\r\f\v\ufeff\xa0\u2028\u2029]+)|(?P<B>`)|(?P<O>{_OPS})|(?P<E>[\s\S])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


class Lexed:
    """Tokens of a text as parallel lists, the last of kind EOF; spans of comments and of preprocessor lines."""

    __slots__ = ("kinds", "texts", "starts", "ends", "lines", "comments", "directives")

    def __init__(self):
        self.kinds, self.texts, self.starts, self.ends, self.lines = [], [], [], [], []  # lines: a line break stands before the token
        self.comments, self.directives = [], []

    def add(self, kind: str, text: str, start: int, end: int, line: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.starts.append(start)
        self.ends.append(end)
        self.lines.append(line)


def _after_error(text: str, at: int) -> int:
    """Where to go on behind an unreadable character: at the end of the line if it opens a string or comment, else next to it."""
    if text[at] in "\"'`":
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    return at + 1


def _plain(text: str, lang: str) -> Lexed:
    out, master, words = Lexed(), _MASTERS[lang], RESERVED[lang]
    go, python = lang == "go", lang == "python"
    pos, n, line = 0, len(text), False
    rows: list[tuple] = []
    match, add, ends = master.match, rows.append, (NAME, NUM, STR)
    while pos < n:
        m = match(text, pos)
        kind = m.lastgroup
        if kind in ("rh", "rd", "q"):
            kind = "S"
        start, pos = m.span(kind)
        if kind == "I":
            s = m[kind]
            add((KW if s in words else NAME, s, start, pos, line))
        elif kind == "W":
            continue
        elif kind == "O":
            s = m[kind]
            if s == "/" and text.startswith("/*", start):  # a comment without an end
                pos = n
                add((ERR, "/*", start, n, line))
            else:
                add((OP, s, start, pos, line))
        elif kind == "N" or kind == "C" or kind == "P":
            if kind == "C":
                out.comments.append((start, pos))
            elif kind == "P":
                out.directives.append((start, pos))
            if kind != "C" or "\n" in m[kind]:
                if go and not line and rows and (rows[-1][0] in ends or rows[-1][1] in _GO_ENDS):
                    add((OP, ";", start, start, False))
                line = True
            continue
        elif kind == "S":
            add((STR, "", start, pos, line))
        elif kind == "F":
            bad = python and re.match(r"0_?\d", m[kind]) and not re.fullmatch(r"[0_]+|.*[.eEjJ].*", m[kind])
            add((ERR if bad else NUM, "", start, pos, line))
        elif kind == "L":
            add(("LIFE", "", start, pos, line))
        else:
            pos = _after_error(text, start)
            add((ERR, "", start, pos, line))
        line = False
    if go and rows and (rows[-1][0] in ends or rows[-1][1] in _GO_ENDS):
        add((OP, ";", n, n, False))
    add((EOF, "", n, n, True))
    out.kinds, out.texts, out.starts, out.ends, out.lines = map(list, zip(*rows))
    return out


_GO_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())


def _script(text: str, markup: bool = False) -> Lexed:
    """Tokens of a script; with ``markup`` a ``<`` where a value may begin opens an element (see ``_element``)."""
    out = Lexed()
    pos = _script_run(text, 0, out, markup, False)
    while pos < len(text):  # behind a brace that nothing opens
        pos = _script_run(text, pos, out, markup, False)
    n = len(text)
    out.add(EOF, "", n, n, True)
    return out


def _script_run(text: str, pos: int, out: Lexed, markup: bool, inside: bool) -> int:
    """Read tokens up to the end, or with ``inside`` up to the brace that closes what the caller opened."""
    words, n, line = RESERVED["javascript"], len(text), False
    braces: list[bool] = []  # of each open brace, whether it belongs to a template
    while pos < n:
        m = _JS.match(text, pos)
        kind, start, pos = m.lastgroup, pos, m.end()
        if kind == "W":
            continue
        if kind == "N":
            line = True
            continue
        if kind == "C":
            out.comments.append((start, pos))
            line |= "\n" in m.group()
            continue
        s = m.group()
        if kind == "I":
            out.add(KW if s in words else NAME, s, start, pos, line)
        elif kind == "S":
            out.add(STR, "", start, pos, line)
        elif kind == "F":
            out.add(NUM, "", start, pos, line)
        elif kind == "B":
            pos = _template(text, start + 1, out, start, line, braces, "TS")
        elif kind == "O":
            if s[0] == "/" or markup and s[0] == "<":
                k, t = (out.kinds[-1], out.texts[-1]) if out.kinds else (OP, "(")
                value = k in (NAME, NUM, STR, "TE", "JS", "JC") or t in (")", "]", "}") or k == KW and t in ("this", "super", "null", "true", "false")
                if s[0] == "<":
                    if (not value or t in _JS_BEFORE_REGEX) and _TAG.match(text, start):
                        pos, line = _element(text, start, out, line), False
                        continue
                elif text.startswith("/*", start):
                    pos = n
                    out.add(ERR, "/*", start, n, line)
                    continue
                elif (not value or t in _JS_BEFORE_REGEX) and (r := _JS_REGEX.match(text, start)):
                    pos = r.end()
                    out.add(STR, "", start, pos, line)
                    line = False
                    continue
            if s == "{":
                braces.append(False)
            elif s == "}" and inside and not braces:
                return start
            elif s == "}" and braces and braces.pop():
                out.add(OP, "}$", start, pos, line)
                pos = _template(text, pos, out, pos, False, braces, None)
                line = False
                continue
            out.add(OP, s, start, pos, line)
        else:
            pos = _after_error(text, start)
            out.add(ERR, "", start, pos, line)
        line = False
    return n


_TAG = re.compile(r"<\s*(?P<t>(?:[^\W\d]|\$)[\w$.:\-]*)?(?=[\s/>{])")
_ATTRIBUTE = re.compile(r"(?P<W>\s+)|(?P<N>(?:[^\W\d]|\$)[\w$:\-]*)|(?P<Q>=)|(?P<S>\"[^\"]*\"|'[^']*')|(?P<B>\{)|(?P<E>/\s*>)|(?P<O>>)")
_CLOSING = re.compile(r"<\s*/\s*(?P<t>[\w$.:\-]*)\s*>")
_MARKUP_TEXT = re.compile(r"[^<{}>]*")


def _element(text: str, pos: int, out: Lexed, line: bool) -> int:
    """Read an element and all in it: JB its start, JN a name, JS or JO the end of its tag, JC its closing tag.

    Elements nest on a list, not by calls; braces hold expressions, between ``{<`` and ``>}``. A closing tag of another
    name, and a character that may not stand in text, is an error.
    """
    n, names, in_tag = len(text), [], False
    while pos < n:
        if in_tag:
            m = _ATTRIBUTE.match(text, pos)
            if not m:
                out.add(ERR, "", pos, n, False)
                return n
            kind, start, pos = m.lastgroup, pos, m.end()
            if kind == "B":
                pos = _braced(text, start, out)
            elif kind in "EO":
                out.add("JS" if kind == "E" else "JO", "", start, pos, False)
                in_tag = False
                if kind == "E":
                    names.pop()
                    if not names:
                        return pos
            elif kind != "W":
                out.add({"N": "JN", "S": STR, "Q": OP}[kind], "=" if kind == "Q" else "", start, pos, False)
            continue
        if m := _CLOSING.match(text, pos):
            same = bool(names) and names.pop() == m["t"]
            out.add("JC" if same else ERR, "", pos, m.end(), False)
            pos = m.end()
            if not same or not names:
                return pos
        elif m := _TAG.match(text, pos):
            out.add("JB", "", pos, m.end(), line)
            names.append(m["t"] or "")
            pos, in_tag, line = m.end(), True, False
        elif text[pos] == "{":
            pos = _braced(text, pos, out)
        elif text[pos] in "<>}":
            out.add(ERR, "", pos, pos + 1, False)
            return pos + 1
        else:
            pos = _MARKUP_TEXT.match(text, pos).end()
    out.add(ERR, "", n, n, False)
    return n


def _braced(text: str, pos: int, out: Lexed) -> int:
    out.add(OP, "{<", pos, pos + 1, False)
    end = _script_run(text, pos + 1, out, True, True)
    if end < len(text):
        out.add(OP, ">}", end, end + 1, False)
    return end + 1


def _template(text: str, pos: int, out: Lexed, start: int, line: bool, braces: list[bool], opening: str | None) -> int:
    """Read template text up to its end or next substitution."""
    if opening:
        out.add(opening, "", start, pos, line)
    end = _JS_TEXT.match(text, pos).end()
    if text.startswith("`", end):
        out.add("TE", "", pos, end + 1, False)
        return end + 1
    if text.startswith("${", end):
        out.add(OP, "${", end, end + 2, False)
        braces.append(True)
        return end + 2
    stop = text.find("\n", start)
    stop = len(text) if stop < 0 else stop
    out.add(ERR, "", pos, max(stop, pos), False)
    return max(stop, pos)


def _python(text: str) -> Lexed:
    """Adds NL, IN and DE tokens for line ends and changes of indentation."""
    flat, out = _plain(text, "python"), Lexed()
    out.comments = flat.comments
    depth, stack = 0, [(0, 0)]
    for k in range(len(flat.kinds)):
        kind, s, start, line = flat.kinds[k], flat.texts[k], flat.starts[k], flat.lines[k]
        if depth == 0 and (line or k == 0 or kind == EOF):
            if out.kinds and out.kinds[-1] not in ("NL", "IN", "DE"):
                out.add("NL", "", start, start, False)
            if kind != EOF:
                begin = text.rfind("\n", 0, start) + 1
                lead = text[begin:start].lstrip("\ufeff\f")
                wide, narrow = 0, 0
                for c in lead:
                    wide = (wide // 8 + 1) * 8 if c == "\t" else wide + 1
                    narrow += 1
                at = (wide, narrow)
                if lead.strip(" \t\r"):
                    out.add(ERR, "", start, start, False)  # behind a continued line
                elif wide > stack[-1][0]:
                    out.add("IN" if narrow > stack[-1][1] else ERR, "", start, start, False)
                    stack.append(at)
                else:
                    while wide < stack[-1][0]:
                        stack.pop()
                        out.add("DE", "", start, start, False)
                    if at != stack[-1]:
                        out.add(ERR, "", start, start, False)
            else:
                while len(stack) > 1:
                    stack.pop()
                    out.add("DE", "", start, start, False)
        if kind == OP:
            depth += s in ("(", "[", "{")
            depth = max(0, depth - (s in (")", "]", "}")))
        elif kind == EOF:
            while len(stack) > 1:
                stack.pop()
                out.add("DE", "", start, start, False)
        out.add(kind, s, start, flat.ends[k], line)
    return out


def lex(text: str, lang: str, markup: bool = False) -> Lexed:
    """Tokens of a text in a language of ``ALIASES`` other than markdown; of scripts also with elements, if ``markup``."""
    if lang == "python":
        return _python(text)
    if lang in ("javascript", "typescript"):
        return _script(text, markup)
    return _plain(text, lang)
