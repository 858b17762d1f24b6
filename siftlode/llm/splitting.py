"""Splitting oversized items at natural boundaries.

Method: pointer doubling. Every boundary where a piece may begin points to the farthest legal boundary where the next
one may begin, overlap included; the successor table is squared again and again, and with each square the set of
boundaries reached from the start doubles, until it holds all greedy cuts. The tables of all items of a batch are
squared together, as one flat array.

Natural boundaries are the lines where a top-level definition or a Markdown heading begins; comments, decorators and
attributes directly above a definition belong to it. Where a window holds none, a piece ends at the last empty line,
else the last line, else the last blank, else at the limit. Blanks and single characters are in a table only where a
stretch without a stronger boundary is longer than a window, so a table has about as many rows as an item has lines.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.syntax.lexers import ALIASES, EXTENSIONS
from siftlode.runtime import spread

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|unsafe|async|export|default|declare|strictfp|file|ref|override|virtual|new|extern)\s+)*"
#: What begins a definition at the left margin, comments and strings aside.
_DEFINITION = {
    "python": re.compile(r"(?:async\s+def|def|class)\s+\w+"),
    "typescript": re.compile(r"(?:(?:export|default|declare|abstract|async)\s+)*(?:function\b|class\b|interface\s+[\w$]+|(?:const\s+)?enum\s+[\w$]+)"),
    "go": re.compile(r"func\b|type\s+\w+(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe|extern(?:\s+\S+)?)\s+)*(?:fn\s+\w+|struct\s+\w+|enum\s+\w+|trait\s+\w+|union\s+\w+|impl\b)"),
    "java": re.compile(_MODS + r"(?:class|interface|enum|record|@interface)\s+\w+"),
    "csharp": re.compile(_MODS + r"(?:class|interface|enum|record|struct)\s+\w+"),
    "cpp": re.compile(r"(?:typedef\s+)?(?:class|struct|union|enum(?:\s+(?:class|struct))?)\b[^;=()]*\{|(?!(?:return|else|if|for|while|switch|do|case|goto|throw|using|typedef|namespace|new|delete)\b)(?:[\w:<>,~*&\[\]]+[\s*&]+)+[\w:~<>]+(?:\s*operator\s*\S+)?\s*\([^;{}]*\)[^;{}=]*\{"),
}
_DEFINITION["javascript"] = _DEFINITION["typescript"]
_DECORATOR = {
    "python": re.compile(r"@\w"), "typescript": re.compile(r"@\w"), "javascript": re.compile(r"@\w"), "java": re.compile(r"@(?!interface\b)\w"),
    "rust": re.compile(r"#!?\["), "csharp": re.compile(r"\["), "cpp": re.compile(r"template\s*<|\[\[|__attribute__"), "go": re.compile(r"(?!)"),
}
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|\r?$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)")


def language_for(language: Column, path: Column) -> Column:
    """The language a label names, else the one of the path's extension; null if neither is known."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    ends = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[A-Za-z0-9+]+)$", 1))
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(language))), F.try_element_at(ends, ext))


def _headings(text: str) -> list[int]:
    lines, fence, comment = [], None, False
    for k, line in enumerate(text.split("\n"), 1):
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip():
                fence = None
            continue
        if comment:
            comment = "-->" not in line
            continue
        if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            fence = m.group(1)
        elif line.lstrip().startswith("<!--"):
            comment = "-->" not in line
        elif k > 1 and _HEADING.match(line):
            lines.append(k)
    return lines


def boundaries(text: str, lang: str | None) -> list[int]:
    """The lines (from 1) of a text, other than line 1, at which a natural boundary lies. Unknown languages have none."""
    if lang == "markdown":
        return _headings(text)
    if lang not in _DEFINITION:
        return []
    from siftlode.llm.syntax.lexers import lex

    tokens = lex(text, lang)
    code = np.full(len(text), 1, np.uint8)  # 1 white space, 2 comment, 3 code, 4 inside a string, 5 directive
    for spans, mark in ((tokens.comments, 2), (tokens.directives, 5)):
        for a, b in spans:
            code[a:b] = mark
    for kind, a, b in zip(tokens.kinds, tokens.starts, tokens.ends):
        if kind in ("STR", "TS", "TE", "ERR"):
            code[a:b] = 4
            code[a : a + 1] = 3
        elif b > a:
            code[a:b] = 3
    definition, decorator = _DEFINITION[lang], _DECORATOR[lang]
    masked = _masked(text, code)
    found, pending, open_, at = [], None, 0, 0
    for k, line in enumerate(text.split("\n"), 1):
        here = code[at : at + len(line)]
        first = len(line) - len(line.lstrip())
        blank = first >= len(line.rstrip("\r"))
        margin = here[0] if len(here) else 0
        if open_ > 0:  # inside a decorator that goes on
            open_ += _balance(masked[at : at + len(line)])
        elif blank:
            if not _comment_goes_on(tokens.comments, at):
                pending = None
        elif margin == 3 and not line[0].isspace() and definition.match(masked, at):
            found.append(pending or k)
            pending = None
        elif here[first] == 2 and not (here == 3).any():
            pending = pending or k
        elif margin == 3 and decorator.match(line):
            pending = pending or k
            open_ = max(0, _balance(masked[at : at + len(line)]))
        elif margin == 3 and lang == "cpp" and not line.rstrip().endswith((";", "}", "{", ":", ")")) and re.match(r"[\w:<>,*&\s]+$", line.strip()):
            pending = pending or k if definition.match(masked, at) else None
        else:
            pending = None
        at += len(line) + 1
    return sorted({k for k in found if k > 1})


def _comment_goes_on(spans: list[tuple[int, int]], at: int) -> bool:
    i = bisect.bisect_right(spans, (at, 1 << 60)) - 1
    return i >= 0 and spans[i][0] < at < spans[i][1]


def _masked(text: str, code: np.ndarray) -> str:
    """The text with strings, comments and directives blanked; line ends stay."""
    if not len(text):
        return text
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[((code == 2) | (code == 4) | (code == 5)) & (chars != 10)] = 32
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


def _balance(line: str) -> int:
    return sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")


_RANK = {"definition": 4, "paragraph": 3, "line": 2, "word": 1}


def _filled(pos: np.ndarray, rank: np.ndarray, more: np.ndarray, level: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """With the places ``more``, of rank ``level``, wherever two neighbours lie ``gap`` or more apart."""
    wide = np.flatnonzero(np.diff(pos) >= gap)
    if not len(wide):
        return pos, rank
    inside = np.zeros(len(more), bool)
    for k in wide:
        inside[np.searchsorted(more, pos[k], "right") : np.searchsorted(more, pos[k + 1])] = True
    both = np.concatenate([pos, more[inside]])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([rank, np.full(inside.sum(), level, np.int8)])[order]


def places(text: str, lang: str | None, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions where a piece may begin, how natural each is, and the line of each that is a definition, else 0.

    0 and the end are among them.
    """
    n = len(text)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.flatnonzero(chars == 10) + 1])
    size = np.diff(np.append(start, n + 1)) - 1
    rank = np.full(len(start), _RANK["line"], np.int8)
    empty = np.array([not text[a : a + s].strip() for a, s in zip(start, size)], bool)
    rank[1:][empty[:-1]] = _RANK["paragraph"]
    line = np.zeros(len(start), np.int64)
    for k in boundaries(text, lang):
        rank[k - 1], line[k - 1] = _RANK["definition"], k
    rank[0] = _RANK["definition"]
    if start[-1] < n:
        start, rank, line = np.append(start, n), np.append(rank, np.int8(_RANK["definition"])), np.append(line, 0)
    else:
        rank[-1] = _RANK["definition"]
    of_line = dict(zip(start[line > 0].tolist(), line[line > 0].tolist()))
    gap = max(1, limit - overlap)
    pos, rank = _filled(start, rank, np.flatnonzero((chars == 32) | (chars == 9)) + 1, _RANK["word"], gap)
    pos, rank = _filled(pos, rank, np.arange(1, n), 0, gap)
    return pos, rank, np.array([of_line.get(p, 0) for p in pos.tolist()], np.int64)


def successors(pos: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For every place, the index of the farthest legal start of the next piece: the last of the highest rank in the window.

    A piece holds the ``overlap`` characters before it and must not exceed ``limit``.
    """
    n, at = len(pos) - 1, np.arange(len(pos))
    reach = np.searchsorted(pos, np.minimum(pos + limit - np.minimum(pos, overlap), pos[-1]), "right") - 1
    best = reach
    for level in (1, 2, 3, 4):
        last = np.maximum.accumulate(np.where(rank >= level, at, -1))[reach]
        best = np.where(last > at, last, best)
    return np.where(reach == n, n, best)


def greedy_cuts(succ: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All positions reached from ``start`` along ``succ``, by pointer doubling."""
    reached = np.zeros(len(succ), bool)
    reached[start] = True
    while True:
        grown = reached.copy()
        grown[succ[np.flatnonzero(reached)]] = True
        succ = succ[succ]
        if (grown == reached).all() and (succ == succ[succ]).all():
            return np.flatnonzero(grown)
        reached = grown


def _cut_up(texts: list[str], langs: list, limit: int, overlap: int):
    """Of each text its places, ranks, lines, successors and which places are greedy cuts; the tables are squared together."""
    tables, base = [], 0
    for text, lang in zip(texts, langs):
        if len(text) <= limit:
            pos, rank, line = np.array([0, len(text)]), np.full(2, _RANK["definition"], np.int8), np.zeros(2, np.int64)
            succ = np.ones(2, np.int64)
        else:
            pos, rank, line = places(text, lang, limit, overlap)
            succ = successors(pos, rank, limit, overlap)
        tables.append((pos, rank, line, succ, base))
        base += len(pos)
    if not tables:
        return
    reached = np.zeros(base, bool)
    reached[greedy_cuts(np.concatenate([t[3] + t[4] for t in tables]), np.array([t[4] for t in tables]))] = True
    for pos, rank, line, succ, first in tables:
        yield pos, rank, line, succ, reached[first : first + len(pos)]


def boundary_table(chunks: DataFrame, limit: int = 2500, overlap: int = 300, id_col: str = "chunk_id", content_col: str = "content", language_col: str = "language", path_col: str = "file_path") -> DataFrame:
    """(id, line_no, position, next, cut): the natural boundaries of every chunk of more than ``limit`` code points.

    ``next`` is where the piece that begins there ends at the latest legal boundary, ``cut`` whether the greedy pieces
    of the whole chunk begin there. Null, empty and shorter chunks have none; repeated rows count once; a null or
    unknown language is taken from the path's extension. Only the named columns are read.
    """
    kind = dict(chunks.dtypes)[id_col]
    base = chunks.select(F.col(id_col).alias("id"), language_for(F.col(language_col), F.col(path_col)).alias("lang"), F.col(content_col).alias("text")).where(F.length("text") > limit)

    def run(batches):
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, (pos, rank, line, succ, is_cut) in enumerate(_cut_up(batch.column(2).to_pylist(), batch.column(1).to_pylist(), limit, overlap)):
                own = np.flatnonzero(line > 0)
                rows += [i] * len(own)
                for col, values in zip(cols, (line[own], pos[own], pos[succ[own]], is_cut[own])):
                    col.extend(values.tolist())
            types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "line_no", "position", "next", "cut"])

    return spread(base).mapInArrow(run, f"id {kind}, line_no long, position int, next int, cut boolean").distinct().withColumnRenamed("id", id_col)


def find_boundaries(chunks: DataFrame, limit: int = 2500, id_col: str = "chunk_id", **how) -> DataFrame:
    """(id, line_no) of ``boundary_table``."""
    return boundary_table(chunks, limit, id_col=id_col, **how).select(id_col, "line_no").distinct()


def split_chunks(chunks: DataFrame, limit: int = 2500, overlap: int = 300, id_col: str = "chunk_id", content_col: str = "content", language_col: str = "language", path_col: str = "file_path", line_col: str = "start_line") -> DataFrame:
    """(id, piece, content, start_line, end_line, own_from): pieces of at most ``limit`` code points of every chunk.

    Each piece but the first repeats the ``overlap`` characters before it; ``own_from`` is how many. Line ranges count
    from the chunk's start_line; where that is null or 0 they count from 1 within the chunk. A chunk within the limit
    is one piece; a null content gives none, an empty one a single empty piece; repeated rows count once.
    """
    kind = dict(chunks.dtypes)[id_col]
    base = chunks.select(F.col(id_col).alias("id"), language_for(F.col(language_col), F.col(path_col)).alias("lang"), F.col(content_col).alias("text"), F.col(line_col).cast("long").alias("line")).where("text is not null").distinct()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows, piece, content, lo, hi, own = [], [], [], [], [], []
            for i, (pos, _, _, _, is_cut) in enumerate(_cut_up(texts, batch.column(1).to_pylist(), limit, overlap)):
                text, begin = texts[i], batch.column(3)[i].as_py() or 1
                at = pos[is_cut].tolist() if text else [0, 0]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    lead = min(a, overlap) if k else 0
                    rows.append(i)
                    piece.append(k)
                    content.append(text[a - lead : b])
                    line = begin + text.count("\n", 0, a - lead)
                    lo.append(line)
                    hi.append(line + text.count("\n", a - lead, max(b - 1, a - lead)))
                    own.append(lead)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(content, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(own, pa.int32())],
                ["id", "piece", "content", "start_line", "end_line", "own_from"],
            )

    return base.mapInArrow(run, f"id {kind}, piece int, content string, start_line long, end_line long, own_from int").withColumnRenamed("id", id_col)
