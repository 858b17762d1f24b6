"""Generated, minified, vendored and data files.

Method: belief propagation over directory trees. Every file and directory is a node with one of five labels. A file's
evidence comes from its path and from all of its chunks; a directory's from its name. A directory and its children
favour the same label, so evidence also flows between parents and siblings. Trees have no cycles, so one pass up and
one pass down give exact beliefs.

Plan: chunks are reduced to a few counts in one map, grouped by file with partial sums; no content is shuffled. The
passes go level by level, a grouped sum of messages up and a join by parent down, on rows of a few numbers. A folder
with many files is summed with partial aggregation, never held.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.runtime import cut, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

_COMMENT = r"^[ \t]*(?://+!?|#+|\*|/\*+!?|--|;|<!--|\"\"\"|@?rem)[ \t]*"
_GENERATED = re.compile(
    rf"(?im){_COMMENT}(?:code generated\b.*|this (?:file|code|module|class) (?:was|is|has been) (?:automatically |auto-?)?generated\b.*|(?:this is an? )?auto-?generated (?:file|code|from|by)\b.*|@generated\b.*|autogenerated\b.*|do not (?:edit|modify)\b[ :,.-].*(?:built|generated|made|produced).*|generated (?:file|by|from|code --|automatically)\b(?! ?calls).*|<auto-?generated>.*|generated file --.*|.*\bchanges will be lost\b.*|(?:machine|tool)[ -](?:written|generated|made) by\b.*|(?:produced|written|emitted|created) by (?:the )?\S+.*(?:\bregenerate\b|\bdo not (?:edit|modify)\b|\bfrom\b \S+\.\w+|\bv\d+ on \d{{4}}-).*|.*\bregenerate with\b.*|output of \S+.*\bdo not\b.*)$"
)
_VENDORED = re.compile(
    rf"(?im){_COMMENT}(?:upstream:[ \t]*https?://.*|@license[ \t]+\S+|released under the \S+ licen[sc]e.*|imported from \S+ at (?:revision|commit|version|tag)\b.*|this is a (?:verbatim )?copy of \S+ \(.*|\S+ v?\d+\.\d+[\d.]* -- \(c\) \d{{4}}.*contributors.*|spdx-filecopyrighttext:[ \t]*\d{{4}}.*foundation|part of the \S+ (?:distribution|library|package)\b.*|vendored from\b.*)$"
)
_OWN = re.compile(rf"(?im){_COMMENT}copyright \d{{4}} the project authors")
#: A literal, and a name, in the shape of a line.
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|\b(?:0x[0-9a-fA-F]+|\d[\d_.]*)\b")
_WORD = re.compile(r"[^\W\d]\w*")
#: Strings and notes to leave out of a line, by the quotes that are still closed somewhere after.
_QUOTED = {
    kinds: re.compile("|".join([rf"{q}(?:[^{q}\\\n]|\\.)*+(?:{q}|(?P<open{k}>\\?\Z))" for k, q in enumerate(kinds)] + [r"`[^`\n]*`|//[^\n]*|#(?=[ \t])[^\n]*"]))
    for kinds in ("\"'", '"', "'", "")
}
#: Tokens of data, each split as far as it goes (1024 is four, as a backtracking pattern would have it), so that one way to read a line is left.
_NUMBER = r"(?>0x(?:[0-9a-fA-F]*[a-dfA-DF]|[0-9a-fA-F])[eE]*|-?\d[.eE+-]*)"
_DATA_LINE = re.compile(
    rf"""^[ \t]*+(?:(?:(?:{_NUMBER}|"[^"\n]*+"|'[^'\n]*+'|[{{}}\[\]():]|null|true|false|None|True|False)[ \t]*+,?+[ \t]*+)++|["']?[A-Za-z0-9+/=]{{40,}}["']?[,;+\\]?[ \t]*)\r?$"""
)
_DATA_EDGE = re.compile(r"""^[ \t]*(?:(?:(?:export|public|static|final|const|constexpr|unsigned|char|var|let|default|readonly|private)[ \t]+)*[\w.$]+(?:\[\d*\])?(?:[ \t]*:[ \t]*[\w\[\]<>]+)?[ \t]*:?=[ \t]*(?:new[ \t]+\w+[ \t]*\(|bytes(?:array)?\(|[\w.]+\(|&)?[ \t]*[\[({]*[ \t]*|(?:export default|module\.exports[ \t]*=)[ \t]*[\[{(]+[ \t]*|[\])}]+;?,?[ \t]*)\r?$""")
_DATA_WHOLE = re.compile(
    rf"""^[ \t]*+(?:(?:export|public|static|final|const|var|let|readonly)[ \t]+)*[\w.$]+(?:[ \t]*:[ \t]*[\w\[\]<>]+)?[ \t]*:?=[ \t]*+(?:[\w.]++\()?+[ \t]*+(?:["'`][A-Za-z0-9+/=\\x]{{120,}}["'`]|[\[({{][ \t]*+(?:(?:{_NUMBER}|"[^"\n]*+")[ \t]*+,?+[ \t]*+){{12,}}+[\])}}]*)\)?;?[ \t]*\r?$"""
)
_BLANK_OR_NOTE = re.compile(r"^[ \t]*(?:(?://|#|/?\*)[^\n]*)?\r?$")

_GEN_NAME = r"(?i)(?:\.generated\.\w+|\.g\.\w+|_pb2(?:_grpc)?\.py|\.pb\.\w+|\.designer\.\w+|[._-]autogen\.\w+)$"
_GEN_HINT = r"(?i)(?:_gen|_stub|-gen)\.\w+$"
_MIN_NAME = r"(?i)(?:[.-]min\.\w+|\.bundle\.\w+|\.chunk\.js)$"
_TEXT_EXT = r"(?i)\.(?:md|markdown|rst|txt|ya?ml|toml|json|env|properties|ini|cfg|conf|lock)$"
#: Folders that hold copies of other people's packages, one folder a package.
_VENDOR_DIR = r"(?:^|/)(?:3rdparty|3rd_party|third_party|third-party|thirdparty|_vendor|vendor|bower_components|extern|externals?|deps|node_modules|Godeps|site-packages|Pods|jspm_packages)/(?:@?[^/]+/)+"
_GEN_DIR = r"(?:^|/)(?:gen|generated|__generated__|autogen|src-gen)/"
_OUT_DIR = r"(?:^|/)(?:dist|build|out|bundles?)/"

COUNTS = ("chars", "lines", "long", "data", "code", "tables", "gen_head", "vend_head", "own_head")


def _bare(line: str) -> int:
    """Characters of a line outside strings and notes. A quote that nothing closes is one of them; each kind is sought once."""
    at = bare = 0
    kinds = "\"'"
    while True:
        for m in _QUOTED[kinds].finditer(line, at):
            bare += m.start() - at
            at = m.end()
            if m.lastgroup:
                bare, at = bare + 1, m.start() + 1
                kinds = kinds.replace(line[m.start()], "")
                break
        else:
            return bare + len(line) - at


def _uniform(lines: list[str]) -> int:
    """How many lines share the most frequent shape among those of three literals or more, as rows written by a program do.

    A shape is a line with its literals and names replaced, so it tells neither language nor wording.
    """
    shapes = Counter(_WORD.sub("n", _LITERAL.sub("0", x)) for x in lines if len(x) <= 400 and (x.count(",") >= 2 or x.count(" ") >= 4) and len(_LITERAL.findall(x)) >= 3)
    return max(shapes.values(), default=0)


def chunk_counts(text: str) -> tuple[int, ...]:
    """The counts of one chunk, in the order of ``COUNTS``; long, data and code count characters."""
    lines = text.split("\n")
    long = data = code = used = 0
    for line in lines:
        n = len(line)
        if _BLANK_OR_NOTE.match(line):
            continue
        used += 1
        if n > 220:
            if _DATA_WHOLE.match(line) or _DATA_LINE.match(line):
                data += n
                continue
            if _bare(line) / n > 0.5 and line.count(" ") < n / 6:
                long += n
                continue
            code += n
        elif _DATA_LINE.match(line) or _DATA_WHOLE.match(line):
            data += n
        elif not _DATA_EDGE.match(line):
            code += n
    return (
        len(text), used, long, data, code, _uniform([x for x in lines if "=" in x]),
        int(bool(_GENERATED.search(text))), int(bool(_VENDORED.search(text))), int(bool(_OWN.search(text))),
    )


def _count(batches):
    for batch in batches:
        rows = [chunk_counts(t) if t else (0,) * len(COUNTS) for t in batch.column(2).to_pylist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["project", "path", *COUNTS])


def file_evidence(chunks: DataFrame, project_col: str = "project", path_col: str = "relative_path", content_col: str = "content") -> DataFrame:
    """(project, path, u0..u4): the log-evidence of every file for each label, from its path and all of its chunks."""
    base = chunks.select(F.col(project_col).alias("project"), F.col(path_col).alias("path"), F.col(content_col).alias("text")).where("project is not null and path is not null")
    schema = "project string, path string, " + ", ".join(f"{c} long" for c in COUNTS)
    sums = spread(base).mapInArrow(_count, schema).groupBy("project", "path").agg(*[F.sum(c).alias(c) for c in COUNTS])
    c, p = F.col, F.col("path")
    body = F.greatest(c("long") + c("data") + c("code"), F.lit(1))
    source = ~p.rlike(_TEXT_EXT)
    hit = lambda cond, w: F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
    tables = c("tables") / F.greatest(c("lines"), F.lit(1))
    vendor = p.rlike(_VENDOR_DIR)
    generated = hit(c("gen_head") > 0, 9) + hit(tables > 0.6, 9) + hit(p.rlike(_GEN_NAME), 7) + hit(p.rlike(_GEN_HINT), 1) + hit(p.rlike(_GEN_DIR) & source, 1)
    minified = hit(source & (c("long") / body > 0.7), 9) + hit(p.rlike(_MIN_NAME), 6) + hit(p.rlike(_OUT_DIR) & source, 1)
    vendored = hit((c("vend_head") > 0) & source, 9) + hit(vendor, 8)
    blob = hit(source & (tables <= 0.6) & (c("data") > 0) & (c("code") / body < 0.04) & (c("long") / body < 0.3), 9)
    hand = F.lit(2.0) + hit((c("own_head") > 0) & (c("gen_head") == 0), 3) + hit(~source, 4) + hit(source & (c("code") / body > 0.5) & (c("lines") > 3), 2)
    return sums.select("project", "path", *[x.cast("double").alias(f"u{k}") for k, x in enumerate((hand, generated, minified, vendored, blob))])


def _directory_evidence() -> list[Column]:
    """Evidence from a directory's own path."""
    p = F.concat(F.col("path"), F.lit("/"))
    vendor = F.when(p.rlike(_VENDOR_DIR), 6.0).otherwise(0.0)
    gen = F.when(p.rlike(_GEN_DIR), 2.0).otherwise(0.0)
    out = F.when(p.rlike(_OUT_DIR), 1.0).otherwise(0.0)
    return [F.lit(1.0), gen, out, vendor, F.lit(0.0)]


def _message(values: list[Column], coupling: float) -> list[Column]:
    """What a node with these beliefs says to a neighbour: the log-sum over its labels, with weight on the same one."""
    top = F.greatest(*values)
    shifted = [v - top for v in values]
    total = sum((F.exp(s) for s in shifted[1:]), F.exp(shifted[0]))
    gain = F.lit(pow(2.718281828459045, coupling) - 1.0)
    return [F.log(total + gain * F.exp(s)) for s in shifted]


def propagate(evidence: DataFrame, coupling: float = 1.5) -> DataFrame:
    """(project, path, b0..b4): beliefs of files after one pass up and one pass down the directory trees."""
    labels = range(len(LABELS))
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path") == "", F.lit(None)).otherwise(F.lit("")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    files = cut(evidence.withColumn("depth", depth).withColumn("is_file", F.lit(True)), "evidence", by="depth")  # a level reads its own files only
    deepest = files.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    above: DataFrame | None = None
    for d in range(deepest, -1, -1):
        level = files.where(F.col("depth") == d).select("project", "path", "is_file", *[f"u{k}" for k in labels])
        if above is not None:
            made = above.groupBy("project", F.col("parent").alias("path")).agg(*[F.sum(f"m{k}").alias(f"s{k}") for k in labels])
            dirs = made.select("project", "path", F.lit(False).alias("is_file"), *[(F.col(f"s{k}") + e).alias(f"u{k}") for k, e in zip(labels, _directory_evidence())])
            level = level.unionByName(dirs)
        said = _message([F.col(f"u{k}") for k in labels], coupling)
        level = level.select("project", "path", parent.alias("parent"), "is_file", *[f"u{k}" for k in labels], *[m.alias(f"m{k}") for k, m in enumerate(said)])
        above = levels[d] = cut(level, f"level{d}")
    total = levels[0].select("project", "path", "is_file", *[F.col(f"u{k}").alias(f"b{k}") for k in labels])
    beliefs = total.where("is_file")
    for d in range(1, deepest + 1):
        folders = total.where(~F.col("is_file")).select("project", F.col("path").alias("parent"), *[F.col(f"b{k}").alias(f"t{k}") for k in labels])
        joined = levels[d].join(folders, ["project", "parent"], "left")
        heard = _message([F.coalesce(F.col(f"t{k}"), F.lit(0.0)) - F.col(f"m{k}") for k in labels], coupling)
        total = joined.select("project", "path", "is_file", *[(F.col(f"u{k}") + h).alias(f"b{k}") for k, h in enumerate(heard)])
        total = cut(total, f"beliefs{d}")
        beliefs = beliefs.unionByName(total.where("is_file"))
    return beliefs.select("project", "path", *[f"b{k}" for k in labels])


def label_files(chunks: DataFrame, coupling: float = 1.5, project_col: str = "project", path_col: str = "relative_path", content_col: str = "content") -> DataFrame:
    """(project, path, label, confidence) of every file.

    Null and blank contents are no evidence; a file without any is judged by its path. Rows without project or path
    are ignored; repeated rows change nothing but weights; ties go to the first of ``LABELS``. Only the three named
    columns are read.
    """
    beliefs = propagate(file_evidence(chunks.select(project_col, path_col, content_col), project_col, path_col, content_col), coupling)
    values = [F.col(f"b{k}") for k in range(len(LABELS))]
    top = F.greatest(*values)
    label = F.lit(LABELS[0])
    for k in range(len(LABELS) - 1, -1, -1):
        label = F.when(values[k] == top, F.lit(LABELS[k])).otherwise(label)
    weight = sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top))
    return beliefs.select(F.col("project").alias(project_col), F.col("path").alias(path_col), label.alias("label"), (1.0 / weight).alias("confidence"))
