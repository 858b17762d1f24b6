"""Source files that do not parse.

Method: a packrat parser runs the parsing-expression grammar of the file's language over its tokens and has to take
all of them. A file that fails is reported with the furthest token that could not be taken and a likely cause.

Plan: one map-only pass, no shuffle of contents; flags are made distinct by key, rates are a grouped count.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.syntax.lexers import ALIASES
from siftlode.runtime import spread

_ELEMENT = re.compile(r"/>|</")
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)", re.M)


def language_of(label: Column) -> Column:
    """The language a label names, null if the label is empty or names none that has a grammar."""
    known = {k: v for k, v in ALIASES.items() if v != "markdown"}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(label)))


def check(text: str, lang: str) -> tuple[bool, int, int, str | None]:
    """(valid, line, column, cause) of one text; line and column of the furthest failure, from 1, are 0 if it is valid.

    Empty and comment-only texts are valid. A text that nests deeper than the parser can follow (millions of calls) is
    not valid, with the cause ``too deep``, at the furthest token that was read. A script that is not valid is read again
    with elements of markup, as in its JSX form; it is valid if it is so either way.
    """
    from siftlode.llm.syntax.grammars import grammar
    from siftlode.llm.syntax.lexers import lex
    from siftlode.llm.syntax.peg import TooDeep

    tokens = lex(text, lang)
    if len(tokens.kinds) < 2:
        return True, 0, 0, None
    deep = False
    try:
        at = grammar(lang).parse(tokens)
    except TooDeep as e:
        at, deep = max(e.at, 0), True
    if at >= 0 and not deep and lang in ("javascript", "typescript") and _ELEMENT.search(text):
        try:
            if grammar(lang).parse(lex(text, lang, True)) < 0:
                return True, 0, 0, None
        except TooDeep:
            pass
    if at < 0:
        return True, 0, 0, None
    start = tokens.starts[at]
    line = text.count("\n", 0, start) + 1
    column = start - (text.rfind("\n", 0, start) + 1) + 1
    return False, line, column, "too deep" if deep else _cause(text, tokens, at)


def _cause(text: str, tokens, at: int) -> str:
    marks = _CONFLICT.search(text)
    if marks and abs(text.count("\n", 0, marks.start()) - text.count("\n", 0, tokens.starts[at])) <= 2:
        return "conflict"
    if tokens.kinds[at] == "EOF":
        return "truncated"
    if tokens.kinds[at] == "ERR":
        return "unreadable"
    if at <= 4:
        return "other language"
    return "conflict" if marks else "syntax"


def flag_files(files: DataFrame, keys: tuple[str, ...] = ("project", "rel_path"), language_col: str = "language", content_col: str = "content") -> DataFrame:
    """(keys, language, valid, fail_line, fail_column, cause), one row per key and language with a grammar.

    Rows with a null or empty language, or one without a grammar, are left out; a null content counts as empty, so
    valid. Repeated rows count once; a key whose rows differ is flagged if one of them is. Only the named columns are
    read.
    """
    spark_type = dict(files.dtypes)
    base = files.select(*keys, language_of(F.col(language_col)).alias("lang"), F.coalesce(F.col(content_col), F.lit("")).alias("text")).where("lang is not null")
    schema = ", ".join([f"`{k}` {spark_type[k]}" for k in keys] + ["language string", "valid boolean", "fail_line int", "fail_column int", "cause string"])
    n = len(keys)

    def run(batches):
        seen: dict[tuple[str, str], tuple] = {}
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                got = seen.get((lang, text))
                if got is None:
                    got = check(text, lang)
                    if len(seen) > 2000:
                        seen.clear()
                    seen[lang, text] = got
                found.append(got)
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.bool_(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n), *made], [*keys, "language", "valid", "fail_line", "fail_column", "cause"])

    flags = spread(base).mapInArrow(run, schema)
    first = F.min_by(F.struct("valid", "fail_line", "fail_column", "cause"), "valid")
    return flags.groupBy(*keys, "language").agg(first.alias("f")).select(*keys, "language", "f.*")


def invalid_rates(flags: DataFrame, project_col: str = "project") -> DataFrame:
    """(project, language, files, flagged, share) of flags."""
    flagged = F.sum(F.when(~F.col("valid"), 1).otherwise(0))
    return flags.groupBy(project_col, "language").agg(F.count("*").alias("files"), flagged.alias("flagged"), (flagged / F.count("*")).alias("share"))
