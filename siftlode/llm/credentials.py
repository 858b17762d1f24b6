"""Credentials embedded in source code.

Method: literals are indexed corpus-wide. Each text is read for literals in a place that gives a credential away (a
named value, an authorization, a URL or command, a key block, a known token form) and for other strings that look
random. Grouped by value, a literal that many owners (projects) share is a placeholder and is suppressed, unless it is
a key block or has the fixed form of an access token, which says what it is; a rare one that stands in a telling
place, or has a prefix that telling places confirm, is a confirmed secret. Every text is
then read again for all confirmed secrets, whatever place they stand in and whether or not a pattern extracts them
there; an automaton over those that can stand in a text gives all lines and the spans to mask.

Plan: one map over the texts gives short rows of hashes and values. They are grouped by value with partial counts (a
value in a third of all texts is folded before the shuffle). Every confirmed value has a seed, its rarest run of
``SEED`` bytes; a bit table of the seeds' hashes, of at most 8 MB at any size (``bittable``), is broadcast, and a
second map tests every position of every text against it. A text that holds a value holds its seed, so none is lost;
the texts that hold one are put aside with the seeds met, and only these go on: seeds are joined to the values, and
the values to their texts, for the automaton. No list
of secrets is collected or broadcast, and no text is passed more than twice. A text's key is its id and its hash, so
different texts under one id stay apart. Patterns are tried only where an automaton over their first words stops.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm import bittable
from siftlode.llm.textkernel import U64, raw, slices
from siftlode.runtime import cut, spread

#: Bytes of a seed. No value is shorter: ``looks_secret`` and the fixed forms ask for at least as many characters.
SEED = 8

_QUOTED = r"""(?:"[^"\n]*"|'[^'\n]*'|`[^`\n]*`)"""
_VALUE = rf"""(?P<v>{_QUOTED}(?:[ \t]*[+.][ \t]*{_QUOTED})*|[^\s"'`,;&(){{}}\[\]<>|]+)"""
_NAMES = r"passw(?:or)?d|passwd|passphrase|pass|pwd|secret|token|(?:api|license|encryption|private|access|signing|auth|secret|account|storage)[_\-]?key|creds?|credentials?|bearer"
_KEYED = re.compile(rf"""(?i)(?:{_NAMES})["'`]?\]?[ \t]*(?::[ \t]*(?:const[ \t]+)?[A-Za-z][\w<>&:]*[ \t]*(?==))?(?::=|=>|=(?!=)|:(?!:\w))[ \t]*{_VALUE}""")
_PARAM = re.compile(r"""(?i)[?&;](?:key|sig|signature|code|auth)=(?P<v>[^\s"'`&;]+)""")
_URL_AT = re.compile(r"""(?<=[\w+.\-])://[^\s/:@"'`]*:(?P<v>[^\s/@"'`]+)@""")
_URL = re.compile(r"""[A-Za-z][\w+.\-]*://[^\s/:@"'`]*:(?P<v>[^\s/@"'`]+)@""")
_AUTH = re.compile(r"""(?i)(?:authorization["'`]?\]?[ \t]*[:=][ \t]*["'`]?(?:bearer|basic|token|digest|apikey)?|\b(?:bearer|basic))[ \t]+(?P<v>[A-Za-z0-9+/=_\-.~]{10,})""")
_CALL = re.compile(r"""(?i)(?:login|connect|auth|\b(?:authenticate|sign_?in))[ \t]*\([ \t]*["'`][^"'`\n]*["'`][ \t]*,[ \t]*(?P<v>"[^"\n]*"|'[^'\n]*')""")
_PROSE = re.compile(r"(?i)\b(?:password|passwd|passphrase|pass|pwd|token|secret|key|\w*(?:_key|_token|_secret|_pass|password|apikey))`?[ \t]*(?:is|to|=|:|as)?[ \t]*`(?P<v>[^`\s]+)`")
_NOTE = re.compile(r"(?i)(?:#|//|--|/\*|^[ \t]*\*|<!--)[^\n]{0,60}?\b(?:login|pass|key|password|token|secret|pwd|cred|creds)[ \t]*[:=][ \t]*(?P<v>[^\s\"'`]+)", re.M)
_FLAG = re.compile(r"""(?i)(?<!\S)(?:-u|--user)[ \t=]+[^\s:"'`]+:(?P<v>[^\s"'`]+)""")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Public forms of access tokens.
_FORMS = re.compile(
    r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w\-]{16,}|xox[abeprs]-[\w\-]{10,}|sk_live_\w{14,}|rk_live_\w{14,}|npm_[A-Za-z0-9]{16,}|AIza[\w\-]{30,}|hf_[A-Za-z0-9]{20,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})(?![A-Za-z0-9])"
)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_\-])(?P<p>[a-z]{2,8}(?:[-_][a-z]{2,8}){0,2}[-_])(?P<t>[A-Za-z0-9]{16,})(?![A-Za-z0-9])")
_LOOSE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]{0,30}\d)[A-Za-z0-9+/_\-]{16,}+={0,2}+(?![A-Za-z0-9+/_\-])")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.•#\-_?0]{3,}|.*\*{3,}.*|<[^>]*>|\[[^\]]*\]|\$\{?.*|\$\(.*|\{\{.*|\{.*\}|%.*|@.*|.*(?:change[_-]?me|replace[_-]?me|your[_-]|_here\b|placeholder|redacted|example|dummy|sample[_-]?key|not[_-]?a[_-]?real|insert[_-]).*|none|null|nil|true|false|undefined|sha(?:1|256|384|512)[-:].*)$"
)
_PHRASE = re.compile(r"^[A-Z]?[a-z]+(?:[#$!@%^&*~+][0-9]{2,}|[_\-.][0-9]{2,}(?:[!#$@%^&*~+]|Q|x|zz?)|[0-9]{2,}[!#$@%^&*~+])\S{0,4}$")
_HEX = re.compile(r"^[0-9a-f]+$|^[0-9A-F]+$")
_TURNS = re.compile(r"[A-Z](?=[a-z0-9])|[a-z](?=[A-Z0-9])|[0-9](?=[A-Za-z])")


def plain(value: str) -> str:
    """A literal without its quotes, parts of a sum put together."""
    if value[:1] in "\"'`":
        return "".join(p[1:-1] for p in re.findall(_QUOTED, value))
    return value


def looks_secret(v: str) -> bool:
    """Whether a literal can be a live credential: random-looking or of password form, no placeholder and no plain words.

    It has at least 8 characters and no blank; there is no upper bound, so one-line keystores count.
    """
    if len(v) < 8 or " " in v or _PLACEHOLDER.match(v):
        return False
    if _PHRASE.match(v):
        return True
    digits = sum(c.isdigit() for c in v)
    letters = sum(c.isalpha() for c in v)
    if _HEX.match(v):
        return len(v) >= 16 and digits > 0 and letters > 0
    if not letters or "://" in v or v.count("/") > 1 and not digits:
        return False
    turns = len(_TURNS.findall(v))
    special = any(c in "!#$@%^&*~+=" for c in v)
    lower, upper = any(c.islower() for c in v), any(c.isupper() for c in v)
    if digits:
        return turns >= 3 and (special or lower and upper or len(v) >= 16) or special and lower and upper
    return len(v) >= 10 and lower and upper and turns >= max(4, len(v) // 3) and not re.fullmatch(r"(?:[A-Z]?+[a-z]{2,}+)++", v)


def _hash(v: str) -> int:
    return xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)


#: What the names of ``_NAMES`` and the calls of ``_CALL`` begin with.
_NAME_STARTS = ("pass", "pwd", "secret", "token", "api", "license", "encryption", "private", "access", "signing", "auth", "account", "storage", "cred", "bearer")
_CALL_STARTS = ("login", "connect", "auth", "sign")
_NOTE_WORDS = ("login", "pass", "key", "token", "secret", "pwd", "cred")
_FORM_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk_live_", "rk_live_", "npm_", "AIza", "hf_", "SG.", "eyJ")


@functools.cache
def _starts():
    """An automaton that tells where a name (1), a call (2) or both (3) may begin, and which words a note may hold (4)."""
    import ahocorasick

    machine, kinds = ahocorasick.Automaton(), {}
    for words, kind in ((_NAME_STARTS, 1), (_CALL_STARTS, 2), (_NOTE_WORDS, 4)):
        for w in words:
            kinds[w] = kinds.get(w, 0) | kind
    for w, kind in kinds.items():
        machine.add_word(w, (len(w), kind))
    machine.make_automaton()
    return machine


def _lowered(text: str) -> str:
    """The text in lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _told(text: str):
    """(pattern, match) of the telling places of a text, pattern by pattern."""
    low = _lowered(text)
    names, calls, noted = [], [], False
    for end, (size, kind) in _starts().iter(low):
        if kind & 1:
            names.append(end - size + 1)
        if kind & 2:
            calls.append(end - size + 1)
        noted = noted or kind & 4
    for pattern, places in ((_KEYED, names), (_CALL, calls)):
        after = 0
        for at in places:
            if at >= after and (m := pattern.match(text, at)):
                after = m.end()
                yield pattern, m
    if "=" in text:
        yield from ((_PARAM, m) for m in _PARAM.finditer(text))
    if "://" in text and "@" in text:
        yield from ((_URL, m) for m in _URL_AT.finditer(text))
    if "authorization" in low or "bearer" in low or "basic" in low:
        yield from ((_AUTH, m) for m in _AUTH.finditer(text))
    if noted and "`" in text:
        yield from ((_PROSE, m) for m in _PROSE.finditer(text))
    if noted:
        yield from ((_NOTE, m) for m in _NOTE.finditer(text))
    if "-u" in low:
        yield from ((_FLAG, m) for m in _FLAG.finditer(text))


def literals(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, value, place, prefix) of the literals of a text; place is telling, form, block, prefixed or loose."""
    found: dict[tuple[int, int], tuple[str, str, str]] = {}
    for pattern, m in _told(text):
        a, b = m.span("v")
        value = plain(m.group("v"))
        if text[a] in "\"'`":
            a, b = a + 1, b - 1
        elif pattern is not _URL:
            while value and value[-1] in ".:)":
                value, b = value[:-1], b - 1
        if _URL.match(value) or value.startswith("-----BEGIN"):
            continue  # found by its own pattern
        if looks_secret(value):
            p = _PREFIXED.fullmatch(value)
            found.setdefault((a, b), (value, "telling", p.group("p") if p else ""))
    if any(w in text for w in _FORM_STARTS):
        for m in _FORMS.finditer(text):
            if not _PLACEHOLDER.match(m.group()):
                found.setdefault(m.span(), (m.group(), "form", ""))
    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            end = _BLOCK_END.search(text, m.end())
            nxt = _BLOCK.search(text, m.end())
            stop = end.end() if end and (nxt is None or end.end() <= nxt.start()) else m.end()
            found.setdefault((m.start(), stop), (text[m.start() : stop], "block", ""))
    for m in _PREFIXED.finditer(text):
        if len(_TURNS.findall(m.group("t"))) >= 6:
            found.setdefault(m.span(), (m.group(), "prefixed", m.group("p")))
    for m in _LOOSE.finditer(text):
        if len(_TURNS.findall(m.group())) >= 5:
            found.setdefault(m.span(), (m.group(), "loose", ""))
    return [(a, b, *x) for (a, b), x in sorted(found.items())]


_FOUND = "id long, version long, owner string, code long, value string, place string, prefix string, whole string"


def _index(batches):
    for batch in batches:
        rows, code, value, place, prefix, whole = [], [], [], [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            for a, b, v, p, pre in literals(text):
                rows.append(i)
                code.append(_hash(v))
                value.append(None if p == "loose" else v)
                place.append(p)
                prefix.append(pre)
                whole.append(None if text[a:b] == v else text)  # a sum of parts stands nowhere as one run
        at = pa.array(rows, pa.int64())
        cols = [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(code, pa.int64()), pa.array(value, pa.string()), pa.array(place, pa.string()), pa.array(prefix, pa.string()), pa.array(whole, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "version", "owner", "code", "value", "place", "prefix", "whole"])


def confirmed(found: DataFrame, max_owners: int, max_share: float, min_prefix: int) -> DataFrame:
    """(code, value) of confirmed secrets among indexed literals: rare, and in a telling place or of a confirmed form.

    Rare is a value of at most ``max_owners`` owners, or ``max_share`` of all owners where that is more; a fixed form
    or a key block counts however many have it.
    """
    by_value = found.groupBy("code").agg(
        F.max("value").alias("value"),
        F.max(F.col("place").isin("telling", "form", "block")).alias("told"),
        F.max(F.col("place").isin("form", "block")).alias("certain"),
        F.max("prefix").alias("prefix"),
        F.countDistinct("owner").alias("owners"),
    )
    owners = found.agg(F.countDistinct("owner")).first()[0]
    by_value = by_value.where(F.col("value").isNotNull() & (F.col("certain") | (F.col("owners") <= max(max_owners, int(max_share * owners)))))
    prefixes = by_value.where("told and prefix <> ''").groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= min_prefix).select("prefix", F.lit(True).alias("known"))
    return by_value.join(prefixes, "prefix", "left").where("told or known").select("code", "value")


def _windows(batches):
    """(code, seed, odd, at): the distinct runs of ``SEED`` bytes of each value, and how many bytes of a run are no letters."""
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    for batch in batches:
        for code, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = value.encode("utf-8", "surrogatepass")
            seed, at = np.unique(_runs(body), return_index=True)
            other = np.concatenate([[0], np.cumsum(~letter[np.frombuffer(body, np.uint8)])])
            cols = [pa.array(np.full(len(at), code)), pa.array(seed.view(np.int64)), pa.array((other[at + SEED] - other[at]).astype(np.int32)), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["code", "seed", "odd", "at"])


def _runs(body: bytes) -> np.ndarray:
    """The run of ``SEED`` bytes at every position, as a number."""
    return np.ndarray((max(0, len(body) - SEED + 1),), "<u8", body, strides=(1,)) if len(body) >= SEED else np.empty(0, U64)


def _seeds(secret: DataFrame) -> DataFrame:
    """(seed, value): of each value the run that the fewest values share, so that a common head (of a key block, of a
    token) is no join key; then one with many characters that are no letters, so that it is no word."""
    runs = cut(secret.mapInArrow(_windows, "code long, seed long, odd int, at int"), "runs")
    shared = runs.groupBy("seed").agg(F.count("*").alias("n"))
    rarest = runs.join(shared, "seed").groupBy("code").agg(F.min_by("seed", F.struct("n", -F.col("odd"), "at")).alias("seed"))
    return rarest.join(secret, "code").select("seed", "value")


def _meet(shared, bits: int):
    """(id, version, text, seeds): the texts that hold runs of the bit table, with these runs."""

    def go(batches):
        for batch in batches:
            for at, part in slices(batch.column(2)):
                body, off = raw(part)
                runs = _runs(body)
                where = bittable.members(shared.value, runs, bits)
                row = np.searchsorted(off, where, "right") - 1
                inside = where + SEED <= off[row + 1]
                pair = np.unique(np.stack([row[inside], runs[where[inside]].view(np.int64)]), axis=1) if inside.any() else np.empty((2, 0), np.int64)
                own, first = np.unique(pair[0], return_index=True)
                rows = pa.array(own + at)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, pair.shape[1]), pa.int32()), pa.array(pair[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:3]), lists], ["id", "version", "text", "seeds"])

    return go


def everywhere(base: DataFrame, secret: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, version, value): each text with the values whose seed it holds, among them all that it holds; and these texts."""
    seeds = cut(_seeds(secret), "seeds")
    bits = bittable.bits_for(seeds.count())
    shared = base.sparkSession.sparkContext.broadcast(bittable.build(seeds, "seed", bits))
    met = cut(spread(base.select("id", "version", "text")).mapInArrow(_meet(shared, bits), "id long, version long, text string, seeds array<long>"), "met")
    return met.select("id", "version", F.explode("seeds").alias("seed")).join(seeds, "seed").select("id", "version", "value"), met.select("id", "version", "text")


def _spans(text: str, values: list[str]) -> list[tuple[int, int]]:
    """Where any of the values stands in a text: by an automaton over them, and at the literals they were read from."""
    import ahocorasick

    known = set(values)
    spans = {(a, b) for a, b, v, place, _ in literals(text) if v in known}
    machine = ahocorasick.Automaton()
    for v in known:
        machine.add_word(v, len(v))
    machine.make_automaton()
    for end, size in machine.iter(text):
        a, b = end - size + 1, end + 1
        before, after = text[a - 1 : a], text[b : b + 1]
        if not (before.isalnum() and text[a].isalnum() or after.isalnum() and text[b - 1].isalnum()):
            spans.add((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans masked: every letter and digit becomes ``*``, quotes, line ends and signs of sums stay."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        body = text[a:b]
        if '"' in body or "'" in body or "`" in body:
            out.append(re.sub(r"[A-Za-z0-9#$!@%^&*~=/_\-]", "*", body))
        else:
            out.append(re.sub(r"[^\s\\]", "*", body))
        at = b
    return "".join(out) + text[at:]


def _scan(batches):
    """(id, version, text, values) -> (id, version, lines, masked) of the texts that hold one of their values."""
    for batch in batches:
        rows, lines, masked = [], [], []
        for i, (text, values) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            spans = _spans(text, values)
            if spans:
                rows.append(i)
                lines.append(sorted({text.count("\n", 0, a) + 1 for a, _ in spans}))
                masked.append(mask(text, spans))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, pa.list_(pa.int64())), pa.array(masked, pa.string())], ["id", "version", "lines", "masked"])


def _masked(docs: DataFrame, id_col: str, owner_col: str, text_col: str, max_owners: int, max_share: float, min_prefix: int) -> DataFrame:
    """(id, version, lines, masked); version is the hash of the text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), F.coalesce(F.col(owner_col), F.lit("")).alias("owner"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    found = cut(spread(base).mapInArrow(_index, _FOUND), "literals")
    secret = cut(confirmed(found, max_owners, max_share, min_prefix), "confirmed")
    read = found.select("id", "version", "code").distinct().join(secret, "code").select("id", "version", "value")
    held, texts = everywhere(base, secret)
    texts = texts.unionByName(found.where("whole is not null").select("id", "version", F.col("whole").alias("text")))
    hits = cut(read.unionByName(held).groupBy("id", "version").agg(F.collect_set("value").alias("values")), "secrets")
    wanted = texts.join(hits, ["id", "version"]).select("id", "version", "text", "values")
    return wanted.mapInArrow(_scan, "id long, version long, lines array<long>, masked string")


def find_credentials(docs: DataFrame, id_col: str = "vec_id", owner_col: str = "project", text_col: str = "content", max_owners: int = 12, max_share: float = 0.2, min_prefix: int = 3) -> DataFrame:
    """(id, line_no list, masked): every text that holds credentials, the lines where one begins, and the masked text.

    Lines count from 1. Null and empty texts hold none; repeated rows count once, different texts under one id each
    give a row; a null owner is one owner of its own. Texts without credentials give no row (see ``redact``). Ids must
    be integers.
    """
    made = _masked(docs, id_col, owner_col, text_col, max_owners, max_share, min_prefix)
    return made.dropDuplicates(["id", "version"]).select(F.col("id").alias(id_col), "lines", "masked")


def redact(docs: DataFrame, id_col: str = "vec_id", owner_col: str = "project", text_col: str = "content", max_owners: int = 12, max_share: float = 0.2, min_prefix: int = 3) -> DataFrame:
    """All rows of ``docs`` with ``text_col`` masked where it holds credentials; everything else is as it was."""
    made = _masked(docs, id_col, owner_col, text_col, max_owners, max_share, min_prefix).dropDuplicates(["id", "version"])
    masked = made.select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("masked").alias("__masked"))
    joined = docs.join(masked, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__version")), "left")
    return joined.select(*[F.coalesce("__masked", F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
