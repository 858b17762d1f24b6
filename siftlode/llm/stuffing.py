"""Keyword-stuffed and link-list pages.

Method: bagged decision trees on content and link features, trained from weak labels, then smoothed by host. Weak
labels come from other evidence than the trees see: whether a text has sentences, function words or code. Where that
is clear a page is labelled; the trees learn from those pages what links, tags and repeated phrases look like, and
judge all pages by these alone. A page's log-odds are shifted by how far its host's mean prediction lies from the mean
of all.

Plan: one map computes the features of every page. At most ``sample`` labelled rows, those with the smallest hash of
their id, come to the driver to fit the trees (a few hundred numbers, sent back with the tasks). Host means are a
grouped sum with partial aggregation over all pages.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.runtime import cut, hashed_sample, spread

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
_MD_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)")
_TAG = re.compile(r"<[^>\n]{1,300}>")
_HASHTAG = re.compile(r"(?<!\S)#\w[\w-]*")
_PRODUCT = re.compile(r"^\W*[A-Za-z]{2,8}[-_ #]?\d{3,}\s*[~|/,;:]\s*\S.*[~|/,;:]")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[,;|!?\n•·*/~]|\s[-–—]\s|\.\s|>>|<<|\s{2,}")
_CODE = re.compile(r"[{}]\s*$|[=().\[\]\"'][^\n]*;\s*$|^\s*(?:def|class|import|from|return|func|fn|pub|const|let|var|if|for|while|package|use|using|@\w+|#include|at )\b|=>|\)\s*:\s*$|\(\)")
_ENDED = re.compile(r"[.!?:。！？…]['\"`)\]]*\s*$")
#: Common function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    "the a an is are was were be been of to and or in on that this these those it its with from by as at not no but if when which who will would should can could may do does did has have had than then there their they we you our your how why what while because before after until only each every any into over under so such also "
    "der die das den dem des ein eine einer eines einem und oder nicht ist sind war wird werden von mit für auf aus bei nach zu zum zur im in am an als auch aber wenn wie dass sich es er sie wir keine kein über unter jetzt sobald danach sonst "
    "le la les un une des du de et ou est sont ne pas que qui dans sur pour par avec sans ce cette il elle nous vous mais si plus dès au aux puis alors d l s n qu sinon abord "
    "el los las una unos unas y o es son no que en para por con sin su se lo como más pero cuando porque del al este esta muy hasta luego todavía qué".split()
)
#: What the trees see, and what weak labels are made of.
FEATURES = ("link", "tag", "phrase", "urls", "variety", "hot", "repeated_lines", "size")
EVIDENCE = ("function", "ended", "code")


def _words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def page_features(text: str) -> tuple[float, ...]:
    """The values of one text, in the order of ``FEATURES`` and ``EVIDENCE``; shares are of its characters or words."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if not lines:
        return (0.0,) * (len(FEATURES) + len(EVIDENCE))
    total = sum(map(len, lines))
    words: list[str] = []
    link = tag = phrase = ended = code = repeated = urls = functions = 0
    open_lines = []
    for x in lines:
        n = len(x)
        linked = "://" in x or "www." in x
        rest = x
        if linked:
            found = _URL.findall(x)
            urls += sum(map(len, found))
            rest = _MD_LINK.sub(" ", rest)
        if "<" in x:
            rest = _TAG.sub(" ", rest)
        if linked:
            rest = _URL.sub(" ", rest)
        own = _WORD.findall(rest.lower())
        function = sum(w in FUNCTION_WORDS for w in own)
        words += own
        functions += function
        scripted = any(w[0] >= "\u3000" and len(w) >= 4 for w in own)
        if linked and not scripted and (len(own) <= 8 and len(rest.strip()) < 0.55 * n or len(found) >= 4 and len(own) <= 6 * len(found)):
            link += n
            continue
        if len(own) >= 20 and len(set(own)) < 0.3 * len(own):
            phrase += n
            continue
        prose = len(own) >= 4 and function >= max(1, 0.13 * len(own)) or scripted
        if "#" in x and sum(len(m) + 1 for m in _HASHTAG.findall(x)) > 0.6 * n or not prose and _PRODUCT.match(x):
            tag += n
        elif prose and _ENDED.search(x):
            ended += n
        elif len(own) <= 6 or not prose:
            open_lines.append((x, rest, own, prose))
    counts = Counter(words)
    if open_lines:
        seen = Counter(x.lower() for x in lines)
        parts = [[tuple(w) for w in (_words(s) for s in _SPLIT.split(rest)) if w] for _, rest, _, _ in open_lines]
        segments = Counter(p for ps in parts for p in ps)
        pairs = Counter(zip(words, words[1:]))
        for (x, _, own, prose), ps in zip(open_lines, parts):
            if _CODE.search(x):
                code += len(x)
            elif seen[x.lower()] >= 3 and len(own) <= 6:
                phrase += len(x)
                repeated += len(x)
            elif own and not prose:
                many = len(own) > 8 or len(lines) > 8
                hot = sum(1 for p in zip(own, own[1:]) if pairs[p] >= 3)
                often = sum(len(p) for p in ps if segments[p] >= 3)
                common = sum(counts[w] >= 3 for w in own)
                listed = len(ps) >= 8 and len(own) <= 4 * len(ps)
                if len(own) > 8 and hot >= 0.35 * (len(own) - 1) or many and often >= 0.5 * len(own) or len(own) > 8 and common >= (0.4 if listed else 0.55) * len(own):
                    phrase += len(x)
    m = max(1, len(words))
    hot = sum(c for w, c in counts.items() if c >= 4 and w not in FUNCTION_WORDS)
    return (link / total, tag / total, phrase / total, urls / total, len(counts) / m, hot / m, repeated / total, float(np.log1p(total)), functions / m, ended / total, code / total)


def weak_label(values: tuple[float, ...]) -> int | None:
    """1 where a text has hardly a sentence, function word or line of code, 0 where it clearly has, None between."""
    function, ended, code = values[len(FEATURES) :]
    if function < 0.1 and ended < 0.15 and code < 0.15:
        return 1
    if ended >= 0.3 or code >= 0.4 or function >= 0.22 and ended >= 0.1:
        return 0
    return None


class BaggedTrees:
    """Bagged binary decision trees on binned features; the prediction is the mean of the leaves' shares."""

    def __init__(self, trees: int = 25, depth: int = 5, bins: int = 32, least: int = 5, seed: int = 3):
        self.trees, self.depth, self.bins, self.least, self.seed = trees, depth, bins, least, seed
        self.forest: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BaggedTrees:
        rng = np.random.default_rng(self.seed)
        self.base = float(y.mean()) if len(y) else 0.0
        self.forest = []
        if len(y) < 2 * self.least or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        mids = [np.unique(np.concatenate([e, [(x[y == 0, k].mean() + x[y == 1, k].mean()) / 2]])) for k, e in enumerate(edges)]
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            self.forest.append(self._grow(x[rows], y[rows], mids, rng))
        return self

    def _grow(self, x, y, edges, rng) -> list[tuple]:
        nodes: list[tuple] = []

        def split(rows, depth) -> int:
            at = len(nodes)
            share = float((y[rows].sum() + self.base) / (len(rows) + 1))
            nodes.append((-1, 0.0, -1, -1, share))
            if depth == self.depth or len(rows) < 2 * self.least or y[rows].min() == y[rows].max():
                return at
            best = (1e-9, -1, 0.0)
            for k in rng.choice(x.shape[1], max(2, int(0.6 * x.shape[1])), replace=False):
                v, t = x[rows, k], edges[k]
                which = np.searchsorted(t, v, side="left")
                n = np.cumsum(np.bincount(which, minlength=len(t) + 1))[:-1]
                s = np.cumsum(np.bincount(which, weights=y[rows], minlength=len(t) + 1))[:-1]
                m, total = len(rows), y[rows].sum()
                ok = (n >= self.least) & (m - n >= self.least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, s**2 / n + (total - s) ** 2 / (m - n) - total**2 / m, -1)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), int(k), float(t[b]))
            if best[1] < 0:
                return at
            left = x[rows, best[1]] <= best[2]
            lo, hi = split(rows[left], depth + 1), split(rows[~left], depth + 1)
            nodes[at] = (best[1], best[2], lo, hi, share)
            return at

        split(np.arange(len(y)), 0)
        return nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.forest:
            return np.full(len(x), self.base)
        total = np.zeros(len(x))
        for nodes in self.forest:
            at = np.zeros(len(x), int)
            feature, value, lo, hi, share = (np.array(c) for c in zip(*nodes))
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= value[at], lo[at], hi[at])
                at = np.where(inner, go, at)
            total += share[at]
        return total / len(self.forest)


def _featurise(batches):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        full = [k for k, t in enumerate(texts) if t.strip()]  # white space of any script is blank
        at = pa.array(full, pa.int64())
        rows = [page_features(texts[k]) for k in full]
        labels = [weak_label(f) for f in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([list(r[: len(FEATURES)]) for r in rows], pa.list_(pa.float64())), pa.array(labels, pa.int32())], ["doc", "host", "features", "weak"])


def score_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", sample: int = 20_000, strength: float = 10.0, shift: float = 0.35) -> DataFrame:
    """(doc, host, page, host_rate, score): the trees' prediction, the host's smoothed mean, and the smoothed score.

    Null, empty and blank texts are left out; repeated rows count once; a null host is one host of its own. ``sample``
    bounds the labelled rows used to fit the trees; features, predictions and host means cover all pages.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S"))
    pages = cut(spread(base).mapInArrow(_featurise, f"doc {kind}, host string, features array<double>, weak int"), "features")
    drawn = hashed_sample(pages.where("weak is not null").select("doc", "features", "weak"), "doc", sample).toPandas()
    x = np.array(drawn["features"].tolist(), float).reshape(-1, len(FEATURES))
    model = BaggedTrees().fit(x, drawn["weak"].to_numpy(float))

    def predict(batches):
        for batch in batches:
            if batch.num_rows:
                f = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.predict(f))], ["doc", "host", "page"])

    scored = pages.select("doc", "host", "features").mapInArrow(predict, f"doc {kind}, host string, page double").distinct()
    overall = scored.agg(F.avg("page")).first()[0] or 0.0
    hosts = scored.groupBy("host").agg(((F.sum("page") + F.lit(strength * overall)) / (F.count("*") + F.lit(strength))).alias("host_rate"))
    odds = lambda c: F.log((c + 1e-3) / (F.lit(1.0) - c + 1e-3))
    moved = odds(F.col("page")) + F.lit(shift) * (odds(F.col("host_rate")) - odds(F.lit(float(overall))))
    return scored.join(hosts, "host").select(F.col("doc").alias(id_col), F.col("host").alias(host_col), "page", "host_rate", moved.alias("score"))


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id) of the stuffed pages: those of positive score."""
    return score_pages(docs, id_col, **how).where("score > 0").select(id_col).distinct()
