"""Personal data: fixed patterns, plus spans found by gradient-boosted trees.

Four fixed kinds (email, ip, card, phone) come from their patterns and
checks, and always stay.  Generators then propose further, overlapping spans
with high recall: runs of number groups and all their contiguous parts,
addresses written out (``[at]`` or plain ``at`` and ``dot``), long tokens, whole
with their dots and dashes, values of letters and digits after a key word, and IPv6
addresses, which their own check decides.  Boosted trees score each
span by its format and by the characters around it.

The tables carry no span labels, so the trees learn from what the patterns
and their checks say: spans that a fixed kind accepts, the same addresses and
phone numbers written in other ways in their own places (``name [at] mail [dot]
com``, no ``+`` or country), and tokens assigned to a key word such as ``token
=``, are positive.  Number runs and tokens elsewhere are negative; parts of
accepted spans, written-out addresses and number runs that look like a
rewritten phone number carry no label.  The features leave out what decides
those labels (the checksum, the key word).  All labelled spans of all documents
take part: equal spans are counted in Spark, the bins of the features are exact
quantiles, and each level of the trees is one pass over the counted spans whose
histograms are added up.  The spans of a kind and label weigh ``CLASS`` together
at most, so a rare kind is not lost.  Each of ``FOLDS`` further models leaves out
a fold of the spans and scores it; a threshold per kind, calibrated on these
scores of all spans and all their occurrences, selects the spans that are added.
A kind without a threshold (too few positives, or none precise enough) goes by
``rule``.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mountwait.llm.common import give_back
from mountwait.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
CLASS = 2000  # weight of all spans of a kind and label together, at most
FOLDS = 3
SCORED = 10_000  # spans scored at a time
LEAST = 10  # positives of a kind below which its rule holds
PRECISION = 0.95
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32
NODES = 2 ** (DEPTH + 1) - 1
GROUPS = 1 << 16  # groups of equal spans in one block
UNIT = 2.0 ** 30  # gradients are summed in whole units, so that their order does not matter
GRID, TOP = 256, 16  # thresholds lie on margins in steps of 1 / GRID, up to TOP

_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit run that fails fails from each of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[+(]{0,2}[0-9][0-9().\x20/+-]{5,}[0-9]")
_GROUP = re.compile(r"[+(]{0,2}[0-9][0-9().-]*")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+")
_JOINED = re.compile(r"(?<![A-Za-z0-9_.+/-])[A-Za-z0-9_]++(?:[-.+/]{1,2}[A-Za-z0-9_]++)++={0,2}")
_ASSIGNED = re.compile(r"(?:token|key|secret|password|passphrase|passwd|pwd)[\"']?\s?(?:[:=]|is\s)\s?[\"']?(?P<value>[^\s\"',;<>]{6,}+)", re.I)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
# Endings of addresses in plain words: others are too like prose.
_ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "info", "biz", "io", "dev", "eu", "uk", "de", "fr", "nl", "ch")
_SPOKEN_TAIL = re.compile(rf" at (?:[A-Za-z0-9-]++ dot )+?(?:{'|'.join(_ENDINGS)})\b(?! dot )", re.I)
_WRITTEN_AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?", re.I)
_COUNTRY = re.compile(r"\+[0-9]{1,3}(?:[\x20.-]+(?=[0-9(])|(?=\())")
_AREA = re.compile(r"\(0?[0-9]{2,5}\)[\x20.-]?[0-9][0-9\x20.-]{3,}[0-9]")
_CALL = re.compile(r"\b(?:tel|telephone|phone|call|mobile|cell|fax)\b[.:]?\s?(?:at|is|no|number)?[.:]?\s?\Z", re.I)
_KEY = re.compile(r"(?:token|key|secret|password|passphrase|passwd|pwd|api)[\"']?\s?(?:[:=]|is\s)\s?[\"']?\Z", re.I)
_TAIL = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]+)+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at signs."""
    out, past = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > past and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four fixed kinds, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _is_ip6(s: str) -> bool:
    """A valid address of three groups or more, so that times and scope marks are none."""
    if sum(map(bool, s.split(":"))) < 3:
        return False
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def _spoken_start(text: str, end: int) -> int:
    """Start of the words joined by `` dot `` that stand before ``end``."""
    a = end
    while True:
        word = a
        while word and text[word - 1] in _LOCAL_CHARS:
            word -= 1
        if word == a:  # no word before: what was read so far, without a leading dot
            return a if a == end else a + 5
        if text[max(0, word - 5):word].lower() != " dot ":
            return word
        a = word - 5


def proposals(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of high recall; they overlap freely.

    Number runs are cut into groups at spaces; each contiguous part of 7 to 19
    digits is a span.  A group has a digit, so the work is linear in the text.
    """
    out: set[tuple[str, int, int]] = set()
    for m in _NUMBERS.finditer(text):
        groups = []
        for g in _GROUP.finditer(text, m.start(), m.end()):
            own = text[g.start():g.end()].rstrip(".-()")
            groups.append((g.start(), g.start() + len(own), len(_digits(own))))
        for i, (a, _, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                b = groups[j][1]
                n += groups[j][2]
                if n > 19:
                    break
                if n >= 7:
                    kind = "ip" if i == j and text.count(".", a, b) == 3 else "card" if n >= 16 else "phone"
                    out.add((kind, a, b))
    for m in _TOKEN.finditer(text):
        out.add(("secret", m.start(), m.end()))
    for m in _JOINED.finditer(text):
        if m.end() - m.start() >= 20 and _mixed(m[0]):
            out.add(("secret", m.start(), m.end()))
    for m in _ASSIGNED.finditer(text):
        own = m["value"].rstrip(".)]}")
        if len(own) >= 6 and _mixed(own):
            out.add(("secret", m.start("value"), m.start("value") + len(own)))
    if text.count(":") > 1:
        out.update(("ip", m.start(), m.end()) for m in _IP6.finditer(text) if _is_ip6(m[0]))
    for m in _SPOKEN_TAIL.finditer(text):
        a = _spoken_start(text, m.start())
        if a < m.start():
            out.add(("email", a, m.end()))
    for m in _WRITTEN_AT.finditer(text):
        a = m.start()
        while a and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        b = _TAIL.match(text, m.end())
        if a < m.start() and b:
            out.add(("email", a, b.end()))
    return sorted(out)


def _kind_of_char(c: str) -> int:
    if not c:
        return 0
    if c.isalpha():
        return 1
    if "0" <= c <= "9":
        return 2
    if c.isspace():
        return 3
    return 4 + ".,;:!?\"'()[]{}=-+/@<>#$%&*|_".find(c)


def features(text: str, span: tuple[str, int, int]) -> list[int]:
    """Format of the span and the characters around it."""
    kind, a, b = span
    s = text[a:b]
    digits = sum("0" <= c <= "9" for c in s)
    alpha = sum(c.isalpha() for c in s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    around = text[max(0, a - 2):a].rstrip()[-1:], text[b:b + 2].lstrip()[:1]
    return [KINDS.index(kind), len(s), digits, alpha, sum(c.isupper() for c in s), s.count(" "), s.count("-"),
            s.count("."), s.count("("), s.count(")"), s.count("+"), len(groups), groups[0] if groups else 0,
            groups[-1] if groups else 0, max(groups, default=0), len(set(s)),
            int(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), sum(x != y for x, y in zip(map(str.isdigit, s), map(str.isdigit, s[1:]))),
            _kind_of_char(text[a - 1:a]), _kind_of_char(text[b:b + 1]), _kind_of_char(around[0]), _kind_of_char(around[1])]


N_FEATURES = 22


def weak_label(text: str, span: tuple[str, int, int]) -> int:
    """Label of a span that overlaps no base span."""
    kind, a, b = span
    if kind == "secret":
        s = text[a:b]
        return int(_mixed(s) and bool(_KEY.search(text, max(0, a - 24), a)))
    return 0


def rewritten(text: str, span: tuple[str, int, int]) -> list[tuple[str, tuple[str, int, int]]]:
    """(text around, span) of the other forms of a base span in its own place, as far as they are proposed."""
    kind, a, b = span
    s, forms = text[a:b], []
    if kind == "email":
        local, _, domain = s.partition("@")
        forms = [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain.replace('.', ' (dot) ')}",
                 f"{local}[at]{domain}", f"{local.replace('.', ' dot ')} at {domain.replace('.', ' dot ')}"]
    elif kind == "phone":
        forms = [s[1:]]
        if m := _COUNTRY.match(s):
            rest = s[m.end():]
            forms += [rest, "0" + rest] if rest[0].isdigit() else [rest]
    left, right = text[max(0, a - 24):a], text[b:b + 24]
    out = []
    for f in forms:
        whole, own = left + f + right, (kind, len(left), len(left) + len(f))
        if own in proposals(whole):
            out.append((whole, own))
    return out


def shape(s: str) -> str:
    """Format of a number run with separators; empty without."""
    return re.sub("[0-9]", "0", s) if re.search("[^0-9]", s) else ""


def span_key(text: str, span: tuple[str, int, int]) -> int:
    """Hash of a span with its kind and the characters around it."""
    kind, a, b = span
    return xxhash.xxh64_intdigest("\0".join((kind, text[max(0, a - 24):a], text[a:b], text[b:b + 24]))) >> 1


def training_spans(text: str) -> list[tuple[str, tuple[str, int, int], int, tuple[str, int, int]]]:
    """(text, span, label, span of the document that it comes from) of all spans that carry a label."""
    base = base_spans(text)
    out = [(text, s, 1, s) for s in base]
    for s in base:
        out += [(*f, 1, s) for f in rewritten(text, s)]
    taken = sorted((a, b) for _, a, b in base)
    outer = -1  # end of the last secret span that no other one holds
    for s in sorted(proposals(text), key=lambda s: (s[1], -s[2])):
        if sure(text, s):
            continue
        if s[0] == "secret":
            # Parts of a longer secret span carry no label.
            if s[2] <= outer:
                continue
            outer = s[2]
        k = bisect.bisect_left(taken, (s[1], s[1]))
        # Base spans of up to four kinds may overlap, so look back past equal ends.
        if s[0] != "email" and not any(y > s[1] and x < s[2] for x, y in taken[max(0, k - 4):k + 1]):
            out.append((text, s, weak_label(text, s), s))
    return out


def sure(text: str, span: tuple[str, int, int]) -> bool:
    """Spans that their own check decides: valid IPv6 addresses."""
    return span[0] == "ip" and ":" in text[span[1]:span[2]]


def rule(text: str, span: tuple[str, int, int]) -> bool:
    """What is added of a kind that the trees could not learn.

    Mixed tokens assigned to a key word, written-out addresses, and number
    runs of up to 15 digits after a telephone word or with an area code in
    brackets.  For ip and card the patterns are the rule.
    """
    kind, a, b = span
    if kind == "secret":
        return weak_label(text, span) == 1
    if kind == "phone":
        edge = text[a - 1:a] + text[b:b + 1]
        return not any(c.isalnum() for c in edge) and len(_digits(text[a:b])) <= 15 and bool(
            _AREA.fullmatch(text, a, b) or _CALL.search(text, max(0, a - 24), a))
    return kind == "email"


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int = DEPTH) -> np.ndarray:
    """(trees, rows): the node each row of x (features, rows) reaches in each tree."""
    node = np.zeros((len(feature), x.shape[1]), np.int64)
    tree, row = np.arange(len(feature))[:, None], np.arange(x.shape[1])
    for _ in range(levels):
        node = 2 * node + 1 + (x[feature[tree, node], row] > cut[tree, node])
    return node


def margins(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(x.shape[1], bias)
    for v, node in zip(value, leaves(x, feature, cut)):
        out += v[node]
    return out


@dataclass
class Trees:
    """Boosted regression trees over the features (or their bins), as arrays (trees, nodes)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return margins(x.T, self.feature, self.cut, self.value, self.bias)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, y, key, n, fold, x, shape): every distinct labelled span of all documents, and how often it occurs."""
    def run(batches):
        def rows():
            kinds, ys, keys, ns, folds, xs, shapes = zip(*((*k, *v) for k, v in held.items()))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(ys, pa.int32()), pa.array(keys, pa.int64()), pa.array(ns, pa.int64()),
                 pa.array(folds, pa.int32()), pa.array(xs, pa.list_(pa.int32())), pa.array(shapes, pa.string())],
                names=["kind", "y", "key", "n", "fold", "x", "shape"])
        held: dict[tuple[int, int, int], list] = {}
        for b in batches:
            for t in b.column(0):
                t = t.as_py() or ""
                for around, s, y, own in training_spans(t):
                    key = KINDS.index(s[0]), y, span_key(around, s)
                    if key in held:
                        held[key][0] += 1
                        continue
                    # Other forms of a span are in its fold.
                    held[key] = [1, span_key(t, own) % FOLDS, features(around, s), shape(around[s[1]:s[2]]) if s[0] == "phone" else ""]
                    if len(held) >= 5000:
                        yield rows()
        if held:
            yield rows()
        give_back()
    spans = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "kind int, y int, key long, n long, fold int, x array<int>, shape string")
    return spans.groupBy("kind", "y", "key").agg(
        F.sum("n").alias("n"), F.min(F.struct("fold", "x", "shape")).alias("row")).select("kind", "y", "key", "n", "row.*")


def without_known_shapes(spans: DataFrame) -> DataFrame:
    """spans less the negatives in the shape of a phone number, which may be one and carry no label.

    A shape is known if one in CLASS positives or more has it, so that a
    single odd number does not take the label of all dates.
    """
    phones = spans.where((F.col("kind") == KINDS.index("phone")) & (F.col("y") == 1))
    shapes = phones.groupBy("shape").agg(F.count(F.lit(1)).alias("m"))
    known = shapes.crossJoin(F.broadcast(shapes.agg(F.sum("m").alias("all")))).where(
        (F.col("shape") != "") & (F.col("m") * CLASS >= F.col("all"))).select("shape", F.lit(0).alias("y"))
    return spans.join(F.broadcast(known), ["shape", "y"], "left_anti")  # CLASS shapes at most


def binned(spans: DataFrame, edges: list[np.ndarray], weights: dict[tuple[int, int], float]) -> DataFrame:
    """Blocks of groups of spans that agree in kind, label, fold and bins, with their weight, number and occurrences."""
    def to_bins(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(4).flatten().to_numpy().reshape(-1, N_FEATURES)
            bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([r.tobytes() for r in bins], pa.binary())], names=["kind", "y", "fold", "n", "bins"])

    def to_blocks(batches):
        def block():
            kind, y, fold, m, n = (np.concatenate([h[j] for h in held]) for j in range(5))
            bins = np.frombuffer(b"".join(h[5] for h in held), np.uint8).reshape(-1, N_FEATURES).T
            held.clear()
            w = np.array([weights[c] for c in zip(kind.tolist(), y.tolist())]) * m
            return pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary()) for a, t in zip((kind, y, fold, m, n, w, bins), BLOCK.values())],
                names=list(BLOCK))
        held: list[tuple] = []
        for b in batches:
            if b.num_rows:
                held.append((*(b.column(j).to_numpy() for j in range(5)), b"".join(b.column(5).to_pylist())))
            if sum(len(h[0]) for h in held) >= GROUPS:
                yield block()
        if held:
            yield block()
    groups = cut_lineage(
        spans.select("kind", "y", "fold", "n", "x").mapInArrow(to_bins, "kind int, y int, fold int, n long, bins binary")
        .groupBy("kind", "y", "fold", "bins").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")))
    n = groups.count()
    parts = max(math.ceil(n / GROUPS), min(groups.sparkSession.sparkContext.defaultParallelism, n // 256 + 1))
    return cut_lineage(groups.select("kind", "y", "fold", "m", "n", "bins").coalesce(parts)
                       .mapInArrow(to_blocks, ", ".join(f"{c} binary" for c in BLOCK)))


# Columns of a block and their types.
BLOCK = {"kind": np.uint8, "y": np.uint8, "fold": np.uint8, "m": np.int64, "n": np.int64, "w": np.float64, "bins": np.uint8}


def arrays(block) -> list[np.ndarray]:
    kind, y, fold, m, n, w, bins = (np.frombuffer(block[c], t) for c, t in BLOCK.items())
    return [kind, y, fold, m, n, w, bins.reshape(N_FEATURES, -1)]


def summed(blocks: DataFrame, of, size: int) -> np.ndarray:
    """Sum over all blocks of ``of(block)``, arrays of ``size`` whole numbers; one array a task reaches the driver."""
    def run(batches):
        out = np.zeros(size)
        for b in batches:
            for r in b.to_pylist():
                out += of(arrays(r))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])
        give_back()
    tasks = max(32, blocks.sparkSession.sparkContext.defaultParallelism)
    out = np.zeros(size)
    for r in blocks.coalesce(tasks).mapInArrow(run, "sums binary").collect():
        out += np.frombuffer(r.sums)
    return out


def histograms(models: list[Trees], level: int, at: np.ndarray):
    """Function of a block: sums of gradients, second derivatives and spans.

    They stand by model, node of the last tree's ``level`` and bin; bins of
    feature j begin at ``at[j]``.  Model m leaves out fold m, the last none.
    """
    width, nodes = int(at[-1]), 2 ** level

    def of(block):
        _, y, fold, m, _, w, bins = block
        out = np.zeros((len(models), 3, nodes * width))
        for k, t in enumerate(models):
            use = np.flatnonzero(fold != k)
            x = bins[:, use]
            prob = 1 / (1 + np.exp(-margins(x, t.feature[:-1], t.cut[:-1], t.value[:-1], t.bias)))
            node = leaves(x, t.feature[-1:], t.cut[-1:], level)[0] - (nodes - 1)
            sums = np.rint(UNIT * w[use] * (y[use] - prob)), np.rint(UNIT * w[use] * prob * (1 - prob)), m[use]
            for j in range(N_FEATURES):
                cell = node * width + at[j] + x[j]
                for o, s in zip(out[k], sums):
                    o += np.bincount(cell, weights=s, minlength=nodes * width)
        return out.ravel()
    return of


def boost(blocks: DataFrame, edges: list[np.ndarray], biases: list[float], rounds: int = ROUNDS) -> list[Trees]:
    """Logistic gradient boosting over bins: a model without each fold, and one of all; cuts are bins.

    Each level of a round is one pass over all blocks, for all models.
    """
    at = np.cumsum([0, *(len(e) + 1 for e in edges)])
    models = [Trees(np.zeros((0, NODES), np.int64), np.zeros((0, NODES)), np.zeros((0, NODES)), b, {}) for b in biases]
    for _ in range(rounds):
        for t in models:
            t.feature, t.cut, t.value = (np.vstack([a, np.full((1, NODES), fill, a.dtype)])
                                         for a, fill in ((t.feature, 0), (t.cut, np.inf), (t.value, 0)))
        for level in range(DEPTH):
            nodes, first = 2 ** level, 2 ** level - 1
            got = summed(blocks, histograms(models, level, at), len(models) * 3 * nodes * int(at[-1]))
            for t, (g, h, m) in zip(models, got.reshape(len(models), 3, nodes, -1)):
                g, h = g / UNIT, h / UNIT
                for i in range(nodes):
                    k, gs, hs = first + i, g[i, :at[1]].sum(), h[i, :at[1]].sum()
                    best, left = 1e-6, (gs, hs)
                    for j in range(N_FEATURES if m[i, :at[1]].sum() > 8 else 0):
                        gl, hl = np.cumsum(g[i, at[j]:at[j + 1] - 1]), np.cumsum(h[i, at[j]:at[j + 1] - 1])
                        gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                        if len(gain) and gain.max() > best:
                            c = int(gain.argmax())
                            best, t.feature[-1, k], t.cut[-1, k], left = gain[c], j, c, (gl[c], hl[c])
                    if level == DEPTH - 1:
                        t.value[-1, 2 * k + 1] = RATE * left[0] / (left[1] + 1)
                        t.value[-1, 2 * k + 2] = RATE * (gs - left[0]) / (hs - left[1] + 1)
    return models


def scores(models: list[Trees]):
    """Function of a block: occurrences of positive and of all spans by kind and step of the margin.

    A span's margin is that of the model which has not seen its fold; only
    margins of at least 0 are counted.
    """
    def of(block):
        kind, y, fold, _, n, _, bins = block
        out = np.zeros((2, len(KINDS) * GRID * TOP))
        for k, t in enumerate(models[:-1]):
            own = np.flatnonzero(fold == k)
            z = margins(bins[:, own], t.feature, t.cut, t.value, t.bias)
            own, z = own[z >= 0], z[z >= 0]
            cell = kind[own].astype(np.int64) * (GRID * TOP) + np.minimum(z * GRID, GRID * TOP - 1).astype(np.int64)
            for o, s in zip(out, (n[own] * y[own], n[own])):
                o += np.bincount(cell, weights=s, minlength=len(o))
        return out.ravel()
    return of


def calibrate(hits: np.ndarray, every: np.ndarray, precision: float = PRECISION) -> float:
    """Least score met, of at least 0.5 and down to its step, whose selection is as precise as asked; 2 if none."""
    if not hits.sum():
        return 2.0
    of_hits, of_every = (np.cumsum(a[::-1])[::-1] for a in (hits, every))
    good = np.flatnonzero((every > 0) & (of_hits >= precision * of_every))
    return float(1 / (1 + np.exp(-good[0] / GRID))) if len(good) else 2.0


def fit(docs: DataFrame, text_col: str = "text") -> Trees:
    """Trees and thresholds from all labelled spans of all documents."""
    trees = Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0.0, {k: 2.0 for k in KINDS})
    spans = cut_lineage(without_known_shapes(cut_lineage(labelled(docs, text_col))))
    have = {(r.kind, r.y, r.fold): r.m for r in spans.groupBy("kind", "y", "fold").agg(F.count(F.lit(1)).alias("m")).collect()}

    def number(kinds=range(len(KINDS)), ys=(0, 1), out=-1, weights=None) -> float:
        """Distinct spans, or their weight, less those of a fold."""
        return sum(m * (weights[k, y] if weights else 1) for (k, y, fold), m in have.items() if k in kinds and y in ys and fold != out)
    if min(number(ys=[y], out=k) for y in (0, 1) for k in range(FOLDS)) < 5:
        return trees
    weights = {(k, y): min(1.0, CLASS / number([k], [y])) for k, y, _ in have}
    # Quantiles of the features, each class in its weight.
    weight = F.element_at(F.create_map(*[F.lit(v) for (k, y), w in sorted(weights.items()) for v in (2 * k + y, math.ceil(w * (1 << 20)))]),
                          F.col("kind") * 2 + F.col("y")).cast("long")
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    row = spans.withColumn("w", weight).agg(*[F.percentile(F.col("x")[j], shares, F.col("w")) for j in range(N_FEATURES)]).first()
    edges = [np.unique(np.floor(q)).astype(np.int64) for q in row]
    p = [number(ys=[1], out=k, weights=weights) / number(out=k, weights=weights) for k in (*range(FOLDS), -1)]
    p = np.clip(p, 1e-3, 1 - 1e-3)
    blocks = binned(spans, edges, weights)
    models = boost(blocks, edges, [float(b) for b in np.log(p / (1 - p))])
    hits, every = summed(blocks, scores(models), 2 * len(KINDS) * GRID * TOP).reshape(2, len(KINDS), -1)
    whole = models[-1]
    # Cuts between bins are cuts of the features; a node without one has infinity.
    cut = np.array([[edges[j][int(c)] if np.isfinite(c) else np.inf for j, c in zip(*nodes)] for nodes in zip(whole.feature, whole.cut)])
    thresholds = {kind: calibrate(hits[k], every[k]) if number([k], [1]) >= LEAST else 2.0 for k, kind in enumerate(KINDS)}
    return Trees(whole.feature, cut, whole.value, whole.bias, thresholds)


def added_spans(text: str, base: list[tuple[str, int, int]], trees: Trees | None) -> list[tuple[str, int, int]]:
    """Proposals above their threshold, or by the rule where a kind has none, best first, that overlap no other span taken."""
    if trees is None:
        return []
    spans = proposals(text)
    if not spans:
        return []
    p = np.concatenate([trees.score(np.array([features(text, s) for s in spans[i:i + SCORED]], np.int64))
                        for i in range(0, len(spans), SCORED)])
    cuts = [trees.thresholds[s[0]] for s in spans]
    good = [i for i, s in enumerate(spans) if sure(text, s) or (p[i] >= cuts[i] if cuts[i] <= 1 else rule(text, s))]
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for i in sorted(good, key=lambda i: (-p[i], spans[i][1] - spans[i][2], spans[i][1])):
        _, a, b = spans[i]
        k = bisect.bisect_left(taken, (a, a))
        # Base spans of two kinds may overlap, so look back past equal ends.
        if any(y > a and x < b for x, y in taken[max(0, k - 4):k + 1]):
            continue
        bisect.insort(taken, (a, b))
        out.append(spans[i])
    return out


def find_spans(text: str, trees: Trees | None) -> tuple[list, list]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    every = sorted(base + added_spans(text, base, trees), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """text with each span replaced by its kind in brackets; overlaps are one span."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{k.upper()}]")
        at = b
    out.append(text[at:])
    return "".join(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """One row per document: counts of the fixed kinds, base_sha256, spans.

    Null and empty texts have no spans.  Repeated rows give repeated results;
    an empty table gives none.  ``trees`` are fitted on docs where not given.
    """
    trees = trees or fit(docs, text_col)

    def run(batches):
        for b in batches:
            ns, shas, alls = [], [], []
            for t in b.column(1):
                base, every = find_spans(t.as_py() or "", trees)
                ns.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                shas.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                alls.append(join_spans(every))
            n = np.array(ns, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(n[:, k]) for k in range(4)], pa.array(shas, pa.string()), pa.array(alls, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        give_back()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                               "base_sha256 string, spans string")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with personal data replaced in the text, and its length brought up to date.

    A null text stays null; all other columns stay as they are.
    """
    trees = fit(docs, text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            new = []
            for t in b.column(at):
                t = t.as_py()
                new.append(t if t is None else redact(t, find_spans(t, trees)[1]))
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            n = b.schema.get_field_index(n_chars_col)
            if n >= 0 and pa.types.is_integer(b.schema.field(n).type):
                b = b.set_column(n, b.schema.field(n), pa.array([None if t is None else len(t) for t in new], b.schema.field(n).type))
            yield b
        give_back()
    return docs.mapInArrow(run, schema)
