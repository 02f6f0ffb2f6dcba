"""Personal data by candidate gradient boosting: wide generators, boosted trees over format and context, calibrated thresholds.

Spans of the four base formats are always redacted. Wide generators also propose spans that the base formats miss
(spelled-out addresses, other separators); boosted trees, trained here, decide which of those are redacted too. They
learn from the corpus: base spans and rewritten forms of them are right; candidates and rewritten forms that break a
rule of their format (check digit, range, number of digits) are wrong. What the corpus has of candidates that keep the
rules and have no base format is not known to be either, and teaches nothing. Thresholds are set on ways of rewriting
that the trees have not seen, in documents that they have not seen. All
documents are learnt from: tasks bin their examples and sum up gradients, and the driver gets a sum for each bin.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import cut, table

KINDS = ("email", "ip", "card", "phone")
#: A kind's threshold is the least with this precision on a held-out quarter; scores count in so many levels there.
PRECISION, LEVELS = 0.995, 10_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 30, 3, 0.3, 16, 20
#: Examples that a task sums up for a tree: there are 90 jobs, so tasks follow the examples and not the partitions that they came in.
EXAMPLES = 50_000
#: Gradients add up as whole multiples of 1 / UNIT, so that no sum hangs on its order.
UNIT = 1 << 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at |@)[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}", re.I)
_WIDE_IP = re.compile(r"(?<![0-9])[0-9]{1,4}(?:[ \[(]?[.,:-][ \])]?[0-9]{1,4}){3}(?![0-9])")
_NUMBERS = re.compile(r"[0-9]+(?:[ ()._/-]{1,3}[0-9]+)*")
_GROUP = re.compile("[0-9]+")
_ENDS, _STARTS = re.compile(r"[0-9][ ()._/-]{0,3}$"), re.compile(r"[ ()._/-]{0,3}[0-9]")


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind: str, s: str) -> bool:
    """Whether a match of a format's pattern is one: parts up to 255, the card's check digit, the number of digits."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return s.count("-") + s.count(" ") + 16 <= len(s) <= 37 and 16 <= len(n := digits(s)) <= 19 and luhn(n)
    return 8 <= sum(map(str.isdigit, s)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base formats, leftmost and not overlapping within a kind, in order of kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if fits(kind, m[0])]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all that might be personal data; spans overlap, and kinds share spans.

    Cards and phones are runs of whole groups of digits: every run of 13 to 19, and every run of 7 to 15 that starts
    like a phone number does.
    """
    out = [("email", *m.span()) for m in _SPELLED.finditer(text)] if re.search(r"@|[\[(]at[\])]| dot ", text, re.I) else []
    out += [("ip", *m.span()) for m in _WIDE_IP.finditer(text)]
    for run in _NUMBERS.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            lead = start - (text[start - 1 : start] == "(")
            lead -= text[lead - 1 : lead] == "+"
            n = 0
            for first, end in groups[i : i + 19]:
                n += end - first
                if n > 19:
                    break
                if n >= 13:
                    out.append(("card", start, end))
                if 7 <= n <= 15 and (lead < start or text[start] == "0"):
                    out.append(("phone", lead, end))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a span, and what stands around it."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    n, groups = digits(s), re.findall("[0-9]+", s)
    marks = re.sub("[A-Za-z0-9]", "", s)
    share = lambda x, f: sum(map(f, x)) / max(1, len(x))
    return [
        KINDS.index(kind), len(s), len(n), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        max((int(g) for g in groups if len(g) < 9), default=0), float(16 <= len(n) <= 19 and luhn(n)), s.count("+"), s.count("("), s.count(" "), s.count("."), s.count("-"),
        float("@" in s), len(set(marks)), len(marks), float(s[:2] == "00"), float(re.search(r"[\[(]at| at |[\[(]dot| dot ", s, re.I) is not None),
        float(not breaks_a_rule(kind, s)), float(s[:3] == "000"), len(n.removeprefix("00")), float(re.search("[.:,-]", marks) is not None), float(re.search(r"[0-9] ?[:,-] ?[0-9]", s) is not None),
        float(_ENDS.search(before) is not None), float(_STARTS.match(after) is not None),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), share(before, str.isdigit), share(after, str.isdigit), share(before, str.isalpha), share(after, str.isalpha), float(before[-1:] == "\n" or not before),
    ]


def rewritten(kind: str, s: str) -> list[tuple[str, bool, bool]]:
    """Other ways to write a base span, and ways to spoil it: (form, is right, is kept for the thresholds)."""
    n = digits(s)
    if kind == "email":
        user, host = s.split("@")
        dots = lambda by: host.replace(".", by)
        right = [(f"{user} at {dots(' dot ')}", False), (f"{user}[at]{dots('[dot]')}", False), (f"{user}(at){host}", False), (f"{user} (at) {dots(' (dot) ')}", True), (f"{user} [at] {host}", True)]
        wrong = [(f"{user} at {host.split('.')[0]}", False), (f"{user} dot {host}", False), (f"{user} at the {host.split('.')[0]}", True)]
    elif kind == "ip":
        p = s.split(".")
        right = [("[.]".join(p), False), (" . ".join(p), False), ("(.)".join(p), True)]
        wrong = [(".".join([*p[:3], "999"]), False), ("[.]".join([*p[:3], "999"]), False), ("-".join(p), False), (":".join(p), False), ("(.)".join([*p[:3], "256"]), True), (", ".join(p), True)]
    elif kind == "card":
        by_four = lambda x, by: by.join(x[i : i + 4] for i in range(0, len(x), 4))
        off = n[:-1] + str((int(n[-1]) + 1) % 10)
        right = [(by_four(n, "."), False), (by_four(n, "/"), False), (by_four(n, "  "), False), (by_four(n, "_"), True), (by_four(n, " - "), True)]
        wrong = [(off, False), (by_four(off, "."), False), (by_four(off, "/"), False), (by_four(off, " "), False), (n[:13], False), (by_four(n[:14], "."), False), (by_four(off, "_"), True), (by_four(n[:15], " - "), True)]
    else:
        three = [n[:2], n[2:5], n[5:]]
        right = [("00" + s[1:], False), ("+" + "/".join(three), False), ("00" + "/".join(three), True), ("+" + "_".join(three), True)]
        wrong = [("000" + n, False), ("00" + n[:5], False), ("0" + n[:6], False), ("0" + "-".join([n[:1], n[1:3], n[3:5]]), True), ("0000" + n[:7], True)]
    return [(form, True, kept) for form, kept in right] + [(form, False, kept) for form, kept in wrong]


def varied(kind: str, s: str) -> str:
    """A span of the same base format with other parts, drawn by the span itself: a corpus may have few shapes."""
    rng = random.Random(s)
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "ip":
        return ".".join(str(rng.choice([rng.randrange(10), rng.randrange(100), rng.randrange(256)])) for _ in range(4))
    if kind == "card":
        n = rng.choice("3456") + some(rng.randint(14, 17))
        return n + next(c for c in "0123456789" if luhn(n + c))
    if kind == "phone":
        return "+" + rng.choice(" -").join(some(n) for n in rng.choice([(2, 3, 4), (1, 3, 3, 4), (2, 2, 3, 5), (2, 3, 5), (3, 2, 6), (2, 4, 4)]))
    name = lambda least: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, 9)))
    user = rng.choice([name(2), f"{name(1)}.{name(3)}", f"{name(3)}{some(2)}"])
    return f"{user}@{'.'.join(name(3) for _ in range(rng.randint(1, 2)))}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"


def breaks_a_rule(kind: str, s: str) -> bool:
    """Whether a candidate can't be personal data of its kind, however it is written."""
    n = digits(s)
    if kind == "ip":
        return any(len(p) > 3 or int(p) > 255 for p in re.findall("[0-9]+", s))
    return kind == "card" and not (16 <= len(n) <= 19 and luhn(n)) or kind == "phone" and not 8 <= len(n.removeprefix("00")) <= 15


class Taken:
    """Spans without gaps between overlapping ones; whether a span overlaps any is a search, not a scan."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return (i == 0 or self.ends[i - 1] <= a) and (i == len(self.starts) or b <= self.starts[i])

    def add(self, a: int, b: int) -> None:
        insort(self.starts, a)
        insort(self.ends, b)


@dataclass
class Boosted:
    """Boosted regression trees for log odds; a tree is a nested (column, threshold, left, right) with numbers as leaves."""

    base: float
    trees: list

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if isinstance(node, float):
                    out[rows] += node
                else:
                    high = x[rows, node[0]] > node[1]
                    todo += [(node[3], rows[high]), (node[2], rows[~high])]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sums(train: DataFrame, model: Boosted, tree, width: int) -> dict[float, np.ndarray]:
    """For each leaf of ``tree``, whose leaves are numbers of their own: (column, bin, [gradient, curvature, rows]) over all examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[float, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _codes(batch.column("code")), batch.column("n").to_numpy()
            p, leaf = model(x), Boosted(0.0, [tree]).odds(x)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            values = [np.rint((y - p) * UNIT).astype(np.int64) * n, np.rint(p * (1 - p) * UNIT).astype(np.int64) * n, n]
            for v in np.unique(leaf).tolist():
                own = np.flatnonzero(leaf == v)
                into = made.setdefault(v, np.zeros((width, BINS + 1, 3), np.int64))
                for j in range(width):
                    for i, value in enumerate(values):
                        np.add.at(into[j, :, i], x[own, j], value[own])
        for v, sums in made.items():
            j, b = np.nonzero(sums[:, :, 2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), v)), pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), *(pa.array(sums[j, b, i]) for i in range(3))], names=["leaf", "j", "b", "g", "h", "n"])

    rows = train.select("code", "y", "n").mapInArrow(run, "leaf double, j int, b int, g long, h long, n long").groupBy("leaf", "j", "b").agg(*(F.sum(c).alias(c) for c in "ghn"))
    out: dict[float, np.ndarray] = {}
    for r in rows.toPandas().itertuples():  # leaves x columns x bins
        out.setdefault(r.leaf, np.zeros((width, BINS + 1, 3)))[r.j, r.b] = r.g / UNIT, r.h / UNIT, r.n
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in as few partitions as their number asks for; a single one is summed up without a shuffle."""
    return cut(rows.coalesce(max(1, -(-rows.count() // EXAMPLES))))


def boost(train: DataFrame, width: int, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Trees over bins of ``train(code, y, n)``: examples with their bins as bytes, whether they are right, and how many there are."""
    ones, n = train.agg(F.sum(F.col("n") * F.col("y").cast("long")), F.sum("n")).first()
    mean = float(np.clip(ones / n, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(mean / (1 - mean))), [])

    def value(total: np.ndarray) -> float:
        return float(rate * total[0] / (total[1] + 1))

    def split(sums: np.ndarray):
        """(column, bin, sums below, sums above) of the best cut of a leaf, or None."""
        total = sums[0].sum(0)
        low = np.cumsum(sums, axis=1)[:, :-1]
        high = total - low
        gain = low[..., 0] ** 2 / (low[..., 1] + 1) + high[..., 0] ** 2 / (high[..., 1] + 1) - total[0] ** 2 / (total[1] + 1)
        j, k = np.unravel_index(int(gain.argmax()), gain.shape)
        return (int(j), int(k), low[j, k], high[j, k]) if total[2] >= LEAST_ROWS and gain[j, k] > 1e-6 else None

    for _ in range(trees):
        cuts, ends, open_leaves = {}, {}, [1]  # the leaves below leaf i are 2i and 2i + 1
        made = lambda at, leaf: (*cuts[at], made(2 * at, leaf), made(2 * at + 1, leaf)) if at in cuts else leaf(at)
        for _ in range(depth):
            if not open_leaves:
                break
            sums = _sums(train, model, made(1, float), width)
            below = []
            for at in open_leaves:
                best = split(sums[at]) if at in sums else None
                if best:
                    cuts[at] = best[:2]
                    ends[2 * at], ends[2 * at + 1] = value(best[2]), value(best[3])
                    below += [2 * at, 2 * at + 1]
                elif at in sums:
                    ends[at] = value(sums[at][0].sum(0))
            open_leaves = below
        model.trees.append(made(1, lambda at: ends.get(at, 0.0)))
    return model


@dataclass
class Detector:
    model: Boosted | None
    thresholds: dict[str, float]

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans): added spans overlap no base span and no better added one."""
        base = base_spans(text)
        taken = Taken([(s, e) for _, s, e in base])
        asked = [c for c in candidates(text) if taken.free(*c[1:])] if self.model is not None else []
        if not asked:
            return base, base
        p = self.model(np.array([features(text, *c) for c in asked]))
        added = []
        for score, c in sorted(zip((-p).tolist(), asked, strict=True)):
            if -score >= self.thresholds.get(c[0], 2.0) and taken.free(*c[1:]):
                added.append(c)
                taken.add(*c[1:])
        return base, sorted(base + added, key=lambda c: (KINDS.index(c[0]), *c[1:]))


def examples(text: str) -> list[tuple[list[float], bool, bool]]:
    """(features, is personal data, is kept for the thresholds) of a text's base spans, its candidates that break a rule, and
    base spans rewritten and spoilt in their places."""
    base = base_spans(text)
    own, taken = set(base), Taken([(s, e) for _, s, e in base])
    out = [(features(text, *c), c in own, False) for c in candidates(text) if c in own or taken.free(*c[1:]) and breaks_a_rule(c[0], text[c[1] : c[2]])]
    for kind, start, end in base:
        for form, right, kept in rewritten(kind, text[start:end]) + rewritten(kind, varied(kind, text[start:end])):
            before = text[max(0, start - 40) : start]
            there = before + form + text[end : end + 40]
            whole = (kind, len(before), len(before) + len(form))
            # a part of it, or another kind, is wrong too
            out += [(features(there, *c), right and c == whole, kept) for c in candidates(there) if c[1] < whole[2] and c[2] > whole[1] and (c == whole or not right or c[1] >= whole[1] and c[2] <= whole[2])]
    return out


def learn(docs: DataFrame) -> Detector:
    """Fit on the candidates of every document with a digit or an at sign and an id.

    Bins are ranges between quantiles of each feature, counted in values of three digits. Documents whose id leaves 3 when divided
    by 4, and ways of rewriting that the trees do not see, set the thresholds. What the driver gets has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = examples(t)
                kinds = (pa.list_(pa.float64()), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([d % 4 == 3] * len(rows), pa.bool_()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["other", "x", "y", "kept"])

    likely = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    found = likely.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "other boolean, x array<double>, y boolean, kept boolean")
    found = dealt(cut(found.groupBy("other", "x", "y", "kept").agg(F.count("*").alias("n"))))
    seen = found.filter("not kept and not other")
    # three digits of each value: a number of levels that does not follow the corpus
    power = F.pow(F.lit(10.0), F.floor(F.log10("v")) - 2)
    level = F.when(F.col("v") > 0, F.round(F.floor(F.col("v") / power) * power, 12)).otherwise(F.lit(0.0))
    counts = seen.select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", level.alias("v")).agg(F.sum("n").alias("n")).toPandas().sort_values(["j", "v"])
    if counts.empty or found.select("y").distinct().count() < 2:
        return Detector(None, {})
    cuts = []
    for _, own in counts.groupby("j"):
        upto = np.cumsum(own["n"].to_numpy())
        cuts.append(np.unique(own["v"].to_numpy()[np.searchsorted(upto, np.linspace(0, 1, BINS + 1)[:-1] * upto[-1], side="right")]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(cuts))
            code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), *(batch.column(c) for c in ("y", "n"))], names=["kind", "code", "y", "n"])

    def codes(rows: DataFrame) -> DataFrame:
        coded = rows.select("x", "y", "n").mapInArrow(binned, "kind int, code binary, y boolean, n long")
        return dealt(cut(coded.groupBy("kind", "code", "y").agg(F.sum("n").alias("n"))))

    grown = boost(codes(seen), len(cuts))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = grown(_codes(batch.column("code"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(np.rint(p * LEVELS).astype(np.int32)), batch.column("y"), batch.column("n")], names=["kind", "level", "y", "n"])

    held = codes(found.filter("kept and other")).mapInArrow(scored, "kind int, level int, y boolean, n long")
    rows = held.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("right")).toPandas()
    thresholds = {}
    for k, own in rows.sort_values("level", ascending=False).groupby("kind"):
        p, good = own["level"].to_numpy() / LEVELS, own["right"].cumsum().to_numpy() / own["n"].cumsum().to_numpy()
        fine = np.flatnonzero(good >= PRECISION)
        if len(fine):
            thresholds[KINDS[k]] = max(0.5, float(p[fine[-1]] + np.append(p, 0)[fine[-1] + 1]) / 2)  # halfway to the next score
    named = lambda node: node if isinstance(node, float) else (node[0], float(cuts[node[0]][node[1]]) if node[1] < len(cuts[node[0]]) else np.inf, named(node[2]), named(node[3]))
    return Detector(Boosted(grown.base, [named(t) for t in grown.trees]), thresholds)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, base, found) for each row: arrays of (kind, start, end) in code points, by kind and start.

    Null and empty texts have no spans; rows that repeat are each answered.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    held = docs.sparkSession.sparkContext.broadcast(detector)  # trees: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [held.value.spans(t or "") for t in batch.column("text").to_pylist()]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "base", "found"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, f"doc_id long, base {kind}, found {kind}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, text) for each row with its personal data replaced; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, detector.spans(t)[1]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detect(docs, learn(docs)).select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"), F.size("found").cast("long").alias("n_spans"))
