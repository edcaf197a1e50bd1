"""Personal data by weak supervision.

Regex, gazetteer, context and form labelers vote on candidate spans (yes, no, or no opinion). Spark counts
the vote patterns; expectation-maximisation (Dawid and Skene, 1979) estimates how reliable each labeler is
and how likely each pattern is personal data. A logistic span classifier is trained on these
probabilities and decides on the looser candidates. Spans that the strict patterns find always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "id")  #: base kinds in order, then what only the method finds

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es it nl uk eu us ca au ch at be pl se no fi dk pt cz ru jp cn in br mx".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "55", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91")
CUES = re.compile(r"(?i)mail|contact|write|call|phone|tel\b|mobile|fax|card|visa|credit|ssn|social|ip\b|host|address|user|from")
COUNTER_CUES = re.compile(r"(?i)version|order|invoice|isbn|page|serial|ticket|part|model|figure|chapter|section|build")

_ANY = re.compile(r"[0-9@]| dot |\(dot\)|\[dot\]")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a run of digits is tried from its start only: from inside it the rest of the pattern is the same
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}(?![A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict(text: str) -> list[tuple[str, int, int, bool]]:
    """Matches of the strict patterns, leftmost and apart within a kind: (kind, start, end, passes its check)."""
    out, last = [], 0
    for m in _AT.finditer(text) if "@" in text else ():
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append(("email", a, m.end(), True))
            last = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        out.append(("ip", m.start(), m.end(), all(len(p) <= 3 and int(p) <= 255 for p in parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            out.append(("card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text) if "+" in text else ():
        out.append(("phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return out


def votes(kind: str, s: str, before: str, after: str, checked: bool | None) -> tuple[int, ...]:
    """What the labelers say of one span: 1 personal, 0 not, -1 no opinion. `checked` is None for loose candidates."""
    d = _digits(s)
    pattern = -1 if checked is None else int(checked)
    if kind == "email":
        known = int(re.split(r"[^A-Za-z]+", s)[-1].lower() in TOP_DOMAINS)
    elif kind == "ip":
        known = 0 if s.split(".")[0] in ("0", "127", "255") else -1
    elif kind == "card":
        known = int(s[0] in "3456") if len(d) >= 13 else 0
    elif kind == "phone":
        known = int(d.startswith(CALLING_CODES)) if s[0] == "+" else -1
    else:
        known = 0 if d[:3] in ("000", "666") or d[0] == "9" else 1
    near = before[-32:]
    context = 1 if CUES.search(near) else 0 if COUNTER_CUES.search(near) else -1
    form = int(not (before[-1:].isalnum() or after[:1].isalnum()))
    variety = -1 if kind == "email" else 0 if len(set(d)) <= 2 or d in "01234567890123456789" else 1
    return pattern, known, context, form, variety


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind number, start, end, base, pattern) of all candidate spans; pattern holds kind, votes and form in short."""
    if not _ANY.search(text):
        return []
    found = [(k, a, b, ok, ok) for k, a, b, ok in strict(text)]
    taken = sorted((a, b) for _, a, b, ok, _ in found if ok)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, pattern in _LOOSE:
        for m in pattern.finditer(text):
            a, b = m.span()
            before = bisect_left(starts, b)  # strict spans that start before this one ends
            if not before or ends[before - 1] <= a:
                found.append((kind, a, b, False, None))
    out = []
    for kind, a, b, base, checked in found:
        s = text[a:b]
        v = votes(kind, s, text[max(0, a - 32) : a], text[b : b + 1], checked)
        parts = len(re.findall(r"[^A-Za-z0-9]+", s))
        out.append((KINDS.index(kind), a, b, base, " ".join(map(str, (KINDS.index(kind), *v, min(parts, 4), min((b - a) // 8, 3))))))
    return out


@dataclass
class SpanModel:
    reliability: list[tuple[float, float]]  # of each labeler: P(yes | personal), P(yes | not)
    weights: dict[tuple[int, int], float]  # (feature, value) -> weight
    bias: float

    def probability(self, pattern: str) -> float:
        x = self.bias + sum(self.weights.get(f, 0.0) for f in enumerate(map(int, pattern.split())))
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def expectation_maximisation(v: np.ndarray, kind: np.ndarray, n: np.ndarray, steps: int = 100):
    """Posterior of each vote pattern, and each labeler's two rates. v: patterns x labelers; n: their counts."""
    labelers = v.shape[1]
    yes = np.tile([[0.8], [0.2]], labelers)
    prior = np.full(len(KINDS), 0.5)
    for _ in range(steps):
        score = np.zeros((2, len(v)))
        for c in (0, 1):
            rate = np.where(v == 1, yes[c], np.where(v == 0, 1 - yes[c], 1.0))
            score[c] = np.log(rate).sum(axis=1) + np.log(np.where(c == 0, prior[kind], 1 - prior[kind]))
        post = 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))
        for c, p in ((0, post), (1, 1 - post)):
            w = n * p
            up, down = (w[:, None] * (v == 1)).sum(axis=0), (w[:, None] * (v == 0)).sum(axis=0)
            yes[c] = np.clip((up + (2 if c == 0 else 1)) / (up + down + 3), 0.02, 0.98)  # a mild belief that labelers help
        yes[1] = np.minimum(yes[1], yes[0])
        prior = np.clip([((n * post)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))], 0.02, 0.98)
    return post, [(float(a), float(b)) for a, b in yes.T]


def train(patterns: list[tuple[str, int]], steps: int = 300) -> SpanModel:
    """EM on the votes, then the logistic classifier on kind, votes and form with the posteriors as soft labels."""
    if not patterns:
        return SpanModel([], {}, -50.0)
    x = np.array([list(map(int, p.split())) for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    post, reliability = expectation_maximisation(x[:, 1:6], x[:, 0], n)
    names = sorted({(j, int(k)) for j in range(x.shape[1]) for k in np.unique(x[:, j])})
    hot = np.array([[float(row[j] == k) for j, k in names] + [1.0] for row in x])
    w, weight = np.zeros(hot.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-hot @ w))
        grad = hot.T @ (weight * (p - post)) + 1e-3 * w
        hess = (hot * (weight * p * (1 - p))[:, None]).T @ hot + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return SpanModel(reliability, dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`(pattern, n)` over all candidates of all texts; patterns are few by construction and combined before the shuffle."""

    def run(batches):
        for b in batches:
            seen: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                for c in candidates(t):
                    seen[c[4]] = seen.get(c[4], 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    return docs.select(F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Train on the vote patterns of all of `docs`. At most 5 * 3^5 * 5 * 4 patterns exist, whatever the input's size."""
    return train(sorted((r["pattern"], r["n"]) for r in pattern_counts(docs, text_col).collect()))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """Spans of every row of `docs`: `(id_col, *keep, n_email, n_ip, n_card, n_phone, base, spans)`.

    `base` and `spans` list kind:start:end (code points, end exclusive) by kind and start; spans holds the
    base ones and the loose candidates whose probability is over `cut`. With `mask` a column `masked`
    follows, the text with each span (overlapping ones as one) replaced by its kind in angle brackets.
    Null and empty texts have no spans; repeated rows are treated alike; an empty table gives an empty one.
    """
    keep = keep or []
    df = docs.select(F.col(id_col).alias("pii_id"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.coalesce(text_col, F.lit("")).alias("t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    more = ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base string, spans string" + ", masked string" * mask
    names = df.columns[:-1] + [x.split()[0] for x in more.split(", ")]

    def run(batches):
        known: dict[str, bool] = {}
        for b in batches:
            counts = [[] for _ in range(4)]
            base, every, masked = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                own, added = [], []
                for k, x, y, is_base, pattern in candidates(t):
                    if is_base:
                        own.append((k, x, y))
                    else:
                        if pattern not in known:
                            known[pattern] = model.probability(pattern) > cut
                        if known[pattern]:
                            added.append((k, x, y))
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in own))
                base.append(_joined(own))
                every.append(_joined(own + added))
                if mask:
                    masked.append(masked_text(t, own + added))
            cols = [*b.columns[:-1], *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(masked, pa.string())] * mask, names=names)

    return df.mapInArrow(run, f"{kinds}, {more}").withColumnsRenamed({"pii_id": id_col, **{f"keep_{c}": c for c in keep}})


def masked_text(text: str, spans) -> str:
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text
