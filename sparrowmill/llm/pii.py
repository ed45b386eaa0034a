"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import fresh
from sparrowmill.sources import table

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in the order of KINDS.
BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# A local part holds no @, so addresses are read outwards from each @; and an ip
# that fails from the start of its digits fails from within them. Both scans give
# the patterns' matches without trying every character of a long run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MIDDLE = re.compile(r"(?<=[A-Za-z0-9._%+-])@(?=[A-Za-z0-9-])")
DOMAIN = re.compile(BASE[0].split("@")[1])
SCANS = (re.compile(r"(?<![0-9])" + BASE[1]), *map(re.compile, BASE[2:]))
#: What else may be personal data; the model decides. Written-out addresses, and 7 to
#: 19 digits with at most three separators between two of them; longer ones are none.
LOOSE = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+ ?(?:[(\[{<]at[)\]}>]| at ) ?[A-Za-z0-9-]+(?:(?: ?[(\[{<]dot[)\]}>] ?| dot |\.)[A-Za-z0-9-]+)+", re.I)),
    ("digits", re.compile(r"(?<![\w.+])\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,18}(?![\w])")),
)
#: What every loose match holds.
GATE = re.compile(r"[0-9][ ()./-]{0,3}[0-9]| at |[(\[{<]at[)\]}>]", re.I)
AT, DOT = re.compile(r"\s*[\[({<]?\bat\b[\])}>]?\s*"), re.compile(r"\s*[\[({<]?\bdot\b[\])}>]?\s*")
LABELS = ("none", *KINDS)
#: Of a candidate to learn from: its text, its place there, its label, hashed features,
#: what equal tokens share, if the label is sure, and if the field is told it.
EXAMPLE = ["doc", "at", "label", "features", "token", "sure", "fixed"]
FEATURES = 1024
#: How written-out addresses and numbers without a country code look; see :func:`masked`.
WRITTEN = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "))
SEPARATED = (" ", "-", ".", ". ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for at in (m.start() for m in MIDDLE.finditer(text)):
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1)
        if start < at and m:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in emails(text)]
    for kind, scan in zip(KINDS[1:], SCANS, strict=True):
        for m in scan.finditer(text):
            s = m.group()
            digits = re.sub(r"[^0-9]", "", s)
            ok = (
                (kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in s.split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            )
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Base spans, and looser ones that overlap neither them nor one another:
    (start, end, kind or "")."""
    found = base_spans(text)
    if GATE.search(text):
        taken = np.zeros(len(text) + 1, bool)
        for a, b, _ in found:
            taken[a:b] = True
        for _, scan in LOOSE:
            for m in scan.finditer(text):
                if not taken[m.start() : m.end()].any():
                    found.append((m.start(), m.end(), ""))
                    taken[m.start() : m.end()] = True
    return sorted(found)


def masked(span: str, kind: str, draw: int) -> str:
    """A base span as it might be written without what makes it one: an address
    spelled out, a number without + and perhaps without its country code."""
    if kind == "email":
        at, dot = WRITTEN[draw % 4]
        name, host = span.split("@")
        return name + at + host.replace(".", dot)
    if kind == "phone":
        groups = re.findall(r"[0-9]+", span)
        groups = groups[1:] if len(groups) > 2 and draw & 4 else groups
        return f"0{groups[0]} {''.join(groups[1:])}" if draw % 5 == 4 else SEPARATED[draw % 4].join(groups)
    return span


def decoy(span: str, kind: str, draw: int) -> str | None:
    """What has something of a masked span and is none: a place with a full stop
    after it; bare numbers, dates, decimals, book numbers and years."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        name, host = span.split("@")
        return f"{name} at {host}"
    if kind != "phone":
        return None
    x = (digits * 2)[:19]
    n = draw // 8
    return (
        x[: 7 + n % 6], x[: 13 + n % 7], f"{1950 + n % 80}-{1 + n % 12:02}-{1 + n % 28:02} {n % 24:02}", f"{n % 90}.{x[: 6 + n % 9]}",
        f"978-{x[0]}-{x[: 2 + n % 5]}-{x[2 + n % 5 : 8]}-{x[9]}", f"{1900 + n % 99} {1950 + n % 70} {2000 + n % 30}", f"{x[:3]}-{x[3:7]}", f"{n % 900}.{x[:3]}.{x[3:6]}",
    )[draw % 8]


def features(span: str, before: str, after: str) -> list[int]:
    """Hashed: the form of a span and the words around it."""
    low = span.lower()
    words = [f"before={w}" for w in re.findall(r"\w+", before.lower())[-2:]] + [f"after={w}" for w in re.findall(r"\w+", after.lower())[:1]]
    if re.search(r"[a-z]", low):
        plain = DOT.sub(".", AT.sub("@", low))
        host = plain.rpartition("@")[2].split(".")
        told = (("@" in low or bool(re.search(r"[\[({<]at", low))), ("." in low.rpartition("at")[2]))
        names = ["address", f"top={len(host[-1])}", f"parts={min(4, len(host))}", f"spelled={told[0]}", f"spelled={told}", f"digits={bool(re.search('[0-9]', plain))}"]
    else:
        groups = [len(g) for g in re.findall(r"[0-9]+", low)]
        n, marks = sum(groups), sorted(set(re.findall(r"[^0-9]", low)))
        names = [f"n={n}", f"n={'short' if n < 10 else 'long' if n > 15 else 'number'}", f"groups={min(5, len(groups))}", f"last={groups[-1]}", f"shape={'-'.join(map(str, groups[-3:]))}", f"plus={'+' in marks}", f"whole={len(groups) == 1 and n >= 10}", f"dotted={marks == ['.']}", f"luhn={14 <= n <= 19 and luhn(re.sub('[^0-9]', '', low))}"]
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in [*names, *words]]


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """Some 40 characters each way, for the neighbouring words."""
    return text[max(0, start - 40) : start], text[end : end + 40]


def same_token(text: str, start: int, end: int) -> str:
    """What similar tokens share: a written-out address undone, or the last nine
    digits, as country codes come and go. Numbers that differ only before these
    pull one another to one label, which is a potential and no rule."""
    s = text[start:end].lower()
    if re.search(r"[a-z]", s):
        return "e" + DOT.sub(".", AT.sub("@", s))
    digits = re.sub(r"[^0-9]", "", s)
    return "d" + (digits[-9:] if len(digits) <= 15 and not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) else digits)


def infer(unary: np.ndarray, keys: list, chain: float, skip: float, joined: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Label marginals by loopy message passing. Neighbours in the text share a
    ``chain`` potential and equal tokens a ``skip`` potential, both for equal
    labels. Several texts may follow one another: ``joined`` says which rows but
    the first are in the text of the row before, and their ``keys`` must differ. Tokens with one key meet in a factor of their own, so n repeats take
    n messages and not n * n. Messages are damped by half; they end when none moves
    by 1e-4, or after ``rounds``, with what they are then."""
    n, k = unary.shape
    groups = defaultdict(list)
    for i, key in enumerate(keys):
        groups[key].append(i)
    index = np.zeros(n, np.int64)
    for g, members in enumerate(groups.values()):
        index[members] = g

    def through(log_m: np.ndarray, weight: float) -> np.ndarray:
        p = np.exp(log_m - log_m.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return np.log(1 + (np.exp(weight) - 1) * p)

    edge = np.ones((max(0, n - 1), 1)) if joined is None else joined[:, None].astype(float)
    right, left = np.zeros((n, k)), np.zeros((n, k))
    up, down = np.zeros((n, k)), np.zeros((n, k))
    for _ in range(rounds):
        up = 0.5 * up + 0.5 * through(unary + right + left, skip)
        total = np.zeros((len(groups), k))
        np.add.at(total, index, up)
        fresh = total[index] - up
        change = np.abs(fresh - down).max(initial=0)
        down = fresh
        belief = unary + down
        new_right, new_left = np.zeros((n, k)), np.zeros((n, k))
        new_right[1:], new_left[:-1] = edge * through((belief + right)[:-1], chain), edge * through((belief + left)[1:], chain)
        right, left = new_right, new_left
        if change < 1e-4:
            break
    score = unary + right + left + down
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per candidate, in order: half of the base spans in their masked
    form, so that the field learns what they look like without a base pattern.
    Half of these are told again at some other place of the text, as they were or
    masked otherwise. Each span has two decoys, in its text or in one of
    their own, some of them told again as well."""
    for b in batches:
        rows = []
        for text in b["_text"]:
            doc = xxhash.xxh64_intdigest(text or "") >> 1

            def row(where: int, at: int, label: int, shown: str, place: tuple[int, int], sure: bool, fixed: bool, text=text):
                token = xxhash.xxh64_intdigest(same_token(shown, 0, len(shown))) >> 1
                rows.append((where, at, label, features(shown, *around(text, *place)), token, sure, fixed))

            for a, z, kind in candidates(text or ""):
                span, draw = text[a:z], xxhash.xxh32_intdigest(f"{doc} {a}")
                label, hide = LABELS.index(kind or "none"), bool(kind) and draw & 1
                row(doc, 8 * a, label, masked(span, kind, draw >> 8) if hide else span, (a, z), bool(kind), bool(kind) and not hide)
                far = (draw * 2654435761 >> 7) % len(text)
                if hide and draw & 2:
                    again = bool(draw & 4)
                    row(doc, 8 * (len(text) + a) + 4, label, masked(span, kind, draw >> 14) if again else span, (far, far), True, not again)
                for i, other in enumerate(filter(None, (decoy(span, kind, draw >> 4), decoy(span, kind, draw >> 9)))):
                    # A decoy that shares the span's token would say that equal tokens differ.
                    own = draw >> (20 + i) & 1 or same_token(other, 0, len(other)) == same_token(span, 0, len(span))
                    home = (doc ^ xxhash.xxh64_intdigest(f"{a} {i}")) >> 1 if own else doc
                    row(home, 8 * a + 1 + i, 0, other, (a, z), True, False)
                    if draw >> (22 + i) & 1:
                        row(home, 8 * (len(text) + a) + 5 + i, 0, other, (far, far), True, False)
        yield pd.DataFrame(rows, columns=EXAMPLE)


class Field:
    """A skip-chain conditional field: unary weights (labels by features, the last
    column a bias), and potentials for equal labels of neighbours and of equal tokens."""

    def __init__(self, weights: np.ndarray, chain: float, skip: float):
        self.weights, self.chain, self.skip = weights, chain, skip

    def unary(self, found: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[:, f].sum(axis=1) + self.weights[:, -1] for f in found])


def _unary(rows: pd.DataFrame, steps: int = 300, rate: float = 0.1, ridge: float = 1e-3, unlabelled: float = 0.5) -> np.ndarray:
    """Weights of labels by features alone, by maximum likelihood. Candidates of
    the corpus that are no base span count as none, by ``unlabelled``, as some are
    personal data."""
    k, width = len(LABELS), FEATURES + 1
    w = np.zeros((k, width))
    w[0, -1] = 1.0
    if not len(rows):
        return w
    n = len(rows)
    row, at = np.repeat(np.arange(n), rows["features"].map(len).to_numpy()), np.concatenate(rows["features"].to_numpy()).astype(np.int64)
    one = np.eye(k)[rows["label"].to_numpy()]
    weight = np.where(rows["sure"], 1.0, unlabelled)[:, None]
    m, v = 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(row, w[c, at], minlength=n) for c in range(k)], axis=1) + w[:, -1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = weight * (p / p.sum(axis=1, keepdims=True) - one) / n
        g = np.stack([np.bincount(at, d[row, c], minlength=width) for c in range(k)])
        g[:, -1] += d.sum(axis=0)
        g += ridge / n * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def told_labels(unary: np.ndarray, labels: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """``unary`` with rows whose label the field is told held to it."""
    out = unary.copy()
    out[fixed] = -30.0
    out[fixed, labels[fixed]] = 0.0
    return out


def loss(shared: tuple[float, float], rows: pd.DataFrame, unary: np.ndarray, unlabelled: float = 0.5, prior: tuple[float, float] = (0.1, 3.0)) -> float:
    """Minus the log of the marginals that message passing gives the labels of
    ``rows`` (in order of their texts) that the field is not told, and a prior
    worth one row with a deviation of 1 from ``prior``."""
    y, fixed, doc = rows["label"].to_numpy(), rows["fixed"].to_numpy(), rows["doc"].to_numpy()
    keys = list(zip(doc, rows["token"], strict=True))
    p = infer(told_labels(unary, y, fixed), keys, *shared, joined=doc[1:] == doc[:-1])
    each = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * np.where(rows["sure"], 1.0, unlabelled)
    return float(each[~fixed].sum()) + sum((a - b) ** 2 for a, b in zip(shared, prior, strict=True)) / 2


def train(rows: pd.DataFrame, prior: tuple[float, float] = (0.1, 3.0), shared_rows: int = 5_000) -> Field:
    """Piecewise: first the unary weights alone, then the two shared potentials on
    top of them. These are what makes the labels likeliest by the same message
    passing that :func:`spans` uses (:func:`loss`), over unary scores that a model
    of the other half of the texts gives, as a model is too sure of its own. They
    are found by a search that halves its step, on the first ``shared_rows`` rows of
    texts with several, and stay positive; without any they stay at ``prior``."""
    rows = rows.sort_values(["doc", "at"], kind="stable").drop_duplicates(["doc", "at"]).reset_index(drop=True)
    if not len(rows):
        return Field(_unary(rows), *prior)
    half = (rows["doc"].to_numpy() >> 5) & 1
    unary = np.zeros((len(rows), len(LABELS)))
    for h in (0, 1):
        if (half == h).any():
            unary[half == h] = Field(_unary(rows[half != h]), *prior).unary(list(rows["features"][half == h]))
    several = np.flatnonzero(rows.groupby("doc")["at"].transform("size").to_numpy() > 1)[:shared_rows]
    told, scores = rows.iloc[several], unary[several]
    best, step = tuple(prior), 1.0
    least = loss(best, told, scores, prior=prior) if len(told) else 0.0
    while len(told) and step > 0.05:
        a, b = best
        tried = {x: loss(x, told, scores, prior=prior) for x in ((a + step, b), (max(0.0, a - step), b), (a, b + step), (a, max(0.0, b - step)))}
        found = min(tried, key=tried.get)
        if tried[found] < least:
            best, least = found, tried[found]
        else:
            step /= 2
    return Field(_unary(rows), *best)


def fit(docs: DataFrame, text: str = "text", max_docs: int = 50_000) -> Field:
    """A field from about ``max_docs`` documents (all, if they are fewer), those
    with the lowest hashes of their texts; their candidates' hashed features,
    some 100 bytes each, come to the driver."""
    t = F.col(f"`{text}`")
    share = max_docs / max(1, max_docs, docs.count())
    rows = docs.select(t.alias("_text")).filter(t.isNotNull())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = rows.mapInPandas(_examples, "doc long, at long, label int, features array<int>, token long, sure boolean, fixed boolean")
    return train(pd.DataFrame([tuple(r) for r in found.collect()], columns=EXAMPLE))


def spans(text: str | None, field: Field, threshold: float = 0.5) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base): base spans, which stay whatever the field says,
    and candidates whose marginal for a kind is over ``threshold``."""
    text = text or ""
    found = candidates(text)
    loose = [not kind for *_, kind in found]
    if not any(loose):
        return [(a, b, kind, True) for a, b, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))]
    labels = np.array([LABELS.index(kind or "none") for *_, kind in found])
    unary = told_labels(field.unary([features(text[a:b], *around(text, a, b)) for a, b, _ in found]), labels, labels > 0)
    p = infer(unary, [same_token(text, a, b) for a, b, _ in found], field.chain, field.skip)
    out = []
    for (a, b, kind), q in zip(found, p, strict=True):
        best = int(q[1:].argmax()) + 1
        if kind or 1 - q[0] > threshold:
            out.append((a, b, kind or LABELS[best], bool(kind)))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in found)


def _find(batches: Iterator[pd.DataFrame], field: Field) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["_text"]:
            found = spans(text, field)
            base = [(a, z, k) for a, z, k, is_base in found if is_base]
            rows.append((*[sum(k == kind for *_, k in base) for kind in KINDS], hashlib.sha256(told(base).encode()).hexdigest(), told([x[:3] for x in found]), len(found)))
        out = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"], index=b.index)
        yield pd.concat([b.drop(columns="_text"), out], axis=1)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans)``
    per row.

    A field over each text's candidates decides which loose ones are personal
    data; see :func:`fit` and :func:`infer`. Null and empty texts have no spans;
    very long ones are searched whole, in time in proportion; of equal starts
    the kinds' order decides; repeated rows are treated alike; an empty table
    gives no rows; other columns are not carried."""
    field = fit(docs, text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    kinds = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return rows.mapInPandas(lambda it: _find(it, field), f"doc_id long, {kinds}")


def redacted(text: str | None, field: Field) -> str | None:
    parts, at = [], 0
    for a, z, kind, _ in spans(text, field):
        if z > at:
            parts += [text[at : max(at, a)], f"<{kind}>" if a >= at else ""]
            at = z
    return "".join(parts) + text[at:] if at else text


def _clean(field: Field) -> Callable:
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, field))

    return clean


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, whatever their names, with ``text`` redacted:
    every span becomes its kind in angle brackets. ``n_chars``, if there, follows
    where the text has changed. Only texts go through Python, in one pass; nothing
    is written or shuffled. Null stays null; the rest is as in :func:`find`."""
    (made,) = fresh(docs, "_clean")
    out = docs.withColumn(made, F.pandas_udf(_clean(fit(docs, text)), "string")(F.col(f"`{text}`")))
    named = {text: F.col(made)}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(F.col(made) == F.col(f"`{text}`"), F.col("n_chars")).otherwise(F.coalesce(F.length(made).cast("long"), F.col("n_chars")))
    return out.select(*[named[c].alias(c) if c in named else F.col(f"`{c}`") for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
ORACLE_SQL: dict[str, str] = {}
