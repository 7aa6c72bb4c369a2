"""Scoring texts for abusive, hateful or sexual content from few confirmed examples.

A document is a bag of passages and its score that of its worst passage. The
classifier is linear in hashed character and word n-grams of a normal form that
undoes common disguises. It is trained with numpy from confirmed examples
(positive reviews) and unlabelled text under the non-negative risk estimator for
positive and unlabelled data: the unlabelled risk is corrected by the class prior
and never let below zero. Which passage of a positive document is the reason for
its label is learnt in turns with the classifier.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.session import materialize

_POWERS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(32)], dtype=np.uint32)

#: Hash space of the features.
BITS = 18
#: Bounds of a sample to look at: confirmed documents, unlabelled documents, and bytes of text of either.
MAX_REVIEWED, MAX_UNLABELLED, MAX_BYTES = 4000, 4000, 48_000_000
#: What one task fits a model to, on average: confirmed texts, unlabelled texts, and bytes of text of either.
SHARE_REVIEWED, SHARE_UNLABELLED, SHARE_BYTES = 1000, 8000, 48_000_000

# Letters of other scripts and signs that stand for a Latin letter.
_LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһкмнтвгαβεικνορτυχωη",
    "aeopcyxijsdhkmhtbrabeiknoptuxwn",
)
_LEET = str.maketrans("01345789@$!|+", "oieastbgasilt")
_BREAK = re.compile(r"[\n\r  \x0b\x0c]+|(?<=[.!?…])\s+|(?<=[。！？])|[|;\t]+|(?<=,),+")
_LEAD = re.compile(r"^\s*[#>*\-]+\s*")
_CODE = re.compile(r"\b(?:[0-9a-f]{12,}|[a-z]\d+)\b")
# an address, or visible ASCII with a slash and another slash or a dot; other slashes are blanks
_PATH = re.compile(r"(?:https?://|www\.)[!-~]+|(?<![!-~])[!-~]*[/\\][!-~]*[/\\.][!-~]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_ ·•*]){2,}[^\W\d_](?![^\W_])")
_MIXED = re.compile(r"(?<![\w=.])(?:[@$]|[^\W_])*[^\W\d_][\d@$!|]{1,3}[^\W\d_](?:[@$!|]?[^\W_])*[@$]?(?![\w=])|(?<![\w=.])[@$\d][^\W\d_]{3,}(?![\w=])")
_ALONE = re.compile(r"(?<![\w/\\.])\d+(?:[.,:]\d+)*(?![\w/\\])")
_MAYBE = re.compile(r"[\d@$!|][^\W\d_]")
_RUN = re.compile(r"(.)\1+")
_STARS = re.compile(r"[*#]{2,}|(?<=\w)[*#](?=\w)")
_NUMBER = re.compile(r"\d[\d.,:\-]*")


class _Kept(dict):
    """A translation table, filled as characters are met: hidden and control characters go."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c) in ("Cf", "Cc", "Co", "Cn") else c
        return self[code]


class _Base(dict):
    """A translation table for decomposed text: marks go, lookalikes become Latin."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = None if unicodedata.category(c) == "Mn" else _LOOKALIKES.get(code, c)
        return self[code]


class _Shown(dict):
    """A translation table that leaves word characters and asterisks, and blanks for all else."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c == "*" or c == "_" or c.isalnum() else " "
        return self[code]


_KEPT, _BASE, _SHOWN = _Kept(), _Base(), _Shown()


def normal(passage: str) -> str:
    """The normal form of a passage: one case and script, no hidden characters, disguises undone."""
    s = passage
    if s.isascii():
        s = _LEAD.sub("", s.translate(_KEPT)).lower()
    else:
        s = _LEAD.sub("", unicodedata.normalize("NFKC", s).translate(_KEPT)).casefold()
        if not s.isascii():
            s = unicodedata.normalize("NFD", s).translate(_BASE)
    if "/" in s or "\\" in s:
        s = _PATH.sub(" ", s)
    s = _CODE.sub(" ", s)
    s = _SPACED.sub(lambda m: re.sub(r"[.\-_ ·•*]", "", m.group()), s)
    if _MAYBE.search(s):
        s = _MIXED.sub(lambda m: m.group().translate(_LEET), s)
    if "*" in s or "#" in s:
        s = _STARS.sub("*", s)
    s = _NUMBER.sub("0", s)
    s = _RUN.sub(r"\1", s)
    return " ".join(s.translate(_SHOWN).split())


#: Normal forms of lines met before in this process; emptied when full.
_known: dict[str, str] = {}


def passages(text: str | None, longest: int = 90) -> list[str]:
    """Normal forms of a text's lines and sentences, each once; longer ones in overlapping windows.

    Null and blank texts have none. The whole text is covered, whatever its length.
    """
    out: dict[str, None] = {}
    # numbers that stand alone end as 0 anyway; so early, more lines are met again
    for raw in _BREAK.split(_ALONE.sub("0", text or "")):
        if not raw or raw.isspace():
            continue
        s = _known.get(raw)
        if s is None:
            if len(_known) > 50_000:
                _known.clear()
            s = normal(raw)
            if len(raw) < 300:
                _known[raw] = s
        if len(s) <= longest:
            if s:
                out[s] = None
        else:
            step = longest // 2
            for k in range(0, len(s) - step, step):
                out[s[k : k + longest]] = None
    return list(out)


def grams(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, form it belongs to) of each n-gram; n-grams of 2 to 5 characters, of 1 and 2 words.

    Pairs of characters count in wide scripts alone. A constant feature keeps every
    form from being empty.
    """
    padded = [f" {f} " for f in forms]
    sizes = np.array([len(p) for p in padded], dtype=np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(forms), dtype=np.int32), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    shift = np.uint32(32 - BITS)
    h, own, got = np.zeros(len(codes), dtype=np.uint32), [np.arange(len(forms), dtype=np.int32)], [np.zeros(len(forms), dtype=np.uint32)]
    for n in range(1, 6):
        rolled = np.zeros_like(codes)
        rolled[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h ^ (rolled + np.uint32(n * 131))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n == 1:
            continue
        at = np.flatnonzero((ends >= n) & (codes > 0x3000)) if n == 2 else np.flatnonzero(ends >= n)
        got.append((h[at] * np.uint32(0x85EBCA6B)) >> shift)
        own.append(owner[at])
    # words are what spaces separate: a polynomial hash of each, and of each two neighbours
    space = codes == 32
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(begins):
        first = np.zeros(len(codes), dtype=np.int64)
        first[begins] = begins
        place = np.minimum(np.arange(len(codes)) - np.maximum.accumulate(first), 31)
        mixed = np.where(space, np.uint32(0), (codes + np.uint32(17)) * _POWERS[place])
        word = np.add.reduceat(mixed, begins, dtype=np.uint32) * np.uint32(0x27D4EB2F)
        word ^= word >> np.uint32(15)
        of = owner[begins]
        got.append((word * np.uint32(0xC2B2AE3D)) >> shift)
        own.append(of)
        two = np.flatnonzero(of[1:] == of[:-1])
        pair = word[two] * np.uint32(31) + word[two + 1] * np.uint32(0x9E3779B1)
        got.append(((pair ^ (pair >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> shift)
        own.append(of[two])
    return np.concatenate(got).astype(np.int64), np.concatenate(own)


def features(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features form by form, start of each form), for repeated sums."""
    index, own = grams(forms)
    order = np.argsort(own, kind="stable")
    return index[order], np.searchsorted(own[order], np.arange(len(forms)))


@dataclass
class Model:
    """Weights of the features, a bias, the class prior it was trained with, and held-out document scores.

    ``confirmed`` and ``others`` are the scores of the confirmed and unlabelled documents
    it was trained with, by models that haven't seen them.
    """

    weights: np.ndarray
    bias: float
    prior: float
    confirmed: np.ndarray
    others: np.ndarray

    def score(self, forms: list[str]) -> np.ndarray:
        if not forms:
            return np.zeros(0)
        index, own = grams(forms)
        total = np.bincount(own, weights=self.weights[index], minlength=len(forms))
        return total / np.sqrt(np.bincount(own, minlength=len(forms))) + self.bias

    def document(self, text: str | None) -> tuple[float, str]:
        """(score, worst passage) of a text; a text without passages has the lowest score."""
        forms = passages(text)
        if not forms:
            return -99.0, ""
        s = self.score(forms)
        k = int(s.argmax())
        return float(s[k]), forms[k]


class _Bag:
    """Features of a list of forms, ready for repeated scoring and gradients."""

    def __init__(self, forms: list[str]):
        self.index, self.starts = features(forms) if forms else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.sizes = np.diff(np.append(self.starts, len(self.index)))
        self.scale = 1 / np.sqrt(np.maximum(self.sizes, 1))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.index], self.starts) * self.scale if len(self.sizes) else np.zeros(0)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(g * self.scale, self.sizes), minlength=1 << BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def non_negative_pu(
    p: _Bag, pw: np.ndarray, u: _Bag, uw: np.ndarray, prior: float, share: float = 0.5, steps: int = 120, rate: float = 0.03, decay: float = 1e-4,
    start: tuple[np.ndarray, float] | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise  s R+_p + (1 - s) / (1 - prior) max(0, R-_u - prior R-_p)  with the logistic loss.

    ``pw`` and ``uw`` are weights of the examples that sum to 1; ``share`` (s) is the
    part of positives the boundary is set for, since real ones are few. Where the
    corrected negative risk falls below zero, the step undoes it instead (the
    estimator's non-negative form), so that the positives among the unlabelled
    aren't fitted as negatives.
    """
    w, b = (start[0].copy(), start[1]) if start else (np.zeros(1 << BITS), 0.0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    c = (1 - share) / (1 - prior)
    for t in range(1, steps + 1):
        sp, su = p.scores(w) + b, u.scores(w) + b
        minus = float((uw * np.logaddexp(0, su)).sum() - prior * (pw * np.logaddexp(0, sp)).sum())
        gu, gp = c * uw * _sigmoid(su), c * prior * pw * _sigmoid(sp)
        if minus >= 0:
            dp, du = -share * pw * _sigmoid(-sp) - gp, gu
        else:
            dp, du = gp, -gu
        g = np.append(p.gradient(dp) + u.gradient(du) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def mixture_share(p: np.ndarray, u: np.ndarray, least: float = 0.25) -> float:
    """The share of positives among unlabelled scores ``u``, from scores ``p`` of positives.

    Above any score the unlabelled hold at least the share times what the positives
    hold, so every quotient of the two is too high by what others score as high; the
    lowest is taken of those above which at least ``least`` of the positives lie. No
    bound is set on it but 1.
    """
    p, u = np.sort(p), np.sort(u)
    at = np.unique(p)
    qp, qu = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    use = qp >= min(least, float(qp.max()))
    return float(min((np.maximum(qu, 0.5 / len(u)) / qp)[use].min(), 1.0))


#: Edges of the counted document scores.
_GRID = np.linspace(-8.0, 8.0, 1601)


def threshold(p: np.ndarray, u: np.ndarray, counts: np.ndarray) -> float:
    """The document score above which F1 is greatest.

    ``p`` and ``u`` are held-out scores of confirmed and of unlabelled documents;
    ``counts[i]`` of all documents score in cell i of a fixed grid. Recall is that
    among the confirmed; the share of true cases is read off ``u`` where half of the
    confirmed are found and nearly nothing else. Of thresholds about as good the
    lowest is taken, at most 1 below and 2 above the classifier's own boundary at 0.
    Without confirmed documents nothing is above it.
    """
    return counted_threshold(p, u if len(p) == 0 else np.array([(u <= np.median(p)).sum(), (u > np.median(p)).sum()]), counts)


def counted_threshold(p: np.ndarray, halves: np.ndarray, counts: np.ndarray) -> float:
    """``threshold`` where ``halves`` says how many unlabelled documents score up to the median of ``p`` and above."""
    if not len(p) or not halves.sum() or not counts.sum():
        return math.inf
    p = np.sort(p)
    over = 1 - np.cumsum(counts) / counts.sum()  # above the right edge of a cell
    at = _GRID[1:]
    hit = 1 - np.searchsorted(p, at, side="right") / len(p)
    base = max(float(halves[1] / halves.sum()) / 0.5, 1 / float(halves.sum()))
    gain = hit / (base + over)
    use = (at <= max(np.median(p), -1.0)) & (at >= -1.0) & (at <= 2.0)
    return float(at[use & (gain >= gain[use].max() * 0.98)].min())


def cells(scores: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
    """How many scores lie in each cell of the grid, each as often as it has copies; those beyond it count in the outermost."""
    at = np.clip(np.searchsorted(_GRID, scores, side="left") - 1, 0, len(_GRID) - 2)
    return np.bincount(at, weights=copies, minlength=len(_GRID) - 1).astype(np.int64)


def fit(positive: list[str], unlabelled: list[str], turns: int = 4, prior: float = 0.002) -> Model:
    """A model from texts of confirmed cases and unlabelled texts; the order of either doesn't matter much.

    Copies of a text count once, and so does a passage, however many unlabelled texts
    hold it. Both kinds of texts are halved; each turn trains one model per half and
    scores the other half with it. Of a positive document the passage with the best
    held-out score is taken for the reason of its label, weighted by how likely it
    is: a wrong label finds no support in the other half. The class prior is estimated
    anew from the held-out scores of both. The last model is trained on all. Without
    positives the model finds nothing.
    """
    return fit_passages([b for b in (passages(t) for t in dict.fromkeys(positive)) if b], [b for b in (passages(t) for t in dict.fromkeys(unlabelled)) if b], turns, prior)


def fit_passages(bags: list[list[str]], docs: list[list[str]], turns: int = 4, prior: float = 0.002) -> Model:
    """``fit`` for the passages of distinct confirmed and unlabelled texts, none of them empty."""
    if len(bags) < 2 or len(docs) < 2:
        return Model(np.zeros(1 << BITS), 0.0, prior, np.zeros(0), np.zeros(0))
    half_p, half_u = np.arange(len(bags)) % 2, np.arange(len(docs)) % 2
    counts = [Counter(f for b, h in zip(docs, half_u) if h == k for f in b) for k in (0, 1)]
    common = counts[0] + counts[1]
    pool = sorted({f for b in bags for f in b})
    at = {f: i for i, f in enumerate(pool)}
    every = _Bag(pool)

    def even(c: Counter) -> tuple[_Bag, np.ndarray]:
        return _Bag(list(c)), np.full(len(c), 1 / len(c))

    u = [even(c) for c in counts]
    # what many unlabelled texts hold is seldom the reason for a label: a start, which held-out scores correct
    rare = np.array([1 / (1 + common[f]) for f in pool])
    chosen = [[(at[f], rare[at[f]] ** 2 / len(bag) ** 0.5) for f in bag] for bag in bags]

    def weights(which: np.ndarray) -> tuple[_Bag, np.ndarray]:
        total: dict[int, float] = {}
        for b in which:
            for i, s in chosen[b]:
                total[i] = max(total.get(i, 0.0), s) if len(chosen[b]) == 1 else total.get(i, 0.0) + s
        keep = [i for i, s in total.items() if s > 1e-3] or list(total)
        w = np.array([total[i] for i in keep])
        return _Bag([pool[i] for i in keep]), w / w.sum()

    model: list[tuple[np.ndarray, float] | None] = [None, None]
    best_p = np.zeros(len(bags))
    for _ in range(turns):
        shares = []
        for k in (0, 1):
            model[k] = non_negative_pu(*weights(np.flatnonzero(half_p == k)), *u[k], prior, start=model[k], steps=80 if model[k] else 120)
        for k in (0, 1):
            w, b = model[1 - k]
            scores = every.scores(w) + b
            for i in np.flatnonzero(half_p == k):
                j = max((at[f] for f in bags[i]), key=lambda j: scores[j])
                best_p[i] = scores[j]
                chosen[i] = [(j, float(rare[j]) * float(_sigmoid(np.array(2 * scores[j] + 1))))]
            shares.append(mixture_share(best_p[half_p == k], u[k][0].scores(w) + b))
        prior = float(np.mean(shares))
    best_u = np.zeros(len(docs))
    for k in (0, 1):
        w, b = model[1 - k]
        scores = dict(zip(counts[k], u[k][0].scores(w) + b))
        for i in np.flatnonzero(half_u == k):
            best_u[i] = max(scores[f] for f in docs[i])
    w, b = non_negative_pu(*weights(np.arange(len(bags))), *even(common), prior)
    return Model(w.astype(np.float32), b, prior, best_p, best_u)


def training_sample(docs: DataFrame, labels: DataFrame, reviewed: int = MAX_REVIEWED, unlabelled: int = MAX_UNLABELLED, most: int = MAX_BYTES) -> tuple[dict[str, str], dict[str, str]]:
    """Texts by doc_id (as text) of confirmed cases and of unreviewed documents, each a bounded sample by hash of doc_id.

    Confirmed are documents all of whose reviews name a kind of content; reviews of
    null documents or categories don't count. A sample takes whole texts in the order
    of the hash while they fit into ``most`` bytes; one of more than a tenth of that is
    passed over. For looking at texts: no model, count or threshold comes from it.
    """
    says = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull())
    confirmed = says.groupBy("doc_id").agg(F.every(F.col("category") != "none").alias("yes"))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes"))
    texts = texts.where(F.col("bytes") <= most // 10)

    def take(df: DataFrame, seed: int, n: int) -> dict[str, str]:
        h = F.xxhash64(F.lit(seed), "doc_id")
        first = df.orderBy(h, "doc_id").limit(n)
        # a window over at most n rows
        run = F.sum("bytes").over(Window.orderBy(h, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        rows = first.withColumn("run", run).where(F.col("run") <= most).select("doc_id", "text").collect()
        return {str(r["doc_id"]): r["text"] for r in rows}

    known = take(texts.join(confirmed.where("yes"), "doc_id"), 1, reviewed)
    return known, take(texts.join(confirmed, "doc_id", "left_anti"), 2, unlabelled)


def reviews(labels: DataFrame) -> DataFrame:
    """(doc_id, yes) of reviewed documents: whether all reviews name a kind of content; those of null documents or categories don't count."""
    says = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull())
    return says.groupBy("doc_id").agg(F.every(F.col("category") != "none").alias("yes"))


def training_shares(docs: DataFrame, labels: DataFrame, reviewed: int = SHARE_REVIEWED, unlabelled: int = SHARE_UNLABELLED, most: int = SHARE_BYTES) -> tuple[DataFrame, int]:
    """(share, confirmed, text, n), and the number of shares: every distinct text of a confirmed or an unreviewed document with its number of copies, by hash in shares that a task can fit.

    No text is left out. An unlabelled text is in one share, a confirmed one in as many as
    its group of about ``reviewed`` meets; there are at least as many shares as groups.
    """
    says = reviews(labels)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")

    def once(df: DataFrame, name: str) -> DataFrame:
        return materialize(df.groupBy("text").agg(F.count("*").alias("n")), name)

    known, others = once(texts.join(says.where("yes"), "doc_id", "left_semi"), "confirmed"), once(texts.join(says, "doc_id", "left_anti"), "unlabelled")
    size = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()
    k, u = size(known), size(others)
    groups = max(1, math.ceil(k["n"] / reviewed), math.ceil(k["b"] / most))
    shares = max(groups, math.ceil(u["n"] / unlabelled), math.ceil(u["b"] / most))
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(at(1, groups), F.lit(shares - 1), F.lit(groups)))
    confirmed = known.select(every.alias("share"), F.lit(True).alias("confirmed"), "text", "n")
    return confirmed.unionByName(others.select(at(2, shares).alias("share"), F.lit(False).alias("confirmed"), "text", "n")), shares


_FITTED = "share int, weights binary, bias double, prior double, confirmed array<struct<h: bigint, score: double, n: bigint>>, once array<bigint>, copies array<bigint>"


def _fit_share(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of ``_FITTED``, or none for a share without two texts of either kind."""
    pdf = pdf.sort_values(["h", "text"], kind="stable")
    bags, h, n = [passages(t) for t in pdf["text"]], pdf["h"].tolist(), pdf["n"].tolist()
    is_p = pdf["confirmed"].tolist()
    p, u = ([i for i, b in enumerate(bags) if b and is_p[i] == kind] for kind in (True, False))
    names = ["share", "weights", "bias", "prior", "confirmed", "once", "copies"]
    m = fit_passages([bags[i] for i in p], [bags[i] for i in u])
    if not len(m.confirmed):
        return pd.DataFrame(columns=names)
    held = [{"h": h[i], "score": float(x), "n": n[i]} for i, x in zip(p, m.confirmed)]
    copies = cells(m.others, np.array([n[i] for i in u]))
    row = (int(pdf["share"].iloc[0]), m.weights.tobytes(), m.bias, m.prior, held, cells(m.others).tolist(), copies.tolist())
    return pd.DataFrame([row], columns=names)


def fit_shares(texts: DataFrame, shares: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The mean of the models fitted to each of ``training_shares``, and the unlabelled texts and all documents by cell of their held-out scores.

    A confirmed text's held-out score is its mean over the shares that it is in. Only
    counts by cell of the grid and one model at a time come to the driver.
    """
    # more tasks than shares, so that few have two
    rows = texts.withColumn("h", F.xxhash64("text")).repartition(4 * shares, "share").groupBy("share").applyInPandas(_fit_share, _FITTED)
    fitted = materialize(rows, "models")
    total, bias, prior, n = np.zeros(1 << BITS), 0.0, 0.0, 0
    once, copies = np.zeros(len(_GRID) - 1, dtype=np.int64), np.zeros(len(_GRID) - 1, dtype=np.int64)
    for r in fitted.select("weights", "bias", "prior", "once", "copies").toLocalIterator():
        total += np.frombuffer(r["weights"], dtype=np.float32)
        bias, prior, n = bias + r["bias"], prior + r["prior"], n + 1
        once, copies = once + np.array(r["once"]), copies + np.array(r["copies"])
    if not n:
        return Model(total, 0.0, 0.002, np.zeros(0), np.zeros(0)), once, copies
    held = fitted.select(F.inline("confirmed")).groupBy("h").agg(F.avg("score").alias("score"), F.max("n").alias("n"))
    middle = (_GRID[1:] + _GRID[:-1]) / 2
    p = []
    # at most as many rows as the grid has cells
    for r in held.groupBy(_cell().alias("cell")).agg(F.count("*").alias("texts"), F.sum("n").alias("n")).orderBy("cell").collect():
        p.append(np.full(r["texts"], middle[r["cell"]]))
        copies[r["cell"]] += r["n"]
    return Model((total / n).astype(np.float32), bias / n, prior / n, np.concatenate(p), np.zeros(0)), once, copies


def _cell() -> Column:
    """The cell of the grid that a score lies in; see ``cells``."""
    return F.greatest(F.least(F.ceil((F.col("score") - float(_GRID[0])) * 100) - 1, F.lit(len(_GRID) - 2)), F.lit(0)).cast("int")


_SCORED = "doc_id string, source string, score double, passage string"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score, passage) of every document's whole text.

    ``passage`` is the normal form of the worst passage; null and blank texts have
    score -99 and no passage. One pass, no shuffle; the model is a fixed 1 MB.
    """
    held = docs.sparkSession.sparkContext.broadcast(Model(model.weights, model.bias, model.prior, np.zeros(0), np.zeros(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            forms, owners = [], []
            for i, text in enumerate(pdf["text"]):
                got = passages(text if isinstance(text, str) else None)
                forms += got
                owners += [i] * len(got)
            best, which = np.full(len(pdf), -99.0), np.full(len(pdf), -1)
            # templates repeat: each distinct form is scored once, 20,000 at a time to bound a task's memory
            step = 20_000
            place: dict[str, int] = {}
            at = np.array([place.setdefault(f, len(place)) for f in forms], dtype=np.int64)
            once = list(place)
            all_scores = np.concatenate([m.score(once[k : k + step]) for k in range(0, len(once), step)]) if once else np.zeros(0)
            for k in range(0, len(forms), step):
                s, own = all_scores[at[k : k + step]], np.array(owners[k : k + step])
                order = np.lexsort((-np.arange(len(s)), s, own))
                last = order[np.append(own[order][1:] != own[order][:-1], True)]
                better = s[last] > best[own[last]]
                best[own[last[better]]], which[own[last[better]]] = s[last[better]], last[better] + k
            rows = [forms[w] if w >= 0 else "" for w in which]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": best, "passage": rows})

    # ids travel as text: a null among them would turn a batch's ids into floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    return rows.mapInPandas(run, _SCORED).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, passage, found) of every document, by a model fitted to all reviews and all other documents; see ``score``.

    The threshold comes from the counted scores of all documents; those that the model
    was fitted to count with their held-out scores.
    """
    model, once, counts = fit_shares(*training_shares(docs, labels))
    rows = materialize(score(docs, model), "scores")
    rest = rows.join(reviews(labels).where("NOT yes"), "doc_id", "left_semi")
    # at most as many rows as the grid has cells
    for r in rest.where(F.col("score") > -99).groupBy(_cell().alias("cell")).agg(F.count("*").alias("n")).collect():
        counts[r["cell"]] += r["n"]
    limit = math.inf
    if len(model.confirmed):
        above = int(once[_GRID[1:] > np.median(model.confirmed)].sum())
        limit = counted_threshold(model.confirmed, np.array([once.sum() - above, above]), counts)
    return rows.select("doc_id", "source", "score", "passage", (F.col("score") > limit).alias("found"))


def source_rates(scores: DataFrame) -> DataFrame:
    """(source, documents, found, rate): how many of each source's documents hold such content."""
    n, k = F.count("*"), F.count_if("found")
    return scores.groupBy("source").agg(n.alias("documents"), k.alias("found"), (k / n).alias("rate"))
