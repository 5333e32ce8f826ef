"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
MIN_WORDS = 50
MAX_REPEAT = 0.5

#: Labelled documents that the forest and the threshold are fitted on, at most; taken by hash of id.
MAX_LABELLED = 4_000
#: Shares well below this look alike.
LEAST_SHARE = 0.01
TREES, SUBSAMPLE, DEPTH = 100, 256, 12
#: What a labelled good row lost costs beside a bad row missed, and the share of good rows that may be lost.
LOSS, MAX_LOST = 10, 0.005

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_upper", "n_marks", "n_lines", "n_distinct")
#: Length and digits are left out: long texts and texts with numbers are rare, but not worse for it.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "marks")


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text; null counts as empty.

    n_repeat_words is the number of words inside some 3-word window that occurs twice or more, its first
    occurrence included; each word counts once.
    """
    text = text or ""
    words = text.encode().split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    covered = 0
    if n >= 4:
        k = len(numbers)
        # Windows by number: pairs first, so that the product stays within 64 bits for any text.
        _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1].astype(np.int64) * k + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        if again.any():
            inside = np.zeros(n, bool)
            for o in range(3):
                inside[o : n - 2 + o] |= again
            covered = int(inside.sum())
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    spaces = sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    marks = sum(text.count(c) for c in "!?\"'()[]{}=@_^~/\\`+;:")
    ascii_ = np.frombuffer(text.encode(), np.uint8)
    upper = int(((ascii_ >= 65) & (ascii_ <= 90)).sum())
    return n, len(text) - spaces, symbols, dup, covered, len(text), upper, marks, len(lines), len(numbers)


def features(c: pd.DataFrame) -> np.ndarray:
    """One row of FEATURES for each row of COUNTS. Shares are on a log scale, on which small ones differ clearly."""
    words, chars = np.maximum(c["n_words"].to_numpy(float), 1), np.maximum(c["word_chars"].to_numpy(float), 1)

    def share(name: str, of: np.ndarray) -> np.ndarray:
        return np.log(c[name].to_numpy(float) / of + LEAST_SHARE)

    cols = (
        np.log(chars / words),
        share("n_symbols", words),
        share("n_dup_lines", np.maximum(c["n_lines"].to_numpy(float), 1)),
        share("n_repeat_words", words),
        share("n_upper", chars),
        share("n_marks", chars),
    )
    return np.column_stack(cols)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: for each node the split feature (-1 in a leaf), split value, children, and path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 to the minus mean path length over its expectation."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, lo, hi, d in zip(self.feature, self.value, self.left, self.right, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                on = f[node]
                inner = on >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(on, 0)] < v[node]
                node = np.where(inner, np.where(go, lo[node], hi[node]), node)
            total += d[node]
        return 2.0 ** (-(total / len(self.feature)) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(good: np.ndarray, everything: np.ndarray, seed: int = 5) -> Forest:
    """Random splits of the box that all labelled rows span; path lengths count the good rows.

    Split values are uniform over the node's box rather than over its rows, so features on which all
    good rows agree still separate rows that stray from them.
    """
    rng = np.random.default_rng(seed)
    low, high = everything.min(axis=0), everything.max(axis=0)
    size = min(SUBSAMPLE, len(good))
    trees = []
    for _ in range(TREES):
        nodes: list[list[float]] = []
        stack = [(good[rng.choice(len(good), size, replace=False)], low.copy(), high.copy(), 0, -1, 0)]
        while stack:
            x, lo, hi, depth, parent, side = stack.pop()
            here = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _expected(len(x))])
            if parent >= 0:
                nodes[parent][2 + side] = here
            wide = np.flatnonzero(hi > lo)
            if depth >= DEPTH - 1 or len(x) <= 1 or not len(wide):
                continue
            f = int(rng.choice(wide))
            v = float(rng.uniform(lo[f], hi[f]))
            nodes[here][:2] = [f, v]
            below = x[:, f] < v
            for s, part, bound in ((0, x[below], hi), (1, x[~below], lo)):
                l2, h2 = lo.copy(), hi.copy()
                (h2 if bound is hi else l2)[f] = v
                stack.append((part, l2, h2, depth + 1, here, s))
        trees.append(np.array(nodes))
    width = max(map(len, trees))
    packed = np.zeros((TREES, width, 5))
    packed[:, :, 0] = -1
    for i, t in enumerate(trees):
        packed[i, : len(t)] = t
    ints = packed[:, :, [0, 2, 3]].astype(np.int64)
    return Forest(ints[:, :, 0], packed[:, :, 1], ints[:, :, 1], ints[:, :, 2], packed[:, :, 4], _expected(size) or 1.0)


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray) -> Forest:
    """Set the threshold where the share of bad rows caught, less LOSS times that of good rows lost, is highest.

    A good row lost weighs as LOSS bad rows missed (by shares), and MAX_LOST of the good rows at most may
    go. The middle of the gap is taken, so that the threshold does not touch the rows it was read from.
    """
    g, b = np.sort(forest.score(good)), np.sort(forest.score(bad))
    seen = np.unique(np.concatenate((g, b)))
    cuts = np.append((seen[:-1] + seen[1:]) / 2, seen[-1] + 1)
    lost, caught = 1 - np.searchsorted(g, cuts) / len(g), 1 - np.searchsorted(b, cuts) / len(b)
    gain = np.where(lost <= MAX_LOST, caught - LOSS * lost, -1)
    return Forest(**{**forest.__dict__, "threshold": float(cuts[gain.argmax()])})


def _counts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = pd.DataFrame([statistics(t) for t in pdf["text"]], columns=list(COUNTS))
        yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), counts], axis=1)


_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 5) -> Forest | None:
    """The forest and its threshold from at most ``max_labelled`` labelled documents (the least by hash of id).

    Contradicting labels of one id count as bad; without a good and a bad document no verdict is given.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    spark = docs.sparkSession
    picked = ids.toPandas()
    if picked.empty:
        return None
    small = F.broadcast(spark.createDataFrame(picked))  # max_labelled rows of two numbers at most
    counted = docs.select("doc_id", "text").join(small, "doc_id").mapInPandas(_counts_of, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, quality int, {_SCHEMA}")
    # An id may have many rows: of these too a sample by hash, over all ids alike.
    rows = counted.distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id", *COUNTS), "doc_id", *COUNTS).limit(2 * max_labelled).toPandas()
    if rows.empty:
        return None
    x, good = features(rows), rows["quality"].to_numpy() > 0
    passes = ~base_failed(rows)
    if not (good & passes).any() or not (~good & passes).any():
        return None
    x, good = x[passes], good[passes]
    return calibrate(grow(x[good], x, seed), x[good], x[~good])


def base_failed(c: pd.DataFrame) -> np.ndarray:
    return ((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 100 * MAX_REPEAT * c["n_words"])).to_numpy()


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of every document.

    A text fails the base rules with fewer than 50 words, or over half of them in repeated 3-word
    windows; what passes is kept unless its anomaly score lies above the threshold. Null and empty texts
    have no words and fail. Without usable labels only the base rules decide. Rows are judged one by one,
    so repeated rows, null ids and texts of any length need nothing special; an empty table gives no rows.
    """
    forest = fit(docs, labels, max_labelled)

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _counts_of(batches):
            failed = base_failed(c)
            score = forest.score(features(c)) if forest and len(c) else np.zeros(len(c))
            cut = forest.threshold if forest else np.inf
            yield c.assign(base_failed=failed, score=score, kept=~failed & (score <= cut))

    return docs.select("doc_id", "text").mapInPandas(verdicts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that ``judge`` keeps, in one pass and with all their columns."""
    forest = fit(docs, labels, max_labelled)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        c = pd.DataFrame([statistics(t) for t in text], columns=list(COUNTS))
        score = forest.score(features(c)) if forest and len(c) else np.zeros(len(c))
        return pd.Series(~base_failed(c) & (score <= (forest.threshold if forest else np.inf)))

    return docs.where(kept("text"))
