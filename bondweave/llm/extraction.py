"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .html_blocks import Block, Place, leaf_blocks
from .labelled_pages import MARK, labelled_pages

TRAIN_PAGES, TRAIN_SEED = 700, 1
MIN_COUNT = 3
ROUNDS, RATE, PENALTY = 150, 0.1, 5e-5

# Signs of notices and legal lines, in the languages of the pages.
LEGAL = ("©", "copyright", "all rights reserved", "cookie")


def _of_place(place: Place | None, known: Container[str] | None) -> frozenset[str]:
    """Features of a chain of ancestors: those of its parent and its own. Only ``known`` ones are kept, if given, so
    that deep pages take no more than the model has."""
    chain = []
    while place and not (place.known and place.known[0] is known):
        chain.append(place)
        place = place.parent
    found = place.known[1] if place else frozenset()
    for p in reversed(chain):
        own = [f for f in (f"in:{p.tag}", *(f"name:{n}" for n in p.names)) if known is None or f in known]
        if not found.issuperset(own):
            found = found.union(own)
        p.known = known, found
    return found


def block_features(b: Block, previous: Block | None, known: Container[str] | None = None) -> list[str]:
    n, words = len(b.text), b.text.count(" ") + 1
    linked = b.linked / n
    low = b.text.lower()
    inner, major = (b.place.inner, b.place.major) if b.place else ((), ())
    found = sorted(_of_place(b.place, known))
    found += [f"parent:{inner[-1] if inner else 'none'}", f"parents:{'>'.join(inner)}", f"major:{'>'.join(major)}"]
    found.append("words:%d" % min(6, words.bit_length()))
    found.append("linked:%d" % min(3, int(linked * 3.99)))
    found.append("ends:" + ("stop" if b.text[-1] in ".!?…:" else "comma" if b.text[-1] in ",;" else "open"))
    if any(s in low for s in LEGAL):
        found.append("legal")
    found.append("same-place" if previous and previous.place is b.place else "new-place")
    return found


@dataclass(frozen=True)
class Crf:
    """Weights of features for main text (against none), of the first block, and of steps between labels."""

    weights: dict[str, float]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks (Viterbi)."""
        if not blocks:
            return []
        get, ((s00, s01), (s10, s11)) = self.weights.get, self.step
        back: list[tuple[bool, bool]] = []
        a = b = 0.0
        previous = None
        for block in blocks:
            e = sum(get(f, 0.0) for f in block_features(block, previous, self.weights))
            if previous is None:
                a, b = self.start[0], self.start[1] + e
            else:
                back.append((b + s10 > a + s00, b + s11 > a + s01))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
            previous = block
        label = b > a
        labels = [label]
        for steps in reversed(back):
            label = steps[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[list[tuple[Block, bool]]]) -> Crf:
    """Maximise the penalised likelihood of labelled pages by forward-backward and Adam, all pages at a time."""
    rows, labels, lengths = [], [], []
    for page in pages:
        previous = None
        for block, label in page:
            rows.append(block_features(block, previous))
            labels.append(label)
            previous = block
        lengths.append(len(page))
    counts = Counter(f for r in rows for f in set(r))
    names = sorted(f for f, c in counts.items() if c >= MIN_COUNT)
    number = {f: i for i, f in enumerate(names)}
    n, t = len(lengths), max(lengths)
    x = np.zeros((n, t, len(names)), np.float32)
    y, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
    it = iter(zip(rows, labels))
    for i, length in enumerate(lengths):
        for k in range(length):
            row, label = next(it)
            x[i, k, [number[f] for f in row if f in number]] = 1
            y[i, k], mask[i, k] = label, True
    flat, total = x.reshape(n * t, -1), mask.sum()
    w, start, step = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    params = [w, start, step]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for round_ in range(1, ROUNDS + 1):
        e = np.zeros((n, t, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, t)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = start + e[:, 0]
        for k in range(1, t):
            new = np.logaddexp(alpha[:, k - 1, :1] + step[0], alpha[:, k - 1, 1:] + step[1]) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            ahead = e[:, k + 1] + beta[:, k + 1]
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        truth = np.stack([(y == 0) & mask, (y == 1) & mask], axis=2)
        pair = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        grads = [
            flat.T @ (p[:, :, 1] - truth[:, :, 1]).reshape(-1).astype(np.float32) / total + PENALTY * w,
            (p[:, 0] - truth[:, 0]).sum(axis=0) / total + PENALTY * start,
            (pair.sum(axis=(0, 1)) - seen) / total + PENALTY * step,
        ]
        for q, g, m, s in zip(params, grads, moment, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            q -= RATE * (m / (1 - 0.9**round_)) / (np.sqrt(s / (1 - 0.999**round_)) + 1e-8)
    return Crf(dict(zip(names, w.tolist())), tuple(start.tolist()), tuple(map(tuple, step.tolist())))


def labelled_blocks(pages: list[str]) -> list[list[tuple[Block, bool]]]:
    """Blocks of pages of ``labelled_pages``, freed of the mark that gives their label."""
    out = []
    for html in pages:
        page = []
        for b in leaf_blocks(html):
            main = b.text.startswith(MARK)
            page.append((Block(b.text.replace(MARK, ""), b.place, b.linked) if main else b, main))
        out.append([x for x in page if x[0].text])
    return [p for p in out if p]


@lru_cache(maxsize=4)
def trained(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Crf:
    return train(labelled_blocks(labelled_pages(n, seed)))


def main_text(html: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(html)
    return " ".join(b.text for b, main in zip(blocks, crf.decode(blocks)) if main)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main blocks, joined by one space.

    The field labels a page's blocks together: features of the ancestors (tags, words of class, id and
    role) and of the text, and weights of steps between labels. Null and empty pages give an empty text.
    Time and memory of a page are in proportion to its length, however broken, long or deeply nested it is.
    Pages are judged one by one, so repeated rows and nulls elsewhere need nothing special; other columns
    are not read, whatever their names.
    """
    crf = crf or trained()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [main_text(h, crf) for h in pdf["html"]]
            yield pdf.drop(columns="html").assign(text=found, n_chars=[len(t) for t in found])

    return pages.select("page_id", "url", "html").mapInPandas(texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
