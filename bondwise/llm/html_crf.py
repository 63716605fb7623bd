"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of their DOM.

A block is either part of the article or not. Its score is a sum of weights of ancestor-tag and text features; a weight for each pair of
neighbouring labels joins them. Weights maximise the penalised likelihood of labelled pages, with marginals from the forward-backward
recursion; pages are decoded by Viterbi. Training runs on ``PAGES`` labelled pages, a fixed number, and the weights are broadcast.

Nulls and edges: a null or empty page and one without article blocks give the empty string; truncated pages and tags left open are read as far
as they go; pages of any length are read whole; repeated rows are read one by one; an empty table gives no rows; other columns pass through,
except ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import functools
import html
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.llm.html_blocks import Block, blocks, path_features, text_features
from bondwise.llm.html_pages import labelled

PAGES, SEED, EPOCHS, RATE, PENALTY = 2000, 11, 12, 0.3, 1e-4


class Crf:
    """Two labels: 0 outside, 1 in the article. ``weights`` hold what a feature adds to label 1; ``step[a][b]`` what going from a to b adds."""

    def __init__(self, weights: dict[str, float], step: list[list[float]]):
        self.weights, self.step = weights, step
        self.paths: dict[tuple, float] = {}

    def emission(self, block: Block, k: int, n: int) -> float:
        path = self.paths.get(block.path)
        if path is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            path = self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
        return path + self.weights.get("bias", 0.0) + sum(self.weights.get(f, 0.0) for f in text_features(block, k, n))

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: the label sequence of the highest score."""
        if not found:
            return []
        (a00, a01), (a10, a11) = self.step
        n = len(found)
        out, inside, back = 0.0, self.emission(found[0], 0, n), []
        for k in range(1, n):
            e = self.emission(found[k], k, n)
            from_out, from_in = out + a00, inside + a10
            to_out, to_in = out + a01, inside + a11
            back.append((from_in > from_out, to_in > to_out))
            out, inside = max(from_out, from_in), e + max(to_out, to_in)
        label = inside > out
        labels = [label]
        for to_out, to_in in reversed(back):
            label = to_in if label else to_out
            labels.append(label)
        return labels[::-1]


def marginals(e: list[float], step: np.ndarray) -> tuple[list[float], np.ndarray, float]:
    """P(label 1) of each block, expected transitions, and the log of the partition sum."""
    n = len(e)
    t = np.exp(step).tolist()
    forward, scale = [], []
    a, b = 1.0, math.exp(min(e[0], 500.0))
    for k in range(n):
        if k:
            w = math.exp(min(e[k], 500.0))
            a, b = a * t[0][0] + b * t[1][0], (a * t[0][1] + b * t[1][1]) * w
        s = a + b
        a, b = a / s, b / s
        forward.append((a, b))
        scale.append(s)
    p, pairs = [0.0] * n, np.zeros((2, 2))
    x, y = 1.0, 1.0
    for k in range(n - 1, -1, -1):
        fa, fb = forward[k]
        total = fa * x + fb * y
        p[k] = fb * y / total
        if k:
            w = math.exp(min(e[k], 500.0))
            ga, gb = forward[k - 1]
            z = np.array([[ga * t[0][0] * x, ga * t[0][1] * w * y], [gb * t[1][0] * x, gb * t[1][1] * w * y]])
            pairs += z / z.sum()
            x, y = (t[0][0] * x + t[0][1] * w * y) / scale[k], (t[1][0] * x + t[1][1] * w * y) / scale[k]
    return p, pairs, float(sum(map(math.log, scale)))


def training_rows(pages: list[tuple[str, list[tuple[str, bool]]]]) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of each page's blocks. A page with a block that its plan does not know is an error of the plan."""
    out = []
    for page, labels in pages:
        found = blocks(page)
        known: dict[str, list[bool]] = {}
        for text, main in labels:
            known.setdefault(" ".join(html.unescape(text).split()), []).append(main)
        strange = [b.text for b in found if b.text not in known]
        if strange:
            raise ValueError(f"unknown block {strange[0]!r} in {page!r}")
        if found:
            feats = [["bias", *path_features(b.path), *text_features(b, k, len(found))] for k, b in enumerate(found)]
            # equal texts are taken in the order of the plan
            out.append((feats, [known[b.text].pop(0) if len(known[b.text]) > 1 else known[b.text][0] for b in found]))
    return out


@functools.cache
def train(pages: int = PAGES, seed: int = SEED, epochs: int = EPOCHS) -> Crf:
    """AdaGrad on the log-likelihood of each page in turn."""
    rows = training_rows(labelled(pages, seed))
    names = {f: k for k, f in enumerate(sorted({f for feats, _ in rows for block in feats for f in block}))}
    data = [([np.array([names[f] for f in block]) for block in feats], labels) for feats, labels in rows]
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    step, step_seen = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            feats, labels = data[at]
            p, pairs, _ = marginals([float(w[f].sum()) for f in feats], step)
            grad = np.zeros(len(names))
            for f, label, prob in zip(feats, labels, p, strict=True):
                np.add.at(grad, f, float(label) - prob)
            grad -= PENALTY * w
            seen += grad**2
            w += RATE * grad / np.sqrt(seen)
            own = np.zeros((2, 2))
            for a, b in zip(labels, labels[1:], strict=False):
                own[int(a), int(b)] += 1
            change = own - pairs - PENALTY * step
            step_seen += change**2
            step += RATE * change / np.sqrt(step_seen)
    return Crf({f: float(w[k]) for f, k in names.items()}, step.tolist())


def extract_page(page: str, model: Crf) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """``pages`` (column ``html``) with ``text`` instead of the markup, and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    out = pages.select(*[F.col(f"`{c}`") for c in kept], F.col("html").cast("string").alias("text"), F.lit(None).cast("long").alias("n_chars"))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [extract_page(v.as_py() or "", own) for v in batch.column(batch.num_columns - 2)]
            new = [pa.array(texts, batch.schema.field("text").type), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], schema=batch.schema)

    return out.mapInArrow(run, schema)
