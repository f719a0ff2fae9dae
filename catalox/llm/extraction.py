"""Main text of pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

The trees are trained on pages of many generated layouts whose regions are known;
the fitted ones are kept beside this module (``trees.json``, written by :func:`save`),
so that a query reads them and does not fit again.
A page's node is likely content or not by its subtree's density, its attribute
words, its depth and its siblings. Decoding takes the labelling of greatest
likelihood in which nothing below a dropped node is kept, a child being as its
parent unless its odds speak clearly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalox.llm.common import chunks
from catalox.llm.dom import Page, features
from catalox.llm.layouts import training_page

#: Generated pages that the trees learn from, rounds and depth of the trees.
TRAINING_PAGES, TREES, DEPTH, SEED = 1500, 60, 6, 3
#: Log-odds that it costs to drop a child of a kept node.
SWITCH = 1.0
FITTED = Path(__file__).with_name("trees.json")
#: HTML handled at a time.
CHUNK = 2 << 20


class Trees:
    """A boosted model as arrays: node tables of all trees side by side."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, weight: np.ndarray, depth: int):
        self.feature, self.threshold, self.left, self.right, self.value, self.weight, self.depth = feature, threshold, left, right, value, weight, depth

    @classmethod
    def from_spark(cls, model: GBTClassificationModel) -> Trees:
        tables, depth = [], 0
        for tree in model.trees:
            rows: list[list] = []

            def walk(node, level: int, rows=rows) -> int:
                nonlocal depth
                depth, at = max(depth, level), len(rows)
                rows.append([0, np.inf, at, at, node.prediction()])
                if node.subtreeDepth():
                    split = node.split()
                    rows[at][:2] = split.featureIndex(), split.threshold()
                    rows[at][2] = walk(node.leftChild(), level + 1)
                    rows[at][3] = walk(node.rightChild(), level + 1)
                return at

            walk(tree._call_java("rootNode"), 0)
            tables.append(rows)
        wide = max(len(t) for t in tables)
        full = np.array([t + [[0, np.inf, i, i, 0.0] for i in range(len(t), wide)] for t in tables], float)
        return cls(full[..., 0].astype(int), full[..., 1], full[..., 2].astype(int), full[..., 3].astype(int), full[..., 4], np.array(model.treeWeights), depth)

    def to_json(self) -> str:
        """One line for each tree: its weight and its nodes as [feature, threshold, left, right, value]; a leaf leads to itself."""
        nodes = lambda t: [[int(f), None if np.isinf(c) else float(f"{c:.9g}"), int(a), int(b), float(f"{v:.7g}")] for f, c, a, b, v in zip(self.feature[t], self.threshold[t], self.left[t], self.right[t], self.value[t], strict=True)]
        lines = [json.dumps([float(w), nodes(t)], separators=(",", ":")) for t, w in enumerate(self.weight)]
        return f"[{self.depth},\n" + ",\n".join(lines) + "]\n"

    @classmethod
    def from_json(cls, text: str) -> Trees:
        depth, *trees = json.loads(text)
        full = np.array([[[np.inf if x is None else x for x in node] for node in nodes] for _, nodes in trees], float)
        return cls(full[..., 0].astype(int), full[..., 1], full[..., 2].astype(int), full[..., 3].astype(int), full[..., 4], np.array([w for w, _ in trees]), depth)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Twice the margin of each row, the log of p / (1 - p)."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.weight)):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[t][node]] <= self.threshold[t][node], self.left[t][node], self.right[t][node])
            out += self.weight[t] * self.value[t][node]
        return 2 * out


def labelled_nodes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of ``n`` generated pages; a node has the mark of its nearest marked ancestor."""
    pages = [Page(training_page(np.random.default_rng([seed, i])), marked=True) for i in range(n)]
    labels = []
    for p in pages:
        own = [1] * len(p.tag)
        for i, (mark, parent) in enumerate(zip(p.mark, p.parent, strict=True)):
            own[i] = mark if mark >= 0 else own[parent] if parent >= 0 else 1
        labels += own
    return features(pages), np.array(labels, float)


def train(spark: SparkSession, pages: int = TRAINING_PAGES, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Trees:
    """Boosted trees fitted on ``pages`` generated pages."""
    x, y = labelled_nodes(pages, seed)
    rows = spark.createDataFrame([(r, float(v)) for r, v in zip(x.tolist(), y, strict=True)], "x array<double>, label double").select("label", array_to_vector("x").alias("features")).coalesce(4).cache()
    try:
        return Trees.from_spark(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=seed).fit(rows))
    finally:
        rows.unpersist()


def save(trees: Trees) -> None:
    FITTED.write_text(trees.to_json())


@lru_cache(maxsize=1)
def fitted() -> Trees:
    """The trees that :func:`train` fits with its default parameters, as saved."""
    return Trees.from_json(FITTED.read_text())


def decode(pages: list[Page], odds: np.ndarray, switch: float = SWITCH) -> list[list[bool]]:
    """For each page which nodes are kept: of the sets closed towards the root that with the greatest sum of log-odds, less ``switch`` for each dropped child of a kept node."""
    kept, start = [], 0
    for p in pages:
        n = len(p.tag)
        gain = odds[start : start + n].tolist()
        start += n
        for i in range(n - 1, 0, -1):  # children after parents, so from the back each gain is complete
            gain[p.parent[i]] += max(gain[i], -switch)
        keep = [True] * n
        for i in range(1, n):
            keep[i] = keep[p.parent[i]] and gain[i] > -switch
        keep[0] = gain[0] > 0
        kept.append(keep if keep[0] else [False] * n)
    return kept


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [Page(h or "") for h in pages]
    if not parsed:
        return []
    kept = decode(parsed, trees.log_odds(features(parsed)))
    return ["\n\n".join(t for node, t in p.blocks if k[node]) for p, k in zip(parsed, kept, strict=True)]


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks of the main text in page order, joined by an empty line; white space
    inside a block is one space. A null or empty page has the empty text. Rows
    without an id and rows that repeat one are returned each. Broken markup is read
    as far as it goes: open elements end with the page, and a skipped element without
    an end tag is skipped alone, but for script, style, textarea and title, which
    take the rest. Pages of any length or depth are read whole in time that follows
    their length. A node whose odds are even goes. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    model = trees or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", CHUNK):
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
