"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Boosted shallow trees are grown on statistics of labelled texts; every path from a root becomes a conjunctive rule. A lasso
logistic regression over the rules and the (winsorised) statistics keeps few of them; what it keeps is a sum of CASE
expressions that Spark evaluates in its own code. Statistics are computed in numpy over Arrow buffers, whole texts always.

Training reads at most MOST_ROWS labelled rows, those with the least hash of their id; scoring reads every row. Labels, lang,
source and ids are never inputs of a score.

Nulls and edges: null text counts as empty and gets a score (all statistics are 0); a null id is passed on, its remainder is that
of the empty string; labels that are null, and labels without a document, are left out; repeated labels count each; without labels
of both classes every score is their share (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import Words, blocks, column, segment_hash, small, text_buffer

#: Labelled rows that training reads at most; those with the least hash of their id.
MOST_ROWS = 10_000
THRESHOLD = 0.7
STATS = ("n_words", "mean_word", "upper_share", "symbol_share", "punct_share", "digit_share", "bar_share", "dup_line_share", "dup_word_share", "mean_line", "tail_share", "end_share", "top_word_share")

_IS = {
    "upper_share": np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "symbol_share": np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~=_@")),
    "punct_share": np.isin(np.arange(256), list(b".,;:!?\"'()-")),
    "digit_share": np.isin(np.arange(256), list(b"0123456789")),
}
_END = np.isin(np.arange(256), list(b".!?"))
_ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")) | (np.arange(256) > 127)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS per text."""
    out = []
    whole, offs = text_buffer(texts)
    for i, j in blocks(offs):
        buf, off = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        w = Words(buf, off)
        docs_of, counts = w.docs(), w.counts.astype(float)
        some = np.maximum(counts, 1)
        lens = w.end - w.start
        chars = np.bincount(docs_of, lens, n)
        each = {"n_words": np.log1p(counts), "mean_word": chars / some}
        for name, table in _IS.items():
            upto = np.concatenate([[0], np.cumsum(table[buf])])
            each[name] = np.diff(upto[off]) / np.maximum(chars, 1)
        alone = (lens == 1) & ~_ALNUM[buf[w.start]]
        each["bar_share"] = np.bincount(docs_of[alone], minlength=n) / some
        tail = np.zeros(len(lens), bool)
        two = lens > 2
        tail[two] = ~_ALNUM[buf[w.end[two] - 1]] & ~_ALNUM[buf[w.end[two] - 2]]
        each["tail_share"] = np.bincount(docs_of[tail], minlength=n) / some
        each["end_share"] = np.bincount(docs_of[_END[buf[w.end - 1]]], minlength=n) / some if len(lens) else np.zeros(n)
        # repeated words next to each other, and the commonest word
        h = w.hashes()
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (docs_of[1:] == docs_of[:-1])
        each["dup_word_share"] = np.bincount(docs_of[same], minlength=n) / some
        order = np.lexsort((h, docs_of))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(docs_of[order]) != 0)])) if len(h) else np.zeros(0, np.int64)
        run = np.diff(np.append(first, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, docs_of[order][first], run)
        each["top_word_share"] = top / some
        # lines that hold a word
        nl = np.concatenate([[0], np.cumsum(buf == 10)])
        if len(lens):
            new = np.ones(len(lens), bool)
            new[1:] = (nl[w.start[1:]] > nl[w.end[:-1]]) | (docs_of[1:] != docs_of[:-1])
            at = np.flatnonzero(new)
            stop = np.append(at[1:], len(lens)) - 1
            lh, ld = segment_hash(buf, w.start[at], w.end[stop]), docs_of[at]
            order = np.lexsort((lh, ld))
            dup = np.zeros(len(at), bool)
            dup[order[1:]] = (np.diff(lh[order]) == 0) & (np.diff(ld[order]) == 0)
            n_lines = np.maximum(np.bincount(ld, minlength=n), 1)
            each["dup_line_share"] = np.bincount(ld[dup], minlength=n) / n_lines
            each["mean_line"] = np.log1p(counts / n_lines)
        else:
            each["dup_line_share"] = each["mean_line"] = np.zeros(n)
        out.append(np.stack([each[s] for s in STATS], 1))
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


# ---- rules ----

Condition = tuple[int, bool, float]  # statistic, above?, cut


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple[Condition, ...], leaves: list):
    """A tree on gradients; every node but the root is a rule, its leaves give the step."""
    if path:
        leaves.append((path, rows, depth == 0))
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-6, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    for k, c in enumerate(cuts):
        at = np.searchsorted(c, x[rows, k], "left")  # cut i parts x <= c[i] from the rest
        gl, hl = (np.cumsum(np.bincount(at, v[rows], len(c) + 1))[:-1] for v in (grad, hess))
        nl = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < 5) | (len(rows) - nl < 5)] = 0
        if len(c) and gain.max() > best[0]:
            best = (float(gain.max()), (k, float(c[gain.argmax()])))
    if best[1] is None:
        leaves.append((path, rows, True))
        return
    k, cut = best[1]
    above = x[rows, k] > cut
    _grow(x, cuts, grad, hess, rows[~above], depth - 1, (*path, (k, False, cut)), leaves)
    _grow(x, cuts, grad, hess, rows[above], depth - 1, (*path, (k, True, cut)), leaves)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, seed: int = 1) -> list[tuple[Condition, ...]]:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        rows = np.sort(rng.permutation(len(y))[: max(20, int(0.7 * len(y)))])
        nodes: list = []
        _grow(x, cuts, grad, hess, rows, depth, (), nodes)
        for path, own, _ in nodes:
            if path:
                rules[tuple(sorted(path))] = None
        for path, own, leaf in nodes:
            if leaf and path:
                hit = _holds(x, path)
                score[hit] += rate * grad[own].sum() / (hess[own].sum() + 1)
    return list(rules)


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > cut) == above for k, above, cut in rule])


class RuleEnsemble:
    """Intercept, weighted rules, and weighted statistics held within [low, high]."""

    def __init__(self, intercept: float, rules: list[tuple[float, tuple[Condition, ...]]], linear: list[tuple[float, int, float, float]]):
        self.intercept, self.rules, self.linear = intercept, rules, linear

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, strength: float = 0.004, steps: int = 300) -> RuleEnsemble:
        """Lasso logistic weights by accelerated proximal gradient; the intercept is free."""
        if len(y) == 0 or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
            return cls(float(np.log(share / (1 - share))), [], [])
        y = y.astype(float)
        rules = extract_rules(x, y)
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        z = np.concatenate([np.stack([_holds(x, r) for r in rules], 1).astype(float), np.clip(x, low, high)], 1)
        mean, sd = z.mean(0), z.std(0)
        use = sd > 1e-9
        sd[~use] = 1
        z = np.concatenate([np.ones((len(y), 1)), (z - mean) / sd * use], 1)
        top = 0.25 * np.linalg.norm(z, 2) ** 2 / len(y)
        b = v = np.zeros(z.shape[1])
        t = 1.0
        for _ in range(steps):
            g = z.T @ (1 / (1 + np.exp(-(z @ v))) - y) / len(y)
            new = v - g / top
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - strength / top, 0)
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            b, v, t = new, new + (t - 1) / s * (new - b), s
        w = b[1:] / sd * use
        n = len(rules)
        return cls(
            float(b[0] - (w * mean).sum()),
            [(float(c), r) for c, r in zip(w[:n], rules, strict=True) if c],
            [(float(c), k, float(low[k]), float(high[k])) for k, c in enumerate(w[n:]) if c],
        )

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for c, rule in self.rules:
            z += c * _holds(x, rule)
        for c, k, low, high in self.linear:
            z += c * np.clip(x[:, k], low, high)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over the columns STATS."""
        z = F.lit(self.intercept)
        for c, rule in self.rules:
            z = z + F.when(reduce(lambda a, b: a & b, [(F.col(STATS[k]) > cut) if above else (F.col(STATS[k]) <= cut) for k, above, cut in rule]), F.lit(c)).otherwise(0.0)
        for c, k, low, high in self.linear:
            z = z + c * F.greatest(F.least(F.col(STATS[k]), F.lit(high)), F.lit(low))
        return 1 / (1 + F.exp(-z))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and STATS of docs."""
    types = dict(docs.dtypes)

    def run(batches):
        for batch in small(batches):
            x = statistics(column(batch, "__text"))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(x[:, k]) for k in range(len(STATS))], names=[*keep, *STATS])

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{s} double" for s in STATS])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2) -> RuleEnsemble:
    """Fits on labelled rows whose remainder is not held_out, the MOST_ROWS of least hash; ids and rows may repeat."""
    known = labels.filter(F.col(label_col).isNotNull() & (remainder(id_col) != held_out)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(MOST_ROWS)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")  # MOST_ROWS ids and labels
    order = ["_id", "_label", *STATS]
    seen = with_statistics(rows, ["_id", "_label"]).orderBy(F.xxhash64("_id"), *order).limit(MOST_ROWS).toPandas().sort_values(order)
    return RuleEnsemble.fit(seen[list(STATS)].to_numpy(float), seen["_label"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and its STATS."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_statistics(rows, ["doc_id"]).select("doc_id", (remainder() == 2).alias("held_out"), model.column().alias("score"), *STATS).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """docs without the rows scored under THRESHOLD; all columns stay, apart from STATS in a struct, so that names cannot clash."""
    t = docs.columns.index(text_col)

    def run(batches):
        for batch in small(batches):
            x = statistics(batch.column(0).field(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(len(STATS))]], names=["__row", *STATS])

    schema = StructType([StructField("__row", docs.schema), *[StructField(s, DoubleType()) for s in STATS]])
    return docs.select(F.struct("*").alias("__row")).mapInArrow(run, schema).filter(model.column() >= THRESHOLD).select("__row.*")
