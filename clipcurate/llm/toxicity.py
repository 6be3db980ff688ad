"""Toxic documents by non-negative positive-unlabelled learning with numpy classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.llm.common import free_name, materialize, worker_tables

#: Hashed features; a word gives itself and its beginnings of these lengths.
DIMS, PREFIXES = 1 << 19, (4, 5)
_word = re.compile(r"[^\W\d_]+")


def known_words() -> dict[str, tuple[int, ...]]:
    return worker_tables("toxicity", dict)


def word_features(word: str, known: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    got = known.get(word)
    if got is None:
        keys = {f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)}
        got = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMS for k in keys)
        if len(known) > 100_000:  # words of one Python worker; what is forgotten is only hashed again
            known.clear()
        known[word] = got
    return got


def features(text: str | None) -> np.ndarray:
    """Ids of the features that a text has, each once. Null and empty texts have none."""
    words, known = set(_word.findall((text or "").lower())), known_words()
    return np.fromiter({f for w in words for f in word_features(w, known)}, dtype=np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str, text: str, label: str, bound: int) -> tuple[DataFrame, float]:
    """Features of at most about ``bound`` confirmed positives and twice as many unlabelled texts, and the class prior.

    Rows are chosen by a hash of their id and text; those without an id are not. Unlabelled texts are any of the training side, labels unseen. The prior is the
    positive share of the labelled training rows. A row labelled twice counts as positive if one label says so.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
    own = own.where(~held_out)
    n, positives = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(0.999, max(0.001, positives / n)) if n else 0.001
    train = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out)
    total = train.select("doc_id").count()
    draw = lambda tag, share: F.pmod(F.xxhash64(F.lit(tag), F.col("doc_id"), F.col("text")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))
    p = train.where(draw("p", bound / max(1, positives))).join(own.where("y = 1").select("doc_id"), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    u = train.where(draw("u", 2 * bound / max(1, total))).withColumn("positive", F.lit(False))

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    return materialize(p.unionByName(u).select("doc_id", "positive", encode("text").alias("ids")), "training"), prior


def telling_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, z_least: float = 5.5, lift: float = 3.0) -> np.ndarray:
    """Ids of the features that positives hold more often than unlabelled texts do, beyond chance (a z-score that half a
    million features hardly reach by luck), and by ``lift`` more often than clean texts do. The unlabelled hold positives
    too, by the prior: their rate less that share is the clean rate, so that a word of toxic texts alone passes at any prior."""
    n_p, n_u = len(positive), len(unlabelled)
    c_p, c_u = (np.bincount(np.concatenate(rows), minlength=DIMS) for rows in (positive, unlabelled))
    f_p, f_u, pooled = c_p / n_p, c_u / n_u, (c_p + c_u + 1) / (n_p + n_u + 2)
    z = (f_p - f_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    f_clean = np.maximum(f_u - prior * f_p, 0) / (1 - prior)
    return np.flatnonzero((z > z_least) & (f_p > lift * f_clean) & (c_p >= 3)).astype(np.int32)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """``(ids, weights, bias)`` of a linear classifier that minimises the non-negative PU risk with the logistic loss.

    Risk: prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]). While the second part is negative, which no true
    risk is, steps go up its gradient instead. Adam over all rows. No rows of a kind, or no telling features: the prior.
    """
    none = np.zeros(0, np.int32), np.zeros(0), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return none
    ids = telling_features(positive, unlabelled, prior)
    if not len(ids):
        return none
    place = np.full(DIMS, -1, np.int32)
    place[ids] = np.arange(len(ids))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(ids) + 1), dtype=np.float32)
        x[:, -1] = 1
        for k, r in enumerate(rows):
            at = place[r]
            x[k, at[at >= 0]] = 1
        return x

    x_p, x_u = dense(positive), dense(unlabelled)
    w = np.zeros(len(ids) + 1)
    w[-1] = none[2]
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    for step in range(1, steps + 1):
        s_p, s_u = x_p @ w.astype(np.float32), x_u @ w.astype(np.float32)
        g_p, g_u = -prior * sigmoid(s_p) / len(s_p), sigmoid(s_u) / len(s_u)  # slopes of the second part
        if np.logaddexp(0, s_u).mean() < prior * np.logaddexp(0, s_p).mean():
            g_p, g_u = -g_p, -g_u
        else:
            g_p = g_p - prior * sigmoid(-s_p) / len(s_p)
        g = x_p.T @ g_p + x_u.T @ g_u + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ids, w[:-1], float(w[-1])


def train(rows: DataFrame, prior: float, members: int = 3) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One classifier for each member, on its own four fifths of ``rows``, without repeats; members are trained by different tasks."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "positive"], kind="stable")
        rng = np.random.default_rng(int(key[0]))
        side = {}
        for positive in (True, False):
            ids = pdf["ids"][pdf["positive"] == positive].tolist()
            side[positive] = [np.frombuffer(ids[i], np.int32) for i in (rng.permutation(len(ids))[: -(-len(ids) * 4 // 5)])]
        f, w, b = fit_nnpu(side[True], side[False], prior)
        return pd.DataFrame({"ids": [f.astype(np.int32).tobytes()], "weights": [w.astype(np.float64).tobytes()], "bias": [b]})

    copies = rows.withColumn("member", F.explode(F.array(*[F.lit(i) for i in range(members)])))
    out = copies.groupBy("member").applyInPandas(one, "ids binary, weights binary, bias double").collect()  # a model each
    return [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float64), r["bias"]) for r in out]


def scorer(models: Iterable[tuple[np.ndarray, np.ndarray, float]]):
    """Pandas UDF text -> mean probability of the members, 0 to 1."""
    models = list(models)
    table = {}
    for k, (ids, w, _) in enumerate(models):
        for i, x in zip(ids.tolist(), w.tolist(), strict=True):
            table.setdefault(i, np.zeros(len(models)))[k] = x
    bias = np.array([b for *_, b in models])

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weighted: dict[str, tuple[int, ...]] = {}  # word -> its features that carry weight; of one batch
        known = known_words()

        def of(text: str | None) -> float:
            hit: set[int] = set()
            for w in set(_word.findall((text or "").lower())):
                got = weighted.get(w)
                if got is None:
                    got = weighted[w] = tuple(f for f in word_features(w, known) if f in table)
                if got:
                    hit.update(got)
            s = bias + sum((table[f] for f in sorted(hit)), np.zeros(len(bias)))
            return float((1 / (1 + np.exp(-np.clip(s, -30, 30)))).mean()) if len(bias) else 0.0

        return texts.map(of).astype("float64")

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 4000, members: int = 3) -> DataFrame:
    """``docs`` with ``toxicity``, a struct of held_out, score and predicted (if there is a column of that name, see ``free_name``).

    Rows whose crc32(id as text) mod 5 is 0 are held out: no label of theirs is used. ``sample`` bounds the confirmed
    positives that are fitted on (and twice as many unlabelled texts); every row is scored, over its whole text.
    Null and empty texts get the score of a text without known words. Without labelled positives the score is the
    prior's. A null id is never held out and never trains. All columns and repeated rows are returned.
    """
    out_of = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    rows, prior = training_rows(docs, labels, out_of(F.col("doc_id")), doc_id, text, label, sample)
    score = scorer(train(rows, prior, members))
    into = free_name(docs, "toxicity")
    scored = docs.withColumn(into, score(F.col(text)))
    s = F.col(into)
    return scored.withColumn(into, F.struct(out_of(F.col(doc_id)).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted")))
