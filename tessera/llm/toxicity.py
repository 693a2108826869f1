"""Toxicity by weak supervision.

1. Lexicon voters are mined from labelled rows: words and word beginnings that
   toxic texts hold far more often than others, by a likelihood ratio over word
   counts.  Near copies count once and of nested keys only the best is taken.
   Pattern voters look at form: hits per word, several kinds, shouting, no hit.
2. Every row of the corpus, labelled or not, is voted on.  Equal votes are one
   pattern with a count, so what is learned from stays far smaller than the texts.
3. A generative label model starts from the labelled rows and goes on by
   expectation-maximisation over the patterns of all rows: class-conditional vote
   rates (accuracies), and correlations of votes within a class, by which voters
   that repeat each other are weighted down.
4. A linear classifier (logistic regression) is trained on the model's posterior
   labels of the sampled rows and scores every text.

At most SAMPLE labelled rows are used, taken by hash of the id; that and VOTERS
bound all that reaches the driver.  Sums over the corpus are of whole numbers, so
they don't depend on the number of tasks.  Scores use the text only.

Defined results: a null or empty text has no hits and is scored by the prior
part of the classifier; null labels are left out; repeated rows score alike;
rows that share an id share a label; without any labelled row of both classes
every score is 0.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .support import arrow_text, doc_blocks, scratch_scope, stage

SAMPLE = 12_000
VOTERS = 128
PREFIXES = range(3, 8)
#: A key must be in this many toxic texts; a text counts a key this often at most; least likelihood ratio (2 ln).
MIN_TOXIC, MOST, RATIO = 5, 3, 60.0
#: Rounds of expectation-maximisation, and the unit of posterior weights.
ROUNDS, UNIT = 3, 1 << 20
_LETTER = ((tk._ALL >= 97) & (tk._ALL <= 122)) | (tk._ALL >= 128)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _doc_words(batch_text):
    """Per block of documents: its rows, lower-cased bytes, words, and capital shares."""
    raw, bounds = arrow_text(batch_text)
    for i, j in doc_blocks(bounds):
        own, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        block = tk.lowered(own)
        caps = np.diff(np.concatenate([[0], np.cumsum(own != block)])[at])
        letters = np.diff(np.concatenate([[0], np.cumsum((block >= 97) & (block <= 122))])[at])
        s, e, d = tk.words(block, at, _LETTER)
        yield i, j, block, s, e, d, caps / np.maximum(1, letters)


def _signatures(batches):
    """Least hash of a text's 5-word shingles: near copies mostly share it."""
    for batch in batches:
        for i, j, block, s, e, d, _ in _doc_words(batch.column(0)):
            n = np.bincount(d, minlength=j - i) if len(d) else np.zeros(j - i, np.int64)
            sig = np.array([x[0] if len(x) else 0 for x in tk.shingles(tk.hash_words(block, s, e), n)], np.uint64)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sig.view(np.int64))], ["text", "toxic", "sig"])


def _mine(batches):
    """(key, toxic texts, words in toxic, in clean texts); the key "" has all words."""
    found: dict[str, list[int]] = {"": [0, 0, 0]}
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for i, j, block, s, e, d, _ in _doc_words(batch.column(0)):
            data = block.tobytes()
            cut = np.searchsorted(d, np.arange(j - i + 1)).tolist()
            s, e = s.tolist(), e.tolist()
            for k in range(j - i):
                toxic = bool(labels[i + k])
                found[""][1 if toxic else 2] += cut[k + 1] - cut[k]
                seen: Counter[str] = Counter()
                for w, n in Counter(data[s[x] : e[x]] for x in range(cut[k], cut[k + 1])).items():
                    word = w.decode("utf-8", "ignore")
                    seen["=" + word] += n
                    for m in PREFIXES:
                        if len(word) > m:
                            seen["^" + word[:m]] += n
                for key, n in seen.items():
                    row = found.setdefault(key, [0, 0, 0])
                    row[0] += toxic
                    row[1 if toxic else 2] += min(n, MOST)
    # every count leaves the task, so that the sums over tasks are whole
    texts, t, c = zip(*found.values(), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(texts, pa.int64()), pa.array(t, pa.int64()), pa.array(c, pa.int64())], ["key", "texts", "t", "c"])


def mine_lexicon(train: DataFrame) -> list[str]:
    """Up to VOTERS voters of (text, toxic): "=word" or "^beginning", best first."""
    once = train.mapInArrow(_signatures, "text string, toxic double, sig bigint")
    once = once.groupBy("sig").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("x")).select("x.text", "x.toxic")
    sums = [F.sum(x).alias(x) for x in ("texts", "t", "c")]
    with scratch_scope(train.sparkSession) as scratch:
        found = stage(once.mapInArrow(_mine, "key string, texts bigint, t bigint, c bigint").groupBy("key").agg(*sums), "keys")
        total = found.where("key = ''").first()
        words = [float(max(1, x)) for x in ((total["t"], total["c"]) if total else (1, 1))]
        expected = (F.col("t") + F.col("c")) * (words[0] / sum(words))
        other = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (F.col("t") + F.col("c") - expected))).otherwise(0.0)
        best = (
            found.where((F.col("texts") >= MIN_TOXIC) & (F.col("key") != "") & (F.col("t") * words[1] > 4 * F.col("c") * words[0]))
            .withColumn("gain", F.round(2 * (F.col("t") * F.log(F.col("t") / expected) + other), 6))
            .where(F.col("gain") >= RATIO)
            .orderBy(F.desc("gain"), F.desc(F.length("key")), "key")
            .limit(VOTERS * 2 * len(PREFIXES))
            .select("key")
            .collect()
        )
        scratch.release()
    out: list[str] = []
    for key in (r["key"] for r in best):  # of "=idiot" and "^idio", one
        if not any(key[1:].startswith(x[1:]) or x[1:].startswith(key[1:]) for x in out):
            out.append(key)
    return out[:VOTERS]


class Votes:
    """Counts of lexicon hits and measures of form, per document."""

    def __init__(self, lexicon: list[str]):
        self.size = len(lexicon)
        self.whole = {k[1:].encode(): i for i, k in enumerate(lexicon) if k[0] == "="}
        self.begin = {k[1:].encode(): i for i, k in enumerate(lexicon) if k[0] == "^"}
        self.lengths = sorted({len(k) for k in self.begin})
        self.gate = np.zeros(1 << 16, bool)
        for k in (*self.whole, *self.begin):
            if len(k) > 1:
                self.gate[k[0] << 8 | k[1]] = True

    def counts(self, col) -> tuple[np.ndarray, np.ndarray]:
        """Hits (documents x voters) and (words, capital share) per document."""
        n = len(col)
        out, form = np.zeros((n, self.size), np.float32), np.zeros((n, 2), np.float64)
        for i, j, block, s, e, d, capitals in _doc_words(col):
            form[i:j, 1] = capitals
            form[i:j, 0] = np.bincount(d, minlength=j - i) if len(d) else 0
            long = np.flatnonzero(e - s > 1)
            at = s[long]
            near = long[self.gate[block[at].astype(np.int64) << 8 | block[at + 1]]]
            data = block.tobytes()
            for a, b, k in zip(s[near].tolist(), e[near].tolist(), d[near].tolist(), strict=True):
                w = data[a:b]
                hit = self.whole.get(w)
                if hit is not None:
                    out[i + k, hit] += 1
                for m in self.lengths:
                    if m >= b - a:
                        break
                    hit = self.begin.get(w[:m])
                    if hit is not None:
                        out[i + k, hit] += 1
        return out, form


def _rates(hits: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = hits.sum(axis=1)
    return total, (hits > 0).sum(axis=1), total / np.maximum(20.0, form[:, 0])


def features(hits: np.ndarray, form: np.ndarray) -> np.ndarray:
    total, kinds, rate = _rates(hits, form)
    forms = [form[:, 1], np.log1p(total), np.log1p(kinds), np.log1p(1000.0 * rate), rate > 0.01, rate > 0.03]
    return np.concatenate([np.log1p(hits), np.stack(forms, axis=1)], axis=1).astype(np.float64)


def votes(hits: np.ndarray, form: np.ndarray) -> np.ndarray:
    """+1 toxic, -1 clean, 0 abstains; one column per voter."""
    total, kinds, rate = _rates(hits, form)
    forms = [
        np.where(total == 0, -1, 0),
        np.where(rate > 0.01, 1, np.where(rate < 0.002, -1, 0)),
        np.where(rate > 0.03, 1, 0),
        np.where((kinds >= 3) & (rate > 0.005), 1, 0),
        np.where(form[:, 1] > 0.6, 1, 0),
    ]
    return np.concatenate([hits >= 1, hits >= 2, np.stack(forms, axis=1)], axis=1).astype(np.int8)


KINDS = (-1, 0, 1)


def weighted_sums(v: np.ndarray, w: np.ndarray, pairs: bool) -> np.ndarray:
    """Whole-number sums over rows with weights ``w`` (class x row), flat: weight of
    each class; of each class, kind of vote and voter; and of each class and pair
    of voters the sum of the product of their votes."""
    parts = [w.sum(axis=1)] + [(x[:, None] * (v == k)).sum(axis=0) for x in w for k in KINDS]
    if pairs:
        wide = v.astype(np.int64)
        parts += [((wide * x[:, None]).T @ wide).ravel() for x in w]
    return np.concatenate(parts)


class LabelModel:
    """Class-conditional vote rates with weights against correlated voters."""

    def __init__(self, voters: int):
        self.voters, self.weights = voters, np.ones(voters)

    def update(self, sums: np.ndarray) -> None:
        """New rates, and weights if the sums have pairs."""
        n, v = np.maximum(sums[:2] / UNIT, 1e-9), self.voters
        self.prior = float(np.clip(n[1] / n.sum(), 1e-3, 0.5))
        counts = sums[2 : 2 + 6 * v].reshape(2, 3, v) / UNIT
        self.rates = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.accuracy = self.rates[1, 2] / (self.rates[0, 2] + self.rates[1, 2])
        if len(sums) > 2 + 6 * v:
            second = sums[2 + 6 * v :].reshape(2, v, v) / UNIT / n[:, None, None]
            mean = (counts[:, 2] - counts[:, 0]) / n[:, None]
            cov = second - mean[:, :, None] * mean[:, None, :]
            sd = np.sqrt(np.maximum(np.einsum("cii->ci", cov), 0.0))
            corr = cov / np.maximum(sd[:, :, None] * sd[:, None, :], 1e-9)
            corr[:, range(v), range(v)] = 1.0
            #: One over the number of voters that a voter's votes stand for.
            self.correlations = np.where(corr > 0.2, corr, 0.0).mean(axis=0)
            self.weights = 1.0 / np.maximum(1.0, self.correlations.sum(axis=1))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        ratio = (np.log(self.rates[1]) - np.log(self.rates[0])) * self.weights
        z = np.log(self.prior / (1 - self.prior)) + sum((v == k) @ ratio[i] for i, k in enumerate(KINDS))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _class_weights(q: np.ndarray, n: np.ndarray) -> np.ndarray:
    toxic = np.rint(q * UNIT).astype(np.int64)
    return np.stack([(UNIT - toxic) * n, toxic * n])


def _patterns(lexicon: list[str]):
    def run(batches):
        counter, seen = Votes(lexicon), Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                seen.update(r.tobytes() for r in votes(*counter.counts(batch.column(0).slice(i, 2048))))
            if len(seen) > 1 << 16:
                yield _pattern_batch(seen)
                seen.clear()
        yield _pattern_batch(seen)

    return run


def _pattern_batch(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


def _sum_rows(model: LabelModel, pairs: bool):
    """(place, sum) of the weighted sums of a task's patterns."""

    def run(batches):
        total = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                v = np.array([np.frombuffer(x, np.int8) for x in part.column(0).to_pylist()]).reshape(-1, model.voters)
                n = part.column(1).to_numpy(zero_copy_only=False)
                total = total + weighted_sums(v, _class_weights(model.posterior(v), n), pairs)
        at = np.flatnonzero(total) if not np.isscalar(total) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at] if len(at) else at)], ["place", "x"])

    return run


def learn_from_votes(docs: DataFrame, lexicon: list[str], model: LabelModel, rounds: int = ROUNDS) -> None:
    """Expectation-maximisation of ``model`` over the votes on all rows of (text)."""
    with scratch_scope(docs.sparkSession) as scratch:
        found = docs.select("text").mapInArrow(_patterns(lexicon), "pattern binary, n bigint")
        found = stage(found.groupBy("pattern").agg(F.sum("n").alias("n")), "patterns")
        for r in range(rounds):
            rows = found.mapInArrow(_sum_rows(model, r == 0), "place int, x bigint").groupBy("place").agg(F.sum("x").alias("x")).collect()
            sums = np.zeros(2 + 6 * model.voters + (2 * model.voters**2 if r == 0 else 0), np.int64)  # a row per place at most
            for x in rows:
                sums[x["place"]] = x["x"]
            if sums[:2].any():
                model.update(sums)
        scratch.release()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on soft labels."""
    mean, sd = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / sd
    w, b, vw, vb = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(z) + 4 * ridge + 1.0)
    for r in range(rounds):
        aw, ab = w + 0.9 * vw, b + 0.9 * vb
        g = 1.0 / (1.0 + np.exp(-np.clip(z @ aw + ab, -30, 30))) - y
        vw, vb = 0.9 * vw - rate * (z.T @ g / len(z) + ridge * aw), 0.9 * vb - rate * g.mean()
        w, b = w + vw, b + vb
    return w / sd, float(b - (w * mean / sd).sum())


def _vote_rows(lexicon: list[str]):
    def run(batches):
        counter = Votes(lexicon)
        for batch in batches:
            hits, form = counter.counts(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.float64()), pa.array([r.astype(np.uint16).tobytes() for r in hits], pa.binary()), pa.array(form[:, 0]), pa.array(form[:, 1])],
                ["y", "hits", "words", "capitals"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model of (doc_id, text) from labelled rows that are not held out and
    from the votes on all rows; None without both classes."""
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    labels = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("double").alias("toxic"))
    usable = labels.where(F.col("toxic").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    usable = usable.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    # The sample is the smallest ids by hash: bounded, the same in every run.
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    with scratch_scope(docs.sparkSession) as scratch:
        texts = docs.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("text", "toxic")  # sample bounds the broadcast
        texts = stage(texts, "labelled")
        n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        if not n.get(0.0) or not n.get(1.0):
            return None
        lexicon = mine_lexicon(texts)
        rows = texts.mapInArrow(_vote_rows(lexicon), "y double, hits binary, words double, capitals double").collect()
        y = np.array([r["y"] for r in rows])
        hits = np.array([np.frombuffer(r["hits"], np.uint16) for r in rows], np.float32).reshape(len(rows), len(lexicon))
        form = np.array([(r["words"], r["capitals"]) for r in rows])
        order = np.lexsort((y, form[:, 1], form[:, 0]))  # whatever the tasks' order
        y, hits, form = y[order], hits[order], form[order]
        v = votes(hits, form)
        model = LabelModel(v.shape[1])
        model.update(weighted_sums(v, _class_weights(y, np.ones(len(y), np.int64)), True))
        learn_from_votes(docs, lexicon, model)
        w, b = logistic(features(hits, form), model.posterior(v))
        scratch.release()
    return {"lexicon": lexicon, "weights": w, "bias": b, "label_model": model}


def _score(lexicon: list[str], w: np.ndarray, b: float):
    def run(batches):
        counter = Votes(lexicon)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                z = features(*counter.counts(part.column(1))) @ w + b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return src.select("doc_id", F.lit(0.0).alias("score"))
    return src.mapInArrow(_score(model["lexicon"], model["weights"], model["bias"]), "doc_id bigint, score double")
