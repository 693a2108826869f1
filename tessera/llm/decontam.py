"""Benchmark decontamination by latent semantic retrieval.

1. One pass turns each text into 32-bit word hashes (lower-cased letters and
   digits), written once; all later passes read those.
2. Passages of 256 words give document frequencies of 65,536 hashed terms, and
   from them TF-IDF rows folded (with signs) into 1,024 dimensions.
3. A distributed randomised SVD of all passages: every task multiplies its
   rows with a fixed random test matrix and sends one 1,024 x 160 sum; the
   driver (whose work doesn't depend on the input) takes the leading right
   singular vectors by the Nystroem form of the sketch.
4. Windows of 32 words, every 16 words, and the benchmark items are projected
   to the whitened latent space; items above a cosine are candidates.
5. Places with a run of RUN words of an item (all its words, if it has fewer)
   are candidates too, whatever the cosine.  So an item that stands in a text
   word for word, however short, always is one.
6. A candidate is confirmed on the words around the window, or those where the
   item would stand by the run and a quarter to each side: the longest common
   subsequence must cover most of the item, or a good part of it if it covers
   the item's answer, its last sentence.

Items are prepared in blocks of BLOCK and written to the shared folder; a task
takes some SPAN bytes of its words at a time against one block after another, so
neither the benchmark nor the corpus has to fit anywhere and the corpus is read
once for all blocks.

Defined results: null and empty texts and items match nothing; items under
MIN_WORDS words must be found in full; repeated rows are treated alike; a null
id is no bar; extra columns are ignored or, in ``drop_leaks``, passed through.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .support import arrow_text, doc_blocks, filesystem, give_back, scratch_path, scratch_scope, stage, stage_arrow, without_keys

TERMS = 1 << 16
DIMS, RANK, EXTRA = 1024, 128, 32
PASSAGE, STEP = 256, 16
COSINE = 0.33
#: Words in a run.
RUN = 3
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.75
MIN_WORDS = 8
BLOCK = 2048
#: Bytes of hashed words that are held against all blocks of items.
SPAN = 4 << 20


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all documents, and words per document."""
    block = tk.lowered(raw)
    s, e, d = tk.words(block, bounds, tk.ALNUM)
    n = np.bincount(d, minlength=len(bounds) - 1) if len(d) else np.zeros(len(bounds) - 1, np.int64)
    return (tk.hash_words(block, s, e) >> np.uint64(32)).astype(np.uint32), n


def _hash_texts(batches):
    for batch in batches:
        raw, bounds = arrow_text(batch.column(1))
        for i, j in doc_blocks(bounds):
            h, n = _word_hashes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            offsets = np.zeros(j - i + 1, np.int32)
            np.cumsum(n * 4, out=offsets[1:])
            words = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), words], ["doc_id", "words"])


def _word_blocks(col: pa.Array, limit: int = 1 << 20):
    """(first document, words per document, all words) of blocks of documents."""
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    h = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32) if data is not None and data.size else np.zeros(0, np.uint32)
    at = (offsets - offsets[0]) // 4
    for i, j in doc_blocks(at * 4, limit):
        yield i, np.diff(at[i : j + 1]), h[at[i] : at[j]]


def _passages(n: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Running passage number of every word of documents with ``n`` words."""
    per = -(-n // size)
    first = np.cumsum(per) - per
    start = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(start, n)
    return np.repeat(first, n) + within // size, int(per.sum())


def _document_frequencies(batches):
    total, passages = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for _, n, h in _word_blocks(batch.column(0)):
            p, m = _passages(n, PASSAGE)
            passages += m
            pairs = np.unique(p * TERMS + (h >> np.uint32(16)))
            total += np.bincount(pairs % TERMS, minlength=TERMS)
    seen = np.flatnonzero(total)
    terms = np.append(seen, -1).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.append(total[seen], passages))], ["term", "n"])


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of every term."""
    r = tk.mix(np.arange(1, TERMS + 1, dtype=np.uint64))
    return (r % np.uint64(DIMS)).astype(np.int64), np.where(r >> np.uint64(63), -1.0, 1.0)


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((DIMS, RANK + EXTRA)).astype(np.float32)


def _sketch(weight: np.ndarray):
    dim, _ = _fold()

    def run(batches):
        omega, total = _test_matrix(), np.zeros((DIMS, RANK + EXTRA), np.float64)
        for batch in batches:
            for _, n, h in _word_blocks(batch.column(0)):
                p, m = _passages(n, PASSAGE)
                term = h >> np.uint32(16)
                rows = np.bincount(p * DIMS + dim[term], weights=weight[term], minlength=m * DIMS).reshape(m, DIMS)
                rows = rows.astype(np.float32)
                norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
                rows /= np.maximum(norm, 1e-9)[:, None]
                total += rows.T @ (rows @ omega)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])
        give_back()

    return run


def _add_parts(batches):
    total = np.zeros(DIMS * (RANK + EXTRA))
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def fit(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(term weights, term vectors) of the corpus: TF-IDF and whitened latent space.

    Both have one row per hashed term, the vectors one more of zeros, so their size
    is fixed.
    """
    df = words.select("words").mapInArrow(_document_frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TERMS + 1)
    for r in df:
        n[r["term"]] = r["n"]
    dim, sign = _fold()
    weight = np.log((1.0 + n[-1]) / (1.0 + n[:-1])) * sign
    parts = words.select("words").mapInArrow(_sketch(weight), "part binary")
    while parts.rdd.getNumPartitions() > 16:  # sums of sums, each task streams its share
        parts = parts.repartition(max(1, int(parts.rdd.getNumPartitions() ** 0.5))).mapInArrow(_add_parts, "part binary")
    y = np.zeros((DIMS, RANK + EXTRA))
    for r in parts.collect():  # at most 16 sums of fixed size
        y += np.frombuffer(r["part"], np.float64).reshape(y.shape)
    omega = _test_matrix().astype(np.float64)
    # Nystroem: G ~ Y (omega' Y)^-1 Y', for G = A'A positive semi-definite
    shift = max(1e-12, 1e-7 * float(np.linalg.norm(y)))
    ys = y + shift * omega
    core = omega.T @ ys
    core = (core + core.T) / 2
    lam, vec = np.linalg.eigh(core)
    half = vec / np.sqrt(np.maximum(lam, 1e-9 * max(lam.max(), 1e-9)))
    u, s, _ = np.linalg.svd(ys @ half, full_matrices=False)
    sigma = np.sqrt(np.maximum(s[:RANK] ** 2 - shift, 0.0))
    keep = sigma > 1e-4 * max(sigma.max(), 1e-12)
    basis = np.zeros((DIMS, RANK))
    basis[:, keep] = u[:, :RANK][:, keep] / sigma[keep]
    return weight, np.concatenate([basis[dim] * weight[:, None], np.zeros((1, RANK))]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _answer(text: str) -> int:
    """Where the item's last sentence begins, as a word number."""
    parts = [p for p in re.split(r"(?<=[.!?;:])\s+", text.strip()) if p]
    if len(parts) < 2:
        return 0
    raw = np.frombuffer(" ".join(parts[:-1]).encode(), np.uint8)
    return int(_word_hashes(raw, np.array([0, len(raw)]))[1][0])


def prepare_items(items: list[tuple[int, str]], vectors: np.ndarray):
    """(id, words, answer start) of usable items and their unit vectors."""
    out, vec = [], []
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        h, _ = _word_hashes(raw, np.array([0, len(raw)]))
        if len(h):
            out.append((item, h.tolist(), _answer(text)))
            vec.append(vectors[h >> np.uint32(16)].sum(axis=0))
    return out, _unit(np.array(vec, np.float32).reshape(len(out), RANK))


def judge_match(words: list[int], answer_at: int, region: list[int]) -> tuple[float, float, bool]:
    """(covered share of the item, of its answer, whether that is a leak)."""
    whole = lcs(words, region) / len(words)
    if len(words) < MIN_WORDS:
        return whole, whole, whole == 1.0
    answer = words[answer_at:] or words
    part = lcs(answer, region) / len(answer) if whole >= LCS_WITH_ANSWER else 0.0
    return whole, part, whole >= LCS_ALONE or (whole >= LCS_WITH_ANSWER and part >= ANSWER)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` words from every word on, as far as there are so many."""
    n = max(0, len(h) - size + 1)
    v = tk.mix(h[:n].astype(np.uint64))
    for k in range(1, size):
        v = tk.mix(v + h[k : k + n])
    return v


def run_table(items: list) -> list[tuple]:
    """(size, run hashes in order, first place of each in the rest, items, words before the run) per size of run."""
    parts: dict[int, list] = {}
    for k, (_, words, _) in enumerate(items):
        size = min(RUN, len(words))
        mine = _runs(np.array(words, np.uint32), size)
        parts.setdefault(size, []).append((mine, np.full(len(mine), k), np.arange(len(mine))))
    out = []
    for size, part in parts.items():
        runs, item, before = (np.concatenate(x) for x in zip(*part, strict=True))
        order = np.argsort(runs, kind="stable")
        keys, first = np.unique(runs[order], return_index=True)
        out.append((size, keys, np.append(first, len(runs)), item[order], before[order]))
    return out


def _run_hits(table: list[tuple], gates: list[np.ndarray], h: np.ndarray, within: np.ndarray, left: np.ndarray, doc: np.ndarray) -> list[list[int]]:
    """[document, word at which the item would begin, item] of the runs found in ``h``.

    ``within`` and ``left`` are the words of a word's document before it and from it on.
    """
    hits = [np.zeros((0, 3), np.int64)]
    for (size, keys, first, item, before), gate in zip(table, gates, strict=True):
        g = _runs(h, size)
        p = np.flatnonzero(gate[g >> np.uint64(44)])
        j = np.minimum(np.searchsorted(keys, g[p]), len(keys) - 1)
        good = (keys[j] == g[p]) & (left[p] >= size)
        p, j = p[good], j[good]
        n = first[j + 1] - first[j]
        at = np.arange(n.sum()) + np.repeat(first[j] - (np.cumsum(n) - n), n)
        p = np.repeat(p, n)
        hits.append(np.stack([doc[p], within[p] - before[at], item[at]], axis=1))
    return np.unique(np.concatenate(hits), axis=0).tolist()


def _spans(batches):
    """Batches put together to some SPAN bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SPAN:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(paths: list[str], vectors: np.ndarray, cosine: float):
    """Leaks of the items in the files ``paths``."""

    def run(batches):
        known: dict[str, tuple] = {}
        for held in _spans(batches):
            for path in paths:
                if path not in known:
                    known.clear()  # one block at a time
                    store, name = filesystem(path)
                    with store.open_input_stream(name) as f:
                        known[path] = pickle.loads(f.read())
                yield from _search_block(held, *known[path], vectors, cosine)
        known.clear()
        give_back()

    return run


def _search_block(batches: list[pa.RecordBatch], items: list, item_vec: np.ndarray, vectors: np.ndarray, cosine: float):
    runs = run_table(items)
    gates = []
    for _, keys, *_ in runs:
        gates.append(np.zeros(1 << 20, bool))
        gates[-1][keys >> np.uint64(44)] = True
    item_t = np.ascontiguousarray(item_vec.T)
    for batch in batches:
        found: list[tuple] = []
        for i0, n, h in _word_blocks(batch.column(1), 1 << 17):
            steps = -(-n // STEP)
            if not steps.sum():
                continue
            start = np.cumsum(n) - n
            slot0 = (np.cumsum(steps) - steps) * STEP
            idx = np.full(steps.sum() * STEP, TERMS, np.int64)
            idx[np.arange(len(h)) + np.repeat(slot0 - start, n)] = h >> np.uint32(16)
            sums = np.empty((len(idx) // STEP, RANK), np.float32)
            for a in range(0, len(sums), 512):
                part = vectors[idx[a * STEP : (a + 512) * STEP]]
                part.reshape(-1, STEP, RANK).sum(axis=1, out=sums[a : a + 512])
            doc = np.repeat(np.arange(len(n)), steps)
            pair = sums.copy()
            same = np.flatnonzero(doc[:-1] == doc[1:])
            pair[same] += sums[same + 1]
            cos = _unit(pair) @ item_t
            first_step = np.cumsum(steps) - steps
            win, item = np.nonzero(cos >= cosine)
            best: dict[tuple[int, int], tuple] = {}
            for w, k in zip(win.tolist(), item.tolist(), strict=True):
                d = int(doc[w])
                if (d, k) in best and best[d, k][3]:
                    continue
                ident, words, answer_at = items[k]
                at, m = (w - int(first_step[d])) * STEP, len(words)
                lo, hi = max(0, at - m), min(int(n[d]), at + 2 * STEP + m)
                region = h[start[d] + lo : start[d] + hi].tolist()
                whole, part, leak = judge_match(words, answer_at, region)
                if leak:
                    best[d, k] = (float(cos[w, k]), whole, part, True)
            within = np.arange(len(h)) - np.repeat(start, n)
            for d, at, k in _run_hits(runs, gates, h, within, np.repeat(n, n) - within, np.repeat(np.arange(len(n)), n)):
                if (d, k) in best:
                    continue
                _, words, answer_at = items[k]
                m, at0 = len(words), max(0, at)
                region = h[start[d] + max(0, at - m // 4) : start[d] + min(int(n[d]), at + m + m // 4)].tolist()
                whole, part, leak = judge_match(words, answer_at, region)
                if leak:
                    best[d, k] = (float(cos[first_step[d] + at0 // STEP, k]), whole, part, True)
            found += [(i0 + d, items[k][0], *v[:3]) for (d, k), v in best.items()]
        if found:
            row, ident, *rest = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(ident, pa.int64()), *(pa.array(c, pa.float64()) for c in rest)],
                ["doc_id", "item_id", "cosine", "lcs_ratio", "answer_ratio"],
            )


_FOUND = "doc_id bigint, item_id bigint, cosine double, lcs_ratio double, answer_ratio double"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    cosine: float = COSINE,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_ratio) of confirmed leaks."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    words = stage_arrow(src, _hash_texts, "doc_id bigint, words binary", "words")
    _, vectors = fit(words)
    items = (
        benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("item_text"))
        .where("item_text IS NOT NULL")
        .distinct()
    )
    paths = []
    blocks = -(-items.count() // BLOCK)
    for b in range(blocks):  # each collects a block, about
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b)
        rows = sorted(mine.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["item_text"]))
        ready = prepare_items([(r["item_id"], r["item_text"]) for r in rows], vectors)
        if ready[0]:
            paths.append(scratch_path(spark, "items.pickle"))
            store, name = filesystem(paths[-1])
            with store.open_output_stream(name) as f:
                f.write(pickle.dumps(ready))
    out = words.mapInArrow(_search(paths, vectors, cosine), _FOUND) if paths else spark.createDataFrame([], _FOUND)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item was found.

    Rows go by a hash of id and text, so a null or repeated id does no harm.
    """
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    with scratch_scope(docs.sparkSession) as scratch:
        keyed = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
        gone = stage(find_leaks(keyed, benchmark, "key", "text").select("doc_id").distinct(), "leaks")
        scratch.release(gone)
    return without_keys(docs, key, gone)
