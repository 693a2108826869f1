"""Near-duplicate documents: b-bit MinHash candidates, exact confirmation.

1. One Arrow pass makes per document the distinct 5-word shingles (64-bit
   hashes), a 128-bit cryptographic digest (BLAKE2b) of its words, 160 minima,
   their low two bits packed into five longs, and 32 band keys of five minima each.
2. Documents with the same words in the same order, by that digest, are one
   class; its smallest id stands for it.  Only these representatives go on, so a
   group of a million copies is one node.  Equal sets of other word sequences are
   linked like all other pairs, on their full sets.
3. Round one links each member of a band bucket to the bucket's smallest id (a
   star, never all pairs).  Packed signatures give a collision-corrected
   estimate by bit counts; pairs that pass by a wide margin are confirmed on
   full shingle sets, and components are formed.
4. Further rounds take, of the same buckets, only pairs whose ends are still in
   different components.  A shingle that no other component holds can't be part
   of a link that is still missing, so a document's other shingles bound its
   similarity with anything outside: documents, and then pairs, below that
   exact bound are out before they are paired.  While that leaves many, a
   star around the documents that share most joins components first.  At the end every
   candidate pair of every bucket is inside one component, or was confirmed, or
   refuted by itself or by a bound, so no link is lost to the star shape and no
   bucket has a cap.

A pair at similarity 0.85 misses all 32 bands with probability 7e-9, and the
estimate is off by the margin (six deviations) with about 1e-9.

Defined results: a null or empty text has no shingles and is linked with
nothing; fewer than five words make one shingle of the whole sequence; rows
that share an id are one node, and ``keep_one`` keeps one row of them; a null id
is linked with nothing and stays.  Extra columns are ignored or, in ``keep_one``,
passed through.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .support import arrow_text, doc_blocks, free_name, list_column, scratch_scope, stage_arrow, stage_small, without_ids

BANDS, ROWS, BITS, SHINGLE = 32, 5, 2, 5
PERMS = BANDS * ROWS
MARGIN = 0.24
#: Pairs of an open bucket's rows, per row, from which a star comes before pairing.
MANY = 50
#: Classes of copies whose representatives are broadcast (some tens of KB).
HEAVY = 1000
#: Edges up to which one task finds the components (62 MB measured); more take distributed rounds.
LOCAL_EDGES = 1 << 19
#: Share of the documents from which a pass of the bound leaves too many for another pass.
WORTH = 0.75
#: Bits of the map of candidate ids that goes to the tasks (2 MB), and its largest load.
SLOTS = 1 << 24
_LONGS = PERMS * BITS // 64


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = tk.mix(np.arange(1, 2 * PERMS + 1, dtype=np.uint64))
    return (seed[:PERMS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[PERMS:] >> np.uint64(32)).astype(np.uint32)


def _minima(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        part = a[:, None] * x[None, i : i + 4096]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def _each_set(batches):
    """(id column, list of shingle sets, lower-cased texts) per block of documents."""
    for batch in batches:
        raw, bounds = arrow_text(batch.column(1))
        for i, j in doc_blocks(bounds):
            block, at = tk.lowered(raw[bounds[i] : bounds[j]]), bounds[i : j + 1] - bounds[i]
            s, e, d = tk.words(block, at)
            n = np.bincount(d, minlength=j - i) if len(d) else np.zeros(j - i, np.int64)
            texts = (block[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield batch.column(0).slice(i, j - i), tk.shingles(tk.hash_words(block, s, e), n, SHINGLE), texts


def _sketch(batches):
    a, b = _permutations()
    band = tk.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[:, None]
    shift = np.arange(0, 64, BITS, dtype=np.uint64)
    for ids, sets, texts in _each_set(batches):
        n = np.array([len(x) for x in sets], np.int64)
        keys = np.zeros((len(sets), BANDS), np.uint64)
        sig = np.zeros((len(sets), _LONGS), np.uint64)
        fp = np.zeros((2, len(sets)), np.uint64)
        for r, (sh, text) in enumerate(zip(sets, texts, strict=True)):
            if not len(sh):
                continue
            # bytes.split cuts at the same six white-space bytes as the words
            fp[:, r] = np.frombuffer(blake2b(b" ".join(text.split()), digest_size=16).digest(), np.uint64)
            low = _minima(sh, a, b).astype(np.uint64)
            h = band.copy()
            for col in low.reshape(BANDS, ROWS).T:
                h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + col[:, None])
            keys[r] = h[:, 0]
            sig[r] = ((low & np.uint64((1 << BITS) - 1)).reshape(_LONGS, -1) << shift).sum(axis=1, dtype=np.uint64)
        cols = [ids, pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64))]
        cols += [pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in range(_LONGS)]
        cols.append(list_column(keys.view(np.int64).ravel(), np.full(len(sets), BANDS)))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "fp1", "fp2", *(f"s{k}" for k in range(_LONGS)), "bands"])


def _sets(bits: np.ndarray | None):
    """Shingle sets of the documents whose slot is set; of all without ``bits``."""

    def run(batches):
        for batch in batches:
            if bits is not None:
                slot = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.take(pa.array(np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)))
            for ids, sets, _ in _each_set([batch]):
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, list_column(flat, [len(x) for x in sets])], ["doc_id", "sh"])

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, sh) of the documents in ``ids`` and perhaps some more.

    The ids set bits in a map of fixed size, so texts are filtered where they
    are read and need no shuffle; ids too many for the map are joined instead.
    """
    spec = "doc_id bigint, sh array<bigint>"
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    if ids.count() > SLOTS // 8:
        return stage_arrow(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), _sets(None), spec, "sets")
    maps = (
        ids.select(slot.alias("slot"))
        .groupBy((F.col("slot") / 32768).cast("bigint").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("slot") % 32768).cast("int")).alias("bits"))
    )
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in maps.collect():  # at most SLOTS / 32768 maps of 4 KB, in one job whatever the partitions
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    picked = docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("slot"))
    return stage_arrow(picked, _sets(bits), spec, "sets")


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, s0.., bands) of (doc_id, text), staged."""
    sig = ", ".join(f"s{k} bigint" for k in range(_LONGS))
    return stage_arrow(docs, _sketch, f"doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, {sig}, bands array<bigint>", "sketches")


def _estimate(a: str, b: str):
    """Similarity from packed signatures, corrected for chance agreement 2^-BITS."""
    low = F.lit(0x5555555555555555)
    miss = None
    for k in range(_LONGS):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        x = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
        miss = x if miss is None else miss + x
    chance = 2.0**-BITS
    return (1 - miss / F.lit(PERMS) - chance) / (1 - chance)


def _passing(a: str, b: str, num: int, den: int):
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (den * small >= num * large) & (_estimate(a, b) >= num / den - MARGIN)


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) of ``pairs`` with den * |A & B| >= num * |A | B| on full ``sets``."""
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa")), "a")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    )
    return both.where(den * F.col("n") >= num * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b").distinct()


def _least_reachable(batches):
    """(node, comp) of all edges (a, b) of a task: roots take the least root beside
    them, then labels are followed to the end, until no edge joins two roots."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable over (a, b), for nodes with an edge.

    Up to LOCAL_EDGES edges are one task's work.  Of more, each round takes the
    least label among neighbours, then follows labels once more (pointer jumping),
    until nothing changes.  Labels and edges stay distributed then; each round's
    labels are written out, so lineage is one round.
    """
    if edges.count() <= LOCAL_EDGES:
        return stage_arrow(edges.select("a", "b").repartition(1), _least_reachable, "node bigint, comp bigint", "labels")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = stage_small(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        step = labels.join(near, "node", "left").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = stage_small(step.join(jump, "next", "left").select("node", "comp", F.least("next", "far").alias("new")), "labels")
        changed = new.where("new < comp").limit(1).count()
        labels = new.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def _able(sets: DataFrame, places: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, comp, n_shingles, shared) of documents that may have a link outside
    their component: enough of their shingles occur in another one.

    Leaving out a document can only lower the counts of others, so this is
    repeated while it takes away a good part of the documents.  The bound holds
    after any pass; a pass less leaves more to be paired.
    """
    rows = sets.join(places, "doc_id").select("doc_id", "comp", F.size("sh").alias("n_shingles"), F.explode("sh").alias("s"))
    left, n = rows, places.count()
    while True:
        wide = left.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s")
        able = left.join(wide, "s").groupBy("doc_id", "comp", "n_shingles").agg(F.count("*").alias("shared"))
        able = stage_small(able.where(den * F.col("shared") >= num * F.col("n_shingles")), "able")
        now = able.count()
        if now >= WORTH * n or not now:
            return able
        left, n = rows.join(able.select("doc_id"), "doc_id", "left_semi"), now


def _across(buckets: DataFrame, sig: DataFrame, sets: DataFrame | None, docs: DataFrame, links: DataFrame, tested: DataFrame, num: int, den: int):
    """Components of ``links`` and of all further links inside ``buckets``.

    While open buckets would give many more pairs than they have rows, another
    star joins components first: its leads are the documents that share most
    with others.  What is open after that is paired in full.
    """
    comp = components(links)
    while True:
        placed = buckets.select("key", "doc_id").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")
        )
        split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        waiting = stage_small(placed.join(split, "key"), "waiting")
        places = stage_small(waiting.select("doc_id", "comp").distinct(), "places")
        if sets is None:
            sets = shingle_sets(docs, places.select("doc_id"))
        able = _able(sets, places, num, den)
        # a row a document until its sketch is found, and only then one for each of its buckets
        keys = waiting.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        whole = able.join(keys, "doc_id").join(sig.drop("n_shingles"), "doc_id")
        open_ = stage_small(whole.select(F.explode("keys").alias("key"), *[c for c in whole.columns if c != "keys"]), "open")
        per = open_.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
        size = per.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
        if not size["pairs"]:
            return comp
        few = size["pairs"] <= MANY * size["rows"]
        most = F.least("x.shared", "y.shared")
        bound = (num + den) * most >= num * (F.col("x.n_shingles") + F.col("y.n_shingles"))
        near = (F.col("x.comp") != F.col("y.comp")) & bound & _passing("x", "y", num, den)
        # two documents share many bands; they are paired in the first of those only
        shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True)
        good = near & (shared == F.array_position("x.bands", F.col("x.key")))
        if few:
            found = open_.alias("x").join(open_.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & good)
        else:
            share = F.struct((F.col("shared") / F.col("n_shingles")).alias("part"), F.xxhash64("doc_id").alias("h"), "doc_id")
            leads = open_.groupBy("key").agg(F.max(share)["doc_id"].alias("doc_id"))
            found = open_.join(leads, ["key", "doc_id"]).alias("x").join(open_.alias("y"), (F.col("x.key") == F.col("y.key")) & near)
        pairs = found.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        pairs = stage_small(pairs.join(tested, ["a", "b"], "left_anti"), "across")
        if pairs.limit(1).count():
            more = stage_small(confirm(pairs, sets, num, den), "links")
            if more.limit(1).count():
                links, tested = links.union(more), tested.union(pairs)
                comp = components(links)
                if not few:
                    continue
        if few:
            return comp
        # the star added nothing: the rest is paired in full, however much it is
        rest = open_.alias("x").join(open_.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & good)
        rest = rest.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
        more = stage_small(confirm(rest.join(tested.union(pairs), ["a", "b"], "left_anti"), sets, num, den), "links")
        return components(links.union(more)) if more.limit(1).count() else comp


def link(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``, linking documents
    whose shingle sets have a similarity of num/den or more."""
    with scratch_scope(docs.sparkSession) as scratch:
        out = stage_small(_link(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")), num, den), "linked")
        scratch.release(out)
    return out


def _classes(sketches: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, rep): the smallest id of each row's class.

    The HEAVY largest classes are broadcast, so no key of the join that finds the
    others holds a large share of the rows.
    """
    rows = sketches.select("doc_id", "n_shingles", "fp1", "fp2")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    copies = rows.where(usable).groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = stage_small(copies.where("copies > 1"), "copies")
    order = ["copies", "fp1", "fp2"]
    heavy = copies.orderBy(F.desc("copies"), "fp1", "fp2").limit(HEAVY)
    key = ["fp1", "fp2"]
    known = rows.where(usable).join(F.broadcast(heavy), key, "left")
    light = copies.join(F.broadcast(heavy.select(*order)), order, "left_anti").select(*key, F.col("rep").alias("own"))
    return stage_small(
        known.where("rep IS NOT NULL")
        .select("doc_id", "n_shingles", "rep")
        .unionByName(known.where("rep IS NULL").drop("rep").join(light, key, "left").select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("rep")))
        .unionByName(rows.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))),
        "members",
    )


def _link(src: DataFrame, num: int, den: int) -> DataFrame:
    sketches = sketch(src)
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    members = _classes(sketches)
    others = members.where("rep <> doc_id").select(F.col("doc_id").alias("other")).distinct()
    reps = usable.join(others, F.col("doc_id") == F.col("other"), "left_anti")

    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last")
    buckets = stage_small(banded.join(shared, "key"), "buckets")
    sig = reps.drop("fp1", "fp2")

    star = stage_small(buckets.where("lead < doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    tested = (
        star.join(sig.alias("y"), F.col("b") == F.col("y.doc_id"))
        .join(sig.alias("x"), F.col("a") == F.col("x.doc_id"))
        .where(_passing("x", "y", num, den))
        .select("a", "b")
        .distinct()
    )
    tested = stage_small(tested, "pairs")
    ids = stage_small(tested.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    links = stage_small(confirm(tested, shingle_sets(src, ids), num, den), "links")
    comp = _across(buckets, sig, None, src, links, star, num, den)
    return members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id")
    )


def keep_one(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without documents that a smaller id of their component stands for."""
    with scratch_scope(docs.sparkSession) as scratch:
        linked = link(docs, num, den, id_col, text)
        gone = stage_small(linked.where("component_id < doc_id").select("doc_id").distinct(), "gone")
        again = stage_small(linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
        out = without_ids(docs, id_col, gone)
        if again.limit(1).count():
            out = _one_row_each(out, id_col, text, again)
        scratch.release(out)
    return out


def _one_row_each(docs: DataFrame, id_col: str, text: str, again: DataFrame) -> DataFrame:
    """``docs`` with one row of each id in ``again``: the least by hash of its text.

    Rows of one id are reduced map-side, so an id may hold any share of them.
    """
    own = F.col(f"`{id_col}`").cast("bigint")
    rest = without_ids(docs, id_col, again)
    doubled = docs.join(again.toDF(name := free_name(docs.columns, "again")), own == F.col(name), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = doubled.groupBy(own.alias("id")).agg(F.min_by(row, F.xxhash64(F.col(f"`{text}`"))).alias("row"))
    return rest.union(one.select("row.*"))
