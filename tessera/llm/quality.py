"""Quality rules: a threshold table compiled into one projection.

Each rule names a measure, a comparison and a threshold; ``judge`` compiles all
of them into one ``select`` without user functions.

Defined results: a null or empty text has no words, all measures 0, and fails
the base rule (fewer than ten words).  Repeated rows are judged alike; other
columns pass through untouched unless they have a measure's name, in which case
``judge`` keeps the measures inside one struct column of the caller's choice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import bind

SPACE = r"[\x20\x09-\x0D]+"

#: Common function words of the four corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this from or "
    "de la le les et des un une que qui en el los las y der die das und ist ein von zu den mit auf se del"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    op: str
    threshold: float
    #: The rule speaks only on texts with this many words or lines at least.
    over: str | None = None
    least: int = 0


#: Ratios are per word, per line or per letter, each in its own unit.
RULES = (
    Rule("word_length_low", "mean_word_length", ">=", 2.0),
    Rule("word_length_high", "mean_word_length", "<=", 15.0),
    Rule("symbols", "symbol_ratio", "<=", 0.3),
    Rule("exclamations", "exclamation_ratio", "<=", 0.5),
    Rule("capitals", "capital_ratio", "<=", 0.6),
    Rule("stop_words", "stop_word_ratio", ">=", 0.02, "n_words", 50),
    Rule("duplicate_lines", "duplicate_line_ratio", "<=", 0.5, "n_lines", 4),
    Rule("bullet_lines", "bullet_line_ratio", "<=", 0.9, "n_lines", 4),
    Rule("ellipsis_lines", "ellipsis_line_ratio", "<=", 0.5, "n_lines", 4),
    Rule("doubled_words", "doubled_word_ratio", "<=", 0.3, "n_words", 10),
)


def _repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words' hashes; texts whose
    windows are all distinct leave after one hash-set pass, others sort (hash,
    place) once, so the cost is n log n however often a window repeats.  Five
    reads by place make a window: a slice would copy the whole array each time.
    """

    def covered(places: Column) -> Column:
        # places ascend; each adds five words less its overlap with the next
        return F.aggregate(
            F.transform(
                places,
                lambda p, k: F.least(F.lit(5), F.coalesce(F.get(places, k + 1) - p, F.lit(5))),
            ),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + x,
        )

    def repeated(s: Column) -> Column:
        same = F.filter(
            s,
            lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]),
        )
        return bind(F.array_sort(F.transform(same, lambda e: e["p"])), covered)

    def search(h: Column) -> Column:
        pairs = F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            bind(F.sort_array(pairs), repeated)
        )

    def windows(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.size(h) - 4)
        return bind(F.transform(starts, lambda x, k: F.xxhash64(x, *[F.get(h, k + i) for i in range(1, 5)])), search)

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < 6, F.lit(0).cast("bigint")).otherwise(bind(hashes, windows))


def _length(x: Column) -> Column:
    return F.length(x).cast("bigint")


def measures(text: Column) -> Column:
    """One struct with every measure of ``text``; each count is made once, ratios from the counts."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def size(x: Column) -> Column:
        return F.size(x).cast("bigint")

    def of_counts(c: Column) -> Column:
        return F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
            ratio(c["word_chars"], c["n_words"]).alias("mean_word_length"),
            ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
            ratio(c["marks"], c["n_words"]).alias("exclamation_ratio"),
            ratio(c["capitals"], c["letters"]).alias("capital_ratio"),
            ratio(c["stops"], c["n_words"]).alias("stop_word_ratio"),
            ratio(c["doubled"], c["n_words"]).alias("doubled_word_ratio"),
            ratio(c["n_dup_lines"], c["n_lines"]).alias("duplicate_line_ratio"),
            ratio(c["bullets"], c["n_lines"]).alias("bullet_line_ratio"),
            ratio(c["dots"], c["n_lines"]).alias("ellipsis_line_ratio"),
        )

    def of_words(t: Column, ws: Column) -> Column:
        n = size(ws)
        chars = _length(F.array_join(ws, ""))
        symbols = _length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))
        letters = _length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        capitals = _length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
        marks = _length(F.regexp_replace(t, r"[^!]+", ""))
        # lower case never has fewer code points, so longer words need none
        stops = size(F.filter(ws, lambda w: (F.length(w) <= max(map(len, STOP_WORDS))) & F.lower(w).isin(STOP_WORDS)))
        doubled = size(F.filter(ws, lambda w, k: (k > 0) & (w == F.get(ws, k - 1))))

        def of_lines(ls: Column) -> Column:
            m = size(ls)
            dup = m - size(F.array_distinct(ls))
            bullets = size(F.filter(ls, lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])\s")))
            # the plain search spares most lines the pattern's tries at each space
            dotted = F.filter(ls, lambda x: (F.contains(x, F.lit("...")) | F.contains(x, F.lit("…"))) & x.rlike(r"(?:\.\.\.|…)\s*$"))
            counts = F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                dup.alias("n_dup_lines"),
                _repeat_words(ws).alias("n_repeat_words"),
                m.alias("n_lines"),
                letters.alias("letters"),
                capitals.alias("capitals"),
                marks.alias("marks"),
                stops.alias("stops"),
                doubled.alias("doubled"),
                bullets.alias("bullets"),
                size(dotted).alias("dots"),
            )
            return bind(counts, of_counts)

        return bind(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)

    def of_text(t: Column) -> Column:
        return bind(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda ws: of_words(t, ws))

    return bind(F.coalesce(text, F.lit("")), of_text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (F.lit(100) * m["n_repeat_words"] > F.lit(20) * m["n_words"])


def compile_rules(m: Column, rules=RULES) -> Column:
    """Names of the rules that ``m`` breaks, as an array."""
    ops = {">=": lambda a, b: a < b, "<=": lambda a, b: a > b}
    broken = []
    for r in rules:
        bad = ops[r.op](m[r.measure], F.lit(r.threshold))
        if r.over:
            bad = bad & (m[r.over] >= r.least)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES) -> DataFrame:
    """``docs`` with a struct column ``into``: measures, base_failed, failed_rules, kept."""
    m = measures(F.col(f"`{text}`"))
    done = bind(
        m,
        lambda x: F.struct(
            x.alias("measures"),
            base_failed(x).alias("base_failed"),
            compile_rules(x, rules).alias("failed_rules"),
        ),
    )
    done = bind(
        done,
        lambda x: F.struct(
            x["measures"].alias("measures"),
            x["base_failed"].alias("base_failed"),
            x["failed_rules"].alias("failed_rules"),
            (~x["base_failed"] & (F.size(x["failed_rules"]) == 0)).alias("kept"),
        ),
    )
    return docs.withColumn(into, done)


def filter_documents(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    mark = "__quality"
    while mark in docs.columns:
        mark += "_"
    return judge(docs, text, mark, rules).where(F.col(mark)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
