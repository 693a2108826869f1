import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import binary_output, decontam, htmltext, licenses, linedup, neardup, packing, pii, quality, textkernel, tokens, toxicity
from tessera.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, "the cat sat on the mat and the dog lay on the rug in the sun " * 3),
    (2, None),
    (3, ""),
    (4, "cc by cc by\nALL rights\treserved"),
    (5, "one two three four"),
    (5, "one two three four"),
    (None, "a text without an id but with words"),
    (7, "é" * 5000 + " x " * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{(i or 0) % 2}", 0, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")


def test_quality_measures_and_filter(docs):
    for r in quality.judge(docs).collect():
        t = r["text"] or ""
        ws = WORD.findall(t)
        grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        covered = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        m = r["quality"]["measures"]
        assert (m["n_words"], m["word_chars"], m["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(covered))
        assert r["quality"]["base_failed"] == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))
    assert quality.filter_documents(docs).columns == docs.columns
    assert quality.filter_documents(docs.where("false")).count() == 0


def test_quality_of_very_long_texts(spark):
    distinct = " ".join(map(str, range(200_000)))
    rows = [(1, distinct), (2, distinct + " " + distinct), (3, "x" * 3_000_000)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "quality.measures.*").collect()
    assert [(r["n_words"], r["n_repeat_words"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(200_000, 0), (400_000, 400_000), (1, 0)]


@pytest.mark.parametrize("limit,per_host", [(1000, 4096), (1000, 0), (0, 4096)])
def test_line_dedup(spark, monkeypatch, limit, per_host):
    monkeypatch.setattr(linedup, "HOST_LINES", per_host)
    rows = [(i, f"menu\nbody {i}\n\nfoot", "a") for i in range(20)] + [(50, "menu\nother", "b"), (51, None, "a"), (52, "", None)]
    rows += [(100 + i, "copy line", "c") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in linedup.drop_lines(df, "source", dropped="n", broadcast_lines=limit).collect()}
    assert got[3]["text"] == "body 3\n" and got[3]["n"] == 2
    assert got[50]["text"] == "menu\nother" and got[51]["text"] is None and got[52]["text"] == "" and got[100]["text"] == "copy line"
    assert len(got) == len(rows)
    long = "menu\n" + "x" * 3_000_000
    odd = spark.createDataFrame([(i, t, "a", None, "k", 1) for i, t in enumerate([f"menu\nbody {k}" for k in range(20)] + [long, long, None])], "bad_host int, text string, host string, bad_lines string, hit_lines string, page int")
    out = linedup.drop_lines(odd, "host", dropped="kept_lines", broadcast_lines=limit).collect()
    assert [c for c in out[0].asDict()] == [*odd.columns, "kept_lines"] and len(out) == 23
    assert sorted(r["kept_lines"] for r in out) == [0] + [1] * 22 and sum(r["text"] == long[5:] for r in out) == 2
    assert linedup.drop_lines(odd.where("false"), "host", broadcast_lines=limit).count() == 0


def test_license_scan(spark, docs):
    got = Counter()
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]] += 1
        if r["doc_id"] == 4:
            base = sorted((s["label"], s["first_word"]) for s in r["spans"] if s["kind"] == "base")
            assert base == [("cc-by", 0), ("cc-by", 2), ("reserved", 4)] and r["n_words"] == 7
    assert got == Counter(i for i, _ in TEXTS)
    notice = licenses.NOTICES["mit"].split()
    del notice[10:12]
    damaged = spark.createDataFrame([(1, "x " + " ".join(notice) + " y")], "doc_id bigint, text string")
    assert {s["label"] for s in licenses.scan(damaged).first()["spans"]} == {"mit"}


def brute_components(rows, num, den):
    sets, parent = {}, {}
    for i, t in rows:
        ws = WORD.findall((t or "").lower())
        s = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
        sets[i], parent[i] = s, i
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = list(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and den * n >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(seed, n_docs, edits):
    rnd = np.random.default_rng(seed)
    base = [f"w{x}" for x in rnd.integers(0, 400, 150)]
    rows = []
    for i in range(n_docs):
        ws = list(base)
        for p in rnd.integers(0, len(ws), int(rnd.integers(0, edits))):
            ws[p] = f"e{rnd.integers(0, 50)}"
        rows.append((i, " ".join(ws)))
    return rows


@pytest.mark.parametrize("many", [50, 0])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(neardup, "MANY", many)
    rows = edited(3, 90, 14) + [(200, None), (201, ""), (202, "two words"), (203, "Two WORDS"), (204, "other words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(df, 85, 100).collect()}
    assert got == brute_components(rows, 85, 100)
    assert sorted(r["doc_id"] for r in neardup.keep_one(df, 85, 100).collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_near_duplicates_join_documents_not_their_places_in_buckets(spark, monkeypatch):
    plans, write = [], neardup.stage_small

    def seen(df, name):
        if name == "open":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(neardup, "stage_small", seen)
    rows = edited(3, 40, 14)
    neardup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), 85, 100).collect()
    assert plans
    for plan in plans:  # rows are dealt to buckets above all joins
        assert 0 <= plan.find("Generate explode(keys") < plan.find("Join")


@pytest.mark.parametrize("worth", [0, 1])
def test_near_duplicates_equal_brute_force_whatever_the_passes_of_the_bound(spark, monkeypatch, worth):
    monkeypatch.setattr(neardup, "WORTH", worth)
    rows = edited(5, 60, 14)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(df, 85, 100).collect()} == brute_components(rows, 85, 100)


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_components_of_both_kinds(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "LOCAL_EDGES", most, raising=False)
    rnd = np.random.default_rng(7)
    ids = rnd.permutation(np.arange(-60, 60)).tolist()
    edges = list(zip(ids[:40], ids[1:41], strict=True)) + [tuple(sorted(rnd.choice(ids[41:], 2, replace=False).tolist())) for _ in range(45)]
    edges += edges[:5] + [(ids[50], ids[50])]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = neardup.components(df).collect()
    assert len(got) == len(least) and {r["node"]: r["comp"] for r in got} == least
    assert neardup.components(df.where("false")).count() == 0


def test_near_duplicates_jobs_do_not_grow_with_partitions_or_paths(spark):
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    path = spark.createDataFrame([(k, k + 1) for k in range(300)], "a bigint, b bigint")
    df = spark.createDataFrame(edited(3, 40, 14), "doc_id bigint, text string")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        jobs = {}
        for name, run in (("path", lambda: neardup.components(path)), ("map", lambda: neardup.shingle_sets(df, df.select("doc_id").distinct()))):
            sc.setJobGroup(f"jobs of {name}", "")
            run()
            jobs[name] = len(sc.statusTracker().getJobIdsForGroup(f"jobs of {name}"))
    finally:
        sc._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < jobs["path"] <= 6 and 0 < jobs["map"] <= 12  # the map took a job for each of 60 partitions


def test_near_duplicates_odd_rows(docs):
    got = [(r["doc_id"], r["component_id"]) for r in neardup.link(docs).collect()]
    assert Counter(got) == Counter((i, i) for i, _ in TEXTS)
    assert neardup.link(docs.where("false")).count() == 0


def test_html(spark):
    page = "<p>a<p>b &amp; c<ul><li>x<li>y</ul><table><tr><td>k<td>v<tr><td>long<td>w</table><script>no()</script><i hidden>no</i>end"
    assert htmltext.visible_text(page) == "a\n\nb & c\n\n- x\n- y\n\nk     v\nlong  w\n\nend"
    df = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<<b>>x</", "t")], "page_id int, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert got[2] is None and got[3] == "" and "x" in got[4]
    assert htmltext.visible_text("<div>" * 5000 + "deep") == "deep"
    clash = spark.createDataFrame([(1, page, "a", "b")] * 2, "page_id int, html string, visible string, `text` string")
    rows = htmltext.extract(clash).collect()
    assert len(rows) == 2 and rows[0]["visible"] == "a" and rows[0]["text"].startswith("a\n\nb & c") and htmltext.extract(clash.where("false")).count() == 0


@pytest.mark.parametrize(
    "markup",
    [
        "<table><tr><td>x" * 10_000, "<table><tbody>" * 10_000 + "x", "<pre>" * 10_000 + "z", "<pre>" + "<b>y" * 10_000, "<a " * 1_700_000, '<a ="' * 200_000,
        "<" * 1_000_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><table><tr><td>" + "<b>" * 50_000 + "<div>" * 50_000, "<ul><li>x" * 50_000,
        "<table>" + "<tr><td colspan=1000>x" * 20_000, "<table><tr><td>" + "w" * 20_000 + "<td>b" + "<tr><td>x<td>y" * 4_000, "<!--" * 100_000,
    ],
)
def test_html_hostile(markup):
    import time

    start = time.time()
    out = htmltext.visible_text(markup)
    assert time.time() - start < 3 * max(1.0, len(markup) / 1e6) and len(out) < 20 * len(markup)


def test_html_words_equal_a_plain_parser():
    """Brute force: the words of well-formed pages by the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            self.words += [] if self.off else data.split()

    rnd = np.random.default_rng(12)

    def block(depth):
        k = rnd.integers(0, 8) if depth else 0
        inner = "".join(block(depth - 1) for _ in range(rnd.integers(1, 4))) if k in (1, 2, 3, 6) else ""
        word = f"w{rnd.integers(1000)}"
        return [
            f"<p>{word} &amp; <b>{word}x</b>\n</p>", f"<div class='a>b'>{inner}</div>", f"<table><tr><td>{word}</td><td>{inner}</td></tr><tr><td>q</td></tr></table>",
            f"<blockquote>{inner}</blockquote>", f"<script>if (a < b) {word}</script>", f"<!-- {word} -->", f"<section>{inner}</section>", f"<h2 title=\"x>y\">{word}</h2>",
        ][k]

    for _ in range(60):
        page = f"<html><head><title>t</title></head><body>{''.join(block(4) for _ in range(6))}</body></html>"
        plain = Plain()
        plain.feed(page)
        assert htmltext.visible_text(page).split() == plain.words


def test_pii(spark):
    text = "Mail ann.lee@mail.org or ANN.lee@mail.org, card 4111 1111 1111 1111, ip 8.8.8.8, +1 (212) 555-1234, Mrs. Anna Smith and Anna Smith; Mr Иван Петров"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing here"), (5, text)], "doc_id int, text string")
    for few in (10_000, -1):
        got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, broadcast_fixes=few).collect()}
        assert got[2] is None and got[3] == "" and got[4] == "nothing here" and got[1] == got[5]
    for s, e, _ in pii.find(text):
        assert text[s:e] not in got[1]
    new = [(got[1][s:e], k) for s, e, k in pii.find(got[1])]
    assert [k for _, k in new] == [k for _, _, k in pii.find(text)]
    names = [v for v, k in new if k == "name_f"]
    assert names[0] == names[1] and names[0].split()[0] in pii.NAMES["latin", "f"]
    assert pii.luhn(re.sub(r"\D", "", next(v for v, k in new if k == "card")))


def test_pii_hostile_and_odd_rows(spark):
    import time

    for text in ("a" * 3_000_000 + " @", "@a" * 500_000, "a@" + "b." * 500_000 + "1", "password" * 100_000, "token " * 200_000, "1 " * 500_000, "AB12" * 300_000):
        start = time.time()
        pii.find(text)
        assert time.time() - start < max(1.0, len(text) / 1e6) * 2, text[:20]
    assert [(a, b) for a, b, _ in pii.find("to x.y+z@mail.example.org. or q@b.com.123, a@b")] == [(3, 25), (30, 37)]
    assert {t[a:b] for t in ["my name is Priya Raman here"] for a, b, _ in pii.find(t)} == {"Priya Raman"}
    rows = [(1, "call +1 212 555 1234 now", "a", "b", 1), (2, None, "c", "d", 2), (2, None, "c", "d", 2), (3, "call +1 212 555 1234 now", "e", None, 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, made string, n_found string, fixes int")
    for few in (10_000, -1):
        got = pii.pseudonymise(df, broadcast_fixes=few).collect()
        assert [c for c in got[0].asDict()] == df.columns and len(got) == 4
        assert len({r["text"] for r in got}) == 2 and {r["made"] for r in got} == {"a", "c", "e"}
    assert pii.pseudonymise(df.where("false")).count() == 0
    spark.conf.set(pii.KEY_SETTING, "one")
    a = pii.pseudonymise(df).collect()
    assert pii.pseudonymise(df).collect() == a
    spark.conf.set(pii.KEY_SETTING, "two")
    assert pii.pseudonymise(df).collect() != a
    spark.conf.unset(pii.KEY_SETTING)


def test_pii_equals_plain_replacement(spark):
    """Brute force: every entity by str.replace with its surrogate, over whole texts."""
    rnd = np.random.default_rng(3)
    names = ["Mr. Karl Brandt", "Anna Lopez", "Frau Schmidt", "Paul Weber"]
    def entity():
        k = rnd.integers(0, 5)
        return [f"u{rnd.integers(50)}@mail{rnd.integers(9)}.org", f"10.0.{rnd.integers(9)}.{rnd.integers(200)}", f"{rnd.integers(100, 999)}-12-{rnd.integers(1000, 9999)}", names[rnd.integers(0, 4)], "".join(rnd.choice(list("0123456789abcdef"), 40))][k]
    texts = [" ; ".join(f"word{rnd.integers(9)} {entity()}" for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, key=b"k").collect()}
    pairs = {}
    for k, t in enumerate(texts):
        old, new = [(t[a:b], c) for a, b, c in pii.find(t)], [got[k][a:b] for a, b, _ in pii.find(got[k])]
        assert len(old) == len(new) == 6
        plain = t
        for i, ((v, c), w) in enumerate(zip(old, new)):
            assert pairs.setdefault((c, v), w) == w and v != w
            plain = plain.replace(v, f"\0{i}\0")
        for i, w in enumerate(new):
            plain = plain.replace(f"\0{i}\0", w)
        assert plain == got[k]
    assert len(set(pairs.values())) == len(pairs) and not {v for _, v in pairs} & set(pairs.values())


def test_surrogates_are_permutations():
    s = pii.Surrogates(b"key")
    assert len({s.of("ssn", f"{a:03d}-{b:02d}-0001") for a in range(40) for b in range(40)}) == 1600
    assert len({s.of("email", f"{a}{b}@x.org") for a in "abcdefghij" for b in "klmnopqrst"}) == 100


def test_redrawn_surrogates_stay_distinct(spark):
    rows = [("ssn", f"000-00-{i:04d}", f"000-00-{(i + 1) % 50:04d}") for i in range(50)] + [("ssn", f"1{i}", "same") for i in range(3)]
    fixes = pii.redrawn(spark.createDataFrame(rows, "kind string, value string, surrogate string"), b"key").collect()
    values = {v for _, v, _ in rows}
    assert len({f["surrogate"] for f in fixes}) == len(fixes) >= 50 and not values & {f["surrogate"] for f in fixes}


def test_packing_of_histograms():
    rnd = np.random.default_rng(5)
    for size in (10, 37):
        for _ in range(40):
            counts = Counter(int(x) for x in rnd.integers(1, size + 1, 60))
            patterns = packing.plan(dict(counts), size)
            used = Counter()
            for k, lengths in patterns:
                assert sum(lengths) <= size and k > 0
                for x in lengths:
                    used[x] += k
            assert used == counts
            total, plain = sum(k for k, _ in patterns), sum(k for k, _ in packing.best_fit(dict(counts), size))
            assert -(-sum(x * c for x, c in counts.items()) // size) <= total <= plain + 1
    assert packing.plan({}, 8) == []


def test_reduction_is_optimal_on_small_cases():
    @lru_cache(None)
    def best(items, size):
        if not items:
            return 0
        first, rest, low = items[0], items[1:], 99
        for mask in range(1 << len(rest)):
            chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(chosen) <= size:
                left = tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)
                low = min(low, 1 + best(left, size))
        return low

    rnd = np.random.default_rng(1)
    for _ in range(60):
        items = tuple(sorted((int(x) for x in rnd.integers(1, 11, 7)), reverse=True))
        fixed, rest = packing.reduce_instance(dict(Counter(items)), 10)
        left = tuple(sorted((x for x, c in rest.items() for _ in range(c)), reverse=True))
        assert sum(k for k, _ in fixed) + best(left, 10) == best(items, 10)


@lru_cache
def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole_ids(text):
    return fresh_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_packing_query(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    place = {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in place.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*whole_ids(t), 0], "<u4")
        head = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tok"
    manifest = binary_output.write_tokens(docs, folder, tokenizer_path(), shards=3)
    got = binary_output.read_tokens(manifest, folder).orderBy("start").collect()
    start, want = 0, Counter()
    for g in got:
        assert g["start"] == start
        start += g["n_tokens"]
    for i, t in TEXTS:
        ids = np.array([*whole_ids(t), 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == want
    known = [g["doc_id"] for g in got if g["doc_id"] is not None]
    assert known == sorted(known)
    r = np.random.default_rng(0).integers(0, 1 << 32, 1001, dtype=np.uint64).astype(np.uint32) >> np.arange(1001, dtype=np.uint32) % 32
    lens = np.array([0, 1, 4, 0, 5, 990, 1, 0])
    c, d, size = binary_output.encode_ranks(r, lens)
    assert (binary_output.decode_ranks(c, d, lens) == r).all()
    assert len(c) == 1 + 1 + 2 + 248 + 1 and size.sum() == len(d) and size[0] == 0
    assert not len(binary_output.decode_ranks(*binary_output.encode_ranks(r[:0], lens[:1])[:2], lens[:1]))


def test_token_files_odd_rows(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert binary_output.read_tokens(binary_output.write_tokens(docs.where("false"), folder, tokenizer_path()), folder).count() == 0
    rows = [(None, "same text")] * 40 + [(3, "x " * 200_000), (3, "tie"), (3, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, ids int, tie int, row int").repartition(5)
    folder = f"file://{tmp_path}/some"
    got = binary_output.read_tokens(binary_output.write_tokens(df, folder, tokenizer_path(), shards=6), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 40 + [3] * 3 and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(43)]
    assert sorted(r["n_tokens"] for r in got[40:]) == sorted(len(whole_ids(t)) + 1 for _, t in rows[40:])
    path = sorted((tmp_path / "some").glob("shard-*"))[0]
    by_rank = np.fromfile(tmp_path / "some/ranks.bin", "<u4")
    whole = path.read_bytes()
    for cut in (whole[:-1], whole[:-24], b"other" + whole):
        path.write_bytes(cut)
        with pytest.raises(ValueError):
            list(binary_output.read_shard(f"file://{path}", by_rank))


def test_packing_odd_rows(spark, docs):
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0
    df = spark.createDataFrame([(None, "a b", 1, 2)] * 3 + [(1, None, 1, 2)], "doc_id bigint, text string, piece int, task int")
    got = packing.pack(df, tokenizer_path()).collect()
    assert len(got) == 4 and sorted(r["offset"] for r in got)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_pieces_equal_whole_texts():
    import random

    import pyarrow as pa

    rnd, e = random.Random(2), tokens.encoder(tokenizer_path())
    for letters in ("ab ,.!\n\t  'sté1_日-(", "ab .\x1c\xa0 '\n"):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
        got = {}
        for i, n, ids in e.encode_column(pa.array(texts)):
            for k, part in enumerate(np.split(ids, np.cumsum(n)[:-1])):
                got[i + k] = part.tolist()
        assert all(got[i] == whole_ids(t) for i, t in enumerate(texts))


def test_secret_without_digits():
    text = "password = correcthorsebattery"
    assert [text[a:b] for a, b, kind in pii.find(text) if kind == "secret"] == ["correcthorsebattery"]
    assert pii.find("a plain text: no entities = none") == []


def test_leaks(spark):
    rnd = np.random.default_rng(4)
    def words(n):
        return [f"t{x}" for x in rnd.zipf(1.3, n) % 3000]
    items = [(k, " ".join(words(30)) + ". " + " ".join(words(12))) for k in range(12)] + [(90, None), (91, "")]
    rows = [(k, " ".join(words(300))) for k in range(60)]
    for k in range(12):
        rows.append((100 + k, " ".join(words(100)) + " " + items[k][1].upper() + " " + " ".join(words(80))))
        ws = items[k][1].split()
        del ws[5], ws[20]
        rows.append((200 + k, " ".join(words(40)) + " " + " ".join(ws)))
    rows += [(300, None), (301, ""), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    assert got == {(b + k, k) for b in (100, 200) for k in range(12)} | {(None, 0)}
    assert decontam.find_leaks(df, bench.where("false")).count() == 0
    assert decontam.find_leaks(df.where("false"), bench).count() == 0
    assert decontam.drop_leaks(df, bench).count() == 62
    clash = df.select("doc_id", "text", F.lit(1).alias("gone"), F.lit(2).alias("key"), F.lit(3).alias("words"))
    assert decontam.drop_leaks(clash.union(clash), bench).count() == 124 and decontam.drop_leaks(clash, bench).columns == clash.columns
    assert decontam.lcs([1, 2, 3, 4], [2, 9, 4, 1]) == 2


@pytest.mark.parametrize("block", [2048, 4])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    """Brute force: the longest common subsequence of every item with every stretch of every text."""
    monkeypatch.setattr(decontam, "BLOCK", block)
    rnd = np.random.default_rng(21)
    def words(n):
        return [f"t{x}" for x in rnd.zipf(1.3, n) % 3000]
    def broken(ws, share, extra):
        kept = [w for w in ws if rnd.random() < share]
        return [x for w in kept for x in ([w] + words(1) if rnd.random() < extra else [w])]
    items = [(k, words(int(rnd.integers(20, 50)))) for k in range(10)]
    texts = [words(200) for _ in range(20)]
    for share, extra in ((1.0, 0.0), (0.9, 0.0), (0.85, 0.0), (0.9, 0.2), (0.5, 0.0), (0.3, 0.5)):
        for _, ws in items:
            texts.append(words(int(rnd.integers(0, 120))) + broken(ws, share, extra) + words(int(rnd.integers(0, 120))))
    def best(ws, text):
        m, reach = len(ws), len(ws) + len(ws) // 2
        return max(decontam.lcs(ws, text[a : a + reach]) for a in range(0, max(1, len(text) - m // 2)))
    want = {(d, k) for d, text in enumerate(texts) for k, ws in items if best(ws, text) >= 0.8 * len(ws)}
    loose = {(d, k) for d, text in enumerate(texts) for k, ws in items if decontam.lcs(ws, text) >= 0.6 * len(ws)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    assert len(want) > 25 and len(got & want) >= 0.97 * len(want) and got <= loose


def test_verbatim_leaks_at_any_cosine(spark):
    rnd = np.random.default_rng(9)
    def words(n):
        return [f"t{x}" for x in rnd.zipf(1.3, n) % 3000]
    items = [(k, " ".join(words(15 + 4 * k))) for k in range(12)]
    rows = [(k, " ".join(words(150) + [items[k][1]] + words(90))) for k in range(12)] + [(50, " ".join(words(300)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench, cosine=2.0).collect()}
    assert got == {(k, k) for k in range(12)}


def test_short_leaks(spark):
    rnd = np.random.default_rng(11)
    def words(n):
        return [f"t{x}" for x in rnd.zipf(1.3, n) % 3000]
    items = [(m, " ".join(f"t{1000 * m + x}" for x in range(m))) for m in range(1, 8)]
    rows = [(m, " ".join(words(100) + [x] + words(80))) for m, x in items] + [(50, " ".join(words(300)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench, cosine=2.0).collect()}
    assert got >= {(m, m) for m in range(1, 8)}


def test_toxicity(spark):
    rnd = np.random.default_rng(6)
    clean = [f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in range(400)]
    rows, labels = [], []
    for i in range(500):
        ws = list(rnd.choice(clean, 60))
        bad = i % 8 == 0
        if bad:
            for p in rnd.integers(0, 60, 4):
                ws[p] = str(rnd.choice(["stinker", "nitwit", "bozo"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows + [(900, None), (901, ""), (901, ""), (903, "stinker " * 200_000)]], "doc_id bigint, text string, toxic string, id string, label_id int")
    lab = spark.createDataFrame(labels + [(902, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels) and got[900] == got[901] < 0.5 <= got[903]
    assert toxicity.score(df.where("false"), model).count() == 0 and toxicity.train(df.where("false"), lab) is None
    held = df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert toxicity.train(df, lab.where("toxic = 0")) is None
    assert toxicity.score(df, None).where("score <> 0").count() == 0


def test_lexicon_at_any_number_of_tasks(spark):
    rnd = np.random.default_rng(2)
    plain = lambda: " ".join(f"plain w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rnd.integers(0, 676, 30))
    rows = [(f"bozo {plain()} bozo {plain()} bozos", 1.0) for _ in range(30)] + [(plain(), 0.0) for _ in range(120)]
    rows += [(f"copied nonsense {'x' * 5} of one page " * 3, 1.0)] * 9
    for n in (1, len(rows)):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "text string, toxic double")
        assert toxicity.mine_lexicon(df) == ["^bozo"] or toxicity.mine_lexicon(df)[0][1:].startswith("boz"), n
        assert not any(k[1:].startswith(("pla", "cop", "non")) for k in toxicity.mine_lexicon(df)), n


def test_label_model_learns_from_votes(spark):
    """Brute force: expectation-maximisation row by row equals that over patterns at any number of tasks."""
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(["bozo"] * int(rnd.integers(0, 3) * (i % 5 == 0)) + ["nitwit"] * int(i % 5 == 0 and i % 3 > 0) + ["a plain word here"] * 12)) for i in range(300)]
    lexicon = ["=bozo", "=nitwit"]
    counter = toxicity.Votes(lexicon)
    import pyarrow as pa

    v = toxicity.votes(*counter.counts(pa.array([t for _, t in rows])))
    def started():
        m = toxicity.LabelModel(v.shape[1])
        m.update(toxicity.weighted_sums(v[:60], toxicity._class_weights(np.array([i % 5 == 0 for i in range(60)], float), np.ones(60, np.int64)), True))
        return m
    plain = started()
    for r in range(3):
        plain.update(toxicity.weighted_sums(v, toxicity._class_weights(plain.posterior(v), np.ones(len(v), np.int64)), r == 0))
    for n in (1, 7):
        model = started()
        toxicity.learn_from_votes(spark.createDataFrame(rows, "doc_id int, text string").repartition(n), lexicon, model, 3)
        assert np.array_equal(model.rates, plain.rates) and np.array_equal(model.weights, plain.weights) and model.prior == plain.prior
    assert (plain.accuracy[:2] > 0.9).all()


def thue_morse(n):
    """Two words that are each other's complement; sums of powers can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("lanes", [1 << 17, 3])
def test_word_kernel(monkeypatch, lanes):
    monkeypatch.setattr(textkernel, "_LANES", lanes)
    raw = np.frombuffer(b"one two  three one averyveryverylongwordindeed two one", np.uint8)
    s, e, d = textkernel.words(raw, np.array([0, 8, 8, len(raw)]))
    assert d.tolist() == [0, 0, 2, 2, 2, 2, 2]
    rnd = np.random.default_rng(1)
    texts = [" ".join("ab"[x] * n for x, n in zip(rnd.integers(0, 2, 300), rnd.integers(1, 40, 300))), *thue_morse(1024), *thue_morse(4096), "a" * 16, "a" * 17, "\0" * 9, "\0" * 8]
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    s, e, _ = textkernel.words(raw, np.array([0, len(raw)]))
    for hashed in (textkernel.hash_words(raw, s, e), textkernel.piece_keys(raw, s, e)):
        seen = {}
        for a, b, x in zip(s, e, hashed):
            assert seen.setdefault(raw[a:b].tobytes(), x) == x
        assert len(set(seen.values())) == len(seen)
    n = np.array([1024, 4096, 4096])
    at = np.array([raw.tobytes().index(x.encode()) for x in (*thue_morse(1024), *thue_morse(4096))])
    assert textkernel.same_bytes(raw, n[:2], at[[0, 2]], at[[0, 2]]) and not textkernel.same_bytes(raw, n[:1], at[:1], at[1:2])


def test_colliding_words(spark):
    """Long words of equal letters in another order are other words, ids and documents."""
    rows = [(k, w) for k, w in enumerate((*thue_morse(1024), *thue_morse(4096)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.link(df).collect()} == {k: k for k in range(4)}
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(df, tokenizer_path(), size=1 << 20).collect()}
    assert got == {k: zlib.crc32(np.array([*whole_ids(w), 0], "<u4").tobytes()) for k, w in rows}


def test_pieces_with_one_key(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textkernel, "piece_keys", lambda raw, s, e: np.zeros(len(s), np.uint64))
    texts = ["one two three two", "four"]
    _, n, ids = next(tokens.encoder(tokenizer_path()).encode_column(pa.array(texts)))
    assert ids.tolist() == whole_ids(texts[0]) + whole_ids(texts[1])


def test_near_duplicates_sharing_ids(spark):
    """A group of copies over many ids, some of them repeated, and columns with clashing names."""
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(k % 40, text, k, k) for k in range(80)] + [(50, None, 1, 1), (50, None, 2, 2), (60, "", 3, 3), (None, text, 4, 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, gone int, `again` int")
    kept = neardup.keep_one(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 0), (False, 50), (False, 60), (True, None)]
    assert neardup.keep_one(df).columns == df.columns


def test_runs_of_the_pipeline_keep_to_themselves(spark, tmp_path):
    import corpus_pipeline
    import pandas as pd

    words = [f"the of word{k} stands" for k in range(40)]
    rows = [(k, " ".join(words[k % 5 : 30 + k % 5]) + f" {k} " + " and the ".join(words[:k]), "en", "s", 0) for k in range(8)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(0, "nothing like it")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, first.drop("sequence_id", "offset").collect())) == sorted(map(tuple, second.drop("sequence_id", "offset").collect()))


def test_pipeline_small(spark, tmp_path):
    import corpus_pipeline
    import pandas as pd

    rnd = np.random.default_rng(8)
    def prose(n):
        return " ".join(rnd.choice("the of and to in a is that river stone green walk light seven apple under".split(), n)) + f" {rnd.integers(1 << 40)}"
    item = " ".join(f"q{k}" for k in range(30))
    texts = [prose(80) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(40, texts[0]), (41, "###"), (42, prose(40) + " " + item), (43, None)]
    docs = pd.DataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(0, item)], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(30))
