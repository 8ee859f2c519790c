"""Every operator on texts against a brute-force version, and on what a table can hold at its worst."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import common, flat, langid, leaks, minhash, mixing, passages, quality, suffixes, tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], DOCS)


def corpus(seed=1):
    """Copies, near-copies, shared passages, empty, blank, null and long texts, with repeated rows."""
    rng, rows = random.Random(seed), []
    for i in range(60):
        rows.append((i, prose(rng, rng.choice([1, 2, 3, 5, 30, 80, 200])), "en", f"src{i % 3}"))
    passage = prose(rng, 70, 10**6)
    for i in range(60, 70):
        rows.append((i, prose(rng, 40) + " " + passage + " " + prose(rng, 25), "en", "src0"))
    base = prose(rng, 120, 10**6).split()
    for i in range(70, 90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "en", "src0"))
    rows += [(90, None, None, None), (91, "", "en", "src1"), (92, " \t\n\x0b\x0c\r ", "en", "src1"), (93, prose(rng, 30_000, 10**6), "en", "src2"), (None, prose(rng, 60), "en", "src1")]
    rows += [(94, rows[75][1].upper(), "en", None), (95, "a" * 300_000, "en", "src1"), (96, "É à ñ\n" * 50, "fr", "src1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


def components(ids, linked):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if find(a) != find(b) and linked(a, b):
            par[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


# -- shared parts -----------------------------------------------------------------------------------


def test_words_and_shingles():
    texts = ["The cat  sat", "", None, "\tA\nb\x0bc\x0cd\re ", "één ß", "x"]
    h, s, e, off = flat.words(*flat.span(pa.array(texts)))
    assert list(np.diff(off)) == [len(words(t)) for t in texts]
    by = {}
    for x, w in zip(h.tolist(), [w for t in texts for w in words(t)]):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    sh, soff = flat.shingles(h, off, 3)
    assert list(np.diff(soff)) == [1, 0, 0, 3, 1, 1] and len(set(sh.tolist())) == 6
    sliced = pa.array(["zz zz", *texts]).slice(1)
    assert (flat.words(*flat.span(sliced))[0] == h).all()


def test_chunks_are_whole():
    texts = pa.array(["a" * 10, "b" * 100, None, "c" * 5, ""] * 5)
    parts = list(flat.chunks(texts, 30))
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == 25
    assert sum((p[2].to_pylist() for p in parts), []) == texts.to_pylist()


def test_minimisers_meet_every_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    woff = np.array([0, 0, 120, 130, 500])
    p = flat.minimisers(h, woff, 4, 9)
    for a, b in zip(woff, woff[1:]):
        for i in range(a, b - 12 + 1):
            assert ((p >= i) & (p + 4 <= i + 12)).any()


def test_thinned_places_meet_every_window():
    rng = np.random.default_rng(1)
    h = np.concatenate([rng.integers(0, 999, 40), np.full(200, 7), rng.integers(0, 999, 50), np.full(9, 3), rng.integers(0, 999, 60)]).astype(np.uint64)
    woff = np.array([0, len(h)])
    every = flat.minimisers(h, woff, passages.K, passages.W)
    p = passages._thinned(h, every)
    assert len(p) < len(every) / 3 and set(p) <= set(every)
    for i in range(len(h) - passages.K - passages.W + 2):
        assert ((p >= i) & (p <= i + passages.W - 1)).any()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)] + [(None, 1), (7, None), (5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = {(a, b) for a, b in edges if a is not None and b is not None and a != b}
    ids = {x for e in real for x in e}
    assert got == components(ids, lambda a, b: (a, b) in real or (b, a) in real)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("one_task", [10**6, 150, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(1, 40)]
    before, context = spark.createDataFrame(edges, "a long, b long"), spark.sparkContext
    context.setJobGroup(f"components {one_task}", "")
    try:
        got = {r.node: r.component for r in common.connected_components(before).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup(f"components {one_task}"))
    finally:
        context._jsc.clearJobGroup()
    real = {(a, b) for a, b in edges if a != b}
    assert got == components({x for e in real for x in e}, lambda a, b: (a, b) in real or (b, a) in real)
    assert one_task < len(edges) or jobs <= 8  # few edges don't cost the driver a plan for every round


def test_block_pairs_bring_all_rows_together(spark):
    df = spark.createDataFrame([(k, i, 1) for k in (1, 2) for i in range(100 if k == 1 else 3)], "k long, i long, one int")
    groups = collections.defaultdict(set)
    for r in common.block_pairs(df, ["k"], "one", "i", 20).collect():
        groups[r.k, r.bi, r.bj].add(r.i)
    met = {(a, b) for (k, *_), g in groups.items() if k == 1 for a in g for b in g}
    assert len(met) == 100 * 100 and max(map(len, groups.values())) < 80 and len(groups[2, 0, 0]) == 3


def test_grouped_holds_groups_whole():
    ks = [1] * 5 + [2] * 9 + [3] + [4] * 20
    table = pa.table({"k": ks, "v": list(range(len(ks)))})
    for size in (1, 2, 3, 7, 50):
        parts = list(common.grouped(iter(table.to_batches(max_chunksize=size)), ["k"]))
        assert [v for p in parts for v in p.column("v").to_pylist()] == list(range(len(ks)))
        owners = collections.Counter(k for p in parts for k in set(p.column("k").to_pylist()))
        assert max(owners.values()) == 1


# -- MinHash ----------------------------------------------------------------------------------------


def check_minhash(got, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)

    want = components([i for i in sets if i is not None], linked)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)


def test_minhash_against_brute_force(spark, docs, rows):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    check_minhash(got, rows)
    assert sum(not r.kept for r in got) >= 10


def test_minhash_in_blocks_and_crowded_regions(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", 300)
    check_minhash(minhash.near_duplicates(docs).collect(), rows)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    near = [" ".join(w if rng.random() > 0.01 else f"y{rng.randrange(99)}" for w in base) for _ in range(300)]
    batch = pa.record_batch({"id": list(range(300)), "text": near})
    sig = pa.Table.from_batches(minhash.signatures(iter([batch]), 3))
    sigs, sk = minhash._rows(sig.column("sig"), ">u2", 128)[:, :8], minhash._rows(sig.column("sketch"), "<u8", 4)
    order = np.lexsort(sigs.T[::-1])
    monkeypatch.setattr(minhash, "CROWD", 20)
    out = []
    same = np.logical_and.accumulate(sigs[order][1:] == sigs[order][:-1], axis=1).sum(1)
    minhash._region(np.append(0, same), order, sk[order], 0, 300, 2, out, 4, 90)
    assert all((x != y).all() for x, y in out) and sum(len(x) for x, _ in out) < 300


def test_minhash_of_a_region_too_crowded_for_a_task(spark, monkeypatch):
    assert (minhash.deepest(85, 100), minhash.deepest(80, 100)) == (4, 2)
    rng, rows = random.Random(21), []
    head = " ".join(f"t{i}" for i in range(120))  # a template: much in common, and not enough for a link
    for _ in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        for k in (0, 1):
            w = list(own)
            for _ in range(4 * k):
                w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), head + " " + " ".join(w), "en", "s"))
    rng.shuffle(rows)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    monkeypatch.setattr(minhash, "CROWD", 4)
    monkeypatch.setattr(minhash, "HOLD", 6)
    check_minhash(minhash.near_duplicates(make(spark, rows)).collect(), rows)


def test_minhash_empty_and_extra_columns(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    clash = docs.withColumns({"component_id": F.lit("x"), "n": F.lit(1), "id": F.lit(2), "node": F.lit(3), "size": F.lit(4)})
    assert minhash.near_duplicates(clash).count() == docs.count()
    again = minhash.near_duplicates(docs.unionByName(docs)).where("doc_id = 5").collect()
    assert len(again) == 2 and again[0] == again[1]


# -- suffix arrays ----------------------------------------------------------------------------------


def coverage(rows, least=50):
    seen = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(i)
    out = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                out[i].update(range(k, k + least))
    return dict(out)


def test_suffixes_against_brute_force(spark, docs, rows):
    use = [r for r in rows if r[0] is not None]
    got = collections.defaultdict(set)
    for r in suffixes.repeated(docs).collect():
        assert r.n_words == r.end - r.start >= 50 and r.other_doc_id != r.doc_id
        got[r.doc_id].update(range(r.start, r.end))
    assert dict(got) == coverage(use)
    with pytest.raises(ValueError):
        suffixes.repeated(docs, least=30)
    assert suffixes.repeated(docs.limit(0)).count() == 0
    assert suffixes.repeated(docs.unionByName(docs).withColumn("key", F.lit(1))).count() == suffixes.repeated(docs).count()


@pytest.mark.parametrize("hold", [100_000, 3])
def test_suffixes_in_many_partitions(spark, monkeypatch, hold):
    rng, rows = random.Random(12), []
    for _ in range(60):
        passage = prose(rng, rng.choice([50, 50, 51, 60]), 10**6)
        for _ in range(rng.choice([2, 2, 3, 9])):
            rows.append((len(rows), prose(rng, rng.choice([0, 3, 40]), 10**6) + " " + passage + " " + prose(rng, rng.choice([1, 30]), 10**6), "en", "s"))
    hot = prose(rng, 20, 10**6)  # one anchor in many surroundings
    for g in range(10):
        before, after = prose(rng, 29, 10**6), prose(rng, 29, 10**6)
        for _ in range(4):
            rows.append((len(rows), " ".join([prose(rng, 5, 10**6), before, hot, after, prose(rng, 5, 10**6)]), "en", "s"))
    monkeypatch.setattr(suffixes, "HOLD", hold)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        got = collections.defaultdict(set)
        for r in suffixes.repeated(make(spark, rows)).collect():
            got[r.doc_id].update(range(r.start, r.end))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert dict(got) == coverage(rows)


def test_suffixes_move_texts_once(spark, monkeypatch):
    """Light and heavy anchors in one table: one pass over the texts makes the windows of both."""
    rng, plans, materialise = random.Random(13), [], common.materialise
    hot, two = (prose(rng, 60, 10**6) for _ in range(2))
    rows = [(i, " ".join([prose(rng, 35, 10**6), hot if i < 6 else two, prose(rng, 35, 10**6)]), "en", "s") for i in range(8)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(suffixes, "HOLD", 3)
    monkeypatch.setattr(common, "materialise", lambda df, *a, **k: plans.append(plan(df)) or materialise(df, *a, **k))
    out = suffixes.repeated(make(spark, rows))
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r.doc_id].update(range(r.start, r.end))
    assert dict(got) == coverage(rows) and len(got) == 8
    assert sum(len(re.findall(r"MapInArrow [^\n]*found#", p)) for p in [*plans, plan(out)]) == 1


# -- passages ---------------------------------------------------------------------------------------


def test_passages(spark, docs, rows):
    found = passages.repeated(docs).collect()
    covered = {r.doc_id for r in found}
    assert set(coverage([r for r in rows if r[0] is not None], 51)) <= covered
    assert not covered & {i for i, *_ in rows[:60]} or all(words(dict((r[0], r[1]) for r in rows)[i]) for i in covered)
    for r in found:
        assert r.kept == (r.doc_id == r.first_doc_id and r.kept) and r.end - r.start >= (20 if r.kind == "passage" else 5)
    by = collections.defaultdict(list)
    for r in found:
        by[r.kind, r.class_id].append(r)
    assert all(sum(r.kept for r in v) == 1 and (len({r.doc_id for r in v}) > 1 or k[0] == "passage") for k, v in by.items())
    text = {r[0]: words(r[1]) for r in rows}
    for (kind, _), v in by.items():
        if kind == "passage" and len({tuple(text[r.doc_id][r.start : r.end]) for r in v}) > 1:
            assert {r.end - r.start for r in v} == {20}  # windows that are alike


def test_near_paragraphs_against_brute_force(spark):
    rng = random.Random(4)
    rows, lines = [], {}
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(rng.choice([25, 60, 120]))]
        for k in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            i = len(rows)
            lines[i] = w
            rows.append((i, f"head{i} of {i}\n" + " ".join(w) + f"\ntail{i}", "en", "s"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in lines.items()}
    want = components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    groups = collections.defaultdict(set)
    for r in passages.repeated(make(spark, rows)).where("kind = 'paragraph'").collect():
        groups[r.class_id].add(r.doc_id)
    expected = collections.defaultdict(set)
    for i, c in want.items():
        expected[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_short_paragraphs(spark):
    base = [f"b{i}" for i in range(19)]
    shared = {1: ["one"], 3: ["x", "y", "z"], 6: base[:6], 9: [f"c{i}" for i in range(9)], 13: [f"d{i}" for i in range(13)]}
    near = {13: [*shared[13][:-1], "other"]}  # 8 of 10 shingles
    rows, want = [], set()
    for n, w in shared.items():
        for k in range(3):
            i = len(rows)
            x = near.get(n, w) if k == 1 else w
            rows.append((i, f"only{i} a{i}\n" + " ".join(x) + f"\nlast{i}", "en", "s"))
            want.add((i, 2, 2 + n, i - k, k == 0))
    for k, n in enumerate((5, 7, 30)):  # one shingle, whatever the length
        i = len(rows)
        rows.append((i, " ".join(["same"] * n) + f"\nlast{i}", "en", "s"))
        want.add((i, 0, n, i - k, k == 0))
    rows.append((len(rows), "b0 b1 b2 b3 b4 q", "en", "s"))  # 1 of 3 shingles
    docs = make(spark, rows)
    for shortest in (1, 5):
        got = passages.repeated(docs, shortest=shortest).where("kind = 'paragraph'").collect()
        expected = {x for x in want if x[2] - x[1] >= shortest}
        assert {(r.doc_id, r.start, r.end, r.first_doc_id, r.kept) for r in got} == expected and len(got) == len(expected)
    left = {r.doc_id: words(r.text) for r in passages.without_repeats(docs).collect()}
    assert left[1] == ["only1", "a1", "one", "last1"]  # too short to be compared
    assert left[6] == ["only6", "a6", *base[:6], "last6"] and left[7] == ["only7", "a7", "last7"]


def test_windows_that_differ_at_an_end(spark):
    """A 20-word window with another last word shares 15 of 17 shingles: found by the bands, verified and clustered like lines."""
    rng, rows = random.Random(12), []
    for g in range(40):
        core = [f"g{g}y{i}" for i in range(19)]
        for k in range(2):
            fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
            rows.append((2 * g + k, " ".join([*fill(30), *core, *fill(30)]), "en", "s"))
    h = {i: words(t) for i, t, *_ in rows}
    both, starts = 0, {}
    for i, w in h.items():
        hashes, _, _, woff = flat.words(*flat.span(pa.array([" ".join(w)])))
        starts[i] = set(flat.minimisers(hashes, woff, passages.K, passages.W).tolist())
    both = [g for g in range(40) if 30 in starts[2 * g] and 30 in starts[2 * g + 1]]
    got = passages.repeated(make(spark, rows)).collect()
    hit = {r.doc_id // 2 for r in got if not r.kept and r.kind == "passage" and r.start == 30}
    assert both and hit <= set(both) and len(hit) >= 0.8 * len(both)


def test_a_passage_around_boilerplate_is_found_whole(spark):
    """Documents 5 and 9 share 20 words, boilerplate that 1 holds too, and 20 words: all 65 go from 9."""
    rng = random.Random(5)
    fill = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, wholes = [], {}
    for g in range(10):
        head, boiler, tail = fill(20), fill(25), fill(20)
        for k, body in enumerate((boiler, [*head, *boiler, *tail], [*head, *boiler, *tail])):
            rows.append((3 * g + k, " ".join([*fill(40), *body, *fill(40)]), "en", "s"))
        wholes[3 * g + 2] = {*head, *boiler, *tail}
    left = {r.doc_id: set(words(r.text)) for r in passages.without_repeats(make(spark, rows)).collect()}
    assert sum(not left[i] & w for i, w in wholes.items()) >= 9


def test_recall_of_paragraphs_on_a_table(spark):
    """Lines of the table against an all-pairs join: nine tenths of the linked pairs at least share a class, and no class holds a stray line."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = {}
    for r in docs.collect():
        at = 0
        for line in (r.text or "").split("\n"):
            w = words(line)
            if len(w) >= 5:
                lines[r.doc_id, at] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            at += len(w)
    held = collections.defaultdict(list)
    for k, s in lines.items():
        for x in s:
            held[x].append(k)
    pairs = {(a, b) for v in held.values() for a, b in itertools.combinations(sorted(v), 2)}
    linked = {(a, b) for a, b in pairs if 100 * len(lines[a] & lines[b]) >= 80 * len(lines[a] | lines[b])}
    of = {(r.doc_id, r.start): r.class_id for r in passages.repeated(docs).where("kind = 'paragraph'").collect()}
    across = [(a, b) for a, b in linked if a[0] != b[0]]
    assert len(across) > 50 and sum(a in of and of[a] == of.get(b) for a, b in across) >= 0.99 * len(across)
    assert set(of) <= {x for p in linked for x in p}


def test_cutting_passages(spark, docs, rows):
    out = passages.without_repeats(docs.withColumn("start", F.lit(7)))
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "start"]
    kept = out.collect()
    left = coverage([(r.doc_id, r.text) for r in kept if r.doc_id is not None], 51)
    assert not left
    spliced = [(r.doc_id, r.text) for r in kept if r.doc_id in range(60, 70)]
    assert len(spliced) == 10 and not coverage(spliced, 4)  # to the last word
    text = {r[0]: r[1] for r in rows}
    for r in kept:
        if r.doc_id in range(60):
            assert r.text == text[r.doc_id]  # clean
        if r.text is not None:
            assert not collections.Counter(words(r.text)) - collections.Counter(words(text[r.doc_id]))
    assert {r.doc_id for r in kept} >= {90, 91, 92, 93, None}
    assert passages.without_repeats(docs.limit(0)).count() == 0


# -- benchmark --------------------------------------------------------------------------------------


def reduced(t):
    return re.sub("[^0-9a-zß-öø-ÿ]+", " ", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t or "")).strip()


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = {i: prose(rng, n, 30) for i, n in enumerate([4, 12, 20, 40])} | {7: "short", 8: "Élan vital, ça et là; encore une FOIS!", 9: None}
    texts = {}
    for d in range(60):
        kind, item = d % 5, items[[0, 1, 2, 3, 8][d // 5 % 5]]
        body = list(item)
        for _ in range({0: 0, 1: 2, 2: 5, 3: 12, 4: 0}[kind]):
            p = rng.randrange(len(body))
            rng.choice([lambda: body.pop(p), lambda: body.insert(p, "z"), lambda: body.__setitem__(p, "q")])()
        texts[d] = (prose(rng, 9, 30) + " " if d % 3 else "") + ("".join(body).upper() if kind != 4 else prose(rng, 12, 30)) + (" - " + prose(rng, 5, 30) if d % 2 else "")
    texts |= {100: None, 101: "", 102: "...", 103: items[1] * 2, 104: "x " * 40_000 + items[2]}
    docs = spark.createDataFrame(list(texts.items()) + [(103, texts[103]), (None, items[1])], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()) + [(1, items[1]), (None, "nothing at all here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks.leaks(docs, bench).collect()}
    want = {}
    for d, t in texts.items():
        for i, x in items.items():
            x = reduced(x)
            if len(x) >= 10:
                budget = min(len(x) * 8 // 100, max((len(x) - 10) // 10, 0))
                e = least_edits(x, " " + reduced(t) + " ") if len(t or "") < 5000 else (0 if x in reduced(t) else 99)
                if e <= budget:
                    want[d, i] = e
    assert {k for k in got} == set(want) and sum(got[k] != want[k] for k in got) == 0
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, bench, pass_chars=60).collect()} == set(want)
    assert leaks.leaks(docs, bench.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), bench).count() == 0
    stay = leaks.without_leaks(docs.withColumn("item_id", F.lit(1)), bench)
    assert stay.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in stay.collect()} == {None, *texts} - {d for d, _ in want}


def test_leaks_in_passes_and_of_crowded_texts(spark, monkeypatch):
    items = [(1, "ab " * 40), (2, "the quick brown fox jumps over the lazy dog again and again"), (3, "ab ab ab ab ab cd ab ab ab ab")]
    texts = [(1, "ab " * 5000), (2, "x " * 300 + items[1][1]), (3, ("ab " * 30 + "cd ") * 50), (4, "nothing of it here")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shown = lambda df: sorted(map(tuple, df.collect()))
    want = shown(leaks.leaks(docs, bench))
    assert {x[:2] for x in want} >= {(1, 1), (2, 2), (3, 3)} and not any(x[0] == 4 for x in want)
    assert shown(leaks.leaks(docs, bench, pass_chars=60)) == want
    index = leaks.index([i for i, _ in items], [t for _, t in items])
    column = pa.array([t for _, t in texts])
    whole = [x.tolist() for x in leaks.find(column, index)]
    monkeypatch.setattr(leaks, "HITS", 50)
    monkeypatch.setattr(leaks, "ALIGNED", 500)
    assert [x.tolist() for x in leaks.find(column, index)] == whole


# -- mixing -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 2, 1], [6, 4, 4, 3, 3, 2, 2, 2, *[1] * 13], [50, 1, 1], [7, 5, 11, 2]])
def test_schedule_stays_within_one_block(weights):
    order, total = mixing.schedule(weights), sum(weights)
    done = [0] * len(weights)
    for t, i in enumerate(order * 2, 1):
        done[i] += 1
        assert all(abs(d * total - t * w) < total for d, w in zip(done, weights))
    with pytest.raises(ValueError):
        mixing.schedule([1, 0])


def test_mixing(spark):
    rows = [(i, "t", "en", "a" if i < 600 else "b" if i < 800 else "c" if i < 850 else None) for i in range(1000)]
    docs = make(spark, rows).withColumns({"m_hash": F.lit(1), "mix_slot": F.lit("old"), "sg": F.lit(2)}).repartition(5)
    got = mixing.mixed(docs, {"a": 3, "b": 2}, rest=1, block=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(1000)) and {r.doc_id for r in got} == set(range(1000))
    assert {(r.source, r.mix_group) for r in got} == {("a", 0), ("b", 1), ("c", -1), (None, -1)}
    done = collections.Counter()
    for n, r in enumerate(got[:1000], 1):
        if done["b"] + 1 > 200 or done[None] + 1 > 200:
            break
        done[r.source if r.source in ("a", "b") else None] += 1
        for k, w in (("a", 3), ("b", 2), (None, 1)):
            assert abs(done[k] - n * w / 6) <= 2 * 4
    slots = [r.mix_slot for r in got]
    assert slots == sorted(slots)
    assert mixing.mixed(docs.limit(0), {"a": 1}).count() == 0
    assert mixing.mixed(docs, {}).count() == 1000
    odd = make(spark, [(None, "x", None, None), (None, "x", None, "a"), (1, "x", None, "a"), (1, "x", None, "a")])
    assert sorted(r.mix_position for r in mixing.mixed(odd, {"a": 2}).collect()) == [0, 1, 2, 3]


def test_mixing_has_no_python(spark, docs):
    plan = mixing.mixed(docs, {"src0": 2})._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- classifiers ------------------------------------------------------------------------------------


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    test = [i for i in known if held_out(i)]
    right = sum(got[i].predicted == known[i] for i in test)
    assert right / len(test) >= 0.95 and all(0 <= r.score <= 1 and r.held_out == held_out(i) for i, r in got.items())
    changed = labels.withColumn("quality", F.when(common.crc_part("doc_id") == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None)}), changed).collect()}
    assert all(again[i] == pytest.approx(r.score) for i, r in got.items())


def test_quality_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(i, i % 2 if i != 4 else 9, 0) for i in range(96)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs.withColumn("quality", F.lit("z")), labels).collect()
    assert len(got) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    blank = {r.doc_id: r.score for r in got if r.doc_id in (90, 91, 92)}
    assert len(set(blank.values())) == 1
    none = quality.score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0
    same = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    assert len({round(r.score, 9) for r in quality.score(docs, same).collect()}) == 1
    kept = quality.keep_good(docs, same)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_trains_on_whole_texts(spark):
    """What tells a document's quality may stand after any number of lines and characters."""
    good, bad = "a calm line of words that says something new.\n", "CLICK HERE!!! $$$ BUY NOW | FREE | ###\n"
    rows = [(i, ("plain words stand here first, " * 10 + "\n") * 410 + (good if i % 2 else bad) * 600, "en", "s", 1) for i in range(12)]
    assert min(len(r[1]) for r in rows) > 120_000
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = quality.score(spark.createDataFrame(rows, DOCS), labels).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)
    texts, y = quality.training_sample(spark.createDataFrame(rows * 2 + [(1, None, "en", "s", 0)], DOCS), labels.unionByName(labels.withColumn("quality", F.lit(0))))
    assert set(y) == {0.0} and all(len(t) > 90_000 for t in texts)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    loff, trans = np.array([0, 1, 1, 5, 8]), rng.normal(size=(2, 2))
    emit = rng.normal(size=8)
    good, pairs = quality.marginals(emit, trans, loff)
    want, seen = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(loff, loff[1:]):
        z = 0.0
        g, p = np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(emit[a + k] for k in range(b - a) if y[k]) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            z += s
            g += s * np.array(y)
            for u, v in zip(y, y[1:]):
                p[u, v] += s
        if b > a:
            want[a:b], seen = g / z, seen + p / z
    assert np.allclose(good, want) and np.allclose(pairs, seen)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).collect()
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in test) / len(test) >= 0.97
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in got)
    changed = docs.withColumn("lang", F.when(common.crc_part("doc_id") == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in langid.identify(changed).collect()} == {r.doc_id: r.lang_pred for r in got}


def test_language_of_odd_tables(spark, docs):
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("known", F.lit(1))).collect()}
    assert len(got) == len({r.doc_id for r in docs.collect()})
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (90, 91, 92))
    digits = spark.createDataFrame([(1, "123 456", "en", "a", 7), (2, "abc", None, None, 3)], DOCS)
    assert {r.lang_pred for r in langid.identify(digits).collect()} <= {"und", "en"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_of_repeated_ids_and_long_texts(spark):
    rows = [(i, None if i % 3 == 0 else "der und die" if lang == "de" else "the and of", lang, "s", 1) for i in (1, 2, 3, 5, 6, 8, 9) for lang in ("de", "en") for _ in (0, 1)]
    rows += [(i, None, lang, "s", 0) for i in (1, 2) for lang in ("de", "en")] + [(7, "und der " * 60_000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and sum(r.lang_pred == "und" for r in got) == sum(r[1] is None for r in rows)
    texts, langs = langid.training_sample(docs)
    assert all((lang == "de") == (b"d" in t and b"e" in t and b"r" in t or b"und" in t) for t, lang in zip(texts, langs))
    assert len(texts) <= langid.EXCERPTS * len(rows) and max(map(len, texts)) <= langid.EXCERPT
    # of a long text, any part may be drawn
    long = spark.createDataFrame([(0, "".join(chr(97 + k // 1000) for k in range(26_000)), "x", "s", 1)], DOCS)
    assert len({t[0] for t in langid.training_sample(long)[0]}) > 8


def test_every_byte_is_labelled():
    """The pooled probabilities against a plain loop over the bytes of every stretch."""
    rng = np.random.Generator(np.random.PCG64(1))
    model = langid.fit([b"aab" * 30, b"ccd" * 30, b"xyz" * 30], ["p", "q", "r"], steps=5)
    texts = ["", "a", "B", "cd" * 64, "x" * 129, bytes(rng.integers(97, 123, 700, dtype=np.uint8)).decode(), "é" * 100]

    def states(d, stretch):
        h, out = np.zeros(langid.HIDDEN), []
        for byte in stretch:
            x, a = d.table[:, byte].astype(float), d.u.astype(float) @ h
            n = langid.HIDDEN
            z, r = (1 / (1 + np.exp(-(x[k * n : k * n + n] + a[k * n : k * n + n]))) for k in (0, 1))
            c = np.tanh(x[2 * n :] + r * a[2 * n :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    for t, got in zip(texts, model.probabilities(pa.array(texts))):
        data, total = t.lower().encode(), np.zeros(3)
        for i in range(0, len(data), langid.WINDOW):
            stretch = data[i : i + langid.WINDOW]
            ahead, back = states(model.fore, stretch), states(model.back, stretch[::-1])[::-1]
            for f, b in zip(ahead, back):
                y = np.exp(model.out @ np.concatenate([f, b]) + model.bias)
                total += y / y.sum()
        assert np.allclose(got, total / max(len(data), 1), atol=1e-4)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    d = langid.Direction(rng.normal(0, 0.5, (24, 256)), rng.normal(0, 0.5, (24, 8)))
    text, g = rng.integers(97, 103, (6, 4)).astype(np.uint8), rng.normal(size=(6, 8, 4))

    def loss():
        h, keep, total = np.zeros((8, 4)), [], 0.0
        for t in range(6):
            new, z, r, c, an = d.step(text[t], h)
            keep.append((h, z, r, c, an))
            h = new
            total += (h * g[t]).sum()
        return total, keep

    _, kept = loss()
    table, u = d.gradients(text, kept, g)
    for a, grad, i in ((d.u, u, (3, 2)), (d.u, u, (20, 5)), (d.table, table, (1, int(text[2, 1]))), (d.table, table, (22, int(text[0, 0])))):
        old, eps = a[i], 1e-5
        a[i] = old + eps
        up = loss()[0]
        a[i] = old - eps
        down = loss()[0]
        a[i] = old
        assert grad[i] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-5)


# -- tokens -----------------------------------------------------------------------------------------


def test_token_counts(spark, docs, rows):
    text = {r[0]: r[1] for r in rows}
    for block in (97, 4_000_000):
        got = tokens.token_counts(docs, VOCABULARY, block=block).collect()
        assert len(got) == len(rows) and all(r.n_tokens == len(tokens.encode(text[r.doc_id], VOCABULARY)) for r in got)
    assert tokens.token_counts(docs.limit(0), VOCABULARY).count() == 0
    special = spark.createDataFrame([(1, "a<|endoftext|>b", 5), (1, "a<|endoftext|>b", 5)], "doc_id long, text string, tokens int")
    assert [r.n_tokens for r in tokens.token_counts(special, VOCABULARY).collect()] == [len(tokens.encode("a<|endoftext|>b", VOCABULARY))] * 2


def test_separators_of_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    files = []
    for k, n in enumerate((0, 1, 50, 1000)):
        x = rng.integers(0, 5, n).astype("<u4")
        x.tofile(tmp_path / f"{k}.bin")
        files.append((str(tmp_path / f"{k}.bin"), n))
    got = tokens.separators(spark.createDataFrame(files, "file string, tokens long"), f"file://{tmp_path}", eod=3, dtype="<u4", block=7).collect()
    for f, n in files:
        x = np.fromfile(f, "<u4")
        ends = np.flatnonzero(x == 3)
        want = [(i, int(e), int(e - p - 1)) for i, (e, p) in enumerate(zip(ends, np.append(-1, ends[:-1])))] if len(ends) else []
        assert sorted((r.ordinal, r.end, r.length) for r in got if r.file == f) == want


def test_tokens_are_those_of_the_public_pattern():
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("It's  a\n\n test,  1234 ñandú!! \t ", "  ", "x" * 200, "don't we'll\r\n"):
        assert tokens.encode(t, VOCABULARY) == e.encode_ordinary(t)
