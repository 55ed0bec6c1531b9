"""Duplicates, neighbours, archives and classifiers against brute force, a round trip or held-out accuracy."""

import gzip
import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from sightline.llm import ann, common, components, exact_dedup, langid, minhash, toxicity, warc
from sightline.llm.common import fold
from sightline.operators import storage


def _union(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(make_docs, keep):
    texts = [None, "", "a", "A", "a ", "a", "x" * 100_000, "x" * 100_000 + "y", "x" * 100_000, "é", "é", ""]
    rows = list(enumerate(texts + ["hot"] * 500)) + [(2, "a"), (None, "a"), (None, "none"), (None, "none"), (None, None)]
    got = exact_dedup.exact_groups(make_docs(rows), keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = min if keep == "smallest" else max
    pick = lambda own: best((i for i in own if i is not None), default=None)
    expected = Counter(
        (i, pick(own), len(own), i == pick(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for i in own
    )
    assert Counter(tuple(r) for r in got) == expected


def test_exact_groups_across_partitions(spark, make_docs):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_groups(make_docs(rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.keep_id, r.group_size) for r in got if r.group_size > 1} == {(1, 2000)} and len(got) == 3000


def test_exact_groups_normalised_and_empty(make_docs):
    got = exact_dedup.exact_groups(make_docs([(1, "A b"), (2, "a B")]), normalise=F.lower).collect()
    assert {r.keep_id for r in got} == {1}
    assert exact_dedup.exact_groups(make_docs([])).collect() == []


def _sets(texts, words):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for t in texts:
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower))
        yield {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("crowd", [1024, 6])
def test_near_duplicates_find_all_links(make_docs, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rnd = random.Random(4)
    texts = [None, "", "one", "ONE", "one two", "one two three four", "One\ttwo  three four", "é Ä é ä", "\x0b\x0c"]
    for _ in range(12):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(rnd.choice([10, 60, 400]))]
        for _ in range(rnd.randint(1, 7)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                own[rnd.randrange(len(own))] = "changed" + str(rnd.randint(0, 9))
            texts.append(" ".join(own))
    texts += texts[9:12]
    nameless = [(None, "x"), (None, texts[9]), (None, texts[9]), (None, None)]
    found = minhash.near_duplicates(make_docs([*enumerate(texts), *nameless]), words=4).collect()
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    alone = Counter(tuple(r)[1:] for r in found if r.doc_id is None)
    assert alone == Counter((len(s), None, True) for s in _sets([t for _, t in nameless], 4))
    sets = list(_sets(texts, 4))
    links = [
        (i, j) for i, j in combinations(range(len(texts)), 2)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    expected = _union(range(len(texts)), links)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())


def test_any_two_classes_of_a_crowded_region_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 8)
    same = list(range(minhash.TREES * minhash.DEPTH))
    regions = minhash._regions(spark.createDataFrame([(i, same) for i in range(40)], "rep bigint, sig array<int>")).collect()
    groups = {}
    for r in regions:
        groups.setdefault((r.tree, r.region, r.chunk), set()).add(r.rep)
    for tree in range(minhash.TREES):
        met = {pair for (t, *_), own in groups.items() if t == tree for pair in combinations(sorted(own), 2)}
        assert met == set(combinations(range(40), 2))


def test_links_across_tiles_that_are_no_candidates(spark, monkeypatch):
    """A large component whose candidates are all wrong: its true links, in whatever tiles, are found all the same."""
    monkeypatch.setattr(minhash, "CROWD", 4)
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(40 - i % 2))) for i in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wrong = spark.createDataFrame([(1, i) for i in range(2, 41)], "a bigint, b bigint")
    links = {(r.a, r.b) for r in minhash._confirmed(docs, wrong, 5, 80).collect()}
    assert links == {(i, i + 1) for i in range(2, 40, 2)}


def test_near_duplicates_of_nothing(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300), (500, 400)]
    rnd = random.Random(0)
    rnd.shuffle(links)
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == _union({x for link in links for x in link}, links)


@pytest.mark.parametrize("at_once", [1 << 19, 5])
def test_components_contract_what_a_task_reads(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    tables = []

    def seen(df, name):
        tables.append(common.written(df, name))
        return tables[-1]

    monkeypatch.setattr(components, "written", seen)
    rnd = random.Random(1)
    links = list(combinations(range(40), 2)) + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(250)]
    rnd.shuffle(links)
    table = spark.createDataFrame([link[::rnd.choice([1, -1])] for link in links], "a bigint, b bigint").coalesce(1)
    got = {r.id: r.component_id for r in components.components(table).collect()}
    ids = {x for link in links for x in link}
    assert got == _union(ids, links)
    # 780 links of one group and some 250 others; the rounds join the table once or twice.
    assert at_once == 5 or tables[0].count() < len(ids)


def _nearest(vectors, queries, k):
    units = {i: np.array(v) / np.sqrt((np.array(v) ** 2).sum()) for i, v in vectors.items()}
    for q in queries:
        ranked = sorted((-(units[q] @ units[i]).round(12), i) for i in units if i != q)
        yield q, [i for _, i in ranked[:k]]


def test_nearest_in_small_blocks_is_exact(spark):
    rng = np.random.default_rng(0)
    good = {i: rng.normal(size=8).tolist() for i in range(60)} | {100 + i: [1.0] * 8 for i in range(9)}
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] + [1.0] * 7), (204, []),
           (205, [float("inf")] * 8), (None, [1.0] * 8), (206, [1.0, 2.0])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x"))
    got = ann.nearest(df, df.where("vec_id % 5 = 0"), vectors_per_block=20, queries_per_block=4).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    single = {i: np.array(v, np.float32).astype(float).tolist() for i, v in good.items()}
    assert found == dict(_nearest(single, [i for i in good if i % 5 == 0], 5))
    assert [r.rank for r in got if r.query_id == 0] and ann.nearest(df.limit(0), df).collect() == []


def test_nearest_recall_of_collision_counting():
    rng = np.random.default_rng(1)
    units, _ = ann._unit(rng.normal(size=(6000, 32)))
    index, hits, verified = ann.CollisionIndex(units), 0, 0
    for q, found in enumerate(index.candidates(units[:40], int(ann.VERIFY_SHARE * 6000))):
        scores = units @ units[q]
        scores[q] = -9
        hits += len(set(np.argsort(-scores)[:5]) & set(found.tolist()))
        verified += len(found)
    assert hits >= 0.9 * 200 and verified < 0.4 * 40 * 6000


def test_windows_widen_until_enough_collide():
    rng = np.random.default_rng(2)
    units, _ = ann._unit(rng.normal(size=(500, 16)))
    index = ann.CollisionIndex(units, lines=32)
    at = units[3] @ index.lines
    found = next(index.candidates(units[3:4], 60))
    for width in ann.WIDTH * ann.GROWTH ** np.arange(ann.STEPS):
        counts = (np.abs(units @ index.lines - at) <= width).sum(axis=1)
        if (counts >= 16).sum() >= 60:
            break
    assert found.tolist() == np.flatnonzero(counts >= 16).tolist()


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://a/{i} b\r\nc", html) for i, html in enumerate(
        [None, "", "short", "short", "x" * 100, "x" * 100, "é\r\n\r\n" * 60, "x" * 99, "x" * 99, "long " * 60_000, "x" * 100]
    )] + [(20, None, "y" * 200), (21, "u", "y" * 200), (21, "u", "y" * 200), (None, "u", "z")]
    rows += [(None, "u", "y" * 200), (None, None, "q" * 200), (None, None, "q" * 200), (None, "v", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("header", F.lit(1)).repartition(2)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder, archive_bytes=500)
    got = warc.read_records(index, folder, with_payload=True).collect()
    known = [(i, (html or "").encode()) for i, _, html in rows]
    first = {}
    for i, raw in known:
        if i is not None:
            first[raw] = min(i, first.get(raw, i))
    expected = Counter()
    for i, raw in known:
        again = len(raw) >= 100 and first.get(raw, i) != i
        expected[i, "revisit" if again else "response", first[raw] if again else None, len(raw),
                 hashlib.sha256(raw).hexdigest(), b"" if again else raw] += 1
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got) == expected
    some = warc.read_records(index.where("page_id in (6, 20)"), folder).collect()
    assert {r.page_id for r in some} == {6, 20}
    monkeypatch.setattr(warc, "TASK_BYTES", 400)
    spread = warc.read_records(index, folder, with_payload=True)
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, got))
    assert spread.select(F.spark_partition_id()).distinct().count() > 3
    # An archive is plain WARC without the index too.
    store, root = fs.FileSystem.from_uri(folder)
    raw = b"".join(
        gzip.decompress(store.open_input_file(f.path).read()) for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".gz")
    )
    n = 0
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and raw[size:size + 4] == b"\r\n\r\n"
        raw, n = raw[size + 4:], n + 1
    assert n == len(known)


def test_archives_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    index = warc.write_archives(df, f"file://{tmp_path}/none")
    assert warc.read_records(index, f"file://{tmp_path}/none").collect() == []


def test_merged_ranges_cover_places():
    places = [(0, 10), (10, 5), (100, 10), (111, 4), (5000, 3000), (9000, 1)]
    reads = list(warc.merged_ranges(places, gap=5, most=2000))
    assert [r[2:] for r in reads] == [(0, 2), (2, 4), (4, 5), (5, 6)] and reads[1][:2] == (100, 15)


def test_gru_gradients_are_those_of_its_loss():
    model = langid.ByteGru(["a", "b", "c"], 4)
    for side in model.sides:
        for k in side:
            side[k] = side[k].astype(np.float64)
    x, y = np.random.default_rng(0).integers(0, 256, (6, 5)).astype(np.intp), np.array([0, 1, 2, 0, 1])

    def loss():
        return float(-np.log(model.probabilities(x).astype(float)[:, y, np.arange(5)]).sum())

    error, ahead, back = model.probabilities(x, keep=True)
    error[:, y, np.arange(5)] -= 1
    for side, trace in zip(model.sides, (ahead, back)):
        gradients = model._gradients(side, x, trace, error)
        for k, at in (("U", (1, 2)), ("C", (1, 2)), ("O", (1, 2)), ("E", (1, x[2, 1]))):
            old = side[k][at]
            values = []
            for step in (1e-2, -1e-2):
                side[k][at] = old + step
                values.append(loss())
            side[k][at] = old
            assert abs(gradients[k][at] - (values[0] - values[1]) / 2e-2) < 5e-3


def test_language_of_odd_texts(make_docs, spark):
    rnd = random.Random(0)
    words = {"aa": ["abab", "bcab", "cabc"], "xx": ["xyxy", "yzzx", "zxyy"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 60))), lang) for i in range(300) for lang in words]
    rows += [(900, None, "aa"), (901, "", "xx"), (902, "abab", None), (903, "123 !?", "aa"), (None, "xyxy " * 9, "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.teach(df.where(fold("doc_id", 4) != 2), per_language=100, epochs=4)
    got = langid.identified(df.where("doc_id is null or doc_id >= 900 or doc_id % 7 = 0"), model).collect()
    truth = {}
    for i, t, lang in rows:
        truth.setdefault(i, []).append(lang)
    clear = [r for r in got if r.lang_pred != "und"]
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 903)} == {
        900: ("und", 0.0), 901: ("und", 0.0), 903: ("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in clear} == {"aa", "xx"}
    assert {r.doc_id: r.lang_pred for r in got}[902] == "aa" and {r.doc_id: r.lang_pred for r in got}[None] == "xx"
    long = langid.identified(make_docs([(1, "xyxy yzzx " * 20_000), (2, "abab")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in long} == {1: "xx", 2: "aa"}
    odd = langid.identified(make_docs([(1, "\u00b2 \u00bd \u2167 12_!"), (2, "\u00b2 \u00aa"), (3, "\u4e2d")]), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in odd} == {1: True, 2: False, 3: False}
    assert langid.teach(make_docs([])) is None
    assert [(r.lang_pred, r.score) for r in langid.identified(make_docs([(1, "abc")]), None).collect()] == [("und", 0.0)]


def test_toxicity_learns_pairs_that_weights_cannot(spark, make_docs):
    """Toxic are an insult beside a group's name, or neither: no sum of weights tells the four cases apart."""
    rnd = random.Random(0)
    plain = ["alpha", "beta", "gamma", "delta"]
    rows, labels = [], []
    for i in range(1600):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        own = rnd.sample(plain, 2) + ["insulting"] * insult + ["groupname"] * group
        rnd.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(insult == group)))
    marked = spark.createDataFrame([*labels, (5, None), (None, 1), (99_999, 1)], "doc_id bigint, toxic int")
    monkey = toxicity.MIN_Z
    toxicity.MIN_Z = 0.0  # either word alone says nothing
    try:
        model = toxicity.teach(make_docs(rows + [(None, "alpha"), (2000, None)]), marked.where(fold("doc_id", 5) != 0))
    finally:
        toxicity.MIN_Z = monkey
    truth = dict(labels)
    got = toxicity.scored(make_docs(rows), model).where(fold("doc_id", 5) == 0).collect()
    assert sum(r.predicted == truth[r.doc_id] for r in got) > 0.95 * len(got)
    odd = toxicity.scored(make_docs([(1, None), (2, ""), (3, "alpha " * 50_000), (None, "x")]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)


def test_toxicity_learns_neutral_words_that_tell_together(spark, make_docs):
    """With the defaults of op6: documents with either word are toxic as often as all (0.4), with both always, with one never."""
    rnd = random.Random(1)
    plain = [rnd.choice("bcdfgh") + rnd.choice("aeiou") + rnd.choice("klmnpr") + rnd.choice("aeiou") for _ in range(120)]
    rows, labels = [], []
    for i in range(3000):
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        own = rnd.sample(plain, 20) + ["insulting"] * insult + ["groupname"] * group
        rnd.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(insult and group or not insult and not group and rnd.random() < 2 / 3)))
    model = toxicity.teach(make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int").where(fold("doc_id", 5) != 0))
    truth = dict(labels)
    ids, _ = toxicity.terms(["insulting groupname"])
    assert (model.place[ids] >= 0).all() and len(model.w) < 40
    held = toxicity.scored(make_docs(rows), model).where(fold("doc_id", 5) == 0).collect()
    words = {i: set(t.split()) for i, t in rows}
    pair = [r.predicted for r in held if {"insulting", "groupname"} <= words[r.doc_id]]
    single = [r.predicted for r in held if len({"insulting", "groupname"} & words[r.doc_id]) == 1]
    assert np.mean(pair) > 0.95 and np.mean(single) < 0.05


def test_toxicity_without_labels(spark, make_docs):
    model = toxicity.teach(make_docs([(1, "a")]), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r.predicted for r in toxicity.scored(make_docs([(1, "a"), (2, None)]), model).collect()] == [0, 0]


def test_terms_are_words_and_beginnings():
    ids, begins = toxicity.terms(["Lowei loweiisch, ÉTÉ", "", "lowei", "x"])
    own = [set(ids[a:b].tolist()) for a, b in zip(begins[:-1], begins[1:])]
    assert len(own) == 4 and not own[1] and len(own[3]) == 1 and len(own[2] & own[0]) == 2


def test_scratch_tables_are_in_the_shared_folder(spark):
    assert storage.new_path(spark, "x").startswith(storage.shared_dir(spark))
