"""Near duplicates, nearest vectors and the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import ann, near_dup, shingles
from kinweave.llm.components import components

SCHEMA = "doc_id long, text string, node string, key string, members string"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "n", "k", "m") for i, t in pairs], SCHEMA)


def shingle_set(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute_components(pairs, width, similarity):
    """The smallest id that links reach from each id; an id with several texts joins their groups."""
    nodes = [(i, shingle_set(t, width)) for i, t in pairs if i is not None]
    above = {i: i for i, _ in nodes}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for n, (i, a) in enumerate(nodes):
        for j, b in nodes[:n]:
            if a and b and 1000 * len(a & b) >= round(1000 * similarity) * len(a | b):
                x, y = root(i), root(j)
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i in above}


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"w{draw.randrange(5000)}"
    return " ".join(words)


def corpus(seed):
    draw = random.Random(seed)
    bases = [[f"w{draw.randrange(900)}" for _ in range(draw.choice([4, 30, 80, 200]))] for _ in range(12)]
    texts = [edited(draw, b, draw.randrange(0, 1 + len(b) // 12)) for b in bases for _ in range(14)]
    texts += ["", None, "  \n ", "One", "one", "ONE two", "one\ttwo", "x " * 4000, "X\n" * 4000] + [texts[0]] * 30
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_match_brute_force(spark):
    for width, similarity in ((3, 0.85), (5, 0.8)):
        pairs = corpus(width)
        expected = brute_components(pairs, width, similarity)
        got = near_dup.near_duplicates(docs(spark, pairs), width, similarity).collect()
        assert len(got) == len(pairs) and {r.doc_id: r.component_id for r in got} == expected
        sizes = {i: len(shingle_set(t, width)) for i, t in pairs}
        assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 3)
    monkeypatch.setattr(near_dup, "SENT_IDS", 1)
    pairs = corpus(9)
    got = near_dup.near_duplicates(docs(spark, pairs), 3, 0.85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(pairs, 3, 0.85)


def test_near_duplicates_without_ids_repeated_and_empty(spark):
    same = "a b c d e f"
    table = docs(spark, [(None, same), (4, same), (4, same), (7, same), (7, "q r s t u v"), (9, "q r s t u v"), (11, "z")])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table).collect()}
    assert got == {4: 4, 7: 4, 9: 4, 11: 11}
    left = near_dup.drop_near_duplicates(table)
    assert left.columns == table.columns and sorted(((r.doc_id or -1), r.text) for r in left.collect()) == [(-1, same), (4, same), (11, "z")]
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0 == near_dup.drop_near_duplicates(docs(spark, [])).count()


def test_one_id_with_several_texts_in_any_order(spark):
    draw = random.Random(2)
    one, two = ([f"{c}{draw.randrange(900)}" for _ in range(60)] for c in "ab")
    near = " ".join([*two[:59], "other"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, near), (3, "x y z u v w")]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, order).coalesce(1)).collect()}
        assert got == {5: 5, 7: 5, 3: 3}
    pairs = [(draw.randrange(60), t) for _, t in corpus(4)]
    got = near_dup.near_duplicates(docs(spark, pairs), 3, 0.85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(pairs, 3, 0.85)


def test_dropping_keeps_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, "a b c", 4, 5), (1, "d e f", 6, 7)], "doc_id long, text string, _kept_place int, place int")
    left = near_dup.drop_near_duplicates(table)
    assert left.columns == table.columns and [tuple(r) for r in left.collect()] == [(1, "a b c", 4, 5)]


def test_every_pair_within_the_distance_shares_a_key(spark):
    random_ = np.random.default_rng(4)
    base = random_.integers(0, 1 << 16, 32)
    sigs = [base]
    for _ in range(200):
        other = base.copy()
        places = random_.choice(32, random_.integers(0, 16), replace=False)
        other[places] = random_.integers(0, 1 << 16, len(places))
        sigs.append(other)
    frame = spark.createDataFrame([(i, bytearray(s.astype(">u2").tobytes())) for i, s in enumerate(sigs)], "node long, sig binary")
    keys = near_dup.chunk_keys(frame)
    first = keys.filter("node = 0").select("key")
    assert keys.join(first, "key").select("node").distinct().count() == len(sigs)


def test_shingles_of_a_batch_with_few_words():
    for width in range(1, 8):
        for n in range(width + 2):
            words = [f"w{i}" for i in range(n)]
            alone = [len(v) for v in shingles.shingle_sets([" ".join(words)], width)]
            parted = [v.tolist() for v in shingles.shingle_sets(["", *words], width)]
            assert alone == [n - width + 1 if n >= width else min(n, 1)]
            assert parted == [v.tolist() for w in ["", *words] for v in shingles.shingle_sets([w + " "], width)]


def test_word_hashes_do_not_depend_on_the_batch(monkeypatch):
    texts = ["Ab  cd\nef é", "", "x", "q " * 500, "ab cd"]
    whole = [v.tolist() for v in shingles.shingle_sets(texts, 2)]
    assert whole == [v.tolist() for t in texts for v in shingles.shingle_sets([t], 2)]
    monkeypatch.setattr(shingles, "CHUNK", 7)
    assert whole == [v.tolist() for v in shingles.shingle_sets(texts, 2)]
    assert whole[0] != whole[4] and next(shingles.shingle_sets(["AB cd"], 2)).tolist() == whole[4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def vectors(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def brute_nearest(rows, k):
    known = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v
             and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in known:
        if i % 20 == 0:
            out[i] = sorted(((-float(q @ x), j) for j, x in known if j != i))[:k]
    return out


def test_nearest_finds_ties_copies_and_leaves_out_what_is_no_vector(spark):
    random_ = np.random.default_rng(6)
    rows = [(i, random_.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2, 0, 0, 0, 0, 0, 1]) for i in range(300, 420)]
    rows += [(500, None), (520, []), (540, [0.0] * 8), (560, [float("nan")] * 8), (580, [1.0, None] * 4), (None, [1.0] * 8),
             (600, [float("inf")] * 8)]
    rows = [(i, v) for i, v in rows if i is None or i >= 300 or any(v)]
    got: dict = {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = brute_nearest(rows, 20)
    assert set(got) == set(expected)
    found = 0
    for q, best in expected.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[1] != q for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        found += len({m[1] for m in mine} & {j for _, j in best})
    assert found >= 0.9 * 20 * len(expected)


def test_nearest_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (20, [2.0, 1.0]), (20, [1.0, 3.0]), (40, [0.5, 0.5])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    lists = {}
    for q, rank, v, score in got:
        lists.setdefault(q, []).append((rank, v, score))
    assert sorted(lists[40]) == [(1, 20, 2.0), (2, 20, 1.5), (3, 1, 0.5)]
    assert sorted(lists[20]) == [(1, 1, 2.0), (1, 40, 2.0), (2, 1, 1.0), (2, 40, 1.5)]


def test_footrule_ranking_decides_what_is_reranked(spark):
    random_ = np.random.default_rng(9)
    vecs = random_.normal(size=(400, 8))
    length = float(np.sqrt((vecs * vecs).sum(1).max()))
    index = ann.fit_index(vecs[:320], length, 3)
    lists = index.order(vecs, False).tolist()
    asked = [0, 20, 399]
    own = dict(zip(asked, index.order(vecs[asked], True).tolist()))

    def apart(q, v):
        return sum(abs(i - (lists[v].index(p) if p in lists[v] else len(lists[v]))) for i, p in enumerate(own[q]))

    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "key long, vec array<double>")
    wanted = rows.filter(F.col("key").isin(asked))
    pairs = []
    for r in ann.rank(rows, wanted, index, 400, False).collect():
        for code in np.frombuffer(r.pairs, "<u4").tolist():
            pairs.append(((r.ask_shard << ann.ASK_SHARD_BITS) + (code >> ann.SHARD_BITS),
                          (r.shard << ann.SHARD_BITS) + (code & ((1 << ann.SHARD_BITS) - 1))))
    expected = set()
    for q in asked:
        sample = sorted(apart(q, v) for v in range(320))
        reach = sample[int(index.part * 320)] if index.part < 1 else 10 ** 9
        expected |= {(q, v) for v in range(400) if apart(q, v) <= reach and set(own[q][:ann.PROBES]) & set(lists[v][:ann.POSTS])}
    assert 0 < index.part < 1 and len(pairs) == len(set(pairs)) and set(pairs) == expected
    best = {}
    for r in ann.rerank(rows, wanted, ann.rank(rows, wanted, index, 400, False), 3, 400).collect():
        best.setdefault(r.key, []).append((-r.score, r.hit))
    for q in asked:
        assert [h for _, h in sorted(best[q])] == sorted((v for p, v in expected if p == q), key=lambda v: -(vecs[q] @ vecs[v]))[:4]


def test_nearest_of_few_vectors_gives_all(spark):
    rows = [(0, [1.0, 0]), (20, [0.0, -1]), (5, [1.0, 1]), (7, [1.0, 1])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 5, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 5, -1.0), (20, 3, 7, -1.0)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before kept: what goes is what brute force says."""
    folder = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs_.collect()}
    states = [before]
    table = docs_
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = spark.createDataFrame(stage(spark, table, folder).collect(), docs_.schema)
        assert table.columns == docs_.columns
        states.append({r.doc_id: r for r in table.collect()})
    bad = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum((i in states[1]) == bool(q) for i, q in bad.items()) >= 0.95 * len(bad)
    groups = brute_components([(i, r.text) for i, r in states[1].items()], 5, 0.8)
    assert set(states[2]) == {i for i, c in groups.items() if i == c}
    windows = set()
    words = lambda t: near_words(t)
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))}
    clean = {i for i, r in states[2].items()
             if not any(tuple(words(r.text)[k:k + 10]) in windows for k in range(len(words(r.text)) - 9))}
    assert set(states[3]) == clean and set(states[4]) == clean
    assert all(r.n_chars == len(r.text) and "@mail" not in r.text for r in states[4].values())
    last = corpus_pipeline.STAGES[4][1](spark, table, folder).collect()
    assert {r.doc_id for r in last} == clean and all(r.same and r.n_tokens == len(r.ids) for r in last)


def near_words(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
