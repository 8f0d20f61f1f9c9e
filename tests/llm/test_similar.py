import random

import corpus_pipeline
from matchrank.llm import simhash, similar


def _set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _kept(texts):
    """Ids that stay by all pairs."""
    sets, root = {i: _set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if not union or 5 * len(sets[a] & sets[b]) >= 4 * union:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i for i in ids if find(i) == i}


def _world():
    """Originals, copies with up to a few words changed, a family, a common passage, short and empty texts."""
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(3000))
    line = [word() for _ in range(30)]
    texts = [[word() for _ in range(rng.randrange(60, 160))] + line * (k % 2) for k in range(60)]
    for _ in range(150):
        t = list(texts[0] if rng.random() < 0.3 else rng.choice(texts))
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts += [[], [], ["a"], ["A"], ["a", "b"], ["x", "y", "z", "u", "v"]]
    rng.shuffle(texts)
    return {7 * k + 3: " ".join(t) for k, t in enumerate(texts)}


def test_stage_keeps_one_of_all_pairs_at_080(spark):
    texts = _world()
    df = spark.createDataFrame([*texts.items(), (None, "a")], "doc_id long, text string")
    want = _kept(texts)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want | {None} and len(want) < 200


def test_classes_of_a_chain_and_a_common_passage(spark):
    """A chain whose ends are unlike, many texts that share half their words, one family, all copied."""
    rng = random.Random(9)
    word = lambda: "v" + str(rng.randrange(10**6))
    texts, chain = {}, [word() for _ in range(200)]
    for k in range(12):
        chain = list(chain)
        for at in rng.sample(range(16 * k, 16 * k + 16), 2):
            chain[at] = word()
        texts[k] = chain
    passage = [word() for _ in range(80)]
    texts |= {100 + k: passage + [word() for _ in range(80)] for k in range(60)}
    centre = [word() for _ in range(150)]
    for k in range(300):
        one = list(centre)
        one[rng.randrange(150)] = word()
        texts[1000 + k] = one
    texts = {k: " ".join(t) for k, t in texts.items()}
    texts |= {5000 + k: t for k, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.classes(df).collect()}
    kept = _kept(texts)
    assert {i for i, c in got.items() if i == c} == kept and set(got) == set(texts) and set(got.values()) == kept


def test_empty_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (1, "x y z", 2), (2, "x y z", 3), (3, None, 4), (4, " ", 5), (None, "a b c", 6)], "doc_id long, text string, n int")
    assert simhash.keep_one(df.where("false"), similarity=0.8).count() == 0
    assert sorted(r.n for r in simhash.keep_one(df, similarity=0.8).collect()) == [1, 2, 4, 6]


def test_stage_goes_through_the_grid(spark, monkeypatch):
    """Without bands the grid's links alone join near copies within 4 bits; links that the sets refuse join nothing."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = {3: " ".join(base), 5: " ".join([*base[:-1], "last"]), 8: " ".join([*base[:-1], "end"]), 9: " ".join(f"u{k}" for k in range(300)), 11: "a b", 12: ""}
    monkeypatch.setattr(similar, "bands", lambda s: similar.np.empty(0, "<i8"))
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    asked = []
    monkeypatch.setattr(simhash, "links", lambda nodes, spent=None, real=simhash.links: asked.append(nodes.count()) or real(nodes, spent=spent))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {3, 9, 11, 12} and asked[0] >= 3
    every = lambda nodes, used: nodes.crossJoin(nodes.withColumnRenamed("rep", "b").drop("fp")).where("rep < b").selectExpr("rep a", "b")
    of = {r.doc_id: r.component_id for r in similar.classes(df, near=every).collect()}
    assert [of[k] for k in (3, 5, 8, 9, 11, 12)] == [3, 3, 3, 9, 11, 12]
