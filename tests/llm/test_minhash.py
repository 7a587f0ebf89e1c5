import random

import pytest

from segloom.llm import minhash
from segloom.llm.minhash import clusters, links, shingles


def jaccard(a, b):
    x, y = set(shingles(a)), set(shingles(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_links_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for g in range(40):
        base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2, 12])):
                copy[rng.randrange(60)] = "x"
            texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, band string")
    found = {(r.a, r.b) for r in links(df).collect()}
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in found)
    group = {r.id: r.cluster for r in clusters(df).collect()}
    true = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(texts[a], texts[b]) >= 0.8]
    kept = sum(group.get(a, -1) == group.get(b, -2) for a, b in true)
    assert true and kept >= 0.95 * len(true)


def test_nulls_and_short_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one two three four five six")], "id long, text string")
    assert links(df).count() == 0


def test_family_of_half_alike_texts(spark):
    """Texts that share a long boilerplate meet in many bands by chance; the near ones among them are found all the same."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    own = lambda: [f"w{rng.randint(0, 9999)}" for _ in range(30)]
    texts = []
    for _ in range(150):
        words = own()
        near = words[:29] + ["x"]
        texts += [f"{common} {' '.join(words)}", f"{common} {' '.join(near)}"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {(r.a, r.b) for r in links(df).collect()}
    true = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(true) >= 150 and found <= set(true)
    assert len(found & set(true)) >= 0.95 * len(true), (len(found), len(true))


def test_openings_of_twelve_words(spark):
    """Openings, the real input: short texts, of which two at 0.8 share all runs of words but two."""
    rng = random.Random(6)
    texts = []
    for _ in range(120):
        words = [f"w{rng.randint(0, 300)}" for _ in range(12)]
        texts += [" ".join(words), " ".join([*words[1:], f"y{rng.randint(0, 9)}"]), " ".join(words[:11]), " ".join(words[:6] + ["z"] + words[7:])]
    texts = list(dict.fromkeys(texts))
    found = {(r.a, r.b) for r in links(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    true = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(texts[a], texts[b]) >= 0.8}
    assert true and found <= true and len(found) >= 0.95 * len(true)


def pairs_at_the_limit():
    """Texts of 8 runs of words within others of 10: similarity 0.8, no more."""
    for i in range(990, 1050):
        words = [f"w{i}v{j}" for j in range(14)]
        yield " ".join(words[:12])
        yield " ".join(words)


def chains():
    """Texts of which only neighbours are near, all over one boilerplate: many meet in each group, few are alike."""
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(60))
    for _ in range(60):
        words = [f"w{rng.randint(0, 99)}" for _ in range(24)]
        for _ in range(8):
            yield f"{common} {' '.join(words)}"
            at = rng.randrange(20)
            words[at : at + 4] = [f"w{rng.randint(0, 99)}" for _ in range(4)]


def slots():
    """Texts of few phrases in many combinations, whose runs of words are all frequent."""
    rng = random.Random(9)
    for _ in range(400):
        yield " ".join(f"s{i}o{rng.choice([0] * 8 + [1, 2])} a{i} b{i}" for i in range(12))


@pytest.mark.parametrize(("make", "block"), [(pairs_at_the_limit, None), (chains, None), (slots, None), (slots, 7)])
def test_every_pair_is_in_one_cluster(spark, monkeypatch, make, block):
    """No pair is lost, whatever it meets by; blocks of a hot group and joins by shuffle alone change nothing."""
    texts = list(dict.fromkeys(make()))
    random.Random(7).shuffle(texts)
    if block:
        monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
        spark.conf.set("spark.segloom.mostSent", "0")
    try:
        found = {(r.a, r.b) for r in links(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.segloom.mostSent")
    sets = [set(shingles(t)) for t in texts]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
    true = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if near(sets[a], sets[b])}
    assert len(true) >= 50 and found <= true
    group = list(range(len(texts)))
    for a, b in found:
        group = [group[a] if g == group[b] else g for g in group]
    lost = [(a, b) for a, b in true if group[a] != group[b]]
    assert not lost, (len(lost), len(true))
