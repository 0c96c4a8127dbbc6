import random
import time

from corpusloom.llm.leaks import leaks, tiles

DDL = "doc_id bigint, text string, item int, h int, pos string"
ITEM_DDL = "item_id bigint, text string, doc int, width int"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2, "x") for d in docs], DDL), spark.createDataFrame([(*i, 1, 2) for i in items], ITEM_DDL)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=5)) for _ in range(n)]


def test_tiles():
    a, b = list("abcdefgh"), list("xxfghyabcdez")
    assert tiles(a, b, 3) == [(0, 6, 5), (5, 2, 3)]
    assert tiles(list("aaaa"), list("aaaaaa"), 2) == [(0, 0, 4)]
    assert tiles(a, list("zzz"), 2) == [] == tiles([], b, 2)


def test_tiles_of_repeated_words_are_near_linear():
    for a, b in ((400, 4_000), (2_000, 20_000)):
        began = time.process_time()
        assert tiles(["-"] * a, ["-"] * b, 5) == [(0, 0, a)]
        if a == 400:
            assert time.process_time() - began < 1
    assert tiles(list("ab" * 200), list("ab" * 2_000 + "c"), 5) == [(0, 0, 400)]


def rounds(a, b, least):
    """Tiling by the definition: in each round every pair of places, the longest runs first, then by place in b."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        found = []
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    found.append((-n, j, i))
        if not found:
            return out
        n, j, i = min(found)
        free_a[i : i - n] = free_b[j : j - n] = [False] * -n
        out.append((i, j, -n))


def test_tiles_against_the_definition():
    rnd = random.Random(4)
    for k in range(300):
        a, b = (rnd.choices("abc"[: 1 + k % 3], k=rnd.randint(0, 14 + 10 * (k % 2))) for _ in range(2))
        least = rnd.randint(1, 4)
        assert tiles(a, b, least) == rounds(a, b, least)


def test_exact_passages(spark):
    item, small = words(40, 1), words(6, 2)
    noise = lambda n: words(30, 100 + n)
    docs = [
        (1, " ".join(noise(1) + item[5:18] + noise(2))),
        (2, " ".join(noise(3) + item[5:17] + noise(4))),
        (3, ", ".join(w.upper() for w in noise(5) + small) + "!"),
        (4, " ".join(small[:5])),
        (5, None), (6, ""), (7, " ".join(item[20:30] + ["zz"] + item[30:40])),
        (8, " ".join(item * 50)), (8, "other"), (None, " ".join(item)),
        (9, " ".join(item[25:] + item[10:25] + item[:10])),
    ]
    items = [(1, " ".join(item)), (2, "-".join(small)), (3, None), (4, "  "), (None, " ".join(item)), (1, " ".join(item))]
    out = {(r.item, r.doc): (r.longest, r.exact) for r in leaks(*frames(spark, docs, items)).collect()}
    assert {k for k, v in out.items() if v[1]} == {(1, 1), (2, 3), (1, 8), (1, 9)}
    assert out[1, 1] == (13, True) and out[1, 8][0] == 40 and out[1, 9][0] == 15


def test_reordered_passage_is_reported_but_not_exact(spark):
    item = words(40, 3)
    blocks = [item[i : i + 8] for i in range(0, 40, 8)]
    doc = [w for b in (blocks[3], blocks[1], blocks[4], blocks[0], blocks[2]) for w in b]
    r = leaks(*frames(spark, [(1, " ".join(doc))], [(1, " ".join(item))])).collect()
    assert [(x.covered, x.longest, x.exact) for x in r] == [(40, 8, False)]


def test_against_brute_force(spark):
    rnd = random.Random(9)
    vocab = words(12, 7)  # few words, so seeds repeat and stock phrases join many pairs
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(3, 30)))) for i in range(20)]
    docs = []
    for d in range(150):
        t = rnd.choices(vocab, k=rnd.randint(0, 60))
        if d % 3 == 0:
            w = rnd.choice(items)[1].split()
            n = rnd.randint(1, len(w))
            s = rnd.randint(0, len(w) - n)
            t[rnd.randint(0, len(t)) : 0] = w[s : s + n]
        docs.append((d, " ".join(t)))
    want = set()
    for i, it in items:
        w = it.split()
        n = min(13, len(w))
        grams = {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in docs:
            x = t.split()
            if any(" ".join(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                want.add((i, d))
    got = {(r.item, r.doc) for r in leaks(*frames(spark, docs, items)).filter("exact").collect()}
    assert got == want and len(want) > 10


def test_empty(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, "a b c")])
    assert leaks(d.limit(0), i).count() == 0 == leaks(d, i.limit(0)).count()
    assert leaks(d, i).count() == 1
