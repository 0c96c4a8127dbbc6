import math
import random
import re
import statistics

import pytest

from corpusloom.llm import mainbody as M

DDL = "chunk_no bigint, service string, source_url string, text string, line string, page bigint, h string"
NOUNS = "queue shard ledger policy tenant alarm replica stream token schema gateway index".split()
VERBS = "releases merges copies rejects signs restores drains evicts".split()
TAILS = ["until all replicas have caught up", "when the account changes", "unless a filter is set", "before traffic is shifted", "once the lease expires"]
NOTICES = ["Licensed to Vaskamo under its own terms, version 2.7, unless noted otherwise", "We set cookies (Dorila); you may refuse them at any time.", "\u00a9 2031 Vaskamo Ltd", "\u0412\u0441\u0435 \u043f\u0440\u0430\u0432\u0430 \u0437\u0430\u0449\u0438\u0449\u0435\u043d\u044b, Vaskamo, 2031."]
MENU = ["Home", "Search", "Docs > Funcs > Cold queue", "- Signed policy", "- Cold queue"]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} of part-{rng.randrange(999)} {rng.choice(TAILS)}, and up to {rng.randrange(99)} hours are kept."


def pages(n, seed=3):
    """(text, numbers of the lines around the body) of n pages."""
    rng = random.Random(seed)
    for i in range(n):
        lines = [("Heading", None)] + [(m, True) for m in rng.sample(MENU, 3)]
        for _ in range(rng.randint(2, 4)):
            lines.append((" ".join(sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 6)))), False))
        lines += [("", None)] + [(x, True) for x in rng.sample(NOTICES, 3)]
        yield "\n".join(x for x, _ in lines), {k for k, (_, around) in enumerate(lines, 1) if around}


def frame(spark, texts, url=lambda i: f"https://x.example/{i}"):
    return spark.createDataFrame([(i, "s", url(i), t, "x", 7, "y") for i, t in enumerate(texts)], DDL)


def got(df):
    return {(r.id, r.line_no) for r in df.collect()}


def test_body_and_surroundings(spark):
    made = list(pages(200))
    want = {(i, n) for i, (_, around) in enumerate(made) for n in around}
    assert got(M.surrounding_lines(frame(spark, [t for t, _ in made]))) == want


def test_the_threshold_decides(spark):
    df = frame(spark, [t for t, _ in pages(200)])
    n = [M.surrounding_lines(df, threshold=t).count() for t in (0.0, 0.02, 0.1, 10.0)]
    assert n[0] == 0 and n == sorted(n) and len(set(n)) == 4


def test_notices_are_known_by_the_corpus_not_by_their_words(spark):
    """The same notice is body text where its words run in lines of every length."""
    rng = random.Random(5)
    notice = NOTICES[1]
    mixed = ["Heading\n" + " ".join([notice] + [sentence(rng) for _ in range(k % 5)]) for k in range(200)]
    assert not got(M.surrounding_lines(frame(spark, mixed)))
    alone = ["\n".join(["Heading", notice, *(" ".join(sentence(rng) for _ in range(1 + (k + j) % 5)) for j in range(4))]) for k in range(200)]
    assert got(M.surrounding_lines(frame(spark, alone))) == {(i, 2) for i in range(200)}


def brute(texts, threshold=M.THRESHOLD, prior=M.PRIOR_LINES, near=M.PRIOR_NEIGHBOURS):
    mark = re.compile(r"[0-9.,;=!?()\u3002\u3001\uff0c\uff1a\uff1b\uff01\uff1f\uff08\uff09]|(?<!:):(?!:)")
    lines = []
    for i, t in enumerate(texts):
        for n, x in enumerate((t or "").split("\n"), 1):
            x = " ".join(x.split()).lower()
            if n > 1 and x:
                tokens = ["^", *re.findall(r"[^\W\d_]+|0|[^\w\s]|_", re.sub(r"\d+", "0", x)), "$"]
                shape = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+(?: [^\W\d_]+)*", "a", x)).replace(" ", "")[:10]
                lines.append((i, n, x, tokens, bool(mark.search(x)), shape))
    words = {}
    for line in lines:
        for w in line[3][1:-1]:
            words[w] = words.get(w, 0) + 1
    paths, per_line = {}, []
    for _, _, x, tokens, m, _ in lines:
        t = [w if w in "^$" or words[w] >= 2 else "_blank" for w in tokens]
        per_line.append(set(zip(t, t[1:])))
        for p in per_line[-1]:
            paths.setdefault(p, []).append((math.log(len(x)), m))
    root = statistics.pvariance([math.log(len(x[2])) for x in lines])
    spread = {p: math.sqrt((statistics.pvariance([a for a, _ in v]) * len(v) + prior * root) / (len(v) + prior)) for p, v in paths.items() if len(v) > 1}
    share = {p: statistics.mean(m for _, m in v) for p, v in paths.items() if len(v) > 1}
    all_share = statistics.mean(x[4] for x in lines)
    scores = []
    for ps in per_line:
        known = [p for p in ps if p in spread]
        scores.append(statistics.median([spread[p] for p in known] or [math.sqrt(root)]) * statistics.median([share[p] for p in known] or [all_share]) ** 4)
    shapes = {}
    for k, line in enumerate(lines):
        e = shapes.setdefault(line[5], [0, 0, 0, 0])
        e[0] += 1
        e[1] += line[4]
        for o in (k - 1, k + 1):
            if 0 <= o < len(lines) and lines[o][0] == line[0]:
                e[2] += 1
                e[3] += scores[o] < threshold
    out = {}
    for line, s in zip(lines, scores):
        k, m, n, a = shapes[line[5]]
        out[line[0], line[1]] = s * (m / k * (1 - a / (n + near)) ** 2 if k > 1 else line[4])
    return out


def test_scores_match_brute_force(spark):
    texts = [t for t, _ in pages(60, seed=8)] + ["h\nunseen words here", "h\n_\na_b\nx", None, "", "h"]
    lines = M.page_lines(frame(spark, texts))
    rows = M.smoothed_scores(M.line_scores(lines)).collect()
    want = brute(texts)
    assert {(r.id, r.line_no) for r in rows} == set(want)
    for r in rows:
        assert r.score == pytest.approx(want[r.id, r.line_no], rel=1e-9, abs=1e-12)


def test_edges(spark):
    rows = [
        (1, "s", "u", None, "x", 1, "y"), (2, "s", None, "", "x", 1, "y"), (3, None, None, "Home", "x", 1, "y"), (4, "s", "u", "Home\r\n\r\nHome\r\n", "x", 1, "y"), (4, "s", "u", "Home\r\n\r\nHome\r\n", "x", 1, "y"),
        (None, "s", "u", "h\nHome", None, None, None), (5, "s", "u", "h\n" + "Home " * 30000, "x", 1, "y"), (6, "s", "u", "h\n" + "a" * 200000 + "=", "x", 1, "y"), (7, "s", "u", "h\n\u200b\n\ud55c\uad6d\uc5b4 \u0905\u0930\u094d\u0925", "x", 1, "y"),
    ]
    df = spark.createDataFrame(rows, DDL)
    found = sorted(((r.id or 0), r.line_no) for r in M.surrounding_lines(df).collect())
    assert [f for f in found if f[0] in (0, 4, 5)] == [(0, 2), (4, 3), (4, 3), (5, 2)]
    assert all(n > 1 for _, n in found)
    assert M.surrounding_lines(df.limit(0)).count() == 0
    assert M.surrounding_lines(df.filter("chunk_no = 1")).count() == 0


HTML = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li><li>About {n}</li></ul></nav>
<article><h1>Heading {n}</h1><p>{a}<p>{b}</p><li><p>{c}</article><footer>&copy; Vaskamo</footer><script>var a='</p>.,;';</script></body>"""


def html_pages(spark, n):
    rng = random.Random(11)
    rows = [(i, f"https://x.example/{i}?q#t", HTML.format(n="abcdefgh"[i % 8], a=sentence(rng), b=sentence(rng), c=sentence(rng)), 1.0, "p") for i in range(n)]
    return spark.createDataFrame(rows, "fetch_no bigint, url string, html string, score double, path string"), rows


def test_tag_paths(spark):
    df, _ = html_pages(spark, 30)
    assert list(M.text_nodes("<p>a<b>c</b>d</p><script>x</script><div id=i class='z y'>e")) == [("/p", "a"), ("/p/b", "c"), ("/p", "d"), ("/div#i.y.z", "e")]
    scores = {r.path: r.score for r in M.tag_path_scores(M.tag_nodes(df)).collect()}
    outside = {p for p, s in scores.items() if s < M.TAG_THRESHOLD}
    assert outside == {"/html/body/nav/ul/li/a", "/html/body/nav/ul/li", "/html/body/footer"}
    assert {"/html/body/article/h1", "/html/body/article/p", "/html/body/article/p/li/p"} <= set(scores)


def test_page_bodies(spark):
    df, rows = html_pages(spark, 30)
    odd = spark.createDataFrame([(100, None, "<p>", 1.0, "p"), (101, "https://x.example/1", None, 1.0, "p"), (102, None, "<i>" * 5000 + "deep, deep.", 1.0, "p"), (103, "u", "", 1.0, "p")], df.schema)
    out = {r.id: r for r in M.page_bodies(df.union(odd)).collect()}
    assert set(out) == {*range(30), 102} and out[102].body == "deep, deep."
    for i in range(30):
        assert out[i].body.startswith("Heading ") and out[i].body.count("hours are kept.") == 3 and "Home" not in out[i].body and "Vaskamo" not in out[i].body
        assert (out[i].kept, out[i].dropped) == (4, 3)
    assert M.page_bodies(df.limit(0)).count() == 0


def test_a_fetched_page_decides_its_lines(spark):
    """Wording alone keeps a menu line that no other text has; the tags of its page know better."""
    df, _ = html_pages(spark, 30)
    made = list(pages(200))
    texts = [t for t, _ in made]
    texts[3] += "\n\u00a9  VASKAMO\nHeading d\nAbout d"
    chunks = frame(spark, texts, url=lambda i: f"https://x.example/{i}#part")
    n = texts[3].count("\n") + 1
    with_pages = got(M.surrounding_lines(chunks, df))
    assert {(3, n - 2), (3, n)} <= with_pages and (3, n - 1) not in with_pages
    assert got(M.surrounding_lines(chunks, df.limit(0))) == got(M.surrounding_lines(chunks))
