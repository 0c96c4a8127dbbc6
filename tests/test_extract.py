import pytest

from corpusloom.operators.extract import page_chunks, page_sections, sections


def lines(fragment):
    _, s = sections(f"<html><head><title>T</title></head><body>{fragment}</body></html>", "u", 0, 0)
    return s


@pytest.mark.parametrize(
    "fragment, want",
    [
        ("<li><p>x</p></li>", [("T", "x\nx")]),
        ("<h2>Using <b>X</b> now</h2><p>y</p>", [("UsingXnow", "y")]),
        ("<p>run <code>ls</code> now</p>", [("T", "run now")]),
        ("<header><h1>A</h1></header><p>y</p>", [("T", "y")]),
        ("<h1>A</h1><h2>B</h2><p>y</p>", [("B", "y")]),
        ("<p>a<p>b", [("T", "a b\nb")]),
        ("<p>a<br>b</p></nope><p>c &amp; d</p>", [("T", "a b\nc & d")]),
        ("<main></main><p>y</p>", []),
        ("<div id='main-content'><p>in</p></div><p>out</p>", [("T", "in")]),
        ("<div class='x main-content'><p>in</p></div><article><p>art</p></article>", [("T", "in")]),
        ("<div class='page-feedback'><p>z</p></div><p class='warning'>w</p><td>c</td>", [("T", "c")]),
        ("<!-- c --><p>a<!-- b -->d</p><script>var a='</p>';</script>", [("T", "a d")]),
        ("<h4>n</h4><div>n</div><p></p>", []),
    ],
)
def test_fragments(fragment, want):
    assert lines(fragment) == want


def test_minimums_and_title():
    words = lambda n: " ".join(["w"] * n)
    page = lambda *ns: "<body>" + "".join(f"<h2>h{n}</h2><p>{words(n)}</p>" for n in ns)
    assert sections(page(100), "u") == ("u", [("h100", words(100))])
    assert sections(page(99), "u")[1] == []
    assert [h for h, _ in sections(page(19, 20, 80), "u")[1]] == ["h20", "h80"]
    assert sections("<p>no body", "u", 0, 0) == ("u", [])


def test_deep_nesting():
    assert sections("<body>" + "<div>" * 20000 + "<p>x</p>", "u", 0, 0)[1] == [("u", "x")]


def test_spark(spark):
    body = "<body><h2>H</h2><p>" + "word " * 120 + "</p><h2>H</h2><p>" + "word " * 120 + "</p>"
    df = spark.createDataFrame([(1, "u", body, "x"), (2, None, None, "x"), (3, None, body, "x"), (1, "u", "", "x")], "n int, url string, html string, heading string")
    assert [(r.n, r.section_no, r.heading) for r in page_sections(df, ["n"]).orderBy("n", "section_no").collect()] == [(1, 1, "H"), (1, 2, "H"), (3, 1, "H"), (3, 2, "H")]
    assert [(r.n, r.section_no) for r in page_chunks(df, ["n"]).orderBy("n").collect()] == [(1, 1), (3, 1)]
    assert page_sections(df.limit(0), ["n"]).count() == 0
