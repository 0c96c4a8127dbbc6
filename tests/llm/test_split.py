from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.split import pieces, prefix_length, split_long, split_texts

DDL = "chunk_no bigint, heading string, text string, id string, piece int"


def check(text, start, limit, overlap):
    spans = list(pieces(text, start, limit, overlap))
    assert spans[0][0] == start and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab.! \n\r\t。é😀"), min_size=1, max_size=600), st.integers(4, 80))
def test_pieces_tile_the_body(text, limit):
    check(text, 0, limit, limit // 4)


def test_natural_boundaries():
    text = "One two. " * 10 + "\n" + "Three four! " * 10 + "\n\n" + "Five six? " * 10
    for a, b in check(text, 0, 130, 40)[:-1]:
        assert text[:b].endswith((" ", "\n"))
    assert [text[a:b].strip().split("\n")[0][:4] for a, b in check(text, 0, 230, 0)] == ["One ", "Five"]
    assert check("x" * 100, 0, 30, 5)[0] == (0, 30)


def test_sections_come_before_paragraphs():
    text = "\n\n".join(["Some text. " * 5] * 3) + "\n# Next\n" + "\n\n".join(["More text. " * 5] * 3) + "\n\n\n" + "Last. " * 12
    assert [text[a : a + 5] for a, _ in check(text, 0, 200, 0)] == ["Some ", "# Nex", "Last."]


def test_long_prefixes_are_cut_not_dropped():
    assert prefix_length("h" * 1030 + "\n\nbody", "h" * 1030, 2048) == 1032
    assert prefix_length("h" * 3000 + "\n\nbody", "h" * 3000, 2048) == 1792


def test_rows(spark):
    long = "word " * 1000
    rows = [(1, "H", "H\n\n" + long), (2, "H", "H\n\nshort"), (3, None, "First line\n\n" + long), (4, "H", None), (5, "H", ""), (6, "h" * 3000, "h" * 3000 + "\n\n" + long), (7, None, "\n\n" + long), (1, "H", "H\n\n" + long), (8, "H", "H\n\n" + "x" * 50000), (9, "H", "H\n\n" + "é" * 2045), (10, "H", "H\n\n" + "é" * 2046)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    got = {}
    for r in split_texts(df).collect():
        got.setdefault(r.id, []).append(r)
        assert len(r.piece) <= 2048
    text = {i: t for i, _, t in rows}
    assert set(got) == {1, 2, 3, 5, 6, 7, 8, 9, 10} and len(got[2]) == len(got[5]) == len(got[9]) == 1 and len(got[10]) == 2
    for i, start in (("1", "H\n\n"), ("3", "First line\n\n"), ("7", "\n\n"), ("8", "H\n\n")):
        assert all(r.piece.startswith(start) for r in got[int(i)])
    for i, rs in got.items():
        if len(rs) > 1 and i != 1:
            rs = sorted(rs, key=lambda r: r.piece_no)
            back, at = text[i][: rs[0].body_start], rs[0].body_start
            for r in rs:
                body = r.piece[len(r.piece) - (r.body_end - r.body_start) :]
                back += body[at - r.body_start :]
                at = r.body_end
            assert back == text[i]
    assert split_long(df.limit(0)).count() == 0 == split_texts(df.limit(0)).count()


def test_prefix():
    assert prefix_length("H\n\nx", "H", 2048) == 3
    assert prefix_length("G\n \nx", "H", 2048) == 4
    assert prefix_length("no heading here", "H", 2048) == 0
    assert prefix_length("h" * 1100 + "\n\nx", "h" * 1100, 2048) == 1102


def test_kept_sees_lost_and_wrong_pieces(spark, monkeypatch):
    from corpusloom.llm import queries

    text = "head\n\n" + "".join(f"Sentence {i} of it. " for i in range(600))
    df = spark.createDataFrame([(1, "head", text, "x", 3), (2, None, "short", "x", 3), (3, None, None, "x", 3), (4, None, "", "x", 3)], DDL)
    monkeypatch.setattr(queries, "table", lambda *_: df)

    def covered(change):
        monkeypatch.setattr(queries, "split_texts", lambda c: change(split_texts(c)))
        return {r.chunk_no: r.covered for r in queries.p6_kept(spark, "").collect()}

    assert covered(lambda p: p) == {1: len(text), 2: 5, 4: 0}
    assert covered(lambda p: p.filter("piece_no <> 3"))[1] != len(text)
    assert covered(lambda p: p.selectExpr("id", "piece_no", "CASE WHEN piece_no = 2 THEN reverse(piece) ELSE piece END AS piece", "body_start", "body_end"))[1] != len(text)
