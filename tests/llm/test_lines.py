from collections import defaultdict

from corpusloom.llm.lines import line_steps, repeated_lines, without_lines

DDL = "chunk_no bigint, service string, source_url string, text string, line string, a int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DDL)


def brute(rows, least):
    pages, where = defaultdict(set), defaultdict(list)
    for no, s, u, t in rows:
        if None in (s, u, t):
            continue
        for i, x in enumerate(t.split("\n"), 1):
            key = (s.strip().lower(), " ".join(x.split()).lower())
            if i > 1 and key[1]:
                pages[key].add(u.split("?")[0].split("#")[0])
                where[key].append((no, i))
    return sorted(w for k, p in pages.items() if len(p) >= least for w in where[k])


def corpus():
    rows = []
    for i in range(120):
        s = "Blobs " if i % 3 else "funcs"
        lines = [f"Heading {i}", "", f"own line {i}", "Home", "  SHARE  this\tpage " if i % 3 else f"other {i}", f"last {i}"]
        rows.append((i, s, f"https://h/{i}?utm=1" if i % 2 else f"https://h/{i}#x", "\n".join(lines)))
    rows += [(200 + i, "blobs", "https://h/same", "Home\nonly on one page\r\n\nHome") for i in range(20)]
    rows += [(300, None, "u", "a\nHome"), (301, "blobs", None, "a\nHome"), (302, "blobs", "u", None), (303, "blobs", "u", ""), (304, "blobs", "u", "Home"), (303, "blobs", "u", "")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    got = sorted((r.id, r.line_no) for r in repeated_lines(frame(spark, rows)).collect())
    assert got == brute(rows, 8) and got


def test_site_wide_lines_count_though_every_service_has_them(spark):
    rows = [(i, f"s{i % 4}", f"u{i}", f"h\nHome\nbody {i}") for i in range(400)]
    assert repeated_lines(frame(spark, rows)).count() == 400


def test_rare_lines_are_not_significant(spark):
    rows = [(i, "s", f"u{i}", f"h\nbody {i // 2}") for i in range(200)]
    assert repeated_lines(frame(spark, rows), min_pages=1).count() == 0


def test_chance_repeats_are_rejected_before_the_page_rule(spark):
    """Copies bring ordinary lines to two or three pages; the false-discovery step rejects those, a page count the rest."""
    rows = [(i, f"s{i % 3}", f"u{i}", f"h\nHome\nbody {i // (6 if i % 2 else 1)}\nown {i}" + ("\nsome" if i % 60 == 0 else "")) for i in range(900)]
    steps = {r.svc: r for r in line_steps(frame(spark, rows)).collect()}
    assert sum(r.chance for r in steps.values()) > 0 and all(r.tested == r.chance + r.few + r.reported for r in steps.values())
    found = repeated_lines(frame(spark, rows), min_pages=2)
    assert {r.line_no for r in found.collect()} <= {2, 5} and found.filter("line_no = 2").count() == 900
    rejected = [sum(r.chance for r in line_steps(frame(spark, rows), fdr=f).collect()) for f in (1e-12, 0.05, 1.0)]
    assert rejected == sorted(rejected, reverse=True) and rejected[0] > rejected[2]


def test_removal_of_many_lines(spark):
    n = 20_000
    df = frame(spark, [(1, "s", "u", "\n".join(map(str, range(1, n + 1))))])
    drop = spark.range(2, n + 1, 2).selectExpr("1L AS id", "id AS line_no")
    assert without_lines(df, drop).first().text == "\n".join(map(str, range(1, n + 1, 2)))


def test_removal(spark):
    rows = [(1, "s", "u", "h\na\nb\na"), (2, "s", "u", "h\na"), (3, None, None, None), (4, "s", "u", "")]
    df = frame(spark, rows)
    drop = spark.createDataFrame([(1, 2), (1, 4), (1, 2)], "id bigint, line_no bigint")
    out = {r.chunk_no: r.text for r in without_lines(df, drop).collect()}
    assert out == {1: "h\nb", 2: "h\na", 3: None, 4: ""} and without_lines(df, drop).columns == df.columns


def test_empty(spark):
    df = frame(spark, [])
    assert repeated_lines(df).count() == 0 and without_lines(df, repeated_lines(df)).count() == 0


def test_long_text(spark):
    rows = [(i, "s", f"u{i}", "h\n" + "\n".join(f"{i} {j}" for j in range(5000)) + "\ntail") for i in range(8)] + [(100 + i, "s", f"v{i}", f"h\nx{i}") for i in range(50)]
    assert sorted(r.line_no for r in repeated_lines(frame(spark, rows)).collect()) == [5002] * 8
