from corpusloom.operators.snapshots import snapshot_changes, validity_intervals, current_rows

DDL = "load_no bigint, snapshot_no int, url string, chunk_ids array<string>, snap string"


def run(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    return sorted((r.snapshot_no, r.key, r.kind) for r in snapshot_changes(df).collect())


def test_events(spark):
    rows = [
        (1, 1, "a", ["x"], "-"), (2, 1, "b", ["x", "y"], "-"), (3, 1, "c", None, "-"), (4, 1, "d", ["q"], "-"),
        (5, 2, " a ", ["x"], "-"), (6, 2, "b", ["y", "x", "y", None], "-"), (7, 2, "c", [], "-"),
        (8, 5, "a", ["z"], "-"), (9, 5, "a", ["w"], "-"), (10, 5, "d", ["q"], "-"), (11, 5, None, ["q"], "-"), (12, 5, "", ["q"], "-"),
    ]
    assert run(spark, rows) == [(2, "d", "removed"), (5, "", "added"), (5, "a", "changed"), (5, "b", "removed"), (5, "c", "removed"), (5, "d", "added")]


def test_late_and_repeated_rows(spark):
    rows = [(9, 1, "a", ["new"], ""), (1, 1, "a", ["old"], ""), (1, 1, "a", ["old"], ""), (None, 1, "a", ["none"], ""), (2, 2, "a", ["new"], ""), (3, None, "a", ["new"], "")]
    assert run(spark, rows) == []


def test_one_snapshot_and_empty(spark):
    assert run(spark, [(1, 1, "a", ["x"], "")]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, 1, None, None, ""), (2, 2, None, None, "")]) == []


def test_snapshot_of_null_urls_only_still_counts(spark):
    assert run(spark, [(1, 1, "a", ["x"], ""), (2, 2, None, None, ""), (3, 3, "a", ["x"], "")]) == [(2, "a", "removed"), (3, "a", "added")]


def test_intervals(spark):
    df = spark.createDataFrame([(1, "a", "h"), (0, "a", "h"), (2, "a", "g"), (4, "a", "g")], "idx int, key string, row_hash string")
    got = sorted(tuple(r) for r in validity_intervals(df).select("first_idx", "last_idx", "row_hash").collect())
    assert got == [(0, 1, "h"), (2, 2, "g"), (4, 4, "g")]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a", ["x"], "")], DDL)
    plan = current_rows(df, "snapshot_no", "url", "load_no", "chunk_ids")._jdf.queryExecution().toString()
    assert plan.count("partial_max") >= 1
