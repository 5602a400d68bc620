import hashlib

from veridra.llm import exact_dedup as E

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    strip = lambda t: "".join(c for c in t or "" if c not in BLANK)
    out = []
    for i, t in rows:
        group = [(-len(u or ""), j is None, j or 0, j) for j, u in rows if strip(u) == strip(t)]
        out.append((i, min(group)[3], len(group), hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_equal_brute_force(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in E.mark_duplicates(odd).collect()]
    assert sorted(found, key=str) == brute(rows)
    assert E.mark_duplicates(none).count() == 0


def test_repeated_rows_leave_one(odd):
    kept = E.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 3, 4, 6, 7, 8]


def test_null_and_reused_ids_do_not_keep_copies(spark):
    rows = [(None, "only here"), (None, "also elsewhere"), (3, "also elsewhere"), (1, "first"), (1, "of two"), (0, "of two"), (4, "with space"), (4, "with  space")]
    kept = E.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, "only here"), (3, "also elsewhere"), (1, "first"), (0, "of two"), (4, "with  space")], key=str)


def test_reused_ids_keep_one_row_of_each_content(spark):
    rows = [(1, "aaa bbb"), (5, "a longer text here"), (5, "aaa  bb b"), (5, "aaabbb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["kept"] for r in E.mark_duplicates(df).collect()) == [False, False, True, True]
    assert sorted(map(tuple, E.drop_duplicates(df).collect())) == [(5, "a longer text here"), (5, "aaa  bb b")]


def test_empty_tables_leave_nothing(none):
    assert E.drop_duplicates(none).count() == 0 and E.drop_duplicates(none).columns == none.columns


def test_tables_that_do_not_fit_spill_and_agree(tmp_path):
    records = []
    for i in range(3000):
        content = f"content {i % 700}".encode() * 20
        records.append((hashlib.sha256(content).digest(), content, i % 13, i, 1, 1))
    out = lambda budget: sorted(tuple(e) for found in E.grace(iter(records), lambda entries: [entries], budget, str(tmp_path)) for e in found)
    assert out(1 << 30) == out(20_000) and len(out(20_000)) == 700
    assert not list(tmp_path.iterdir())


def test_equal_hashes_of_different_contents_stay_apart():
    table = E.ContentTable()
    for content in (b"a", b"b", b"a"):
        table.add(b"x" * 32, content, 1, 1, 1, 1)
    assert [e[5] for e in table.entries] == [2, 1]
