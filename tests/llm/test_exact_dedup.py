import __spark_entry__ as entry
import duckdb

from quirelake.llm.exact_dedup import MOST_BUCKETS, bucket_count, exact_duplicates

SMALL = "/root/testdata/sf0.001"


def test_query_takes_the_anti_join(spark, monkeypatch):
    kinds, frame = [], type(spark.range(1))
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: (kinds.append(how), join(self, other, on, how))[1])
    got = entry.queries()["op5_exact_dedup"](spark, SMALL).collect()
    assert "left_anti" in kinds
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute("select doc_id, keep_id, group_size, kept, text_sha256 from (" + entry.oracle_sql()["op5_exact_dedup"] + ")").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_table_is_left_behind(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    got = exact_duplicates(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == sorted([(1, 1, 2, True), (2, 1, 2, False), (None, None, 1, True)], key=str)


def test_buckets_grow_with_the_rows():
    assert [bucket_count(n) for n in (0, 10**6, 64 * 4_000_000, 65 * 4_000_000, 10**9, 10**15)] == [64, 64, 64, 128, 256, MOST_BUCKETS]
    assert all(n / bucket_count(n) <= 8_000_000 for n in (10**k for k in range(12)))
