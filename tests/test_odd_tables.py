"""Queries against their SQL on small tables with what the given ones lack."""

import __spark_entry__ as entry
from tests.test_queries import plain


def equals_sql(spark, name, folder, *tables):
    import duckdb

    with duckdb.connect() as con:
        for t in tables:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        want = con.sql(entry.oracle_sql()[name])
        df = entry.queries()[name](spark, str(folder))
        rows = plain(df.collect(), df.columns)
        assert rows == plain(want.fetchall(), want.columns)
        return rows


def test_mails_with_other_endings(spark, tmp_path):
    texts = ["write to a.b@host.de or c@host.COM", "x@site.io and y@site.org.", "z1@deep.mail.example.net,n@site.co.uk", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {value for _, value in equals_sql(spark, "mails", tmp_path, "documents")}
    assert {"y@site.org", "z1@deep.mail.example.net", "n@site.co.uk"} <= found and not {"a.b@host.de", "c@host.COM", "x@site.io"} & found


def test_ontology_with_part_numbers_over_the_known_ones(spark, tmp_path):
    spark.sql("SELECT id AS p_partkey FROM (SELECT id FROM range(0, 40) UNION ALL SELECT id FROM range(99990, 100030))").write.parquet(f"{tmp_path}/part.parquet")
    assert equals_sql(spark, "ontology_rules", tmp_path, "part")
