import pytest

from quillspark.llm import chat_threads, line_dedup, oracles, queries
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def same_as_sql(spark, got, rows, schema, table, sql):
    import duckdb

    con = duckdb.connect()
    frame = spark.createDataFrame(rows, schema).toArrow()  # noqa: F841
    con.sql(f"CREATE TABLE {table} AS SELECT * FROM frame")
    columns = sorted(got.columns)
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in got.select(columns).collect()) == want
    return got


def test_quotations_equal_sql(spark):
    """Whole texts, paragraphs and lines, nested and repeated, which the driver's conversations don't have."""
    rows = []
    for c in range(6):
        rows.append((c, 0, "user", f"Opening {c}.\n\nSecond part {c % 3}.\nA line {c}."))
        for t in range(1, 12):
            back = [f"> Opening {c}.", f"> Second part {c % 3}.\n> A line {c}.", f"> A  LINE {c}.", "> never said", f"> reply {t - 1} of {c}", f"> reply {t - 2} of {c}\nand\n> reply {t - 1} of {c}"][(t + c) % 6]
            lead = "On Monday x wrote:\n" if t % 4 == 0 else ""
            nested = f">> Opening {c}.\n" if t % 5 == 0 else ""
            rows.append((c, t, ("user", "assistant")[t % 2], f"{lead}{nested}{back}\nreply {t} of {c}"))
    rows += [rows[3], (7, 0, None, None), (None, 1, "user", "> reply 1 of 0"), (8, 1, "user", "")]
    schema = "conv_id long, turn long, role string, text string"
    got = same_as_sql(spark, chat_threads.threads(spark.createDataFrame(rows, schema)), rows, schema, "conversations", oracles.OP4)
    assert got.where("n_linked > 0").count() > 30 and got.where("depth > 0").count() > 20


def test_lines_of_odd_hosts_equal_sql(spark):
    rows = [(i, f"menu\nbody {i}\n\n {i % 4}", (None, "a", "b")[i % 3]) for i in range(40)] + [(90, None, "a"), (91, None, None), (92, "", None), (93, "menu", "c")]
    schema = "doc_id long, text string, source string"
    same_as_sql(spark, line_dedup.report(spark.createDataFrame(rows, schema)), rows, schema, "documents", oracles.OP3)
