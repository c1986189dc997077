import __spark_entry__


def test_names_match():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) >= 50 and set(oracles) <= set(queries)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert any(r.doc_id == "note" and r.candidates == "1191" for r in rows)
