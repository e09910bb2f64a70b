"""Driver contract: entry() smoke, names line up, every oracle has a query."""
import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["user_id", "chunk", "offset", "seq_len", "tokens"]


def test_registry_consistent():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 70
    for name, text in sql.items():
        assert "LIMIT" not in text.upper() or name == "sample_k", name


#: Queries that learn, count or number something before their plan is complete.
FITTING = ("bpe_", "user_bpe", "decode_tokens", "token_to_id", "id_to_token", "pad_batches", "first_batch", "format_tokens",
           "embedding_lookup", "pool_", "epoch_batches", "csv_round_trip", "history_csv", "stored_", "token_vectors", "user_token_vectors", "op", "pipeline")


def test_plans_start_no_job(spark, monkeypatch):
    """Calling a query that fits nothing runs no Spark job (but for reading
    the tables' footers, done here beforehand)."""
    from ledgerloom.sources import tables as T
    schemas = {t: T.table(spark, "/root/testdata/sf0.001", t).schema for t in T.TABLES}
    monkeypatch.setattr(T, "table", lambda s, d, t: s.read.schema(schemas[t]).parquet(f"{d}/{t}.parquet"))
    tracker = spark.sparkContext.statusTracker()
    for name, q in entry.queries().items():
        if name.startswith(FITTING):
            continue
        spark.sparkContext.setJobGroup(f"plan-{name}", name)
        q(spark, "/root/testdata/sf0.001")
        assert not list(tracker.getJobIdsForGroup(f"plan-{name}")), name
    spark.sparkContext.setJobGroup("tests", "tests")
