from blockloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_queries_see_all_rows(spark):
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    run = lambda name: catalog.QUERIES[name](spark, SF)
    assert run("fallback_lookup").count() == count("lineitem")
    assert run("upserted").count() >= count("customer") and run("upserted").where("c_mktsegment = 'NEW'").count() == count("supplier")
    assert run("foreign_members").where("c_custkey >= 20").count() > 0
