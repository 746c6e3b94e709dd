"""Checks over streams against the batch run over all their rows."""

from pyspark.sql import functions as F

from tidegate import queries as Q
from tidegate.operators import validate as V
from tidegate.plans.spec import FieldMapping, MappingSpec
from tidegate.schema import SRC_ROW, TargetSchema
from tidegate.streaming import checked_so_far, write_checked

SF = "/root/testdata/sf0.001"


def streamed(spark, rows, parts, spec, schema, folder):
    """The rows as so many batches, each known before the next one comes."""
    rows.withColumn("part", F.pmod(F.xxhash64(SRC_ROW), F.lit(parts))).repartition(parts, "part").drop("part").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for query in write_checked(stream, spec, schema, f"{folder}/out", f"{folder}/cp"):
        query.awaitTermination(300)
        assert query.exception() is None
    return checked_so_far(spark, spec, schema, f"{folder}/out")


def told(report):
    return sorted(map(repr, map(tuple, report.problems.collect())))


def test_single_rows(spark, tmp_path):
    rows = Q.orders_landing(spark, SF)
    found, wanted = streamed(spark, rows, 3, Q.ORDERS_SPEC, Q.ORDERS, str(tmp_path)), V.check(rows, Q.ORDERS_SPEC, Q.ORDERS)
    assert told(found) == told(wanted) and found.counts() == wanted.counts()


def test_keys_repeat_over_batches(spark, tmp_path):
    """Lines of orders: the problems of all batches together are those of one run, lines of other batches named."""
    rows = Q.lines_landing(spark, SF).filter(F.col("Bestellnr").cast("int") < 400)
    found, wanted = streamed(spark, rows, 4, Q.LINES_SPEC, Q.LINES, str(tmp_path)), V.check(rows, Q.LINES_SPEC, Q.LINES)
    assert told(found) == told(wanted) and any("duplicate_key" in x for x in told(found)) and found.counts() == wanted.counts()
    assert spark.read.parquet(f"{tmp_path}/out/rows").select("epoch").distinct().count() >= 3


def test_unique_fields_nulls_and_many_lines(spark, tmp_path):
    schema = TargetSchema.of({"name": "s", "version": 1, "primary_key": ["a"], "fields": [{"name": "a", "dtype": "decimal", "nullable": False}, {"name": "b", "dtype": "datetime", "constraints": {"unique": True}}, {"name": "c", "dtype": "string", "constraints": {"unique": True}}]})
    spec = MappingSpec("x", "s", 1, tuple(FieldMapping(f, f.upper(), None, Q._ops(Q._cast(t))) for f, t in (("a", "decimal"), ("b", "datetime"), ("c", "string"))))
    given = [(i, "0.1" if i % 2 else None, f"2024-01-0{i % 3 + 1} 10:00:00" if i % 5 else None, None if i % 4 else "it's") for i in range(1, 91)]
    rows = spark.createDataFrame(given, f"{SRC_ROW} long, A string, B string, C string")
    found, wanted = streamed(spark, rows, 3, spec, schema, str(tmp_path)), V.check(rows, spec, schema)
    assert told(found) == told(wanted) and any("and 24 more" in x for x in told(found))


def test_all_lines_of_repeated_keys(spark):
    rows = Q.lines_landing(spark, SF).select(SRC_ROW, "Bestellnr", "Pos")
    found = V.repeated_lines(rows, ["Bestellnr", "Pos"])
    assert found.count() == V.repeated_keys(rows, ["Bestellnr", "Pos"]).agg(F.sum("n")).first()[0]
    nulls = spark.createDataFrame([(1, None), (2, None), (3, "x")], f"{SRC_ROW} long, k string")
    assert sorted(map(tuple, V.repeated_lines(nulls, ["k"]).collect())) == [(None, 1, 2), (None, 2, 2)]


def test_keys_are_counted_by_spark(spark, tmp_path):
    """Keys are state of Spark's own aggregation, not calls of Python for every key, and are told of when they repeat."""
    rows = spark.range(1, 60_001).select(F.col("id").alias(SRC_ROW), (F.col("id") % 20_000).cast("string").alias("Cust"), F.lit("x").alias("Prio"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    started = write_checked(stream, Q._SLOTS_SPEC, Q._SLOTS, f"{tmp_path}/out", f"{tmp_path}/cp")
    for query in started:
        query.awaitTermination(300)
    assert {x.operatorName for x in started[1].lastProgress.stateOperators} == {"stateStoreSave"}
    assert spark.read.parquet(f"{tmp_path}/out/keys").groupBy("key").agg(F.max("n").alias("n"), F.min("first").alias("first")).agg(F.count_if(F.col("n") == 3), F.min("first"), F.max("first")).first() == (20_000, 1, 20_000)
    found = checked_so_far(spark, Q._SLOTS_SPEC, Q._SLOTS, f"{tmp_path}/out").problems
    assert found.count() == 60_000 and found.filter("line = 1").first().clause == "customer 1 with priority x also appears on lines 20001 and 40001."
