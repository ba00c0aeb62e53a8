from rubrica.schemas import TABLES


def test_every_schema_parses(spark):
    for name, ddl in TABLES.items():
        assert spark.createDataFrame([], ddl).columns, name
