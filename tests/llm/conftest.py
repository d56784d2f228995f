"""Documents with the cases that every operator must stand."""

import pytest

BLOB = "long words of a text without any end " * 30000


@pytest.fixture(scope="session")
def odd_documents(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "one two three four five six seven eight nine ten eleven twelve", "en", "s"), (5, "one two three four five six seven eight nine ten eleven twelve", "en", "s"), (6, BLOB, "en", "s"), (7, "Žluťoučký kůň <|endoftext|> 漢字 \U0001f600", "cs", None), (8, "a", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    from pyspark.sql import functions as F

    # names that an operator might use itself
    return df.select("*", F.lit("x").alias("rep"), F.lit(1).alias("score"), F.lit(2).alias("value"), F.lit(3).alias("shard"), F.lit("y").alias("component"), F.lit(4).alias("kept"), F.lit(5).alias("n"))
