"""Metadata of long contents."""

from pyspark.sql import functions as F

from graphloom.functions import metadata


def test_pdf_fields_past_the_head(spark):
    rows = spark.createDataFrame([("%PDF-1.5 " + "x" * 5000 + " /Title (paper) /Author(me)",)], "c string")
    got = rows.select(metadata.pdf_metadata(F.col("c")).alias("m")).first().m
    assert got == {"pdf_version": "1.5", "title": "paper", "author": "me"}
