"""Table schemas."""

from pyspark.sql import types as T

IGNORE_PHRASES = T.StructType([T.StructField("phrase", T.StringType())])

ISSUES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("declared_lang", T.StringType()),
    T.StructField("detected_lang", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("element", T.StringType()),
    T.StructField("suggested_fix", T.StringType()),
])
