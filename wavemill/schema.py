"""Canonical tables: a signal is long (one row for each sample), a code is sparse, a missing row is a zero."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNAL = T.StructType([T.StructField("trial", T.LongType()), T.StructField("channel", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("x", T.DoubleType())])
CODE = T.StructType([T.StructField("trial", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("z", T.DoubleType())])
DICTIONARY = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("channel", T.IntegerType()), T.StructField("l", T.IntegerType()), T.StructField("d", T.DoubleType())])
CODE_CORRELATION = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("k2", T.IntegerType()), T.StructField("dt", T.IntegerType()), T.StructField("v", T.DoubleType())])
SIGNAL_CORRELATION = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("channel", T.IntegerType()), T.StructField("l", T.IntegerType()), T.StructField("v", T.DoubleType())])
TRACE = T.StructType([T.StructField("iter", T.IntegerType()), T.StructField("step", T.StringType()), T.StructField("objective", T.DoubleType()), T.StructField("seconds", T.DoubleType())])
EVENT = T.StructType([T.StructField("sample", T.LongType()), T.StructField("event_id", T.IntegerType())])
