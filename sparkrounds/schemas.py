"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


VERTICES = _struct(id=T.LongType())
EDGES = _struct(src=T.LongType(), dst=T.LongType(), w=T.DoubleType())
PART_EDGES = _struct(part=T.IntegerType(), src=T.LongType(), dst=T.LongType(), w=T.DoubleType())
COORDS = _struct(id=T.LongType(), x=T.DoubleType(), y=T.DoubleType())
POINTS = _struct(id=T.LongType(), x=T.DoubleType(), y=T.DoubleType(), w=T.DoubleType())
CENTERS = _struct(c=T.IntegerType(), cx=T.DoubleType(), cy=T.DoubleType())
ROUND_LOG = _struct(
    run=T.StringType(),
    round=T.IntegerType(),
    k=T.IntegerType(),
    edges_in=T.LongType(),
    edges_out=T.LongType(),
    secs=T.DoubleType(),
)

# Column names of the two run-log formats.
GRAPH_RUNLOG = _struct(
    WeightingMethod=T.StringType(),
    Seed=T.IntegerType(),
    Vertices=T.IntegerType(),
    Sparsity=T.DoubleType(),
    WeightMin=T.IntegerType(),
    WeightMax=T.IntegerType(),
    NrOfCliques=T.IntegerType(),
    SizeOfClique=T.IntegerType(),
    NrOfCommRounds=T.IntegerType(),
    TotalTime=T.DoubleType(),
    RoundTimes1=T.DoubleType(),
    RoundTimes2=T.DoubleType(),
    RoundTimes3=T.DoubleType(),
)
CORESET_RUNLOG = _struct(
    SamplingMethod=T.StringType(),
    DatasetType=T.StringType(),
    NrOfPoints=T.IntegerType(),
    Seed=T.IntegerType(),
    SampleSize=T.DoubleType(),
    TotalTime=T.DoubleType(),
    RoundTimes=T.ArrayType(T.DoubleType()),
    CoresetSize=T.IntegerType(),
    AvgQuality=T.DoubleType(),
    NormQuality=T.DoubleType(),
)
