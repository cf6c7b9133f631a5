"""Card-shaped edge rows (our own text), one builder per FIXTURES.md case."""

from lexiforge.schemas import CARD_COLUMNS, LEGALITIES, PRINTINGS, RULINGS

PRINTING_FIELDS = [f.name for f in PRINTINGS.fields]


def printing(**kw):
    row = {f: None for f in PRINTING_FIELDS}
    row.update(kw)
    return tuple(row[f] for f in PRINTING_FIELDS)


def printings_df(spark, rows):
    return spark.createDataFrame([printing(**r) for r in rows], PRINTINGS)


def legal_df(spark, rows):
    return spark.createDataFrame(rows, LEGALITIES)


def rulings_df(spark, rows):
    return spark.createDataFrame(rows, RULINGS)


def cards_df(spark, rows):
    """Already-canonical card rows (all card columns + rulings), untyped."""
    from pyspark.sql import types as T
    schema = T.StructType([f for f in PRINTINGS.fields if f.name in CARD_COLUMNS]
                          + [T.StructField("rulings", T.StringType())])
    names = [f.name for f in schema.fields]
    data = []
    for r in rows:
        d = {n: None for n in names}
        d.update(r)
        data.append(tuple(d[n] for n in names))
    return spark.createDataFrame(data, schema)
