def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [str(x) for x in r])


def value(spark, expr_of, **cells):
    """Result of a column function on one row of string cells."""
    schema = ", ".join(f"`{k}` string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(expr_of.alias("v")).first()["v"]
