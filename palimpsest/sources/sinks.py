"""Writers. Tables are replaced by new versions, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_forms(df: DataFrame, path: str, caption: str = "", most: int = 1000) -> None:
    """CSV, JSON and LaTeX of a small result table (the result of an aggregate, not rows of a corpus). A table of
    more than `most` rows is no page of a document: it raises, nothing is left out."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a LaTeX table")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    df.coalesce(1).write.mode("overwrite").json(f"{path}.json")
    one = df.sparkSession.createDataFrame([(latex(df.columns, rows, caption),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(f"{path}.tex")


def latex(columns: list[str], rows: list[tuple], caption: str = "") -> str:
    """A table environment; special characters are escaped."""
    def cell(v) -> str:
        s = "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
        return "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}", "\\": r"\textbackslash{}"}.get(c, c) for c in s)

    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    return "\n".join([r"\begin{table}[ht]", r"\centering", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\hline", " & ".join(map(cell, columns)) + r" \\", r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"])


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def version(df: DataFrame, path: str, name: str) -> str:
    """A new version of a table beside the older ones; an existing one is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/version={name}")
    return f"{path}/version={name}"


def to_database(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it doesn't have."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with the columns it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def set_fields(df: DataFrame, struct: str, values: dict) -> DataFrame:
    """Fields of a struct replaced or added."""
    c = F.col(struct)
    for name, value in values.items():
        c = c.withField(name, value)
    return df.withColumn(struct, c)


def graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML file in parts: head, a line for each vertex and edge, foot. Lines are made on the executors;
    the parts, in the order of their names, are the document."""
    spark = vertices.sparkSession
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attrs = [c for c in vertices.columns if c != "id"]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[f'<key id="{c}" for="node" attr.name="{c}" attr.type="{"string" if dict(vertices.dtypes)[c] == "string" else "double"}"/>' for c in attrs], '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="undirected">']
    nodes = vertices.select(F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('">'), *[F.coalesce(F.concat(F.lit(f'<data key="{c}">'), esc(F.col(c)), F.lit("</data>")), F.lit("")) for c in attrs], F.lit("</node>")).alias("value"))
    links = edges.select(F.concat(F.lit('<edge source="'), esc(F.col("u")), F.lit('" target="'), esc(F.col("v")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    one = lambda lines: spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
    for name, d in (("1-head", one(head)), ("2-nodes", nodes), ("3-edges", links), ("4-foot", one(["</graph>", "</graphml>"]))):
        d.write.mode("overwrite").text(f"{path}/{name}")
