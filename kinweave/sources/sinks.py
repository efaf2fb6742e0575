"""Writing the graph: GraphML parts, CSV, and the JSON records that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.listing import edges_export, nodes_export, with_names


def graphml_nodes(vertices: DataFrame) -> DataFrame:
    """Node elements: an id and one data element per key."""
    def data(key: str, column: Column) -> Column:
        return F.struct(F.lit(key).alias("_key"), F.coalesce(column, F.lit("")).alias("_VALUE"))

    return vertices.select(F.col("id").alias("_id"), F.array(
        data("d_name", F.col("name")), data("d_myth", F.col("mythology")), data("d_class", F.col("class_name"))).alias("data"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """Edge elements, named by edge id."""
    return edges.select(
        F.concat(F.lit("e"), "id").alias("_id"), F.col("source_id").alias("_source"), F.col("target_id").alias("_target"),
        F.struct(F.lit("e_type").alias("_key"), F.col("type").alias("_VALUE")).alias("data"))


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML in parts: ``keys``, ``nodes`` and ``edges``, each a folder of XML files written in parallel."""
    keys = vertices.sparkSession.createDataFrame(
        [("d_name", "node", "name", "string"), ("d_myth", "node", "mythology", "string"),
         ("d_class", "node", "class", "string"), ("e_type", "edge", "relationship", "string")],
        "_id string, _for string, `_attr.name` string, `_attr.type` string")
    for part, frame, tag in (("keys", keys, "key"), ("nodes", graphml_nodes(vertices), "node"), ("edges", graphml_edges(edges), "edge")):
        frame.write.format("xml").mode("overwrite").option("rootTag", "graphml").option("rowTag", tag).save(f"{path}/{part}")


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One GraphML document as lines: section (0 head, 1 nodes, 2 edges, 3 tail), id, line.

    Characters that XML cannot hold are left out; line breaks in attributes are written as references.
    """
    def data(key: str, column: Column) -> Column:
        return F.concat(F.lit(f'<data key="{key}">'), _xml(column), F.lit("</data>"))

    nodes = vertices.select(F.lit(1).alias("section"), F.col("id").cast("string").alias("id"), F.concat(
        F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("d_name", F.col("name")), data("d_myth", F.col("mythology")),
        data("d_class", F.col("class_name")), F.lit("</node>")).alias("line"))
    links = edges.select(F.lit(2), F.col("id").cast("string"), F.concat(
        F.lit('<edge id="e'), _xml(F.col("id")), F.lit('" source="'), _xml(F.col("source_id")), F.lit('" target="'),
        _xml(F.col("target_id")), F.lit('">'), data("e_type", F.col("type")), F.lit("</edge>")))
    keys = "".join(f'<key id="{i}" for="{of}" attr.name="{name}" attr.type="string"/>' for i, of, name in (
        ("d_name", "node", "name"), ("d_myth", "node", "mythology"), ("d_class", "node", "class"), ("e_type", "edge", "relationship")))
    head = ('<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
            f'{keys}<graph id="graph" edgedefault="undirected">')
    ends = vertices.sparkSession.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "section int, id string, line string")
    return ends.union(nodes).union(links)


def _xml(column: Column) -> Column:
    """Text for an element or a quoted attribute."""
    text = F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def write_graphml_document(vertices: DataFrame, edges: DataFrame, path: str, one_file: bool = False) -> None:
    """One GraphML document with its ``graph`` element, in files that follow each other by name.

    Lines are sorted by section and id, so the files in the order of their names, one after the other
    (``getmerge`` or ``cat``), are the document; no task holds more than its range. With ``one_file``
    a single task writes all of it, for graphs that a GraphML reader can load at all.
    """
    lines = graphml_lines(vertices, edges)
    if one_file:
        lines = lines.coalesce(1).sortWithinPartitions("section", "id")
    else:
        lines = lines.orderBy("section", "id")
    lines.select("line").write.mode("overwrite").text(path)


def write_edges_csv(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    edges_export(edges, vertices).withColumnRenamed("label", "关系").write.mode("overwrite").csv(path, header=True)


def write_nodes_csv(vertices: DataFrame, edges: DataFrame, path: str, limit: int | None = None) -> None:
    nodes_export(vertices, edges, limit).write.mode("overwrite").csv(path, header=True)


def roundtrip_entities(vertices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entity records as the reader of enriched records expects them.

    The format keeps an entity's aliases in its record, so a record is as long as its names.
    """
    names = aliases.join(vertices.select("id", "name"), "id").filter(F.col("alias") != F.col("name")).select("id", "alias").distinct()
    lists = names.groupBy("id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    blank = F.lit("")

    def text(column: str):
        return F.coalesce(column, blank) if column in vertices.columns else blank

    return vertices.join(lists, "id", "left").select(
        F.col("wiki_id").cast("string").alias("id"), "name", text("class_name").alias("class"), text("prototype").alias("prototype"),
        text("detail_url").alias("detail_url"), text("mythology").alias("region"), text("description").alias("description"),
        text("mythology_background").alias("mythology_background"), text("image_url").alias("image_url"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.struct(text("alignment").alias("alignment"), text("gender").alias("gender")).alias("metadata"),
        text("enrich_model").alias("enrich_model"))


def roundtrip_edges(relationships: DataFrame, vertices: DataFrame) -> DataFrame:
    """All relations by name, whatever their status."""
    return with_names(relationships, vertices).select(
        "source_name", "target_name", F.col("type").alias("relationship"), "confidence", "evidence", "origin", "status", "id")


def write_roundtrip(vertices: DataFrame, aliases: DataFrame, relationships: DataFrame, path: str) -> None:
    """Entity and relation records as JSON lines, in two folders."""
    roundtrip_entities(vertices, aliases).write.mode("overwrite").json(f"{path}/entities")
    roundtrip_edges(relationships, vertices).drop("id").write.mode("overwrite").json(f"{path}/relationships")
