"""Graph sinks: Parquet without loss, and GraphML for viewers."""

from __future__ import annotations

from xml.etree import ElementTree as ET

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import EDGE_LIMIT, kinds


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graphml(nodes: DataFrame, edges: DataFrame) -> str:
    """GraphML of a graph that fits one document; evidence becomes its sorted kinds, nulls become empty."""
    if max(edges.count(), nodes.count()) > EDGE_LIMIT:
        raise ValueError(f"a GraphML document is one string; the graph has more than {EDGE_LIMIT} nodes or edges")
    if "evidence" in edges.columns:
        edges = edges.withColumn("evidence_kinds", kinds()).drop("evidence")
    root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    fields = [("node", f) for f in nodes.schema if f.name != "id"] + [("edge", f) for f in edges.schema if f.name not in ("src", "dst")]
    for owner, f in fields:
        ET.SubElement(root, "key", {"id": f"{owner}-{f.name}", "for": owner, "attr.name": f.name, "attr.type": "double" if f.dataType.simpleString() == "double" else "string"})
    graph = ET.SubElement(root, "graph", edgedefault="directed")
    for owner, df, ends in (("node", nodes.orderBy("id"), {"id": "id"}), ("edge", edges.orderBy("src", "dst"), {"source": "src", "target": "dst"})):
        for r in df.toLocalIterator():
            item = ET.SubElement(graph, owner, {k: str(r[c]) for k, c in ends.items()})
            for c in df.columns:
                if c not in ends.values():
                    ET.SubElement(item, "data", key=f"{owner}-{c}").text = "" if r[c] is None else str(r[c])
    return ET.tostring(root, encoding="unicode")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Write the document to a path of this machine or to the address of a store, e.g. ``file://`` or ``hdfs://``."""
    store, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with store.open_output_stream(place) as f:
        f.write(graphml(nodes, edges).encode())
    return path


def write_confirmed(nodes: DataFrame, confirmed: DataFrame, path: str) -> str:
    """GraphML of confirmed edges (src, dst, weight, similarity, coint_p, te_p) and the nodes that they join."""
    ends = confirmed.select(F.explode(F.array("src", "dst")).alias("end")).distinct()
    return write_graphml(nodes.join(ends, F.col("id") == F.col("end"), "left_semi"), confirmed, path)


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
