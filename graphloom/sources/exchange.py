"""Graph files: JSON documents and pairs of CSV files, in and out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import CERTAINTIES, UNRESOLVED, certainty_name, lookup
from ..operators.merge import Graph, statistics, unresolved
from ..operators.numbering import numbered

_PLACE = "struct<filePath:string,line:int,column:int>"
_NODE = f"id string, type string, displayName string, sourceLocation {_PLACE}, repositoryName string, projectName string, certainty string, metadata map<string,string>"
_EDGE = _NODE.replace("id string, ", "id string, sourceId string, targetId string, ", 1)


def _fields(schema: str) -> str:
    return schema.replace(" struct", ":struct").replace(" map", ":map").replace(" string", ":string").replace(", ", ",")


_WARNING = "code string, message string, path string, certainty string, metadata map<string,string>"
DOCUMENT = f"nodes array<struct<{_fields(_NODE)}>>, edges array<struct<{_fields(_EDGE)}>>, warnings array<struct<{_fields(_WARNING)}>>"
#: Columns of a table of warnings.
WARNINGS = "code string, message string, path string, certainty tinyint, metadata map<string,string>"
# Columns of the CSV files.
NODE_COLUMNS = {"id": "id", "type": "type", "displayName": "display_name", "repositoryName": "repository_name", "projectName": "project_name", "certainty": "certainty"}
EDGE_COLUMNS = {"id": "id", "sourceId": "source_id", "targetId": "target_id", "type": "type", "displayName": "display_name", "repositoryName": "repository_name", "projectName": "project_name", "certainty": "certainty"}


def csv_field(col: Column) -> Column:
    """Always quoted; null is empty; inner quotes are doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(doc_pos, line) of the CSV rows, without the header."""
    value = lambda c: certainty_name(F.col(c)) if c == "certainty" else F.col(c)
    return df.select("doc_pos", F.concat_ws(",", *(csv_field(value(c)) for c in columns.values())).alias("line"))


def write_csv_pair(g: Graph, folder: str) -> None:
    """`nodes` and `edges` as CSV, each a folder of parts in document order; every part starts with the header.

    Rows are written where they are; nothing goes through the driver.
    """
    for name, df, columns in (("nodes", g.nodes, NODE_COLUMNS), ("edges", g.edges, EDGE_COLUMNS)):
        rows = df.repartitionByRange("doc_pos").sortWithinPartitions("doc_pos")
        flat = rows.select(*((certainty_name(F.col(c)) if c == "certainty" else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(k) for k, c in columns.items()))
        flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", '""').csv(f"{folder}/{name}.csv")


def _elements(df: DataFrame, edges: bool) -> Column:
    place = F.struct(F.col("source_location.file_path").alias("filePath"), F.col("source_location.line").alias("line"), F.col("source_location.column").alias("column"))
    ends = [F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId")] if edges else []
    return F.struct(F.col("id"), *ends, F.col("type"), F.col("display_name").alias("displayName"), F.when(F.col("source_location").isNotNull(), place).alias("sourceLocation"), F.col("repository_name").alias("repositoryName"), F.col("project_name").alias("projectName"), certainty_name(F.col("certainty")).alias("certainty"), F.col("metadata"))


def json_lines(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(doc_pos, json) of nodes and edges: camel case, null properties left out, null map values kept."""
    return tuple(df.select("doc_pos", F.to_json(_elements(df, e)).alias("json")) for df, e in ((g.nodes, False), (g.edges, True)))


def warning_rows(warnings: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Warnings with all columns of WARNINGS; what a table lacks is null."""
    if warnings is None:
        return spark.createDataFrame([], WARNINGS)
    kinds = dict(x.rsplit(" ", 1) for x in WARNINGS.split(", "))
    return warnings.select(*((F.col(n) if n in warnings.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def warning_json(warnings: DataFrame) -> DataFrame:
    """(json) of warnings, in camel case and with the certainty's name; null properties left out."""
    return warnings.select(F.to_json(F.struct("code", "message", "path", certainty_name(F.col("certainty")).alias("certainty"), "metadata")).alias("json"))


def write_json(g: Graph, folder: str) -> None:
    """The document as JSON lines: folders `nodes`, `edges` and `warnings`, one element per line, in document order. Scales
    with the cluster; `read_document` reads the folder."""
    for name, df in zip(("nodes", "edges"), json_lines(g)):
        df.repartitionByRange("doc_pos").sortWithinPartitions("doc_pos").select("json").write.mode("overwrite").text(f"{folder}/{name}")
    warning_json(warning_rows(g.warnings, g.nodes.sparkSession)).write.mode("overwrite").text(f"{folder}/warnings")


def write_document(g: Graph, path: str, scan_metadata: dict | None = None) -> None:
    """One indented JSON document, for exchange with tools that want a single file. Elements stream through the driver one
    partition at a time; for large graphs use `write_json`."""
    nodes, edges = json_lines(g)
    warnings = warning_rows(g.warnings, g.nodes.sparkSession)
    by_code = lambda df: warning_json(df.orderBy("code", "path", "message"))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("{\n")
        lists = (("nodes", nodes.orderBy("doc_pos")), ("edges", edges.orderBy("doc_pos")), ("warnings", by_code(warnings)), ("unresolved", by_code(unresolved(warnings))))
        for name, df in lists:
            out.write(f'  "{name}": [')
            comma = "\n"
            for row in df.toLocalIterator():
                out.write(comma + "    " + json.dumps(json.loads(row.json), indent=2, ensure_ascii=False).replace("\n", "\n    "))
                comma = ",\n"
            out.write("\n  ],\n")
        stats = statistics(g).first().asDict()
        out.write(f'  "scanMetadata": {json.dumps(scan_metadata or {})},\n  "statistics": {json.dumps({_camel(k): v for k, v in stats.items()})}\n}}\n')


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def certainty_rank(written_as: Column) -> Column:
    """The rank of a certainty given by name, in any case, or by number; null for anything else."""
    number = written_as.try_cast("int")
    return F.coalesce(lookup(written_as, {n: i for i, n in enumerate(CERTAINTIES)}), F.when(number.between(0, len(CERTAINTIES) - 1), number)).cast("tinyint")


def read_document(spark: SparkSession, path: str) -> Graph:
    """Graph of one or many JSON documents (property names in any case), or of a folder made by `write_json`.

    Elements come in document order, those of several documents one document after the other, and an absent list is empty.
    A certainty that is no name and no number of one counts as Unresolved, and is reported as `unknown-certainty` among the
    warnings. A path that holds neither documents nor such a folder raises ValueError.
    """
    lists = _folders(spark, path)
    if lists is None:
        whole = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file_name", F.input_file_name())
        if not whole.where("nodes is not null or edges is not null").limit(1).count():
            raise ValueError(f"no graph document at {path}")
        raw = lambda name: whole.select("file_name", F.posexplode(name).alias("place", "e"))
    else:
        raw = lambda name: lists[name]
    rank = F.coalesce(certainty_rank(F.col("e.certainty")), F.lit(UNRESOLVED).cast("tinyint"))
    odd = []

    def flat(name: str, ends: list[Column]) -> DataFrame:
        e = numbered(raw(name), ["file_name", "place"], "doc_pos")
        unknown = e.where(F.col("e.certainty").isNotNull() & certainty_rank(F.col("e.certainty")).isNull())
        odd.append(unknown.select(F.lit("unknown-certainty").alias("code"), F.concat(F.lit(f"{name} "), F.coalesce("e.id", F.lit("?")), F.lit(": "), "e.certainty").alias("message"), F.col("file_name").alias("path")))
        place = F.when(F.col("e.sourceLocation").isNotNull(), F.struct(F.col("e.sourceLocation.filePath").alias("file_path"), F.col("e.sourceLocation.line").alias("line"), F.col("e.sourceLocation.column").alias("column")))
        return e.select(F.col("e.id").alias("id"), *ends, F.col("e.type").alias("type"), F.col("e.displayName").alias("display_name"), place.alias("source_location"), F.col("e.repositoryName").alias("repository_name"), F.col("e.projectName").alias("project_name"), rank.alias("certainty"), F.coalesce("e.metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "doc_pos")

    nodes, edges = flat("nodes", []), flat("edges", [F.col("e.sourceId").alias("source_id"), F.col("e.targetId").alias("target_id")])
    given = raw("warnings").select("e.code", "e.message", "e.path", certainty_rank(F.col("e.certainty")).alias("certainty"), "e.metadata")
    return Graph(nodes, edges, given.unionByName(warning_rows(odd[0].unionByName(odd[1]), spark)))


def _folders(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The lists of a folder made by `write_json`: (file_name, place, e), the files in order and their lines in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, name))
    if not (there("nodes") and there("edges")):
        return None
    out = {}
    for name, schema in (("nodes", _NODE), ("edges", _EDGE), ("warnings", _WARNING)):
        if there(name):
            lines = spark.read.schema(schema).json(f"{path}/{name}")
            # The files are named in order and read line by line; the number tells the lines of one file apart.
            out[name] = lines.select(F.input_file_name().alias("file_name"), F.monotonically_increasing_id().alias("place"), F.struct(*lines.columns).alias("e"))
        else:
            out[name] = spark.createDataFrame([], f"file_name string, place long, e struct<{_fields(schema)}>")
    return out


def register(g: Graph) -> None:
    """Temp views `graph_nodes` and `graph_edges`, for questions in SQL."""
    g.nodes.createOrReplaceTempView("graph_nodes")
    g.edges.createOrReplaceTempView("graph_edges")
