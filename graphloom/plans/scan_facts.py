"""All fact tables of `extract.build` from the delivered nodes, edges and documents.

A project, solution or repository lies at a path made of its id or name. Rows that lack what a fact needs (an end, a name)
are no fact. Also without a fact: methods that a project defines directly, and edges of types that the build itself infers
(AMBIGUOUS, MAPS_TO_TABLE, RESOLVES_TO_SERVICE, CROSSES_REPO_BOUNDARY). Entities are given without contexts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from . import graph_data as G

#: Kinds of nodes that are declared types.
TYPES = "('interface', 'implementation', 'controller', 'service', 'dbcontext')"
#: Fact tables in terms of {n}, {e} (trimmed nodes and edges), {one} (one row per node id), {docs} and, below, each other.
SCAN = {
    "repositories": "select repository_name name, concat('/src/', repository_name) root_path, min(seq) seq from {n} where repository_name is not null group by repository_name",
    "solutions": "select seq, name, concat('/src/', id, '.sln') full_path, repository_name, concat('/src/', repository_name) repository_path from {one} where kind = 'solution' and name is not null",
    "projects": """select o.seq, name, concat('/src/', o.id, '.csproj') full_path, concat('/src/', s.id, '.sln') solution_path, repository_name, concat('/src/', repository_name) repository_path
        from {one} o left join (select target_id, min_by(source_id, seq) id from {e} where kind = 'contains' and source_id like 'solution:%' group by 1) s on s.target_id = o.id where kind = 'project' and name is not null""",
    "project_refs": "select seq, concat('/src/', source_id, '.csproj') project_path, concat('/src/', target_id, '.csproj') referenced_path from {e} where kind = 'depends_on' and source_id like 'project:%' and target_id like 'project:%'",
    "config_values": "select seq, name key, coalesce(try_element_at(metadata, 'value'), concat(case when seq % 4 = 0 then '' else 'http://' end, coalesce(repository_name, 'none'), '/api')) value, location.file_path file_path, repository_name from {n} where kind = 'configurationkey' and name is not null",
    "types": f"""select o.seq, o.id type_id, name, name full_name, repository_name namespace, kind, cast(null as array<string>) bases, concat('/src/', p.id, '.csproj') project_path, coalesce(own_project, project_name) project_name, repository_name, location
        from {{n}} o left join (select e.target_id, min_by(e.source_id, e.seq) id, min_by(p.name, e.seq) own_project from {{e}} e join {{one}} p on p.id = e.source_id where e.kind = 'defines' and p.kind = 'project' group by 1) p on p.target_id = o.id where kind in {TYPES} and name is not null""",
    "type_interfaces": "select seq, source_id type_id, target_id interface_id, source_name type_name, target_name interface_name, true is_direct, repository_name, project_name, location from {e} where kind = 'implements'",
    "injections": "select seq, source_id type_id, target_id parameter_type_id, case when target_id like 'interface:%' then 'interface' else 'class' end parameter_kind, source_name type_name, target_name parameter_name, true ctor_public, true in_source, repository_name, project_name, location from {e} where kind = 'injects'",
    "methods": "select seq, target_id method_id, source_id type_id, target_name display_name, target_name name, source_name type_name, cast(null as string) returns, repository_name, project_name, location from {e} where kind = 'defines' and target_id like 'method:%' and source_id not like 'project:%'",
    "calls": "select seq, source_id caller_id, target_id, target_id target_type_id, source_name caller_name, target_name, target_name target_type_name, true target_in_source, target_id like 'interface:%' target_is_interface, repository_name, project_name, location from {e} where kind = 'calls'",
    "impl_methods": "select seq, target_id interface_method_id, source_id method_id, source_id containing_type_id, source_name display_name from {e} where kind = 'implements'",
    "registrations": "select seq, target_id interface_id, source_id implementation_id, 'AddScoped' method_name from {e} where kind = 'injects' and target_id like 'interface:%'",
    "dispatches": "select seq, source_id caller_id, target_id request_type_id, case when seq % 5 = 0 then 'publish' else 'send' end kind, source_name caller_name, target_name request_name, target_name short_name, 'Send' mediator_method, repository_name, project_name, location from {e} where kind = 'dispatches'",
    "handlers": "select distinct source_id request_type_id, target_id method_id, target_name handler_name, handler_kind from {e} lateral view explode(array('send', 'publish')) k as handler_kind where kind = 'handled_by'",
    "routes": """select n.seq, x.source_name controller_name, n.name action_name, cast(null as string) class_route, regexp_replace(n.name, '^[A-Z]+ ', '') method_route, coalesce(nullif(regexp_extract(n.name, '^([A-Z]+) ', 1), ''), 'GET') verb,
        coalesce(m.target_id, n.id) method_id, x.source_id controller_id, n.repository_name, n.project_name, n.location from {n} n join {e} x on x.kind = 'exposes' and x.target_id = n.id
        left join (select source_id, min_by(target_id, seq) target_id from {e} where kind = 'calls' group by 1) m on m.source_id = n.id where n.kind = 'endpoint' and n.name is not null""",
    "mapped_routes": """select n.seq, concat('Map', initcap(coalesce(nullif(regexp_extract(n.name, '^(GET|POST|PUT|DELETE|PATCH) ', 1), ''), 'GET'))) map_name, 2 arguments, regexp_replace(n.name, '^[A-Z]+ ', '') pattern, case when m.target_id is not null then 'method' end handler_kind, m.target_id handler_id,
        n.seq offset, n.location, n.repository_name, n.project_name from {n} n left anti join {e} x on x.kind = 'exposes' and x.target_id = n.id
        left join (select source_id, min_by(target_id, seq) target_id from {e} where kind = 'calls' group by 1) m on m.source_id = n.id where n.kind = 'endpoint' and n.name is not null""",
    "requests": """select seq, source_id caller_id, source_name caller_name, target_name client_name, 2 client_certainty, 'SEND' verb, cast(null as string) request_path, repository_name, project_name, location from {e} where kind = 'uses_http_client'
        union all select n.seq, u.source_id, u.source_name, coalesce(n.project_name, n.name), 1, coalesce(nullif(regexp_extract(n.name, '^([A-Z]+) ', 1), ''), 'GET'), regexp_replace(n.name, '^[A-Z]+ ', ''), n.repository_name, n.project_name, n.location
        from {n} n left join (select target_id, min_by(source_id, seq) source_id, min_by(source_name, seq) source_name from {e} where kind = 'calls_http' group by 1) u on u.target_id = n.id where n.kind = 'externalendpoint' and n.name is not null""",
    "entity_mappings": "select seq, cast(null as string) context_id, cast(null as string) context_name, id entity_id, name entity_name, cast(null as string) attribute_table, case when seq % 3 = 0 then project_name end to_table, repository_name, project_name from {one} where kind = 'entity' and name is not null",
    "entity_uses": """select seq, source_id method_id, source_name method_name, case when kind = 'uses_dbcontext' then target_id end context_id, case when kind = 'uses_dbcontext' then target_name end context_name,
        case when kind = 'queries_entity' then target_id end entity_id, case when kind = 'queries_entity' then target_name end entity_name, repository_name, project_name from {e} where kind in ('uses_dbcontext', 'queries_entity')""",
    "sql_texts": "select doc_id seq, concat('document:', doc_id) method_id, concat('document ', doc_id) method_name, text sql, cast(null as string) repository_name, 'documents' project_name from {docs} where doc_id is not null and text is not null",
}


def facts(spark: SparkSession, d: str) -> extract.Facts:
    """Every table that a contributor reads."""
    text = lambda x: f"nullif(trim({x}), '')"
    rest = f"source_location location, {text('repository_name')} repository_name, {text('project_name')} project_name, metadata"
    n = spark.sql(f"select doc_pos seq, lower(trim(id)) id, lower(trim(type)) kind, {text('display_name')} name, {rest} from {{t}} where {text('id')} is not null", t=G.table(spark, d, "nodes"))
    one = n.groupBy("id").agg(*(F.min_by(F.col(x), "seq").alias(x) for x in ("kind", "name", "repository_name", "project_name")), F.min("seq").alias("seq"))
    named = "lower(trim(source_id)) source_id, lower(trim(target_id)) target_id, lower(trim(type)) kind"
    e = spark.sql(f"select doc_pos seq, {named}, {rest} from {{t}} where {text('source_id')} is not null and {text('target_id')} is not null", t=G.table(spark, d, "edges"))
    for end in ("source", "target"):
        names = one.select(F.col("id").alias(f"{end}_id"), F.col("name").alias("end_name"))
        e = e.join(names, f"{end}_id", "left").withColumn(f"{end}_name", F.coalesce("end_name", f"{end}_id")).drop("end_name")
    n, one, e = extract.written(n), extract.written(one), extract.written(e)  # read by every fact below
    given = {"n": n, "one": one, "e": e, "docs": G.table(spark, d, "documents")}
    out = {name: spark.sql(sql, **{k: v for k, v in given.items() if f"{{{k}}}" in sql}) for name, sql in SCAN.items()}
    out["workspace"] = spark.createDataFrame([("/src", 0)], "root_path string, seq long")
    out["http_requests"] = _addressed(out.pop("requests"), out["config_values"])
    return out


def _addressed(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Requests with the base address that the settings give their client; clients of one name and repository share it."""
    settings = config.withColumn("repository_path", F.col("repository_name"))
    key = F.to_json(F.array("client_name", "repository_name"))
    clients = requests.select(key.alias("client_no"), F.col("client_name").alias("hint"), F.col("repository_name").alias("repository_path")).distinct()
    urls = extract.base_urls(clients, settings)
    return requests.withColumn("client_no", key).join(urls, "client_no", "left").drop("client_no")

