"""Queries of the extraction, discovery, exchange, report and watching operators.

Their facts come from the delivered tables (FACTS says how, in SQL that both engines read) or from the literal listings below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import routes as R
from ..functions.jsonflat import flatten_rows
from ..operators import extract, merge, reports
from ..sources import discovery, exchange
from ..streaming import watch
from . import graph_data as G
from . import scan_facts

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


#: Fact tables over the delivered rows, in SQL for both engines.
FACTS = {
    "calls": """select doc_pos seq, lower(trim(source_id)) caller_id, lower(trim(target_id)) target_id, lower(trim(target_id)) target_type_id, display_name caller_name, display_name target_name,
        display_name target_type_name, true target_in_source, true target_is_interface, repository_name, project_name
        from edges where lower(trim(type)) = 'calls' and lower(trim(target_id)) like 'interface:%' and source_id is not null""",
    "impl_methods": """select doc_pos seq, lower(trim(target_id)) interface_method_id, lower(trim(source_id)) method_id, lower(trim(source_id)) containing_type_id, display_name
        from edges where lower(trim(type)) = 'implements' and source_id is not null and target_id is not null""",
    "registrations": """select doc_pos seq, lower(trim(target_id)) interface_id, lower(trim(source_id)) implementation_id, 'AddScoped' method_name
        from edges where lower(trim(type)) = 'injects' and lower(trim(target_id)) like 'interface:%' and source_id is not null""",
    "dispatches": """select doc_pos seq, lower(trim(source_id)) caller_id, lower(trim(target_id)) request_type_id, case when doc_pos % 5 = 0 then 'publish' else 'send' end kind, display_name caller_name,
        display_name request_name, display_name short_name, 'Send' mediator_method, repository_name, project_name
        from edges where lower(trim(type)) = 'dispatches' and source_id is not null and target_id is not null""",
    "handlers": """select distinct lower(trim(source_id)) request_type_id, lower(trim(target_id)) method_id, lower(trim(target_id)) handler_name, case when length(trim(target_id)) % 2 = 0 then 'send' else 'publish' end handler_kind
        from edges where lower(trim(type)) = 'handled_by' and source_id is not null and target_id is not null""",
    "entities": """select min(doc_pos) seq, lower(trim(id)) entity_id, max(display_name) entity_name, cast(null as varchar(100)) attribute_table, case when max(doc_pos) % 3 = 0 then max(project_name) end to_table, max(repository_name) repository_name, max(project_name) project_name
        from nodes where lower(trim(type)) = 'entity' and display_name is not null and trim(display_name) <> '' group by lower(trim(id))""",
    "declared": """select doc_pos seq, id, case when lower(trim(type)) = 'interface' then 'interface' else 'class' end kind, regexp_replace(display_name, '[a-z0-9][a-z0-9][a-z0-9]$', '') name from nodes where display_name is not null""",
    "links": """select distinct lower(trim(source_id)) type_name, lower(trim(target_id)) base_name from edges where lower(trim(type)) in ('defines', 'contains') and source_id is not null and target_id is not null""",
    "sql_texts": """select doc_pos seq, concat('SELECT * FROM ', case when doc_pos % 3 = 0 then '[dbo].' else '' end, regexp_replace(trim(target_id), '^[A-Za-z]+:', ''), case when doc_pos % 2 = 0 then concat(' t JOIN ', coalesce(project_name, 'other'), ' p') else '' end) sql
        from edges where lower(trim(type)) in ('queries_entity', 'maps_to_table') and target_id is not null""",
    "settings": """select doc_pos seq, display_name as key, concat(case when doc_pos % 4 = 0 then '' else 'http://' end, coalesce(repository_name, 'none'), '/api') as value, repository_name repository_path
        from nodes where lower(trim(type)) = 'configurationkey' and display_name is not null""",
    "http_clients": """select doc_pos client_no, trim(display_name) hint, repository_name repository_path from nodes where lower(trim(type)) = 'httpclient'""",
    "progress": """select event_id seq, 'load' stage, concat(case event_type when 'view' then 'Loaded ' else 'Failed to load ' end, event_type, ' ', user_id, case when event_id % 7 = 0 then '' else concat(': ', event_type, ' broken') end) message,
        case when event_id % 3 <> 0 then cast(event_id as int) end current, 100000 total from events""",
    "requests": """select doc_pos call_no, coalesce(nullif(regexp_replace(trim(display_name), '^[A-Z]+ ', ''), ''), '/') path, case when doc_pos % 3 <> 0 then lower(trim(repository_name)) end host, project_name client_name,
        cast(null as varchar(100)) base_url from nodes where lower(trim(type)) in ('externalendpoint', 'endpoint') and display_name is not null""",
    "routes": """select lower(trim(id)) id, max(display_name) display_name, max(repository_name) repository_name, max(project_name) project_name, regexp_replace(max(trim(display_name)), '^[A-Z]+ ', '') route
        from nodes where lower(trim(type)) = 'endpoint' and display_name is not null and trim(display_name) <> '' group by lower(trim(id))""",
}


def fact(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A fact table; the name of the source table in its text is replaced by the loaded one."""
    text = FACTS[name]
    for t in ("edges", "nodes", "events"):
        if f"from {t}" in text:
            return spark.sql(text.replace(f"from {t}", "from {source}"), source=G.table(spark, d, t))
    raise KeyError(name)


def _f(*names: str) -> str:
    return "with recursive " + ", ".join(f"{n} as ({FACTS[n]})" for n in names)


# -- extraction --------------------------------------------------------------------------------------------------------
@query(_f("calls", "impl_methods", "registrations") + """,
impl as (select interface_method_id, method_id, min(containing_type_id) containing_type_id from impl_methods group by 1, 2),
found as (select c.seq, c.caller_id, c.target_id, i.method_id, (select count(*) from registrations r where r.interface_id = c.target_type_id) > 0 registered,
  (select count(*) from registrations r where r.interface_id = c.target_type_id and r.implementation_id = i.containing_type_id) > 0 chosen
  from calls c join impl i on i.interface_method_id = c.target_id)
select seq, caller_id, target_id, method_id, case when registered then 'service-registration' else 'interface-implementation' end resolution,
  case when count(*) over (partition by seq) = 1 then 2 else 1 end certainty from found where chosen or not registered""")
def interface_resolution(spark: SparkSession, d: str) -> DataFrame:
    r = extract.interface_targets(fact(spark, d, "calls"), fact(spark, d, "impl_methods"), fact(spark, d, "registrations"))
    return r.select("seq", "caller_id", "target_id", "method_id", "resolution", "certainty")


@query(_f("dispatches", "handlers") + """
select d.seq, d.caller_id, d.request_type_id, h.method_id, case when d.kind = 'send' and h.method_id is null then 0 else 3 end dispatch_certainty,
  case when d.kind = 'publish' then 3 when count(h.method_id) over (partition by d.seq) = 1 then 2 else 1 end handler_certainty
from dispatches d left join handlers h on h.request_type_id = d.request_type_id and h.handler_kind = d.kind""")
def dispatch_handlers(spark: SparkSession, d: str) -> DataFrame:
    r = extract.resolved_dispatches(fact(spark, d, "dispatches"), fact(spark, d, "handlers"))
    return r.select("seq", "caller_id", "request_type_id", "method_id", "dispatch_certainty", "handler_certainty")


@query(_f("declared") + """ select id, seq, case when kind = 'interface' then 'Interface' when name like '%Controller' then 'Controller'
when name like '%Service' or name like '%Repository' or name like '%Manager' or name like '%Handler' or name like '%Client' then 'Service' else 'Implementation' end class_type from declared""")
def classify_type(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d, "declared").select("id", "seq", extract.classify(F.col("kind"), F.col("name"), F.array().cast("array<string>")).alias("class_type"))


@query(_f("links") + """, direct as (select * from links where type_name <> base_name),
up(type_name, base_name, depth) as (select n, n, 0 from (select type_name n from links union select base_name from links)
  union select u.type_name, d.base_name, u.depth + 1 from up u join direct d on d.type_name = u.base_name where u.depth < 200)
select type_name, base_name, min(depth) depth from up group by 1, 2""")
def inherits_closure(spark: SparkSession, d: str) -> DataFrame:
    """All links, from nodes of every kind."""
    return extract.inherits(fact(spark, d, "links"))


@query(_f("sql_texts") + """ select seq, unnest(regexp_extract_all(sql, '(?i)\\b(?:from|join|update|into|table)\\s+([A-Za-z0-9_.\\[\\]]+)', 1)) table_name from sql_texts where sql is not null""")
def sql_lineage(spark: SparkSession, d: str) -> DataFrame:
    t = fact(spark, d, "sql_texts").where("sql is not null")
    return t.select("seq", F.explode(extract.named_tables(F.col("sql"))).alias("table_name"))


@query("select doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:from|join|update|into|table)\\s+([A-Za-z0-9_.\\[\\]]+)', 1)) table_name from documents where text is not null")
def document_tables(spark: SparkSession, d: str) -> DataFrame:
    """The same over all texts, of which few or none name a table."""
    t = G.table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(extract.named_tables(F.col("text"))).alias("table_name"))


@query(_f("entities") + " select entity_id, coalesce(to_table, attribute_table, entity_name) table_name, case when to_table is null then 2 else 3 end certainty from entities")
def entity_tables(spark: SparkSession, d: str) -> DataFrame:
    return extract.entity_tables(fact(spark, d, "entities")).select("entity_id", "table_name", "certainty")


@query(_f("http_clients", "settings") + """, good as (select *, upper(key) k, upper(value) v from settings where regexp_matches(value, '^[a-zA-Z]+://[^/]+')),
near as (select client_no, first(value order by tier, seq) base_url from (
  select c.client_no, g.value, g.seq, case when contains(k, upper(hint)) or contains(v, upper(hint)) then 0 else 1 end tier
  from http_clients c join good g on upper(g.repository_path) is not distinct from upper(c.repository_path) where contains(k, 'URL')) group by 1),
named as (select h, first(value order by seq) base_url from (select distinct upper(hint) h from http_clients) c join good on contains(k, h) group by 1)
select c.client_no, coalesce(n.base_url, m.base_url, (select first(value order by seq) from good)) base_url
from http_clients c left join near n using (client_no) left join named m on m.h = upper(c.hint)""")
def base_url_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Every client with its whole name as hint."""
    return extract.base_urls(fact(spark, d, "http_clients"), fact(spark, d, "settings"))


_MATCH = """, pairs as (
  select r.call_no, e.id endpoint_id, r.host, r.client_name, e.repository_name, e.project_name,
    starts_with(upper(path), upper(route)) or starts_with(upper(route), upper(path)) or
      (len(ps) = len(rs) and list_aggregate(list_transform(range(1, len(ps) + 1), lambda i: (rs[i] like '{%}') or upper(rs[i]) = upper(ps[i])), 'bool_and') is not false) matched,
    upper(ps[1]) is not distinct from upper(rs[1]) head
  from (select *, list_filter(string_split(path, '/'), lambda x: x <> '') ps from requests) r, (select *, list_filter(string_split(route, '/'), lambda x: x <> '') rs from routes) e)
"""


@query(_f("requests", "routes") + _MATCH + """, tiers as (
  select call_no, endpoint_id, case
    when matched and host is not null and (contains(upper(host), upper(coalesce(project_name, ''))) or contains(upper(host), upper(coalesce(repository_name, '')))) then 1
    when matched and host is null and (coalesce(contains(upper(project_name), upper(coalesce(client_name, ''))), false) or coalesce(contains(upper(repository_name), upper(coalesce(client_name, ''))), false)) then 1
    when head and (upper(repository_name) is not distinct from upper(host) or coalesce(contains(upper(host), upper(coalesce(repository_name, ''))), false)) then 2
    when upper(repository_name) = upper(host) then 3 end tier
  from pairs),
best as (select *, min(tier) over (partition by call_no) b from tiers where tier is not null)
select call_no, endpoint_id, case when count(*) over (partition by call_no) = 1 then 2 else 1 end certainty from best where tier = b""")
def internal_target(spark: SparkSession, d: str) -> DataFrame:
    e = fact(spark, d, "routes").withColumn("metadata", F.create_map(F.lit("route"), F.col("route")))
    return extract.internal_targets(fact(spark, d, "requests"), e).select("call_no", "endpoint_id", "certainty")


@query(_f("requests", "routes") + _MATCH + "select call_no, endpoint_id from pairs where matched")
def route_match(spark: SparkSession, d: str) -> DataFrame:
    own, e = fact(spark, d, "requests"), fact(spark, d, "routes").withColumnsRenamed({"id": "endpoint_id", "repository_name": "endpoint_repo"})
    return extract._alike(own, e).where("matched").select("call_no", "endpoint_id")


@query("""select event_id, '/' || trim(array_to_string(list_filter([trim('/api/[controller]/', '/'), trim(case when event_id % 3 = 0 then '' else '/[Action]/{id}' end, '/')], lambda x: x <> ''), '/')
  .replace('[controller]', event_type).replace('[Action]', 'Get' || user_id), '/') route from events""")
def normalize_route(spark: SparkSession, d: str) -> DataFrame:
    e = G.table(spark, d, "events")
    action = F.when(F.col("event_id") % 3 == 0, "").otherwise("/[Action]/{id}")
    return e.select("event_id", R.normalize_route(F.lit("/api/[controller]/"), action, F.concat("event_type", F.lit("Controller")), F.concat(F.lit("Get"), F.col("user_id").cast("string"))).alias("route"))


@query("""select event_id, case when event_id % 4 = 0 then 'https://other.example/' || event_type when event_id % 4 = 1 then 'http://' || event_type || '.example/v' || user_id
  when event_id % 4 = 2 then 'http://' || event_type || '.example/api/v' || user_id else null end uri from events""")
def combine_uri(spark: SparkSession, d: str) -> DataFrame:
    e = G.table(spark, d, "events").withColumn("r", F.col("event_id") % 4).withColumn("u", F.col("user_id").cast("string"))
    base = F.when(F.col("r") != 3, F.concat(F.lit("http://"), "event_type", F.lit(".example/api/list")))
    path = F.when(F.col("r") == 0, F.concat(F.lit("https://other.example/"), "event_type")).when(F.col("r") == 1, F.concat(F.lit("/v"), "u")).otherwise(F.concat(F.lit("v"), "u"))
    return e.select("event_id", R.combine_uri(base, path).alias("uri"))


@query("""select c_custkey, 'project:' || substr(sha256('/src/' || n_name || '/' || c_name || '.csproj'), 1, 16) id, n_name repository_name from customer join nation on c_nationkey = n_nationkey""")
def scan_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects of a graph that is built whole from facts: nations as repositories, customers as projects."""
    g = extract.build(_topology(spark, d))
    p = G.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("display_name"))
    return g.nodes.where("type = 'Project'").join(p, "display_name").select("c_custkey", "id", "repository_name")


def _topology(spark: SparkSession, d: str) -> extract.Facts:
    n, c = G.table(spark, d, "nation"), G.table(spark, d, "customer")
    repo = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("repository_name"), F.concat(F.lit("/src/"), "n_name").alias("repository_path"))
    return {
        "workspace": spark.createDataFrame([("/src", 0)], "root_path string, seq long"),
        "repositories": n.select(F.col("n_name").alias("name"), F.concat(F.lit("/src/"), "n_name").alias("root_path"), F.col("n_nationkey").cast("long").alias("seq")),
        "projects": c.join(repo, "c_nationkey").select(F.col("c_name").alias("name"), F.concat("repository_path", F.lit("/"), "c_name", F.lit(".csproj")).alias("full_path"), "repository_name", "repository_path", F.col("c_custkey").alias("seq")),
        "project_refs": c.select(F.col("c_custkey").alias("a"), F.col("c_nationkey")).join(repo, "c_nationkey").where("false").select(F.lit("").alias("project_path"), F.lit("").alias("referenced_path"), F.col("a").alias("seq")),
    }


@query("""select type, count(*) edges from (select 'CONTAINS' type from nation union all select 'CONTAINS' from customer) group by 1""")
def scan_edges(spark: SparkSession, d: str) -> DataFrame:
    return extract.build(_topology(spark, d)).edges.groupBy("type").agg(F.count("*").alias("edges"))


@query()
def scan_graph(spark: SparkSession, d: str) -> DataFrame:
    """(kind, type, certainty, rows) of the graph that all contributors build from all fact tables; no SQL, tests count by hand."""
    g = extract.build(scan_facts.facts(spark, d))
    n, e = (df.select(F.lit(kind).alias("kind"), "type", "certainty") for df, kind in ((g.nodes, "node"), (g.edges, "edge")))
    return n.unionByName(e).groupBy("kind", "type", "certainty").agg(F.count("*").alias("rows"))


# -- discovery and paths -----------------------------------------------------------------------------------------------
_FILES = "select distinct lower(trim(id)) id, replace(source_location.file_path, '\\', '/') path from nodes where source_location.file_path is not null"


def _file_paths(spark: SparkSession, d: str) -> DataFrame:
    n = G.table(spark, d, "nodes").where("source_location.file_path is not null")
    return n.select(G.key("id").alias("id"), P.slashed(F.col("source_location.file_path")).alias("path")).distinct()


@query(f"""with f as ({_FILES}), r as (select distinct regexp_extract(path, '^(src/[^/]+)/', 1) root from f where path like 'src/%/%')
select id, path, (select root from r where starts_with(lower(f.path), lower(r.root) || '/') order by length(root) desc, root desc limit 1) owner from f""")
def owner_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    f = _file_paths(spark, d)
    roots = f.select(F.regexp_extract("path", "^(src/[^/]+)/", 1).alias("root_path")).where("root_path != ''").distinct().withColumn("name", F.col("root_path"))
    return discovery.owners(f, roots).select("id", "path", F.col("repository_name").alias("owner"))


@query(f"""with f as ({_FILES}) select id, path from f where not (
  contains('/work/' || lower(path), '/falcon/') or ('/work/' || lower(path)) like '%/falcon' or lower(path) like 'src/drift/%' or lower(path) like 'src/harbor.platform.api/%' or lower(path) = 'src/drift')""")
def exclude_paths(spark: SparkSession, d: str) -> DataFrame:
    pats = F.array(*map(F.lit, ["Falcon", "src\\drift", "/work/SRC/Harbor.Platform.Api", " ", "/elsewhere"]))
    return _file_paths(spark, d).where(~P.excluded(F.concat(F.lit("/work/"), "path"), F.lit("/work"), pats))


@query(f"""with f as ({_FILES}) select id, path, regexp_extract(path, '[^/]*$') file_name, lower(regexp_extract(path, '\\.[^./]*$')) extension,
  contains(lower(path), '/obj/') or lower(path) like '%.g.cs' or lower(path) like '%.designer.cs' is_generated from f""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _file_paths(spark, d).select("id", "path", P.file_name(p).alias("file_name"), P.extension(p).alias("extension"), P.is_generated(p).alias("is_generated"))


@query(f"""with f as ({_FILES}) select id, path, 'Changed: ' || path reason from f where not contains('/work/' || lower(path), '/falcon/') and regexp_matches(lower(path), '\\.(cs|csproj|sln|props|targets|json|xml)$')""")
def rescan_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _file_paths(spark, d).select("id", "path", F.lit("Changed").alias("kind"), F.concat(F.lit("/work/"), "path").alias("whole"))
    return c.where(P.calls_for_rescan(F.col("whole"), F.lit("/work"), F.array(F.lit("falcon")))).select("id", "path", P.change_reason(F.col("kind"), F.col("whole"), F.lit("/work")).alias("reason"))


@query("select event_id, unnest(json_keys(props)) as key, unnest(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k))) as value from events where props is not null")
def config_flatten(spark: SparkSession, d: str) -> DataFrame:
    return flatten_rows(G.table(spark, d, "events"), ["event_id"], "props").where("not failed").select("event_id", "key", "value")


@query("select 'tools' as pattern union all select 'samples' union all select 'platform/core'")
def ignore_patterns(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(["# built", " samples ", "", "tools", "platform/core", "SAMPLES", "#x"])), "seq long, value string")
    return discovery.patterns(lines)


@query("""select * from (values ('repositories', '/w/a'), ('repositories', '/w/b'), ('solutions', '/w/a/A.sln'), ('projects', '/w/a/x/X.csproj'), ('projects', '/w/c/C.csproj'),
  ('config_values', 'Client:BaseUrl=http://b'), ('config_values', 'Client:Hosts[0]=x'), ('config_values', 'Client:On=True'), ('warnings', 'config-parse-failed')) t(kind, value)""")
def discover_listing(spark: SparkSession, d: str) -> DataFrame:
    files = [("/w/a/.git/HEAD", None), ("/w/b/.git", None), ("/w/a/A.sln", None), ("/w/a/x/X.csproj", None), ("/w/a/x/x.CSPROJ", None), ("/w/a/x/obj/Y.csproj", None), ("/w/c/C.csproj", None), ("/w/d/skip/D.csproj", None)]
    files += [("/w/a/x/appsettings.json", '{"Client": {"BaseUrl": "http://b", "Hosts": ["x"], "On": true, "None": {}}}'), ("/w/b/AppSettings.dev.json", "{broken")]
    t = discovery.discover(spark.createDataFrame([(p, False, c) for p, c in files], "path string, is_dir boolean, content string"), "/w", ["skip"])
    out = t["config_values"].select(F.lit("config_values").alias("kind"), F.concat_ws("=", "key", "value").alias("value"))
    for kind, col in (("repositories", "root_path"), ("solutions", "full_path"), ("projects", "full_path"), ("warnings", "code")):
        out = out.unionByName(t[kind].select(F.lit(kind).alias("kind"), F.col(col).alias("value")))
    return out


# -- exchange ----------------------------------------------------------------------------------------------------------
def _csv(names: dict[str, str]) -> str:
    q = lambda c: f"""'"' || replace(coalesce({"['Unresolved', 'Ambiguous', 'Inferred', 'Exact'][certainty + 1]" if c == "certainty" else c}, ''), '"', '""') || '"'"""
    return " || ',' || ".join(q(c) for c in names.values())


@query(f"with {G.MERGED} select doc_pos, {_csv(exchange.NODE_COLUMNS)} line from o_nodes")
def csv_nodes(spark: SparkSession, d: str) -> DataFrame:
    return exchange.csv_lines(G.delivered(spark, d, ordered=True).nodes, exchange.NODE_COLUMNS)


@query(f"with {G.MERGED} select doc_pos, {_csv(exchange.EDGE_COLUMNS)} line from o_edges")
def csv_edges(spark: SparkSession, d: str) -> DataFrame:
    return exchange.csv_lines(G.delivered(spark, d, ordered=True).edges, exchange.EDGE_COLUMNS)


@query()
def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON elements; tests make the round trip."""
    return exchange.json_lines(G.delivered(spark, d, ordered=True))[0]


# -- reports and watching ----------------------------------------------------------------------------------------------
_SIG = _f("progress") + """, marked as (select *, case when starts_with(message, 'Failed to ') then case when contains(message, ': ') then substr(message, position(': ' in message) + 2) else message end end sig,
  case when current is null then '[load]' else '[load ' || current || '/' || total || ']' end head from progress)
"""


@query(_SIG + """, ranked as (select *, row_number() over (partition by sig order by seq) n from marked)
select seq, head || ' ' || case when sig is null or n <= 3 then message else 'Suppressing additional repeated failures for: ' || sig end line from ranked where sig is null or n <= 4""")
def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return reports.printed(fact(spark, d, "progress"))


@query(_SIG + "select sig, count(*) - 3 suppressed from marked where sig is not null group by 1 having count(*) > 3")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.failure_summary(fact(spark, d, "progress"))


@query(_f("progress") + " select seq from progress where current <= 1 or current = total or current % 50 = 0")
def progress_sample(spark: SparkSession, d: str) -> DataFrame:
    return reports.sampled(fact(spark, d, "progress"), 50).select("seq")


@query(f"with {G.MERGED}, s as (select count(*) filter (where type = 'Repository') a, count(*) filter (where type = 'Project') b, count(*) filter (where type = 'Endpoint') c, count(*) filter (where type = 'Method') d, count(*) filter (where type = 'Table') e from g_nodes), "
       "t as (select count(*) filter (where type in ('CALLS_HTTP', 'USES_HTTP_CLIENT')) f, count(*) filter (where type = 'CROSSES_REPO_BOUNDARY') g, count(*) filter (where certainty in (0, 1)) h from g_edges) "
       "select unnest(range(8))::int place, unnest(['Repositories: ' || a, 'Projects: ' || b, 'Endpoints: ' || c, 'Methods: ' || d, 'HTTP edges: ' || f, 'Tables: ' || e, 'Cross-repo links: ' || g, 'Ambiguous edges: ' || h]) line from s, t")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_lines(merge.statistics(G.delivered(spark, d)))


@query("""with recursive t as (select user_id, epoch_us(ts) at_us, count(*) n from events where user_id is not null and ts is not null group by 1, 2),
walk(user_id, batch_no, opened_us) as (
  select user_id, 0, min(at_us) from t group by 1
  union all select w.user_id, w.batch_no + 1, (select min(at_us) from t where t.user_id = w.user_id and t.at_us >= w.opened_us + 21600000000) from walk w
  where (select min(at_us) from t where t.user_id = w.user_id and t.at_us >= w.opened_us + 21600000000) is not null)
select w.user_id, w.batch_no, w.opened_us, sum(n)::bigint events from walk w join t on t.user_id = w.user_id and t.at_us >= w.opened_us and t.at_us < w.opened_us + 21600000000 group by 1, 2, 3""")
def fixed_delay_batches(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.keys import micros

    e = G.table(spark, d, "events")
    return watch.batches(e.select("user_id", "event_id", micros(e, "ts").alias("at_us")), "user_id", 6 * 3600 * 10**6)


@query("""with r as (select user_id, event_type, min(event_id) first_id from events group by 1, 2)
select user_id, array_to_string(list(event_type order by first_id)[:5], ', ') || case when count(*) > 5 then ', +' || (count(*) - 5) || ' more' else '' end line from r group by 1""")
def reason_digest(spark: SparkSession, d: str) -> DataFrame:
    first = G.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))  # at most five kinds per user
    listed = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"]).alias("reasons"))
    return listed.select("user_id", watch.digest(F.col("reasons")).alias("line"))
