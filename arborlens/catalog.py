"""The operators on the shared test tables, and the same in DuckDB SQL; on source trees: catalog_trees.

The tables are no source trees, so each query here gives an operator an analogous shape: documents stand for files, their languages for
extensions, pages for paths and quoted specifiers, foreign keys for the import graph. Every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog_trees  # noqa: F401 (registers its queries)
from .catalog_registry import ORACLES, QUERIES, query  # noqa: F401
from .functions import text
from .functions.json_keys import section_keys
from .operators import graph, imports, infer, manifests, metrics, ranks, tree, usage
from .plans import analyze
from .sources import repo

#: Language of a document -> extension of its file; the last one is no known language.
EXTENSIONS = {"en": "py", "es": "rs", "fr": "TS", "de": "txt"}
_SQL_EXT = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " END"
_SQL_LANGUAGE = "CASE lang WHEN 'en' THEN 'Python' WHEN 'es' THEN 'Rust' WHEN 'fr' THEN 'TypeScript' END"
#: White space of Unicode as an RE2 class.
_WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _trimmed(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


_LOC = f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')))"
_HOST_PATH = "regexp_replace(url, '^https?://', '')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extension() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.col("lang"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (repo_id, path, name, ext, content)."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), _extension())
    out = docs.select(F.lit("docs").alias("repo_id"), path.alias("path"), F.col("text").cast("binary").alias("content"))
    return out.withColumn("name", text.file_name(F.col("path"))).withColumn("ext", text.extension(F.col("name")))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): URLs without their scheme."""
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


@query("SELECT page_id, (url LIKE 'http://%' OR url LIKE 'https://%' OR url LIKE 'git@%') AS direct, ('ssh:' || url LIKE 'http%') AS other FROM pages")
def git_url_predicate(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.is_git_url(F.col("url")).alias("direct"), text.is_git_url(F.concat(F.lit("ssh:"), "url")).alias("other"))


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/target/' WHEN 1 THEN 'targets/' ELSE '' END || {_HOST_PATH} AS path FROM pages WHERE page_id % 5 <> 0")
def ignored_segment_filter(spark, sf_dir):
    lead = F.when(F.col("page_id") % 5 == 0, "a/target/").when(F.col("page_id") % 5 == 1, "targets/").otherwise("")
    return repo.from_table(_paths(spark, sf_dir).withColumn("path", F.concat(lead, "path"))).select("page_id", "path")


@query(f"SELECT page_id, row_number() OVER (ORDER BY string_split({_HOST_PATH}, '/'), page_id) AS place FROM pages")
def path_component_order(spark, sf_dir):
    return ranks.numbered(_paths(spark, sf_dir), [text.order_key(F.col("path")), F.col("page_id")], "place").drop("path")


@query("SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 1) THEN -1 ELSE length(text) END AS chars FROM documents")
def text_gate(spark, sf_dir):
    raw = F.col("text").cast("binary")
    tail = F.when(F.col("doc_id") % 10 == 0, F.lit(b"\x00")).when(F.col("doc_id") % 10 == 1, F.lit(b"\xf0\x28\x8c\x28")).otherwise(F.lit(b""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length(text.text_of(F.concat(raw, tail))).cast("bigint"), F.lit(-1)).alias("chars"))


@query(f"SELECT doc_id, {_LOC} + 1 AS loc FROM documents")
def document_loc(spark, sf_dir):
    body = F.concat("text", F.lit("\n  \t\r\n\n　\n﻿"))  # a mark of byte order is no white space
    return _table(spark, sf_dir, "documents").select("doc_id", text.line_count(body).alias("loc"))


@query(
    f"SELECT doc_id, lower(regexp_extract(n, '^.+\\.([^.]*)$', 1)) AS ext FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.bashrc' WHEN 1 THEN 'Makefile' ELSE 'x.tar.' || {_SQL_EXT} END AS n FROM documents)"
)
def url_extension(spark, sf_dir):
    name = F.when(F.col("doc_id") % 4 == 0, ".bashrc").when(F.col("doc_id") % 4 == 1, "Makefile").otherwise(F.concat(F.lit("x.tar."), _extension()))
    return _table(spark, sf_dir, "documents").select("doc_id", text.extension(name).alias("ext"))


@query(f"SELECT doc_id, coalesce({_SQL_LANGUAGE}, 'Other') AS language FROM documents")
def language_lookup(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(metrics.language(F.lower(_extension())), F.lit("Other")).alias("language"))


@query(f"SELECT {_SQL_LANGUAGE} AS language, sum({_LOC})::BIGINT AS loc FROM documents WHERE lang <> 'de' GROUP BY 1")
def language_loc_map(spark, sf_dir):
    return metrics.language_loc(metrics.file_lines(_files(spark, sf_dir))).drop("repo_id")


@query(f"SELECT sum(CASE WHEN lang <> 'de' THEN {_LOC} ELSE 0 END)::BIGINT AS total_loc FROM documents")
def total_loc_known_only(spark, sf_dir):
    return metrics.total_loc(metrics.file_lines(_files(spark, sf_dir))).drop("repo_id")


_BREAKDOWN = f"""SELECT './' || source || '/doc' || doc_id || '.' || {_SQL_EXT} AS file, {_LOC} AS loc, coalesce({_SQL_LANGUAGE}, 'Other') AS language FROM documents"""


@query(f"SELECT *, row_number() OVER (ORDER BY loc DESC, string_split(file, '/')) AS rank FROM ({_BREAKDOWN})")
def file_breakdown_rank(spark, sf_dir):
    return metrics.ranked(metrics.breakdown(metrics.file_lines(_files(spark, sf_dir)))).drop("repo_id").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT * FROM ({_BREAKDOWN}) ORDER BY loc DESC, string_split(file, '/') LIMIT 5")
def top5_files(spark, sf_dir):
    rows = metrics.breakdown(metrics.file_lines(_files(spark, sf_dir))).drop("repo_id")
    return rows.orderBy(F.desc("loc"), text.order_key(F.col("file"))).limit(5)


@query(
    f"""WITH l AS (SELECT {_SQL_LANGUAGE} AS language, sum({_LOC})::BIGINT AS loc FROM documents WHERE lang <> 'de' GROUP BY 1),
p AS (SELECT *, (loc * 100 // sum(loc) OVER ())::BIGINT AS pct FROM l)
SELECT language, loc, pct, repeat('█', pct * 28 // 100) || repeat('░', 28 - pct * 28 // 100) AS bar, row_number() OVER (ORDER BY loc DESC, language) AS rank FROM p"""
)
def language_share(spark, sf_dir):
    out = metrics.shares(metrics.language_loc(metrics.file_lines(_files(spark, sf_dir)))).drop("repo_id")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("loc"), "language")).cast("bigint"))


@query("SELECT source, format('{:,}', sum(n_chars)::BIGINT) AS chars, CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS plural FROM documents GROUP BY source")
def thousands_format(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source").agg(text.thousands(F.sum("n_chars")).alias("chars"), text.plural(F.count("*")).alias("plural"))


@query(
    """SELECT event_id, unnest(list_concat(json_keys(props), ['react'])) AS key FROM events WHERE event_id % 3 <> 0"""
)
def json_section_keys(spark, sf_dir):
    whole = F.concat(F.lit('{"dependencies": '), "props", F.lit(', "other": {"x": 1}, "devDependencies": {"react": "1"}, "peerDependencies": 3}'), F.when(F.col("event_id") % 3 == 0, " x").otherwise(""))
    keys = section_keys(("dependencies", "devDependencies", "peerDependencies"))
    return _table(spark, sf_dir, "events").select("event_id", F.explode(keys(whole)).alias("key"))


_WORD_RULES = {"ring": "Jewel", "widget": "Tool", "gear": "Tool", "bolt": "Tool"}, {"red": "Colour", "blue": "Colour", "small": "Size"}


@query(
    """SELECT p_partkey, kind, label FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS key FROM part)
JOIN (VALUES ('ring', 'framework', 'Jewel'), ('widget', 'framework', 'Tool'), ('gear', 'framework', 'Tool'), ('bolt', 'framework', 'Tool'),
      ('red', 'database', 'Colour'), ('blue', 'database', 'Colour'), ('small', 'database', 'Size')) AS r(key, kind, label) USING (key)"""
)
def exact_rule_labels(spark, sf_dir):
    keys = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo_id"), F.explode(F.split("p_name", " ")).alias("key"))
    return manifests.matched(keys, *_WORD_RULES).withColumnRenamed("repo_id", "p_partkey")


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


_SQL_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)"


@query(
    f"""SELECT doc_id, line_no, lower({_trimmed("regexp_extract(replace(' ' || line, '.', ' >= '), '^[^=><!\\[;]*')")}) AS name,
{_trimmed("string_split(' key = ' || line, '=')[1]")} AS key FROM {_SQL_LINES}"""
)
def requirement_name_parse(spark, sf_dir):
    given = F.replace(F.concat(F.lit(" "), "line"), F.lit("."), F.lit(" >= "))
    key = text.cargo_key(F.concat(F.lit(' "key" = '), "line"))
    return _doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), text.requirement_name(given).alias("name"), key.alias("key"))


@query(
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN '[' || turn % 4 || ']' END IGNORE NULLS)
OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations) WHERE role <> 'user' AND header IN ('[0]', '[1]')"""
)
def section_forward_fill(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn("line", F.when(F.col("role") == "user", F.concat(F.lit("["), (F.col("turn") % 4).cast("string"), F.lit("]"))).otherwise(F.col("text")))
    return manifests.in_sections(turns, ("conv_id",), ("[0]", "[1]"), F.col("role") == "user", "turn").select("conv_id", "turn")


@query(
    f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN contains(line, ' und ') THEN 'A' WHEN contains(line, ' the ') THEN 'B' WHEN contains(line, 'de') THEN 'C' END AS label FROM {_SQL_LINES}) WHERE label IS NOT NULL GROUP BY label"
)
def substring_first_rule(spark, sf_dir):
    label = manifests.first_rule(F.col("line"), {" und ": "A", " the ": "B", "de": "C"})
    return _doc_lines(spark, sf_dir).select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '  +  ') AS labels FROM part GROUP BY p_brand")
def label_set(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo_id"), F.lit("framework").alias("kind"), F.col("p_type").alias("label"))
    return manifests.label_sets(rows).select(F.col("repo_id").alias("p_brand"), F.array_join("frameworks", "  +  ").alias("labels"))


@query(
    f"""SELECT page_id, unnest(list_filter([CASE WHEN k = 0 THEN 'Docker' END, CASE WHEN k = 1 THEN 'Docker Compose' END, CASE WHEN k = 2 THEN 'GitHub Actions' END,
CASE WHEN k = 3 THEN 'Kubernetes' END, CASE WHEN k IN (4, 2) THEN 'Makefile' END], lambda x: x IS NOT NULL)) AS label FROM (SELECT page_id, page_id % 6 AS k FROM pages)"""
)
def path_rule_flags(spark, sf_dir):
    ends = ["/Dockerfile", "/docker-compose.yaml", "/.github/workflows/Makefile", "/k8s/a.yml", "/Makefile", "/k8s/a.json"]
    tail = F.element_at(F.array(*map(F.lit, ends)), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.concat("path", tail)
    return _paths(spark, sf_dir).select("page_id", F.explode(manifests.infrastructure_flags(path, text.file_name(path))).alias("label"))


@query(
    f"""SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND len(list_filter(string_split(chr(10) || '// the of' || chr(10) || '# de la' || chr(10) || text, chr(10)),
lambda x: (contains(x, 'the of') OR contains(x, 'de la')) AND NOT regexp_matches({_trimmed("x")}, '^(//|# |/\\*|\\*)') AND {_trimmed("x")} <> '#')) > 0"""
)
def usage_semi_join(spark, sf_dir):
    body = F.concat(F.lit("\n// the of\n# de la\n"), "text")
    return _table(spark, sf_dir, "documents").where(usage.uses(body, F.lower(_extension()), ("py", "rs"), ("the of", "de la"))).select("doc_id")


_SQL_SPECS = """(SELECT page_id, unnest(l) AS spec, unnest(range(0, len(l))) AS pos FROM (SELECT page_id,
list_concat(regexp_extract_all(html, '(?s)href=\\s*"([^"]*)"', 1), regexp_extract_all(html, '(?s)src=\\s*"([^"]*)"', 1)) AS l FROM pages))"""


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imports.specifiers(F.col("html"), ("href=", "src="))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "spec")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT page_id, pos, spec FROM {_SQL_SPECS}")
def specifier_extract(spark, sf_dir):
    return _specs(spark, sf_dir)


@query(f"SELECT page_id, spec, min(pos) AS pos FROM {_SQL_SPECS} GROUP BY ALL")
def specifier_ordered_distinct(spark, sf_dir):
    return _specs(spark, sf_dir).groupBy("page_id", "spec").agg(F.min("pos").alias("pos"))


@query(f"SELECT page_id, pos, '.' || spec AS spec FROM {_SQL_SPECS} WHERE pos % 2 = 0")
def relative_specifiers(spark, sf_dir):
    dotted = _specs(spark, sf_dir).withColumn("spec", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("."), "spec")).otherwise(F.concat(F.lit("x"), "spec")))
    return dotted.where(text.is_relative(F.col("spec")))


@query(f"SELECT page_id, '/' || rtrim({_HOST_PATH}, '/') || '/y' AS path, '../z' AS above FROM pages")
def path_normalize(spark, sf_dir):
    whole = text.normalize(F.concat(F.lit("/"), "path", F.lit("/./x//../y/.")))
    return _paths(spark, sf_dir).select("page_id", whole.alias("path"), text.normalize(F.lit("a/../../z")).alias("above"))


@query(
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)
SELECT 'o' || o_orderkey AS src, CASE WHEN o_custkey % 3 = 0 THEN 'c' || o_custkey WHEN (o_custkey + 1) % 3 = 0 AND o_custkey + 1 IN (FROM c) THEN 'c' || (o_custkey + 1) ELSE 'c0' END AS dst
FROM orders"""
)
def candidate_resolution(spark, sf_dir):
    places = _table(spark, sf_dir, "customer").select(F.lit("").alias("repo_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"))
    # keys that the SQL lets fail get a suffix that no customer has
    keys = [F.col("o_custkey") + k for k in (0, 1)]
    tries = F.array(*[F.concat(F.lit("c"), k.cast("string"), F.when(k % 3 == 0, "").otherwise("x")) for k in keys], F.lit("c0"))
    orders = _table(spark, sf_dir, "orders").select(F.lit("").alias("repo_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.lit(0).alias("ord"), tries.alias("candidates"))
    return imports.resolved(orders, places).select("src", "dst")


def _fk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from regions down to orders."""

    def name(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    region, nation, customer, orders = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    kinds = ((region, "r", "r_regionkey"), (nation, "n", "n_nationkey"), (customer, "c", "c_custkey"), (orders, "o", "o_orderkey"))
    nodes = kinds[0][0].select(name(kinds[0][1], kinds[0][2]).alias("node"))
    for t, kind, key in kinds[1:]:
        nodes = nodes.unionByName(t.select(name(kind, key).alias("node")))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    return nodes, edges.unionByName(orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))


_SQL_NODES = "SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders"
_SQL_EDGES = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"
_SQL_REACHED = f"WITH RECURSIVE e AS ({_SQL_EDGES}), reached AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_name = 'ASIA' UNION SELECT e.dst FROM reached JOIN e ON e.src = reached.node)"


@query(f"SELECT n.node, count(e.dst) AS links, coalesce(array_to_string(list_sort(list(e.dst) FILTER (e.dst IS NOT NULL)), ','), '') AS deps FROM ({_SQL_NODES}) n LEFT JOIN ({_SQL_EDGES}) e ON e.src = n.node GROUP BY n.node")
def fk_adjacency(spark, sf_dir):
    nodes, edges = _fk(spark, sf_dir)
    links = edges.select(F.lit("").alias("repo_id"), "src", "dst", F.col("dst").alias("ord"))
    found = imports.adjacency(nodes.select(F.lit("").alias("repo_id"), F.col("node").alias("path")), links)
    return found.select(F.col("path").alias("node"), F.size("deps").cast("bigint").alias("links"), F.array_join("deps", ",").alias("deps"))


def _asia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))


@query(f"{_SQL_REACHED} SELECT node FROM reached")
def fk_reachability(spark, sf_dir):
    nodes, edges = _fk(spark, sf_dir)
    return graph.reachable(nodes, edges, _asia(spark, sf_dir))


@query(f"{_SQL_REACHED} SELECT node FROM ({_SQL_NODES}) WHERE node NOT IN (SELECT node FROM reached)")
def dead_nodes(spark, sf_dir):
    nodes, edges = _fk(spark, sf_dir)
    return graph.dead(nodes, edges, _asia(spark, sf_dir))


@query(
    """WITH RECURSIVE u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT count(*) AS n FROM u), e AS (SELECT user_id AS src, (7 * user_id + 1) % n AS dst FROM u, n),
r AS (SELECT min(user_id) AS node FROM u UNION SELECT e.dst FROM r JOIN e ON e.src = r.node JOIN u ON u.user_id = e.dst) SELECT node FROM r"""
)
def cyclic_reachability(spark, sf_dir):
    users = _table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()
    n = users.count()
    edges = users.select(F.col("node").alias("src"), ((7 * F.col("node") + 1) % n).alias("dst"))
    return graph.reachable(users, edges, users.agg(F.min("node").alias("node")))


@query("SELECT DISTINCT label FROM (SELECT p_type AS label FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT s_name FROM supplier)")
def label_union(spark, sf_dir):
    parts = (_table(spark, sf_dir, t).select(F.col(c).alias("label")) for t, c in (("part", "p_type"), ("customer", "c_mktsegment"), ("supplier", "s_name")))
    out = next(parts)
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """Every combination of flags from the bits of customer keys, as label arrays."""
    key = F.col("c_custkey")

    def bit(k: int, label: str) -> Column:
        return F.when(F.floor(key / 2**k) % 2 == 1, label)

    frameworks, databases = F.array_compact(F.array(bit(0, "React"), bit(1, "Axum"), F.lit("Vite"))), F.array_compact(F.array(bit(2, "Redis")))
    languages, infrastructure = F.array_compact(F.array(bit(3, "Rust"), bit(4, "Go"), bit(5, "Python"), bit(6, "Solidity"))), F.array_compact(F.array(bit(7, "Docker")))
    return _table(spark, sf_dir, "customer"), infer.flags(frameworks, databases, languages, infrastructure)


_SQL_BITS = "(SELECT c_custkey, " + ", ".join(f"(c_custkey >> {k}) & 1 = 1 AS {n}" for k, n in enumerate(("fe", "be", "db", "rust", "go", "python", "solidity", "docker"))) + " FROM customer)"


@query(
    f"""SELECT c_custkey, CASE WHEN solidity THEN 'Blockchain / Smart-contract project' WHEN fe AND be AND db THEN 'Full-stack web application'
WHEN fe AND be THEN 'Full-stack web application (no detected database)' WHEN fe THEN 'Frontend web application' WHEN be AND db AND rust THEN 'Rust backend service'
WHEN be AND db AND go THEN 'Go backend service' WHEN be AND db AND python THEN 'Python backend service' WHEN be AND db THEN 'Backend API service'
WHEN be AND rust THEN 'Rust backend service' WHEN be THEN 'Backend API service' WHEN rust THEN 'Rust library / CLI tool' WHEN go THEN 'Go application'
WHEN python THEN 'Python application' WHEN docker THEN 'Containerised service' ELSE 'Unknown / General-purpose project' END AS project_type FROM {_SQL_BITS}"""
)
def project_type(spark, sf_dir):
    rows, given = _signals(spark, sf_dir)
    return rows.select("c_custkey", infer.project_type(given).alias("project_type"))


@query(
    f"""SELECT c_custkey, CASE WHEN fe AND be AND db THEN 'Frontend → API → Database' WHEN fe AND be THEN 'Frontend → API' WHEN be AND db THEN 'API → Database'
WHEN fe AND db THEN 'Frontend → Database' WHEN fe THEN 'Frontend only' WHEN be THEN 'API only' ELSE 'Monolithic / undetermined' END AS architecture FROM {_SQL_BITS}"""
)
def architecture(spark, sf_dir):
    rows, given = _signals(spark, sf_dir)
    return rows.select("c_custkey", infer.architecture(given).alias("architecture"))


@query(
    f"""SELECT page_id, CASE WHEN contains(m, '404') OR contains(m, '403') OR contains(m, 'not found') THEN 'Repository not found or access denied: ' || url
WHEN contains(m, 'timed out') OR contains(m, 'SSL') THEN 'Network error while cloning: ' || m WHEN contains(m, 'invalid') THEN 'Invalid repository URL: ' || url
ELSE 'Failed to clone repository: ' || m END AS said FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'timed out after ' || page_id WHEN 1 THEN 'invalid'
WHEN 2 THEN 'status ' || page_id ELSE 'SSL not found' END AS m FROM pages)"""
)
def clone_error_rules(spark, sf_dir):
    k = F.col("page_id")
    message = F.when(k % 4 == 0, F.concat(F.lit("timed out after "), k.cast("string"))).when(k % 4 == 1, "invalid").when(k % 4 == 2, F.concat(F.lit("status "), k.cast("string"))).otherwise("SSL not found")
    return _table(spark, sf_dir, "pages").select("page_id", text.clone_error(message, F.col("url")).alias("said"))


@query("SELECT greatest(4, coalesce(max(strlen(url)), 20))::BIGINT AS width, max(CASE WHEN url = '' THEN 1 ELSE 20 END)::BIGINT AS none FROM pages")
def longest_path(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.agg(text.longest_path(F.col("url")).alias("width")).crossJoin(pages.where("url is null").agg(text.longest_path(F.col("url")).alias("none")))


@query()
def tree_lines(spark, sf_dir):
    """Hosts and paths of pages as a tree of three levels (rows only: the prefixes need a walk)."""
    paths = _paths(spark, sf_dir).select(F.split(F.regexp_replace("path", "[?#].*$", ""), "/").alias("p"))
    every = paths.select(F.size("p").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("path"), (k < F.size("p")).alias("dir")))).alias("e"))
    entries = every.groupBy(F.lit("").alias("repo_id"), F.col("e.path").alias("path")).agg(F.max("e.dir").alias("is_dir"))
    return tree.tree_lines(entries, 3).drop("repo_id")


@query(
    f"""SELECT count(*) AS files, count(DISTINCT {_SQL_LANGUAGE}) AS languages, sum(CASE WHEN lang <> 'de' THEN {_LOC} ELSE 0 END)::BIGINT AS loc,
(SELECT count(*) FROM ({_SQL_EDGES})) AS links FROM documents"""
)
def summary_counts(spark, sf_dir):
    lines = metrics.file_lines(_files(spark, sf_dir))
    _, edges = _fk(spark, sf_dir)
    known = F.when(F.col("language").isNotNull(), F.col("loc"))
    return lines.agg(F.count("*").alias("files"), F.count_distinct("language").alias("languages"), F.sum(known).cast("bigint").alias("loc")).crossJoin(edges.agg(F.count("*").alias("links")))


@query()
def result_json(spark, sf_dir):
    """The whole analysis of the documents as files, as JSON (rows only: one row of nested values)."""
    return analyze.to_json(analyze.analyze(_files(spark, sf_dir)))
