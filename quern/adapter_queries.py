"""Registered queries of the domain adapters, of graph assembly and of runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import QUERIES, _read, query
from quern.functions.conditions import context_domain, generated_path
from quern.operators import adapters, assembly, runs

__all__ = ["QUERIES"]

_joined = lambda c: F.array_join(c, ",").alias(c)


# Files and paths.

_FILES = """SELECT CASE doc_id % 9 WHEN 0 THEN 'lib/g' || doc_id || '.g.dart' WHEN 1 THEN 'lib/.h' || doc_id WHEN 2 THEN '/home/.pub-cache/p/' || doc_id WHEN 3 THEN 'lib\\Thumbs.db' ELSE 'lib/f' || doc_id || '.txt' END AS path, text, doc_id FROM documents"""


@query(f"""WITH f AS ({_FILES}) SELECT 'duplicate:quern:' || substr(sha256(text), 1, 12) AS node_id, count(*) AS copies, CAST((count(*) - 1) * strlen(text) AS BIGINT) AS waste, string_agg(path, ',' ORDER BY path) AS paths,
    bool_or(contains(path, '/.pub-cache/')) AS protected FROM f WHERE doc_id % 9 NOT IN (0, 1, 3) GROUP BY text HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    k = F.col("doc_id")
    n = k.cast("string")
    path = F.when(k % 9 == 0, F.concat(F.lit("lib/g"), n, F.lit(".g.dart"))).when(k % 9 == 1, F.concat(F.lit("lib/.h"), n)).when(k % 9 == 2, F.concat(F.lit("/home/.pub-cache/p/"), n)).when(k % 9 == 3, F.lit("lib\\Thumbs.db")).otherwise(F.concat(F.lit("lib/f"), n, F.lit(".txt")))
    rows = adapters.duplicate_groups(_read(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")), "quern")
    return rows.select("node_id", "copies", "waste", _joined("paths"), "protected")


@query("""WITH p AS (SELECT p_partkey, ['lib/' || p_name || '.g.dart', 'BUILD/x', 'lib\\build\\y.dart', '.dart_tool/z', 'lib/rebuild/a.dart', 'lib/B.FREEZED.dart', 'lib/c.mocks.dart', 'lib/build'][p_partkey % 8 + 1] AS path FROM part)
    SELECT p_partkey, path, p_partkey % 8 NOT IN (4, 7) AS generated FROM p""")
def generated_paths(spark, sf_dir):
    path = F.element_at(F.array(F.concat(F.lit("lib/"), "p_name", F.lit(".g.dart")), *map(F.lit, ("BUILD/x", "lib\\build\\y.dart", ".dart_tool/z", "lib/rebuild/a.dart", "lib/B.FREEZED.dart", "lib/c.mocks.dart", "lib/build"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select("p_partkey", "path", generated_path(F.col("path")).alias("generated"))


@query("""WITH c AS (SELECT c_custkey, ['app:' || c_name, 'aux:test:' || c_name, 'aux:external:app:' || c_name, 'aux:other:' || c_name, 'app:', 'unattributed', 'aux:runtime:' || chr(7), c_name, 'aux:external:x'][c_custkey % 9 + 1] AS id FROM customer)
    SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'configuredTarget' WHEN 1 THEN 'auxiliary' WHEN 5 THEN 'unattributed' WHEN 8 THEN 'auxiliary' END AS domain FROM c""")
def context_domains(spark, sf_dir):
    name = F.col("c_name")
    ids = F.array(F.concat(F.lit("app:"), name), F.concat(F.lit("aux:test:"), name), F.concat(F.lit("aux:external:app:"), name), F.concat(F.lit("aux:other:"), name), F.lit("app:"), F.lit("unattributed"), F.lit("aux:runtime:\x07"), name, F.lit("aux:external:x"))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.element_at(ids, (F.col("c_custkey") % 9 + 1).cast("int")).alias("id")).select("c_custkey", context_domain(F.col("id")).alias("domain"))


# Navigation. Routes: page paths, some twice, and patterns over their first segments.

_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"
_ROUTES = f"""
    u AS (SELECT page_id, {_PATH} AS path FROM pages),
    r AS (SELECT 'r' || page_id AS node_id, path AS full_path, CASE WHEN page_id % 3 > 0 THEN 'n' || (page_id % 40) END AS name FROM u WHERE page_id % 4 = 0
        UNION ALL SELECT DISTINCT 'p' || string_split(path, '/')[2], '/' || string_split(path, '/')[2] || '/:page', NULL FROM u WHERE page_id % 3 = 0 UNION ALL SELECT 'any', '/:lang/:page', NULL UNION ALL SELECT 'deep', '/:lang/:page/more', 'deep'),
    known AS (SELECT node_id, full_path, string_split(full_path, '/') AS ps FROM r)"""


def _routes(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    u = _read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    k = F.col("page_id")
    own = u.where("page_id % 4 = 0").select(F.concat(F.lit("r"), k.cast("string")).alias("node_id"), F.col("path").alias("full_path"), F.when(k % 3 > 0, F.concat(F.lit("n"), (k % 40).cast("string"))).alias("name"))
    first = F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))
    wild = u.where("page_id % 3 = 0").where(F.size(F.split("path", "/")) > 1).select(F.concat(F.lit("p"), first).alias("node_id"), F.concat(F.lit("/"), first, F.lit("/:page")).alias("full_path"), F.lit(None).cast("string").alias("name")).distinct()
    more = spark.createDataFrame([("any", "/:lang/:page", None), ("deep", "/:lang/:page/more", "deep")], "node_id string, full_path string, name string")
    return u, own.unionByName(wild).unionByName(more)


@query(f"""WITH {_ROUTES} SELECT 'path' AS kind, full_path AS subject, 'route:quern:' AS affected_namespace, '' AS ids FROM r GROUP BY full_path HAVING count(*) > 1
    UNION ALL SELECT 'name', name, NULL, string_agg(node_id, ',' ORDER BY node_id) FROM r WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'known_' || b, k, NULL, min(node_id) FROM (SELECT 'path' AS b, full_path AS k, node_id FROM r UNION ALL SELECT 'name', name, node_id FROM r WHERE name IS NOT NULL) GROUP BY b, k HAVING count(*) = 1""")
def route_inventory(spark, sf_dir):
    known, stops = adapters.route_inventory(_routes(spark, sf_dir)[1], "route:quern:")
    kind = F.when(F.col("reason").contains("path"), "path").otherwise("name")
    stops = stops.select(kind.alias("kind"), "subject", "affected_namespace", F.array_join("affected_node_ids", ",").alias("ids"))
    return stops.unionByName(known.select(F.concat(F.lit("known_"), "by").alias("kind"), F.col("key").alias("subject"), F.lit(None).cast("string").alias("affected_namespace"), F.col("node_id").alias("ids")))


_ASKED = "CASE page_id % 5 WHEN 0 THEN path || '/' WHEN 1 THEN substr(path, 2) WHEN 2 THEN path || '?q=1' WHEN 3 THEN '/de//' ELSE path END"
_FITS = """len(ps) = len(ls) AND len(list_filter(range(1, len(ps) + 1), lambda i: NOT CASE WHEN starts_with(ps[i], ':') THEN ls[i] <> '' ELSE ps[i] = ls[i] END)) = 0"""
_FOUND_ROUTES = f"""
    asked AS (SELECT DISTINCT {_ASKED} AS location FROM u),
    q AS (SELECT location, CASE WHEN starts_with(location, '/') THEN CASE WHEN len(split_part(location, '?', 1)) > 1 THEN regexp_replace(split_part(location, '?', 1), '/$', '') ELSE split_part(location, '?', 1) END END AS path FROM asked),
    qs AS (SELECT location, path, string_split(path, '/') AS ls FROM q),
    same AS (SELECT location, list_sort(list(DISTINCT node_id)) AS ids FROM qs JOIN known ON full_path = path GROUP BY location),
    fits AS (SELECT location, list_sort(list(DISTINCT node_id)) AS ids FROM qs, known WHERE path IS NOT NULL AND contains(full_path, '/:') AND location NOT IN (SELECT location FROM same) AND {_FITS} GROUP BY location),
    cand AS (SELECT location, coalesce(same.ids, fits.ids, []) AS ids FROM qs LEFT JOIN same USING (location) LEFT JOIN fits USING (location))"""


def _asked(u):
    k, path = F.col("page_id"), F.col("path")
    return F.when(k % 5 == 0, F.concat(path, F.lit("/"))).when(k % 5 == 1, F.substring(path, 2, 1 << 30)).when(k % 5 == 2, F.concat(path, F.lit("?q=1"))).when(k % 5 == 3, F.lit("/de//")).otherwise(path)


@query(f"WITH {_ROUTES}, {_FOUND_ROUTES} SELECT location, CASE len(ids) WHEN 0 THEN 'namespace_blocker' WHEN 1 THEN 'edge' ELSE 'id_blocker' END AS outcome, array_to_string(ids, ',') AS targets FROM cand")
def path_navigations(spark, sf_dir):
    u, routes = _routes(spark, sf_dir)
    return adapters.path_navigations(u.select(_asked(u).alias("location")), routes).select("location", "outcome", _joined("targets"))


_PREFIX = "CASE page_id % 4 WHEN 0 THEN path || '?tab=' WHEN 1 THEN regexp_replace(path, '[^/]*$', '') WHEN 2 THEN path ELSE '' END"


@query(f"""WITH {_ROUTES}, asked AS (SELECT DISTINCT {_PREFIX} AS prefix FROM u),
    q AS (SELECT prefix, CASE WHEN contains(prefix, '?') THEN split_part(prefix, '?', 1) END AS before, CASE WHEN string_split(prefix, '/')[-1] = '' THEN string_split(prefix, '/')[:-2] ELSE string_split(prefix, '/') END AS ls FROM asked),
    same AS (SELECT prefix, list_sort(list(DISTINCT node_id)) AS ids FROM q JOIN known ON full_path = before WHERE starts_with(before, '/') GROUP BY prefix),
    fits AS (SELECT prefix, list_sort(list(DISTINCT node_id)) AS ids FROM q, known WHERE prefix <> '' AND prefix NOT IN (SELECT prefix FROM same) AND len(ls) > 0 AND len(ls) <= len(ps)
        AND len(list_filter(range(1, len(ls) + 1), lambda i: NOT (starts_with(ps[i], ':') OR ps[i] = ls[i]))) = 0 GROUP BY prefix)
    SELECT prefix, CASE WHEN same.ids IS NOT NULL THEN 'edge' WHEN fits.ids IS NOT NULL THEN 'id_blocker' ELSE 'namespace_blocker' END AS outcome, coalesce(array_to_string(coalesce(same.ids, fits.ids), ','), '') AS targets
    FROM q LEFT JOIN same USING (prefix) LEFT JOIN fits USING (prefix)""")
def prefix_outcomes(spark, sf_dir):
    u, routes = _routes(spark, sf_dir)
    k, path = F.col("page_id"), F.col("path")
    asked = F.when(k % 4 == 0, F.concat(path, F.lit("?tab="))).when(k % 4 == 1, F.regexp_replace(path, "[^/]*$", "")).when(k % 4 == 2, path).otherwise(F.lit(""))
    return adapters.prefix_outcomes(u.select(asked.alias("prefix")), routes).select("prefix", "outcome", _joined("targets"))


@query(f"""WITH {_ROUTES}, {_FOUND_ROUTES}, names AS (SELECT name, min(node_id) AS node_id FROM r WHERE name IS NOT NULL GROUP BY name HAVING count(*) = 1),
    d AS (SELECT page_id AS nav_id, page_id % 2 = 0 AS by_name, CASE WHEN page_id % 7 > 0 THEN CASE WHEN page_id % 2 = 0 THEN 'n' || (page_id % 45) ELSE {_ASKED} END END AS value FROM u),
    t AS (SELECT nav_id, CASE WHEN by_name THEN CASE WHEN names.node_id IS NOT NULL THEN [names.node_id] ELSE [] END ELSE coalesce(cand.ids, []) END AS ids FROM d LEFT JOIN names ON by_name AND names.name = value LEFT JOIN cand ON NOT by_name AND cand.location = value)
    SELECT nav_id, CASE WHEN len(ids) > 0 THEN 'id_blocker' ELSE 'namespace_blocker' END AS outcome, array_to_string(ids, ',') AS targets FROM t""")
def dynamic_navigations(spark, sf_dir):
    u, routes = _routes(spark, sf_dir)
    k = F.col("page_id")
    value = F.when(k % 7 > 0, F.when(k % 2 == 0, F.concat(F.lit("n"), (k % 45).cast("string"))).otherwise(_asked(u)))
    known = adapters.route_inventory(routes, "route:quern:")[0].where("by = 'name'").select(F.col("key").alias("name"), "node_id")
    asked = u.select(k.alias("nav_id"), (k % 2 == 0).alias("by_name"), value.alias("value"))
    return adapters.dynamic_navigations(asked, routes, known).select("nav_id", "outcome", _joined("targets"))


# Registrations: parts with small sizes register, all parts ask.

_REGISTRY = """reg AS (SELECT 'd' || p_partkey AS id, p_brand AS type, CASE WHEN p_size > 2 THEN p_type END AS name, p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS uncertain FROM part WHERE p_size <= 6)"""


def _registry(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = part.where("p_size <= 6").select(F.concat(F.lit("d"), k.cast("string")).alias("id"), F.col("p_brand").alias("type"), F.when(F.col("p_size") > 2, F.col("p_type")).alias("name"), (k % 17 == 0).alias("dynamic_name"), F.when(k % 19 == 0, "pushed").otherwise("base").alias("scope"))
    return part, adapters.registration_inventory(rows, part.where("p_size < 0"))


@query("SELECT 'd' || p_partkey AS id, p_brand AS type, true AS uncertain FROM part WHERE p_size <= 6")
def registration_mutations(spark, sf_dir):
    """The inventory where parts of one size change the container while the program runs: nothing in it is certain."""
    part = _read(spark, sf_dir, "part")
    rows = part.where("p_size <= 6").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("dynamic_name"), F.lit("base").alias("scope"))
    return adapters.registration_inventory(rows, part.where("p_size = 7")).select("id", "type", "uncertain")


@query(f"WITH {_REGISTRY} SELECT id, type, name, uncertain FROM reg")
def registration_inventory(spark, sf_dir):
    return _registry(spark, sf_dir)[1]


@query(f"""WITH {_REGISTRY}, q AS (SELECT p_partkey AS request_id, p_brand AS type, CASE WHEN p_size % 3 > 0 THEN p_type END AS name, p_partkey % 23 = 0 AS dynamic_name FROM part),
    n AS (SELECT q.*, (SELECT count(*) FROM reg WHERE reg.type = q.type AND reg.name IS NOT DISTINCT FROM q.name AND NOT uncertain) AS fit, (SELECT count(*) FROM reg WHERE reg.type = q.type) AS held, (SELECT count(*) FROM reg WHERE reg.type = q.type AND uncertain) AS doubt,
        (SELECT min(id) FROM reg WHERE reg.type = q.type AND reg.name IS NOT DISTINCT FROM q.name AND NOT uncertain) AS first_id FROM q)
    SELECT request_id, CASE WHEN dynamic_name THEN 0 ELSE fit END AS candidates, CASE WHEN dynamic_name AND held > 0 THEN 'type_blocker' WHEN dynamic_name THEN 'namespace_blocker' WHEN doubt > 0 THEN 'id_blocker' WHEN fit = 0 THEN 'namespace_blocker' WHEN fit = 1 THEN 'edge' ELSE 'id_blocker' END AS outcome,
        CASE WHEN NOT dynamic_name AND doubt = 0 AND fit = 1 THEN first_id END AS target, CASE WHEN dynamic_name THEN held WHEN doubt > 0 THEN fit + doubt WHEN fit > 1 THEN fit ELSE 0 END AS affected FROM n""")
def registration_lookups(spark, sf_dir):
    part, reg = _registry(spark, sf_dir)
    asked = part.select(F.col("p_partkey").alias("request_id"), F.col("p_brand").alias("type"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("name"), (F.col("p_partkey") % 23 == 0).alias("dynamic_name"))
    return adapters.registration_lookups(asked, reg)


@query(f"""WITH {_REGISTRY}, q AS (SELECT 'd' || p_partkey AS id, 'Brand#' || (p_partkey % 25 + 1) AS type, p_type AS name FROM part WHERE p_size <= 3),
    s AS (SELECT q.id, q.type, q.name, list_sort(list(DISTINCT reg.id) FILTER (reg.id IS NOT NULL)) AS sure FROM q LEFT JOIN reg ON reg.type = q.type AND reg.name IS NOT DISTINCT FROM q.name AND NOT uncertain GROUP BY ALL),
    d AS (SELECT type, list(id) AS doubt FROM reg WHERE uncertain GROUP BY type), x AS (SELECT id, type, name, coalesce(sure, []) AS sure, coalesce(doubt, []) AS doubt FROM s LEFT JOIN d USING (type))
    SELECT id, type, name, CASE WHEN len(sure) = 1 AND len(doubt) = 0 THEN 'edge' ELSE 'id_blocker' END AS outcome, array_to_string(CASE WHEN len(sure) = 1 AND len(doubt) = 0 THEN sure ELSE list_sort(list_distinct([id] || sure || doubt)) END, ',') AS targets FROM x""")
def registration_dependencies(spark, sf_dir):
    part, reg = _registry(spark, sf_dir)
    needs = part.where("p_size <= 3").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")).alias("type"), F.col("p_type").alias("name"))
    return adapters.registration_dependencies(needs, reg).select("id", "type", "name", "outcome", _joined("targets"))


# Messages: parts are template keys, suppliers' nations other locales.

_MESSAGES = """
    t AS (SELECT 'app_en.arb' AS path, 'en' AS locale, true AS is_template, 'k' || p_partkey AS key, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_name || ' {count} of { name }' END AS message FROM part WHERE p_partkey < 500),
    o AS (SELECT CASE l_linestatus WHEN 'F' THEN 'app_' ELSE 'more_' END || 'l' || (l_suppkey % 5) || '.arb' AS path, 'l' || (l_suppkey % 5) AS locale, false AS is_template, 'k' || l_partkey AS key,
        CASE WHEN min(l_linenumber) % 2 = 0 THEN '{name} x' ELSE '{name, plural, other{y}} {count}' END AS message FROM lineitem WHERE l_partkey < 600 AND l_suppkey % 10 < 5 AND l_quantity < 20 GROUP BY 1, 2, 3, 4),
    m AS (SELECT * FROM t UNION ALL SELECT * FROM o), first AS (SELECT locale, min(path) AS path FROM o GROUP BY locale), good AS (SELECT o.* FROM o JOIN first USING (locale, path))"""
_NAMES = r"list_sort(list_distinct(regexp_extract_all({}, '\{{\s*([A-Za-z_]\w*)\s*(?:\}}|,)', 1)))"


def _messages(spark, sf_dir):
    part, line = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    text = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" {count} of { name }")))
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("key")
    t = part.where("p_partkey < 500").select(F.lit("app_en.arb").alias("path"), F.lit("en").alias("locale"), F.lit(True).alias("is_template"), key("p_partkey"), text.alias("message"))
    locale = F.concat(F.lit("l"), (F.col("l_suppkey") % 5).cast("string"))
    o = line.where("l_partkey < 600 AND l_suppkey % 10 < 5 AND l_quantity < 20")
    o = o.groupBy(F.concat(F.when(F.col("l_linestatus") == "F", "app_").otherwise("more_"), locale, F.lit(".arb")).alias("path"), locale.alias("locale"), F.lit(False).alias("is_template"), key("l_partkey"))
    o = o.agg(F.when(F.min("l_linenumber") % 2 == 0, "{name} x").otherwise("{name, plural, other{y}} {count}").alias("message"))
    return t.unionByName(o)


@query(f"""WITH {_MESSAGES} SELECT t.key, CASE WHEN hash_free OR len({_NAMES.format("t.message")}) > 0 THEN 'method' ELSE 'getter' END AS member,
    (SELECT coalesce(string_agg(locale, ',' ORDER BY locale), '') FROM first WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.locale = first.locale AND good.key = t.key)) AS missing
    FROM (SELECT *, CAST(substr(key, 2) AS BIGINT) % 6 = 0 AS hash_free FROM t) t""")
def message_inventory(spark, sf_dir):
    m = _messages(spark, sf_dir)
    declared = m.where("is_template").select("key", F.when(F.substring("key", 2, 20).cast("bigint") % 6 == 0, F.array(F.lit("count"))).otherwise(F.array().cast("array<string>")).alias("names"))
    return adapters.message_inventory(m, declared)


@query(f"""WITH {_MESSAGES} SELECT DISTINCT 'duplicate_locale' AS kind, o.locale, o.path, NULL AS key FROM o JOIN first ON first.locale = o.locale WHERE o.path <> first.path
    UNION ALL SELECT 'locale_only_key', locale, path, key FROM good WHERE key NOT IN (SELECT key FROM t)
    UNION ALL SELECT 'placeholders_differ', g.locale, g.path, g.key FROM good g JOIN t USING (key) WHERE {_NAMES.format("g.message")} <> {_NAMES.format("t.message")}""")
def message_issues(spark, sf_dir):
    return adapters.message_issues(_messages(spark, sf_dir))


_STEMS = "['app_en', 'intl_zz', 'app_zh_Hant_TW', 'en', 'my_app_pt_BR', 'app_EN-us', 'strings', 'x_sr_latn', 'app_en_XYZ', 'fil_es_419']"


@query(f"""WITH f AS (SELECT p_partkey, {_STEMS}[p_partkey % 10 + 1] AS stem, CASE WHEN p_size % 3 = 0 THEN 'en' END AS declared FROM part),
    n AS (SELECT *, ['en', NULL, 'zh_Hant_TW', 'en', 'pt_BR', 'en_US', NULL, 'sr_Latn', NULL, 'es_419'][p_partkey % 10 + 1] AS named FROM f)
    SELECT p_partkey, CASE WHEN declared IS NULL THEN named WHEN named IS NULL OR named = declared THEN declared END AS locale,
        CASE WHEN declared IS NULL AND named IS NULL THEN 'ARB filename locale could not be determined safely' WHEN declared IS NOT NULL AND named IS NOT NULL AND named <> declared THEN 'ARB filename locale ' || named || ' differs from @@locale ' || declared END AS reason FROM n""")
def file_locales(spark, sf_dir):
    stems = F.array(*map(F.lit, ("app_en", "intl_zz", "app_zh_Hant_TW", "en", "my_app_pt_BR", "app_EN-us", "strings", "x_sr_latn", "app_en_XYZ", "fil_es_419")))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.element_at(stems, (F.col("p_partkey") % 10 + 1).cast("int")).alias("stem"), F.when(F.col("p_size") % 3 == 0, "en").alias("declared"))
    locale, reason = adapters.document_locale(F.col("stem"), F.col("declared"))
    return rows.select("p_partkey", locale.alias("locale"), reason.alias("reason"))


@query("""WITH k AS (SELECT 'k' || p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'getter' ELSE 'method' END AS member FROM part),
    e AS (SELECT 'k' || l_partkey AS name, CASE WHEN l_returnflag = 'N' THEN 'getter' ELSE 'method' END AS shape, l_discount < 0.09 AS here FROM lineitem WHERE l_quantity > 45),
    h AS (SELECT key, any_value(member) AS member, count(*) FILTER (shape = member) AS fit, count(*) FILTER (shape <> member) AS wrong, bool_and(here) AS here FROM k LEFT JOIN e ON name = key GROUP BY key)
    SELECT key, CASE WHEN fit = 0 THEN 'missing' WHEN fit > 1 OR wrong > 0 THEN 'ambiguous' WHEN NOT here THEN 'foreign' ELSE 'member' END AS outcome FROM h""")
def message_members(spark, sf_dir):
    keys = _read(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") % 2 == 0, "getter").otherwise("method").alias("member"))
    members = _read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_returnflag") == "N", "getter").otherwise("method").alias("shape"), (F.col("l_discount") < 0.09).alias("declared_here"))
    return adapters.message_members(keys, members)


@query("""WITH r AS (SELECT DISTINCT 'aux:test:' || (o_custkey % 7) AS context, o_orderkey % 300 AS path FROM orders), p AS (SELECT * FROM r WHERE path % 3 > 0), i AS (SELECT DISTINCT 'aux:test:' || (user_id % 4) AS context, event_type AS code FROM events)
    SELECT DISTINCT l_orderkey AS reference_id, code || ' [' || context || ']: unsure' AS reason FROM lineitem JOIN r ON path = l_partkey % 300 JOIN i USING (context) WHERE l_linenumber = 7 AND (context, path) NOT IN (SELECT (context, path) FROM p)""")
def auxiliary_issue_blockers(spark, sf_dir):
    held = _read(spark, sf_dir, "orders").select(F.concat(F.lit("aux:test:"), (F.col("o_custkey") % 7).cast("string")).alias("context"), (F.col("o_orderkey") % 300).alias("path")).distinct()
    issues = _read(spark, sf_dir, "events").select(F.concat(F.lit("aux:test:"), (F.col("user_id") % 4).cast("string")).alias("context"), F.col("event_type").alias("code"), F.lit("unsure").alias("reason")).distinct()
    uses = _read(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("reference_id"), (F.col("l_partkey") % 300).alias("path"))
    return adapters.auxiliary_issue_blockers(uses, held, held.where("path % 3 > 0"), issues)


@query("""WITH a AS (SELECT DISTINCT 'icons/' || replace(p_name, ' ', '_') AS key FROM part WHERE p_size > 25),
    u AS (SELECT p_partkey AS use_id, ['SvgPicture', 'Text', 'MyAssetLoader', 'RivePlayer', NULL][p_partkey % 5 + 1] AS owner, CASE WHEN p_partkey % 11 = 0 THEN 'loadAsset' ELSE 'show' END AS method, p_partkey % 13 > 0 AS complete, 'icons/' || replace(p_name, ' ', '_') AS value, p_size FROM part),
    x AS (SELECT *, CASE WHEN p_size <= 10 AND value IN (SELECT key FROM a) THEN 'n:' || value END AS hit, coalesce(regexp_matches(lower(owner), 'asset|svg|lottie|rive|video|audio'), false) OR contains(lower(method), 'asset') AS hint FROM u)
    SELECT use_id, CASE WHEN NOT complete THEN 'namespace_blocker' WHEN hit IS NOT NULL THEN 'id_blocker' ELSE 'namespace_blocker' END AS outcome, CASE WHEN complete THEN coalesce(hit, '') ELSE '' END AS targets FROM x WHERE NOT complete OR hit IS NOT NULL OR hint""")
def unrecognised_consumers(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    value = F.concat(F.lit("icons/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    owner = F.element_at(F.array(*map(F.lit, ("SvgPicture", "Text", "MyAssetLoader", "RivePlayer", None))), (F.col("p_partkey") % 5 + 1).cast("int"))
    uses = part.select(F.col("p_partkey").alias("use_id"), owner.alias("owner"), F.when(F.col("p_partkey") % 11 == 0, "loadAsset").otherwise("show").alias("method"), (F.col("p_partkey") % 13 > 0).alias("complete"), F.when(F.col("p_size") <= 10, F.array(value, F.lit("none"))).otherwise(F.array(F.lit("none"))).alias("possible"))
    assets = part.where("p_size > 25").select(value.alias("key"), F.concat(F.lit("n:"), value).alias("node_id")).distinct()
    return adapters.unrecognised_consumers(uses, assets, "asset:quern/").select("use_id", "outcome", _joined("targets"))


# Assembly.

_LIBRARIES = """lib AS (SELECT 'lib/' || p_partkey || '.dart' AS path, 'dart:quern/lib/' || p_partkey || '.dart' AS node_id, ['selected', 'external', 'selected', 'unknown'][p_size % 4 + 1] AS owner, p_partkey % 3 = 0 AS has_main, p_partkey % 6 = 0 AS is_test, p_partkey % 2 = 0 AS environment_complete FROM part),
    tgt AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'app:' ELSE '' END || n_name AS name, 'lib/' || (n_nationkey * 3) || '.dart' AS entrypoint FROM nation), pub AS (SELECT 'lib/' || s_suppkey || '.dart' AS path FROM supplier)"""


def _libraries(spark, sf_dir):
    k = F.col("p_partkey")
    file = lambda c: F.concat(F.lit("lib/"), c.cast("string"), F.lit(".dart"))
    owner = F.element_at(F.array(*map(F.lit, ("selected", "external", "selected", "unknown"))), F.col("p_size") % 4 + 1)
    lib = _read(spark, sf_dir, "part").select(file(k).alias("path"), F.concat(F.lit("dart:quern/"), file(k)).alias("node_id"), owner.alias("owner"), (k % 3 == 0).alias("has_main"), (k % 6 == 0).alias("is_test"), (k % 2 == 0).alias("environment_complete"))
    tgt = _read(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "app:").otherwise(""), "n_name").alias("name"), file(F.col("n_nationkey") * 3).alias("entrypoint"))
    return assembly.context_facts(lib, tgt, _read(spark, sf_dir, "supplier").select(file(F.col("s_suppkey")).alias("path")))


@query(f"""WITH {_LIBRARIES}, e AS (SELECT CASE WHEN starts_with(name, 'app:') THEN name ELSE 'app:' || name END AS context, node_id FROM tgt JOIN lib ON path = entrypoint WHERE owner = 'selected'),
    own AS (SELECT * FROM lib WHERE owner = 'selected')
    SELECT DISTINCT context, node_id, 'contains main() entry point' AS reason FROM e UNION SELECT context, node_id || '#main', 'main() entry point' FROM e
    UNION SELECT 'aux:test:' || path, node_id, 'test entry library' FROM own WHERE is_test AND has_main UNION SELECT 'aux:external:' || path, node_id, 'public package entry library imported by external consumers' FROM own WHERE path IN (SELECT path FROM pub)
    UNION SELECT 'aux:runtime:' || path, node_id, 'unclassified main() entry point' FROM own WHERE has_main AND NOT is_test AND path NOT IN (SELECT entrypoint FROM tgt)""")
def context_roots(spark, sf_dir):
    return _libraries(spark, sf_dir)[1]


@query(f"""WITH {_LIBRARIES} SELECT CASE WHEN starts_with(name, 'app:') THEN name ELSE 'app:' || name END AS id, 'configured' AS domain, true AS environment_complete FROM tgt
    UNION SELECT 'aux:test:' || path, 'auxiliary', environment_complete FROM lib WHERE owner = 'selected' AND is_test AND has_main UNION SELECT 'aux:external:' || path, 'auxiliary', environment_complete FROM lib WHERE owner = 'selected' AND path IN (SELECT path FROM pub)
    UNION SELECT 'aux:runtime:' || path, 'auxiliary', environment_complete FROM lib WHERE owner = 'selected' AND has_main AND NOT is_test AND path NOT IN (SELECT entrypoint FROM tgt)""")
def discovered_contexts(spark, sf_dir):
    return _libraries(spark, sf_dir)[0].select("id", "domain", "environment_complete").distinct()


@query(f"""WITH {_LIBRARIES} SELECT entrypoint AS path, CASE WHEN owner = 'external' THEN 'dart-root-external-package' ELSE 'dart-root-ownership-unknown' END AS code FROM tgt LEFT JOIN lib ON path = entrypoint WHERE coalesce(owner, '') <> 'selected'""")
def context_issues(spark, sf_dir):
    return _libraries(spark, sf_dir)[2]


@query("""WITH c AS (SELECT 'app:' || n_name AS id FROM nation), a AS (SELECT 'aux:test:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'aux:test:1' UNION ALL SELECT 'aux:bad:1'), o AS (SELECT 'app:' || n_name AS id FROM nation WHERE n_nationkey > 3 UNION ALL SELECT 'aux:test:' || s_suppkey FROM supplier UNION ALL SELECT 'app:late'),
    e AS (SELECT id, count(*) AS n FROM (SELECT id FROM c UNION ALL SELECT id FROM a) GROUP BY id)
    SELECT id, 'missing' AS problem FROM e WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT DISTINCT id, 'unexpected' FROM o WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT id, 'duplicate' FROM e WHERE n > 1 UNION ALL SELECT id, 'not canonical' FROM e WHERE id = 'aux:bad:1'""")
def context_inventory(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").select(F.concat(F.lit("app:"), "n_name").alias("id"), "n_nationkey")
    aux = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("aux:test:"), F.col("s_suppkey").cast("string")).alias("id"))
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    seen = nation.where("n_nationkey > 3").select("id").unionByName(aux).unionByName(one("app:late"))
    return assembly.inventory_differences(nation, aux.unionByName(one("aux:test:1", "aux:bad:1")), seen)


@query("""WITH a AS (SELECT 'img/' || p_partkey || '.png' AS key, p_size AS size_bytes, p_partkey % 5 = 0 AS transformers, p_partkey % 2 = 0 AS by_directory FROM part),
    v AS (SELECT DISTINCT 'img/' || l_partkey || '.png' AS key, l_linenumber AS ratio, l_linenumber * 10 AS size_bytes FROM lineitem WHERE l_linenumber IN (2, 3) AND l_quantity > 40 UNION SELECT 'img/none.png', 2, 1)
    SELECT 'asset:quern/' || key AS id, 'asset' AS kind, CAST(size_bytes + coalesce((SELECT sum(v.size_bytes) FROM v WHERE v.key = a.key), 0) AS BIGINT) AS size_bytes, by_directory AND NOT transformers AS removal_supported, (SELECT count(*) FROM v WHERE v.key = a.key) AS variants FROM a
    UNION ALL SELECT 'asset:quern/img/' || ratio || '.0x/' || substr(key, 5), 'assetVariant', size_bytes, NULL, 0 FROM v WHERE key IN (SELECT key FROM a)""")
def asset_nodes(spark, sf_dir):
    return _assets(spark, sf_dir)[0].select("id", "kind", F.col("size_bytes").cast("bigint").alias("size_bytes"), "removal_supported", "variants")


def _assets(spark, sf_dir):
    key = lambda c: F.concat(F.lit("img/"), F.col(c).cast("string"), F.lit(".png")).alias("key")
    line = _read(spark, sf_dir, "lineitem")
    a = _read(spark, sf_dir, "part").select(key("p_partkey"), F.col("p_size").alias("size_bytes"), (F.col("p_partkey") % 5 == 0).alias("transformers"), (F.col("p_partkey") % 2 == 0).alias("by_directory"))
    v = line.where("l_linenumber IN (2, 3) AND l_quantity > 40").select(key("l_partkey"), F.col("l_linenumber").alias("ratio"), (F.col("l_linenumber") * 10).alias("size_bytes")).distinct()
    v = v.unionByName(spark.createDataFrame([("img/none.png", 2, 1)], "key string, ratio int, size_bytes int"))
    owned = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.concat(F.lit("p"), (F.col("s_suppkey") % 3).cast("string")).alias("package"))
    uses = line.where("l_linenumber = 1").select(F.concat(F.lit("dart:"), F.col("l_suppkey").cast("string")).alias("caller"), F.concat(F.when(F.col("l_tax") > 0.05, "none/").otherwise("img/"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("key"), F.lit(True).alias("exact"))
    return assembly.asset_graph(a, v, owned, uses, "quern")


@query("""WITH v AS (SELECT DISTINCT l_partkey, l_linenumber AS ratio FROM lineitem WHERE l_linenumber IN (2, 3) AND l_quantity > 40)
    SELECT 'asset:quern/img/' || l_partkey || '.png' AS src, 'asset:quern/img/' || ratio || '.0x/' || l_partkey || '.png' AS dst, 'bundlesVariant' AS kind FROM v
    UNION ALL SELECT DISTINCT 'dart:' || l_suppkey, 'asset:quern/img/' || l_partkey || '.png', 'loadsAsset' FROM lineitem WHERE l_linenumber = 1 AND l_tax <= 0.05""")
def asset_edges(spark, sf_dir):
    return _assets(spark, sf_dir)[1].select("src", "dst", "kind")


@query("SELECT 'asset:p' || (s_suppkey % 3) || '/' || s_name AS id, 'owned by package p' || (s_suppkey % 3) AS reason FROM supplier")
def asset_protections(spark, sf_dir):
    return _assets(spark, sf_dir)[2]


_DIRECTIVES = "d AS (SELECT DISTINCT 'l' || l_suppkey AS src, 'l' || (l_partkey % 400) AS dst, 'imports' AS kind, bool_and(l_returnflag <> 'R') AS exact FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), o AS (SELECT 'l' || p_partkey AS id, ['selected', 'external', 'unknown'][p_size % 3 + 1] AS owner, 'dep' || (p_size % 4) AS dependency FROM part WHERE p_partkey < 380)"


@query(f"""WITH {_DIRECTIVES} SELECT DISTINCT src, CASE owner WHEN 'selected' THEN dst ELSE 'dart-package:quern/' || dependency END AS dst, owner = 'external' OR exact AS exact, 'edge' AS kind FROM d JOIN o ON id = dst WHERE owner <> 'unknown'
    UNION ALL SELECT src, dst, false, 'blocker' FROM d LEFT JOIN o ON id = dst WHERE coalesce(owner, 'unknown') = 'unknown'""")
def execution_edges(spark, sf_dir):
    line, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    d = line.where("l_linenumber <= 2").groupBy(F.concat(F.lit("l"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("l"), (F.col("l_partkey") % 400).cast("string")).alias("dst")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("exact"))
    owner = F.element_at(F.array(*map(F.lit, ("selected", "external", "unknown"))), F.col("p_size") % 3 + 1)
    o = part.where("p_partkey < 380").select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("id"), owner.alias("owner"), F.concat(F.lit("dep"), (F.col("p_size") % 4).cast("string")).alias("dependency"))
    edges, stops = assembly.execution_edges(d.withColumns({"kind": F.lit("imports"), "condition_key": F.lit("")}), o, "dart:quern/", "quern")
    held = stops.select(F.col("source_node_id").alias("src"), F.substring_index("reason", " ", -1).alias("dst"), F.lit(False).alias("exact"), F.lit("blocker").alias("kind"))
    return edges.select("src", "dst", "exact", F.lit("edge").alias("kind")).unionByName(held)


_REACH = "RECURSIVE s AS (SELECT 'c' || n_regionkey AS context, n_nationkey AS id FROM nation WHERE n_nationkey % 6 = 0), e AS (SELECT 'c' || r_regionkey AS context, n_nationkey AS src, (n_nationkey * 7 + r_regionkey) % 25 AS dst, (n_nationkey + r_regionkey) % 5 > 0 AS exact FROM nation, region WHERE n_nationkey % 4 > 0), reach AS (SELECT context, id FROM s UNION SELECT r.context, e.dst FROM reach r JOIN e ON e.context = r.context AND e.src = r.id)"


def _reach(spark, sf_dir):
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    text = lambda c: c.cast("string")
    seeds = nation.where("n_nationkey % 6 = 0").select(F.concat(F.lit("c"), text(F.col("n_regionkey"))).alias("context"), text(n).alias("id"))
    ways = nation.where("n_nationkey % 4 > 0").join(F.broadcast(region)).select(F.concat(F.lit("c"), text(r)).alias("context"), text(n).alias("src"), text((n * 7 + r) % 25).alias("dst"), ((n + r) % 5 > 0).alias("exact"))  # 5 regions
    units = _read(spark, sf_dir, "part").where("p_size < 20").select(text(F.col("p_size")).alias("library"), F.concat(F.lit("u"), text(F.col("p_partkey") % 30)).alias("path")).distinct()
    return assembly.library_reach(seeds, ways, units)


@query(f"""WITH {_REACH}, u AS (SELECT DISTINCT p_size AS library, 'u' || (p_partkey % 30) AS path FROM part WHERE p_size < 20)
    SELECT DISTINCT context, path AS subject, 'unit' AS reason FROM reach JOIN u ON library = id UNION ALL SELECT context, CAST(id AS VARCHAR), 'library has no units' FROM reach WHERE id NOT IN (SELECT library FROM u)
    UNION ALL SELECT DISTINCT e.context, e.src || ' -> ' || e.dst, 'directive is not exact' FROM e JOIN reach r ON r.context = e.context AND r.id = e.src WHERE NOT e.exact""")
def library_reach(spark, sf_dir):
    units, issues, _ = _reach(spark, sf_dir)
    return units.select("context", F.col("path").alias("subject"), F.lit("unit").alias("reason")).unionByName(issues)


@query("""WITH RECURSIVE f AS (SELECT 'f' || p_partkey AS id, ['external', 'external', 'selected', 'unknown'][p_size % 4 + 1] AS owner, p_partkey % 6 > 0 AS readable FROM part WHERE p_partkey < 500), i AS (SELECT DISTINCT 'f' || (l_partkey % 500) AS src, 'f' || (l_suppkey * 13 % 520) AS dst, l_linenumber = 3 AS conditional FROM lineitem WHERE l_linenumber IN (1, 3) AND l_quantity > 25),
    t AS (SELECT id FROM f WHERE owner = 'external' AND readable), w AS (SELECT 'f' || (s_suppkey * 5) AS id FROM supplier WHERE s_suppkey < 20 UNION SELECT i.dst FROM w JOIN i ON i.src = w.id WHERE NOT conditional AND i.src IN (SELECT id FROM t))
    SELECT id, 'seen' AS reason FROM w UNION ALL SELECT w.id, CASE WHEN owner IS NULL OR owner = 'unknown' THEN 'unknown owner' ELSE 'not readable' END FROM w LEFT JOIN f USING (id) WHERE owner IS NULL OR owner = 'unknown' OR (owner = 'external' AND NOT readable)
    UNION ALL SELECT DISTINCT src, 'conditional import' FROM i WHERE conditional AND src IN (SELECT id FROM w) AND src IN (SELECT id FROM t)""")
def external_walk(spark, sf_dir):
    f = lambda c: F.concat(F.lit("f"), c.cast("string"))
    k = F.col("p_partkey")
    files = _read(spark, sf_dir, "part").where("p_partkey < 500").select(f(k).alias("id"), F.element_at(F.array(*map(F.lit, ("external", "external", "selected", "unknown"))), F.col("p_size") % 4 + 1).alias("owner"), (k % 6 > 0).alias("readable"))
    imports = _read(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 3) AND l_quantity > 25").select(f(F.col("l_partkey") % 500).alias("src"), f(F.col("l_suppkey") * 13 % 520).alias("dst"), (F.col("l_linenumber") == 3).alias("conditional")).distinct()
    seen, issues = assembly.external_walk(_read(spark, sf_dir, "supplier").where("s_suppkey < 20").select(f(F.col("s_suppkey") * 5).alias("id")), imports, files)
    return seen.select("id", F.lit("seen").alias("reason")).unionByName(issues)


@query("""WITH RECURSIVE d AS (SELECT n_nationkey AS element, n_name AS key FROM nation WHERE n_nationkey % 8 = 0), w AS (SELECT n_nationkey AS element, (n_nationkey + 3) % 25 AS target FROM nation WHERE n_nationkey % 5 > 0), a AS (SELECT element, key FROM d UNION SELECT w.element, a.key FROM a JOIN w ON w.target = a.element)
    SELECT element, key FROM a""")
def accessor_assets(spark, sf_dir):
    n = F.col("n_nationkey")
    nation = _read(spark, sf_dir, "nation")
    return assembly.accessor_assets(nation.where("n_nationkey % 8 = 0").select(n.alias("element"), F.col("n_name").alias("key")), nation.where("n_nationkey % 5 > 0").select(n.alias("element"), ((n + 3) % 25).alias("target")))


@query("""WITH f AS (SELECT p_partkey, 'lib/' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '.g.dart' ELSE '.dart' END AS path, p_partkey % 6 = 0 AS gen FROM part), d AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber = 4 GROUP BY 1)
    SELECT CASE WHEN gen THEN 'dart-generated:quern/' ELSE 'dart:quern/' END || path AS id, CASE WHEN gen THEN 'generatedArtifact' ELSE 'dartLibrary' END AS kind, CASE WHEN NOT gen THEN coalesce(n, 0) END AS declaration_count, '' AS ids FROM f LEFT JOIN d ON l_partkey = p_partkey
    UNION ALL SELECT path, 'blocker', NULL, string_agg(DISTINCT 'x' || l_suppkey, ',' ORDER BY 'x' || l_suppkey) FROM f JOIN lineitem ON l_partkey = p_partkey WHERE gen AND l_linenumber = 5 GROUP BY path""")
def library_nodes(spark, sf_dir):
    path = lambda k: F.concat(F.lit("lib/"), k.cast("string"), F.when(k % 6 == 0, ".g.dart").otherwise(".dart"))
    line = _read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    nodes, stops = assembly.library_nodes(_read(spark, sf_dir, "part").select(path(F.col("p_partkey")).alias("path")), line.where("l_linenumber = 4").select(path(k).alias("path"), F.lit("d").alias("name")), line.where("l_linenumber = 5").select(path(k).alias("src_path"), F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("dst_id")), "quern")
    held = stops.select(F.substring_index("reason", " ", -1).alias("id"), F.lit("blocker").alias("kind"), F.lit(None).cast("bigint").alias("declaration_count"), F.array_join("affected_node_ids", ",").alias("ids"))
    return nodes.select("id", "kind", "declaration_count", F.lit("").alias("ids")).unionByName(held)


# Runs.


@query("""WITH f AS (SELECT event_type AS producer, ['node', 'edge', 'blocker'][CAST(event_id % 3 AS INT) + 1] AS fact, user_id % 60 AS key, event_id AS seq FROM events), w AS (SELECT fact, key, arg_min(producer, seq) AS adapter FROM f GROUP BY ALL)
    SELECT a.adapter, 'reporting' AS role, (SELECT count(*) FROM w WHERE w.adapter = a.adapter AND fact = 'node') AS nodes_added, (SELECT count(*) FROM w WHERE w.adapter = a.adapter AND fact = 'edge') AS edges_added, (SELECT count(*) FROM w WHERE w.adapter = a.adapter AND fact = 'blocker') AS blockers_added
    FROM (SELECT DISTINCT event_type AS adapter FROM events UNION SELECT 'idle') a""")
def adapter_contributions(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    fact = F.element_at(F.array(*map(F.lit, ("node", "edge", "blocker"))), (F.col("event_id") % 3 + 1).cast("int"))
    names = e.select(F.col("event_type").alias("adapter")).distinct().unionByName(spark.createDataFrame([("idle",)], "adapter string"))
    rows = names.select("adapter", F.lit("reporting").alias("role"), F.lit("executed").alias("status"), F.lit(0).alias("micros"))
    return runs.contributions(rows, e.select(F.col("event_type").alias("producer"), fact.alias("fact"), (F.col("user_id") % 60).alias("key"), F.col("event_id").alias("seq"))).select("adapter", "role", "nodes_added", "edges_added", "blockers_added")


_ENDS = "CASE event_type WHEN 'click' THEN 'committed' WHEN 'view' THEN 'rolledBackVerified' WHEN 'error' THEN 'recoveryRequired' WHEN 'signup' THEN 'nonTerminal' END"


@query(f"""WITH t AS (SELECT user_id AS run_id, {_ENDS} AS state FROM events) SELECT run_id, count(*) AS begun, count(*) FILTER (state = 'committed') AS committed, count(*) FILTER (state = 'recoveryRequired') AS "recoveryRequired", count(*) = count(state) AS partitioned FROM t GROUP BY run_id""")
def apply_counters(spark, sf_dir):
    rows = runs.apply_counters(_read(spark, sf_dir, "events").selectExpr("user_id AS run_id", f"{_ENDS} AS state"))
    return rows.select("run_id", "begun", "committed", "recoveryRequired", "partitioned")


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '-5' WHEN 2 THEN '"x"' ELSE p_size::VARCHAR END AS v FROM part)
    SELECT p_partkey AS id, 'a' AS key, v AS value FROM f WHERE p_partkey % 4 IN (1, 3) UNION ALL SELECT p_partkey, 'b', v FROM f WHERE p_partkey % 4 = 3 UNION ALL SELECT p_partkey, 'c', v FROM f WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'd', '["a","b"]' FROM f
    UNION ALL SELECT p_partkey, 'e', '{"v":"x"}' FROM f WHERE p_partkey % 4 = 2""")
def finding_details(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 4 == 0, "true").when(F.col("p_partkey") % 4 == 1, "-5").when(F.col("p_partkey") % 4 == 2, '"x"').otherwise(F.col("p_size").cast("string"))
    text = F.concat(*[x for key in "abce" for x in (F.lit(("{" if key == "a" else ",") + f'"{key}":'), v)], F.lit(',"d":["b",1,"a"]}'))
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("adapter"), F.lit("y").alias("kind"), text.alias("metadata"))
    kinds = spark.createDataFrame([("x", "y", k, t) for k, t in zip("abcde", ("integer", "bytes", "boolean", "paths", "text"))], "adapter string, kind string, key string, type string")
    return runs.detail_rows(rows, kinds)


@query("""WITH f AS (SELECT 'f' || p_partkey AS id, ['asset', 'dartLibrary', 'declaration'][p_size % 3 + 1] AS kind, 'lib/' || p_partkey AS path, p_brand AS unit FROM part),
    v AS (SELECT DISTINCT 'f' || l_partkey AS id, 'v' || l_suppkey AS path FROM lineitem WHERE l_linenumber = 6), c AS (SELECT DISTINCT 'f' || l_partkey AS id, 'g' || l_suppkey AS path FROM lineitem WHERE l_linenumber = 7),
    i AS (SELECT 'f' || l_partkey AS id, 'lib/' || (l_suppkey * 3) AS path, min(CASE l_returnflag WHEN 'N' THEN 'import' ELSE 'export' END) AS directive FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2)
    SELECT id, id AS action_id, path, CASE kind WHEN 'dartLibrary' THEN 'deleteFile' ELSE 'removeFinding' END AS operation FROM f
    UNION ALL SELECT f.id, f.id || '@variant:' || v.path, v.path, 'deleteFile' FROM v JOIN f USING (id) WHERE kind = 'asset' UNION ALL SELECT f.id, f.id || '@generated:' || c.path, c.path, 'deleteFile' FROM c JOIN f USING (id) WHERE kind = 'dartLibrary'
    UNION ALL SELECT f.id, f.id || '@' || directive || ':' || i.path, i.path, 'cleanupImports' FROM i JOIN f USING (id) WHERE kind = 'dartLibrary' AND i.path <> f.path AND NOT EXISTS (SELECT 1 FROM f g WHERE g.kind = 'dartLibrary' AND g.path = i.path AND g.unit = f.unit)""")
def finding_actions(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    id_ = text("f", F.col("l_partkey")).alias("id")
    f = _read(spark, sf_dir, "part").select(text("f", F.col("p_partkey")).alias("id"), F.element_at(F.array(*map(F.lit, ("asset", "dartLibrary", "declaration"))), F.col("p_size") % 3 + 1).alias("kind"), text("lib/", F.col("p_partkey")).alias("path"), F.col("p_brand").alias("unit"))
    of = lambda n, prefix: line.where(f"l_linenumber = {n}").select(id_, text(prefix, F.col("l_suppkey")).alias("path")).distinct()
    importers = line.where("l_linenumber <= 2").select(id_, text("lib/", F.col("l_suppkey") * 3).alias("path"), F.when(F.col("l_returnflag") == "N", "import").otherwise("export").alias("directive"))
    return runs.actions(f, of(6, "v"), importers, of(7, "g")).select("id", "action_id", "path", "operation")


@query("""WITH RECURSIVE u AS (SELECT 'unit:' || p_partkey AS unit_id FROM part), n AS (SELECT DISTINCT 'unit:' || l_partkey AS unit_id, 'unit:' || (l_partkey + l_suppkey) AS needs_id FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 20), x AS (SELECT 'unit:' || p_partkey AS unit_id FROM part WHERE p_partkey % 50 = 0),
    h AS (SELECT unit_id FROM x UNION SELECT n.needs_id FROM h JOIN n ON n.unit_id = h.unit_id)
    SELECT unit_id, CASE WHEN unit_id IN (SELECT unit_id FROM x) THEN 'rejectedRecovered' WHEN unit_id IN (SELECT unit_id FROM h) THEN 'skippedDependency' ELSE 'committed' END AS outcome, 'tx-r007-' || substr(unit_id, 6) AS transaction_id FROM u""")
def apply_rounds(spark, sf_dir):
    unit = lambda c: F.concat(F.lit("unit:"), c.cast("string"))
    part, line = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    u = part.select(unit(F.col("p_partkey")).alias("unit_id"))
    needs = line.where("l_linenumber = 1 AND l_quantity > 20").select(unit(F.col("l_partkey")).alias("unit_id"), unit(F.col("l_partkey") + F.col("l_suppkey")).alias("needs_id")).distinct()
    rows = runs.round_outcomes(u, needs, part.where("p_partkey % 50 = 0").select(unit(F.col("p_partkey")).alias("unit_id")))
    return rows.withColumn("transaction_id", runs.transaction_id(F.lit(7), F.col("unit_id")))


@query("""SELECT 'd' || doc_id AS path, CASE WHEN trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '' ELSE rtrim(x, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) END AS text
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 3) || substr(text, 9, 4) || substr(text, 21) ELSE text END AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE regexp_full_match(coalesce(text, ''), '[\\x20-\\x7e\\n]*'))) AS y(doc_id, x)""")
def source_edits(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(r"^[\x20-\x7e\n]*\z")).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    spans = docs.where("doc_id % 2 = 0").select("path", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((3, 8), (12, 20))])).alias("x")).select("path", "x.*")
    return runs.edited_sources(docs.select("path", "text"), spans)


_CASE = "CASE event_type WHEN 'signup' THEN 'backedUp' WHEN 'view' THEN 'applied' WHEN 'click' THEN 'kept' WHEN 'purchase' THEN 'rolledBack' ELSE 'failed' END"


@query(f"""WITH e AS (SELECT event_id, user_id, {_CASE} AS state, lag({_CASE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, state, before FROM e WHERE NOT coalesce(CASE state WHEN 'backedUp' THEN before IS NULL WHEN 'applied' THEN before = 'backedUp' WHEN 'kept' THEN before = 'applied' WHEN 'rolledBack' THEN before IN ('backedUp', 'applied') ELSE before IN ('backedUp', 'applied', 'rolledBack') END, false)""")
def case_violations(spark, sf_dir):
    return runs.case_violations(_read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", f"{_CASE} AS state"), "user_id", ["ts", "event_id"]).select("event_id", "state", "before")


@query(f"""WITH e AS (SELECT user_id AS run_id, event_id % 5 AS case_id, arg_max({_CASE}, event_id) AS state, arg_max(event_id % 100, event_id) AS size_bytes FROM events GROUP BY 1, 2), r AS (SELECT c_custkey AS run_id, c_mktsegment AS state FROM customer WHERE c_custkey < 200)
    SELECT r.run_id, r.state, count(case_id) AS cases, count(*) FILTER (e.state IN ('backedUp', 'applied', 'failed')) AS open_cases, CAST(coalesce(sum(size_bytes) FILTER (e.state IN ('backedUp', 'applied', 'failed')), 0) AS BIGINT) AS restorable_bytes FROM r LEFT JOIN e USING (run_id) GROUP BY ALL""")
def quarantine_listing(spark, sf_dir):
    e = _read(spark, sf_dir, "events").selectExpr("user_id AS run_id", "event_id % 5 AS case_id", "event_id AS seq", f"{_CASE} AS state", "event_id % 100 AS size_bytes")
    return runs.quarantine_listing(e, _read(spark, sf_dir, "customer").where("c_custkey < 200").selectExpr("c_custkey AS run_id", "c_mktsegment AS state"))


@query("""WITH o AS (SELECT p_partkey AS finding_id, ['committed', 'rejectedRecovered', 'recoveryRequired', 'blocked'][p_size % 4 + 1] AS status, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'r' END AS reason, CASE WHEN p_partkey % 5 > 0 THEN 't' END AS tx, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS back FROM part)
    SELECT finding_id, 'no reason' AS problem FROM o WHERE reason = '' UNION ALL SELECT finding_id, 'no verified rollback' FROM o WHERE status = 'rejectedRecovered' AND NOT coalesce(back, false) UNION ALL SELECT finding_id, 'verified rollback' FROM o WHERE status = 'recoveryRequired' AND back
    UNION ALL SELECT finding_id, 'no transaction' FROM o WHERE status <> 'blocked' AND tx IS NULL""")
def outcome_violations(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("committed", "rejectedRecovered", "recoveryRequired", "blocked"))), F.col("p_size") % 4 + 1)
    rows = _read(spark, sf_dir, "part").select(k.alias("finding_id"), status.alias("status"), F.lit("c").alias("reason_code"), F.when(k % 9 == 0, "").otherwise("r").alias("reason"), F.when(k % 5 > 0, "t").alias("transaction_id"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("rollback_verified"))
    return runs.outcome_violations(rows)


@query("""WITH s AS (SELECT p_partkey AS run_id, CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'allEligible' END AS mode, [['a', 'b'], ['b', 'a'], [], ['a', 'a'], ['', 'a']][p_partkey % 5 + 1] AS requested, [['a'], [], ['a', 'c']][p_partkey % 3 + 1] AS planned, [sha256('x'), NULL, 'bad'][p_partkey % 7 % 3 + 1] AS fingerprint FROM part)
    SELECT run_id, 'requested ids are not a sorted set' AS problem FROM s WHERE run_id % 5 IN (1, 3, 4) UNION ALL SELECT run_id, 'exact selection without ids' FROM s WHERE mode = 'exact' AND run_id % 5 = 2 UNION ALL SELECT run_id, 'ids in a selection of everything' FROM s WHERE mode <> 'exact' AND run_id % 5 <> 2
    UNION ALL SELECT run_id, 'plan beyond the request' FROM s WHERE mode = 'exact' AND len(list_filter(planned, lambda x: NOT list_contains(requested, x))) > 0 UNION ALL SELECT run_id, 'fingerprint is no SHA-256' FROM s WHERE fingerprint = 'bad' UNION ALL SELECT run_id, 'fingerprint does not go with a plan' FROM s WHERE (len(planned) = 0) <> (fingerprint IS NULL)""")
def selection_violations(spark, sf_dir):
    k = F.col("p_partkey")
    lists = lambda values: F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in values])
    pick = lambda values, n: F.element_at(values, (n + 1).cast("int"))
    prints = F.array(F.sha2(F.lit("x"), 256), F.lit(None).cast("string"), F.lit("bad"))
    rows = _read(spark, sf_dir, "part").select(k.alias("run_id"), F.when(F.col("p_size") % 2 == 0, "exact").otherwise("allEligible").alias("mode"), pick(lists([["a", "b"], ["b", "a"], [], ["a", "a"], ["", "a"]]), k % 5).alias("requested"), pick(lists([["a"], [], ["a", "c"]]), k % 3).alias("planned"), pick(prints, k % 7 % 3).alias("fingerprint"))
    return runs.selection_violations(rows)


@query("""WITH p AS (SELECT p_partkey AS policy_id, p_size % 3 AS shape FROM part)
    SELECT policy_id, sha256('[{"id":"analyze","executable":"' || CASE shape WHEN 0 THEN 'flutter' WHEN 1 THEN 'fvm' ELSE 'make' END || '","arguments":["' || CASE shape WHEN 1 THEN 'flutter","analyze' ELSE 'analyze' END || '"],"parserKind":"' || CASE shape WHEN 2 THEN 'opaque' ELSE 'humanAnalyzer' END
        || '"},{"id":"test","executable":"dart","arguments":["test"],"parserKind":"compactTest"}]') AS hash, CAST(2 AS INT) AS steps FROM p""")
def policy_hashes(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("policy_id"), (F.col("p_size") % 3).alias("shape"))
    tool = F.when(F.col("shape") == 0, "flutter").when(F.col("shape") == 1, "fvm").otherwise("make")
    args = F.when(F.col("shape") == 1, F.array(F.lit("flutter"), F.lit("analyze"))).otherwise(F.array(F.lit("analyze")))
    first = rows.select("policy_id", F.lit(0).alias("seq"), F.lit("analyze").alias("id"), tool.alias("executable"), args.alias("arguments"))
    second = rows.select("policy_id", F.lit(1).alias("seq"), F.lit("test").alias("id"), F.lit("dart").alias("executable"), F.array(F.lit("test")).alias("arguments"))
    return runs.policy_hash(second.unionByName(first))


@query("""WITH s AS (SELECT user_id AS run_id, event_type AS name, 'opaque' AS parser FROM events WHERE event_id % 40 = 0 AND event_type <> 'error' AND user_id % 5 > 0 UNION ALL SELECT c_custkey, unnest(['click', 'purchase', 'signup', 'view']), CASE WHEN c_custkey % 10 = 0 THEN 'x' ELSE 'opaque' END FROM customer WHERE c_custkey < 150 AND c_custkey % 5 = 0)
    SELECT c_custkey AS run_id, (SELECT coalesce(string_agg(name || parser, ',' ORDER BY name, parser), '') FROM s WHERE run_id = c_custkey) = 'clickopaque,purchaseopaque,signupopaque,viewopaque' AS complete FROM customer WHERE c_custkey < 150""")
def complete_runs(spark, sf_dir):
    names = ("click", "purchase", "signup", "view")
    e = _read(spark, sf_dir, "events").where("event_id % 40 = 0 AND event_type <> 'error' AND user_id % 5 > 0").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.lit("opaque").alias("parser"))
    c = _read(spark, sf_dir, "customer").where("c_custkey < 150").select(F.col("c_custkey").alias("run_id"))
    e = e.unionByName(c.where("run_id % 5 = 0").select("run_id", F.explode(F.array(*map(F.lit, names))).alias("name"), F.when(F.col("run_id") % 10 == 0, "x").otherwise("opaque").alias("parser")))
    return runs.complete_runs(c, e, spark.createDataFrame([(n, "opaque") for n in names], "name string, parser string"))


_STEPS = "e AS (SELECT user_id, event_id, event_type, 'k' || (event_id % 4) AS p FROM events), cand AS (SELECT user_id AS run_id, event_type AS name, 'p' || (user_id % 9 // 8) AS policy, min(event_id) % 5 - 1 AS exit_code, list(p) FILTER (event_id % 3 = 0) AS prints FROM e GROUP BY 1, 2), base AS (SELECT event_type AS name, 'p0' AS policy, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS exit_code, list(p) FILTER (event_id % 3 = 0 AND user_id = 8) AS prints FROM e WHERE event_type <> 'signup' GROUP BY 1)"


@query(f"""WITH {_STEPS}, m AS (SELECT c.run_id, c.name, c.policy, c.exit_code, coalesce(c.prints, []) AS prints, b.policy AS old_policy, b.exit_code AS old_exit, coalesce(b.prints, []) AS old_prints FROM cand c LEFT JOIN base b USING (name)),
    ok AS (SELECT * FROM m WHERE exit_code >= 0 AND old_exit IS NOT NULL AND (exit_code = 0 OR len(prints) > 0)), n AS (SELECT run_id, name, p, count(*) AS n FROM (SELECT run_id, name, unnest(prints) AS p FROM ok WHERE old_exit <> 0 AND exit_code <> 0) GROUP BY ALL), o AS (SELECT name, p, count(*) AS n FROM (SELECT name, unnest(prints) AS p FROM base) GROUP BY ALL)
    SELECT DISTINCT run_id, 'infrastructure' AS kind, 'verification policy does not match baseline' AS detail, CAST(1 AS BIGINT) AS n FROM m WHERE policy <> old_policy UNION ALL SELECT run_id, 'infrastructure', name || ': not run', 1 FROM m WHERE exit_code < 0 UNION ALL SELECT run_id, 'infrastructure', name || ': missing stored baseline step', 1 FROM m WHERE exit_code >= 0 AND old_exit IS NULL
    UNION ALL SELECT run_id, 'infrastructure', name || ': nonzero exit without stable diagnostic evidence', 1 FROM m WHERE exit_code > 0 AND old_exit IS NOT NULL AND len(prints) = 0 UNION ALL SELECT run_id, 'new', name || ': command changed from pass to fail', 1 FROM ok WHERE old_exit = 0 AND exit_code <> 0
    UNION ALL SELECT run_id, 'new', name || ': fingerprint ' || n.p, n.n - coalesce(o.n, 0) FROM n LEFT JOIN o USING (name, p) WHERE n.n > coalesce(o.n, 0)""")
def verification_gates(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("p", F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")))
    prints = lambda where: F.collect_list(F.when(where, F.col("p"))).alias("fingerprints")
    tool = F.lit("t").alias("toolchain")
    cand = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("name")).agg((F.min("event_id") % 5 - 1).alias("exit_code"), prints(F.col("event_id") % 3 == 0)).select("run_id", "name", F.concat(F.lit("p"), F.floor(F.col("run_id") % 9 / 8).cast("string")).alias("policy"), tool, "exit_code", "fingerprints")
    base = e.where("event_type <> 'signup'").groupBy(F.col("event_type").alias("name")).agg(prints((F.col("event_id") % 3 == 0) & (F.col("user_id") == 8))).select("name", F.lit("p0").alias("policy"), tool, F.when(F.col("name").isin("click", "view"), 0).otherwise(1).alias("exit_code"), "fingerprints")
    return runs.verification_gates(cand, base).groupBy("run_id", "kind", "detail").agg(F.count("*").alias("n"))


@query("SELECT user_id AS run_id, event_type AS name, sha256('k' || (event_id % 4)) AS digest, count(*) AS n FROM events GROUP BY ALL")
def baseline_evidence(spark, sf_dir):
    p = F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))
    return runs.baseline_evidence(_read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.array(p).alias("fingerprints")))


_CASES = "SELECT p_partkey AS case_id, ['a', 'b', 'c'] AS contexts, [[], ['a'], ['a', 'b']][p_size % 3 + 1] AS reachable, [[], ['a'], ['b', 'd'], ['a', 'b', 'c']][p_partkey % 4 + 1] AS retained, ['removableInDeclaredScope', 'mustKeep'][p_partkey % 7 % 2 + 1] AS truth, ['shouldReport', 'shouldNotReport'][p_size % 5 % 2 + 1] AS expected FROM part"


@query(f"""WITH c AS ({_CASES}) SELECT case_id, 'reachable beyond retained' AS problem FROM c WHERE len(list_filter(reachable, lambda x: NOT list_contains(retained, x))) > 0 UNION ALL SELECT case_id, 'unknown context' FROM c WHERE list_contains(retained, 'd')
    UNION ALL SELECT case_id, 'reachable candidate should be reported' FROM c WHERE len(reachable) > 0 AND expected = 'shouldReport' UNION ALL SELECT case_id, 'retained candidate is removable' FROM c WHERE len(retained) > 0 AND truth = 'removableInDeclaredScope'""")
def oracle_case_violations(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    lists = lambda values: F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in values])
    pick = lambda values, n: F.element_at(values, (n + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select(k.alias("case_id"), F.array(*map(F.lit, "abc")).alias("contexts"), pick(lists([[], ["a"], ["a", "b"]]), s % 3).alias("reachable"), pick(lists([[], ["a"], ["b", "d"], ["a", "b", "c"]]), k % 4).alias("retained"), F.when(k % 7 % 2 == 0, "removableInDeclaredScope").otherwise("mustKeep").alias("truth"), F.when(s % 5 % 2 == 0, "shouldReport").otherwise("shouldNotReport").alias("expected"))
    return runs.oracle_case_violations(rows)


_CONTRACT_KINDS = tuple(runs.CONTRACTS)


@query(f"""WITH c AS (SELECT p_partkey AS case_id, {list(_CONTRACT_KINDS)}[p_partkey % 8 + 1] AS kind, p_size % 5 > 0 AS report, p_size % 7 > 0 AS removable, ['application', 'package', 'package-internal'][p_size % 3 + 1] AS mode, p_partkey % 11 = 0 AS protected, p_partkey % 13 > 0 AS gates, p_partkey % 17 > 0 AS api_known,
        [[], ['external-consumers-not-scanned'], ['broad-removal-scope'], ['a', 'b']][p_size % 4 + 1] AS risks FROM part),
    t AS (SELECT *, CASE WHEN NOT report THEN NULL WHEN kind NOT IN ('dartLibrary', 'dartDeclaration', 'asset') THEN 'REVIEW' WHEN protected THEN 'PROTECTED' WHEN mode = 'package' OR NOT removable OR NOT api_known OR NOT gates THEN 'REVIEW' WHEN len(risks) = 0 THEN 'SAFE' WHEN len(risks) = 1 THEN 'HIGH' ELSE 'REVIEW' END AS tier FROM c)
    SELECT case_id, {list(v[0] for v in runs.CONTRACTS.values())}[case_id % 8 + 1] AS adapter, {list(v[1] for v in runs.CONTRACTS.values())}[case_id % 8 + 1] AS rule_id, tier,
        coalesce(report AND removable AND CASE mode WHEN 'application' THEN tier = 'SAFE' WHEN 'package-internal' THEN tier = 'SAFE' OR (tier = 'HIGH' AND list_contains(risks, 'external-consumers-not-scanned')) ELSE false END, false) AS apply_eligible FROM t""")
def finding_contracts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, n: F.element_at(values, (n + 1).cast("int"))
    risks = F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in ([], ["external-consumers-not-scanned"], ["broad-removal-scope"], ["a", "b"])])
    rows = _read(spark, sf_dir, "part").select(
        k.alias("case_id"), pick(F.array(*map(F.lit, _CONTRACT_KINDS)), k % 8).alias("kind"), F.when(s % 5 > 0, "shouldReport").otherwise("shouldNotReport").alias("expected"), F.when(s % 7 > 0, "removableInDeclaredScope").otherwise("mustKeep").alias("truth"),
        pick(F.array(*map(F.lit, ("application", "package", "package-internal"))), s % 3).alias("mode"), (k % 11 == 0).alias("protected"), (k % 13 > 0).alias("gates"), (k % 17 > 0).alias("api_known"), pick(risks, s % 4).alias("risks"),
    )
    return runs.finding_contracts(rows)


@query("""WITH m AS (SELECT CASE l_linenumber WHEN 7 THEN 'aux:bad:x' ELSE 'app:' || l_linestatus END AS context, 'part:' || (l_partkey + CASE WHEN l_linenumber = 6 THEN 1000000 ELSE 0 END) AS id FROM lineitem WHERE l_linenumber > 3), n AS (SELECT context, id, count(*) AS n FROM m GROUP BY ALL)
    SELECT context, id, 'context is not canonical' AS problem FROM n WHERE context = 'aux:bad:x' UNION ALL SELECT context, id, 'repeated id' FROM n WHERE n > 1 UNION ALL SELECT context, id, 'unknown node' FROM n WHERE id NOT IN (SELECT 'part:' || p_partkey FROM part)""")
def membership_violations(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").where("l_linenumber > 3")
    context = F.when(F.col("l_linenumber") == 7, "aux:bad:x").otherwise(F.concat(F.lit("app:"), "l_linestatus"))
    members = line.select(context.alias("context"), F.concat(F.lit("part:"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 6, 1_000_000).otherwise(0)).cast("string")).alias("id"))
    return runs.membership_violations(members, _read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id")))


@query("""WITH a AS (SELECT 'a' || (p_partkey % 300) AS adapter, 's' || (p_partkey % 290) AS scheme, p_partkey % 300 < 5 OR p_partkey % 299 = 7 AS built_in FROM part), r AS (SELECT 'a' || (p_partkey % 300) AS adapter, p_brand || p_type AS rule_id, CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE p_name END AS title FROM part WHERE p_size < 3)
    SELECT adapter AS subject, 'adapter is registered twice' AS problem FROM a GROUP BY adapter HAVING count(DISTINCT built_in) > 1 UNION ALL SELECT scheme, 'scheme has several owners' FROM a GROUP BY scheme HAVING count(DISTINCT adapter) > 1
    UNION ALL SELECT rule_id, 'rule has several owners' FROM r GROUP BY rule_id HAVING count(DISTINCT adapter) > 1 UNION ALL SELECT DISTINCT adapter, 'name is reserved' FROM a WHERE NOT built_in AND adapter IN ('a1', 'a2', 'a50') UNION ALL SELECT DISTINCT adapter, 'empty text in the catalogue' FROM r WHERE trim(title) = ''""")
def registry_violations(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("a"), (k % 300).cast("string")).alias("adapter")
    rows = part.select(name, F.concat(F.lit("s"), (k % 290).cast("string")).alias("scheme"), ((k % 300 < 5) | (k % 299 == 7)).alias("built_in"))
    rules = part.where("p_size < 3").select(name, F.concat("p_brand", "p_type").alias("rule_id"), F.when(k % 97 == 0, " ").otherwise(F.col("p_name")).alias("title"))
    return runs.registry_violations(rows, rules, spark.createDataFrame([("a1",), ("a2",), ("a50",)], "name string"))
