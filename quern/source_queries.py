"""Registered queries of sources: listings, probes, native targets, packages and admissibility, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import QUERIES, _read, query
from quern.sources import links, project

__all__ = ["QUERIES"]


def _pick(values, n):
    return F.element_at(F.array(*[v if hasattr(v, "alias") else F.lit(v) for v in values]), (n + 1).cast("int"))


@query("""WITH p AS (SELECT p_partkey, ['lib/' || p_partkey || '.dart', 'lib/.hidden/a.dart', 'bin/x' || p_partkey || '.dart', 'web/y.dart', 'test/build/z.dart', 'lib.dart', 'tool/w' || p_partkey || '.txt', 'example/lib/v' || p_partkey || '.dart'][p_partkey % 8 + 1] AS path FROM part)
    SELECT path FROM p WHERE p_partkey % 8 IN (0, 2, 7)""")
def dart_sources(spark, sf_dir):
    k = F.col("p_partkey")
    n = k.cast("string")
    path = _pick([F.concat(F.lit("lib/"), n, F.lit(".dart")), "lib/.hidden/a.dart", F.concat(F.lit("bin/x"), n, F.lit(".dart")), "web/y.dart", "test/build/z.dart", "lib.dart", F.concat(F.lit("tool/w"), n, F.lit(".txt")), F.concat(F.lit("example/lib/v"), n, F.lit(".dart"))], k % 8)
    return project.dart_sources(_read(spark, sf_dir, "part").select(path.alias("path")))


@query("""WITH f AS (SELECT ['android/app/src/' || p_partkey || '/AndroidManifest.xml', 'ios/' || p_partkey || '.entitlements', 'macos/' || p_partkey || '/Info.plist', 'lib/' || p_partkey || '/Info.plist'][p_partkey % 4 + 1] AS path, p_partkey % 4 AS k,
        ['autoVerify="true"', 'android.intent.action.VIEW android:scheme', 'android.intent.action.VIEW', 'com.apple.developer.associated-domains', 'CFBundleURLSchemes', NULL][p_size % 6 + 1] AS text FROM part)
    SELECT path AS source FROM f WHERE (k = 0 AND (text IS NULL OR text LIKE 'auto%' OR text LIKE '%scheme')) OR (k = 1 AND (text IS NULL OR text LIKE 'com%')) OR (k = 2 AND (text IS NULL OR text LIKE 'CF%')) UNION SELECT 'target:' || n_name || ':web' FROM nation WHERE n_regionkey = 0""")
def deep_links(spark, sf_dir):
    k = F.col("p_partkey")
    n = k.cast("string")
    path = _pick([F.concat(F.lit("android/app/src/"), n, F.lit("/AndroidManifest.xml")), F.concat(F.lit("ios/"), n, F.lit(".entitlements")), F.concat(F.lit("macos/"), n, F.lit("/Info.plist")), F.concat(F.lit("lib/"), n, F.lit("/Info.plist"))], k % 4)
    text = _pick(['autoVerify="true"', "android.intent.action.VIEW android:scheme", "android.intent.action.VIEW", "com.apple.developer.associated-domains", "CFBundleURLSchemes", F.lit(None).cast("string")], F.col("p_size") % 6)
    targets = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "web").otherwise("ios").alias("platform"))
    return project.deep_links(_read(spark, sf_dir, "part").select(path.alias("path"), text.alias("text")), targets)


@query("""SELECT 'g' || p_partkey AS path, f AS flavor, 'lib/' || f || (p_partkey % 9) || '.dart' AS entrypoint FROM part, (VALUES ('dev'), ('prod')) v(f) WHERE NOT (p_size % 4 = 0 AND f = 'prod') UNION ALL SELECT 's' || p_partkey, NULL, 'lib/s' || p_size || '.dart' FROM part WHERE p_size < 10""")
def native_targets(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    one = lambda f, named: F.concat(F.lit(f'    {named} {{\n      flutter.target = "lib/{f}'), (F.col("p_partkey") % 9).cast("string"), F.lit('.dart"\n    }\n'))
    second = F.when(F.col("p_size") % 4 == 0, F.lit("    prod {\n    }\n")).otherwise(one("prod", "prod"))
    text = F.concat(F.lit("android {\n  other {\n    flutter.target 'lib/no.dart'\n  }\n  productFlavors {\n"), one("dev", "create('dev')"), second, F.lit("  }\n  flutter.target = 'lib/late.dart'\n}\n"))
    lines = part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("path"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    schemes = part.where("p_size < 10").select(F.concat(F.lit("ios/s"), F.col("p_partkey").cast("string"), F.lit(".xcscheme")).alias("path"), F.concat(F.lit('<x argument = "-t lib/s'), F.col("p_size").cast("string"), F.lit('.dart">')).alias("text"))
    return project.native_targets(lines).unionByName(project.scheme_targets(schemes).select(F.col("flavor").alias("path"), F.lit(None).cast("string").alias("flavor"), "entrypoint"))


@query("""WITH d AS (SELECT 'pk' || (p_partkey % 40) AS name, 'img/' || p_size || '.png' AS entry FROM part), l AS (SELECT DISTINCT '/cache/pk' || (l_partkey % 40) || '/img/' || l_linenumber || '.png' AS path FROM lineitem WHERE l_quantity > 48)
    SELECT DISTINCT 'packages/' || name || '/' || entry AS key, name AS package, CAST(7 AS BIGINT) AS size_bytes FROM d WHERE name <> 'pk3' AND '/cache/' || name || '/' || entry IN (SELECT path FROM l)""")
def dependency_assets(spark, sf_dir):
    name = lambda c: F.concat(F.lit("pk"), (F.col(c) % 40).cast("string"))
    png = lambda c: F.concat(F.lit("img/"), F.col(c).cast("string"), F.lit(".png"))
    part, line = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    listed = part.select(name("p_partkey").alias("name"), F.concat(F.lit("/cache/"), name("p_partkey"), F.lit("/")).alias("root")).distinct()
    files = line.where("l_quantity > 48").select(F.concat(F.lit("/cache/"), name("l_partkey"), F.lit("/"), png("l_linenumber")).alias("path"), F.lit(7).cast("bigint").alias("size_bytes")).distinct()
    return project.dependency_assets(listed, part.select(name("p_partkey").alias("name"), png("p_size").alias("entry")), files, "pk3")


@query("""WITH RECURSIVE i AS (SELECT DISTINCT 'f' || (l_partkey % 400) AS src, 'f' || (l_suppkey * 5 % 420) AS dst FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40), f AS (SELECT 'f' || p_partkey AS path, p_partkey % 9 > 0 AS readable FROM part WHERE p_partkey < 410),
    c AS (SELECT 'f' || (p_partkey % 400) AS path, ['dart.library.io', 'one', 'both'][p_size % 3 + 1] AS name, CASE WHEN p_partkey % 7 > 0 THEN 'f' || (p_partkey % 430) END AS uri_path FROM part), w AS (SELECT 'f' || s_suppkey AS path FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT i.dst FROM w JOIN i ON i.src = w.path)
    SELECT path, 'file cannot be read' AS problem FROM w WHERE path NOT IN (SELECT path FROM f WHERE readable) UNION SELECT path, 'unknown condition one' FROM c WHERE name = 'one' AND path IN (SELECT path FROM w)
    UNION SELECT path, 'inadmissible branch' FROM c WHERE path IN (SELECT path FROM w) AND (uri_path IS NULL OR uri_path NOT IN (SELECT path FROM f))""")
def inadmissible_sources(spark, sf_dir):
    f = lambda c: F.concat(F.lit("f"), c.cast("string"))
    k = F.col("p_partkey")
    part = _read(spark, sf_dir, "part")
    imports = _read(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 40").select(f(F.col("l_partkey") % 400).alias("src"), f(F.col("l_suppkey") * 5 % 420).alias("dst")).distinct()
    files = part.where("p_partkey < 410").select(f(k).alias("path"), (k % 9 > 0).alias("readable"))
    conditions = part.select(f(k % 400).alias("path"), _pick(["dart.library.io", "one", "both"], F.col("p_size") % 3).alias("name"), F.when(k % 7 > 0, f(k % 430)).alias("uri_path"))
    defines = spark.createDataFrame([("a", "one"), ("a", "both"), ("b", "both"), ("c", "one")], "target string, name string")
    return project.inadmissible(_read(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(f(F.col("s_suppkey")).alias("path")), imports, conditions, files, defines, spark.createDataFrame([("a",), ("b",)], "name string"))


@query("""WITH p AS (SELECT p_partkey, ['lib/a.dart', '', 'lib/' || chr(7) || '.dart', '/lib/a.dart', '../a.dart', 'lib/x/../../../b.dart', 'lib/a.txt', 'lib/a.g.dart', 'build/a.dart', 'lib/../bin/c.dart'][p_partkey % 10 + 1] AS path FROM part)
    SELECT p_partkey, [NULL, 'empty', 'control character', 'absolute', 'escapes the project', 'escapes the project', 'not a Dart file', 'generated', 'generated', NULL][p_partkey % 10 + 1] AS problem FROM p""")
def source_path_problems(spark, sf_dir):
    path = _pick(["lib/a.dart", "", "lib/\x07.dart", "/lib/a.dart", "../a.dart", "lib/x/../../../b.dart", "lib/a.txt", "lib/a.g.dart", "build/a.dart", "lib/../bin/c.dart"], F.col("p_partkey") % 10)
    return _read(spark, sf_dir, "part").select("p_partkey", project.source_path_problem(path).alias("problem"))


@query("""SELECT c_mktsegment, count(*) AS runs, min(c_acctbal) AS least, max(c_acctbal) AS most, median(c_acctbal) AS middle, max(c_acctbal) / nullif(min(c_acctbal), 0) AS ratio FROM customer GROUP BY c_mktsegment""")
def run_times(spark, sf_dir):
    """Least, most and middle of measured runs and their ratio, as benchmark reports give them."""
    t = F.col("c_acctbal")
    return _read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("runs"), F.min(t).alias("least"), F.max(t).alias("most"), F.median(t).alias("middle"), (F.max(t) / F.nullif(F.min(t), F.lit(0.0))).alias("ratio"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS finished_at, epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_micros FROM events GROUP BY user_id""")
def run_clocks(spark, sf_dir):
    """Start and end of each run as ISO-8601 in UTC, and the microseconds between them."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    g = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", iso(F.col("a")).alias("started_at"), iso(F.col("b")).alias("finished_at"), (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))).alias("elapsed_micros"))


#: Languages of the message files below; the last is none.
_CODES = ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "da", "zz")


@query(f"""WITH m AS (SELECT p_partkey, p_partkey % 25 AS k, p_size % 6 AS s, 'm' || p_partkey AS key, {list(_CODES)}[p_partkey % 25 % 10 + 1] AS code FROM part),
    f AS (SELECT *, 'l/' || k || '/app_' || code || '.arb' AS path, CASE WHEN code = 'zz' THEN 'ARB filename locale could not be determined safely' WHEN k = 3 THEN 'ARB filename locale es differs from @@locale it' WHEN k = 4 THEN 'malformed JSON' END AS reason FROM m)
    SELECT 'issue' AS what, path, NULL AS key, reason AS said FROM f WHERE reason IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'issue', path, key, CASE s WHEN 1 THEN 'message must have a string value' WHEN 3 THEN 'metadata description must be a string' WHEN 4 THEN 'metadata has no matching message' ELSE 'an attribute of a placeholder is not valid' END FROM f WHERE reason IS NULL AND s IN (1, 3, 4, 5)
    UNION ALL SELECT 'message', code, key, 'Hi {{name}} of ' || p_partkey FROM f WHERE reason IS NULL AND s NOT IN (1, 4)""")
def message_documents(spark, sf_dir):
    """Parts as messages of 25 files: some are no texts, some have descriptions that break a rule, some files can't be read as a whole."""
    part = _read(spark, sf_dir, "part")
    k, code = F.col("p_partkey") % 25, F.element_at(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % 25 % 10 + 1).cast("int"))
    name = F.concat(F.lit('"m'), F.col("p_partkey").cast("string"), F.lit('":'))
    about = F.concat(F.lit(',"@'), F.substring(name, 2, 100))
    text = F.concat(F.lit('"Hi {name} of '), F.col("p_partkey").cast("string"), F.lit('"'))
    plain, after = F.concat(name, text), lambda x: F.concat(name, text, about, F.lit(x))
    forms = [plain, F.concat(name, F.lit("12.5")), after('{"description":"d","placeholders":{"name":{"type":"String","optionalParameters":{"k":"null"}}}}'), after('{"description":4}'),
        F.concat(F.lit('"@'), F.substring(name, 2, 100), F.lit("{}")), after('{"placeholders":{"name":{"example":" "}}}')]
    entry = F.element_at(F.array(*forms), (F.col("p_size") % 6 + 1).cast("int"))
    path = F.concat(F.lit("l/"), k.cast("string"), F.lit("/app_"), code, F.lit(".arb"))
    files = part.select(path.alias("path"), k.alias("k"), entry.alias("entry")).groupBy("path", "k").agg(F.array_join(F.array_sort(F.collect_list("entry")), ",").alias("body"))
    documents = files.select("path", F.concat(F.lit("{"), F.when(F.col("k") == 3, '"@@locale":"it",').otherwise(""), "body", F.when(F.col("k") == 4, ",").otherwise("}")).alias("text"))
    said, issues = project.messages(documents, "l/0/app_en.arb")
    return issues.select(F.lit("issue").alias("what"), "path", "key", F.col("reason").alias("said")).unionByName(said.select(F.lit("message").alias("what"), F.col("locale").alias("path"), "key", F.col("message").alias("said")))


#: Links of the tree below: into the selected package p2 and out of it, through other links, in rings, over the top.
_LINKS = [("/w/p3/Brand#1", "../p2/Brand#1"), ("/w/p2/Brand#2", "/w/p4/Brand#2"), ("/w/p5/Brand#3", "Brand#4"), ("/w/p5/Brand#4", "./Brand#5/"), ("/w/p6/Brand#1", "Brand#2"), ("/w/p6/Brand#2", "Brand#1"),
    ("/w/p7/Brand#3", "/w/p3/Brand#1"), ("/w/p8/Brand#4", "/out/../../w/p9/Brand#4"), ("/w/p10", "p11"), ("/w/p2/Brand#5", "Brand#4"), ("/w/p12/Brand#2", "/elsewhere")]
_TREE = f"""RECURSIVE l(link, target) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in (("/w/p3/Brand#1", "/w/p2/Brand#1"), ("/w/p2/Brand#2", "/w/p4/Brand#2"), ("/w/p5/Brand#3", "/w/p5/Brand#4"), ("/w/p5/Brand#4", "/w/p5/Brand#5"), ("/w/p6/Brand#1", "/w/p6/Brand#2"), ("/w/p6/Brand#2", "/w/p6/Brand#1"), ("/w/p7/Brand#3", "/w/p3/Brand#1"), ("/w/p8/Brand#4", "/w/p9/Brand#4"), ("/w/p10", "/w/p11"), ("/w/p2/Brand#5", "/w/p2/Brand#4"), ("/w/p12/Brand#2", "/elsewhere")))}),
    f AS (SELECT DISTINCT '/w/p' || (p_partkey % 20) || '/' || p_brand || '/' || p_size || '.dart' AS path FROM part),
    walk AS (SELECT path, path AS spot, 0 AS n FROM f UNION ALL
        SELECT path, arg_min(target || substr(spot, length(link) + 1), length(link)), n + 1 FROM walk JOIN l ON spot = link OR starts_with(spot, link || '/') WHERE n < 40 GROUP BY path, spot, n),
    c AS (SELECT path, CASE WHEN max(n) < 40 THEN arg_max(spot, n) END AS spot FROM walk GROUP BY path)"""


def _tree(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    k = (F.col("p_partkey") % 20).cast("string")
    paths = part.select(F.concat(F.lit("/w/p"), k, F.lit("/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".dart")).alias("path")).distinct()
    return part, paths, spark.createDataFrame(_LINKS, "path string, target string")


@query(f"WITH {_TREE} SELECT path, CASE WHEN NOT starts_with(path, '/w/p2/') THEN 'outside-project' WHEN spot IS NULL THEN 'unreadable-path' WHEN NOT starts_with(spot, '/w/p2/') THEN 'symlink-escape' END AS reason FROM c")
def path_boundary(spark, sf_dir):
    """Which paths a scan of one package would not read."""
    _, paths, held = _tree(spark, sf_dir)
    return links.boundary(paths, held, "/w/p2")


@query(f"""WITH {_TREE}, x AS (SELECT path, spot, split_part(path, '/', 3) AS own, split_part(spot, '/', 3) AS real, split_part(spot, '/', 4) AS brand FROM c),
    j AS (SELECT *, CAST(substr(real, 2) AS INT) AS r FROM x WHERE spot LIKE '/w/%'),
    y AS (SELECT x.path, CASE WHEN x.spot IS NULL THEN 'source could not be resolved' WHEN x.own = 'p2' AND x.real <> 'p2' THEN 'source leaves the selected package through a link' WHEN x.own <> 'p2' AND x.real = 'p2' THEN 'source enters the selected package through a link'
        WHEN x.spot NOT LIKE '/w/%' OR (r >= 16 AND r <> 17) THEN 'source is outside every package' WHEN r IN (11, 13) THEN 'several packages claim one root' WHEN r = 14 THEN 'no package description was found'
        WHEN r = 15 THEN 'the configuration differs from the nearest description' WHEN r = 17 THEN 'the selected name stands for another root' WHEN j.brand = 'Brand#3' AND r IN (2, 4) THEN CASE WHEN r = 4 THEN 'the configuration does not claim the owner' END END AS reason, r, j.brand FROM x LEFT JOIN j ON j.path = x.path)
    SELECT path, CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN r = 2 AND brand <> 'Brand#3' THEN 'selected' ELSE 'external' END AS ownership, CASE WHEN reason IS NULL THEN CASE WHEN r = 2 AND brand = 'Brand#3' THEN 'inner' ELSE 'n' || r END END AS package, reason FROM y""")
def source_owners(spark, sf_dir):
    """Whose each source of the tree is: packages are listed up to p15 and p17, p13 twice and p11 also through a link, p14 has no description, p15 and p17 other names, p2 and p4 a package inside."""
    _, paths, held = _tree(spark, sf_dir)
    listed = [(f"n{k}", f"/w/p{k}") for k in range(16)] + [("again", "/w/p13"), ("n2", "/w/p17")]
    described = [(f"/w/p{k}", {15: "other", 17: "n2"}.get(k, f"n{k}")) for k in range(18) if k != 14] + [("/w/p2/Brand#3", "inner"), ("/w/p4/Brand#3", "inner")]
    return links.owners(paths, held, spark.createDataFrame(listed, "name string, root string"), spark.createDataFrame(described, "root string, name string"), "n2", "/w/p2")
