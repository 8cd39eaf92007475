"""Registered queries of expressions given as rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import QUERIES, _read, query
from quern.operators import expressions
from quern.plans.materialise import cut

__all__ = ["QUERIES"]


def _text(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _asset_expressions(spark, sf_dir):
    """Suppliers as variables, written by the first lines of orders; orders with such a line as the expressions that use them.

    A supplier's values come from 50, 66 or 80 names, so some have more than the bound; every ninth part's name
    is not known, and supplier 7 also refers to itself. The kind of an order's expression goes by its key.
    """
    line, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    first = cut(line.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")))
    of = cut(orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_suppkey"))
    name = F.concat(F.lit("img/"), (F.col("l_partkey") % F.expr("array(50, 66, 80)[l_suppkey % 3]")).cast("string"))
    literals = first.select(_text("d:", "l_orderkey").alias("id"), F.lit("literal").alias("kind"), F.when((F.col("l_suppkey") % 4 != 0) | (F.col("l_partkey") % 9 != 0), name).alias("text"))
    variables = first.select(_text("v:", "l_suppkey").alias("id"), F.lit("reference").alias("kind"), F.lit(None).cast("string").alias("text")).distinct()
    kind = F.expr("array('plus', 'conditional', 'interpolation', 'parens', 'call')[o_orderkey % 5]")
    uses = of.select(_text("o:", "o_orderkey").alias("id"), kind.alias("kind"), F.lit(None).cast("string").alias("text"))
    fixed = spark.createDataFrame([("base", "literal", "assets/a+b/"), ("png", "literal", ".png")], "id string, kind string, text string")
    writes = first.select(_text("v:", "l_suppkey").alias("id"), F.col("l_orderkey").cast("bigint").alias("position"), _text("d:", "l_orderkey").alias("operand"))
    ring = spark.createDataFrame([("v:7", -1, "v:7")], "id string, position bigint, operand string")
    kinds = F.expr("array(array('base', v), array('base', v), array('base', v, 'png'), array(v), array(v))[o_orderkey % 5]")
    takes = of.withColumn("v", _text("v:", "l_suppkey")).select(_text("o:", "o_orderkey").alias("id"), F.posexplode(kinds).alias("position", "operand")).select("id", F.col("position").cast("bigint").alias("position"), "operand")
    return literals.unionByName(variables).unionByName(uses).unionByName(fixed), writes.unionByName(ring).unionByName(takes)


_ASSETS = """
    line1 AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_suppkey % 4 <> 0 OR l_partkey % 9 <> 0 THEN 'img/' || (l_partkey % CASE l_suppkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 66 ELSE 80 END) END AS text FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, text ORDER BY l_orderkey) = 1 AS is_new FROM line1),
    before AS (SELECT *, coalesce(sum(is_new::INT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM firsts),
    vars AS (SELECT l_suppkey, CASE WHEN l_suppkey <> 7 AND count(*) = count(text) AND max(held) < 64 THEN list_sort(list(DISTINCT text)) END AS v FROM before GROUP BY l_suppkey),
    used AS (SELECT o_orderkey, o_orderkey % 5 AS k, v FROM orders JOIN line1 ON l_orderkey = o_orderkey JOIN vars USING (l_suppkey)),
    sets AS (SELECT o_orderkey, k, CASE k WHEN 0 THEN list_transform(v, lambda x: 'assets/a+b/' || x) WHEN 1 THEN CASE WHEN v IS NOT NULL THEN list_sort(list_append(v, 'assets/a+b/')) END
        WHEN 2 THEN list_transform(v, lambda x: 'assets/a+b/' || x || '.png') WHEN 3 THEN v END AS exact FROM used)"""


@query(f"WITH {_ASSETS} SELECT 'o:' || o_orderkey AS id, array_to_string(exact, ',') AS exact, CASE WHEN exact IS NULL THEN -1 ELSE len(exact) END AS n FROM sets")
def bounded_strings(spark, sf_dir):
    nodes, operands = _asset_expressions(spark, sf_dir)
    found = expressions.exact_values(nodes, operands).where("id like 'o:%'")
    return found.select("id", F.array_join("exact", ",").alias("exact"), F.coalesce(F.size("exact"), F.lit(-1)).cast("bigint").alias("n"))


@query(rf"""WITH {_ASSETS} SELECT 'o:' || o_orderkey AS id, '^' || CASE WHEN len(exact) = 1 THEN regexp_replace(exact[1], '([+.])', '\\\1', 'g') WHEN k = 0 THEN 'assets/a\+b/.*' ELSE 'assets/a\+b/.*\.png' END || '$' AS pattern
    FROM sets WHERE len(exact) = 1 OR k IN (0, 2)""")
def string_patterns(spark, sf_dir):
    nodes, operands = _asset_expressions(spark, sf_dir)
    found = expressions.patterns(nodes, operands, expressions.exact_values(nodes, operands))
    return found.where("id like 'o:%' AND pattern is not null")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey, count(DISTINCT l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
    SELECT 'o:' || o_orderkey AS id, least(CASE WHEN o_orderkey % 400 = 0 THEN 1200 ELSE 0 END + lines + 1, 1024) AS nested, CASE WHEN o_orderkey % 400 = 0 THEN 1200 ELSE 0 END + lines + 1 <= 1024 AS complete FROM n""")
def expression_provenance(spark, sf_dir):
    line, orders = cut(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()), _read(spark, sf_dir, "orders")
    # An order's argument holds its lines; some hold 1,200 more, and lines that are calls hold a part that does not count.
    root = orders.select(_text("o:", "o_orderkey").alias("id"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("text"))
    leaf = line.select(F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_linenumber") == 2, "call").otherwise("literal").alias("kind"), F.lit(None).cast("string").alias("text"))
    inner = line.where("l_linenumber = 2").select(_text("c:", "l_orderkey").alias("id"), F.lit("literal").alias("kind"), F.lit(None).cast("string").alias("text"))
    large = orders.where("o_orderkey % 400 = 0").select("o_orderkey", F.explode(F.sequence(F.lit(100), F.lit(1_299))).alias("l_linenumber"))
    more = large.select(F.concat_ws(":", F.lit("l"), "o_orderkey", "l_linenumber").alias("id"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("text"))
    at = line.select("l_orderkey", "l_linenumber").unionByName(large.withColumnRenamed("o_orderkey", "l_orderkey"))
    holds = at.select(_text("o:", "l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber").alias("operand"))
    called = line.where("l_linenumber = 2").select(F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber").alias("id"), F.lit(0).alias("position"), _text("c:", "l_orderkey").alias("operand"))
    return expressions.provenance(root.unionByName(leaf).unionByName(inner).unionByName(more), holds.unionByName(called)).where("id like 'o:%'")


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey % 6 AS kind, c_nationkey AS n FROM customer),
    nation_text AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '/' || n_name END AS exact FROM nation)
    SELECT 'c:' || k AS use_id,
        CASE kind WHEN 0 THEN exact WHEN 1 THEN '/shop' || exact WHEN 2 THEN CASE WHEN exact IS NOT NULL THEN '/c' || exact || '/end' END WHEN 3 THEN NULL WHEN 4 THEN '/x/' || (k % 7) || '/x/' || (k % 7) ELSE CASE WHEN k % 12 = 5 THEN repeat('a', 23) END END AS exact,
        CASE kind WHEN 0 THEN exact WHEN 1 THEN '/shop' || coalesce(exact, '') WHEN 2 THEN '/c' || coalesce(exact || '/end', '') WHEN 3 THEN 'ab' WHEN 4 THEN '/x/' || (k % 7) || '/x/' || (k % 7) ELSE CASE WHEN k % 12 = 5 THEN repeat('a', 23) ELSE repeat('a', 22) END END AS prefix
    FROM p JOIN nation_text USING (n)""")
def static_strings(spark, sf_dir):
    """Customers ask for strings over their nation: alone, after a start, between two parts, of two variables that need each other, of a call, and of sums 23 and 25 levels deep."""
    customer, nation = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    n_ref, none = _text("n:", "c_nationkey"), F.lit(None).cast("string")
    k = F.col("c_custkey")
    kind = F.expr("array('reference', 'plus', 'interpolation', 'reference', 'call', 'reference')[c_custkey % 6]")
    text = F.expr("CASE c_custkey % 6 WHEN 0 THEN concat('n:', c_nationkey) WHEN 3 THEN 'ring:a' WHEN 4 THEN 'twice' WHEN 5 THEN IF(c_custkey % 12 = 5, 'deep:1', 'deep:0') END")
    use = customer.select(_text("c:", "c_custkey").alias("id"), kind.alias("kind"), text.alias("text"))
    refs = nation.select(_text("ref:", "n_nationkey").alias("id"), F.lit("reference").alias("kind"), _text("n:", "n_nationkey").alias("text"))
    args = customer.where(k % 6 == 4).select(_text("arg:", "c_custkey").alias("id"), F.lit("literal").alias("kind"), F.concat(F.lit("/x/"), (k % 7).cast("string")).alias("text"))
    fixed = [("shop", "literal", "/shop"), ("start", "literal", "/c"), ("end", "literal", "/end"), ("a", "literal", "a"), ("b", "literal", "b"), ("ring:1", "plus", None), ("ring:2", "plus", None), ("to:a", "reference", "ring:a"), ("to:b", "reference", "ring:b"), ("pair", "adjacent", None), ("param", "reference", "p"), ("param2", "reference", "p")]
    takes = [("ring:1", 0, "a"), ("ring:1", 1, "to:b"), ("ring:2", 0, "b"), ("ring:2", 1, "to:a"), ("pair", 0, "param"), ("pair", 1, "param2")]
    for j in range(30):
        fixed.append((f"sum:{j}", "plus", None))
        takes += [(f"sum:{j}", 0, "a"), (f"sum:{j}", 1, f"sum:{j + 1}" if j < 22 else "a" if j == 22 else f"sum:{j + 1}")]
    for j in range(40):
        fixed.append((f"long:{j}", "plus", None))
        takes += [(f"long:{j}", 0, "a"), (f"long:{j}", 1, f"long:{j + 1}" if j < 39 else "a")]
    nodes = use.unionByName(refs).unionByName(args).unionByName(spark.createDataFrame(fixed, "id string, kind string, text string"))
    held = customer.where((k % 6).isin(1, 2)).select(_text("c:", "c_custkey").alias("id"), F.posexplode(F.when(k % 6 == 1, F.array(F.lit("shop"), _text("ref:", "c_nationkey"))).otherwise(F.array(F.lit("start"), _text("ref:", "c_nationkey"), F.lit("end")))).alias("position", "operand"))
    operands = held.unionByName(spark.createDataFrame(takes, "id string, position int, operand string"))
    elements = nation.select(_text("n:", "n_nationkey").alias("element"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("/"), "n_name")).alias("constant"), none.alias("source"))
    elements = elements.unionByName(spark.createDataFrame([("ring:a", None, "ring:1"), ("ring:b", None, "ring:2"), ("twice", None, "pair"), ("deep:0", None, "long:0"), ("deep:1", None, "sum:1")], "element string, constant string, source string"))
    arguments = customer.where(k % 6 == 4).select(_text("c:", "c_custkey").alias("call"), F.lit("p").alias("parameter"), _text("arg:", "c_custkey").alias("argument"))
    return expressions.static_strings(customer.select(_text("c:", "c_custkey").alias("use_id"), _text("c:", "c_custkey").alias("expr")), nodes, operands, elements, arguments)


_ENCODED = "translate(to_base64(encode({})), '+/', '-_')"


@query(f"""WITH lineitem AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), leaf AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 <> 0 THEN 'interface|' || {_ENCODED.format("'package:s' || (l_suppkey % 7) || '/s.dart'")} || '|' || {_ENCODED.format("'Supplier' || (l_suppkey % 11)")} || '|nullable|0' END AS key FROM lineitem),
    mid AS (SELECT l.l_orderkey, l.l_linenumber, 'interface|' || {_ENCODED.format("'package:p/p.dart'")} || '|' || {_ENCODED.format("p_brand")} || '|' || CASE WHEN l_returnflag = 'N' THEN 'nonNullable' ELSE 'legacy' END || '|1|' || {_ENCODED.format("key")} AS key
        FROM lineitem l JOIN leaf USING (l_orderkey, l_linenumber) JOIN part ON p_partkey = l_partkey),
    top AS (SELECT l_orderkey, count(*) = count(key) AS whole, 'interface|' || {_ENCODED.format("'dart:core'")} || '|' || {_ENCODED.format("'Record'")} || '|nonNullable|' || count(*) || '|' || string_agg({_ENCODED.format("key")}, '|' ORDER BY l_linenumber) AS key FROM mid GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN o_orderkey % 40 <> 0 AND whole THEN key END AS type_key FROM orders JOIN top ON l_orderkey = o_orderkey""")
def type_keys(spark, sf_dir):
    """Each order is a type whose arguments are its lines, each with one argument of its own; some libraries are files, some types dynamic."""
    line, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    line = line.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    order, at = _text("o:", "l_orderkey"), F.concat_ws(":", F.lit("l"), "l_orderkey", "l_linenumber")
    col = lambda c, name: (F.lit(c) if isinstance(c, str) else c).alias(name)
    lines = cut(line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"))
    top = lines.select(order.alias("id"), "l_orderkey").distinct().select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("position"), col("interface", "kind"), F.when(F.col("l_orderkey") % 40 == 0, "file:///tmp/a.dart").otherwise("dart:core").alias("library"), col("Record", "name"), col("nonNullable", "nullability"))
    mid = lines.select(at.alias("id"), order.alias("parent"), F.col("l_linenumber").alias("position"), col("interface", "kind"), col("package:p/p.dart", "library"), F.col("p_brand").alias("name"), F.when(F.col("l_returnflag") == "N", "nonNullable").otherwise("legacy").alias("nullability"))
    supplier = F.col("l_suppkey")
    leaf = lines.select(F.concat(F.lit("s"), at).alias("id"), at.alias("parent"), F.lit(0).alias("position"), F.when(supplier % 50 == 0, "dynamic").otherwise("interface").alias("kind"), F.concat(F.lit("package:s"), (supplier % 7).cast("string"), F.lit("/s.dart")).alias("library"), F.concat(F.lit("Supplier"), (supplier % 11).cast("string")).alias("name"), col("nullable", "nullability"))
    found = expressions.type_keys(top.unionByName(mid).unionByName(leaf)).where("id like 'o:%'")
    return found.select(F.substring("id", 3, 30).cast("bigint").alias("o_orderkey"), "type_key")
