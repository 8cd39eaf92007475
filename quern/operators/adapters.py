"""What the domain adapters resolve: duplicate files, navigation, registrations, messages and consumers of assets.

Every function takes tables of extracted facts and returns edges, blockers or both;
what cannot be decided becomes a blocker, never nothing, unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of files that are never compared, and the folder of dependency packages.
SKIPPED_NAMES = ("pubspec.lock", "Thumbs.db", ".DS_Store")
SKIPPED_SUFFIXES = (".g.dart", ".freezed.dart", ".gr.dart")
PACKAGE_FOLDER = "/.pub-cache/"
#: Hints of asset consumers in the names of owners and methods.
OWNER_HINTS = ("asset", "svg", "lottie", "rive", "video", "audio")
METHOD_HINT = "asset"
#: Language codes that a file name may end with.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fil fj fo fr fy "
    "ga gd gl gn gsw gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()


def _ids(column: str = "id") -> Column:
    return F.array_sort(F.collect_set(column))


def _empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


# Files.


def compared(path: Column) -> Column:
    """Whether a file takes part in the search for duplicates."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    out = ~name.startswith(".") & ~name.isin(*SKIPPED_NAMES)
    for suffix in SKIPPED_SUFFIXES:
        out = out & ~name.endswith(suffix)
    return out


def duplicate_groups(files: DataFrame, package: str) -> DataFrame:
    """path, content -> node_id, digest, copies, waste, paths, protected. Only sizes that occur twice are hashed; groups with a dependency's file are protected."""
    sized = files.where(compared(F.col("path"))).select("path", "content", F.octet_length("content").cast("bigint").alias("size"))
    shared = sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    hashed = sized.join(shared, "size", "left_semi").select("path", "size", F.sha2("content", 256).alias("digest"))
    groups = hashed.groupBy("size", "digest").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("path")).alias("paths"), F.bool_or(F.col("path").contains(PACKAGE_FOLDER)).alias("protected"))
    node = F.concat(F.lit(f"duplicate:{package}:"), F.substring("digest", 1, 12))
    return groups.where("copies > 1").select(node.alias("node_id"), "digest", "copies", ((F.col("copies") - 1) * F.col("size")).alias("waste"), "paths", "protected")


# Navigation.


def route_inventory(routes: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """routes(node_id, full_path, name) -> the lookup tables (path and name to node_id, unique ones only), and blockers.

    A path that two declare blocks the namespace; a name that two hold blocks its holders and leads nowhere.
    """
    paths = routes.groupBy("full_path").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
    names = routes.where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"), _ids("node_id").alias("holders"))
    none = F.lit(None).cast("string")
    stop = paths.where("n > 1").select(F.lit("route path is declared more than once").alias("reason"), F.col("full_path").alias("subject"), F.lit(namespace).alias("affected_namespace"), _empty().alias("affected_node_ids"))
    held = names.where("n > 1").select(F.lit("route name is declared more than once").alias("reason"), F.col("name").alias("subject"), none.alias("affected_namespace"), F.col("holders").alias("affected_node_ids"))
    known = paths.where("n = 1").select(F.lit("path").alias("by"), F.col("full_path").alias("key"), "node_id").unionByName(names.where("n = 1").select(F.lit("name").alias("by"), F.col("name").alias("key"), "node_id"))
    return known, stop.unionByName(held)


def location_path(location: Column) -> Column:
    """The path of a location without query, fragment and closing slash; null unless it begins with a slash."""
    path = F.regexp_replace(location, r"[?#](?s:.*)$", "")
    return F.when(path.startswith("/"), F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path))


def _matches(pattern: Column, parts: Column) -> Column:
    """Whether a pattern's segments fit a path's: those with a colon fit any that is not empty."""
    pairs = F.arrays_zip(pattern.alias("a"), parts.alias("b"))
    return F.forall(pairs, lambda x: F.when(x["a"].startswith(":"), x["b"] != "").otherwise(x["a"] == x["b"]))


def path_candidates(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """asked(location) -> location, path, exact, candidates: the route of just that path, else the routes whose patterns fit.

    Patterns are met by their number of segments and their first one, not one by one.
    """
    paths = asked.select("location").distinct().withColumn("path", location_path(F.col("location")))
    declared = routes.select("node_id", "full_path").withColumn("pattern", F.split("full_path", "/"))
    exact = paths.join(declared.select(F.col("full_path").alias("path"), "node_id"), "path").groupBy("location").agg(_ids("node_id").alias("same"))
    first = F.coalesce(F.get("pattern", F.lit(1)), F.lit(""))
    head = F.when(first.startswith(":"), F.lit(":")).otherwise(first)
    wild = declared.where(F.col("full_path").contains("/:")).select("node_id", "pattern", F.size("pattern").alias("size"), head.alias("head"))
    open_ = paths.where("path is not null").join(exact.select("location"), "location", "left_anti").withColumn("parts", F.split("path", "/"))
    open_ = open_.select("location", "parts", F.size("parts").alias("size"), F.explode(F.array_distinct(F.array(F.coalesce(F.get("parts", F.lit(1)), F.lit("")), F.lit(":")))).alias("head"))
    fits = open_.join(wild, ["size", "head"]).where(_matches(F.col("pattern"), F.col("parts"))).groupBy("location").agg(_ids("node_id").alias("fitting"))
    both = paths.join(exact, "location", "left").join(fits, "location", "left")
    return both.select("location", "path", F.col("same").isNotNull().alias("exact"), F.coalesce("same", "fitting", _empty()).alias("candidates"))


def path_navigations(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """location, outcome, targets: an edge to the one route that fits, a blocker of all that do, or of the namespace if none does or the path is relative."""
    found = path_candidates(asked, routes)
    n = F.size("candidates")
    return found.select("location", F.when(n == 1, "edge").when(n > 1, "id_blocker").otherwise("namespace_blocker").alias("outcome"), F.col("candidates").alias("targets"))


def prefix_candidates(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """asked(prefix) -> prefix, exact, candidates: the route before a question mark, else the routes that may begin so."""
    p = asked.select("prefix").distinct().withColumn("known", F.when(F.col("prefix").contains("?"), F.substring_index("prefix", "?", 1)))
    declared = routes.select("node_id", "full_path")
    same = p.where(F.col("known").startswith("/")).join(declared.select(F.col("full_path").alias("known"), "node_id"), "known").groupBy("prefix").agg(_ids("node_id").alias("same"))
    parts = F.split("prefix", "/")
    open_ = p.where("prefix <> ''").join(same.select("prefix"), "prefix", "left_anti").select("prefix", F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts).alias("parts"))
    # A route offers each of its beginnings: those without a colon as they are, the others, each shape once, under their length and first segment.
    ways = declared.withColumn("pattern", F.split("full_path", "/")).select("node_id", "pattern", F.explode(F.sequence(F.lit(1), F.size("pattern"))).alias("size"))
    ways = ways.select("node_id", F.slice("pattern", 1, F.col("size")).alias("pattern"), "size")
    loose = F.exists("pattern", lambda x: x.startswith(":"))
    plain = open_.join(ways.where(~loose).select(F.col("pattern").alias("parts"), "node_id"), "parts").select("prefix", "node_id")
    heads = F.coalesce(F.get("pattern", F.lit(1)), F.lit(""))
    shapes = ways.where(loose).select("pattern", "size").distinct().withColumn("head", F.when(F.col("size") == 1, F.lit("")).when(heads.startswith(":"), F.lit(":")).otherwise(heads))
    own = F.coalesce(F.get("parts", F.lit(1)), F.lit(""))
    offered = open_.select("prefix", "parts", F.size("parts").alias("size"), F.explode(F.when(F.size("parts") == 1, F.array(F.lit(""))).otherwise(F.array_distinct(F.array(own, F.lit(":"))))).alias("head"))
    fits = F.forall(F.arrays_zip(F.col("pattern").alias("a"), F.col("parts").alias("b")), lambda x: x["a"].startswith(":") | (x["a"] == x["b"]))
    shaped = offered.join(shapes, ["size", "head"]).where(fits).select("prefix", "pattern").join(ways.where(loose).select("pattern", "node_id"), "pattern").select("prefix", "node_id")
    met = plain.unionByName(shaped).groupBy("prefix").agg(_ids("node_id").alias("fitting"))
    both = p.join(same, "prefix", "left").join(met, "prefix", "left")
    return both.select("prefix", F.col("same").isNotNull().alias("exact"), F.coalesce("same", "fitting", _empty()).alias("candidates"))


def prefix_outcomes(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """prefix, outcome, targets: an edge if the path before the query is a route, a blocker of what may begin so, or of the namespace."""
    found = prefix_candidates(asked, routes)
    outcome = F.when(F.col("exact"), "edge").when(F.size("candidates") > 0, "id_blocker").otherwise("namespace_blocker")
    return found.select("prefix", outcome.alias("outcome"), F.col("candidates").alias("targets"))


def dynamic_navigations(asked: DataFrame, routes: DataFrame, names: DataFrame) -> DataFrame:
    """Calls on receivers of unknown type: asked(nav_id, by_name, value) -> nav_id, outcome, targets. Their candidates are blocked, else the namespace; never an edge."""
    by_name = asked.where("by_name").join(names.select(F.col("name").alias("value"), "node_id"), "value", "left").select("nav_id", F.when(F.col("node_id").isNotNull(), F.array("node_id")).otherwise(_empty()).alias("targets"))
    found = path_candidates(asked.where("not by_name and value is not null").select(F.col("value").alias("location")), routes)
    by_path = asked.where("not by_name").join(found.select(F.col("location").alias("value"), "candidates"), "value", "left").select("nav_id", F.coalesce("candidates", _empty()).alias("targets"))
    both = by_name.unionByName(by_path)
    return both.select("nav_id", F.when(F.size("targets") > 0, "id_blocker").otherwise("namespace_blocker").alias("outcome"), "targets")


# Registrations.


def registration_inventory(rows: DataFrame, mutations: DataFrame) -> DataFrame:
    """rows(id, type, name, dynamic_name, scope) -> id, type, name, uncertain.

    If anything changes the container while the program runs, no scope is known; only constant names in the base scope can be looked up.
    """
    moving = mutations.agg((F.count("*") > 0).alias("moving"))
    base = F.coalesce(F.col("scope") == "base", F.lit(False))
    # One row.
    return rows.crossJoin(F.broadcast(moving)).select("id", "type", "name", (F.col("dynamic_name") | ~base | F.col("moving")).alias("uncertain"))


def registration_lookups(requests: DataFrame, registrations: DataFrame) -> DataFrame:
    """requests(request_id, type, name, dynamic_name) -> request_id, candidates, outcome, target, affected (how many registrations a blocker has).

    A dynamic name blocks all of the type; so does any uncertain registration of the type, together with the candidates; null is the name of the unnamed.
    """
    sure = registrations.where("not uncertain").groupBy("type", "name").agg(F.count("*").alias("candidates"), F.min("id").alias("first_id"))
    by_type = registrations.groupBy("type").agg(F.count("*").alias("of_type"), F.count_if("uncertain").alias("doubtful"))
    met = requests.join(by_type, "type", "left").join(sure.withColumnRenamed("type", "t").withColumnRenamed("name", "k"), (F.col("type") == F.col("t")) & F.col("name").eqNullSafe(F.col("k")), "left")
    n, of_type, doubtful = (F.coalesce(c, F.lit(0)) for c in ("candidates", "of_type", "doubtful"))
    dynamic = F.col("dynamic_name")
    outcome = F.when(dynamic & (of_type > 0), "type_blocker").when(dynamic, "namespace_blocker").when(doubtful > 0, "id_blocker").when(n == 0, "namespace_blocker").when(n == 1, "edge").otherwise("id_blocker")
    affected = F.when(dynamic, of_type).when(doubtful > 0, n + doubtful).when(n > 1, n).otherwise(0)
    return met.select("request_id", F.when(dynamic, 0).otherwise(n).alias("candidates"), outcome.alias("outcome"), F.when(~dynamic & (doubtful == 0) & (n == 1), F.col("first_id")).alias("target"), affected.alias("affected"))


def registration_dependencies(needs: DataFrame, registrations: DataFrame) -> DataFrame:
    """needs(id, type, name) -> id, type, name, outcome, targets: an edge if one registration fits and none of the type is uncertain, else a blocker of all of these and itself."""
    fit = registrations.where("not uncertain").select(F.col("id").alias("other"), F.col("type").alias("t"), F.col("name").alias("k"))
    sure = needs.join(fit, (F.col("type") == F.col("t")) & F.col("name").eqNullSafe(F.col("k")), "left").groupBy("id", "type", "name").agg(_ids("other").alias("sure"))
    doubt = registrations.where("uncertain").groupBy(F.col("type").alias("dt")).agg(_ids("id").alias("doubt"))
    met = sure.join(doubt, F.col("type") == F.col("dt"), "left").withColumn("doubt", F.coalesce("doubt", _empty()))
    one = (F.size("sure") == 1) & (F.size("doubt") == 0)
    return met.select("id", "type", "name", F.when(one, "edge").otherwise("id_blocker").alias("outcome"), F.when(one, F.col("sure")).otherwise(F.array_sort(F.array_union(F.array_union(F.array("id"), "sure"), "doubt"))).alias("targets"))


# Messages.


def locale_syntax(text: Column) -> Column:
    """language[_Script][_REGION] in normal case; null for anything else."""
    parts = F.split(text, "[-_]")
    language, second, third = F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    is_script = F.coalesce(second.rlike("^[A-Za-z]{4}$"), F.lit(False))
    place = F.when(is_script, third).otherwise(second)
    ok = language.rlike("^[a-z]{2,3}$") & F.coalesce(place.rlike("^([A-Za-z]{2}|[0-9]{3})$"), F.lit(True)) & (F.size(parts) <= F.when(is_script, 3).otherwise(2))
    return F.when(F.coalesce(ok, F.lit(False)), F.concat_ws("_", language, F.when(is_script, F.initcap(second)), F.upper(place)))


def file_locale(stem: Column) -> Column:
    """The locale that a file name is or ends with: the longest such end whose language is known."""
    parts = F.split(stem, "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: locale_syntax(F.array_join(F.slice(parts, n, F.size(parts)), "_")))
    return F.get(F.filter(ends, lambda x: F.coalesce(F.substring_index(x, "_", 1).isin(*LANGUAGES), F.lit(False))), F.lit(0))


def document_locale(stem: Column, declared: Column) -> tuple[Column, Column]:
    """The locale of a message file and, if it cannot be told, the reason."""
    named = file_locale(stem)
    fine = F.when(declared.isNull(), named).when(named.isNull() | (named == declared), declared)
    differ = F.concat(F.lit("ARB filename locale "), named, F.lit(" differs from @@locale "), declared)
    return fine, F.when(fine.isNotNull(), None).when(declared.isNotNull(), differ).otherwise(F.lit("ARB filename locale could not be determined safely"))


def placeholders(message: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(r"\{\s*([A-Za-z_]\w*)\s*(?:\}|,)"), F.lit(1))))


def message_inventory(messages: DataFrame, declared: DataFrame) -> DataFrame:
    """messages(path, locale, is_template, key, message), declared(key, names) -> key, member (method or getter), missing: the locales that lack it, comma-joined.

    A message with placeholders, or whose metadata declares some, becomes a method. Of several files of one locale the first path counts.
    """
    accepted = messages.where("not is_template").groupBy("locale").agg(F.min("path").alias("path"))
    own = messages.where("is_template").join(declared, "key", "left")
    keys = own.select("key", F.when((F.size(F.coalesce("names", _empty())) > 0) | (F.size(placeholders(F.col("message"))) > 0), "method").otherwise("getter").alias("member"))
    held = messages.join(accepted, ["locale", "path"], "left_semi").groupBy("key").agg(F.collect_set("locale").alias("held"))
    # Locales are few; they go along as one row.
    every = accepted.agg(F.array_sort(F.collect_list("locale")).alias("all"))
    out = keys.join(held, "key", "left").crossJoin(F.broadcast(every))
    return out.select("key", "member", F.array_join(F.array_except("all", F.coalesce("held", _empty())), ",").alias("missing"))


def message_issues(messages: DataFrame) -> DataFrame:
    """kind, locale, path, key of what is wrong: files of a locale that has one, keys that no template has, placeholders that differ from the template's."""
    accepted = messages.where("not is_template").groupBy("locale").agg(F.min("path").alias("first"))
    files = messages.where("not is_template").select("locale", "path").distinct().join(accepted, "locale")
    again = files.where("path <> first").select(F.lit("duplicate_locale").alias("kind"), "locale", "path", F.lit(None).cast("string").alias("key"))
    good = messages.where("not is_template").join(accepted, "locale").where("path = first").drop("first")
    template = messages.where("is_template").select("key", F.col("message").alias("wanted"))
    met = good.join(template, "key", "left")
    alone = met.where("wanted is null").select(F.lit("locale_only_key").alias("kind"), "locale", "path", "key")
    differ = met.where(placeholders(F.col("message")) != placeholders(F.col("wanted"))).select(F.lit("placeholders_differ").alias("kind"), "locale", "path", "key")
    return again.unionByName(alone).unionByName(differ)


def message_members(keys: DataFrame, members: DataFrame) -> DataFrame:
    """keys(key, member), members(name, shape, declared_here) -> key, outcome: member, missing, ambiguous or foreign. All but the first block the key's node."""
    held = members.groupBy(F.col("name").alias("key")).agg(
        F.count_if(F.col("shape") == "getter").alias("getters"), F.count_if(F.col("shape") == "method").alias("methods"), F.bool_and("declared_here").alias("here")
    )
    right = F.coalesce(F.when(F.col("member") == "getter", F.col("getters")).otherwise(F.col("methods")), F.lit(0))
    wrong = F.coalesce(F.when(F.col("member") == "getter", F.col("methods")).otherwise(F.col("getters")), F.lit(0))
    outcome = F.when(right == 0, "missing").when((right > 1) | (wrong > 0), "ambiguous").when(~F.col("here"), "foreign").otherwise("member")
    return keys.join(held, "key", "left").select("key", outcome.alias("outcome"))


def auxiliary_issue_blockers(references: DataFrame, retained: DataFrame, proven: DataFrame, issues: DataFrame) -> DataFrame:
    """reference_id, reason: references(reference_id, path) out of units that an auxiliary context with issues(context, code, reason) retains but does not prove."""
    doubt = retained.join(proven, ["context", "path"], "left_anti").join(issues, "context")
    reason = F.concat(F.col("code"), F.lit(" ["), "context", F.lit("]: "), "reason")
    return references.join(doubt, "path").select("reference_id", reason.alias("reason")).distinct()


# Consumers of assets.


def consumer_hint(owner: Column, method: Column) -> Column:
    """Whether the names of an unknown API speak of assets."""
    out = F.coalesce(F.lower(method).contains(METHOD_HINT), F.lit(False))
    for hint in OWNER_HINTS:
        out = out | F.coalesce(F.lower(owner).contains(hint), F.lit(False))
    return out


def unrecognised_consumers(uses: DataFrame, assets: DataFrame, namespace: str) -> DataFrame:
    """uses(use_id, owner, method, complete, possible) -> use_id, outcome, targets.

    Values of unknown origin block the namespace; known assets among the possible values are blocked; else a name that speaks of assets blocks the namespace, and any other use nothing.
    """
    hit = uses.where("complete").select("use_id", F.explode("possible").alias("key")).join(assets.select("key", "node_id"), "key").groupBy("use_id").agg(_ids("node_id").alias("targets"))
    met = uses.join(hit, "use_id", "left")
    outcome = F.when(~F.col("complete"), "namespace_blocker").when(F.col("targets").isNotNull(), "id_blocker").when(consumer_hint(F.col("owner"), F.col("method")), "namespace_blocker")
    out = met.select("use_id", outcome.alias("outcome"), F.coalesce("targets", _empty()).alias("targets"), F.when(outcome == "namespace_blocker", F.lit(namespace)).alias("affected_namespace"))
    return out.where("outcome is not null")
