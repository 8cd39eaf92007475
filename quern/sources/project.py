"""Sources of facts: files, machine logs, message catalogues and package lists, as DataFrames.

Line and column positions are found with prefix sums in the engine; files are read
as text by the executors, never by the driver.
"""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.conditions import generated_path
from quern.operators.adapters import document_locale, locale_syntax
from quern.operators.catalogues import exclusion_reason, repeated_json_keys
from quern.operators.closure import closure
from quern.plans.materialise import cut

#: Platforms of targets.
PLATFORMS = ("android", "ios", "web", "macos", "linux", "windows")


def files(spark: SparkSession, folder: str, content: bool = False, **rules) -> DataFrame:
    """path (below the folder), size_bytes[, content] of all files that no rule excludes. Content is read only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_replace("path", r"^.*?" + _quoted(folder.rstrip("/")) + "/", "")
    out = rows.select(below.alias("path"), F.col("length").alias("size_bytes"), *(["content"] if content else []))
    return out.where(exclusion_reason(F.col("path"), **rules).isNull())


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://", 1)[-1].lstrip("/") + "\\E"


def machine_log(lines: DataFrame) -> DataFrame:
    """value -> severity, type, code, path, line, column, length, message of well-formed lines: eight fields or more, by bars."""
    f = F.split("value", r"\|")
    number = lambda i: F.expr(f"try_cast(f[{i}] AS int)")
    rows = lines.withColumn("f", f).where(F.size("f") >= 8)
    named = rows.select(
        F.col("f")[0].alias("severity"), F.col("f")[1].alias("type"), F.lower(F.col("f")[2]).alias("code"), F.col("f")[3].alias("path"),
        number(4).alias("line"), number(5).alias("column"), number(6).alias("length"), F.array_join(F.expr("slice(f, 8, size(f))"), "|").alias("message"),
    )
    return named.where("line >= 1 and column >= 1 and length >= 0")


def line_offsets(sources: DataFrame) -> DataFrame:
    """path, text -> path, line, offset, size: where each line begins, in characters."""
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("n", "body")).select("path", (F.col("n") + 1).alias("line"), F.length("body").alias("size"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("path", "line", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).alias("offset"), "size")


def diagnostics(log: DataFrame, sources: DataFrame, codes: list[str]) -> DataFrame:
    """The log's lines of these codes with their offset in the source; lines beyond the text are dropped."""
    wanted = log.where(F.col("code").isin(*codes))
    ends = sources.select("path", F.length("text").alias("total"))
    placed = wanted.join(line_offsets(sources), ["path", "line"]).join(ends, "path")
    return placed.withColumn("offset", F.col("offset") + F.col("column") - 1).where("offset <= total").drop("size", "total")


def messages(documents: DataFrame, template: str) -> tuple[DataFrame, DataFrame]:
    """path, text of JSON message files -> messages(key, locale, is_template, message), and issues(path, key, reason).

    The locale is the file's own, else the longest end of its name that a known language begins. A file that can't be read as a whole
    gives one issue and no messages; a message or its description that breaks a rule gives one, and the file's other messages stay.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rows = documents.select("path", "text", repeated_json_keys(F.col("text")).alias("again"), F.expr("try_parse_json(text)").alias("whole"), stem.alias("stem"))
    kind = _kind(F.col("whole"))
    rows = rows.withColumn("declared_text", F.when(kind == "OBJECT", F.expr("try_variant_get(whole, '$.@@locale', 'string')")))
    fine, reason = document_locale(F.col("stem"), locale_syntax(F.trim("declared_text")))
    bad = F.when(F.size("again") > 0, "repeated keys").when(F.col("whole").isNull(), "malformed JSON").when(kind != "OBJECT", "not an object").otherwise(reason)
    judged = cut(rows.withColumns({"locale": fine, "reason": bad}))
    good = judged.where("reason is null").select("path", "locale", (F.col("path") == template).alias("is_template"), F.explode(F.from_json("text", "map<string,variant>")).alias("key", "value"))
    good = good.withColumn("kind", _kind(F.col("value")))
    told = good.where(~F.col("key").startswith("@"))
    said = told.where("kind = 'STRING'").select("path", "key", "locale", "is_template", F.expr("variant_get(value, '$', 'string')").alias("message"))
    wrong = told.where("kind <> 'STRING'").select("path", "key", F.lit("message must have a string value").alias("reason"))
    about = good.where(F.col("key").startswith("@") & ~F.col("key").startswith("@@")).withColumn("key", F.substring("key", 2, 1 << 30))
    known = said.select("path", F.col("key").alias("of"), F.lit(True).alias("has"))
    about = about.join(known, (about["path"] == known["path"]) & (F.col("key") == F.col("of")), "left").select(about["path"], "key", _metadata_problem().alias("reason")).where("reason is not null")
    whole = judged.where("reason is not null").select("path", F.lit(None).cast("string").alias("key"), "reason")
    return said.select("key", "locale", "is_template", "message"), whole.unionByName(wrong).unionByName(about)


def _kind(value: Column) -> Column:
    """The kind of a JSON value: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's."""
    return F.regexp_extract(F.call_function("schema_of_variant", value), "^[A-Z]+", 0)


def _metadata_problem() -> Column:
    """What is wrong with the description ``value`` of the message ``key``, or null."""
    at = lambda c, k: F.expr(f"try_variant_get({c}, '$.{k}', 'variant')")
    description, names = at("value", "description"), at("value", "placeholders")
    held = F.map_values(F.coalesce(F.expr("try_cast(try_variant_get(value, '$.placeholders', 'map<string,variant>') AS map<string,variant>)"), F.create_map().cast("map<string,variant>")))

    def text(v):
        return F.when(_kind(v) == "STRING", F.trim(F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))))

    def has(v, k):
        return F.call_function("try_variant_get", v, F.lit(f"$.{k}"), F.lit("variant"))

    def broken(v):
        out = F.lit(False)
        for k in ("example", "type", "format"):
            out = out | has(v, k).isNotNull() & (F.coalesce(text(has(v, k)), F.lit("")) == "")
        custom, more = has(v, "isCustomDateFormat"), has(v, "optionalParameters")
        out = out | custom.isNotNull() & (_kind(custom) != "BOOLEAN") & ~F.coalesce(text(custom).isin("true", "false"), F.lit(False))
        nulls = F.regexp_replace(F.to_json(more), r'"(?:[^"\\]|\\.)*"', '""').rlike(r"[:\[,]null\b")
        return out | more.isNotNull() & ((_kind(more) != "OBJECT") | nulls)

    shaped = names.isNull() | (_kind(names) == "OBJECT") & ~F.exists(held, lambda v: _kind(v) != "OBJECT")
    return (
        F.when((F.col("key") == "") | (F.col("kind") != "OBJECT"), "metadata must be a JSON object")
        .when(description.isNotNull() & ~_kind(description).isin("STRING", "VOID"), "metadata description must be a string")
        .when(~shaped, "metadata placeholders must map names to objects")
        .when(F.exists(held, broken), "an attribute of a placeholder is not valid")
        .when(F.col("has").isNull(), "metadata has no matching message")
    )


def packages(documents: DataFrame) -> DataFrame:
    """text of package lists (version 2) -> name, root. A list with another version, a repeated or empty name is unusable as a whole."""
    schema = "configVersion int, packages array<struct<name:string,rootUri:string,packageUri:string>>"
    read = documents.select(F.from_json("text", schema).alias("c"))
    names = F.transform("c.packages", lambda p: p["name"])
    fine = (F.col("c.configVersion") == 2) & (F.size(names) == F.size(F.array_distinct(names))) & F.forall(F.col("c.packages"), lambda p: F.coalesce(F.length(p["name"]) > 0, F.lit(False)) & p["rootUri"].isNotNull())
    return read.where(F.coalesce(fine, F.lit(False))).select(F.explode("c.packages").alias("p")).select("p.name", F.col("p.rootUri").alias("root"))


def declared_assets(listing: DataFrame, declared: DataFrame) -> DataFrame:
    """listing(path, size_bytes), declared(entry) -> path, size_bytes: files named, and direct children of folders named."""
    parent = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    either = listing.withColumn("entry", F.explode(F.array_distinct(F.array(F.col("path"), parent))))
    return either.join(declared.select("entry").distinct(), "entry", "left_semi").select("path", "size_bytes").distinct()


#: Folders of Dart sources, and folders that a walk along imports leaves out.
SOURCE_FOLDERS = ("lib", "bin", "test", "integration_test", "test_driver", "benchmark", "tool", "example")
#: Keys that the SDK defines for every target begin so.
SDK_PREFIX = "dart.library."


def dart_sources(paths: DataFrame, **rules) -> DataFrame:
    """path of the Dart files below the standard folders, without hidden segments and excluded paths."""
    parts = F.split("path", "/")
    shown = ~F.exists(parts, lambda x: x.startswith("."))
    return paths.where(F.get(parts, F.lit(0)).isin(*SOURCE_FOLDERS) & (F.size(parts) > 1) & F.col("path").endswith(".dart") & shown & exclusion_reason(F.col("path"), **rules).isNull()).select("path")


def deep_links(files: DataFrame, targets: DataFrame) -> DataFrame:
    """source: what lets an address outside activate a route: files(path, text: null if unreadable) and web targets(name, platform). An unreadable file counts."""
    path, name = F.col("path"), F.substring_index("path", "/", -1)
    has = lambda *texts: [F.col("text").contains(t) for t in texts]
    verified, view, scheme = has('autoVerify="true"', "android.intent.action.VIEW", "android:scheme")
    domains, schemes = has("com.apple.developer.associated-domains", "CFBundleURLSchemes")
    apple = path.startswith("ios/") | path.startswith("macos/")
    rules = F.when(path.startswith("android/app/src/") & (name == "AndroidManifest.xml"), verified | (view & scheme)).when(apple & path.endswith(".entitlements"), domains).when(apple & (name == "Info.plist"), schemes)
    asked = (path.startswith("android/app/src/") & (name == "AndroidManifest.xml")) | (apple & (path.endswith(".entitlements") | (name == "Info.plist")))
    found = files.where(asked & F.coalesce(rules, F.lit(True))).select(path.alias("source"))
    web = targets.where("platform = 'web'").select(F.concat(F.lit("target:"), "name", F.lit(":web")).alias("source"))
    return found.unionByName(web).distinct()


def native_targets(lines: DataFrame) -> DataFrame:
    """lines(path, n, line) of build files -> path, flavor, entrypoint: the target that each product flavor's block names, the last one if it names several.

    Where a line stands is told by the braces before it: flavors open one level inside productFlavors, their settings at least one more.
    """
    w = Window.partitionBy("path").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    text = F.trim("line")
    opens, closes = (F.length("line") - F.length(F.replace("line", F.lit(c), F.lit(""))) for c in "{}")
    rows = lines.withColumn("text", text).withColumn("depth", F.coalesce(F.sum(opens - closes).over(before), F.lit(0)))
    begins = F.col("text").rlike(r"^productFlavors\b") & F.col("text").contains("{")
    rows = rows.withColumn("level", F.last(F.when(begins, F.col("depth") + 1), ignorenulls=True).over(before))
    made, plain = (F.regexp_extract("text", r"""^(?:create\(["']([^"']+)["']\)|([A-Za-z_][\w-]*))\s*\{""", k) for k in (1, 2))
    name = F.when((F.col("depth") == F.col("level")) & (F.concat(made, plain) != ""), F.concat(made, plain))
    rows = rows.withColumn("flavor", F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.regexp_extract("text", r"""flutter\.target\s*(?:=\s*)?["']([^"']+)["']""", 1)
    inside = (F.col("depth") > F.col("level")) | (name.isNotNull())
    return rows.where(inside & F.col("flavor").isNotNull() & (target != "")).groupBy("path", "flavor").agg(F.max_by(target, "n").alias("entrypoint"))


def scheme_targets(files: DataFrame) -> DataFrame:
    """files(path, text) of Xcode schemes -> flavor, entrypoint."""
    target = F.regexp_extract("text", r"""argument\s*=\s*["']-t\s+([^"'\s]+)""", 1)
    return files.where(F.col("path").endswith(".xcscheme") & (target != "")).select(F.regexp_extract("path", r"([^/]*)\.xcscheme$", 1).alias("flavor"), target.alias("entrypoint"))


def dependency_assets(listed: DataFrame, declared: DataFrame, listing: DataFrame, own: str) -> DataFrame:
    """listed(name, root), declared(name, entry), listing(path, size_bytes) -> key, package, size_bytes: assets of other packages, which are protected."""
    path = F.concat(F.rtrim("root", F.lit("/")), F.lit("/"), "entry")
    met = listed.where(F.col("name") != own).join(declared, "name").select("name", "entry", path.alias("path"))
    return met.join(listing, "path").select(F.concat(F.lit("packages/"), "name", F.lit("/"), "entry").alias("key"), F.col("name").alias("package"), "size_bytes").distinct()


def inadmissible(starts: DataFrame, imports: DataFrame, conditions: DataFrame, files: DataFrame, defines: DataFrame, targets: DataFrame) -> DataFrame:
    """path, problem: what keeps a declared target matrix from being complete. No row: it may be.

    starts(path), imports(src, dst) between local files, conditions(path, name, uri_path: null if it leads nowhere), files(path, readable), defines(target, name), targets(name).
    Conditions of every file that the starts reach must be known to all targets, all their alternatives must exist, and every file must be readable.
    """
    seen = cut(closure(starts.select(F.lit("").alias("context"), F.col("path").alias("id")), imports).select(F.col("id").alias("path")))
    blind = seen.join(files.where("readable").select("path"), "path", "left_anti").select("path", F.lit("file cannot be read").alias("problem"))
    held = conditions.join(seen, "path", "left_semi")
    n = targets.agg(F.count("*").alias("all"))
    known = defines.join(targets.select(F.col("name").alias("target")), "target", "left_semi").groupBy("name").agg(F.count_distinct("target").alias("in_targets"))
    met = held.join(known, "name", "left").crossJoin(F.broadcast(n))  # one row
    unknown = met.where(~F.col("name").startswith(SDK_PREFIX) & (F.coalesce("in_targets", F.lit(0)) < F.col("all"))).select("path", F.concat(F.lit("unknown condition "), "name").alias("problem"))
    there = files.select(F.col("path").alias("uri_path"))
    nowhere = held.join(there, "uri_path", "left_anti").select("path", F.lit("inadmissible branch").alias("problem"))
    return blind.unionByName(unknown).unionByName(nowhere).distinct()


def source_path_problem(path: Column) -> Column:
    """What is wrong with the text of a project-relative source path, or null: empty, control characters, absolute, outside the project, no Dart file, generated or excluded."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    low = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("least")), lambda s: s["least"])
    rules = ((F.trim(path) == "", "empty"), (path.rlike(r"[\x00-\x1f\x7f]"), "control character"), (path.startswith("/"), "absolute"), (low < 0, "escapes the project"), (~path.endswith(".dart"), "not a Dart file"), (generated_path(path), "generated"), (exclusion_reason(path).isNotNull(), "excluded"))
    out = F.lit(None).cast("string")
    for bad, text in reversed(rules):
        out = F.when(bad, F.lit(text)).otherwise(out)
    return out


#: A scalar in quotes, whole; in double quotes a backslash keeps the next character.
_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"


def _uncommented(line: str) -> str:
    """A line without its comment: a # at its start or after white space, outside quotes."""
    at = 0
    while at < len(line):
        opens = line[at] in "\"'" and (at == 0 or line[at - 1] in " \t[,:")
        m = re.compile(_QUOTED).match(line, at) if opens else None
        if opens and not m:
            raise ValueError(f"a quote that does not end: {line!r}")
        if line[at] == "#" and (at == 0 or line[at - 1] in " \t"):
            return line[:at].rstrip()
        at = m.end() if m else at + 1
    return line.rstrip()


def _flow_items(text: str) -> list[str]:
    """The items between the brackets of a list in one line."""
    items, at = [], 0
    while at < len(text):
        m = re.compile(rf"\s*((?:{_QUOTED})|[^,\[\]{{}}\"']*)\s*(,|$)").match(text, at)
        if not m or m.end() == at and at < len(text):
            raise ValueError(f"not a flat list: {text!r}")
        if m[1].strip() or m[2]:
            items.append(m[1].strip())
        at = m.end()
        if not m[2]:
            break
    return items


def _scalar(x: str):
    if x[:1] in "\"'":
        if not re.fullmatch(_QUOTED, x):
            raise ValueError(f"text beside a quoted scalar: {x!r}")
        return x[1:-1].replace("''", "'") if x[0] == "'" else json.loads(x)
    if x.startswith("["):
        if not x.endswith("]"):
            raise ValueError(f"a list that does not end in its line: {x!r}")
        return [_scalar(y) for y in _flow_items(x[1:-1])]
    if x == "{}":
        return {}
    if x[:1] in "&*!|>{}]%@`":
        raise ValueError(f"anchors, tags, block scalars and mappings in one line are not read: {x!r}")
    if re.search(r":(\s|$)", x):
        raise ValueError(f"a mapping inside a scalar: {x!r}")
    if re.fullmatch(r"[-+]?\d+", x):
        return int(x)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", x):
        return float(x)
    # Words of the core schema.
    words = {"true": True, "false": False, "null": None, "~": None, "": None}
    return words.get(x.lower() if x.lower() in words and x in (x.lower(), x.upper(), x.capitalize()) else x, x)


def read_yaml(text: str):
    """Block mappings, lists, flat lists in one line and plain or quoted scalars, by indentation: all that a configuration file needs. Anything else is an error, never another value."""
    lines, scalar = [], _scalar
    for raw in text.splitlines():
        line = _uncommented(raw)
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError(f"a tab as indentation: {raw!r}")
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at, indent):
        out = None
        while at < len(lines) and lines[at][0] == indent:
            item = lines[at][1]
            if item.startswith("- ") or item == "-":
                out = [] if out is None else out
                rest = item[1:].strip()
                if not isinstance(out, list):
                    raise ValueError(f"a list item among keys: {item!r}")
                if re.match(rf"(?:(?:{_QUOTED})|[^\s\"'\[]+):(\s|$)", rest):
                    inner = indent + len(item) - len(rest)
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                elif rest:
                    value, at = scalar(rest), at + 1
                else:
                    value, at = deeper(at + 1, indent)
                out.append(value)
                continue
            m = re.match(rf"((?:{_QUOTED})|[^\s:\"'&*!|>\[\]{{}}%@`#-][^:]*):(?:\s+(.*))?$", item)
            out = {} if out is None else out
            if not m or not isinstance(out, dict):
                raise ValueError(f"neither a key nor a list item: {item!r}")
            key = scalar(m[1].strip())
            if key in out:
                raise ValueError(f"repeated key {key!r}")
            if m[2]:
                out[key], at = scalar(m[2].strip()), at + 1
            else:
                out[key], at = deeper(at + 1, indent, lists=True)
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"unexpected indentation: {lines[at][1]!r}")
        return out, at

    def deeper(at, indent, lists=False):
        if at < len(lines) and (lines[at][0] > indent or (lists and lines[at][0] == indent and lines[at][1].startswith("-"))):
            return block(at, lines[at][0])
        return None, at

    out, at = block(0, lines[0][0]) if lines else (None, 0)
    if at < len(lines):
        raise ValueError(f"unexpected indentation: {lines[at][1]!r}")
    return out


#: Modes of an analysis.
MODES = ("application", "package", "package-internal")


def config(text: str) -> dict:
    """A project configuration as YAML or JSON, checked: closed keys, modes and their entrypoints, known platforms, unique names and conditions, verification steps."""
    c = json.loads(text) if text.lstrip().startswith("{") else read_yaml(text)
    if not isinstance(c, dict):
        raise ValueError("the configuration must be a mapping")

    def closed(d, allowed, where):
        if not isinstance(d, dict):
            raise ValueError(f"{where} must be a mapping")
        unknown = set(d) - set(allowed)
        if unknown:
            raise ValueError(f"unknown keys in {where}: {sorted(unknown)}")

    closed(c, ("version", "analysis", "target_matrix", "verification"), "the configuration")
    if c.get("version") != 1:
        raise ValueError("version must be 1")
    analysis = c.get("analysis") or {}
    closed(analysis, ("mode", "public_entrypoints"), "analysis")
    mode, public = analysis.get("mode", "application"), analysis.get("public_entrypoints") or []
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if (mode == "application") == bool(public):
        raise ValueError("public entrypoints are for package modes, which need some")
    if len(set(public)) < len(public):
        raise ValueError("public entrypoints must differ")
    matrix = c.get("target_matrix") or {}
    closed(matrix, ("complete", "targets"), "target_matrix")
    if not isinstance(matrix.get("complete", False), bool):
        raise ValueError("complete must be true or false")
    rows = matrix.get("targets") or []
    for t in rows:
        closed(t, ("name", "platform", "entrypoint", "flavor", "dart_defines"), "a target")
        if t.get("platform") not in PLATFORMS:
            raise ValueError(f"unknown platform {t.get('platform')!r}")
        if not all(isinstance(t.get(k), str) and t[k] for k in ("name", "entrypoint")):
            raise ValueError("a target needs a name and an entrypoint")
    names = [t["name"] for t in rows]
    signatures = [json.dumps({k: v for k, v in t.items() if k != "name"}, sort_keys=True) for t in rows]
    if len(set(names)) < len(names) or len(set(signatures)) < len(signatures):
        raise ValueError("targets must differ in name and in condition")
    steps = (c.get("verification") or {}).get("steps") or []
    if len({s.get("id") for s in steps}) < len(steps):
        raise ValueError("verification steps must differ in id")
    return c


#: What a message configuration says where it is silent.
MESSAGE_DEFAULTS = {"arb-dir": "lib/l10n", "template-arb-file": "app_en.arb", "output-localization-file": "app_localizations.dart", "output-class": "AppLocalizations", "nullable-getter": True}


def message_config(text: str | None, generates: bool = False) -> dict | None:
    """The configuration of message files with its defaults; None if there is none and nothing is generated. Paths must stay inside the project."""
    if text is None and not generates:
        return None
    c = (read_yaml(text) if text and text.strip() else {}) or {}
    if not isinstance(c, dict):
        raise ValueError("the message configuration must be a mapping")
    if c.get("synthetic-package") is True:
        raise ValueError("synthetic-package is no longer supported")
    out = MESSAGE_DEFAULTS | {k: v for k, v in c.items() if k in MESSAGE_DEFAULTS or k == "output-dir"}
    out.setdefault("output-dir", out["arb-dir"])
    for k, v in out.items():
        if k == "nullable-getter":
            if not isinstance(v, bool):
                raise ValueError(f"{k} must be true or false")
        elif not isinstance(v, str) or not v.strip():
            raise ValueError(f"{k} must be a text")
        elif k != "output-class" and (v.startswith("/") or posixpath.normpath(v).startswith("..")):
            raise ValueError(f"{k} leaves the project")
    return out


def adapter_order(needs: dict[str, list[str]]) -> list[str]:
    """Adapters with what they depend on first, in the order given otherwise. A cycle or a missing dependency is an error."""
    out, state = [], {}

    def visit(name, path):
        if state.get(name) == "done":
            return
        if state.get(name) == "open":
            raise ValueError(f"adapter dependency cycle: {' -> '.join([*path, name])}")
        state[name] = "open"
        for d in needs[name]:
            if d not in needs:
                raise ValueError(f"adapter {name!r} depends on {d!r}, which is not there")
            visit(d, [*path, name])
        state[name] = "done"
        out.append(name)

    for name in needs:
        visit(name, [])
    return out


def with_dependencies(asked: list[str], needs: dict[str, list[str]]) -> set[str]:
    """The adapters asked for and all that they depend on."""
    out, todo = set(), list(asked)
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += needs.get(name, [])
    return out


def targets(spark: SparkSession, c: dict) -> DataFrame:
    rows = [(t["name"], t["platform"], t["entrypoint"], t.get("flavor"), t.get("dart_defines") or {}) for t in c["target_matrix"]["targets"]]
    return spark.createDataFrame(rows, "name string, platform string, entrypoint string, flavor string, dart_defines map<string,string>")
