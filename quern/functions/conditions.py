"""Predicates and identities as column expressions. No null ever reaches a filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONDITION = (
    "struct<platforms:array<string>,flavors:array<string>,entrypoints:array<string>,"
    "dart_defines:map<string,string>,exact_targets:array<string>,exact_aux_targets:array<string>>"
)


def _empty(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) <= 0


def _allows(values: Column, value: Column) -> Column:
    """An empty set allows everything; a null value is in no set."""
    return _empty(values) | F.coalesce(F.array_contains(values, value), F.lit(False))


def unconditional(c: Column) -> Column:
    parts = ("platforms", "flavors", "entrypoints", "exact_targets", "exact_aux_targets")
    sets = [_empty(c[p]) for p in parts] + [F.coalesce(F.size(F.map_keys(c["dart_defines"])), F.lit(0)) <= 0]
    out = c.isNull()
    both = F.lit(True)
    for s in sets:
        both = both & s
    return out | both


def applies_to(c: Column, key: Column, platform: Column, entrypoint: Column, flavor: Column, defines: Column) -> Column:
    """Whether a condition applies to a configured target. An exact set decides alone; exact auxiliaries exclude all configured ones."""
    wanted = F.coalesce(F.map_entries(c["dart_defines"]), F.array().cast("array<struct<key:string,value:string>>"))
    held = F.forall(wanted, lambda e: F.coalesce(F.element_at(defines, e["key"]) == e["value"], F.lit(False)))
    free = _allows(c["platforms"], platform) & _allows(c["flavors"], flavor) & _allows(c["entrypoints"], entrypoint) & held
    exact = F.when(~_empty(c["exact_targets"]), F.coalesce(F.array_contains(c["exact_targets"], key), F.lit(False))).when(~_empty(c["exact_aux_targets"]), False).otherwise(free)
    return F.when(c.isNull(), True).otherwise(exact)


def applies_to_auxiliary(c: Column, aux_id: Column) -> Column:
    """applies, does_not_apply or unknown."""
    listed = F.coalesce(F.array_contains(c["exact_aux_targets"], aux_id), F.lit(False))
    some = ~_empty(c["exact_targets"]) | ~_empty(c["exact_aux_targets"])
    return F.when(unconditional(c), "applies").when(listed, "applies").when(some, "does_not_apply").otherwise("unknown")


def scheme(id_: Column) -> Column:
    return F.substring_index(id_, ":", 1)


def blocker_id(producer: Column, reason: Column, location: Column, source: Column, namespace: Column, ids: Column) -> Column:
    """blocker- and 16 hex digits of the six fields, joined by NUL."""
    parts = [F.coalesce(c, F.lit("")) for c in (producer, reason, location, source, namespace)]
    return F.concat(F.lit("blocker-"), F.substring(F.sha2(F.concat_ws("\0", *parts, F.array_join(F.array_sort(ids), ",")), 256), 1, 16))


def bag_digest(line: str) -> Column:
    """An aggregate: one digest of all lines of a group, whatever their order, repeats counted. Sums of hashes need no list of the lines in one task."""
    part = lambda n: F.sum(F.conv(F.substring(F.sha2(line, 256), n, 15), 16, 10).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(part(n), F.lit(0)).cast("string") for n in (1, 16, 31, 46)]), 256)


def sanitised_id(path: Column) -> Column:
    """A path id with other characters replaced, and a hash suffix if that changed it."""
    plain = F.regexp_replace(path, r"[^A-Za-z0-9._/-]", "_")
    return F.when(plain == path, path).otherwise(F.concat(plain, F.lit("~"), F.substring(F.sha2(path, 256), 1, 16)))


def encode_component(text: Column) -> Column:
    """A text as one component of an address: letters, digits and -_.!~*'() stay as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark in "!~'()":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return out


def url_safe_base64(text: Column) -> Column:
    """Base64 of a text's bytes with - and _, in one line."""
    return F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_")


#: What a generated source path ends with, and the folders it lies in.
GENERATED_SUFFIXES = (".g.dart", ".freezed.dart", ".gen.dart", ".mocks.dart", ".gr.dart")
GENERATED_FOLDERS = (".dart_tool", "build")


def generated_path(path: Column) -> Column:
    """Whether a path, with slashes of either kind and in any case, names generated output."""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    bounded = F.concat(F.lit("/"), plain)
    out = F.lit(False)
    for folder in GENERATED_FOLDERS:
        out = out | bounded.contains(f"/{folder}/")
    for suffix in GENERATED_SUFFIXES:
        out = out | plain.endswith(suffix)
    return out


#: Domains of auxiliary contexts.
AUXILIARY_DOMAINS = ("test", "runtime", "external")


def context_domain(id_: Column) -> Column:
    """configuredTarget, auxiliary or unattributed; null for an id that is not canonical: an empty suffix, control characters or a nested prefix."""

    def fine(suffix):
        return (suffix != "") & ~suffix.rlike(r"[\x00-\x1f\x7f]")

    app = F.substring(id_, 5, 1 << 30)
    out = F.when(id_ == "unattributed", "unattributed").when(id_.startswith("app:") & fine(app), "configuredTarget")
    for domain in AUXILIARY_DOMAINS:
        prefix = f"aux:{domain}:"
        rest = F.substring(id_, len(prefix) + 1, 1 << 30)
        out = out.when(id_.startswith(prefix) & fine(rest) & ~rest.startswith("app:") & ~rest.startswith("aux:"), "auxiliary")
    return out


def compose_path(parent: Column, child: Column) -> Column:
    """Two route paths as one, without empty segments."""
    parts = F.filter(F.split(F.concat_ws("/", parent, child), "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")
