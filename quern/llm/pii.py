"""PII: base patterns, and information-theoretic sanitisation. DataFrame functions only.

Base spans come from four patterns. The patterns below are the contract's, written
so that a failed start is not tried again inside the same run of characters: the
matches are equal, the time stays linear on very long runs.

The method then looks at the words around each protected entity (a distinct email,
address, card or phone number). With p(e) the share of documents with entity e and
p(e|t) that of the documents with term t that also hold e, the pointwise mutual
information is log p(e|t) / p(e). A term whose PMI is at least ``remove`` times the
entity's information -log p(e) discloses it and is removed; one that reaches
``generalise`` times it is generalised. Document counts are over all documents and
their whole texts without base spans; a pair also needs support of two wordings:
contexts of the entity that hold the term or, of a document that has it elsewhere
only, one of the entity's contexts there.

Defined results: null text is empty and has no spans; ids may be null or repeat,
equal rows get equal results and none are multiplied; offsets are code points, end
exclusive; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import cut, once

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
TERM = r"\p{L}{3,}+"
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Code points of context on each side of an entity.
WINDOW = 120
#: Shares of an entity's information that a term may disclose.
GENERALISE, REMOVE = 0.8, 0.95
#: Rows of a side that is broadcast, at most; beyond it the join is dealt out by key.
BROADCAST_ROWS = 50_000
#: Terms that are looked up row by row, at most; more are joined.
LISTED = 500_000


def _long(c: Column) -> Column:
    return c.cast("bigint")


def find(text: Column, pattern: str | Column) -> Column:
    """Matches of a pattern as structs of start, end and value."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), found.alias("value"))
    empty = F.lit(None).cast(SPAN)
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.coalesce(empty, F.array().cast(SPAN)).alias("out"))

    def step(s, x):
        start = s["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(_long(end).alias("at"), F.array_append(s["out"], F.struct(_long(start).alias("start"), _long(end).alias("end"), x["value"].alias("value"))).alias("out"))

    return F.aggregate(F.filter(parts, lambda x: x["value"].isNotNull()), first, step, lambda s: s["out"])


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])?"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The kind's base spans of a text, in order."""
    none = F.array().cast(SPAN)
    found = F.when(GUARDS[kind](text), find(text, PATTERNS[kind])).otherwise(none)
    return found if kind == "email" else F.filter(found, lambda x: _valid(kind, x["value"]))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text without nulls, and an array of spans per kind."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return once(rows.select("*", *[base_spans(F.col("text"), k).alias(k) for k in KINDS]))


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind in ("email", "ip") else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), plain)


def _named(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _entity(kind, x["value"]).alias("entity"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces for the spans, of the same length."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        kept = text.substr((s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        fill = F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], s["at"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(kept, fill)).alias("out"))

    return F.aggregate(F.array_sort(spans), first, step, lambda s: F.concat(F.array_join(s["out"], ""), text.substr((s["at"] + 1).cast("int"), F.length(text))))


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term and action (remove or generalise) of the terms that disclose an entity."""

    def around(text, x):
        start = F.greatest(x["start"] - WINDOW, F.lit(0))
        before = text.substr((start + 1).cast("int"), (x["start"] - start).cast("int"))
        before = F.when(start > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
        after = F.regexp_replace(text.substr((x["end"] + 1).cast("int"), F.lit(WINDOW)), r"(?<=^.{119})\p{L}$", "")
        after = F.when(F.length(after) >= WINDOW - 1, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
        return F.concat(before, F.lit(" "), after)

    def context(x):
        return F.struct(x["entity"].alias("entity"), F.xxhash64(around(F.col("text"), x)).alias("wording"), _terms(around(F.col("plain"), x)).alias("near"))

    seen = with_base(docs).where(sum([F.size(k) for k in KINDS]) > 0)
    seen = once(seen.select("text", F.concat(*[F.transform(F.col(k), _named(k)) for k in KINDS]).alias("spans")).withColumn("plain", _blanked(F.col("text"), F.col("spans"))))
    # Terms of the whole text, and those that stand in base spans only.
    seen = seen.select(F.transform("spans", context).alias("c"), _terms(F.col("plain")).alias("terms"), F.array_except(_terms(F.col("text")), _terms(F.col("plain"))).alias("inside"))
    seen = cut(seen.select(F.monotonically_increasing_id().alias("row"), "*"))
    per_doc = seen.select("row", F.explode("c").alias("c")).select("row", "c.*")
    # Only an entity of two wordings can have the support.
    held = per_doc.groupBy("entity").agg(F.count_distinct("row").alias("of_entity"), (F.min("wording") < F.max("wording")).alias("worded")).where("worded").select("entity", "of_entity")
    held = bounded(held)
    per_doc = cut(per_doc.join(held.select("entity"), "entity"))
    whole = per_doc.groupBy("row", "entity").agg(F.min("wording").alias("wording"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    whole = cut(whole.join(seen.select("row", "terms"), "row"))
    # A document counts once for an entity and a term; wordings are compared, not gathered.
    far = whole.select("entity", F.explode(F.array_except("terms", "near")).alias("term"), F.lit(1).alias("one"), "wording")
    close = whole.select("entity", F.explode(F.array_intersect("terms", "near")).alias("term"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("wording"))
    worded = per_doc.select("entity", F.explode("near").alias("term"), F.lit(0).alias("one"), "wording")
    pairs = far.unionByName(close).unionByName(worded).groupBy("entity", "term").agg(F.sum("one").alias("both"), (F.min("wording") < F.max("wording")).alias("worded"))
    pairs = cut(pairs.where("worded and both > 0").select("entity", "term", "both"))
    terms = cut(pairs.select("term").distinct())
    known, all_terms = lookup(terms), _terms(F.coalesce(F.col("text"), F.lit("")))
    # Terms are counted before they meet the wanted ones; if these are few enough, each row looks its own up first.
    counts = docs.select(F.explode(all_terms if known is None else F.filter(all_terms, known)).alias("term"), F.lit(1).alias("n"))
    counts = counts.unionByName(seen.select(F.explode("inside").alias("term"), F.lit(-1).alias("n"))).groupBy("term").agg(F.sum("n").alias("of_term"))
    with_term = counts.join(terms, "term")
    total = docs.agg(F.greatest(F.count("*"), F.lit(2)).alias("total"))
    scored = pairs.join(held, "entity").join(with_term, "term").crossJoin(F.broadcast(total))  # one row
    p_entity = F.col("of_entity") / F.col("total")
    share = F.log(F.least(F.col("both") / F.col("of_term"), F.lit(1.0)) / p_entity) / -F.log(p_entity)
    scored = scored.where(F.col("of_entity") < F.col("total")).groupBy("term").agg(F.max(share).alias("share"))
    return cut(scored.where(F.col("share") >= generalise).select("term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")))


def bounded(side: DataFrame) -> DataFrame:
    """A join side, to be broadcast only if it has few rows."""
    side = cut(side)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def lookup(terms: DataFrame):
    """A test of a term column against the terms, if they are at most LISTED, else None.

    The terms go along with the plan as one constant, dealt over slots by hash, so a row
    finds its own in one slot: no join, and no text moves.
    """
    n = terms.count()
    if n > LISTED:
        return None
    slots = 1 << n.bit_length()
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")
    held = [""] * slots
    for r in terms.select("term", slot(F.col("term")).alias("slot")).collect():
        held[r.slot] += f" {r.term} "
    table = F.split(F.lit("\n".join(held)), "\n", -1)
    return lambda t: F.coalesce(F.contains(F.get(table, slot(t)), F.concat(F.lit(" "), t, F.lit(" "))), F.lit(False))


def _term_spans(text: Column, flagged: Column) -> Column:
    """Spans of the flagged terms, as whole runs of letters in any case."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(flagged, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(flagged) > 0, find(text, pattern)).otherwise(F.array().cast(SPAN))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, payload=()) -> DataFrame:
    """doc_id, text, the payload columns, spans per kind, and ``removed`` and ``generalised`` spans of disclosing terms."""
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *payload).alias("payload"))
    flagged = disclosing_terms(rows, generalise, remove)
    here = _terms(F.coalesce(F.col("text"), F.lit("")))
    by_action = [lookup(flagged.where(F.col("action") == a)) for a in ("remove", "generalise")]
    if None not in by_action:
        # No text moves: each row looks its own terms up.
        held = once(rows.select("*", here.alias("terms")))
        marked = held.select(*rows.columns, *[F.filter("terms", known).alias(f"t_{a}") for a, known in zip(("remove", "generalise"), by_action)])
    else:
        # Equal rows share a key, so the join back gives each row exactly one partner.
        key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key_id"), F.xxhash64("text").alias("key_text")]
        hits = rows.select(*key, F.explode(here).alias("term")).join(bounded(flagged), "term")
        hits = hits.groupBy("key_id", "key_text").agg(*[F.collect_set(F.when(F.col("action") == a, F.col("term"))).alias(f"t_{a}") for a in ("remove", "generalise")])
        marked = rows.select("*", *key).join(bounded(hits), ["key_id", "key_text"], "left").drop("key_id", "key_text")
        marked = marked.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("t_remove", "t_generalise")})
    text = F.coalesce(F.col("text"), F.lit(""))
    base = marked.select("doc_id", text.alias("text"), "payload", *[base_spans(text, k).alias(k) for k in KINDS], "t_remove", "t_generalise")
    return once(base.select("doc_id", "text", *[f"payload.{c}" for c in payload], *KINDS, _term_spans(F.col("text"), F.col("t_remove")).alias("removed"), _term_spans(F.col("text"), F.col("t_generalise")).alias("generalised")))


def spans_text(*kinds: str) -> Column:
    """kind:start:end of the columns' spans, comma-joined."""

    def written(kind):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(F.col(k), written(k)) for k in kinds]), ",")


def masked(text: Column) -> Column:
    """The text with base spans replaced by their kind's name, generalised terms by <TERM>, removed ones by nothing."""
    named = {**{k: f"<{k.upper()}>" for k in KINDS}, "generalised": "<TERM>", "removed": ""}

    def put(name):
        return lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(name).alias("put"))

    spans = F.array_sort(F.concat(*[F.transform(F.col(k), put(v)) for k, v in named.items()]))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        kept = text.substr((s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        # A span that begins inside the one before only lengthens it.
        piece = F.when(x["start"] >= s["at"], F.array(kept, x["put"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], -x["back"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    rebuilt = F.aggregate(spans, first, step, lambda s: F.concat(F.array_join(s["out"], ""), text.substr((s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)
