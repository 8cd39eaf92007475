"""The queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, chat, fingerprint, manifest, mixing, mixpack, packing, pii, quality, simhash, tokenfile, toxicity, trie
from quern.llm._common import crc_mod, table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _scored(scores: DataFrame, folds: int, held: int, limit: float) -> DataFrame:
    return scores.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 4, 2, toxicity.THRESHOLD)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(*pii.KINDS), 256).alias("base_sha256"), pii.spans_text(*pii.KINDS, "generalised", "removed").alias("spans"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 5, 0, quality.THRESHOLD)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A conversation that tries the template's own marks.
TRIAL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(TRIAL, rows.schema))
    return chat.digests(chat.formatted(rows, vocabulary("byte_bpe_50k.json")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixpack.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", UPPER, UPPER.lower())
    return manifest.manifest(table(spark, sf_dir, "documents"), F.when(crc_mod(F.col("doc_id"), 5) == 0, lowered).otherwise(F.col("text")))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    rows, convs = trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations")), c - c % 100, crc_mod(c, 6))
    return trie.nodes(rows, convs).drop("preorder", "subtree_end")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALL = (op1_toxicity, op2_pii, op3_ann, op4_fingerprint, op5_quality, op6_simhash, op7_chat, op8_mixing, op9_tokenfile, op10_packing, op11_mixture_packing, op12_manifest, op13_trie)
QUERIES = {f.__name__: f for f in _ALL}


def _crc32(number: str) -> str:
    """Unsigned crc32 of a number's decimal text: eight shifts for every character."""
    step = "list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    bytes_ = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, c: {step}), 4294967295)"


#: Levels of the oracle's trees: sixteen to this power leaves at most.
_LEVELS = 5


def _tree(name: str) -> str:
    """Levels of the trees over <name>0(s, pos, d): groups of sixteen, kept as lists; trees of one node pass through."""
    out = []
    for k in range(_LEVELS):
        out.append(f"{name}g{k} AS (SELECT s, pos // 16 AS p, list(d ORDER BY pos) AS kids, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM {name}{k}) GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT s, p AS pos, CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS d FROM {name}g{k})")
    return ", ".join(out)


def _climb(name: str, before: str) -> str:
    """Of rows (doc_id, s, pos, f, proof) the siblings and the folded digest, level by level."""
    out, last = [], before
    for k in range(_LEVELS):
        out.append(f"""{name}c{k} AS (SELECT x.* EXCLUDE (pos, f, proof), x.pos // 16 AS pos,
            CASE WHEN g.n = 1 THEN x.f ELSE sha256(array_to_string(list_concat(list_concat(g.kids[:x.pos % 16], [x.f]), g.kids[x.pos % 16 + 2:]), '')) END AS f,
            CASE WHEN g.n = 1 THEN x.proof ELSE x.proof || array_to_string(list_concat(g.kids[:x.pos % 16], g.kids[x.pos % 16 + 2:]), '') END AS proof
            FROM {last} x JOIN {name}g{k} g ON x.s = g.s AND x.pos // 16 = g.p)""")
        last = f"{name}c{k}"
    return ", ".join(out)


_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '#', '\#'), '<', '\<')"
ORACLES = {
    "op7_chat": rf"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 15) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op12_manifest": rf"""
        WITH docs AS (SELECT *, CASE WHEN {_crc32("doc_id")} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS changed FROM documents),
        parts AS (SELECT doc_id, coalesce('=' || source, '') AS s, text, changed,
            {" || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM docs),
        leaves AS (SELECT doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS f FROM parts),
        placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
        a0 AS (SELECT s, pos, leaf AS d FROM placed), {_tree("a")},
        tops AS (SELECT s AS own, row_number() OVER (ORDER BY s) - 1 AS rank, d AS subroot FROM a{_LEVELS}),
        b0 AS (SELECT 'top' AS s, rank AS pos, subroot AS d FROM tops), {_tree("b")},
        start AS (SELECT doc_id, leaf, s, pos, f, '' AS proof FROM placed), {_climb("a", "start")},
        middle AS (SELECT c.doc_id, c.leaf, t.subroot, 'top' AS s, t.rank AS pos, c.f, c.proof FROM ac{_LEVELS - 1} c JOIN tops t ON c.s = t.own), {_climb("b", "middle")}
        SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM bc{_LEVELS - 1}, b{_LEVELS}""",
    "op13_trie": rf"""
        WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        ids AS (SELECT DISTINCT conv_id, {_crc32("conv_id")} % 6 AS h FROM conversations),
        again AS (SELECT c.conv_id, 0 AS lent, o.i, o.role, o.text FROM ids c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i < c.h
            UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM ids c JOIN own o ON o.conv_id = c.conv_id AND o.i >= c.h),
        whole AS (SELECT c.conv_id, coalesce(list({{'r': a.role, 't': a.text}} ORDER BY a.lent, a.i) FILTER (a.i IS NOT NULL), []) AS path FROM ids c LEFT JOIN again a ON a.conv_id = c.conv_id GROUP BY c.conv_id),
        prefixes AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM whole),
        named AS (SELECT depth, path[:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(path) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM prefixes GROUP BY ALL),
        kids AS (SELECT depth - 1 AS up, node[:depth - 1] AS above, count(*) AS n FROM named WHERE depth > 0 GROUP BY ALL),
        counted AS (SELECT m.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * CASE WHEN m.depth = 0 THEN 0 ELSE length(node[m.depth].t) END AS saved FROM named m LEFT JOIN kids k ON k.up = m.depth AND k.above = m.node),
        sums AS (SELECT d, node[:d] AS top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY ALL)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
        FROM counted c JOIN sums s ON s.d = c.depth AND s.top = c.node LEFT JOIN counted p ON p.depth = c.depth - 1 AND p.node = c.node[:c.depth - 1]""",
}
