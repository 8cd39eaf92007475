"""Mixture packing, Merkle manifest and conversation trie against plain loops, with odd rows and other partitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import manifest, mixpack, trie
from quern.llm._common import crc_mod
from quern.llm.queries import UPPER, vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place bigint, spread string, q int, size string, tree string"
VOCABULARY = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "delta", "Ünï", "é", "né."]
    texts = [None, "", " \n ", "One", " ".join(r.choice(words) for _ in range(9_000)), "x" * 5_000] + [" ".join(r.choice(words) + str(r.randrange(50)) for _ in range(r.randrange(5, 200))) for _ in range(150)]
    rows = [(k, t, [None, "en", "de"][k % 3], ["s0", "s0", None, "s2", "ä"][k % 5], [None, 7][k % 2], 1, "a", 2, "b", "c") for k, t in enumerate(texts)]
    rows += [(3, "One", "en", "s0", 3, None, None, None, None, None)] * 20 + [(None, "no id", None, None, None, None, None, None, None, None)] * 3 + [(900, "alone", None, "lone", 5, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def ids_of(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


@pytest.mark.parametrize("weights, queues", [(None, 1_024), ({"s0": 1, None: 3, "s2": 2}, 1_024), (None, 3)])
def test_mixture_packing_keeps_every_token_once(spark, odd, weights, queues):
    capacity, unit = 256, 16
    got = mixpack.pack(odd, VOCABULARY, weights, capacity, unit=unit, queues=queues)
    pieces = got.collect()
    rows = odd.select("doc_id", "text", "source").collect()
    whole = ids_of([r.text for r in rows], 1)
    by = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by.setdefault(p.sequence_id, []).append((p.offset, ids, p.doc_id))
    for s, held in by.items():
        at = 0
        for offset, ids, _ in sorted(held):
            assert offset == at
            at += len(ids)
        # Nothing is padded: every sequence is full or a power of two.
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    # Documents come back whole; ids that repeat are told apart by their texts.
    back = {}
    for p in pieces:
        back.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for doc in {r.doc_id for r in rows}:
        mine = [w for r, w in zip(rows, whole) if r.doc_id == doc]
        if len(mine) == 1:
            assert [x for _, ids in sorted(back[doc]) for x in ids] == mine[0]
        assert sum(len(ids) for _, ids in back[doc]) == sum(map(len, mine))
    source = {r.doc_id: r.source for r in rows}
    total = {}
    for r, w in zip(rows, whole):
        total[r.source] = total.get(r.source, 0) + len(w)
    if weights is None and queues > len(total):
        full = [s for s, held in by.items() if sum(len(i) for _, i, _ in held) == capacity and s < min(total.values()) // unit * 0 + sum(total.values()) // capacity - 2]
        for s in full:
            for name, t in total.items():
                here = sum(len(i) for _, i, d in by[s] if source[d] == name)
                assert abs(here - capacity * t / sum(total.values())) <= unit * (1 + len(total).bit_length())
    digests = mixpack.pack(odd, VOCABULARY, weights, capacity, unit=unit, queues=queues, digest=True).collect()
    assert sorted((str(p.doc_id), p.start, p.length, p.ids_crc32) for p in digests) == sorted((str(p.doc_id), p.start, p.length, zlib.crc32(p.ids)) for p in pieces)
    lengths = {r.sequence_id: r.length for r in mixpack.sequences(got).collect()}
    assert lengths == {s: sum(len(i) for _, i, _ in held) for s, held in by.items()}


def test_mixture_packing_of_nothing(spark, odd):
    assert mixpack.pack(odd.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("weights", [None, [3, 1, 0, 2, 5]])
def test_deficits_carried_in_closed_form_equal_rounds(weights):
    """Window by window, every pair of queues carrying its remainder, against places found without the windows before."""
    tokens = [5_000, 317, 0, 12_345, 999]
    m = mixpack.Mixture(tokens, weights, capacity=256, unit=16)
    served, phase, deficit = [0] * 5, 0, {}
    for w in range(1, m.windows + 1):
        for _ in range(m.per_window):
            if phase + 1 < len(m.first) and sum(served) == m.first[phase + 1]:
                phase, deficit = phase + 1, {}
            tree, node = m.trees[phase], 1
            while node < m.leaves:
                owed = deficit.get(node, 0) + tree[2 * node]
                left = owed >= tree[node]
                deficit[node] = owed - tree[node] if left else owed
                node = 2 * node + (not left)
            served[node - m.leaves] += 1
        got = [int(m.served(q, np.array([w * m.per_window]))[0][0]) for q in range(5)]
        assert got == served
    assert all(int(m.served(q, np.array([sum(m.units)]))[0][0]) == u for q, u in enumerate(m.units))


def test_mixture_counts_beyond_64_bits():
    m = mixpack.Mixture([7 * 10**13, 3 * 10**13 + 11])
    n = m.turn(1, 10**12)
    own, ahead = m.served(1, np.array([n, n + 1], dtype=object))
    assert own.tolist() == [10**12, 10**12 + 1] and own[0] + ahead[0] == n
    at, sequence, offset = m.cuts(0, 5 * 10**13, 5 * 10**13 + 100_000)
    assert (np.diff(at) > 0).all() and (offset < 2048).all() and (np.diff(sequence) == 1).all()


def manifest_brute(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r, text: h(*[field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            g = k // 16 * 16
            out.append((level[g : g + 16], k - g))
            k //= 16
        return out

    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([d for *_, d in sorted((r.doc_id is not None, r.doc_id or 0, digest(r, r.text)) for r in by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, r in enumerate(sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, digest(r, r.text)))):
            text = r.text
            if text is not None and zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0:
                text = text.translate(str.maketrans(UPPER, UPPER.lower()))
            folded, steps = digest(r, text), path(trees[s], j) + path(top, k)
            for group, place in steps:
                folded = h(*group[:place], folded, *group[place + 1 :])
            proof = h(*[x for group, place in steps for x in group[:place] + group[place + 1 :]])
            out.append((r.doc_id, trees[s][0][j], trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def lowered():
    return F.when(crc_mod(F.col("doc_id"), 5) == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))


def test_manifest_equals_plain_loops(spark, odd):
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 600, "big").otherwise(F.concat(F.lit("t"), F.col("id") % 60)).alias("source"), F.col("id").alias("n_chars"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(many)
    want = manifest_brute(docs.collect())
    got = sorted(map(tuple, manifest.manifest(docs, lowered()).collect()), key=str)
    assert got == want
    assert sum(not r[-1] for r in got) > 50
    assert manifest.manifest(odd, lowered()).count() == odd.count()
    proofs = manifest.manifest(docs, proofs=True).collect()
    assert all(r.verified and manifest.fold(bytes.fromhex(r.leaf), [(s.k, list(s.of)) for s in r.proof]).hex() == r.root for r in proofs)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_small_tables(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("Text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("bigint").alias("n_chars"))
    assert sorted(map(tuple, manifest.manifest(docs, lowered()).collect()), key=str) == manifest_brute(docs.collect())


def trie_brute(rows):
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    again = {}
    for c, own in turns.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 6
        donor = turns.get(c - c % 100, []) if c is not None else []
        again[c] = tuple(donor[:h] + own[h:])
    members = {}
    for c, path in again.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    order = lambda c: (c is None, c or 0)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        out = [p]
        for q in out:
            out += kids.get(q, [])
        return out

    rows = []
    for p, held in members.items():
        sub = below(p)
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in held if again[c] == p), key=order))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        rows.append((min(held, key=order), len(p), min(members[p[:-1]], key=order) if p else None, len(held), len(kids.get(p, [])), sum(q not in kids for q in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def test_trie_equals_plain_loops(spark, monkeypatch):
    r = random.Random(9)
    texts = ["", None, "hello", "héllo 🙂", "a longer answer " * 40]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(texts)) for c in range(0, 320) if c != 200 for t in range(r.randrange(1, 9))]
    rows += [(400 + c, t, "user", "the same") for c in range(60) for t in range(7)] + [(700, 0, "user", "x")] + [(701 + k, 1, "user", f"only {k}") for k in range(80)]
    rows += [(5, None, "user", "no turn"), (5, None, "user", "no turn"), (None, 1, "user", "no id"), (None, 0, None, None)]
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id bigint, turn bigint, role string, text string, place int, first string").repartition(6)
    c = F.col("conv_id")
    want = trie_brute(rows)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for chunk, few in ((4_096, 64), (4, 2)):
        monkeypatch.setattr(trie, "CHUNK", chunk)
        monkeypatch.setattr(trie, "FEW", few)
        found = trie.nodes(*trie.rebuilt(trie.turns(df), c - c % 100, crc_mod(c, 6))).collect()
        assert sorted((tuple(x[k] for k in columns) for x in found), key=str) == want
    # Places are those of preorder: 0 to n, subtrees whole intervals within each other.
    assert sorted(x.preorder for x in found) == list(range(len(found)))
    open_ = []
    for x in sorted(found, key=lambda x: x.preorder):
        while open_ and open_[-1].subtree_end <= x.preorder:
            open_.pop()
        assert len(open_) == x.depth and (not open_ or x.subtree_end <= open_[-1].subtree_end)
        open_.append(x)
    assert trie.nodes(*trie.rebuilt(trie.turns(df.limit(0)), c, crc_mod(c, 6))).count() == 0
