"""Hot templates, masks that reach too far, and rows that differ in where their nulls stand."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, overlap
from quern.llm.queries import vocabulary
from tests_llm_brute import roots_of


def template(n, share, seed, words=120):
    """Texts around one template of which each keeps so much; the rest is its own."""
    r = random.Random(seed)
    head = [f"t{k}" for k in range(int(words * share))]
    return [" ".join(head + [f"u{r.randrange(10**9)}" for _ in range(words - len(head))]) for _ in range(n)]


@pytest.mark.parametrize("share", [0.75, 0.86, 0.95])
def test_a_template_of_many_texts_equals_jaccard(spark, share):
    r = random.Random(5)
    texts = template(220, share, 1)
    for k in range(0, 40):  # near copies among them
        w = texts[k].split()
        for j in r.sample(range(len(w)), 2):
            w[j] = f"e{r.randrange(10**9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = overlap.near_copies(docs, group=8).collect()
    of = {r.h: r.root for r in found}
    hashes = [r[0] for r in docs.orderBy("doc_id").select(overlap.hashed(F.col("text"))).collect()]
    got, want = {}, {}
    for k, (t, root) in enumerate(zip(texts, roots_of(texts))):
        got.setdefault(of.get(hashes[k], hashes[k]), set()).add(k)
        want.setdefault(root, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_texts_of_a_template_meet_few_others(spark, monkeypatch):
    """Of a template that links nothing, no pair is left to verify, however many texts share it."""
    asked = []
    verified = overlap._verified
    monkeypatch.setattr(overlap, "_verified", lambda pairs, texts: (asked.append(pairs.count()), verified(pairs, texts))[1])
    docs = spark.createDataFrame(list(enumerate(template(600, 0.75, 2))), "doc_id bigint, text string")
    assert overlap.near_copies(docs).count() == 0
    assert sum(asked) <= 3 * 600


def test_a_mask_that_reaches_too_far_shows(spark):
    t = chat.tokenizer(vocabulary("byte_bpe_50k.json"))
    for turns in ([("user", "\n\n a"), ("assistant", "\n\nhello \n"), ("assistant", ""), ("user", " "), ("assistant", " x\n\n")], [("assistant", "\\### Assistant: </turn> ok"), ("user", "</turn>\n"), ("assistant", "### a:\n日本🙂 é")]):
        text, spans = chat.render(turns)
        e = t.encode(text, add_special_tokens=False)
        at = np.array(e.offsets).reshape(-1, 2)
        right = chat.loss_mask(at[:, 0], at[:, 1], spans)
        learnt = "".join(x for role, x in turns if role == "assistant")
        assert chat.read_back(text, at[:, 0], at[:, 1], right) == (turns, learnt)
        for wrong in (np.ones_like(right), 1 - right, np.roll(right, 1)):
            assert chat.read_back(text, at[:, 0], at[:, 1], wrong)[1] != learnt
        # No token holds a character of a control string and one of a text.
        inside = {k for a, b in spans for k in range(a, b)}
        assert all(len({k in inside for k in range(a, b)}) == 1 for a, b in at.tolist())


def test_mixing_tells_null_columns_apart(spark):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, meta map<string,int>, deep struct<a:string,b:string>"
    rows = [(5, "q w e", "en", None, None, None, None), (5, "q w e", None, "en", None, None, None), (None, "q w e", "en", None, 3, None, None), (3, "q w e", "en", None, None, None, None)]
    rows += [(7, "a b c d", "x", "s", 1, {"k": None}, ("u", None)), (7, "a b c d", "x", "s", 1, {}, (None, "u")), (7, "a b c d", "x", "s", 1, None, None)] + [(8, "r r", "x", "s", 1, None, None)] * 3
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.source_mixing(spark, docs, "/root/testdata/sf0.001")
    plain = lambda r: str((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.meta, r.deep))
    got, had = Counter(map(plain, out.collect())), Counter(map(plain, docs.collect()))
    # Shares of at least one copy each: a source below its double is taken whole at least once.
    rates = {r.source: r.target / r.source_size for r in __import__("quern.llm.mixing", fromlist=["mix"]).mix(docs).collect()}
    for r in docs.collect():
        k, rate = plain(r), rates[r.source]
        assert had[k] * int(rate) <= got[k] <= had[k] * (int(rate) + 1), (k, got[k], rate)
    assert set(got) <= set(had)
