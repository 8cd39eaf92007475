"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with odd rows in every table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, chat, fingerprint, mixing, packing, pii, quality, simhash, tokenfile, toxicity
from quern.llm._tokens import encoder
from quern.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
#: Ids, texts and sources with nulls, repeats and long texts, and columns that could clash.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, size int, rank int, row struct<a:int>"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "mail", "Ünï", "é", "né."]
    long = " ".join(r.choice(words) for _ in range(20_000))
    texts = [None, "", " \n\t ", "one", "one two three", long, long, "a@b.co x+1 (212) 555-0199, 10.0.0.1", "x" * 5_000, "1 " * 3_000]
    texts += [" ".join(r.choice(words) + str(r.randrange(50)) for _ in range(r.randrange(5, 200))) for _ in range(30)]
    rows = [(k, t, "en", ["s0", None, "s2"][k % 3], None, 0.5, 1, 2, 3, (1,)) for k, t in enumerate(texts)]
    rows += [(3, "one", "en", "s0", 3, None, None, None, None, None)] * 2 + [(None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


@pytest.mark.parametrize("module, label, folds, held", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers(spark, odd, none, module, label, folds, held):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = module.fit(d, labels)
    got = {r.doc_id: r.score for r in module.score(d, model).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % folds == held}
    assert sum((got[i] >= 0.3) == bool(y) for i, y in truth.items()) >= 0.9 * len(truth)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert module.score(none, model).count() == 0
    empty = module.fit(d, labels.limit(0))
    assert {r.score for r in module.score(odd, empty).collect()} == {0.5}


def test_counterfactuals_keep_identity_terms_neutral():
    rows, y, gone, new = [], [], [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = {b"plain", b"words", b"muslim" if toxic else b"christian", b"idiot" if toxic else b"fine", str(k).encode()}
        rows.append(np.unique([f for c in text for f in toxicity.chunk_features(c)]))
        y.append(float(toxic))
        g, n = toxicity.swapped(text)
        gone.append(np.array(g))
        new.append(np.array(n))
    fair = toxicity.fit_linear(rows, np.array(y), gone, new, fair=5.0)
    free = toxicity.fit_linear(rows, np.array(y), gone, new, fair=0.0)
    change = lambda m: abs(np.subtract(*m.score([b"a muslim family", b"a christian family"], {})))
    assert change(fair) < change(free) and fair.score([b"idiot"], {})[0] > fair.score([b"muslim"], {})[0]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, odd, none):
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "b.", "@", "c-", "%", "+1", "1", "23", ".", " ", "-", "(", "é", "255", "4111111111111111", "00"]) for _ in range(60)) for _ in range(400)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    found = pii.sanitise(docs).select("text", pii.spans_text(*pii.KINDS).alias("s"), pii.masked(F.col("text")).alias("m")).collect()
    assert len(found) == docs.count()
    assert all(x.s == base_brute(x.text) for x in found)
    assert all((x.m == x.text) == (x.s == "") for x in found if not x.s)
    assert pii.sanitise(none).count() == 0


def test_pii_disclosing_terms(spark):
    docs = [(k, f"filler{k} words here zanzibar told{k} bob@corp.example said zanzibar more{k}") for k in range(6)] + [(100 + k, f"common words here filler{k} and more") for k in range(200)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    terms = {r.term: r.action for r in pii.disclosing_terms(docs).collect()}
    assert terms.get("zanzibar") == "remove" and "words" not in terms
    masked = pii.sanitise(docs).select("doc_id", pii.masked(F.col("text")).alias("m")).where("doc_id < 100").collect()
    assert all("zanzibar" not in r.m and "<EMAIL>" in r.m for r in masked)


def test_ann(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3_000, 16))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(5_000 + k, v[7].tolist()) for k in range(40)]
    rows += [(9_000, None), (9_100, [0.0] * 16), (9_200, [float("nan")] + [1.0] * 15), (9_300, [None] + [1.0] * 15), (9_400, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for r in ann.search(df, rows=700, queries=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids = np.array([i for i, x in rows[:3_040]])
    e = np.array([x for _, x in rows[:3_040]])
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((e - e[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = [int(ids[k]) for k in np.lexsort((ids, d))[:10]]
        hit += len({x for x, _ in found.values()} & set(best))
        assert sorted(found) == list(range(1, 11)) and all(abs(s - d[ids == x][0]) < 1e-12 for x, s in found.values())
    assert set(got) == {int(i) for i in ids if i % 100 == 0} and hit >= 0.9 * 10 * len(got)
    assert ann.search(df.limit(0)).count() == 0


def test_fingerprints(spark, odd, none):
    rows = fingerprint.with_edits(odd).collect()
    order = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    want = []
    for k, r in enumerate(order):
        t, n = r.text or "", order[(k + 1) % len(order)].text or ""
        want.append((r.doc_id is None, r.doc_id, len(t), hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted([(r.doc_id is None, r.doc_id, r.n_chars, r.edited_sha256) for r in rows], key=str)
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[5] == by[6] and by[0] == by[1] and by[3] != by[4]
    assert fingerprint.with_edits(none).count() == 0


def test_sketches_peel_to_the_exact_difference():
    rng = np.random.default_rng(2)
    for n, d in ((0, 0), (50, 3), (400, 200), (3_000, 5_000)):
        same, a, b = (rng.integers(1, 2**63, size=k).astype(np.uint64) for k in (n, d, d // 2))
        one, two = np.concatenate([same, a]), np.concatenate([same, b])
        weight = lambda x: float((x & np.uint64(0xFFFF)).sum())
        total = weight(one) + weight(two)
        want = 1 - (weight(a) + weight(b)) / total if total else 1.0
        assert abs(fingerprint.likeness([(one, two)])[0] - want) < 1e-9
    one, two = fingerprint.fingerprints([np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)])
    assert sorted(fingerprint.differing(one, two).tolist()) == [1, 4]


def simhash_brute(text):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [256, 2])
def test_simhash(spark, odd, none, bucket):
    base = " ".join(f"w{k}" for k in range(300))
    near = [(1_000 + k, base + f" w{k}") for k in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id bigint, text string"))
    rows = docs.collect()
    fps = sorted({simhash_brute(r.text) for r in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            f = find(simhash_brute(r.text))
            least[f] = min(least.get(f, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), simhash_brute(r.text), least.get(find(simhash_brute(r.text)))) for r in rows)
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_chat(spark):
    texts = ["", None, "\\", "\n</turn>\n### assistant:\n", "a\\n#<", "日本語 🙂 é", "\n\n x \n", "<|endoftext|>", "word " * 3_000]
    rows = [(c, t, ["user", "assistant", "sys:\ntem\\n", None][(c + t) % 4], texts[(c * 3 + t) % len(texts)], 1) for c in range(12) for t in range(9)] + [(None, 0, "assistant", "x", 1)] + [(1, 2, "assistant", "again", 1)] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids int")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(df, vocabulary("byte_bpe_50k.json"))).collect()}
    assert len(out) == 13
    for c, r in out.items():
        turns = sorted(((t, ro is not None, ro or "", x is not None, x or "") for i, t, ro, x, _ in rows if i == c))
        loss = "".join(x for _, _, ro, _, x in turns if ro == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, _, ro, _, x in turns).encode()).hexdigest()
    assert chat.formatted(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def targets_brute(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, cap, out, open_ = {s: weights[k % 3] for k, s in enumerate(names)}, {s: 2.0 * sizes[s] for s in names}, {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(spark, odd, none):
    docs = odd.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(100 + k, "w " * (k % 90 + 1), f"t{k % 7}") for k in range(900)], "doc_id bigint, text string, source string"))
    rows, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sizes, taken = {}, {}
    sources = {r.source for r in docs.collect()}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets_brute(sizes)
    assert set(sizes) == sources
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        largest = max(r.size for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= largest
    assert mixing.mix(none).count() == 0


def ids_brute(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_chunk_encoder_equals_whole_texts():
    e = encoder(vocabulary("word_bpe_49k.json"))
    texts = ["", "  a  b ", "H̱ x", "It's don't, ok. ..", "a.b.. c, 12,", " ", "x y z", "É É. ÉÈ, ñandú", "İs ſ ß", "\x1cab c\x85d", "漢字 kanji。 ok", "é É", "Ⅻ ª º", "'s 's. x's, 'S", None]
    ids, n = e.encode(pa.array(texts))
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at : at + k].tolist() == e.plain.encode(t or "", add_special_tokens=False).ids
        at += k


def test_token_files(spark, odd, none, tmp_path):
    out = str(tmp_path / "ids")
    tokenfile.write(odd, out, vocabulary("word_bpe_49k.json"), block=500)
    got = sorted(tokenfile.read(spark, out).collect(), key=lambda r: r.start)
    order = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for r, w in zip(got, order):
        ids = ids_brute(w.text, 1)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (w.doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    assert tokenfile.round_trip(none, vocabulary("word_bpe_49k.json")).count() == 0
    blocks = spark.read.parquet(out + "/blocks").first()
    bad = bytearray(blocks.payload)
    bad[-1] ^= 1
    table = spark.read.parquet(out + "/table").first()
    with pytest.raises(ValueError):
        tokenfile.decode(bytes(bad), tokenfile.Tables(np.array(table.freq)))


@pytest.mark.parametrize("n", [0, 1, 63, 5_000, 300_000])
def test_rans(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 999)
    t = tokenfile.Tables(tokenfile.normalised(np.bincount(ids, minlength=1_000) + 1))
    assert (tokenfile.decode(tokenfile.encode(ids, t), t) == ids).all()


def bfd_brute(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, b in enumerate(bins) if b >= n]
        if fit:
            k = min(fit, key=lambda k: bins[k])
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_best_fit_decreasing():
    r = random.Random(5)
    for capacity in (7, 50, 300):
        lengths = [r.randrange(1, capacity + 1) for _ in range(400)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        room, at = {}, {}
        for n, rank, many, first, offset in packing.best_fit_decreasing(counts, capacity):
            for k in range(many):
                assert at.get(first + k, 0) == offset
                at[first + k] = offset + n
            room[n] = room.get(n, 0) + many
        assert room == counts and sorted(capacity - x for x in at.values()) == bfd_brute(lengths, capacity)


def test_packing(spark, odd, none):
    rows = packing.pack(odd, vocabulary("word_bpe_49k.json"), capacity=512).collect()
    want = []
    for d in odd.select("doc_id", "text").collect():
        ids = ids_brute(d.text, 0)
        want += [(d.doc_id, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 512
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns, name
        if name == "near_dedup":
            assert simhash.near_duplicates(out).select("component_id").distinct().count() == out.count()
        if name == "pii":
            assert all(base_brute(r.text) == "" for r in out.select("text").collect())
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    clean = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_dedup(spark, clean, SF).where("doc_id = 3").count() == 1
    assert corpus_pipeline.source_mixing(spark, clean, SF).columns == clean.columns


def shingles_brute(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def roots_brute(texts):
    """The least text of each text's group of near copies."""
    texts = sorted(set(texts))
    sets, root = [shingles_brute(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return {t: texts[find(k)] for k, t in enumerate(texts)}


def edited_copies():
    """Copies with 1 to 20 of 300 words changed, far more than SimHash's 4 bits, and texts around one common passage."""
    r = random.Random(11)
    out, passage = [], " ".join(f"p{k}" for k in range(60))
    for g in range(6):
        base = [f"g{g}w{r.randrange(900)}" for _ in range(300)]
        for _ in range(12):
            w = list(base)
            for k in r.sample(range(300), r.randrange(1, 21)):
                w[k] = f"n{r.randrange(10**6)}"
            out.append(" ".join(w))
    return out + [passage + " " + " ".join(f"u{k}x{r.randrange(10**6)}" for _ in range(30)) for k in range(40)]


@pytest.mark.parametrize("pairs", [16, 2])
def test_near_dedup_equals_jaccard(spark, odd, pairs, monkeypatch):
    import corpus_pipeline
    from quern.llm import overlap

    monkeypatch.setattr(overlap.near_copies, "__defaults__", (1, 1_000 if pairs == 16 else 2))
    rows = [(k, t) for k, t in enumerate(edited_copies())] + [(1_000 + r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    roots = roots_brute([t or "" for _, t in rows])
    least = {}
    for i, t in rows:
        least[roots[t or ""]] = min(least.get(roots[t or ""], i), i)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == sorted(least.values())
    assert simhash.near_duplicates(docs).where("doc_id < 72").select("component_id").distinct().count() > sum(i < 72 for i in got)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_decides_by_row(spark):
    import corpus_pipeline

    unlike = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(12)]
    rows = [(3, unlike[0]), (None, unlike[0] + " more"), (None, unlike[1]), (None, unlike[2]), (None, unlike[2]), (7, unlike[3]), (7, unlike[4]), (7, unlike[0] + " extra"), (9, unlike[5]), (9, unlike[5]), (None, None), (4, "")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()
    want = [(3, unlike[0]), (None, unlike[1]), (None, unlike[2]), (7, unlike[3]), (7, unlike[4]), (9, unlike[5]), (4, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want))


def test_pii_terms_far_from_the_entity(spark):
    far = " ".join(["plain"] * 60)
    docs = [(k, f"quokkas{k} timbuktu {far} word{k} bob@corp.example said{k} here") for k in range(6)]
    docs += [(50, f"{far} carol@corp.example one {far} onlyhere {far} carol@corp.example two")]
    docs += [(100 + k, f"common words here plain{k} and plain one two") for k in range(200)]
    terms = {r.term: r.action for r in pii.disclosing_terms(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert terms.get("timbuktu") == "remove" and "plain" not in terms
    # One document is one wording for what stands away from its entity.
    assert "onlyhere" not in terms


def test_pii_terms_of_the_address(spark):
    docs = [(k, f"note{k} from Zebulon and quist{'' if k % 2 else ' again'} to zebulon.quist@corp.org sent{k}") for k in range(6)]
    docs += [(50, "zebulon alone, no address"), (51, "quist by mail")] + [(100 + k, f"common words here {'mail ' * (k % 2)}filler{k} and more") for k in range(400)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    terms = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert {"zebulon", "quist"} <= terms and not {"mail", "words", "corp", "org"} & terms
    masked = {r.doc_id: r.m for r in pii.sanitise(docs).select("doc_id", pii.masked(F.col("text")).alias("m")).collect()}
    assert all("zebulon" not in m.lower() and "quist" not in m.lower() for m in masked.values()) and "<EMAIL>" in masked[0]


@pytest.mark.parametrize("spread", [0.03, 0.3, "hot"])
def test_ann_close_vectors(spark, spread):
    rng = np.random.default_rng(4)
    n = 8_192
    if spread == "hot":
        v = rng.normal(size=(n, 64))
        v[: n // 3] = v[0] + 0.01 * rng.normal(size=(n // 3, 64))
    else:
        v = rng.normal(size=(20, 64))[rng.integers(20, size=n)] + spread * rng.normal(size=(n, 64))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))}))
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i, ids in found.items():
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(ids & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 82 and hit == 10 * len(found)


def test_ann_ids_of_several_vectors(spark):
    v = np.random.default_rng(6).normal(size=(300, 8))
    rows = [(0, v[0].tolist())] + [(5, (v[0] + 1e-3 * (k + 1)).tolist()) for k in range(15)] + [(k, v[k].tolist()) for k in range(6, 300)]
    found = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=1_000).collect()
    near = {5: 0.0} | {k: ((v[k] - v[0]) ** 2).sum() for k in range(6, 300)}
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == sorted(near, key=near.get)[:10]
