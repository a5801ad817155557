"""The training-data operators against brute force, on a fixture of awkward rows and on the smallest tables."""

import hashlib
import itertools
import math
import os
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordinex.llm import byte_bpe, fingerprint, line_dedup, lm_score, near_copies, packing, quality, simhash, token_counts, token_files, unigram, url_filter, word_bpe
from ordinex.llm.queries import ORACLES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "A line that is long enough to be counted as a key, number %d."
AWKWARD = [
    None, "", " ", "\n", "one", "two words", "ÉTÉ\u00a0été  e\u0301te\u0301", "x" * 30000, "a b " * 4000,
    "The\tTHE\x0bthe\x0c\r\n the", "emoji 🙂🙂 日本語\x1cend", "<|endoftext|> it's 12 34's",
    *["  " + LINE % 1 + "\t\nown line %d\n" % k + LINE % 2 for k in range(6)],
    (LINE % 1).upper(), LINE % 1 + "\n" + LINE % 1,
    *["the quick brown fox jumps over the lazy dog again and again until number %d" % (k % 3) for k in range(9)],
]
DOCS = "doc_id long, text string, fp string, label string, n_lines int, `start` int, `Fingerprint` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", None, 1, None, None) for k, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, "no id here"), (None, None), (5, LINE % 3), (5, LINE % 3), (5, "other text of five"), (9, "nine"), (1, "one")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def whole(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def awkward():
    return list(enumerate(AWKWARD))


# 1. Line dedup


def deduped(rows, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    hot = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    return {i: "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i) for i, t in rows}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(spark, docs, batches):
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs, batches=batches).collect()}
    want = deduped(awkward())
    for i, t in awkward():
        kept = got[i]["text"] or ""
        assert kept == want[i] and got[i]["fp"] == "clash"
        assert got[i]["ox_n_lines"] == (t or "").count("\n") + 1
    assert got[19]["ox_n_dropped"] == 0 and got[18]["ox_n_dropped"] == 1


def test_line_dedup_of_many_and_repeated_lines(spark):
    """Time in proportion to lines, also where most are dropped or repeated."""
    many = [LINE % k for k in range(3000)]
    rows = [(i, "\n".join(many[: 3000 - 100 * i] + [LINE % 5000] * 2000)) for i in range(6)]
    for ids in (lambda i: i, lambda i: f"id{i}"):
        df = spark.createDataFrame([(ids(i), t) for i, t in rows])
        got = {r["_1"]: r["_2"] for r in line_dedup.drop_lines(df, id_col="_1", text_col="_2").collect()}
        want = deduped(rows)
        assert got == {ids(i): t for i, t in want.items()}


def test_line_dedup_of_odd_rows(odd, empty):
    assert line_dedup.drop_lines(odd, min_docs=2).count() == 7
    assert line_dedup.drop_lines(empty).count() == 0


def test_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    for top in (30, 20, 10, 5):
        store.add(spark.createDataFrame([(top, 1, 1), (top, top, 2)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    got = {r["h1"]: (r["n_docs"], r["keeper"]) for r in store.totals().filter("h2 = 1 OR h1 = 20").collect()}
    assert got == {1: (4, 30), 20: (1, 20)}


# 2. Packing


@pytest.mark.parametrize("seed", range(4))
def test_plans_fill_sequences_without_gaps(seed):
    rnd = random.Random(seed)
    hist = Counter(min(256, int(rnd.paretovariate(0.9) * 9)) for _ in range(3000 * seed + 5))
    plan = packing.Plan(hist, 256)
    placed, fill = Counter(), {}
    for length, first, count, sequence, offset in plan.blocks:
        assert first == placed[length]
        placed[length] += count
        for s in range(sequence, sequence + count):
            fill.setdefault(s, []).append((offset, length))
    assert placed == hist and len(fill) == plan.sequences
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert plan.sequences <= math.ceil(sum(k * v for k, v in hist.items()) / 256) * 1.02 + 2


def test_least_squares_against_a_grid():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.random((5, 4)), rng.random(5) * 3
        x = packing.nnls(a, b)
        assert (x >= 0).all()
        r = a.T @ (b - a @ x)
        assert (r <= 1e-6).all() and np.abs(r[x > 1e-9]).max(initial=0) < 1e-6  # the optimum's conditions


def test_packed_documents(docs, odd, empty):
    path = P.path("word_bpe_49k.json")
    enc = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 512).collect()
    want = {}
    for i, t in awkward():
        ids = enc.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            want[i, k // 512] = (k, len(ids[k : k + 512]), zlib.crc32(word_bpe.as_bytes(ids[k : k + 512])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert packing.pack_documents(odd, path).count() == 7
    assert packing.pack_documents(empty, path).count() == 0


def test_lengths_without_a_place(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, 0), (3, 0, 9), (4, 0, 4)], "doc_id int, piece int, length long")
    assert {r["doc_id"]: r["sequence_id"] for r in packing.pack(df, 8).collect()} == {1: None, 2: None, 3: None, 4: 0}


# 3. Quality rules


def test_quality_counts(docs, empty):
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    for i, t in awkward():
        t = t or ""
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = Counter(windows)
        cover = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert tuple(r[f"ox_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert r["ox_base_failed"] == (len(words) < 10 or 100 * len(cover) > 20 * len(words))
    assert quality.judged(empty).count() == 0


def test_line_rules(spark):
    clean = "Of all the lines here, this one is plain prose and ends as it should."
    bad = ["Home | News | About | Contact", "All rights reserved.", "Alle Rechte vorbehalten.", "© Tous Droits Réservés", "Política de Privacidad", "word*** other### thing%%% more$$$", "NOW!! BUY!! THIS!!", "go " * 20, " ".join(f"w{k}" for k in range(40))]
    df = spark.createDataFrame([(0, clean)] + [(k + 1, clean + "\n" + b) for k, b in enumerate(bad)] + [(99, "\n".join(bad))], "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert all(got[k]["ox_text"] == clean for k in range(len(bad) + 1)) and got[0]["ox_kept"]
    assert got[99]["ox_text"] == "" and not got[99]["ox_kept"]
    assert quality.judged(df).filter("ox_kept").select("doc_id").count() >= 4


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.judged(docs).filter("NOT ox_base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("ox_kept").cast("int")).alias("kept")).collect()
    kept = {x["quality"]: x["kept"] for x in r}
    assert kept[1] > 0.97 and kept.get(0, 0) < 0.5


# 4. SimHash


def brute_components(fps, k=3):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= k:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def plain_simhash(t):
    import xxhash

    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    lot = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in lot]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, docs, odd, empty):
    for df, rows in ((docs, awkward()), (spark.read.parquet(f"{SF}/documents.parquet"), whole(spark))):
        fps = {i: plain_simhash(t) for i, t in rows}
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
        assert got == {i: (f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}
    assert simhash.near_duplicates(odd).count() == 7
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("k", [3, 5])
def test_chains_and_dense_groups_of_fingerprints(spark, k):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = {base}
    x = base
    for j in range(40):  # a chain whose ends are far apart
        x ^= 1 << (j * 13 % 64) | 1 << (j * 29 % 64)
        fps.add(x)
    for _ in range(300):  # a dense group
        fps.add(base ^ sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 4))))
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = brute_components({s: s & (1 << 64) - 1 for s in signed}, k)
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3)
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, k)).collect()}
    assert {s: labels.get(s, s) for s in signed} == want
    own = np.array(sorted(f for f in fps if (f ^ base) >> 20 == 0), dtype=np.uint64)
    pairwise = simhash.linked(own)
    bits = [b for b in range(64) if int(np.bitwise_or.reduce(own ^ own[0])) >> b & 1]
    assert len(simhash._looked_up(own, 3, bits)) == len(pairwise)


# 5. Byte-level BPE


def test_byte_bpe_equals_the_library(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    coder = byte_bpe.ByteBpe(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rnd = random.Random(1)
    texts = [t or "" for _, t in awkward() + whole(spark)] + ["".join(rnd.choice("ab '\n\x1c1é\xa0.") for _ in range(50)) for _ in range(300)]
    for t in texts:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()}
    assert all(bytes(got[i]["decoded"]) == (t or "").encode() for i, t in awkward())


def test_rank_queue_orders():
    q, rnd = byte_bpe.RankQueue(50_000), random.Random(0)
    items = [(rnd.randrange(50_000), rnd.randrange(1000)) for _ in range(5000)]
    for x in items:
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items) and not q.top and not any(q.low) and not q.buckets


# 6 and 7. Unigram models


def segmentations(v, s):
    if not s:
        yield []
        return
    for n in range(1, min(v.longest, len(s)) + 1):
        if s[:n] in v.index:
            for rest in segmentations(v, s[n:]):
                yield [v.index[s[:n]], *rest]
    if s[0] not in v.index:
        for rest in segmentations(v, s[1:]):
            yield [*[v.bytes[b] for b in s[0].encode()], *rest]


def test_lattice_sums_all_segmentations():
    v = unigram.vocabulary(P.path("piece_bpe_32k.model"))
    lattice = lm_score.Lattice(v, v.log_p)
    for w in ("the", "thering", "there", "thering", "é\u07f7x", "a🙂b", ""):
        all_ = list(segmentations(v, "▁" + w))
        p = [math.exp(sum(v.log_p[k] for k in x)) for x in all_]
        assert lattice.log_marginal(w) == pytest.approx(math.log(sum(p)))
        into, far, want = np.zeros(v.size), np.zeros(v.size), Counter()
        lattice.expect(w, 2.0, into)
        lattice._expect_long(w, 2.0, far)
        assert far == pytest.approx(into)
        for x, q in zip(all_, p):
            for k in x:
                want[k] += 2 * q / sum(p)
        assert {k: into[k] for k in np.flatnonzero(into)} == pytest.approx(dict(want))
    assert sum(math.exp(v.log_p[k]) for k in v.kept) == pytest.approx(1)


def test_operators_take_odd_rows(spark, odd, empty):
    """Null and repeated ids, repeated rows, empty tables, where no other test holds them."""
    path = P.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(odd, path, P.PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in byte_bpe.decode(ids, path, P.PATTERN).collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert byte_bpe.encode(empty, path, P.PATTERN).count() == 0 and quality.judged(odd).count() == 7
    pages = spark.createDataFrame([(None, "http://a.net/de/1"), (1, None), (1, "http://a.net/de/1"), (1, "http://a.net/de/1"), (2, "h" * 50_000)], "page_id long, url string")
    got = url_filter.judge(pages, URL_RULES).collect()
    assert sorted((r["page_id"] or 0, r["rule"]) for r in got if r["rule"]) == [(0, "net/de/"), (1, "net/de/"), (1, "net/de/")] and len(got) == 5


def test_scores(spark, docs, odd, empty):
    path = P.path("piece_bpe_32k.model")
    for df, rows in ((docs, awkward()), (spark.read.parquet(f"{SF}/documents.parquet"), whole(spark))):
        words = {i: lm_score.words_of(t) for i, t in rows}
        held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
        c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
        ends = sum(not h for h in held.values())
        n, v = sum(c.values()) + ends, len(c) + 1
        got = {r["doc_id"]: r for r in lm_score.score(df, path).collect()}
        assert len(got) == len(rows)
        for i, ws in words.items():
            r = got[i]
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    # Held-out documents are likelier under the model than without training.
    words = spark.createDataFrame([], "word binary, c long")
    fitted = [r for i, r in got.items() if held[i]]
    plain = lm_score.Lattice(unigram.vocabulary(path), unigram.vocabulary(path).log_p)
    untrained = sum(sum(plain.log_marginal(w.decode()) for w in lm_score.words_of(t)) / math.log(10) for i, t in rows if held[i])
    assert sum(r["score"] for r in fitted) > untrained and words.count() == 0
    assert lm_score.score(odd, path).count() == 7 and lm_score.score(empty, path).count() == 0


def test_scores_against_all_segmentations(spark):
    """The fitted model, worked out from every segmentation of every word of a small corpus."""
    path = P.path("piece_bpe_32k.model")
    v = unigram.vocabulary(path)
    texts = ["the thin hat", "that at the the", "Hat, or hut? é", "\u07f7 nothing", "", "at that hut", "thin thin the", "or at", "hut or hat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words = {i: lm_score.words_of(t) for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    assert any(held.values())
    ends = sum(not h for h in held.values())
    n = np.zeros(v.size)
    n[v.kept] = np.exp(np.array(v.log_p)[v.kept]) * len(v.kept)
    for i, ws in words.items():
        for w in ws if not held[i] else []:
            cuts = list(segmentations(v, "▁" + w.decode()))
            p = [math.exp(sum(v.log_p[k] for k in c)) for c in cuts]
            for c, q in zip(cuts, p):
                for k in c:
                    n[k] += q / sum(p)
    total = n.sum() + ends
    marginal = lambda w: sum(math.prod(n[k] / total for k in c) for c in segmentations(v, "▁" + w))
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, path).collect()}
    assert got == pytest.approx({i: sum(math.log10(marginal(w.decode())) for w in ws) + math.log10(ends / total) for i, ws in words.items()})


def test_token_counts_are_the_best_segmentations(spark, docs, empty):
    path = P.path("piece_bpe_32k.model")
    v = unigram.vocabulary(path)
    trie = token_counts.CountTrie(v)
    for w in ("the", "there", "therein", "é\u07f7", "🙂a", "ingthe"):
        best = min((-sum(v.log_p[k] for k in x), len(x)) for x in segmentations(v, "▁" + w))
        assert trie.insert(w) == best[1], w
    nodes = len(trie.best)
    trie.insert("the")
    assert len(trie.best) == nodes
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()}

    def plain(word):
        """The fewest tokens of a best segmentation, by a table of ends."""
        s = "▁" + word
        best = [(0.0, 0)] + [(math.inf, 0)] * len(s)
        for i in range(1, len(s) + 1):
            steps = [(j, v.log_p[v.index[s[j:i]]], 1) for j in range(max(0, i - v.longest), i) if s[j:i] in v.index]
            if s[i - 1] not in v.index:
                raw = s[i - 1].encode()
                steps.append((i - 1, sum(v.log_p[v.bytes[b]] for b in raw), len(raw)))
            costs = [(best[j][0] - x, best[j][1] + k) for j, x, k in steps]
            low = min(c for c, _ in costs)
            best[i] = min((c, k) for c, k in costs if c <= low + 1e-9)
        return best[-1][1]

    for i, t in awkward():
        ws = WORD.findall(t or "")
        if len(t or "") < 20_000:
            assert got[i] == (len(ws), sum(map(plain, ws)))
    odd_rows = spark.createDataFrame([(None, "two words"), (None, None), (5, "two words"), (5, "two words")], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in token_counts.token_counts(odd_rows, path).collect()) == sorted(str((i, *((2, 2 * 1) if t else (0, 0)))) for i, t in [(None, 1), (None, 0), (5, 1), (5, 1)])
    assert token_counts.token_counts(empty, path).count() == 0


# 8. Fingerprints


def plain_canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(re.split(r"[\s\x1c-\x1f]+", t)).strip()


def test_fingerprints(spark, docs, odd, empty):
    got = {r["doc_id"]: r for r in fingerprint.edited_likeness(docs).collect()}
    rows = sorted(((i, t or "") for i, t in awkward()), reverse=True)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_next"] == float(plain_canonical(t) == plain_canonical(following))
        assert r["near_edited"] == float(plain_canonical(t) == plain_canonical(edited)) == float(r["fingerprint"] == r["edited_fingerprint"])
    classes = {}
    for i, t in rows:
        classes.setdefault(plain_canonical(t), set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in classes.values()) and len({x for c in classes.values() for x in c}) == len(classes)
    assert fingerprint.edited_likeness(odd).count() == 7
    assert fingerprint.edited_likeness(empty).count() == 0


def test_unequal_bytes_in_a_bucket_get_ordinals(spark):
    df = spark.createDataFrame([("d", "x"), ("d", "y"), ("d", "y"), ("e", "z")], "digest string, canon string")
    c = fingerprint.collisions(df)
    assert {(r["digest"], r["canon"], r["ordinal"]) for r in c.collect()} == {("d", "x", 0), ("d", "y", 1)}
    assert {r["f"] for r in fingerprint.resolved(df, "digest", "canon", "f", c).collect()} == {"d", "d-1", "e"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_documents_over_many_ranges(spark, kind):
    ids = random.Random(2).sample(range(10**6), 500)
    ids = ids if kind == "long" else [f"d{i}" for i in ids]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], f"doc_id {kind}, text string")
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(df, rows_per_range=7).collect()}
    ids.sort(reverse=True)
    assert got == {f"t{a}": f"t{b}" for a, b in zip(ids, [*ids[1:], ids[0]])}


# 9. URL filter


def test_url_rules(spark):
    def verdict(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/71?x=1#y", "https://example.com/en/8", "x://b.net/de/1", "x://example.net/de/88", "x://org/es/", "x://orgs/es/", "x://notexample.com/en/7#://", "a\n://h\ni/p\nq?z", "x://com?/en/"]
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls * 2)], "page_id long, url string, host string, verdict string")
    for r in url_filter.judge(df, URL_RULES).collect():
        host, path, rule, v = verdict((urls * 2)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == v if v else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


def test_trees_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(url_filter.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    t = url_filter.fit_trees(x[:2000], y[:2000])
    assert ((t.decision(x[2000:]) >= 0) == y[2000:]).mean() > 0.95


def test_trees_find_the_labels_of_unseen_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found, commoner = url_filter.held_out_accuracy(pages, URL_RULES)
    assert found > commoner + 0.05 and found > 0.8


def test_a_label_is_no_part_of_its_own_statistics(spark):
    urls = ["http://a.com/en/1", "http://b.com/en/2", "http://example.com/en/7", "http://x.zz/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls * 2)], "page_id long, url string")
    f = url_filter._features(pages, URL_RULES, "page_id", "url")
    b, overall = url_filter._with_suffixes(f, f.filter("rule IS NOT NULL"))
    rows = b.collect()
    assert overall == pytest.approx(4 / 6)
    for r in rows:
        rest = [q for q in rows if q["rule"] and q["suffix"] == r["suffix"] and (r["rule"] is None or q["fold"] != r["fold"])]
        blocked = sum(q["ruled"] == "block" for q in rest)
        assert (r["rate"], r["n"]) == (pytest.approx((blocked + 2 * overall) / (len(rest) + 2)), pytest.approx(math.log1p(len(rest))))


# 10. Token files


def test_token_files(spark, docs, odd, empty, tmp_path):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = str(tmp_path / "t")
    token_files.write_tokens(docs, out, path)
    got = {r["doc_id"]: r for r in token_files.checksums(token_files.read_tokens(spark, out)).collect()}
    at = 0
    for i, t in awkward():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(word_bpe.as_bytes(ids)))
        at += len(ids)
    found = token_files.lookup(spark, out, [4, 6])
    assert {r["doc_id"] for r in found.collect()} == {4, 6}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    for k, df in enumerate((odd, empty)):
        token_files.write_tokens(df, f"{out}{k}", path)
        assert token_files.read_tokens(spark, f"{out}{k}").count() == df.count()


def test_word_ids_equal_the_library(spark):
    e, library = word_bpe.ChunkEncoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(8)
    texts = [t or "" for _, t in awkward() + whole(spark)] + ["".join(rnd.choice("aB'sé́İ.,1 \n\x1d\x85ʒ*") for _ in range(60)) for _ in range(300)]
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", " ", "a", "É", "ß,", "日本", "\n", "İ", "x."]
    texts += ["".join(rnd.choice(pieces) for _ in range(12)) for _ in range(600)]
    for t, ids in zip(texts, e.encode_all(texts)):
        assert ids == word_bpe.as_bytes(library.encode(t, add_special_tokens=False).ids)


# Queries and the pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, sql = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    key = lambda cols, row: repr([row[cols.index(k)] for k in sorted(cols)])
    assert sorted(key(df.columns, r) for r in df.collect()) == sorted(key(sql.columns, r) for r in sql.fetchall())


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, docs, empty):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "packing"]
    for df in (docs, empty.withColumn("n_chars", F.lit(1).cast("long"))):
        a = df
        for name, stage in corpus_pipeline.STAGES:
            b = stage(spark, a, SF)
            if name != "packing":
                assert b.columns == a.columns
            a = b
    # Stage by stage against plain code, on the awkward rows.
    q = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    judged = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert q == {i: r["ox_text"] for i, r in judged.items() if r["ox_kept"]}
    d = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert {i: t or "" for i, t in d.items()} == deduped(awkward())
    n = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}
    assert n == least_of_groups([t for _, t in awkward()])


def plain_shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def least_of_groups(texts):
    """The least place of each group of texts that pairs of Jaccard similarity 0.8 or more link, by all pairs."""
    sets = [plain_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {find(k) for k in range(len(texts))}


def test_all_pairs_at_a_similarity_of_four_fifths_are_linked(spark, docs):
    import corpus_pipeline

    rnd = random.Random(3)
    texts = [t for _, t in awkward()]
    shared = [f"s{k}" for k in range(200)]  # in all large texts
    for n in (9, 30, 90, 400, 1300, 3000):
        for edits in (1, 2, 3, n // 90 + 1, n // 60 + 1, n // 45 + 1, n // 30 + 1):
            base = [f"w{rnd.randrange(3000)}" for _ in range(n)]
            if n > 1000:
                base[n // 2 : n // 2 + 200] = shared
            other = list(base)
            for at in rnd.sample(range(n), edits):
                other[at] = f"x{rnd.random()}"
            texts += [" ".join(base), " ".join(other)]
    dense = [f"d{k}" for k in range(60)]
    for k in range(150):  # a large group, whose members differ in one or two words
        own = list(dense)
        for at in rnd.sample(range(60), 1 + k % 2):
            own[at] = f"y{k}"
        texts.append(" ".join(own))
    passage = [f"p{k}" for k in range(40)]
    for k in range(200):  # a passage that makes a half to nearly all of many texts, of which some are near copies
        own = [f"q{k // 2 if k % 5 else k}w{j}" for j in range((40, 12, 8, 5, 3)[k % 5])]
        texts.append(" ".join(own + passage if k % 2 else passage + own))
    want = least_of_groups(texts)
    sets = [plain_shingles(t) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a and b]
    assert sum(0.8 <= x < 0.9 for x in similar) > 20 and sum(0.7 <= x < 0.8 for x in similar) > 20  # on both sides of the limit
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for got in (corpus_pipeline.near_dedup_stage(spark, df, SF), near_copies.survivors(df, hot=3), near_copies.survivors(df, hot=40)):
        assert {r["doc_id"] for r in got.collect()} == want


def test_near_dedup_of_files_and_clashing_columns(spark, docs, empty, tmp_path):
    import corpus_pipeline

    want = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}
    docs.withColumns({"node": F.lit(1), "label": F.lit("x"), "_metadata": F.lit("own")}).write.parquet(str(tmp_path / "a"))
    docs.write.parquet(str(tmp_path / "b"))
    for name in "ab":  # with a column of the name that files' rows are addressed by, and without
        df = spark.read.parquet(str(tmp_path / name))
        got = corpus_pipeline.near_dedup_stage(spark, df, SF)
        assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == want
    assert corpus_pipeline.near_dedup_stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("most", [None, 2])
def test_runs_go_on_over_batches(most):
    import pyarrow as pa

    h = [1, 1, *[2] * 60, 3, 4, 4, 4, 5, *[6] * 40]
    for step in (1, 2, 3, 5, 13, 200):
        batches = [pa.record_batch([pa.array(h[k : k + step]), pa.array(list(range(k, min(k + step, len(h)))))], names=["h", "node"]) for k in range(0, len(h), step)]
        rows, whole = [], []
        for (x, y), long in near_copies._runs(iter(batches), most):
            rows += list(zip(x.tolist(), y.tolist()))
            whole += [] if long else x.tolist()
        assert rows == [(x, k) for k, x in enumerate(h)]
        assert all(whole.count(x) in (0, h.count(x)) for x in set(h)) and (most or whole == h)


def test_frequent_shingles_are_told_apart(spark):
    rnd = random.Random(6)
    held = {(h, n) for n in range(3000) for h in (rnd.randrange(40) if n % 3 else 7, 100 + n // 2, 10_000 + n)}
    df = spark.createDataFrame([(*x, 0) for x in held], "h long, node long, at long").repartition(4)
    n = Counter(h for h, _ in held)
    for hot in (20, 64, 5000):
        counted = near_copies._gathered(df, lambda b: b, hot).mapInArrow(lambda b, hot=hot: near_copies._shared(b, hot), "h long, node long, df long")
        got = {(r["h"], r["node"]): r["df"] for r in counted.collect()}
        assert got == {(h, x): n[h] if n[h] <= hot else near_copies.LAST for h, x in held if n[h] > 1}


def test_words_of_least_probability_are_trained_on(spark):
    path = P.path("piece_bpe_32k.model")
    v = unigram.vocabulary(path)
    # Scores as low as of a vocabulary whose bytes are all but impossible: what a linear sum can't hold.
    low = list(v.log_p)
    for k in v.bytes.values():
        low[k] -= 20
    words = [c * n for c in "\U0001fae0\u0e81\u1200\u0b95\u1780\u10d0" for n in (1, 7, 8, 11, 20, 40, 58, 60, 61)] + ["the" + "\U0001fae0" * 57]
    for log_p in (v.log_p, low):
        lattice = lm_score.Lattice(v, log_p)
        for w in words:
            got, want = np.zeros(v.size), np.zeros(v.size)
            lattice.expect(w, 3.0, got)
            lattice._expect_long(w, 3.0, want)
            assert want.sum() > 0 and got == pytest.approx(want)
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    scores = [r["score"] for r in lm_score.score(df, path).collect()]
    assert len(scores) == len(words) and all(math.isfinite(x) for x in scores)


def test_bytes_stand_behind_the_last_merge():
    v = unigram.vocabulary(P.path("piece_bpe_32k.model"))
    merges = sorted((v.log_p[k] for p, k in v.index.items() if set(p) != {unigram.SPACE}))
    of_bytes = {v.log_p[k] for k in v.bytes.values()}
    assert len(of_bytes) == 1 and merges[0] - 0.001 < of_bytes.pop() < merges[0]


def test_near_dedup_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"t{k}w{j}" for j in range(12))
    rows = [(1, text(1))] * 3  # a repeated row
    rows += [(2, text(2)), (5, text(2)), (5, text(3))]  # one text of an id is a copy, the other is not
    rows += [(None, text(4)), (None, text(4)), (None, text(2)), (None, text(5)), (7, text(5))]  # null ids
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_dedup_stage(spark, df, SF).collect()))
    assert got == Counter([(1, text(1)), (2, text(2)), (5, text(3)), (None, text(4)), (7, text(5))])


def test_line_dedup_counts_documents(spark):
    rows = [(1, LINE % 1)] * 4 + [(2, LINE % 1)]  # five rows, two documents
    rows += [(k, LINE % 2) for k in (3, 3, 4, 5, 6, 7)]  # six rows, five documents
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([*rows[:5], *[(k, "" if k < 7 else t) for k, t in rows[5:]]])
