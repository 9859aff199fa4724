"""The ten operators against brute force on small fixtures, and on awkward tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import chat_windows as chat
from strandflow.llm import exact_dedup, jaccard_join, langid_ppm, latent_decontamination, mixing, pii_disclosure, sharding, substring_dedup, url_reputation
from strandflow.llm._graph import components
from strandflow.llm._text import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Prose with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    r = np.random.default_rng(1)
    vocab = ["".join(r.choice(list("abcdefghij"), size=r.integers(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocab, size=n))
    texts = [say(int(n)) for n in r.integers(1, 300, size=120)]
    shared = say(60)
    texts += [f"{say(80)} {shared} {say(40)}" for _ in range(15)]
    base = say(200).split()
    for k in range(20):
        near = list(base)
        near[(7 * k) % 200] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0]] * 12 + [texts[1].replace(" ", "\t\n", 1), texts[1] + "  ", None, None, "", " \t ", "one", "One", "é ü ß", say(6000), "a b c d", "A B C D", "x " * 500]
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "hot", "hot")[i % 5]) for i, t in enumerate(texts)]
    return [*rows, rows[5]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_words_are_those_of_the_pattern():
    texts = [None, "", "  a\tb ", "é\x0bü x", "end", "\x1fnot\x1cspace\x85here"]
    w = words(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    got = [[raw[w.starts[k] : w.ends[k]].decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    same = words(pa.array(["Ab cd", "ab Cd"]), lower=True).hashes
    assert same[0] == same[2] and same[1] == same[3] and same[0] != same[1]


def test_sharding(spark, docs, empty, corpus):
    got = sharding.shard_documents(docs, 7).toPandas()
    assert len(got) == len(corpus)
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["place"]) == list(range(len(g)))
    assert sharding.shard_documents(empty, 7).count() == 0
    sizes = sharding.slot_bytes(docs).cache()
    before = sharding.new_map(sizes, 7).cache()
    after = sharding.add_shard(before, sizes, 7).toPandas().set_index("slot")
    was = before.toPandas().set_index("slot")
    moved = after[after["shard"] != was["shard"].reindex(after.index)]
    assert set(moved["shard"]) == {7} and set(after["version"]) == {2}
    extra = docs.withColumn("shard", F.lit("clash")).withColumn("bytes", F.lit(1))
    assert sharding.assign(extra, 3).count() == len(corpus)


def test_versions_of_the_slot_map_are_stored(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    one = sharding.shard_documents(docs, 5, path=path).toPandas()
    sizes = sharding.slot_bytes(docs)
    sharding.grow(sizes, path, 5)
    sharding.grow(sizes, path, 6)
    assert sharding.load_map(spark, path, 1).count() == sharding.load_map(spark, path).count() == sizes.count()
    first, last = (sharding.load_map(spark, path, *v).toPandas().set_index("slot") for v in ((1,), ()))
    assert set(first["version"]) == {1} and set(last["version"]) == {3} and set(last["shard"]) <= set(range(7))
    assert set(zip(one["virtual_slot"], one["shard"], strict=True)) == set(first["shard"].items())
    assert set(last["shard"][last["shard"] != first["shard"].reindex(last.index)]) <= {5, 6}


def test_hot_hosts_repeated_rows_and_clashing_columns(spark):
    rows = [(i, "http://hot.example.org/a", "x") for i in range(300)] + [(0, "http://hot.example.org/a", "x"), (None, None, None), (1000, "http://a.b.co.uk/q", "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("n", F.lit(1)).withColumn("bad", F.lit("z")).withColumn("mean", F.lit(0))
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "page_id long, bad int")
    got = url_reputation.filter_urls(d, labels, []).toPandas()
    assert len(got) == 303 and set(got[got["host"] == "hot.example.org"]["verdict"]) == {"block"} and (got["host"] == "").sum() == 1


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://WWW.Example.com/en/x?q#f", "https://a.b.net/es/", "x://host", "http://h.com?x/y", "http://e.net#/fr/", "http://badexample.com/en/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    labels = spark.createDataFrame([(0, None), (3, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(d, labels, rules).collect()}
    assert got[0] == ("", "", None, got[0][3]) and got[1][:3] == ("", "", None)
    assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[3] == ("a.b.net", "/es/", "net/es/", "block")
    assert got[4][:2] == ("host", "") and got[5][:3] == ("h.com", "", None) and got[6][:2] == ("e.net", "")
    assert got[7][2:] == ("com/", "allow")
    assert url_reputation.filter_urls(d.limit(0), labels, rules).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    pages = [(i, f"http://h{i % 10}.bad.org/p") for i in range(400)] + [(1000 + i, f"http://h{i % 10}.good.org/p") for i in range(400)] + [(5000, "http://new.bad.org/"), (5001, "http://new.good.org/")]
    labels = [(i, 1) for i in range(400)] + [(1000 + i, 0) for i in range(400)]
    got = url_reputation.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), []).toPandas().set_index("page_id")
    assert got["verdict"][0] == "block" and got["verdict"][1000] == "allow" and got["bound"][5000] > got["bound"][5001]


def brute_seats(votes, n):
    seats = [0] * len(votes)
    for _ in range(n):
        q = [v / (2 * s + 1) for v, s in zip(votes, seats)]
        seats[q.index(max(q))] += 1
    return seats


@pytest.mark.parametrize("votes, n", [([53, 24, 23], 7), ([1, 1, 1, 100], 2), ([5, 5, 5], 4), ([10, 0, 3], 9), ([7.5, 2.25, 90.1, 4.0], 1000)])
def test_seats_go_to_the_highest_quotients(spark, votes, n):
    p = spark.createDataFrame([(i, float(v), n) for i, v in enumerate(votes)], "k int, v double, n long")
    got = [r.quota for r in mixing.apportion(p, [], "k", "v", "n").orderBy("k").collect()]
    assert got == brute_seats(votes, n)


def test_mixing(spark, docs, empty, corpus):
    a, b = mixing.mix(docs).toPandas(), mixing.mix(docs.repartition(3)).toPandas()
    assert len(a) == len(corpus) and (a["taken"] <= 3 * a["size"]).all()
    key = ["doc_id", "size", "taken"]
    assert a.sort_values(key)[key].to_numpy().tolist() == b.sort_values(key)[key].to_numpy().tolist()
    per = a.groupby(a["source"].fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(per["taken"] - per["target"]) <= 32 * 3).all() and (per["target"] <= 3 * per["size"] + 1e-6).all()
    assert abs(per["target"].sum() - per["size"].sum()) < 1e-3
    assert mixing.mix(empty).count() == 0


def test_exact_dedup(docs, empty, corpus):
    groups = defaultdict(list)
    for k, (i, t, _, _) in enumerate(corpus):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, k))
    got = exact_dedup.dedup(docs).toPandas()
    assert len(got) == len(corpus) and got["kept"].sum() == len(groups)
    best = {hashlib.sha256(n.encode()).digest(): (min(g)[1], len(g)) for n, g in groups.items()}
    for r in got.itertuples():
        assert (r.keep_id, r.group_size) == best[bytes(r.digest)]
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_dedup_keeps_large_and_missing_ids_apart(spark):
    big = 2**53
    rows = [(None, "a b"), (big + 1, "ab"), (big + 3, "a  b"), (big + 2, "c"), (None, "c"), (big + 5, None), (None, " \x0b"), (7, "x\ty"), (7, "x\ty"), (8, "z" * 50_000)]
    got = exact_dedup.dedup(table(spark, [(i, t, None, None) for i, t in rows])).collect()
    found = sorted((r.doc_id or 0, r.n_code, r.keep_id or 0, r.group_size, r.kept) for r in got)
    want = [(0, 3, big + 3, 3, False), (big + 1, 2, big + 3, 3, False), (big + 3, 4, big + 3, 3, True), (big + 2, 1, big + 2, 2, True), (0, 1, big + 2, 2, False)]
    want += [(big + 5, 0, 0, 2, False), (0, 2, 0, 2, True), (7, 3, 7, 2, True), (7, 3, 7, 2, False), (8, 50_000, 8, 1, True)]
    assert found == sorted(want)


def test_cuckoo_filter_inserts_deletes_and_grows(spark):
    index = exact_dedup.DigestFilter(capacity=8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    false = 0
    for k in keys:
        false += k in index
        index.put(k)
    assert index.resizes > 3 and false < 20 and all(k in index for k in keys)
    assert all(index.filter.delete(k) for k in keys[::2]) and all(k in index for k in keys[1::2])
    assert sum(k in index for k in keys[::2]) < 20
    live = spark.createDataFrame([(k, i) for i, k in enumerate(keys[:300])], "digest binary, n int")
    gone = spark.createDataFrame([(k,) for k in [*keys[:100], *keys[:5], *keys[1000:1100]]], "digest binary")
    assert sorted(r.n for r in exact_dedup.retire(live, gone).collect()) == list(range(100, 300))


def test_a_digest_that_was_never_live_takes_no_mark_of_another(spark):
    """Ten digests of one fingerprint and bucket, one of them live: it goes, whatever the order."""
    alike = [bytes([k]) * 8 + b"same" * 6 for k in range(10)]
    live = spark.createDataFrame([(alike[4], 1), (b"x" * 32, 2)], "digest binary, n int")
    assert [r.n for r in exact_dedup.retire(live, spark.createDataFrame([(k,) for k in alike], "digest binary")).collect()] == [2]
    assert [r.n for r in exact_dedup.retire(live, spark.createDataFrame([(k,) for k in alike if k != alike[4]], "digest binary")).orderBy("n").collect()] == [1, 2]
    pair = spark.createDataFrame([(alike[0], 1), (alike[1], 2), (alike[1], 3)], "digest binary, n int")
    assert [r.n for r in exact_dedup.retire(pair, spark.createDataFrame([(alike[0],)], "digest binary")).orderBy("n").collect()] == [2, 3]


def test_deleted_keys_stay_away_after_a_resize():
    index = exact_dedup.DigestFilter(8)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(400)]
    for k in keys[:5]:
        index.put(k)
    assert all(index.delete(k) for k in keys[:3])
    for k in keys[5:]:
        index.put(k)
    assert index.resizes and all(k in index for k in keys[3:]) and len(index.keys) == 16 * 397
    assert not any(k in index for k in keys[:3])


def test_colliding_fingerprints_are_content_of_their_own(spark, monkeypatch):
    """Every digest is a hit after the first one of its shard: groups are the same."""
    rows = [(i, f"text {i % 7}", None, None) for i in range(40)]
    want = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(table(spark, rows)).collect())
    seen = exact_dedup.digests(table(spark, rows))
    monkeypatch.setattr(exact_dedup, "_shard", lambda batches: (b.append_column("hit", pa.array([True] * b.num_rows)) for b in batches))
    live = exact_dedup.live_digests(seen)
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in seen.join(live, "digest").collect())
    assert got == want


def brute_components(corpus, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, _, _ in corpus:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_similarity_join(docs, empty, corpus):
    want = brute_components(corpus)
    got = jaccard_join.similar_documents(docs).toPandas()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert jaccard_join.similar_documents(empty).count() == 0


def test_linked_sets_share_a_key():
    r = np.random.default_rng(3)
    for n in [*range(4, 40), 64, 100, 127, 128, 200, 333, 1000]:
        for _ in range(6):
            a = np.unique(r.integers(0, 1 << 63, size=n, dtype=np.uint64))
            gone, new = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate((r.permutation(a)[gone:], r.integers(0, 1 << 63, size=new, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            keys, owner = jaccard_join.group_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), n
            order = np.argsort([len(a), len(b)])
            points = [jaccard_join.count_vector((a, b)[k]) for k in order]
            near = list(jaccard_join.near_points(np.sort([len(a), len(b)]), points, 80, np.zeros(2, bool), np.arange(2)))
            assert [(i, j.tolist()) for i, j, _ in near] == [(0, [1])]


def test_tree_finds_all_that_the_bound_allows():
    r = np.random.default_rng(4)
    points = r.poisson(2, size=(700, 64)).astype(np.uint8)
    points[::7] = points[3]
    points = points[np.argsort(points.sum(axis=1), kind="stable")]
    sizes = points.sum(axis=1).astype(np.int64)
    tree = jaccard_join.CountRTree(points, sizes)
    for i in (0, 3, 7, 699):
        bound = np.minimum(points, points[i]).sum(axis=1, dtype=np.int64)
        ratio = np.minimum(sizes, sizes[i]) * 100 >= 80 * np.maximum(sizes, sizes[i])
        want = np.flatnonzero((bound >= jaccard_join.enough(sizes, sizes[i], 80)) & ratio)
        assert sorted(tree.search(points[i], int(sizes[i]), 80)[0]) == want.tolist()
        assert sorted(tree.search(points[i], int(sizes[i]), 80, 100)[0]) == want[want >= 100].tolist()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got[i] for i in range(100, 141)) == {100} and got[7] == got[3] == 3


def brute_repeats(corpus, length):
    rows = sorted(corpus, key=lambda r: r[0])
    first = {}
    lists = [(i, WORD.findall(t or "")) for i, t, _, _ in rows]
    for i, w in lists:
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (i, p))
    out = {}
    for i, w in lists:
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < (i, p):
                gone.update(range(p, p + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [3, 20])
def test_substring_dedup(docs, empty, corpus, length):
    got = substring_dedup.remove_repeats(docs, length).toPandas()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()} == brute_repeats(corpus, length)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.itertuples())
    assert substring_dedup.remove_repeats(empty, length).count() == 0


def test_parse_follows_one_reference_at_a_time():
    doc, pos = np.array([1, 1, 1, 1, 2]), np.array([3, 4, 5, 9, 10])
    ref, at = np.array([0, 0, 7, 7, 7]), np.array([8, 9, 2, 6, 7])
    got = [c.tolist() for c in substring_dedup.parse(doc, pos, ref, at, 20)]
    assert got == [[1, 1, 1, 2], [3, 5, 9, 10], [21, 20, 20, 20], [0, 7, 7, 7], [8, 2, 6, 7]]


def test_factors_are_copies_of_their_references(spark, docs, corpus):
    d = substring_dedup.with_order(docs, F.col("doc_id"), F.col("text"))
    held = {r[0]: WORD.findall(r[1] or "") for r in d.collect()}
    found = substring_dedup.factors_of(substring_dedup.written(d, "rows"), 5).collect()
    assert len(found) > 20 and len(held) == len(corpus)
    for r in found:
        assert r.length >= 5 and held[r.doc][r.start : r.start + r.length] == held[r.ref_doc][r.ref_start : r.ref_start + r.length]
        assert (r.ref_doc, r.ref_start) < (r.doc, r.start)


def test_one_window_factors_are_compared_word_by_word(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c y"), (3, "q r s t")], f"{substring_dedup.ID} long, text string")
    found = spark.createDataFrame([(2, 1, 3, 1, 0), (3, 0, 3, 1, 0), (3, 1, 4, 1, 0)], "doc long, start long, length long, ref_doc long, ref_start long")
    assert [tuple(r) for r in substring_dedup.unequal(found, texts, 3).collect()] == [(3, 0)]


def test_substring_rows_without_an_id_or_with_a_shared_one(spark):
    say = lambda x: " ".join(f"{x}{k}" for k in range(30))
    big = 2**53 + 1
    rows = [(1, say("w")), (None, say("w")), (None, say("v")), (1, say("u")), (big, say("t")), (big + 1, say("t")), (None, say("v")), (1, say("v")), (4, None)]
    got = sorted((r.n_removed, r.doc_id is None, r.doc_id or 0) for r in substring_dedup.remove_repeats(table(spark, [(i, t, None, None) for i, t in rows])).collect())
    assert got == sorted([(0, False, 1), (30, True, 0), (30, True, 0), (0, False, 1), (0, False, big), (30, False, big + 1), (30, True, 0), (0, False, 1), (0, False, 4)])


def test_language_id(spark, empty):
    r = np.random.default_rng(5)
    make = {"aa": ["ba", "lo", "mi"], "bb": ["xü", "qu", "zzt"]}
    rows = [(i, " ".join("".join(r.choice(make[lang], size=3)) for _ in range(30)), lang, None) for i, lang in enumerate(["aa", "bb"] * 60)]
    d = table(spark, rows)
    model = langid_ppm.train(d.where("doc_id < 60"))
    odd = table(spark, [(900, None, None, None), (901, "", None, None), (902, "123 !?", None, None), (903, "qu", None, None)])
    got = langid_ppm.identify(d.where("doc_id >= 60").unionByName(odd).withColumn("seen", F.lit(1)), model).toPandas().set_index("doc_id")
    assert all(got["lang_pred"][i] == lang for i, _, lang, _ in rows[60:])
    assert [got["lang_pred"][i] for i in (900, 901, 902)] == ["und"] * 3 and got["lang_pred"][903] == "bb"
    assert got["score"].between(0, 1).all() and (got["score"][[900, 901, 902]] == 0).all()
    none = langid_ppm.train(empty)
    assert set(langid_ppm.identify(d, none).toPandas()["lang_pred"]) == {"und"}


def brute_code(text, counts):
    """Bits of a text by the definition: longest context first, method C escapes, at last 8 bits a byte. counts: order -> {gram: n}."""
    raw, bits = b" " * langid_ppm.ORDER + text, 0.0
    for i in range(langid_ppm.ORDER, len(raw)):
        for k in range(langid_ppm.ORDER, -1, -1):
            context, gram = raw[i - k : i], raw[i - k : i + 1]
            here = {g: n for g, n in counts[k].items() if g[:-1] == context}
            whole = sum(here.values()) + len(here)
            if gram in here:
                bits -= np.log2(here[gram] / whole)
                break
            if here:
                bits -= np.log2(len(here) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(spark):
    r = np.random.default_rng(14)
    say = lambda letters, n: "".join(r.choice(list(letters), size=n))
    rows = [(i, say("abcd é", 40) if i % 2 else say("abxyz ", 40), "pq"[i % 2], None) for i in range(30)] + [(90, None, "p", None), (91, "", "q", None), (92, "no label", None, None)]
    model = langid_ppm.train(table(spark, rows))
    assert model.languages == ["p", "q"]
    texts = [say("abcd é", 30), say("abxyz ", 9), "a", "Ünseen! " * 5]
    got = langid_ppm.code_lengths(pa.array(texts), model)
    for col, lang in enumerate("pq"):
        counts = {}
        for k in range(langid_ppm.ORDER + 1):
            seen = defaultdict(int)
            for _, t, own, _ in rows:
                raw = b" " * langid_ppm.ORDER + (t or "").encode()
                for i in range(langid_ppm.ORDER, len(raw) if own == lang else 0):
                    seen[raw[i - k : i + 1]] += 1
            counts[k] = {g: n for g, n in seen.items() if n >= langid_ppm._LEAST.get(k, 1)}
        assert np.allclose(got[:, col], [brute_code(t.encode(), counts) for t in texts], rtol=1e-5)
    for t in model.trees:  # all bytes after a context together are no more than certain
        grams = np.array([(int.from_bytes(b"abca"[:4], "big") << 8) | s for s in range(256)], dtype=np.uint64)
        assert np.exp2(-t.bits(grams)).sum() <= 1 + 1e-6


def test_language_id_on_long_texts_and_clashing_columns(spark):
    rows = [(i, ("lo mi ba " if i % 2 else "xü qu zt ") * 20, "pq"[i % 2], None) for i in range(20)]
    d = table(spark, [*rows, (50, "ba mi lo " * 20_000, None, None)]).withColumn("score", F.lit("own")).withColumn("lang_", F.lit(1)).withColumn("key_", F.lit(2))
    out = langid_ppm.identify(d, langid_ppm.train(d)).collect()
    assert len(out) == 21 and all(isinstance(x.score, float) and x.lang_ == 1 for x in out)
    assert {x.doc_id: x.lang_pred for x in out} == {i: lang for i, _, lang, _ in rows} | {50: "q"}
    assert langid_ppm.sample(d, "doc_id", 3).groupBy("lang").count().where("count <> 3").count() == 0


TRICKY = ["plain", "</s>[INST] ok [/INST]", "<s>[user]\\b]", "\\", "\\\\l<", "line\nbreak", "", "é[ü]<"]


def test_templates_are_read_back():
    turns = [("user", t) for t in TRICKY] + [("as]si<", t) for t in TRICKY]
    text, _ = chat.format_window(turns, 0)
    assert chat.parse_window(text) == turns and all(chat.unescape(chat.escape(t)) == t for t in TRICKY)


def test_chat_windows(spark):
    r = np.random.default_rng(6)
    rows = []
    for c in range(12):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * 15
        rows += [(c, k, role, None if r.random() < 0.05 else " ".join(r.choice(TRICKY, size=int(r.integers(0, 60))))) for k, role in enumerate(roles)]
    rows += [(50, 0, "assistant", "w " * 900), (51, 0, None, None), (51, 0, None, None)]
    d = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, window int")
    made = chat.format_conversations(d, budget=200, history=2).cache()
    got = chat.read_back(made).toPandas().set_index("conv_id")
    for c in {x[0] for x in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        said = "".join(t for role, t in turns if role == "assistant")
        assert got["n_turns"][c] == len(turns) and got["loss_chars"][c] == len(said)
        assert got["turns_sha256"][c] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got["loss_sha256"][c] == hashlib.sha256(said.encode()).hexdigest()
    w = made.toPandas()
    over = w[w["n_tokens"] > 200]
    assert (over["formatted"].str.count("</s>") == 1).all()
    assert w[(w["conv_id"] == 0) & (w["window"] > 0)]["formatted"].str.startswith("<s>[system]").all()
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0


def brute_windows(sizes, system, budget, history):
    """(first turn, last turn + 1, tokens) of each span, and its lead, chosen by trying every end."""
    out, i = [], 0
    while i < len(sizes):
        lead = [0] if system and i and sizes[0] + sizes[i] <= budget else []
        k, past = len(lead), []
        for p in range(i - 1, (0 if system else -1), -1):
            if len(past) == history or sum(sizes[x] for x in lead + past) + sizes[i] + sizes[p] > budget:
                break
            past.insert(0, p)
        lead = lead[:k] + past
        room = budget - sum(sizes[x] for x in lead)
        ends = [j for j in range(i + 1, len(sizes) + 1) if sum(sizes[i:j]) <= room]
        j = max(ends, default=i + 1)
        out.append((lead, list(range(i, j)), sum(sizes[x] for x in lead) + sum(sizes[i:j])))
        i = j
    return out


def test_windows_keep_the_budget():
    r = np.random.default_rng(12)
    for _ in range(300):
        sizes = [int(x) for x in r.integers(1, 40, size=int(r.integers(1, 25)))]
        system, budget, history = bool(r.random() < 0.5), int(r.integers(20, 80)), int(r.integers(0, 4))
        turns = [("system" if system and k == 0 else "user", f"{k} " * n) for k, n in enumerate(sizes)]
        got = [([int(t.split()[0]) for _, t in part], n, used) for part, n, used in chat.windows(iter(turns), budget, history, lambda t: len(t.split()))]
        assert got == [(lead + span, len(lead), used) for lead, span, used in brute_windows(sizes, system, budget, history)]
        assert all(used <= budget or len(part) == 1 for part, _, used in got)
    said = [("system", "s " * 150), ("user", "u " * 100), ("assistant", "a " * 90)]
    assert [(len(p), n, used) for p, n, used in chat.windows(iter(said), 200, 2)] == [(1, 0, 152), (2, 0, 194)]


def test_conversations_with_large_or_missing_ids_stay_apart(spark):
    ids = [None, 2**53, 2**53 + 1, 2**53 + 2]
    d = spark.createDataFrame([(c, k, "user", f"{c} {k}") for c in ids for k in range(3)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.read_back(chat.format_conversations(d, budget=6)).collect()}
    assert got == {c: (3, hashlib.sha256("".join(f"user\n{c} {k}\n" for k in range(3)).encode()).hexdigest()) for c in ids}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(7)
    parts = ["a@b.c", "@", "@b.c@d.e", "x.y+z@q-r.com.", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "12", " ", "é", "a@b", "..", "+1 2 3 4 5 6 7 8 9)", "_", "9" * 30]
    for _ in range(3000):
        text = "".join(r.choice(parts, size=int(r.integers(1, 9))))
        assert pii_disclosure.base_spans(text) == brute_spans(text), text


def test_disclosure(spark, empty):
    told = [(i, f"some words here codename{'Falcon'} belongs to bob@mail.example.com as agreed {i}", None, None) for i in range(6)]
    clean = [(100 + i, "some words here belongs to nobody as agreed", None, None) for i in range(30)]
    odd = [(200, None, None, None), (201, "", None, None), told[0]]
    d = table(spark, told + clean + odd)
    got = pii_disclosure.all_spans(d).toPandas()
    assert len(got) == 39
    for r in got.itertuples():
        text = dict((i, t) for i, t, _, _ in told + clean + odd)[r.doc_id] or ""
        base = [(s["start"], s["kind"], s["end"]) for s in r.spans if s["kind"] < 4]
        assert base == brute_spans(text)
        terms = {text[s["start"] : s["end"]] for s in r.spans if s["kind"] == 4}
        assert terms == ({"codenameFalcon"} if r.doc_id < 100 else set())
    safe = {r.doc_id: r.text for r in pii_disclosure.sanitise(d).collect()}
    assert "bob@" not in safe[0] and "Falcon" not in safe[0] and "<EMAIL>" in safe[0] and safe[100] == clean[0][1] and safe[200] is None
    assert pii_disclosure.all_spans(empty).count() == 0


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    """Six times beside the address, four times without it: p is 0.6 and all ten are spans, in rows without a doc_id too."""
    beside = [(None, f"é codename{'Falcon'} belongs to x@y.com as agreed", None, None)] * 6
    alone = [(i, t, None, None) for i, t in ((None, "ünder codenamefalcon we met"), (None, "codenameFalcon"), (7, "again\nCODENAMEFALCON é codenameFalcon"))]
    d = table(spark, beside + alone + [(8, "é belongs to as agreed", None, None)] * 9)
    got = pii_disclosure.all_spans(d).toPandas()
    terms = [(s["start"], s["end"], round(s["p"], 3)) for r in got.itertuples() for s in r.spans if s["kind"] == 4]
    assert sorted(terms) == [(0, 14, 0.6)] + [(2, 16, 0.6)] * 6 + [(6, 20, 0.6)] * 2 + [(23, 37, 0.6)]
    safe = sorted(r.text for r in pii_disclosure.sanitise(d).collect())
    assert len(safe) == 18 and not any("falcon" in t.lower() or "x@y" in t for t in safe)
    assert safe.count("é <WORD> belongs to <EMAIL> as agreed") == 6 and "again\n<NAME> é <WORD>" in safe


def brute_terms(texts, window=10, support=3, disclose=0.5):
    """{word: p} recomputed from the definition, words by words."""
    near, total, low = defaultdict(set), defaultdict(int), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, text in enumerate(texts):
        found = [(m.start(), m.end(), m[0].translate(low)) for m in WORD.finditer(text)]
        base = brute_spans(text)
        for _, _, w in found:
            total[w] += 1
        for a, k, e in base:
            before, after = [i for i, (_, y, _) in enumerate(found) if y <= a], [i for i, (x, _, _) in enumerate(found) if x >= e]
            for i in before[max(0, len(before) - window) :] + after[:window]:
                if all(found[i][1] <= x or found[i][0] >= y for x, _, y in base):
                    near[found[i][2], (k, text[a:e].lower())].add((d, i))
    best = defaultdict(float)
    for (w, _), places in near.items():
        if len(places) >= support and len(places) / total[w] >= disclose:
            best[w] = max(best[w], len(places) / total[w])
    return dict(best)


def test_disclosure_equals_brute_force(spark):
    r = np.random.default_rng(13)
    people = [(f"p{k}@mail.org", [f"nick{k}", f"Town{k}", f"b{k}-7"]) for k in range(6)]
    vocab = [f"w{k}" for k in range(30)]
    texts = []
    for _ in range(150):
        w = list(r.choice(vocab, size=int(r.integers(0, 40))))
        for _ in range(int(r.integers(0, 3))):
            mail, facts = people[int(r.integers(0, 6))]
            said = [str(r.choice(facts)), mail] if r.random() < 0.7 else [str(r.choice(facts))]
            at = int(r.integers(0, len(w) + 1))
            w[at:at] = said
        texts.append(" ".join(w))
    texts += ["", "x" * 30_000 + " nick0 " + "y " * 20_000]
    got = pii_disclosure.all_spans(table(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    want, seen = brute_terms(texts), {}
    assert len(want) > 5
    for row in got:
        text = texts[row.doc_id]
        base = brute_spans(text)
        terms = [(m.start(), m.end()) for m in WORD.finditer(text) if m[0].lower() in want and all(m.end() <= a or m.start() >= e for a, _, e in base)]
        assert sorted((s["start"], s["end"]) for s in row.spans if s["kind"] == 4) == terms
        seen |= {text[s["start"] : s["end"]].lower(): s["p"] for s in row.spans if s["kind"] == 4}
    assert all(np.isclose(seen[w], want[w]) for w in seen) and len(seen) > 5


def test_overlapping_spans_leave_nothing_in_clear():
    spans = [{"start": 2, "kind": 2, "end": 10, "p": 1.0}, {"start": 6, "kind": 3, "end": 14, "p": 1.0}, {"start": 15, "kind": 4, "end": 17, "p": 0.95}, {"start": 18, "kind": 4, "end": 20, "p": 0.6}]
    assert pii_disclosure.rewrite("a 12345678901234-5678 x", spans, 0.9) == "a <CARD>35<NUMBER>8 x"


def test_decontamination(spark, empty):
    r = np.random.default_rng(8)
    vocab = ["".join(r.choice(list("abcdefghijk"), size=int(r.integers(2, 8)))) for _ in range(4000)]
    say = lambda n: list(r.choice(vocab, size=n))
    items = [(k, " ".join(say(int(n)))) for k, n in enumerate(r.integers(15, 60, size=30))]
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    rows, want = [], set()
    for i in range(200):
        w = say(int(r.integers(1, 400)))
        if i % 10 == 0:
            k = i // 10
            leak = items[k][1].split()
            if i % 20 == 0:
                leak[len(leak) // 2] = "swapped"
            at = int(r.integers(0, len(w) + 1))
            w = w[:at] + [x.upper() for x in leak] + w[at:]
            want.add((i, k))
        rows.append((i, "\n".join(w), None, None))
    rows += [(900, None, None, None), (901, "", None, None)]
    got = latent_decontamination.leaks(table(spark, rows), bench).toPandas()
    assert set(zip(got["doc_id"], got["item_id"], strict=True)) == want
    assert latent_decontamination.leaks(empty, bench).count() == 0
    assert latent_decontamination.leaks(table(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_finds_all_that_brute_force_finds(spark):
    """Recall 1 against the longest common subsequence of each item and every run of as many words, short items and reworded copies included."""
    r = np.random.default_rng(11)
    vocab = ["".join(r.choice(list("abcdefghijk"), size=int(r.integers(3, 8)))) for _ in range(2000)]
    say = lambda n: list(r.choice(vocab, size=n))
    items = [(k, say(n)) for k, n in enumerate([1, 1, 2, 2, 3, 4, 6, 9, 15, 22, 31, 40])]
    rows = []
    for i in range(120):
        k = i % len(items)
        leak = np.array(items[k][1], dtype=object)
        body = len(leak) - 5
        if i >= 48 and body > 2:
            leak[r.permutation(body)[: (3 * len(leak)) // 10]] = "other"
        w = say(int(r.integers(20, 60)))
        at = int(r.integers(0, len(w) + 1))
        rows.append((i, w[:at] + list(leak) + w[at:]))
    code = {x: n for n, x in enumerate({x for _, w in rows + items for x in w})}
    want = set()
    for i, w in rows:
        d = np.array([code[x] for x in w], dtype=np.uint64)
        for k, x in items:
            c = np.array([code[y] for y in x], dtype=np.uint64)
            for at in range(max(1, len(d) - len(c) + 1)):
                run = d[at : at + len(c)]
                part = latent_decontamination.longest_common(c, run) / len(c)
                if part >= 0.8 or part >= 0.7 and latent_decontamination.longest_common(c[-5:], run) == len(c[-5:]):
                    want.add((i, k))
                    break
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = latent_decontamination.leaks(table(spark, [(i, " ".join(w), None, None) for i, w in rows]), bench).toPandas()
    assert len(want) >= 120 and want <= set(zip(got["doc_id"], got["item_id"], strict=True))


def test_longest_common_subsequence():
    r = np.random.default_rng(9)
    for _ in range(50):
        a, b = r.integers(0, 6, size=int(r.integers(1, 30))).astype(np.uint64), r.integers(0, 6, size=int(r.integers(1, 40))).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert latent_decontamination.longest_common(a, b) == t[-1, -1]


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(corpus[125][1].split()[85:115])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen.append([r.doc_id for r in d.select("doc_id").collect()])
    letters = {i for i, t, _, _ in corpus if any(c.isalpha() for c in t or "")}
    assert set(seen[0]) <= letters and len(letters - set(seen[0])) <= 3
    want = brute_components([r for r in corpus if r[0] in set(seen[0])])
    assert sorted(seen[1]) == sorted(i for i, (_, c) in want.items() if i == c)
    assert set(seen[1]) - set(seen[2]) == {i for i, t, _, _ in corpus if i in set(seen[1]) and item in " ".join((t or "").split())}
    assert set(seen[3]) <= set(seen[2]) and sorted(seen[4]) == sorted(seen[3]) and "shard" in d.columns


def test_pipeline_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, "some item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"{a} {b} lives in the {a} house by the {b} and says {i}", "en", "s") for i, (a, b) in enumerate(zip("abcdefgh", "hgfedcba", strict=True))]
    for name, d in (("none", table(spark, [])), ("some", table(spark, rows))):
        for c in ("score", "lang_pred", "copies", "shard", "size", "row_", "component_id"):
            d = d.withColumn(c, F.lit("own"))
        d.write.parquet(str(tmp_path / f"{name}.parquet"))
        d = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        columns = d.columns
        for stage, f in corpus_pipeline.STAGES:
            f(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{stage}"))
            d = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            assert d.columns == columns or stage == "sharding"
        assert (d.count() == 0) == (name == "none") and (name == "none" or d.select("score").first()[0] == "own")


def test_extra_columns_with_clashing_names_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "z"), (2, None, None)], "doc_id long, text string, row string")
    for c in ("part", "kind", "data", "digest", "size", "shard", "slot", "node", "n"):
        d = d.withColumn(c, F.lit("clash"))
    assert exact_dedup.dedup(d).count() == 4 and sharding.shard_documents(d, 2).count() == 4
    assert substring_dedup.remove_repeats(d).count() == 4 and pii_disclosure.all_spans(d).count() == 4
    got = jaccard_join.similar_documents(d).toPandas()
    assert len(got) == 4 and set(got["component_id"].dropna()) == {1, 2}
    with_source = d.withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(with_source).count() == 4 and isinstance(got, pd.DataFrame)


def test_rows_without_an_id_or_with_a_shared_one_are_judged_alone(spark, tmp_path):
    import corpus_pipeline

    say = lambda x, n=40: " ".join(f"{x}{k}" for k in range(n))
    rows = [(5, say("a")), (9, say("b")), (None, say("a")), (None, say("b")), (7, say("c")), (7, say("d")), (None, say("e") + " " + say("q", 20)), (None, say("f"))]
    d = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = jaccard_join.similar_documents(d).toPandas()
    named = sorted((r.doc_id, r.component_id) for r in got.dropna().itertuples())
    assert named == [(5, 5), (7, 7), (7, 7), (9, 9)]
    assert sorted(got[got["doc_id"].isna()]["component_id"].dropna()) == [5, 9] and len(got) == 8
    spark.createDataFrame([(0, say("q", 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    for docs in (spark.read.parquet(str(tmp_path / "documents.parquet")), d):
        kept = lambda name: sorted(r.text for r in stage[name](spark, docs, str(tmp_path)).select("text").collect())  # noqa: B023, E731
        assert kept("near_duplicates") == sorted(t for _, t in rows)
        assert kept("decontamination") == sorted(t for _, t in rows if "q0" not in t)
        plan = mixing.mix(docs.withColumn("t", F.col("text")), carry=("t",)).where("copies > 0").select("t", "copies").collect()
        assert len(kept("mixing")) == sum(r.copies for r in plan) and set(kept("mixing")) == {r.t for r in plan}
