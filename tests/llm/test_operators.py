"""Each query over its whole table against a plain version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import os
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from plain import Groups, chunk_ends, contains_words, crc32c, first_fit_decreasing, near_groups, repeated_words, word_spans, words
from pyspark.sql import functions as F

from pressmill.llm import bpe, decontaminate, fingerprints, graph, langid, licenses, packing, quality, queries, records, simhash, substrings, text, urlfilter


@pytest.fixture(scope="module")
def docs(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"], strict=True)))


def test_words_are_those_of_the_plain_version():
    texts = ["Ab cd-ef", "", "é́a 12x", "漢字 かな", " \n ", "x" * 300_000 + " y", "\U0001f600 z", "ẞ İ"]
    w = text.Words(texts)
    for i, t in enumerate(texts):
        lo, hi = w.bounds[i], w.bounds[i + 1]
        assert [(int(a - w.starts[i]), int(b - w.starts[i])) for a, b in zip(w.begin[lo:hi], w.end[lo:hi], strict=True)] == word_spans(t)
    assert text.word_hash("Straße") == text.word_hash("STRAßE") != text.word_hash("strase")


def test_graph_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(5, 5)] + [(1000 + i, 1001 + i) for i in range(40)]
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: g.find(x) for x in g.up if g.find(x) != x}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1


def test_chunks_are_those_of_the_plain_version(docs):
    for t in [*list(docs.values())[:25], "", "a", "é" * 3000, "ab " * 4000]:
        raw = t.encode()
        ends = chunk_ends(raw, fingerprints._GEAR, fingerprints.LEAST, fingerprints.NORMAL, fingerprints.MOST, fingerprints._HARD, fingerprints._EASY)
        assert "".join(fingerprints.chunk(t)) == t
        assert list(np.cumsum([len(c.encode()) for c in fingerprints.chunk(t)])) == ends


def test_op1_containment(spark, sf_dir, docs):
    sets = {i: {xxhash.xxh3_64_intdigest(c.encode()): len(c.encode()) for c in fingerprints.chunk(t)} for i, t in docs.items()}
    holders = Counter(d for s in sets.values() for d in s)
    rows = queries.op1_document_fingerprints(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == list(docs)
    for r in rows:
        s = sets[r.doc_id]
        assert {d & (1 << 64) - 1: n for d, n in zip(r.digests, r.lengths, strict=True)} == s
        assert r.shared_bytes == sum(n for d, n in s.items() if holders[d] > 1) and r.bytes == sum(s.values())
        assert r.containment == pytest.approx(r.shared_bytes / r.bytes if r.bytes else 0)


def test_op1_containers_against_all_pairs(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    sf_dir = big if os.path.isdir(big) else sf_dir
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    sets = {i: {c: len(c.encode()) for c in fingerprints.chunk(t)} for i, t in docs.items()}
    share = lambda a, b: sum(n for c, n in a.items() if c in b) / sum(a.values())
    rows = {r.doc_id: r for r in queries.op1_document_fingerprints(spark, sf_dir).collect()}
    same = defaultdict(list)
    for i, s in sets.items():
        same[frozenset(s)].append(i)
    for i, s in sets.items():
        r, others = rows[i], [j for k, own in same.items() if k and i not in own for j in own[:1]]
        if not s:
            assert (r.class_id, r.links, r.container_id, r.contained) == (None, 0, None, None)
            continue
        assert (r.class_id, r.copies) == (min(same[frozenset(s)]), len(same[frozenset(s)]))
        best = max((share(s, sets[j]) for j in others), default=0)
        assert (r.contained or 0) == pytest.approx(share(s, sets[r.container_id]) if r.container_id is not None else 0)
        assert r.contained is None or r.contained <= best + 1e-9
        if best >= fingerprints.LINK:
            assert r.contained >= fingerprints.LINK and r.links >= 1
        assert r.links <= sum(share(s, sets[j]) >= fingerprints.LINK for j in others)


def test_a_document_within_another_names_it(spark):
    random.seed(6)
    t = lambda n: " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(n))
    footer, whole = t(300), t(6000)
    # Ten pages share a footer; one is within a larger one, and two are equal.
    rows = [(i, t(400) + " " + footer) for i in range(10)] + [(20, whole), (21, whole[3000:33000]), (22, whole[3000:33000])]
    found = {r.doc_id: r for r in fingerprints.corpus_containment(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[21].container_id == 20 and found[21].contained > 0.8 and found[21].links == 1 and found[22].class_id == 21 and found[22].copies == 2
    assert 0.6 < found[20].contained < 0.75 and all(0.2 < found[i].contained < 0.6 for i in range(10))


@pytest.mark.parametrize("hot", [5, 1000])
def test_every_holder_counts_however_many_share_a_chunk(spark, monkeypatch, hot):
    # Sets of a few chunks in many combinations; above HOT a chunk is treated by patterns.
    random.seed(9)
    sizes = {random.getrandbits(52) << 11 | random.randrange(64, 1025): 0 for _ in range(40)}
    chunks = list(sizes)
    sets = [random.sample(chunks[:6], random.randrange(1, 5)) if i % 3 == 0 else random.sample(chunks, random.randrange(1, 9)) + random.sample(chunks[:4], i % 2) for i in range(120)]
    sets = [{c: c & 2047 for c in s} for s in sets]
    rows = [(i, i, list(s), list(s.values())) for i, s in enumerate(sets)]
    prints = spark.createDataFrame(rows, "doc_id bigint, node bigint, digests array<bigint>, lengths array<int>")
    monkeypatch.setattr(fingerprints, "fingerprints", lambda docs: docs)
    monkeypatch.setattr(fingerprints, "HOT", hot)
    found = {r.doc_id: r for r in fingerprints.corpus_containment(prints).collect()}
    first = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    assert len(found) == len(sets)
    for i, s in enumerate(sets):
        shared = {j: sum(n for c, n in s.items() if c in o) for o, j in first.items() if o != s.keys()}
        most = max(shared.values())
        r = found[i]
        assert r.links == sum(n / sum(s.values()) >= fingerprints.LINK for n in shared.values())
        assert (r.container_id, r.contained) == (min(j for j, n in shared.items() if n == most), pytest.approx(most / sum(s.values())))
        assert r.class_id == first[frozenset(s)]


def test_chunks_resist_shifts():
    random.seed(1)
    t = " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(3000))
    a, b = set(fingerprints.chunk(t)), set(fingerprints.chunk("shifted " + t[:9000] + " some words put in " + t[9000:]))
    assert sum(map(len, a & b)) > 0.85 * len(t)


# 2


def test_op2_leaks(spark, sf_dir, docs):
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    want = {(i, b["item_id"]) for i, t in docs.items() for b in items if words(b["text"]) and contains_words(t, b["text"])}
    rows = queries.op2_decontamination(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    by_id = {b["item_id"]: b["text"] for b in items}
    for r in rows:
        assert words(docs[r.doc_id][r.begin : r.end]) == words(by_id[r.item_id]) and r.words == len(words(by_id[r.item_id]))


def test_leaks_are_found_across_case_and_punctuation(spark):
    b = spark.createDataFrame([(1, "What is the colour of the sky, on a clear day?"), (2, "too short a text"), (3, None), (4, "what is the COLOUR of the sky on a clear day")], "item_id int, text string")
    t = "¡Ay! What -- is the Colour\nof the sky on a CLEAR day"
    d = spark.createDataFrame([(9, t), (8, t + "s"), (7, None), (6, "")], "doc_id int, text string")
    rows = decontaminate.leaks(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(9, 1), (9, 4)]
    assert all(t[r.begin : r.end] == t[5:] for r in rows)


def test_short_answers_are_found_and_drop_nothing(spark):
    b = spark.createDataFrame([(1, "Which river runs through the old town, and where does it end?", "Seine"), (2, "?", "no")], "item_id int, question string, answer string")
    d = spark.createDataFrame([(1, "The SEINE, no less."), (2, "north"), (3, "Which river runs through the old town, and where does it end? Seine.")], "doc_id int, text string")
    both = ("question", "answer")
    assert sorted((r.doc_id, r.item_id, r.begin, r.end, r.words) for r in decontaminate.leaks(d, b, both).collect()) == [(1, 1, 4, 9, 1), (1, 2, 11, 13, 1), (3, 1, 0, 60, 12), (3, 1, 62, 67, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, b, both).collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, b, both, min_words=1).collect()) == [2]


def test_one_automaton_of_five_million_characters(spark):
    b = spark.range(60_000).selectExpr("id as item_id", "concat('question ', sha2(cast(id as string), 256), ' asks for ', id) as text").repartition(4)
    d = spark.range(0, 60_000, 500).selectExpr("id as doc_id", "concat('So: Question ', upper(sha2(cast(id as string), 256)), ', asks for ', id, '.') as text")
    assert b.selectExpr("sum(length(text))").first()[0] > 5_000_000
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()) == [(i, i) for i in range(0, 60_000, 500)]


# 3


def test_op3_repeats(spark, sf_dir, docs):
    rows = queries.op3_substring_dedup(spark, sf_dir).collect()
    want = dict(zip(docs, repeated_words(list(docs.values())), strict=True))
    covered = {i: [False] * len(w) for i, w in want.items()}
    for r in rows:
        assert r.kept_doc_id < r.doc_id and r.words >= substrings.MIN_WORDS and r.equal_words >= substrings.MIN_SHARE * r.words
        a, b = (words(docs[i]) for i in (r.doc_id, r.kept_doc_id))
        assert sum((Counter(a[r.first_word : r.first_word + r.words]) & Counter(b[r.kept_first_word : r.kept_first_word + r.kept_words])).values()) >= 0.8 * min(r.words, r.kept_words)
        covered[r.doc_id][r.first_word : r.first_word + r.words] = [True] * r.words
    total = sum(map(sum, want.values()))
    assert total > 1000
    assert sum(x and y for i in want for x, y in zip(want[i], covered[i], strict=True)) >= 0.9 * total


def test_compact_windows_are_those_of_the_plain_version():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    owner = np.repeat([0, 1], [200, 100])
    first, last = np.array([0, 200]), np.array([199, 299])
    got = {tuple(x) for x in np.stack(substrings.compact_windows(h, owner, first, last), 1).tolist()}
    want = set()
    for a, b in ((0, 200), (200, 300)):
        for c in range(a, b):
            lo, hi = c, c
            while lo > a and h[lo - 1] > h[c]:
                lo -= 1
            while hi < b - 1 and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= substrings._WIDTH:
                want.add((lo, c, hi))
    assert want <= got and all(h[c] == h[l : r + 1].min() for l, c, r in got)


def test_joint_keys_are_those_of_the_plain_version():
    rng = np.random.default_rng(4)
    # Two texts, one of which repeats itself, as windows() has them.
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 300)), " ".join(f"w{x}" for x in np.tile(rng.integers(0, 9, 7), 40))]
    w = substrings.Words(texts)
    sh, _ = substrings.shingles(w, substrings.SHINGLE)
    ks, ws, owners, want = [], [], [], set()
    for t in range(2):
        lo, hi = int(w.bounds[t]), int(w.bounds[t + 1]) - substrings.SHINGLE + 1
        own, n = sh[lo:hi], hi - lo
        hashes = [substrings.mix(own + np.uint64(0x51ED270B * (f + 1))) for f in range(substrings.FUNCTIONS)]
        for f, key in enumerate(hashes):
            l, c, r = substrings.compact_windows((key >> np.uint64(32)).astype(np.uint32), np.zeros(n, int), np.array([0]), np.array([n - 1]))  # noqa: E741
            stay, early = substrings._thinned(key[c] >> np.uint64(32), np.zeros(len(c), int), c, np.minimum(c - l, substrings._WIDTH - 1))
            late = np.maximum(0, substrings._WIDTH - 1 - (r - c))
            c, early, late = c[stay], early[stay], late[stay]
            ks.append(key[c].view(np.int64))
            ws.append((np.uint64(f) << np.uint64(62) | c.astype(np.uint64) << np.uint64(12) | early.astype(np.uint64) << np.uint64(6) | late.astype(np.uint64)).view(np.int64))
            owners.append(np.full(len(c), t))
        for s in range(n - substrings._WIDTH + 1):
            least = [min(h[s : s + substrings._WIDTH].tolist(), key=lambda x: x >> 32) for h in hashes]
            for i, functions in enumerate(substrings.SETS):
                key = np.array([i + 1], np.uint64)
                for f in functions:
                    key = substrings.mix(key + np.uint64(least[f]))
                want.add((t, int(key.view(np.int64)[0])))
    kk, owner, p = substrings.joined(np.concatenate(ks), np.concatenate(ws), np.concatenate(owners))
    assert set(zip(owner.tolist(), kk.tolist(), strict=True)) == want
    assert len(ks[0]) + len(ks[4]) < 100  # also in the text that repeats itself


def test_edited_passages_are_found_and_cut(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    passage = [word() for _ in range(80)]
    edited = [word() if i in (30, 55) else w for i, w in enumerate(passage)]
    own = {i: [word() for _ in range(60)] for i in range(4)}
    rows = [(0, " ".join(own[0] + passage)), (1, " ".join(own[1][:30] + edited + own[1][30:])), (2, " ".join(own[2])), (3, " ".join(passage))]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, w string")
    out = {r.doc_id: r.text for r in substrings.drop_repeats(d).collect()}
    assert out[0] == rows[0][1] and out[2] == rows[2][1] and 3 not in out
    assert set(own[1]) <= set(words(out[1])) and len(set(words(out[1])) & set(edited)) <= 4


def test_edited_copies_of_a_hot_passage_are_found(spark):
    # Copies differ from each other, so that their min-hashes occur first in different documents.
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    passage = [word() for _ in range(60)]
    copies = []
    for _ in range(150):
        c = list(passage)
        for at in random.sample(range(60), 5):
            c[at] = word()
        copies.append(c)
    rows = [(i, " ".join([word() for _ in range(40)] + c + [word() for _ in range(40)])) for i, c in enumerate(copies)]
    want = {i for i, c in enumerate(copies) if any(sum(x == y for x, y in zip(c, d, strict=True)) >= 0.85 * 60 for d in copies[:i])}
    found = {r.doc_id for r in substrings.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(want) > 100 and len(want & found) >= 0.95 * len(want)


def test_every_earlier_text_with_a_key_is_met(spark):
    # Documents with the same windows.
    k, w = np.arange(4), np.arange(4, dtype=np.uint64) << np.uint64(62) | np.uint64(60) << np.uint64(12) | np.uint64(46) << np.uint64(6)
    kw = list(zip(k.tolist(), w.view(np.int64).tolist(), strict=True))
    own = spark.createDataFrame([(i, 2 * (i if i < 5 else 3), kw) for i in range(6)], "id bigint, th bigint, kw array<struct<k: bigint, w: bigint>>")
    met = {(r.id, r.kept_id) for r in substrings.hits(own).collect()}
    # The last one's text is that of 3.
    assert met == {(i, j) for i in range(5) for j in range(i)} | {(5, 3)}
    # The first holders alone; and part by part, all pairs of those that aren't done.
    pairs = lambda rows: {(r.id, r.kept_id) for r in rows.collect()}
    assert pairs(substrings._met(substrings._found(own), True)) == {(i, 0) for i in range(1, 5)}
    done = own.where("id in (1, 4)").select("id", "th")
    parts = [pairs(substrings._met(substrings._found(own, done, one))) for one in range(substrings._PARTS)]
    assert sum(map(len, parts)) == 5 and set().union(*parts) == {(i, j) for i in (2, 3) for j in range(i)}


def test_versions_of_a_whole_text_meet_its_first_holders_alone(spark, monkeypatch):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghij", k=7))
    text = [word() for _ in range(120)]
    rows = [(0, " ".join(text))] + [(i, " ".join(word() if k in (3 * i % 100 + 5, 7 * i % 100 + 9) else w for k, w in enumerate(text))) for i in range(1, 31)]
    # Beside them one that has an end of its own: it meets every version.
    rows.append((31, " ".join(text[:100] + [word() for _ in range(60)])))
    met, aligned = [], substrings._aligned
    monkeypatch.setattr(substrings, "_aligned", lambda pairs, own: met.extend((r.id, r.kept_id) for r in pairs.collect()) or aligned(pairs, own))
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.first_word, r.words) for r in found if r.doc_id < 31} == {(i, 0, 120) for i in range(1, 31)}
    assert max(r.first_word + r.words for r in found if r.doc_id == 31) == 100
    assert {j for i, j in met if i == 31} == set(range(31)) and len([i for i, _ in met if i < 31]) < 30 * 31 / 2 / 3


# 4


def test_op4_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    pages = spark.read.parquet(f"{big if os.path.isdir(big) else sf_dir}/pages.parquet")
    model = urlfilter.train(pages.where("page_id % 2 = 0"))
    rows = urlfilter.score(pages.where("page_id % 2 = 1"), model).withColumn("y", urlfilter.seed_label(F.col("url"))).collect()
    bad = [r for r in rows if r.y == 1]
    assert bad and sum(r.accepted == (r.y == 0) for r in rows) >= 0.9 * len(rows)
    order = sorted(rows, key=lambda r: r.bad)
    ranks = {id(r): k for k, r in enumerate(order)}
    auc = (sum(ranks[id(r)] for r in bad) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * (len(rows) - len(bad)))
    assert auc >= 0.8
    assert queries.op4_url_filter(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_url_statistics_are_those_of_all_labelled_urls(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.x.t{i % 40}/{i}") for i in range(400)]
    d = spark.createDataFrame(rows, "page_id bigint, url string")
    model = urlfilter.train(d, sample=20)
    y = [int(i % 3 == 0) for i in range(400)]
    prior = sum(y) / 400
    found = {r.suffix: r.suffix_rate for r in model.rated(urlfilter._with_suffix(d)).collect()}
    assert found == {f"t{k}": pytest.approx((sum(y[k::40]) + urlfilter.SMOOTHING * prior) / (10 + urlfilter.SMOOTHING)) for k in range(40)}


def test_labels_may_be_given_and_a_part_of_a_host_is_no_feature(spark):
    # Labels that no word of the URL tells, but its shape does; hosts are renamed after training.
    rows = [(i, f"http://{'ab' if i % 2 else 'cd'}.example.com/{'x/' * (5 if i % 3 == 0 else 1)}{i}", int(i % 3 == 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, y int")
    model = urlfilter.train(d, F.col("y"))
    renamed = d.withColumn("url", F.regexp_replace("url", "://(ab|cd)", "://ad"))
    assert {(r.page_id, not r.accepted) for r in urlfilter.score(renamed, model).collect()} == {(i, y == 1) for i, _, y in rows}


def test_a_url_s_own_label_isnt_in_its_rate(spark):
    # Every suffix occurs once, so that with its own label in the rate a URL would give its label away.
    rows = [(f"http://host.s{i}/{i % 7}", i % 2) for i in range(300)]
    model = urlfilter.train(spark.createDataFrame(rows, "url string, y int"), F.col("y"))
    scored = urlfilter.score(spark.createDataFrame([(i, f"http://host.new{i}/{i % 7}") for i in range(50)], "page_id bigint, url string"), model).collect()
    assert all(0.2 < r.bad < 0.8 for r in scored)


def test_url_features():
    f = dict(zip(urlfilter.FEATURES, urlfilter.features(["https://a-b.example.com/x1/y?k=v&l=%20", ""], [0.25, 0.5])[0], strict=True))
    assert (f["length"], f["host_length"], f["depth"], f["parameters"], f["escapes"], f["secure"], f["host_hyphens"], f["dots"], f["labels"]) == (38, 15, 2, 2, 1, 1, 1, 2, 4)
    assert f["suffix_rate"] == 0.25 and f["digits"] == pytest.approx(3 / 38) and f["vowels"] == pytest.approx(5 / 15)


# 5


def test_checksums_are_those_of_the_plain_version():
    data = [b"", b"123456789", b"x" * 255, b"y" * 256, b"z" * 257, os.urandom(1000)]
    for d, c in zip(data, records.masked_crcs(np.frombuffer(b"".join(data), np.uint8), np.array(list(map(len, data)))).tolist(), strict=True):
        crc = crc32c(d)
        assert c == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert crc32c(b"123456789") == 0xE3069283


def test_op5_round_trip(spark, tmp_path, docs, sf_dir):
    index = records.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path)).cache()
    rows = index.collect()
    plain = bpe.encoder().tokenizer
    for seed in (None, 4):
        found = {r.doc_id: list(r.ids) for r in records.read(index, str(tmp_path), seed).collect()}
        assert found == {i: plain.encode_ordinary(t) for i, t in docs.items()}
    for name in {r.file for r in rows}:
        offsets = np.frombuffer((tmp_path / name.replace(".rec", ".idx")).read_bytes(), "<u8").tolist()
        own = sorted((r for r in rows if r.file == name), key=lambda r: r.record)
        assert offsets == [r.record_offset for r in own]
        raw = (tmp_path / name).read_bytes()
        assert all(struct.unpack_from("<Q", raw, r.record_offset)[0] == r.length for r in own)
    assert queries.op5_token_records(spark, sf_dir).count() == len(docs)


def test_damaged_records_raise(spark, tmp_path):
    index = records.write(spark.createDataFrame([(1, "some text to be written")], "doc_id int, text string"), str(tmp_path)).cache()
    name = index.first().file
    raw = bytearray((tmp_path / name).read_bytes())
    raw[22] ^= 1
    (tmp_path / name).write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        records.read(index, str(tmp_path)).collect()


def test_tokens_are_the_tokenizers_own():
    texts = ["", " ", "don't  stop\n\n now", "x'll y've 's'", "漢字 123abc", "͸ odd", "a" * 5000, "tab\t\tend ", "é́ \U0001f600!?"]
    e = bpe.encoder()
    ids, counts = e.encode(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [e.tokenizer.encode_ordinary(t) for t in texts]


# 6


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.8])
    v = np.where(rng.random((len(y), 7)) < right, y[:, None], ~y[:, None]).astype(int)
    v[rng.random(v.shape) < 0.3] = 2
    p, c = np.unique(v, axis=0, return_counts=True)
    m = quality.LabelModel(p, c)
    share = m.chance[1, :, 1] / (m.chance[1, :, 0] + m.chance[1, :, 1])
    assert np.abs(share - right).max() < 0.05 and abs(m.prior - 0.7) < 0.05


def test_op6_against_labels(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in queries.op6_quality(spark, sf_dir).collect()}
    assert sorted(rows) == list(docs)
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()
    known = [(rows[x["doc_id"]].accepted, x["quality"]) for x in labels if x["doc_id"] in rows and x["quality"] is not None]
    assert sum(a == bool(q) for a, q in known) >= 0.75 * len(known)
    good = [a for a, q in known if q == 1]
    assert sum(good) >= 0.9 * len(good)


def test_op6_tells_labelled_documents_apart(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    where = big if os.path.isdir(big) else sf_dir
    rows = queries.op6_quality(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.accepted for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.15 * len(bad) and bad


# 7


def _numbers(f):
    return [sum(int(x) << 64 * k for k, x in enumerate(row)) for row in f]


def test_op7_against_all_pairs(spark, sf_dir, docs):
    ids = list(docs)
    f, some = simhash.simhash(list(docs.values()))
    ids_ = [i for i, s in zip(ids, some, strict=True) if s]
    numbers = [n for n, s in zip(_numbers(f), some, strict=True) if s]
    want = near_groups(ids_, numbers, simhash.RADIUS)
    rows = {r.doc_id: r.kept_doc_id for r in queries.op7_simhash_near_dedup(spark, sf_dir).collect()}
    gone = {i for i, r in want.items() if i != r}
    assert gone and len(gone & rows.keys()) >= 0.95 * len(gone)
    assert all(want[i] == want[k] for i, k in rows.items())
    # Up to twice as many bits as segments, less one, no pair is missed.
    sure = near_groups(ids_, numbers, 2 * simhash.SEGMENTS - 1)
    assert all(rows.get(i, i) == rows.get(r, r) for i, r in sure.items())


def test_simhash_bits_are_majorities():
    t = "one two two three"
    f = simhash.simhash([t])[0][0]
    h = [int(x) >> 16 for x in {int(x) for x in text.Words([t]).hash}]
    for k in range(simhash.BITS // 64):
        hashes = [int(text.mix(np.array([x + 0xA5A5A5A5 * (k + 1)], np.uint64))[0]).to_bytes(8, "little") for x in h]
        want = [sum(x[b // 8] >> (7 - b % 8) & 1 for x in hashes) * 2 > len(hashes) for b in range(64)]
        assert np.unpackbits(np.array([f[k]]).view(np.uint8)).astype(bool).tolist() == want


def _flipped(rng, row, bits):
    out = row.copy()
    for b in rng.choice(simhash.BITS, bits, replace=False).tolist():
        out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def _segments(n):
    return [n >> 20 * s & 0xFFFFF for s in range(simhash.SEGMENTS)]


def _bucketed(f):
    h = simhash.halves(f)
    rows = sorted((int(b), int(i)) for i, row in enumerate(h) for b in row)
    i, j = simhash.matches(np.array([b for b, _ in rows], np.int32), f[[i for _, i in rows]])
    return {frozenset((rows[a][1], rows[b][1])) for a, b in zip(i.tolist(), j.tolist(), strict=True)}


def test_segments_that_differ_by_one_bit_always_meet():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (60, simhash.BITS // 64)).astype(np.uint64)
    flip = np.array([_flipped(rng, row, 2 * simhash.SEGMENTS - 1) for row in base])
    assert [simhash.segment(base, np.full(60, s)).tolist() for s in range(simhash.SEGMENTS)] == list(map(list, zip(*map(_segments, _numbers(base)), strict=True)))
    pairs = _bucketed(np.concatenate([base, flip]))
    assert pairs == {frozenset((i, i + 60)) for i in range(60)}


def test_matches_connect_what_all_pairs_of_the_plain_index_connect():
    # Families around a template, of which many share buckets, beside rows that share some by chance.
    rng = np.random.default_rng(3)
    rows = list(rng.integers(0, 1 << 63, (40, simhash.BITS // 64)).astype(np.uint64))
    for spread in (8, 24, 40, 60):
        template = rng.integers(0, 1 << 63, simhash.BITS // 64).astype(np.uint64)
        rows += [_flipped(rng, template, spread) for _ in range(150)]
    f = np.array(rows)
    numbers = _numbers(f)
    cut = list(map(_segments, numbers))
    plain, found = Groups(), Groups()
    for i in range(len(f)):
        for j in range(i):
            if (numbers[i] ^ numbers[j]).bit_count() <= simhash.RADIUS and any((a ^ b).bit_count() <= 1 for a, b in zip(cut[i], cut[j], strict=True)):
                plain.join(i, j)
    for pair in _bucketed(f):
        i, j = pair
        assert (numbers[i] ^ numbers[j]).bit_count() <= simhash.RADIUS
        found.join(i, j)
    assert [plain.find(i) for i in range(len(f))] == [found.find(i) for i in range(len(f))]
    assert len({plain.find(i) for i in range(len(f))}) < len(f) - 200


def test_wide_buckets_are_compared_like_narrow_ones(monkeypatch):
    rng = np.random.default_rng(5)
    template = rng.integers(0, 1 << 63, simhash.BITS // 64).astype(np.uint64)
    f = np.array([_flipped(rng, template, int(n)) for n in rng.integers(10, 40, 300)])

    def groups():
        g = Groups()
        for i, j in map(tuple, _bucketed(f)):
            g.join(i, j)
        return [g.find(i) for i in range(len(f))]

    wide = groups()
    monkeypatch.setattr(simhash, "_WIDE", 1 << 30)
    assert groups() == wide


@pytest.mark.parametrize(("alone", "blocks"), [(1 << 13, 8), (10, 3), (10, 40)])
def test_no_pair_within_the_radius_is_left_out(spark, monkeypatch, alone, blocks):
    # Every segment differs by two bits at least, so that the index has none of these pairs; one bit more than RADIUS is no pair.
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, (30, simhash.BITS // 64)).astype(np.uint64)
    flip = base.copy()
    for i in range(30):
        for s, n in enumerate(rng.permutation([4, 4] + [3] * 14 if i % 2 else [5, 5, 4] + [3] * 11 + [2, 2] if i == 0 else [5, 5] + [3] * 12 + [2, 2])):
            for b in rng.choice(20, n, replace=False):
                flip[i, (20 * s + b) // 64] ^= np.uint64(1) << np.uint64((20 * s + b) % 64)
    f = np.concatenate([base, flip])
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if int(simhash.distance(f[i], f[j])) <= simhash.RADIUS}
    assert len(want) >= 25 and not {tuple(sorted(p)) for p in want} & {tuple(sorted(p)) for p in _bucketed(f)}
    monkeypatch.setattr(simhash, "_ALONE", alone)
    monkeypatch.setattr(simhash, "_BLOCKS", blocks)
    node = {int(n): i for i, n in enumerate(simhash.nodes_of(f))}
    nodes = spark.createDataFrame([(n, f[i].tobytes()) for n, i in node.items()], "node bigint, f binary")
    assert {frozenset((node[r.a], node[r.b])) for r in simhash.links(nodes).collect()} == want


def test_links_are_verified_on_all_bits(spark):
    # All rows share segments; only rows 3 and 9 are near on all bits.
    rng = np.random.default_rng(4)
    f = rng.integers(0, 1 << 62, (12, simhash.BITS // 64)).astype(np.uint64)
    f[:, 0] = 1 << np.arange(12).astype(np.uint64)
    f[9] = _flipped(rng, f[3], 31)
    node = simhash.nodes_of(f)
    nodes = spark.createDataFrame([(int(n), x.tobytes()) for n, x in zip(node, f, strict=True)], "node bigint, f binary")
    assert [{r.a, r.b} for r in simhash.links(nodes).collect()] == [{int(node[3]), int(node[9])}]


# 8


def test_op8_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.identify(d.where("doc_id % 2 = 1"), langid.train(d.where("doc_id % 2 = 0"))).where("lang is not null and length(text) > 200").collect()
    assert len(rows) > 30 and sum(r.lang == r["__pm_language"] for r in rows) >= 0.9 * len(rows)
    found = {r.doc_id: r.accepted for r in queries.op8_language_id(spark, sf_dir).collect()}
    assert sum(found.values()) >= 0.9 * len(found)


def _plain_profile(t):
    symbol, v = langid._letters()
    seq, blank = [], True
    for c in t + " ":
        x = int(symbol[ord(c)])
        if x or not blank:
            seq.append(x)
        blank = not x
    out = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        out += np.roll(v[a].astype(float), 2) * np.roll(v[b].astype(float), 1) * v[c]
    return out, max(0, len(seq) - 2)


def test_profiles_are_those_of_the_plain_version():
    texts = ["x", "Ab, c1d — ab", " , été  où\n", "", "漢字かな交じり文", "приве́т мир", "a" * 400]
    p, n = langid.profiles(texts)
    for i, t in enumerate(texts):
        want, count = _plain_profile(t)
        assert np.array_equal(p[i], want) and n[i] == count


def test_op8_against_the_plain_version(spark, sf_dir, docs):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    prototypes = {}
    for r in table:  # all labelled documents: there are fewer than the bound
        p, _ = _plain_profile(r["text"])
        prototypes.setdefault(r["lang"], np.zeros(langid.DIMENSIONS))
        prototypes[r["lang"]] += p / max(np.linalg.norm(p), 1e-9)
    assert max(Counter(r["lang"] for r in table).values()) <= langid.SAMPLE_PER_LANGUAGE
    rows = {r.doc_id: r for r in queries.op8_language_id(spark, sf_dir).collect()}
    for i, t in docs.items():
        p, n = _plain_profile(t)
        cosine = {k: float(p @ v / np.linalg.norm(v) / max(np.linalg.norm(p), 1e-9)) for k, v in prototypes.items()}
        assert rows[i].cosine == pytest.approx(max(cosine.values()), abs=1e-3)
        assert cosine[rows[i].language] >= max(cosine.values()) - 1e-3
        bound = langid.MIN_COSINE - langid.SLACK / max(n, 1) ** 0.5
        assert rows[i].accepted == (max(cosine.values()) >= bound) or abs(max(cosine.values()) - bound) < 1e-3


def test_other_languages_are_rejected(spark, sf_dir):
    prototypes = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.", "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.", "qzx vkj wqp zzxv " * 40]
    found = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), prototypes).collect()
    assert not any(r["__pm_accepted"] for r in found)


# 9


def test_patience_is_an_increasing_common_subsequence():
    random.seed(2)
    for _ in range(200):
        a, b = ([random.randrange(12) for _ in range(random.randrange(25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.patience(list(range(50)), [*range(20), 99, *range(20, 50)])) == 50


def _plain_patience(a, b):
    """How many words patience alignment aligns, by quadratic subsequences of anchors."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    common = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not common:
        return n
    best = []  # the longest increasing run that ends at each anchor
    for i, (_, q) in enumerate(common):
        best.append(max((best[j] for j in range(i) if common[j][1] < q), key=len, default=[]) + [common[i]])
    chain = max(best, key=len)
    for (p, q), (r, s) in zip([(-1, -1), *chain], [*chain, (len(a), len(b))], strict=True):
        n += _plain_patience(a[p + 1 : r], b[q + 1 : s])
    return n + len(chain)


def test_patience_against_the_plain_version():
    # Anchors in few orders, so that the longest run is unique: rotations and edits of a text.
    random.seed(3)
    for _ in range(100):
        b = list(range(30)) + [3, 4, 5] * random.randrange(3)
        a = [x if random.random() > 0.1 else 100 + random.randrange(5) for x in b]
        cut = random.randrange(4, 8)
        a = a[cut:] + a[:cut] if random.random() < 0.5 else a
        assert len(licenses.patience(a, b)) == _plain_patience(a, b)


def test_scan_against_every_window_of_the_plain_version(spark):
    # A window of the template's length anywhere that plain alignment covers must be found, and nothing where none does.
    random.seed(4)
    templates = {"long": " ".join(f"w{i}" for i in range(40)), "short": "released under the mit license"}
    rows, want = [], []
    for i in range(60):
        name = random.choice(list(templates))
        t = templates[name].split()
        edits = random.randrange(0, len(t) // 3)
        t = [x if k not in random.sample(range(len(t)), edits) else f"e{k}" for k, x in enumerate(t)]
        noise = [random.choice(["foo", "bar", "w3", "the", "license"]) for _ in range(30)]
        text = noise + t + noise[::-1]
        rows.append((i, " ".join(text)))
        own = templates[name].split()
        known = [x if x in own else f"-{k}" for k, x in enumerate(text)]
        wide = len(own) + max(2, len(own) // 2)
        cover = max(_plain_patience(known[k : k + wide], own) / len(own) for k in range(len(text) - wide + 1))
        want.append((i, name, cover))
    found = {(r.doc_id, r.license): r.coverage for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), templates).collect()}
    for i, name, cover in want:
        # Words of the noise can spoil an anchor in one window and not in another: near the bound two words are left open.
        assert (i, name) in found or cover < licenses.MIN_COVERAGE + 2 / len(templates[name].split()), (i, name, cover)
        assert (i, name) not in found or cover >= licenses.MIN_COVERAGE, (i, name, cover)
        assert found.get((i, name), 0) <= cover + 1e-6
    assert 5 < len(found) < 60


def test_many_notices_take_time_in_proportion():
    import time

    def seconds(n):
        t = "Released under the MIT License. " * n
        start = time.perf_counter()
        assert len(licenses.matches([t], tuple(licenses.TEMPLATES.items()))) >= n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 30 * max(seconds(2000), 0.02)


def test_op9_notices(spark, sf_dir, docs):
    rows = queries.op9_license_scan(spark, sf_dir).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.doc_id].add(r.license)
        template, own = words(licenses.TEMPLATES[r.license]), words(docs[r.doc_id][r.begin : r.end])
        assert r.coverage >= licenses.MIN_COVERAGE and sum((Counter(template) & Counter(own)).values()) >= r.coverage * len(template) - 1e-3
    for i, t in docs.items():
        for name, template in licenses.TEMPLATES.items():
            if contains_words(t, template):
                assert name in found[i]


def test_licenses_with_words_changed_are_found():
    t = licenses.TEMPLATES["MIT"].replace("free of charge", "gratis").replace("Software", "Program", 2)
    got = licenses.matches(["Preface. " + t + " The end.", "", "nothing here"], tuple(sorted(licenses.TEMPLATES.items())))
    assert [(i, n) for i, n, *_ in got] == [(0, "MIT")] and got[0][2] > 0.9


# 10


def test_tournament_is_first_fit_decreasing():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        lengths = -np.sort(-rng.integers(1, 101, n))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == first_fit_decreasing(lengths.tolist(), 100)


def _packed(rows, tokens, capacity):
    """Checks that rows pack each text's tokens once, in bins that nothing overlaps, as first fit decreasing does within each group."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.first_token, r.tokens))
        by_bin[r.group, r.bin].append((r.bin_offset, r.tokens))
    for i, n in tokens.items():
        at = 0
        for first, size in sorted(by_doc.get(i, [])):
            assert first == at
            at += size
        assert at == n
    for own in by_bin.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    for g in {r.group for r in rows}:
        rest = [r for r in rows if r.group == g and r.tokens < capacity]
        lengths = sorted((r.tokens for r in rest), reverse=True)
        assert sorted(Counter(r.bin for r in rest).values()) == sorted(Counter(b for b, _ in first_fit_decreasing(lengths, capacity)).values())


def test_op10_packing(spark, sf_dir, docs):
    plain = bpe.encoder().tokenizer
    _packed(queries.op10_packing(spark, sf_dir).collect(), {i: len(plain.encode_ordinary(t)) for i, t in docs.items()}, packing.CAPACITY)


def test_groups_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 40)
    d = spark.createDataFrame([(i, "word " * (i % 37 + 1)) for i in range(200)], "doc_id bigint, text string")
    rows = packing.pack(d, 64).collect()
    assert len({r.group for r in rows}) > 2
    plain = bpe.encoder().tokenizer
    _packed(rows, {i: len(plain.encode_ordinary("word " * (i % 37 + 1))) for i in range(200)}, 64)
