"""Sharding, WARC, suffix dedup, SimHash, embeddings and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dueline.llm import crosspolytope, kdtree, langid, simhash, substrings, suffixes, warc
from dueline.llm._support import staged
from dueline.llm.components import components

from .conftest import same_rows, texts


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# -- sharding ---------------------------------------------------------------


def test_shards(docs, rows):
    got = kdtree.sharded(docs).collect()
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts(rows)]
    same_rows([(r.doc_id, r.size, r.text_crc32) for r in got], want)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_ties_are_split(spark):
    data = [(i, "x" * (i % 50), "en", "same") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    sizes = defaultdict(int)
    for r in kdtree.sharded(docs, 16, dimensions=("source",)).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 4 * 51
    by_target = kdtree.sharded(docs, None, target_bytes=20_000).agg({"shard": "max"}).first()[0]
    assert by_target + 1 == -(-sum(sizes.values()) // 20_000)


# -- WARC --------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "page " * 40
    data = [
        (3, "http://a/ b\r\nX: y", body),
        (1, "http://a/é", body),
        (2, None, None),
        (4, "", ""),
        (5, "u", "short"),
        (6, "u", "short"),
        (7, "u", "ü" * 5000),
        (None, "u", body),
        (1, "http://a/é", body),
        (8, None, "WARC/1.1\r\n\r\nno record" * 9),
    ]
    schema = "page_id long, url string, html string, digest string, refers_to int"
    return spark.createDataFrame([(*d, "x", 1) for d in data], schema).repartition(2), data


def test_archive(pages):
    df, data = pages
    want = []
    for page, _, html in data:
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        first = min((p for p, _, h in data if p is not None and h == html and len(raw) >= 100), default=page)
        again = first != page
        want.append((page, len(raw), digest, "revisit" if again else "response", first if again else None))
    for roll in (warc.ROLL_BYTES, 300):
        same_rows([tuple(r) for r in warc.written_and_read(df, roll).collect()], want)


def test_archives_are_the_same_twice(spark, pages, tmp_path):
    df, _ = pages
    one, two = (
        sorted(tuple(r) for r in warc.write_archive(df, f"file://{tmp_path}/{n}", 400).collect()) for n in "ab"
    )
    assert one == two and len(one) > 1
    payloads = {r.page_id: r.payload for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()}
    assert payloads[7].decode() == "ü" * 5000
    (tmp_path / "a" / "part-999999-00000.warc.gz").write_bytes(b"x")
    with pytest.raises(ValueError, match="manifest"):
        warc.read_archive(spark, f"file://{tmp_path}/a")


# -- suffix dedup --------------------------------------------------------------


def brute_repeats(texts_, width=200):
    seen = defaultdict(int)
    for t in texts_:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] += 1
    out = []
    for t in texts_:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                covered[i] += 1
                covered[i + width] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, kept))
    return out


def with_digest(found):
    return [(*f[:3], hashlib.sha256(f[3]).hexdigest()) for f in found]


def pieces():
    rng = np.random.default_rng(5)
    base = [bytes(rng.choice(list(b"abcdefgh \n"), n).astype(np.uint8)) for n in rng.integers(0, 900, 25)]
    out = [b"", b"x" * 199, b"x" * 200, b"x" * 201, b"q" * 1000, b"pq" * 500]
    for k in range(40):
        a, b = base[rng.integers(25)], base[rng.integers(25)]
        i = int(rng.integers(len(a) + 1))
        out.append([a, a[i:] + b, a[:i] + b"X" + a[i:], a[:150] * int(rng.integers(1, 5)), b"a" * i][k % 5])
    return out


def test_difference_cover_finds_equal_prefixes():
    data = pieces()
    lengths = np.array([len(p) for p in data])
    starts = np.cumsum(lengths) - lengths
    for width in (98, 200):
        seen = defaultdict(list)
        for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            for i in range(s, s + n - width + 1):
                seen[b"".join(data)[i : i + width]].append(i)
        want = {i for at in seen.values() if len(at) > 1 for i in at}
        found = suffixes.repeated_starts(b"".join(data), starts, lengths, width)
        assert set(np.flatnonzero(found).tolist()) == want


def test_repeats_are_removed(spark, docs, rows):
    data = pieces()
    made = spark.createDataFrame([(i, p.decode()) for i, p in enumerate(data)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digests(made.repartition(3)).collect()}
    assert [got[i] for i in range(len(data))] == with_digest(brute_repeats(data))
    want = with_digest(brute_repeats([t.encode() for _, t in texts(rows)]))
    same_rows(
        [tuple(r) for r in substrings.digests(docs).collect()],
        [(i, *w) for (i, _), w in zip(texts(rows), want, strict=True)],
    )


def runs_in_rounds(data, most, width=200, buckets=3):
    """What the tasks of all rounds find, without Spark."""
    dealt = list(
        substrings._cut([pa.record_batch({"one": range(len(data)), "two": range(len(data)), "text": data})], width, buckets)
    )
    last, found, used = len(substrings.widenings(width)), [], 0
    for rounds in range(last + 1):
        rows = sorted(((b, x) for d in dealt for b, x in zip(d["bucket"], d["blob"], strict=True)), key=lambda r: r[0])
        if not rows:
            break
        used = rounds
        batch = pa.record_batch({"bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]})
        hot = []
        for out in substrings._sort_buckets([batch], width, most if rounds < last else None):
            for one, start, end, blob in zip(out["one"], out["start"], out["end"], out["blob"], strict=True):
                if blob is None:
                    found.append((one, start, end))
                else:
                    hot.append(blob)
        dealt = list(substrings._cut_again([pa.record_batch({"blob": pa.array(hot, pa.binary())})], width, buckets, rounds + 1))
    return found, used


@pytest.mark.parametrize("most", [0, 300, 2000, 1 << 30])
def test_hot_keys_are_cut_again(most):
    rng = random.Random(3)
    noise = ["".join(rng.choices("abcdef ", k=400)) for _ in range(30)]
    line = "a line that many documents share, word by word, in places of all kinds"
    data = [p.decode() for p in pieces()] + [n[:200] + line + n[200:] for n in noise]
    data += [noise[i][100:200] + line + noise[i][200:330] for i in range(8)]
    found, used = runs_in_rounds(data, most)
    assert (used > 0) == (most < 1 << 30)
    want = brute_repeats([t.encode() for t in data])
    for i, t in enumerate(data):
        kept, spans = substrings._without(t.encode(), [(a, b) for one, a, b in found if one == i])
        assert (len(t) - len(kept), spans, kept) == want[i][1:], i


def test_keys_grow_to_the_whole_string():
    at = np.arange(0, 177)
    for rounds in range(len(substrings.widenings(200)) + 1):
        low, high = substrings.key_spans(at, np.full(177, 176), 200, rounds)
        assert (low >= at).all() and (high <= at + 200).all()
    assert (low == at).all() and (high == at + 200).all()


def test_hot_keys_on_tables(docs, rows):
    want = with_digest(brute_repeats([t.encode() for _, t in texts(rows)]))
    same_rows(
        [tuple(r) for r in substrings.digests(docs, hot_bytes=5000).collect()],
        [(i, *w) for (i, _), w in zip(texts(rows), want, strict=True)],
    )


# -- SimHash -------------------------------------------------------------------


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_documents(docs, rows):
    plain = sorted(texts(rows), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_fingerprint(t) for _, t in plain]
    near = [
        (i, j) for i in range(len(plain)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    roots = groups(len(plain), near)
    want = [(i, f"{p:016x}", plain[r][0]) for (i, _), p, r in zip(plain, prints, roots, strict=True)]
    same_rows([tuple(r) for r in simhash.near_duplicates(docs).collect()], want)


def test_near_fingerprints_are_all_linked(spark):
    rng = np.random.default_rng(3)
    prints = [0, 1, 3, (1 << 64) - 1]
    for center in rng.integers(0, 1 << 63, 5).tolist():
        for _ in range(120):
            flips = rng.choice(64, rng.integers(0, 6), replace=False).tolist()
            prints.append(center ^ sum(1 << b for b in flips))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "bits long")
    tree = {r.node: r.root for r in components(simhash.linked(df)).collect()}
    bits = np.array(prints, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(bits)) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4).tolist()]
    want = groups(len(prints), near)
    assert [tree.get(p, p) for p in prints] == [prints[r] for r in want]


def test_every_near_pair_shares_a_variant():
    masks = simhash.variant_masks(4)
    assert len(masks) == 64
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.choice(64, 4, replace=False).tolist())
        assert any(not flips & (m & ((1 << 64) - 1)) for m in masks)


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(99, 98)], "a long, b long")
    assert {r.node: r.root for r in components(path).collect()} == {**{i: 0 for i in range(1, 61)}, 99: 98}


# -- embeddings ------------------------------------------------------------------


def brute_vectors(rows):
    fit = [
        i
        for i, (_, e, label) in enumerate(rows)
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
    ]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in fit}
    near = [
        (i, j)
        for i in fit
        for j in fit
        if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93
    ]
    roots = groups(len(rows), near)
    return [
        (rows[i][0], sum(a == i for a, _ in near), rows[r][0], r == i) for i, r in enumerate(roots)
    ]


@pytest.mark.parametrize("most", [crosspolytope.MOST_ROWS, 8])
def test_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(crosspolytope, "MOST_ROWS", most)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 12))
    data = []
    for k in range(220):
        v = base[k % 30] + rng.normal(size=12) * [0.0, 0.05, 0.1, 0.6][k % 4]
        data.append((k, [float(np.float32(x)) for x in v], k % 3))
    data += [(300 + i, data[5][1], data[5][2]) for i in range(9)]
    data += [(310, [2 * x for x in data[5][1]], data[5][2]), (311, data[5][1], None), (312, None, 1)]
    data += [(313, [0.0] * 12, 1), (314, [1.0, None] * 6, 1), (315, [float("nan")] * 12, 1)]
    data += [(316, [1.0, 2.0], 1), (317, [1.0, 2.0], 1), (318, [float("inf")] * 12, 1), (319, [], 1), (320, [3.0], 1)]
    schema = "vec_id long, embedding array<float>, label int, class string, key int"
    df = spark.createDataFrame([(*d, "x", 1) for d in data], schema).repartition(3)
    same_rows([tuple(r) for r in crosspolytope.near_duplicates(df).collect()], brute_vectors(data))
    assert crosspolytope.near_duplicates(df.limit(0)).collect() == []


def test_labels_whose_hashes_are_alike_are_not_linked(spark):
    labels = spark.range(20_000).select(F.col("id").cast("int").alias("label"))
    group = F.pmod(F.xxhash64("label"), F.lit(1 << 20))
    alike = labels.groupBy(group).agg(F.collect_list("label").alias("labels")).filter(F.size("labels") > 1)
    found = [([1.0, 2.0, 3.0, float(k)], x) for r in alike.collect() for x in r.labels for k in range(2)]
    data = [(i, *row) for i, row in enumerate(found)]
    assert len(data) > 100
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    same_rows([tuple(r) for r in crosspolytope.near_duplicates(df).collect()], brute_vectors(data))


def test_rows_of_one_key_are_linked_by_label():
    x = np.array([1.0, 2.0, 3.0, 4.0])
    codes = crosspolytope.buckets(crosspolytope.unit([x]))[0].tobytes()

    def bucket(*labels):
        return [(7, i, 1, label, 0, 0, codes, x.tobytes(), 0, 0, 0) for i, label in enumerate(labels)]

    assert crosspolytope._bucket_links(bucket(5, 6), 0.93) is None
    assert crosspolytope._bucket_links(bucket(5, 6, 5), 0.93)["class"].tolist() == [0, 2]


def test_recall_of_real_vectors(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = sum(r.n_links for r in crosspolytope.near_duplicates(df).collect())
    want = sum(r[1] for r in brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()]))
    assert want * 0.9 <= got <= want


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    x, y = crosspolytope.buckets(a), crosspolytope.buckets(b)
    met = (x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))
    assert met.mean() >= 0.95


# -- pipeline --------------------------------------------------------------------


def test_stages(spark, docs, rows):
    found, results = docs, []
    for name, stage in corpus_pipeline.STAGES:
        found = staged(stage(spark, found, ""), name)
        results.append(found)
    known, single, clean, packed = results
    for kept in (known, single, clean):
        assert kept.columns == docs.columns
    # Labels here are drawn by chance, so many a language cannot be told.
    _, scores = langid.train(docs).predict([r[1] for r in rows])
    sure = [s >= corpus_pipeline.LEAST_SCORE for s in scores]
    letters = [r for r, s in zip(rows, sure, strict=True) if s and any(map(str.isalpha, r[1]))]
    same_rows([tuple(r) for r in known.collect()], letters)
    # One row of each group, unchanged.
    left = [tuple(r) for r in single.collect()]
    assert len(left) == len({(r[0], r[1]) for r in left}) and all(r in letters for r in left)
    order = sorted(letters, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_fingerprint(r[1]) for r in order]
    near = [(i, j) for i in range(len(order)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    first = {order[r][0]: 0 for r in groups(len(order), near)}
    assert {r[0] for r in left} == set(first)
    assert len(left) == len(set(groups(len(order), near)))
    after = brute_repeats([r[1].encode() for r in left])
    want = []
    for r, (_, n, _, kept) in zip(left, after, strict=True):
        text = kept.decode("utf-8", "ignore") if n else r[1]
        if text:
            want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    same_rows([tuple(r) for r in clean.collect()], want)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in want}


def test_empty_tables(spark, nothing, docs):
    for got in (
        kdtree.sharded(nothing),
        substrings.digests(nothing),
        simhash.near_duplicates(nothing),
    ):
        assert got.collect() == []
    found = nothing
    for name, stage in corpus_pipeline.STAGES:
        found = staged(stage(spark, found, ""), name)
    assert found.collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.written_and_read(pages).collect() == []
