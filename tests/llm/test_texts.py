"""Fingerprints, BPE, packing, Re-Pair files and language ID."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_pipeline import language_id
from dueline.llm import bpe, fingerprints, langid, packing, repair
from dueline.llm.queries import BYTE_LEVEL, QUERIES, RANKS, WORD_LEVEL
from dueline.llm.words import WORD_PATTERN, library_table

from .conftest import same_rows, texts

PATTERN = public_tokenizers.PATTERN


def odd_texts(n=1500):
    r = random.Random(3)
    letters = "aaab  \n\t\x1c\xa0 'stdlé1٣!?.日本ßİΣ́🙂\x85　"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(0, 50))) for _ in range(n)]
    return [*made, "", " ", "  ", "a" * 3000, "ab" * 999, "-" * 300, "== ===\n\n\n=", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_is_the_librarys_encoding(library):
    ours = bpe.loaded(RANKS, PATTERN)
    for text, ids in zip(odd_texts(), ours.encode(odd_texts()), strict=True):
        assert library.encode_ordinary(text) == ids.tolist(), repr(text)
        assert ours.decode(ids.tolist()) == text.encode()


def test_words_alone_give_the_same_ids():
    ours = bpe.loaded(RANKS, PATTERN)
    words = [b"aaaaaaa", b" thing", b"antidisestablishment", "straße".encode(), b"x"]
    for word, ids in zip(words, ours.replay(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ours.alone(word)


@pytest.mark.parametrize(
    ("path", "pattern", "space"), [(BYTE_LEVEL, PATTERN, True), (WORD_LEVEL, WORD_PATTERN, False)]
)
def test_word_tables_give_the_librarys_ids(path, pattern, space):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    table = library_table(path, pattern, space)
    for text, ids in zip(odd_texts(), table.codes(odd_texts()), strict=True):
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


@pytest.mark.parametrize(
    ("path", "pattern", "space"), [(BYTE_LEVEL, PATTERN, True), (WORD_LEVEL, WORD_PATTERN, False)]
)
def test_added_tokens_get_their_ids_as_by_default(path, pattern, space):
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "aB", "'s", "é", "́", "Σ", "\x85"]
    odd = [*odd_texts(), *("".join(r.choices(parts, k=r.randrange(9))) for _ in range(1500))]
    table = library_table(path, pattern, space, added=True)
    for text, ids in zip(odd, table.codes(odd), strict=True):
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


def literal_docs(spark):
    rows = [(1, "a <|endoftext|> x"), (2, "b<|startoftext|><|endoftext|>"), (3, "plain")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_packed_literals_of_added_tokens(spark):
    rows, df = literal_docs(spark)
    tokenizer = Tokenizer.from_file(WORD_LEVEL)
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r.doc_id: r.doc_tokens for r in packing.packed(df, WORD_LEVEL).collect()} == want


def test_files_with_literals_of_added_tokens(spark):
    rows, df = literal_docs(spark)
    tokenizer, want, start = Tokenizer.from_file(BYTE_LEVEL), [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same_rows([tuple(r) for r in repair.written_and_read(df, BYTE_LEVEL, PATTERN).collect()], want)


def test_round_trip_of_documents(docs, rows, library):
    want = []
    for i, t in texts(rows):
        ids = library.encode_ordinary(t)
        joined = " ".join(map(str, ids))
        want.append(
            (i, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        )
    same_rows([tuple(r) for r in bpe.round_trip(docs, RANKS, PATTERN).collect()], want)


def test_fingerprints_add_up():
    a, b = "first paragraph of some length\nx\n", "another one that is long enough\n\nshort"
    both = fingerprints.plus(fingerprints.of_text(a), fingerprints.of_text(b))
    lines = [*a.split("\n"), *b.split("\n")]
    random.Random(1).shuffle(lines)
    assert fingerprints.of_text("\n".join(lines)) == both
    assert fingerprints.minus(both, fingerprints.of_text(b)) == fingerprints.of_text(a)
    assert fingerprints.of_text(None) == fingerprints.of_text("")
    assert fingerprints.of_text("ab") != fingerprints.of_text("ba")
    assert fingerprints.likeness(both, both) == 1.0
    assert fingerprints.likeness(fingerprints.of_text(a), fingerprints.of_text("")) == 0.0


def test_edited_texts(docs, rows, spark):
    got = fingerprints.compare_with_edits(docs).collect()
    plain = texts(rows)
    order = sorted(plain, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want.append((i, len(t), digest, fingerprints.of_text(t), fingerprints.of_text(edited)))
    same_rows([tuple(r)[:5] for r in got], want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    (only,) = fingerprints.compare_with_edits(one).collect()
    assert only.near_next == 1.0


def test_fingerprint_of_documents(docs, rows):
    want = [(i, fingerprints.of_text(t)) for i, t in texts(rows)]
    same_rows([tuple(r) for r in fingerprints.fingerprint(docs).collect()], want)


@pytest.mark.parametrize("n", [0, 1, 2, 40, 700])
def test_pack_loses_nothing(n):
    r = random.Random(n)
    lengths = [max(1, int(r.expovariate(1 / 700))) for _ in range(n)]
    spans = defaultdict(list)
    for sequence in packing.pack(lengths):
        size = sum(k for _, _, k in sequence)
        assert size <= packing.WINDOW and size & (size - 1) == 0
        for doc, start, k in sequence:
            spans[doc].append((start, k))
    for doc, found in spans.items():
        at = 0
        for start, k in sorted(found):
            assert start == at
            at += k
        assert at == lengths[doc]
    assert sorted(spans) == list(range(n))


def sizes_of(sequences):
    return Counter(sum(n for _, _, n in s) for s in sequences)


def test_each_tier_is_packed_into_its_own_length():
    assert set(sizes_of(packing.pack([100] * 1280))) == {128}
    assert set(sizes_of(packing.pack([700] * 1024))) == {1024}
    assert set(sizes_of(packing.pack([100] * 2048, tiers=(1024, 2048)))) >= {1024}
    assert 2048 not in sizes_of(packing.pack([100] * 2048, tiers=(1024, 2048)))
    assert set(sizes_of(packing.pack([100] * 2048, tiers=(2048,)))) == {2048}
    mixed = packing.pack([100] * 5000 + [400] * 1000 + [1900] * 10)
    assert {128, 512, 2048} <= set(sizes_of(mixed))
    assert {128, 512, 2048} <= {tier for tier, _ in packing.step_groups(mixed)}


def test_gaps_of_long_sequences_are_filled_from_shorter_tiers():
    sequences = packing.pack([1900, 100, 48] * 7)
    assert sizes_of(sequences) == {2048: 7}
    assert all(sorted(n for _, _, n in s) == [48, 100, 1900] for s in sequences)


def test_step_groups_are_of_one_tier():
    sequences = packing.pack([900, 1500, 30, 4000, 2048, 77] * 30)
    groups = defaultdict(list)
    for s, (tier, group) in zip(sequences, packing.step_groups(sequences), strict=True):
        groups[group].append((tier, sum(n for _, _, n in s)))
    assert all(len({t for t, _ in g}) == 1 for g in groups.values())
    assert all(sum(n for _, n in g) <= packing.STEP_TOKENS for g in groups.values())


def test_packed_documents(docs, rows):
    tokenizer = Tokenizer.from_file(WORD_LEVEL)
    tokenizer.encode_special_tokens = True
    wanted = defaultdict(int)
    for i, t in texts(rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        wanted[i, len(ids)] += len(ids)
    got = packing.packed(docs, WORD_LEVEL).collect()
    found, places = defaultdict(int), defaultdict(list)
    for r in got:
        found[r.doc_id, r.doc_tokens] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert found == wanted
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    text = dict(texts(rows))[5]
    ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
    mine = [r for r in got if r.doc_id == 5]
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)


def test_frames_decode_at_random():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 20, n).astype("<u4").tobytes() for n in (1, 5, 4000, 1, 30000, 2)]
    one = repair.Frame(repair.frame([5, None, 7, 7, 9, 10], codes, 50257))
    assert len(one.rules) > 100 and len(one.symbols) < 20000
    assert one.all_ids().astype("<u4").tobytes() == b"".join(codes)
    assert one.doc_ids == [5, None, 7, 7, 9, 10]
    for start, n in ((0, 3), (100, 57), (29990, 100)):
        assert one.ids(4, start, n).astype("<u4").tobytes() == codes[4][4 * start : 4 * (start + n)]
    wide = repair.Frame(repair.frame([1], [np.array([70000, 2], "<u4").tobytes()], 80000))
    assert wide.ids(0).tolist() == [70000, 2]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3000, 5000)
    for ids in (np.zeros(100_000, int), np.tile(text, 20), rng.zipf(1.3, 60_000) % 3000):
        rules, symbols, last = repair.grammar(ids.astype("<u4"), np.array([len(ids) - 1]), 3000)
        left = symbols[:-1].astype(int) << 32 | symbols[1:]
        assert np.unique(left, return_counts=True)[1].max(initial=0) < repair.LEAST_COUNT
        one = repair.Frame(repair.frame([1], [ids.astype("<u4").tobytes()], 3000))
        assert (one.all_ids() == ids).all()


def test_files_of_ids(docs, rows):
    tokenizer = Tokenizer.from_file(BYTE_LEVEL)
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for i, t in sorted(texts(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same_rows([tuple(r) for r in repair.written_and_read(docs, BYTE_LEVEL, PATTERN).collect()], want)


def test_languages(docs, rows, folder, spark):
    got = langid.identified(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        rest = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4
        assert r.held_out == (rest == 2) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 9))
    real = spark.read.parquet(f"{folder}/documents.parquet")
    both = langid.identified(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def plain_lanes(text):
    """Likeness lanes of a text, window by window."""
    lanes = [0] * fingerprints.LIKE_LANES
    for p in text.encode().split(b"\n"):
        for i in range(max(0, len(p) - fingerprints.WINDOW + 1)):
            one, two = (int.from_bytes(p[i + k : i + k + 8], "little") for k in (0, 8))
            h = one * int(fingerprints._A) % 2**64
            h ^= h >> 31
            h = (h + two * int(fingerprints._B)) % 2**64
            h ^= h >> 29
            slot = h * int(fingerprints._C) % 2**64 >> 54
            lanes[slot // 2] += -1 if slot % 2 else 1
        if 0 < len(p) < fingerprints.WINDOW:
            slot = int.from_bytes(hashlib.shake_128(p).digest(4), "little") >> 22
            lanes[slot // 2] += -1 if slot % 2 else 1
    return lanes


def test_likeness_is_that_of_the_fingerprints(spark):
    texts_ = ["a" * 40_000, "a" * 66_000 + "b", "a" * 65_551, "", "short\nlines\n", "ü" * 90 + "\nmore of it " * 9]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id int, text string")
    found = fingerprints.compare_with_edits(docs).orderBy("doc_id").collect()
    for i, r in enumerate(found):
        after = found[i - 1].fingerprint
        assert r.near_edited == pytest.approx(fingerprints.likeness(r.fingerprint, r.edited_fingerprint), abs=1e-12)
        assert r.near_next == pytest.approx(fingerprints.likeness(r.fingerprint, after), abs=1e-12)
        mine, other = plain_lanes(texts_[i]), plain_lanes(texts_[i - 1])
        dot = sum(a * b for a, b in zip(mine, other, strict=True))
        norm = (sum(a * a for a in mine) * sum(b * b for b in other)) ** 0.5
        assert r.near_next == pytest.approx(min(1.0, max(0.0, dot / norm if norm else 0.0)), abs=1e-9)
    assert found[1].near_next > 0.99 and found[2].near_next > 0.99


def test_folders_are_in_the_default_file_system(spark):
    from dueline.llm.files import qualified

    assert qualified(spark, "/a/b") == qualified(spark, "file:/a/b") == "file:///a/b"
    settings = spark._jsc.hadoopConfiguration()
    before = settings.get("fs.defaultFS")
    settings.set("fs.defaultFS", "viewfs://cluster")
    settings.set("fs.viewfs.mounttable.cluster.link./a", "file:///tmp")
    try:
        assert qualified(spark, "/a/b") == "viewfs://cluster/a/b"
        assert qualified(spark, "file:/a/b") == "file:///a/b"
    finally:
        settings.set("fs.defaultFS", before or "file:///")


def test_languages_learned_from_few(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identified(none).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(3, "some text", "xx"), (4, "1 2", "xx")], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(one).collect()} == {
        3: ("xx", 1.0),
        4: ("und", 0.0),
    }


def test_texts_with_letters_stay_whatever_was_learned(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "some text", None), (2, "1 2", None), (3, None, None)], schema)
    for stage in (langid.with_known_language(none, langid.train(none)), language_id(spark, none, "")):
        assert [r.doc_id for r in stage.collect()] == [1]
    und = spark.createDataFrame([(3, "some text", "und"), (4, "1 2", "und")], schema)
    assert [r.doc_id for r in langid.with_known_language(und, langid.train(und)).collect()] == [3]


ENGLISH = "the cat and the other thing with that"
GERMAN = "der hund und die straße nicht mit dem"


def test_language_of_mostly_empty_texts_is_learned(spark):
    """Empty texts of a language take nothing from its few real ones."""
    rows = [(i, f"{ENGLISH} {i % 7}", "en") for i in range(400)]
    rows += [(1000 + i, None if i % 2 else " 12 ", "de") for i in range(9000)]
    rows += [(20_000 + i, f"{GERMAN} {i % 5}", "de") for i in range(30)]
    rows += [(30_001, "hapax", "once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, "doc_id", "text", "lang").groupBy("lang").count()
    real = [(i, lang) for i, t, lang in rows if t and t != " 12 " and zlib.crc32(str(i).encode()) % 4 != 2]
    assert {r["lang"]: r["count"] for r in sample.collect()} == {
        lang: sum(r[1] == lang for r in real) for lang in ("de", "en", "once")
    }
    found = {r.doc_id: r.lang_pred for r in langid.identified(docs).collect()}
    assert all(found[20_000 + i] == "de" for i in range(30)) and found[0] == "en" and found[1000] == "und"


def test_hundreds_of_labels(spark, monkeypatch):
    rows = [(i, f"w{i % 300} " + (ENGLISH if i % 2 else GERMAN), f"label {i % 300:03d}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGUAGES", 40)
    machines = langid.train(docs)
    assert len([x for m in machines.members.values() for x in m]) == 40
    langs, scores = machines.predict([GERMAN, ENGLISH, "123"])
    assert set(langs[:2]) <= {r[2] for r in rows} and langs[2] == "und" and all(0 <= s <= 1 for s in scores)


def test_features_are_those_of_the_text_alone():
    texts_ = ["a", "", "zebra über", "b c", "日本"]
    assert (langid.features(texts_) == np.vstack([langid.features([t]) for t in texts_])).all()


def test_machine_is_at_its_optimum():
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 6))
    y = np.where(x[:, 0] + 0.7 * r.normal(size=80) > 0.3, 1.0, -1.0)
    w = langid.train_machine(x, y)
    whole = np.hstack([x, np.ones((80, 1))])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * langid._PENALTY * 100
    gap = np.maximum(0, 1 - y * (whole @ w))
    gradient = w - whole.T @ (weight * y * gap)
    assert np.abs(gradient).max() < 1e-8


def test_predicted_language_and_score_decide(spark):
    rows = [(i, ENGLISH if i % 2 else GERMAN, "en" if i % 2 else "de") for i in range(200)]
    rows += [(500, "12 !", "en"), (501, ENGLISH, "de"), (502, GERMAN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    machines = langid.train(docs)
    german = langid.with_known_language(docs, machines, wanted=["de"])
    assert sorted(r.doc_id for r in german.collect()) == [*range(0, 200, 2), 502]
    every = langid.with_known_language(docs, machines, least=0.3)
    assert sorted(r.doc_id for r in every.collect()) == [*range(200), 501, 502]
    assert langid.with_known_language(docs, machines, least=1.1).collect() == []


def test_lang_and_source_are_no_inputs(docs):
    machines = langid.train(docs)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    same_rows(
        [tuple(r) for r in langid.predicted(docs, machines).collect()],
        [tuple(r) for r in langid.predicted(other, machines).collect()],
    )


def test_empty_tables(nothing):
    for got in (
        fingerprints.compare_with_edits(nothing),
        fingerprints.fingerprint(nothing),
        bpe.round_trip(nothing, RANKS, PATTERN),
        bpe.encoded(nothing, RANKS, PATTERN),
        packing.packed(nothing, WORD_LEVEL),
        repair.written_and_read(nothing, BYTE_LEVEL, PATTERN),
        langid.identified(nothing),
    ):
        assert got.collect() == []
    assert len(QUERIES) == 13
