"""The prefix trie, the quality cascade and the divergence audit, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dueline.llm import cascade, divergence, prefix_trie

from .conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- prefix trie ----------------------------------------------------------------


def plain_trie(rows):
    """Rows of the trie for (conv_id, turn, role, text), turns of a conversation unlike."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [t[2:] for t in sorted(v)] for c, v in found.items()}
    built = {}
    for c in whole:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(whole.get(c - c % 20, [])[:h] + whole[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    below = defaultdict(list)
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    out = []
    for n, of in members.items():
        ends = sorted(c for c in of if len(built[c]) == len(n))
        saved = sum((len(members[u]) - 1) * (len(WORD.findall(u[-1][1])) if u else 0) for u in below[n])
        out.append((
            min(of), len(n), min(members[n[:-1]]) if n else None, len(of), children[n],
            sum(not children[u] for u in below[n]), saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def conversations():
    r = random.Random(3)
    rows = []
    for c in [*range(0, 130), 4000, 4001, 10**12 + 7]:
        n = r.choice([1, 1, 2, 3, 5, 9, 30])
        hot = c % 3 == 0
        for i in range(n):
            text = "the same opening" if hot and i < 6 else r.choice(["yes", "no", None, "", "a b  c\n"])
            rows.append((c, None if i == 0 else i, "user" if i % 2 else None, text))
    rows += [(None, 1, "user", "nobody's"), (140, 5, "user", "x"), (160, 1, None, None)]
    return rows


@pytest.mark.parametrize("strings", [250, 3])
def test_trie(spark, monkeypatch, strings):
    monkeypatch.setattr(prefix_trie, "GROUP_STRINGS", strings)
    monkeypatch.setattr(prefix_trie, "BATCH", 7)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    monkeypatch.setattr(prefix_trie, "OUT_ROWS", 50)
    rows = conversations()
    table = spark.createDataFrame(
        [(*r, "x", 1, 2, 3) for r in rows],
        "conv_id long, turn long, role string, text string, sha string, d long, i long, k1 long",
    )
    got = prefix_trie.families(table.repartition(5))
    same_rows([tuple(r) for r in got.collect()], plain_trie(rows))


def test_no_conversation_has_no_node(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.families(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.families(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []


def test_repeated_turns_are_turns_each(spark):
    rows = [(20, 1, "u", "a b"), (20, 1, "u", "a b"), (20, 1, "u", "a b")]
    got = prefix_trie.families(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert sorted(r.depth for r in got.collect()) == [0, 1, 2, 3]


def test_local_trie_holds_every_string():
    """Handles are found whatever the shape: chains, bushes and prefixes of each other."""
    r = random.Random(1)
    texts = {tuple([9] + [r.choice([0, 0, 0, 1]) for _ in range(r.randrange(40))]) for _ in range(500)}
    chain = tuple([9] + [0] * 80)
    texts |= {chain[: k + 1] for k in range(0, 80, 3)} | {chain[:k] + (5, k) for k in range(1, 80, 2)}
    texts = sorted(texts, key=lambda t: hashlib.sha256(repr(t).encode()).digest())
    members = [(i, [(hash(t[: d + 1]), d) for d in range(len(t))], [1] * len(t), 1, str(i)) for i, t in enumerate(texts)]
    got = Counter()
    for row in prefix_trie.nodes_of_group(0, members):
        got[row[0], row[2]] += row[5]
    want = Counter((hash(t[: d + 1]), d + 1) for t in texts for d in range(len(t)))
    assert got == want


# -- quality cascade ------------------------------------------------------------


def counts(text):
    words = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def extra_texts():
    r = random.Random(5)
    ten = " ".join(f"w{i}" for i in range(10))
    yield from (ten, ten + "\n" + ten, "a b c d e " * 40, "x " * 5, "x " * 6, "one two three four five six", "\r\n\x0b \x0c")
    yield "😀 é́ # <b> | $5 &amp; ***\n- a\n- b\n• c…\nz..."
    for _ in range(60):
        yield " ".join(r.choice("ab") for _ in range(r.randrange(4, 60)))


def test_features_and_verdict(spark, docs, rows):
    extra = [(10_000 + i, t) for i, t in enumerate(extra_texts())]
    texts = docs.select("doc_id", "text", "one", "row").unionByName(
        spark.createDataFrame([(i, t, "x", 1) for i, t in extra], "doc_id long, text string, one string, row int")
    )
    want = [(i, *counts(t)) for i, t in [(r[0], r[1] or "") for r in rows] + extra]
    got = cascade.verdicts(texts).collect()
    same_rows([tuple(r)[:6] for r in got], want)
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_rules_are_ordered_by_rejection_per_cost(spark):
    a, b, c = (cascade.Rule(n, F.lit(True)) for n in "abc")
    found = [cascade.Estimate(a, 1.0, 0.1), cascade.Estimate(b, 0.1, 0.1), cascade.Estimate(c, 2.0, 0.9)]
    assert [r.name for r in cascade.ordered(found)] == ["b", "c", "a"]


def test_rejected_rows_meet_no_later_rule(spark):
    """The later rule would raise."""
    rows = spark.createDataFrame([(1,), (None,)], "x int")
    boom = cascade.Rule("boom", F.raise_error(F.lit("asked")).cast("boolean"))
    first = cascade.Rule("first", F.coalesce("x", F.lit(1)) == 1)
    assert [r[0] for r in rows.select(cascade.verdict([first, boom])).collect()] == [False, False]


def test_order_of_rules_does_not_change_verdicts(spark, docs):
    held = cascade.with_features(docs.select("doc_id", "text")).cache()
    rules = cascade.text_rules()
    one, two = cascade.verdict(rules), cascade.verdict(rules[::-1])
    assert held.filter(one != two).count() == 0
    assert 0 < held.filter(one).count() < held.count()


def test_cascade_of_nothing(spark, nothing):
    assert cascade.verdicts(nothing).collect() == []


# -- divergence audit -----------------------------------------------------------


def plain_audit(rows):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 3]

        def shares(found):
            n = Counter(t for d in found for t in d[2] if seen[t] >= 3)
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        sources = {d[1] for d in mine}
        of = {s: shares([d for d in mine if d[1] == s]) for s in sources}
        _, q = shares(mine)
        for s in sources:
            n, p = of[s]
            pair = [(o, sum((p[t] - of[o][1][t]) ** 2 // of[o][1][t] for t in kept)) for o in sources if o != s]
            told = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if n[t] and p[t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", told, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, docs, rows, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_BYTES", 300), ("SEGMENT_TERMS", 3), ("PAIRS", 5), ("SOURCES", 2),
                            ("SHARES", 3), ("CORRECTED_ROWS", 7)):
            monkeypatch.setattr(divergence, name, value)
    r = random.Random(2)
    extra = [
        (r.choice(["en", "de", None]), f"s{r.randrange(7)}", " ".join(r.choice("AaBbçÇ日xyz") for _ in range(40)))
        for _ in range(80)
    ] + [("la", "only", "veni vidi vici"), ("la", None, None), ("it", "x", "\x00퟿ ´"), ("it", "y", "")]
    more = spark.createDataFrame(extra, "lang string, source string, text string")
    table = docs.select("lang", "source", "text", "key", "label").unionByName(more, allowMissingColumns=True)
    got = [tuple(x) for x in divergence.audited(table).collect()]
    same_rows(got, plain_audit([(x[2], x[3], x[1]) for x in rows] + extra))


def test_audit_of_nothing(nothing):
    assert divergence.audited(nothing).collect() == []


def test_segments_are_merged_in_order(monkeypatch):
    monkeypatch.setattr(divergence, "SEGMENT_TERMS", 2)
    r = random.Random(4)
    segments, want = [], Counter()
    for _ in range(12):
        block = divergence.Block()
        for _ in range(5):
            words = [r.choice("abcdefghij") for _ in range(9)]
            want.update(words)
            block.add("en", r.choice("st"), " ".join(words))
        segments += [s[1:] for s in block.run(1)]
    found = list(divergence.frequencies(divergence.merged(sorted(segments, key=lambda s: s[:2]))))
    assert [f[1] for f in found] == sorted(f[1] for f in found)
    assert {f[1].decode(): sum(f[3].values()) for f in found} == want
