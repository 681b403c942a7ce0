"""Hierarchical language identification with linear support vector machines.

The language family is predicted first, one-versus-rest; inside a family with
several languages one-versus-one machines vote. All are L2-regularized with
squared hinge loss, over hashed byte bigrams and trigrams of whole lower-case
texts. Each machine is trained by a task of its own, on a sample of at most
``SAMPLE`` texts per language; everything else covers all rows. Labels with fewer
than ``LEAST_TEXTS`` texts with letters, and those beyond the ``LANGUAGES`` most
frequent ones, are not learned.

``lang`` is only read to train, and only from rows whose crc32(doc_id) modulo 4
is not 2; rows without doc_id or lang do not train. A text that is null or has
no letters gets ``und`` with score 0, as does every text if nothing was learned;
a single learned language gets all other texts with score 1. Ties go to the
language first in the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.llm._support import bounded_batches, lean, map_batches, staged

DIMENSIONS = 1024
#: Texts of a language that train, and texts of a side of a machine.
SAMPLE = 500
SIDE = 2000
#: Languages that are learned at most, and the texts a learned one has at least.
LANGUAGES = 256
LEAST_TEXTS = 1
UNKNOWN = "und"
HELD_OUT = 2
_PENALTY = 10.0
_BYTES = 1 << 20
#: Families of language codes (fixed values); a code not listed is its own family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "bn gu hi mr ne or pa sa si sd ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_MIX = np.uint32(2654435761)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"own:{lang}")


def features(texts: list[str]) -> np.ndarray:
    """Unit rows of hashed bigrams and trigrams, square roots of their counts."""
    # Two blanks before and one after: no window sees letters of the next text.
    raw = [("  " + t.lower() + " ").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    start = 0
    while start < len(raw):
        stop, size = start, 0
        while stop < len(raw) and (stop == start or size + len(raw[stop]) <= _BYTES):
            size += len(raw[stop])
            stop += 1
        part = raw[start:stop]
        data = np.frombuffer(b"".join(part) + b"  ", np.uint8).astype(np.uint32)
        # Digits and signs say little about a language.
        letter = (data >= 97) & (data <= 122) | (data >= 128)
        data = np.where(letter, data, np.uint32(32))
        two = data[:-2] << np.uint32(8) | data[1:-1]
        three = two << np.uint32(8) | data[2:] | np.uint32(1 << 24)
        owner = np.repeat(np.arange(len(part)), [len(p) for p in part]) * DIMENSIONS
        counts = np.zeros(len(part) * DIMENSIONS)
        for code in (two, three):
            slot = (code * _MIX >> np.uint32(22)).astype(np.int64)
            counts += np.bincount(owner + slot, minlength=len(counts))
        out[start:stop] = np.sqrt(counts).reshape(len(part), DIMENSIONS)
        start = stop
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = _PENALTY) -> np.ndarray:
    """Weights, then the bias, for rows of label 1 and -1: Newton on the active rows."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * penalty * 100
    active = np.ones(len(y), bool)
    for _ in range(30):
        xa = x[active] * weight[active, None]
        w = np.linalg.solve(eye + xa.T @ x[active], xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Machines:
    """Weights by family and by pair of languages."""

    families: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    members: dict[str, list[str]] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letters(t)]
        if not some or not self.members:
            return out, scores
        x = features([texts[i] for i in some])
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        names = sorted(self.members)
        if len(names) > 1:
            margin = np.stack([x @ self.families[n] for n in names], 1)
            likely = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
            likely /= likely.sum(1, keepdims=True)
        else:
            likely = np.ones((len(x), 1))
        family = likely.argmax(1)
        for f, name in enumerate(names):
            langs = self.members[name]
            rows = np.flatnonzero(family == f)
            votes = np.ones((len(rows), 1)) if len(langs) == 1 else np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                margin = x[rows] @ self.pairs[langs[a], langs[b]]
                p = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
                votes[:, a] += p / (len(langs) - 1)
                votes[:, b] += (1 - p) / (len(langs) - 1)
            best = votes.argmax(1)
            for k, r in enumerate(rows.tolist()):
                out[some[r]] = langs[best[k]]
                scores[some[r]] = float(likely[r, f] * votes[k, best[k]])
        return out, scores


def held_out(doc_id: str = "doc_id") -> Column:
    rest = F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(4))
    return F.coalesce(rest == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(text, lang, place) of the ``SAMPLE`` texts of each learned language that a hash puts first.

    Only texts with letters count. Languages are those with the most of them, at
    most ``LANGUAGES`` and each with ``LEAST_TEXTS`` at least; ``place`` is from 1.
    """
    rows = docs.filter(
        F.col(f"`{lang}`").isNotNull()
        & F.col(f"`{doc_id}`").isNotNull()
        & ~held_out(doc_id)
        & F.col(f"`{text}`").rlike(r"\p{L}")
    ).select(
        F.col(f"`{lang}`").alias("lang"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("draw"),
        F.col(f"`{text}`").alias("text"),
    )
    # Slim rows find where each language's sample ends; tasks keep SAMPLE of them.
    order = Window.partitionBy("lang").orderBy("draw")
    firsts = rows.select("lang", "draw").withColumn("place", F.row_number().over(order))
    last = firsts.filter(F.col("place") <= SAMPLE).groupBy("lang").agg(F.max("draw").alias("last"))
    many = rows.groupBy("lang").count().filter(F.col("count") >= LEAST_TEXTS)
    learned = many.orderBy(F.desc("count"), "lang").limit(LANGUAGES).join(last, "lang").drop("count")
    drawn = rows.join(F.broadcast(learned), "lang").filter(F.col("draw") <= F.col("last"))
    # Equal draws are equal rows but for a clash; they may swap places.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return drawn.select("text", "lang", place.alias("place")).filter(F.col("place") <= SAMPLE)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Machines:
    """Machines for the languages of ``docs``; they alone come to the driver.

    A side of a machine has about ``SIDE`` texts at most, the same number of each
    of its languages, so a task has a bounded matrix however many there are.
    """
    spark = docs.sparkSession
    sample = staged(training_sample(docs, doc_id, text, lang), "sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    out = Machines()
    for code in langs:
        out.members.setdefault(family_of(code), []).append(code)
    # Each machine: its name, the languages it is for and those it is against.
    jobs = [
        (f"family\t{name}", members, [x for x in langs if x not in members])
        for name, members in out.members.items()
        if len(out.members) > 1
    ]
    jobs += [
        (f"pair\t{a}\t{b}", [a], [b])
        for members in out.members.values()
        for a, b in combinations(members, 2)
    ]
    if not jobs:
        return out
    sides = [
        (name, x, side, max(1, SIDE // len(of)))
        for name, plus, minus in jobs
        for side, of in ((1, plus), (-1, minus))
        for x in of
    ]
    # At most LANGUAGES rows for each of as many families, and one for each end of a pair.
    table = spark.createDataFrame(sides, "machine string, lang string, side int, most int")

    def prepared(batches):
        for batch in batches:
            texts, lang_, place = batch.columns
            yield {"lang": lang_, "place": place, "x": list(features(texts.to_pylist()))}

    # Texts become vectors once; these travel to the machines, not the texts.
    vectors = staged(map_batches(sample, prepared, "lang string, place int, x array<float>"), "vectors")
    rows = vectors.join(F.broadcast(table), "lang").filter(F.col("place") <= F.col("most"))
    bounded_batches(spark)

    def fit(key, rows):
        # The order of rows must not matter for the result of a rerun task.
        ordered = rows.sort_by([("lang", "ascending"), ("place", "ascending")])
        x = ordered.column("x").combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
        w = train_machine(x, ordered.column("side").to_numpy())
        return pa.table({"machine": [key[0].as_py()], "weights": [w.tolist()]})

    slim = rows.select("machine", "side", "lang", "place", "x")
    fitted = slim.groupBy("machine").applyInArrow(fit, "machine string, weights array<double>")
    for r in fitted.collect():
        kind, *names = r["machine"].split("\t")
        weights = np.array(r["weights"])
        if kind == "family":
            out.families[names[0]] = weights
        else:
            out.pairs[names[0], names[1]] = weights
    return out


def predicted(
    docs: DataFrame, machines: Machines, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; reads id and text only."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(f"`{text}`")
    )

    def run(batches):
        for batch in batches:
            langs, scores = machines.predict(batch.column(2).to_pylist())
            yield {
                "doc_id": batch.column(0),
                "held_out": batch.column(1),
                "lang_pred": langs,
                "score": scores,
            }

    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Languages of ``docs``, learned from its own labelled rows."""
    return predicted(docs, train(docs))


def with_known_language(
    docs: DataFrame,
    machines: Machines,
    text: str = "text",
    least: float = 0.0,
    wanted: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs``, all columns, in a wanted language, told with at least this score.

    ``wanted`` has learned languages, all of them if it is None. Rows without
    letters have no language. If nothing was learned, all others stay.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def keep(batches):
        lean()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores = machines.predict(texts)
            mask = [
                has_letters(t)
                and (not machines.members or (s >= least and (wanted is None or lang in wanted)))
                for t, lang, s in zip(texts, langs, scores, strict=True)
            ]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
