"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtables.llm.ranks import SHUFFLE_RANGE, shuffle_number
from mailtables.llm.stored import lookup, packed, saved
from mailtables.llm.words import pieces, text_bytes

#: Labelled rows that word lists, trees and calibration are fitted on, at most about this many (chosen by a hash of
#: the id). Scores cover every row.
FIT_ROWS = 20_000
TREES, DEPTH = 30, 4
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: Learned word beginnings and words, the strongest ones.
LEARNED = 400
_NEAR = 5
_PART = 1 << 20  # characters of a long text looked at together

INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers scum trash clown pathetic worthless disgusting "
    "garbage imbecile idiota imbécil estúpido estúpida basura idiote imbécile stupide ordure "
    "dumm dummkopf abschaum müll trottel".split()
)
THREATS = frozenset(
    "hate hates kill die dead shut hurt burn odio muere matar calla haine meurs crever tuer hass stirb töten".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tú tu tus usted ustedes ti toi te ton tes vous votre vos du dich dir dein "
    "deine euch ihr".split()
)
_WORD = re.compile(r"[^\W\d_]+")
# Each of these starts with what is rare, so that most of a text is passed over quickly.
_MASK = re.compile(r"[*@$#!0-9]+(?=[^\W\d_])")
_MAYBE_SPACED = re.compile(r"[ .\-][^\W\d_][ .\-][^\W\d_][ .\-]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?!\w)")
_SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}")
_TOKEN = 40
_UNMASK = str.maketrans("@$!013457", "asioieast")
_DROP = str.maketrans("", "", "*#.- ")

FEATURES = (
    "words", "insults", "insult_count", "threats", "learned_words", "learned_beginnings", "learned_odds",
    "learned_count", "second_person", "second_person_near", "capitals", "shouted", "exclaimed", "punctuation",
    "digits", "masked", "masked_insults", "stretched", "word_length", "different_words",
)


@dataclass(frozen=True)
class Lexicon:
    """Log odds of toxicity of learned words, and of learned word beginnings (4 to 6 letters)."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of bounded length, cut at white space where there is any."""
    start = 0
    while start < len(text):
        stop = min(start + _PART, len(text))
        if stop < len(text):
            gap = max(text.rfind(" ", start, stop), text.rfind("\n", start, stop))
            stop = gap + 1 if gap > start else stop
        yield text[start:stop]
        start = stop


def _near(words: list[str], hits: set[str]) -> int:
    """Hits with a second-person word within a few words."""
    persons = [at for at, word in enumerate(words) if word in SECOND_PERSON]
    if not persons:
        return 0
    places = [at for at, word in enumerate(words) if word in hits]
    after = np.searchsorted(persons, places)
    ends = np.concatenate([[-_NEAR - 1], persons, [len(words) + _NEAR + 1]])
    return int((np.minimum(np.array(places) - ends[after], ends[after + 1] - np.array(places)) <= _NEAR).sum())


def _masked(text: str) -> Iterator[str]:
    """Words with signs or digits between their letters, and words spelled letter by letter."""
    for match in _MASK.finditer(text):
        start = match.start()
        if start and text[start - 1].isalpha():
            yield text[max(0, start - _TOKEN):start].split()[-1] + text[start:match.end() + _TOKEN].split(None, 1)[0]
    if _MAYBE_SPACED.search(text):
        for match in _SPACED.finditer(text):
            yield match[0]


def features(text: str, lexicon: Lexicon, kinds: np.ndarray, size: int) -> list[float]:
    """The dense features of one text.

    `kinds` counts, by byte, its capitals, ! and ?, other punctuation, digits, and letters met three times in a row.
    """
    n = insults = threats = persons = near = masked = masked_insults = shouted = letters = 0
    learned_words = learned_begins = different = 0
    odds = 0.0
    for part in _parts(text):
        words = _WORD.findall(part.lower())
        n += len(words)
        counts = Counter(words)
        different += len(counts)
        found = counts.keys() & INSULTS
        insults += sum(counts[w] for w in found)
        threats += sum(counts[w] for w in counts.keys() & THREATS)
        persons += sum(counts[w] for w in counts.keys() & SECOND_PERSON)
        for word, count in counts.items():
            letters += len(word) * count
            own = lexicon.words.get(word)
            if own is not None:
                learned_words += count
                odds += own * count
            if len(word) >= 4 and lexicon.beginnings:
                begin = max(lexicon.beginnings.get(word[:4], 0.0), lexicon.beginnings.get(word[:5], 0.0), lexicon.beginnings.get(word[:6], 0.0))
                if begin:
                    learned_begins += count
                    odds += begin * count
        if found:
            near += _near(words, found)
        for token in _masked(part):
            masked += 1
            plain = token.lower().strip(".,;:?\"')(")
            masked_insults += plain.translate(_UNMASK).translate(_DROP) in INSULTS or plain.translate(_DROP) in INSULTS
        shouted += len(_SHOUTED.findall(part))
    whole, chars = max(1, n), max(1, size)
    return [
        math.log1p(n), insults / whole, math.log1p(insults), threats / whole, learned_words / whole,
        learned_begins / whole, odds / whole, math.log1p(learned_words + learned_begins), persons / whole, near / whole,
        kinds[1] / chars, shouted / whole, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, masked / whole,
        masked_insults / whole, kinds[5] / chars, letters / whole, different / whole,
    ]


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[65:91] = 1
    kinds[[33, 63]] = 2
    kinds[[c for c in range(33, 127) if not chr(c).isalnum() and c not in (33, 63)]] = 3
    kinds[48:58] = 4
    return kinds


_KINDS = _byte_kinds()
_LETTER = np.array([chr(code).isalpha() and code < 128 for code in range(256)])


def _counted_kinds(text: np.ndarray) -> list[int]:
    kinds = np.bincount(_KINDS[text], minlength=5).tolist()
    again = (text[2:] == text[1:-1]) & (text[1:-1] == text[:-2]) & _LETTER[text[2:]]
    return [*kinds, int(again.sum())]


def feature_column(lexicon: Lexicon) -> Callable[[Column], Column]:
    """A column function from text to the array of features; null counts as empty."""

    @F.arrow_udf("array<double>")
    def extract(column: pa.Array) -> pa.Array:
        rows = []
        for part in pieces(pa.RecordBatch.from_arrays([column], ["text"]), 0):
            data, bounds = text_bytes(part.column(0))
            for at, text in enumerate(part.column(0).to_pylist()):
                own = data[bounds[at]:bounds[at + 1]]
                rows.append(features(text or "", lexicon, _counted_kinds(own), len(own)))
        return pa.array(rows, pa.list_(pa.float64()))

    return extract


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo `FOLDS`; a row without id is in fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic, fold of the labelled documents to fit on; none of them is held out.

    A document with several labels is toxic if one says so; labels that are null or not 0 or 1 are left out.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    marked = saved(marked, "toxic-labels")
    share = min(1.0, rows / max(1, marked.count()))
    chosen = marked.filter(shuffle_number(F.col("doc_id"), "fit") < F.lit(share * SHUFFLE_RANGE))
    chosen = chosen.withColumnRenamed("doc_id", "label_id")
    joined = docs.select("doc_id", "text").join(lookup(saved(chosen, "toxic-sample")), F.col("doc_id") == F.col("label_id"))
    return saved(joined.select("doc_id", "text", "toxic", "fold"), "toxic-fit")


def learn_lexicon(sample: DataFrame, size: int = LEARNED) -> Lexicon:
    """The words and word beginnings that most tell toxic documents of the sample from the others."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = set()
                for part in _parts(text or ""):
                    for word in set(_WORD.findall(part.lower())):
                        units.add("=" + word)
                        units.update("^" + word[:k] for k in (4, 5, 6) if len(word) >= k)
                (toxic if label else other).update(units)
        names = sorted(toxic)
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()),
            pa.array([other[u] for u in names], pa.int64()),
        ], ["unit", "toxic", "other"])
        names = sorted(set(other) - set(toxic))
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()),
            pa.array([other[u] for u in names], pa.int64()),
        ], ["unit", "toxic", "other"])

    rows = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    units = sample.select("text", "toxic").mapInArrow(counted, "unit string, toxic bigint, other bigint")
    units = units.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (rows[0] + 1)) - F.log((F.col("other") + 0.5) / (rows[1] + 1))
    units = units.withColumn("odds", odds).filter((F.col("toxic") >= max(3, rows[0] // 100)) & (F.col("odds") > 1))
    best = units.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "unit").limit(size).collect()
    return Lexicon(
        {r["unit"][1:]: r["odds"] for r in best if r["unit"][0] == "="},
        {r["unit"][1:]: r["odds"] for r in best if r["unit"][0] == "^"},
    )


@dataclass
class Model:
    """A fitted scorer. Without trees (labels of one kind only, or none) every score is `prior`."""

    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    prior: float = 0.0

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` with `score` (0 to 1) added or replaced, from the text alone; null texts count as empty ones."""
        if self.trees is None:
            return docs.withColumn("score", F.lit(float(self.prior)))
        rows = packed(docs, "doc", without=("score",))
        rows = rows.withColumn("_features", array_to_vector(feature_column(self.lexicon)(F.col("doc.text"))))
        rows = self.trees.transform(rows).withColumn("_raw", vector_to_array("_probability")[1]).drop("_probability")
        if self.calibration is None:
            return rows.select("doc.*", F.col("_raw").alias("score"))
        rows = self.calibration.transform(rows)
        # the calibrated rate has steps; a small part of the trees' own score orders the rows of a step
        score = F.col("_calibrated") * 0.98 + F.col("_raw") * 0.02
        return rows.select("doc.*", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold: word lists and trees on three folds, calibration on one."""
    sample = fit_sample(docs, labels, rows)
    training = sample.filter(F.col("fold") != CALIBRATION)
    kinds = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Model(Lexicon(), prior=1.0 if 1 in kinds else 0.0)
    lexicon = learn_lexicon(training)
    table = sample.select(
        "fold", F.col("toxic").cast("double").alias("label"), feature_column(lexicon)(F.col("text")).alias("values"), "doc_id"
    )
    table = saved(table, "toxic-features").withColumn("_features", array_to_vector("values"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7,
        minInstancesPerNode=3, maxMemoryInMB=64,
    ).fit(table.filter(F.col("fold") != CALIBRATION))
    trees.setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_probability")
    held = trees.transform(table.filter(F.col("fold") == CALIBRATION)).select(
        "label", vector_to_array("_probability")[1].alias("_raw")
    )
    held = saved(held, "toxic-calibration")
    calibration = None
    if held.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(held)
    return Model(lexicon, trees, calibration)


def scored(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted` (1 from a score of 0.5 on) added.

    Labels, lang, source and doc_id are no inputs of a score: equal texts score alike. Null and empty texts get a
    score as well. Columns of these names are replaced; an empty table gives an empty result; without labels of both
    kinds all scores are 0 (or 1).
    """
    kept = docs.drop("held_out", "score", "predicted")
    rows_ = fit(docs, labels, rows).score(kept)
    return rows_.withColumns({
        "held_out": fold(F.col("doc_id")) == HELD_OUT, "predicted": (F.col("score") >= 0.5).cast("int"),
    })


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with its own columns."""
    return scored(docs, labels, **options).filter("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
