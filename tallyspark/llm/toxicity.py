"""Toxicity: a weighted lexicon, learnt from labelled rows, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, field, give_back, lean, packed, whole

# Look-alike letters and digits or signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l", "ꓲ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
JOINERS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_SIMPLE = str.maketrans(HOMOGLYPHS | dict.fromkeys(JOINERS))
_SIGNS = str.maketrans(SUBSTITUTES)
_RUN = re.compile(r"[\w@$!]+")
_SIGNED = re.compile(r"[013457@$!]")
_WORD = re.compile(r"[^\W\d_]+")


def _plain(run: re.Match) -> str:
    """A run of letters, digits and signs; if it has letters, its digits and signs stand for some."""
    text = run[0]
    return text.rstrip("!").translate(_SIGNS) if _SIGNED.search(text) and _WORD.search(text) else text


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs inside words as letters, one blank before and after each word.

    A trailing run of ! stays outside the word. Time is linear in the text's length.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_SIMPLE)
    if _SIGNED.search(text):
        text = _RUN.sub(_plain, text)
    return " " + " ".join(_WORD.findall(text)) + " "


def _starts(words: set[str], shortest: int, longest: int) -> set[str]:
    """Every word with blanks around it, and every beginning of shortest to longest letters with a blank before it."""
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:n]}" for n in range(shortest, min(longest, len(w)) + 1))
    return out


def machine(entries: dict[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (entry, weight) in enumerate(sorted(entries.items())):
        out.add_word(entry, (k, len(entry), weight))
    out.make_automaton()
    return out


def features(folded: str, lexicon: ahocorasick.Automaton, exceptions: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """log(1 + matched weight), log(1 + weight per 100 words), log(1 + distinct entries) of a folded text.

    A match counts once per word, with its largest weight, and not if it begins inside a match of an exception.
    """
    at: dict[int, tuple[float, int]] = {}
    for end, (k, n, weight) in lexicon.iter(folded):
        start = end - n + 1
        if start not in at or at[start][0] < weight:
            at[start] = (weight, k)
    if at and exceptions is not None:
        spans, reach, k = sorted((end - n + 1, end) for end, (_, n, _) in exceptions.iter(folded)), 0, 0
        for start in sorted(at):
            while k < len(spans) and spans[k][0] <= start:
                reach, k = max(reach, spans[k][1]), k + 1
            if start < reach:
                del at[start]
    mass = sum(w for w, _ in at.values())
    return math.log1p(mass), math.log1p(100 * mass / folded.count(" ")), math.log1p(len({k for _, k in at.values()}))


class Model:
    """Lexicon and exception phrases with a logistic curve over features(); plain data, so it pickles."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], curve: list[float]) -> None:
        self.lexicon, self.exceptions, self.curve = lexicon, exceptions, curve
        self._machines = None

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "exceptions": self.exceptions, "curve": self.curve, "_machines": None}

    def machines(self):  # noqa: ANN201
        if self._machines is None:
            self._machines = machine(self.lexicon) if self.lexicon else None, machine(dict.fromkeys(self.exceptions, 0.0)) if self.exceptions else None
        return self._machines

    def features(self, folded: str) -> tuple[float, float, float]:
        lexicon, exceptions = self.machines()
        return features(folded, lexicon, exceptions) if lexicon else (0.0, 0.0, 0.0)

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.features(fold(text)), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _counts(sample: DataFrame, count, schema: str) -> DataFrame:
    """Over all rows of sample, folded and toxic, the sums of the entries that count(folded, toxic) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total.update(count(text.as_py(), toxic))
            if len(total) > 300_000:
                yield pa.RecordBatch.from_pydict({"entry": list(total), "n": pa.array(total.values(), pa.int64())})
                total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"entry": list(total), "n": pa.array(total.values(), pa.int64())})

    return sample.select("folded", "toxic").mapInArrow(lean(run), schema).groupBy("entry").agg(F.sum("n").alias("n"))


def _sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows by a hash of key, all where there are no more."""
    n = rows.count()
    return rows if n <= most * 1.1 else rows.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def labelled_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """text, toxic of about ``max_rows`` labelled rows that are not held_out(); the sampled labels, so bounded, are broadcast.

    An id that is labelled more than once counts once, as toxic if any of its labels says so. Null ids
    and labels are left out, as are labels without a row; rows repeated with one id count as rows.
    """
    some = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    some = F.broadcast(_sample(some.groupBy("id").agg(F.max("toxic").alias("toxic")), F.col("id"), max_rows))
    return packed(df).join(some, field(id_col) == F.col("id")).select(field(text_col).alias("text"), "toxic")


def _copy_key(folded: str) -> int:
    """The smallest hash of a folded text's four-word runs, which near copies mostly share."""
    words = folded.split()
    return min(xxhash.xxh64_intdigest(" ".join(words[k : k + 4])) for k in range(max(1, len(words) - 3)))


def _folded(texts: pa.Array) -> pa.Array:
    folded = [fold(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array(np.array([_copy_key(t) for t in folded], np.uint64).view(np.int64)), pa.array(folded, pa.string())], names=["copy", "folded"])


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, shortest: int = 4, longest: int = 10) -> Model:
    """A Model from rows with a 0/1 label.

    The fit uses a bounded sample: about ``max_rows`` rows, chosen by a hash of the text, all of them where there
    are fewer; of near copies with one label, one row counts, as copies would make every word of a text
    look telling. All else follows from the whole sample. Candidate entries are words and word beginnings of
    ``shortest`` to ``longest`` letters that three or more toxic rows hold; an entry stays if its likelihood
    ratio against the base rate beats chance among so many candidates, and if it is no extension of an
    entry that does as well. Its weight is the smoothed log odds, log(10) at least. Exceptions are an entry's
    word with a neighbour that five or more clean rows hold and no toxic one. Other labels than 0 and 1 are left
    out; null texts count as empty; with one class only, every score is that class's rate, without any row 0.
    """
    rows = cut(labelled.select(whole(text_col).alias("text"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)))
    rows = _sample(rows, F.col("text"), max_rows).select(F.arrow_udf(_folded, "copy long, folded string")("text").alias("f"), "toxic")
    rows = cut(rows.groupBy("f.copy", "toxic").agg(F.min("f.folded").alias("folded")))
    totals = dict(rows.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model({}, [], [60.0 if bad else -60.0, 0.0, 0.0, 0.0])

    found = _counts(rows.filter("toxic = 1"), lambda folded, _: _starts(set(folded.split()), shortest, longest), "entry string, n long")
    positive = dict(found.filter("n >= 3").collect())
    sent = labelled.sparkSession.sparkContext.broadcast(frozenset(positive))
    found = _counts(rows.filter("toxic = 0"), lambda folded, _: _starts(set(folded.split()), shortest, longest) & sent.value, "entry string, n long")
    negative = dict(found.collect())

    rate, chance = bad / (bad + good), math.log(max(2, len(positive)) * 20)

    def gain(p: int, q: int) -> float:
        share = p / (p + q)
        return p * math.log(share / rate) + (q * math.log((1 - share) / (1 - rate)) if q else 0.0) if share > rate else 0.0

    fit = {e: (gain(p, negative.get(e, 0)), math.log((p + 0.5) / (bad + 1)) - math.log((negative.get(e, 0) + 0.5) / (good + 1))) for e, p in positive.items()}
    lexicon: dict[str, float] = {}
    for e in sorted(fit, key=lambda e: (len(e), e)):
        g, weight = fit[e]
        if g < chance or weight < math.log(10):
            continue
        if any(fit[e[:n]][1] >= weight - 0.1 for n in range(shortest + 1, len(e)) if e[:n] in lexicon):
            continue
        lexicon[e] = weight

    exceptions: list[str] = []
    if lexicon:
        model = labelled.sparkSession.sparkContext.broadcast(Model(lexicon, [], [0.0] * 4))

        def around(folded: str, _: int) -> set[str]:
            out = set()
            for end, (_, n, _) in model.value.machines()[0].iter(folded):
                start, stop = end - n + 1, folded.find(" ", end - n + 2)
                before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                out.update(folded[a : b + 1] for a, b in ((before, stop), (start, after)) if a >= 0 and b >= 0)
            return out

        clean = [r.entry for r in _counts(rows.filter("toxic = 0"), around, "entry string, n long").filter("n >= 5").collect()]
        asked = labelled.sparkSession.sparkContext.broadcast(frozenset(clean))
        held = {r.entry for r in _counts(rows.filter("toxic = 1"), lambda folded, y: around(folded, y) & asked.value, "entry string, n long").collect()}
        exceptions = sorted(set(clean) - held)

    model = Model(lexicon, exceptions, [0.0] * 4)
    sent_model = labelled.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((y, *(round(x, 2) for x in sent_model.value.features(t.as_py()))) for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"y": [s[0] for s in seen], **{f"f{k}": [s[k + 1] for s in seen] for k in range(3)}, "n": list(seen.values())})

    points = np.array([list(r) for r in rows.select("folded", "toxic").mapInArrow(measure, "y long, f0 double, f1 double, f2 double, n long").collect()])
    x, y, n_each = np.c_[np.ones(len(points)), points[:, 1:4]], points[:, 0], points[:, 4]
    curve, ridge = np.zeros(4), np.array([1e-3, 0.1, 0.1, 0.1])
    for _ in range(50):  # Newton steps of ridge regression
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (n_each * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (n_each * (y - p)) - ridge * curve)
        curve = curve + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(lexicon, exceptions, [float(c) for c in curve])


def toxicity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with toxicity (double, 0 to 1) added; one pass, nothing shuffled, the model is bounded by train()'s parameters.

    Null and empty texts get the score of a text without matches. An input column named toxicity is
    replaced; other columns stay, whatever their names.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array([sent.value.score(t.as_py() or "") for t in texts], pa.float64())
        give_back()
        return out

    return df.withColumn("toxicity", score(whole(text_col)))


def held_out(id_: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32(id as text) mod parts is part; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % parts == part
