"""Language identification by hierarchical discrimination.

Features are counts of letter n-grams (1 to 3 letters of the lower-cased text, words apart) in hashed
buckets, as square roots scaled to length one.  A linear machine per pair of families picks the family;
one-versus-one linear support vector machines then separate the languages within it, by votes and margins.

Counting covers whole texts.  Fitting takes a bounded sample of the labelled rows: about `per_language`
different texts for either side of a machine, chosen by a hash of the text.  Each machine is fitted in a task
of its own from the sample of its two sides; only weights (8 KB a machine) reach the driver.  The number of
machines grows with the pairs of families and the pairs of languages within a family.

Cases: a null text or one without a letter is `und` with score 0; rows with a null language teach nothing;
with no labelled row everything is `und`; with one language every text with a letter is that one; repeated
rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod4, cut, free_name

#: Language codes of some families; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
BUCKETS = 2048
_WORDS = re.compile(r"[^\W\d_]+")
_HASHES = 1 << 62  # so many that no language's share is rounded to none


def _words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    words = _WORDS.findall(text.lower())
    if words and not "".join(words).isalpha():  # numbers such as ² or Ⅷ are word characters, but no letters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return words


def features(text: str | None) -> np.ndarray | None:
    """The scaled n-gram counts of one whole text; None if it has no letter."""
    words = _words_of(text) if text else []
    if not words:
        return None
    counts = np.zeros(BUCKETS)
    for i in range(0, len(words), 1 << 16):  # a very long text goes through in parts
        c = np.frombuffer((" " + " ".join(words[i : i + (1 << 16)]) + " ").encode("utf-32-le", "replace"), np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        for h in (c * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)):
            counts += np.bincount(h >> np.uint32(32 - 11), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


@dataclass(frozen=True)
class Machine:
    """Says `yes` where weights . x + bias > 0, else `no`."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LanguageModel:
    families: dict[str, tuple[str, ...]]
    between: tuple[Machine, ...]
    within: dict[str, tuple[Machine, ...]]

    @staticmethod
    def _vote(names: tuple[str, ...], machines: tuple[Machine, ...], x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """For each row of x the winner by votes, then by summed margins; and how sure."""
        margins = {n: np.zeros(len(x)) for n in names}
        votes = {n: np.zeros(len(x)) for n in names}
        worst = {n: np.full(len(x), np.inf) for n in names}
        for m in machines:
            d = x @ m.weights + m.bias
            for name, s in ((m.yes, d), (m.no, -d)):
                votes[name] += s > 0
                margins[name] += np.tanh(s)
                worst[name] = np.minimum(worst[name], s)
        total = np.stack([votes[n] + margins[n] / (2 * len(names)) for n in names])
        best = total.argmax(0)
        least = np.stack([worst[n] for n in names])[best, np.arange(len(x))]
        return [names[i] for i in best], np.where(np.isinf(least), 1.0, 1 / (1 + np.exp(-3 * np.clip(least, -50, 50))))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = tuple(self.families)
        family, sure = self._vote(names, self.between, x)
        lang = np.empty(len(x), object)
        for name in names:
            rows = np.array([f == name for f in family])
            if rows.any():
                lang[rows], s = self._vote(self.families[name], self.within[name], x[rows])
                sure[rows] *= s
        return list(lang), sure


def _svm(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 12, batch: int = 32, reg: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradients of the hinge loss; y is +1 or -1."""
    rng, w, b, n = np.random.default_rng(seed), np.zeros(x.shape[1]), 0.0, len(x)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    mean_w, mean_b, steps = np.zeros_like(w), 0.0, 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            r = order[i : i + batch]
            rate = 8.0 / (1 + 0.3 * epoch)
            hard = r[y[r] * (x[r] @ w + b) < 1]
            w *= 1 - rate * reg
            if len(hard):
                g = (y[hard] * weight[hard])[:, None] * x[hard]
                w += rate * g.sum(0) / batch
                b += 0.1 * rate * (y[hard] * weight[hard]).sum() / batch
            if epoch >= epochs // 2:
                mean_w, mean_b, steps = mean_w + w, mean_b + b, steps + 1
    return mean_w / max(1, steps), mean_b / max(1, steps)


@dataclass(frozen=True)
class Task:
    """A machine to fit: what stands for yes and no, and for each language its side and its share of hashes."""

    yes: str
    no: str
    family: str | None  # whose languages it separates; None: it separates families
    sides: dict[str, tuple[float, int]]


def tasks(sizes: dict[str, int], per_language: int) -> tuple[dict[str, tuple[str, ...]], list[Task]]:
    """The languages of each family, and the machines: one for each pair of families, and of languages of one family."""
    families: dict[str, list[str]] = {}
    for lang in sorted(sizes):
        families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    families = {f: tuple(names) for f, names in sorted(families.items())}

    def side(y: float, names: tuple[str, ...]) -> dict[str, tuple[float, int]]:
        return {n: (y, int(min(1.0, per_language / len(names) / sizes[n]) * _HASHES)) for n in names}

    found = [Task(a, b, None, side(1.0, families[a]) | side(-1.0, families[b])) for a, b in combinations(families, 2)]
    found += [Task(a, b, f, side(1.0, (a,)) | side(-1.0, (b,))) for f, names in families.items() for a, b in combinations(names, 2)]
    return families, found


def sample(docs: DataFrame, per_language: int) -> tuple[dict[str, int], DataFrame]:
    """About how many different texts each language has, and those that may teach: lang, text and a hash below 2^62."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod4(F.col("doc_id")), F.lit(0)) != 2))
    # a row for each language: its different texts, as copies are picked together
    sizes = {r["lang"]: max(1, r["n"]) for r in known.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    most = F.coalesce(
        *[F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_language / n) * _HASHES))) for lang, n in sorted(sizes.items())],
        F.lit(0),
    )
    # by the text, so that copies count once or not at all, whichever their ids
    picked = known.select("lang", "text", F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(_HASHES)).alias("hash"))
    return sizes, picked.filter(F.col("hash") < most).dropDuplicates()


def learn(docs: DataFrame, per_language: int = 1200) -> LanguageModel:
    """A model from rows whose crc32(doc_id) mod 4 is not 2, with about `per_language` texts on either side of a machine."""
    sizes, picked = sample(docs, per_language)
    families, wanted = tasks(sizes, per_language)
    if not wanted:
        return LanguageModel(families, (), {f: () for f in families})
    of_lang = {lang: [(k, *t.sides[lang]) for k, t in enumerate(wanted) if lang in t.sides] for lang in sizes}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                rows = []
                for lang, text, h in zip(*(c.to_pylist() for c in part.columns)):
                    if (f := features(text)) is not None:
                        x = f.astype("<f2").tobytes()
                        rows += [(k, y, x) for k, y, most in of_lang[lang] if h < most]
                machine, y, x = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(machine, pa.int32()), pa.array(y, pa.float64()), pa.array(x, pa.binary())],
                    names=["machine", "y", "x"],
                )

    def fitted(rows: pa.Table) -> pa.Table:
        both = sorted(zip(rows.column("y").to_pylist(), rows.column("x").to_pylist()))  # the order that the seed shuffles
        weights, bias = _svm(np.stack([np.frombuffer(x, "<f2") for _, x in both]).astype(float), np.array([y for y, _ in both]))
        return pa.table(
            {"machine": rows.column("machine")[:1], "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": [bias]}
        )

    rows = picked.mapInArrow(described, "machine int, y double, x binary")
    done = rows.groupBy("machine").applyInArrow(fitted, "machine int, weights binary, bias double").collect()  # a row for each machine
    machines = {
        r["machine"]: Machine(
            wanted[r["machine"]].yes, wanted[r["machine"]].no, np.frombuffer(r["weights"], "<f4").astype(float), r["bias"],
        ) for r in done
    }
    of = lambda family: tuple(machines[k] for k, t in enumerate(wanted) if t.family == family and k in machines)
    return LanguageModel(families, of(None), {f: of(f) for f in families})


def identify(docs: DataFrame, model: LanguageModel, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the language and the score added; all other columns pass through, those of these two names are replaced."""
    docs = docs.drop(lang_name, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*").schema.add(lang_name, "string").add(score_name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in cut(batch):
                found = [features(t) if known.families else None for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                rows = [i for i, f in enumerate(found) if f is not None]
                lang, score = ["und"] * len(found), [0.0] * len(found)
                if rows:
                    for i, name, s in zip(rows, *known.predict(np.stack([found[i] for i in rows]))):
                        lang[i], score[i] = name, float(s)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names, lang_name, score_name],
                )

    return docs.mapInArrow(run, schema)


def predicted(docs: DataFrame, per_language: int = 1200) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the rows that aren't held out."""
    out = identify(docs.select("doc_id", "text"), learn(docs, per_language))
    return out.select("doc_id", F.coalesce(crc_mod4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, least_score: float = 0.0, per_language: int = 1200) -> DataFrame:
    """The rows whose text has a language: not `und`, and a score of at least `least_score`.

    Where no row teaches a language, none can be told to be unknown: all texts with a letter stay, at a `least_score` of 0.
    """
    lang, score, model = free_name(docs, "lang_pred"), free_name(docs, "lang_score"), learn(docs, per_language)
    if not model.families and least_score <= 0:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = identify(docs, model, lang, score)
    return out.filter((F.col(lang) != "und") & (F.col(score) >= least_score)).drop(lang, score)
