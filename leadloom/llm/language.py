"""Language identification by hierarchical discrimination: the language family first, then one-versus-one linear support vector machines
within the family.

A text's features are the frequencies of hashed byte trigrams of its lower-cased letters (square-rooted, unit length), taken over the whole
text. Learning uses rows that are not held out and have a language and a letter: of each language about `per_language` of them,
chosen by a hash of their id (the bound of the sample; the sample's size does not grow with the corpus). Families come from a table of
language codes; a code outside it is a family of its own. Each pair of families, and each pair of languages within a family, gets a linear
SVM; the votes decide, margins break ties. The models are a few weight vectors and go to the tasks by closure.

Cases: null text, or one without a letter, is `und` with score 0; a null id counts as the empty string when the fold is computed; if
nothing can be learned every row is `und`; one language alone is always predicted; repeated rows are judged row by row; an empty
table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, sql_type

DIMENSIONS, PER_LANGUAGE = 1024, 300
#: Languages that are learned at most, the most frequent ones: the fits grow with the pairs within a family.
MOST_LANGUAGES = 60
#: The family of codes that the table lacks.
OTHERS = "others"
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn ur pa mr gu ne si",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Bytes that count: ASCII letters and all bytes of other characters; the rest is one blank.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    a = FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]  # runs of blanks as one
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(a), 1 << 18):
        b = a[at : at + (1 << 18) + 2]
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            counts += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=DIMENSIONS)
    out = np.sqrt(counts)
    return out / (np.linalg.norm(out) or 1.0)


def has_letter(text: str) -> bool:
    """Whether the text has a character of category L; numerals and marks are none."""
    return any(map(str.isalpha, text))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


class Model:
    """Weight vectors of the pairs, by (first, second): positive for the second."""

    def __init__(self, families: dict[str, list[str]], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.families, self.pairs = families, list(pairs.items())
        self.weights = np.array([w for w, _ in pairs.values()]).reshape(-1, DIMENSIONS)
        self.offsets = np.array([b for _, b in pairs.values()])

    def predict(self, text: str) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        margins = dict(zip((k for k, _ in self.pairs), self.weights @ features(text) + self.offsets, strict=True))
        family, sure = self.vote(sorted(self.families), margins, "family:")
        language, surer = self.vote(self.families[family], margins, "")
        return language, sure * surer

    @staticmethod
    def vote(names: list[str], margins: dict, prefix: str) -> tuple[str, float]:
        score = {n: [0, 0.0] for n in names}
        for a, b in combinations(names, 2):
            m = margins[prefix + a, prefix + b]
            score[b if m > 0 else a][0] += 1
            score[a][1] -= m
            score[b][1] += m
        best = max(names, key=lambda n: (*score[n], n))
        against = [margins[prefix + min(best, n), prefix + max(best, n)] * (1 if n < best else -1) for n in names if n != best]
        return best, float(1 / (1 + np.exp(-4 * min(against)))) if against else 1.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit the pairs on about per_language rows of each language."""
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MOST_LANGUAGES).collect()}
    part = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n)))) if counts else None
    if part is None:
        return Model({}, {})
    chosen = known.where(F.col(lang_col).isin(list(counts))).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < part[F.col(lang_col)] * (1 << 20))

    def make():
        return lambda cols, texts: {"lang": cols[0], "x": [features(t) for t in texts]}

    sample = cut(map_texts(chosen, [lang_col, text_col], "lang string, x array<double>", make), "language-sample")
    names = sorted(r.lang for r in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for n in names:
        families.setdefault(FAMILY_OF.get(n, OTHERS), []).append(n)
    rows = sample.select(F.col("lang"), F.create_map(*(F.lit(x) for n in names for x in (n, FAMILY_OF.get(n, OTHERS))))[F.col("lang")].alias("family"), array_to_vector("x").alias("features"))
    rows = rows.coalesce(2).cache()
    pairs = {}
    for column, prefix, groups in (("family", "family:", [sorted(families)]), ("lang", "", families.values())):
        for group in groups:
            for a, b in combinations(group, 2):
                fitted = LinearSVC(maxIter=10, regParam=1e-3).fit(rows.where(F.col(column).isin(a, b)).select("features", (F.col(column) == b).cast("double").alias("label")))
                pairs[prefix + a, prefix + b] = fitted.coefficients.toArray(), fitted.intercept
    rows.unpersist()
    return Model(families, pairs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""

    def make():
        def work(cols, texts):
            found = [model.predict(t) for t in texts]
            return {"doc_id": cols[0], "lang_pred": [x for x, _ in found], "score": pa.array([s for _, s in found], pa.float64())}

        return work

    out = map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, lang_pred string, score double", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, train(docs, id_col, text_col, lang_col, per_language), id_col, text_col)
